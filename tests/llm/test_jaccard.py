from __future__ import annotations

import random
import re

import pytest
from compare import differences

from veilframe.llm import jaccard
from veilframe.llm.oracles import JACCARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(n_shingles, component) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    boss = list(range(len(rows)))

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if m and 100 * m >= 75 * (len(sets[i]) + len(sets[j]) - m):
                a, b = top(i), top(j)
                boss[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted((d if d is not None else -99, len(s), -99 if (c := low.get(top(i))) is None else c) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df, **params):
    return sorted((-99 if r.doc_id is None else r.doc_id, r.n_shingles, -99 if r.component_id is None else r.component_id) for r in jaccard.near_components(df, jaccard.JoinParams(**params)).collect())


def test_same_as_sql(spark):
    d = "/root/testdata/sf0.01"
    assert differences(jaccard.near_components(spark.read.parquet(f"{d}/documents.parquet")), d, JACCARD) == ""


def test_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert got(edges) == brute(rows)
    assert jaccard.near_components(nothing).count() == 0
    kept = jaccard.one_of_each(edges)
    assert kept.columns == edges.columns and {4, 5, 6} <= {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("params", [{}, {"small": 2, "pivots": 1}, {"small": 2, "pivots": 2, "order_rate": 1, "order_least": 2}, {"broadcast_rows": 0}])
def test_large_regions_by_brute_force(spark, params):
    """Copies with edits around the threshold that share a passage: large regions, several pivots."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    base = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((i * 3, " ".join(w)))
    rows += [(1 + i * 3, " ".join([word() for _ in range(12)] + passage + [word() for _ in range(rng.randint(0, 9))])) for i in range(40)]
    rows += [(500, rows[0][1]), (501, rows[0][1].upper()), (502, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, **params) == brute(rows)


def test_one_row_of_each_component(spark, edges):
    """Repeated rows, null ids, shared ids and copies in other case: one row stays of each linked group, with its own columns."""
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, text, "b"), (5, text, "a"), (5, text, "a"), (7, text.upper(), "c"), (None, text, "d"), (None, text, "d"), (5, other, "e"), (None, "only here", "f"), (None, "only here", "f"), (8, None, "g"), (8, None, "g"), (None, "", "h")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert sorted(got, key=repr) == sorted([(5, text, "a"), (5, other, "e"), (None, "only here", "f"), (8, None, "g"), (8, None, "g"), (None, "", "h")], key=repr)
    kept = jaccard.one_of_each(edges)
    want = {repr(r) for r in edges.collect()}
    assert all(repr(r) in want for r in kept.collect()) and kept.schema.simpleString() == edges.schema.simpleString()


def test_components_of_a_chain(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    r = {x.id: x.comp for x in jaccard.components(links).collect()}
    assert all(r[i] == 0 for i in range(n + 1)) and r[101] == 100
