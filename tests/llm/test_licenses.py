from __future__ import annotations

import random

from veilframe.llm import licenses as lic

from .conftest import words


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_rising():
    rng = random.Random(1)
    for _ in range(50):
        pairs = list(enumerate(rng.sample(range(30), 12)))
        got = lic.rising(pairs)
        assert all(a[1] < b[1] for a, b in zip(got, got[1:]))
        assert len(got) == longest_common([b for _, b in pairs], sorted(b for _, b in pairs))


def test_alignment_is_valid_and_near_the_optimum():
    rng = random.Random(2)
    for _ in range(60):
        b = [rng.choice("abcdefghijklmnopqrst") + str(rng.randint(0, 3)) for _ in range(40)]
        a = [w for w in b if rng.random() > 0.15]
        a.insert(rng.randrange(len(a)), "new")
        got = lic.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) >= 0.9 * longest_common(a, b)


def test_finds_every_template_whole_and_worn(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for k, (name, text) in enumerate(sorted(lic.TEMPLATES.items())):
        rows.append((k, f"{words(rng, 30)}. {text} {words(rng, 30)}"))
        want.add((k, name))
        if len(lic.words_of(text)) > 20:
            worn = lic.words_of(text)
            for i in range(5, len(worn), 15):
                worn[i] = "changed"
            rows.append((100 + k, f"{words(rng, 3)} {' '.join(worn).upper()}"))
            want.add((100 + k, name))
    rows.append((300, words(rng, 400)))
    r = lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want <= {(x.doc_id, x.license) for x in r} and 300 not in {x.doc_id for x in r}
    by = {(x.doc_id, x.license): x for x in r}
    assert all(by[k].coverage == 1 for k in want if k[0] < 100) and all(0.8 <= by[k].coverage < 1 for k in want if k[0] >= 100)


def test_candidates_lose_nothing(small):
    """Every document and template without the bound."""
    got = {(x.doc_id, x.license): (round(x.coverage, 9), x.first_word, x.end_word, x.n_windows) for x in lic.scan(small).collect()}
    want = {}
    for r in small.collect():
        w = lic.words_of(r.text)
        for name, text in lic.TEMPLATES.items():
            if m := lic.best_window(w, lic.words_of(text), 0.8):
                want[r.doc_id, name] = (round(m[0], 9), *m[1:])
    assert got == want and got


def test_every_copy_is_counted():
    """One to four copies of every template, one after another or with text between, whole and worn."""
    rng = random.Random(5)
    for name, text in sorted(lic.TEMPLATES.items()):
        template = lic.words_of(text)
        for n in (1, 2, 3, 4):
            for between in (0, 1, 40):
                for worn in (False, True)[: 1 if name == "WTFPL" else 2]:  # that one ends as it begins
                    made = words(rng, 7).split()
                    for _ in range(n):
                        copy = list(template)
                        if worn and len(copy) > 20:
                            for i in range(rng.randrange(5), len(copy), 12):
                                copy[i] = "changed"
                        made += copy + words(rng, between).split()
                    got = lic.best_window(made, template, 0.8)
                    assert got and got[3] == n, (name, n, between, worn, got)
                    assert got[0] == 1 if not worn else got[0] >= 0.8


def test_foreign_words_between_all():
    rng = random.Random(6)
    for name in ("MIT-grant", "ISC", "Apache-2.0-header", "GPL-3.0-notice"):
        template = lic.words_of(lic.TEMPLATES[name])
        made = [x for w in template for x in (w, *words(rng, 2).split())]
        assert lic.best_window(made, template, 0.8)[0] == 1


def test_copies_and_edges(spark, edges, nothing):
    d = spark.createDataFrame([(1, "mit mit. Released under the MIT License.\n" * 3)], "doc_id long, text string")
    (r,) = [x for x in lic.scan(d).collect() if x.license == "MIT-notice"]
    assert r.n_windows == 3 and r.coverage == 1
    assert {x.doc_id for x in lic.scan(edges).collect()} == {-3} and lic.scan(nothing).count() == 0
