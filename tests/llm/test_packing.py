from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from veilframe.llm import packing


def whole(df, rows, vocab):
    """Checks that all ids lie in exactly one piece and that sequences have no gaps; returns sequence lengths."""
    library = Tokenizer.from_file(vocab)
    want = sorted(((-99 if d is None else d), tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t in rows)
    pieces = df.collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.array(p.ids, "<u4")
        assert p.length == len(ids) and p.ids_crc32 == zlib.crc32(ids.tobytes()) and p.sequence_id >= 0
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[-99 if p.doc_id is None else p.doc_id].append((p.doc_tokens, p.start, tuple(p.ids)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(p.length for p in pieces)
    assert total == sum(len(w[1]) for w in want)
    by_doc = defaultdict(list)
    for d, ids in want:
        by_doc[d].append(ids)
    for d, texts in by_doc.items():
        if len(texts) == 1:
            parts = sorted(docs[d], key=lambda x: x[1])
            assert tuple(itertools.chain(*(x[2] for x in parts))) == texts[0] and {x[0] for x in parts} == {len(texts[0])}
    return sorted(sum(n for _, n in parts) for parts in sequences.values())


def test_all_documents(small, vocab):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    sizes = whole(packing.pieces(small, vocab), rows, vocab)
    assert all(n == 2048 for n in sizes[1:])
    narrow = packing.pieces(small, vocab, with_ids=False)
    assert "ids" not in narrow.columns and narrow.count() >= len(rows)


def test_edges(edges, nothing, vocab):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    whole(packing.pieces(edges, vocab), rows, vocab)
    assert packing.pieces(nothing, vocab).count() == 0


def test_curve_is_a_bijection_of_neighbours():
    bits = 2
    cells = np.array(list(itertools.product(range(1 << bits), repeat=packing.DIMS)))
    at = packing.hilbert_index(cells, bits)
    assert sorted(at.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_share_sequences(spark, vocab):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in d.collect()}
    p = sorted((r.sequence_id, r.offset, r.doc_id) for r in packing.pieces(d, vocab, with_ids=False).collect() if not r.start)
    same = sum(lang[a[2]] == lang[b[2]] for a, b in zip(p, p[1:])) / (len(p) - 1)
    assert same > 0.7
