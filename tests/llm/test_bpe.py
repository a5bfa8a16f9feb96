from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veilframe.llm import bpe


@pytest.fixture(scope="module")
def library(vocab):
    return Tokenizer.from_file(vocab)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_same_as_library_on_documents_and_edges(small, edges, vocab, library):
    for d in (small, edges):
        want = sorted((r.doc_id is None, r.doc_id or 0, *expected(library, r.text)) for r in d.select("doc_id", "text").collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(d, vocab).collect())
        assert got == want


def test_every_character(vocab, library):
    probes = [f"a{chr(c)}b {chr(c)} A{chr(c)}" for c in [*range(1, 0xD800, 7), *range(0xE000, 0x20000, 7)]]
    ids, starts = bpe.vocabulary(vocab).encode_flat(pa.array(probes, pa.large_string()))
    for i, e in enumerate(library.encode_batch(probes, add_special_tokens=False)):
        assert e.ids == ids[starts[i] : starts[i + 1]].tolist()


def test_letters_with_marks(vocab, library):
    """Composition comes before lower case: 50,000 texts of letters of both cases and combining marks."""
    rng = random.Random(17)
    letters = [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *"ÄÖÜßéÑİıΣς", " ", "\n", "'", "1"]
    marks = [chr(c) for c in range(0x300, 0x370)]
    probes = ["T\u0308", "J\u030c", "H\u0331", "W\u030a", "Y\u030a", "I\u0307"]
    probes += ["".join(rng.choice(letters) + rng.choice(marks) * (rng.random() < 0.5) for _ in range(rng.randint(1, 8))) for _ in range(50_000)]
    ids, starts = bpe.vocabulary(vocab).encode_flat(pa.array(probes, pa.large_string()))
    for i, e in enumerate(library.encode_batch(probes, add_special_tokens=False)):
        assert e.ids == ids[starts[i] : starts[i + 1]].tolist(), probes[i]


def test_equal_symbols_merge_from_the_left(vocab, library):
    probes = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)] + ["zz", "'s's'S"]
    ids, starts = bpe.vocabulary(vocab).encode_flat(pa.array(probes, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [library.encode(p, add_special_tokens=False).ids for p in probes]


def test_ids_and_back(small, nothing, vocab, library):
    ids = bpe.encode(small.limit(20), vocab)
    back = {r.doc_id: r.text for r in bpe.decode(ids, vocab).collect()}
    for r in ids.collect():
        assert back[r.doc_id] == library.decode(r.ids, skip_special_tokens=False)
    assert bpe.digests(nothing, vocab).count() == 0
