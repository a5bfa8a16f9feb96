"""BPE encoding and decoding in batched numpy merge rounds (operator 6).

Texts are cut at white space, each distinct chunk is normalised and pre-tokenised once a slice, and the distinct
pre-tokens of the slice are merged together: their symbols lie in one flat array, the ranks of adjacent pairs come
from a binary search over the sorted pair keys, and each round merges every word's pair of lowest rank.

Null texts are empty; an empty text has no ids.  The special tokens' strings, where a text holds them, give their
ids, as the tokenizers library has it.  The operators keep one row per input row, repeated rows, rows that share a
doc_id and rows without one included.  Ties don't occur: of a word's pairs of one rank the leftmost is merged first.  A very long text is a
slice of its own (some 20 times its bytes of memory).  Other columns, also with clashing names, don't enter.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from veilframe.llm.common import only, ranges, slices, texts

#: Fixed value: the pre-token pattern of the vocabulary file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NONE = np.int64(1) << 40
#: Chunks whose ids a worker keeps (some 50 MB); the frequent ones come early.
KEPT = 300_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBPE:
    """A vocabulary with word ends: lower case, white space dropped."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(max(vocab.values()), *self.special.values())
        self.strings = np.empty(size, object)
        for k, v in [*vocab.items(), *self.special.items()]:
            self.strings[v] = k
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.pattern = regex.compile(PRETOKEN)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.path, self.byte = path, {c: b for b, c in enumerate(chars)}
        self.kept: dict[str, int] = {}
        self.kept_ids, self.kept_starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where it is no merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    @functools.cached_property
    def by_rank(self) -> np.ndarray:
        out = np.empty(len(self.made), np.int64)
        out[self.ranks] = self.made
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts) of non-empty pre-tokens given as UTF-8."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = self.inner[raw]
        symbols[ends] = self.final[raw[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbols), _NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.find(symbols[inside], symbols[inside + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lengths = np.diff(np.append(heads, len(symbols)))
            low = np.minimum.reduceat(rank, heads)
            live = low < _NONE
            if not live.all():
                rest = np.repeat(~live, lengths)
                done_symbols.append(symbols[rest])
                done_owner.append(owner[rest])
                keep = ~rest
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                low, lengths = low[live], lengths[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lengths))
            # of overlapping occurrences (a pair of equal symbols) the first, third, ... are merged
            new_run = np.concatenate(([True], np.diff(hit) != 1))
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            symbols[hit] = self.by_rank[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            rank[hit] = _NONE
            at = (np.cumsum(keep) - 1)[hit]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            n = len(symbols)
            again = np.concatenate((at - 1, at))
            again = again[(again >= 0) & (again < n - 1)]
            same = owner[again] == owner[again + 1]
            rank[again[~same]] = _NONE
            again = again[same]
            rank[again] = self.find(symbols[again], symbols[again + 1])
            if n and at[-1] == n - 1:
                rank[n - 1] = _NONE
        symbols = np.concatenate(done_symbols) if done_symbols else symbols
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(words))
        return symbols[order], np.concatenate(([0], np.cumsum(counts)))

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def pretokens(self, text: str) -> list[bytes]:
        """Normalised pre-tokens.  Past Latin the character tables of Python and of the tokenizers library are of
        different Unicode versions; there the library's own normaliser and pre-tokeniser decide."""
        if text.isascii():
            low = text.lower()
            return [low.encode()] if low.isalpha() else [w.encode() for w in self.pattern.findall(low)]
        if max(text) <= "\u024f":
            return [w.encode() for w in self.pattern.findall(unicodedata.normalize("NFC", text).lower())]
        low = self.library.normalizer.normalize_str(text)
        return [bytes(self.byte[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]

    def pooled(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each chunk, size of each): those that are kept, and the others encoded now."""
        get, base = self.kept.get, len(self.kept_ids)
        at = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        fresh = [chunks[i] for i in new.tolist()]
        ids, starts = self.chunks(fresh)
        first, size = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        old = np.flatnonzero(at >= 0)
        first[old], size[old] = self.kept_starts[at[old]], np.diff(self.kept_starts)[at[old]]
        first[new], size[new] = base + starts[:-1], np.diff(starts)
        pool = np.concatenate((self.kept_ids, ids))
        if room := min(KEPT - len(self.kept), len(fresh)):
            self.kept.update(zip(fresh[:room], range(len(self.kept), len(self.kept) + room), strict=True))
            self.kept_ids = pool[: base + starts[room]].copy()
            self.kept_starts = np.concatenate((self.kept_starts, base + starts[1 : room + 1]))
        return pool, first, size

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts) of chunks without ASCII white space between."""
        words: dict[bytes, int] = {}
        which: list[int] = []
        counts = np.zeros(len(chunks), np.int64)
        put, cut = words.setdefault, self.pretokens
        for i, chunk in enumerate(chunks):
            before = len(which)
            if self.cut is not None and "<|" in chunk:
                at = 0
                for m in self.cut.finditer(chunk):
                    which += [put(w, len(words)) for w in cut(chunk[at : m.start()])]
                    which.append(-1 - self.special[m[0]])
                    at = m.end()
                chunk = chunk[at:]
            which += [put(w, len(words)) for w in cut(chunk)]
            counts[i] = len(which) - before
        ids, starts = self.merge(list(words))
        picked = np.array(which, np.int64)
        lone = picked < 0
        ids = np.concatenate((ids, -1 - picked[lone]))
        a, n = np.zeros(len(picked), np.int64), np.ones(len(picked), np.int64)
        a[~lone], n[~lone] = starts[picked[~lone]], np.diff(starts)[picked[~lone]]
        a[lone] = len(ids) - lone.sum() + np.arange(lone.sum())
        total = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]
        return ids[ranges(a, n)], total

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, code starts of each text, ids, first id and size of each chunk): texts share their chunks."""
        parts = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
        flat = parts.flatten().dictionary_encode()
        ids, first, size = self.pooled(flat.dictionary.to_pylist())
        offsets = parts.offsets.to_numpy()
        return flat.indices.to_numpy(), (offsets - offsets[0]).astype(np.int64), ids, first, size

    def encode_flat(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts) of the texts."""
        codes, at, ids, first, size = self.encode(text)
        n = size[codes]
        return ids[ranges(first[codes], n)], np.concatenate(([0], np.cumsum(n)))[at]

    def decode(self, ids) -> str:
        """The tokens' strings, joined by spaces: the file names no decoder."""
        return " ".join(self.strings[np.asarray(ids, np.int64)])


@functools.lru_cache(4)
def vocabulary(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, ids array<int> of each whole text."""

    def run(batches):
        bpe = vocabulary(vocab_path)
        for b in slices(batches):
            ids, starts = bpe.encode_flat(texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, text of the ids of each row; null ids decode to an empty text."""

    def run(batches):
        bpe = vocabulary(vocab_path)
        for b in batches:
            out = [bpe.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return only(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and their decoding, both made chunk by chunk."""

    def run(batches):
        bpe = vocabulary(vocab_path)
        for b in slices(batches):
            codes, at, ids, first, size = bpe.encode(texts(b))
            own = ids[ranges(first, size)]
            tokens, strings = own.tolist(), bpe.strings[own].tolist()
            ends = np.cumsum(size)
            spans = list(zip((ends - size).tolist(), ends.tolist(), strict=True))
            said = np.array([" ".join(map(str, tokens[i:j])).encode() for i, j in spans], object)
            back = np.array([" ".join(strings[i:j]).encode() for i, j in spans], object)
            counts = size[codes]
            full = counts > 0
            fill = np.concatenate(([0], np.cumsum(full)))[at]
            codes, n = codes[full], np.concatenate(([0], np.cumsum(counts)))[at]
            sha = lambda parts: hashlib.sha256(b" ".join(parts)).hexdigest()
            rows = [codes[i:j] for i, j in zip(fill[:-1].tolist(), fill[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(n), pa.int64()), pa.array([sha(said[r].tolist()) for r in rows]), pa.array([sha(back[r].tolist()) for r in rows])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
