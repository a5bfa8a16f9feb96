from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm import jpeg


def test_digests_of_documents_and_edges(small, edges, nothing):
    for d in (small, edges):
        want = []
        for r in d.select("doc_id", "text").collect():
            b = (r.text or "").encode()
            p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
            want.append((r.doc_id is None, r.doc_id or 0, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
        got = jpeg.digests(d).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
        by_text = {}
        for r in got:
            assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
    assert jpeg.digests(nothing).count() == 0


@pytest.mark.parametrize("units", [[1], [1, 3, 2], [341, 1], [1000]])
def test_round_trip_of_any_bytes(units):
    payload = np.random.default_rng(sum(units)).integers(0, 256, 576 * sum(units)).astype(np.uint8)
    media = jpeg.store(payload, np.array(units))
    back = jpeg.read(media)
    assert b"".join(t.tobytes() for images in back for _, _, t in images) == payload.tobytes()
    assert [m for m in media if m[:2] != b"\xff\xd8" or m[-2:] != b"\xff\xd9"] == []
    assert back[0][0][:2] == (192, min(units[0], 340) * 192)


def coded(width, height, parts, blocks, quant, dri=0):
    """A baseline JPEG from quantised blocks in scan order: (component, coefficients in zigzag order)."""
    dc, ac = jpeg.canonical(jpeg.DC_COUNTS, jpeg.DC_VALUES), {}
    symbols = sorted({0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))})
    counts = [0] * 16
    counts[7], counts[15] = 0, 0
    counts[8], counts[9] = 0, len(symbols)  # all in ten bits
    ac = jpeg.canonical(counts, symbols)
    head = b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\x00") + jpeg.segment(0xDB, bytes([0, quant] + [1] * 63))
    head += jpeg.segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)))
    head += jpeg.segment(0xC4, bytes([0, *jpeg.DC_COUNTS, *jpeg.DC_VALUES])) + jpeg.segment(0xC4, bytes([16, *counts, *symbols]))
    if dri:
        head += jpeg.segment(0xDD, struct.pack(">H", dri))
    head += jpeg.segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + bytes([0, 63, 0]))
    out, bits, pred = b"", "", [0] * len(parts)
    per = sum(h * v for h, v in parts)

    def put(table, symbol, value, size):
        code, n = table[symbol]
        text = format(code, f"0{n}b")
        if size:
            text += format(value if value > 0 else value + (1 << size) - 1, f"0{size}b")
        return text

    def flush():
        nonlocal out, bits
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    for k, (c, z) in enumerate(blocks):
        mcu = k // per
        if dri and k % per == 0 and mcu and mcu % dri == 0:
            flush()
            out += bytes([255, 0xD0 + (mcu // dri - 1) % 8])
            pred = [0] * len(parts)
        diff = z[0] - pred[c]
        pred[c] = z[0]
        bits += put(dc, abs(diff).bit_length(), diff, abs(diff).bit_length())
        run = 0
        last = max([i for i in range(1, 64) if z[i]], default=0)
        for v in z[1 : last + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits += put(ac, 0xF0, 0, 0)
                run -= 16
            bits += put(ac, run << 4 | abs(v).bit_length(), v, abs(v).bit_length())
            run = 0
        if last < 63:
            bits += put(ac, 0, 0, 0)
    flush()
    return head + out + b"\xff\xd9"


@pytest.mark.parametrize("dri", [0, 1, 3])
@pytest.mark.parametrize("parts", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_general_baseline_files(dri, parts):
    """Subsampled colour, AC coefficients with long runs, odd sizes."""
    rng = np.random.default_rng(4 + dri)
    width, height = 37, 29
    h, v = parts[0]
    wide, tall = -(-width // (8 * h)), -(-height // (8 * v))
    blocks, luma = [], np.zeros((tall * v, wide * h), int)
    for mcu in range(wide * tall):
        for c, (ch, cv) in enumerate(parts):
            for b in range(ch * cv):
                z = [int(rng.integers(-60, 60))] + [0] * 63
                for i in rng.choice(np.arange(1, 64), int(rng.integers(0, 4)), replace=False):
                    z[i] = int(rng.integers(-500, 500))
                if c == 0:
                    luma[mcu // wide * v + b // h, mcu % wide * h + b % h] = z[0]
                blocks.append((c, z))
    media = coded(width, height, parts, blocks, 16, dri)
    (images,) = jpeg.read([media])
    assert images[0][:2] == (width, height)
    want = np.clip(np.rint(luma * 16 / 8) + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]
    assert (images[0][2] == want).all()


def test_damaged_media(spark):
    good = jpeg.store(np.arange(576, dtype=np.uint8), np.array([1]))[0]
    bad = [b"", b"text", good[:40], good[:-30], good.replace(b"\xff\xc0", b"\xff\xc2"), None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate([good, *bad, good])], "doc_id long, media binary")
    r = {x.doc_id: x for x in jpeg.thumbnails(df).collect()}
    assert r[0].error is None and r[7].feature == r[0].feature and bytes(r[0].thumbnail) == bytes(range(256)) * 2 + bytes(range(64))
    assert all(r[i].error and r[i].feature is None for i in range(1, 7))


def test_stored_column_reads_back(small):
    media = jpeg.stored_texts(small.limit(5))
    assert jpeg.thumbnails(media).filter("error IS NULL").count() == 5


def test_long_texts_in_runs(spark):
    """The same values whether a text goes as one slice or in runs, at all sizes around an image; memory stays bounded."""
    sizes = [0, 1, 575, 576, 577, jpeg.MOST - 1, jpeg.MOST, jpeg.MOST + 1, 3 * jpeg.MOST + 5]
    rng = np.random.default_rng(3)
    for n in sizes:
        raw = rng.integers(32, 127, n).astype(np.uint8)
        text = pa.array([raw.tobytes().decode(), ""], pa.large_string())
        payload, _, units = jpeg.payloads(text)
        whole = jpeg.store(payload, units)[0]
        assert b"".join(jpeg.stored_in_runs(raw, 2 * jpeg.MOST)) == whole
        (images,) = jpeg.read([whole])
        back = b"".join(t.tobytes() for _, _, t in images)
        assert back == raw.tobytes() + b"\xff" * (len(back) - n)
        assert jpeg.digest_in_runs(raw, 2 * jpeg.MOST) == (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), jpeg.feature(images))
    import tracemalloc

    raw = rng.integers(32, 127, 20 << 20).astype(np.uint8)
    tracemalloc.start()
    jpeg.digest_in_runs(raw, 1 << 20)
    assert tracemalloc.get_traced_memory()[1] < 20 * len(raw)
    tracemalloc.stop()
