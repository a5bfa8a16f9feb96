from __future__ import annotations

import struct

import numpy as np
import pytest

from veilframe.sinks.dicom import written
from veilframe.sources.dicom import BIG, DEFLATED, IMPLICIT, RLE, parse, unpacked

from dicom_files import el, head_slice, meta, phantom, plain, seq


def values(p, path="", scope="dataset"):
    return {e[6]: e[8] for e in p["elements"] if e[2] == path and e[0] == scope}


def test_explicit_file_with_nested_items():
    raw = phantom()
    p = parse(head_slice("1.2.3.1", "7", raw))
    root = values(p)
    assert p["error"] is None and p["preamble"][:4] == b"junk" and p["syntax"] == "1.2.840.10008.1.2.1"
    assert root["00080008"] == ["ORIGINAL", "PRIMARY", "AXIAL"] and root["00081140"] == ["2"] and root["00280010"] == ["64"]
    assert values(p, "/00081140[0]")["00081155"] == ["1.2.3.1"] and values(p, "/00081140[1]")["00081155"] == []
    assert values(p, scope="file_meta")["00020016"] == ["SITE"]
    assert np.array_equal(np.frombuffer(p["pixels"], "<i2").reshape(64, 64), raw) and (p["rows"], p["slope"], p["intercept"], p["spacing_row"]) == (64, 1.0, -1024.0, 5.0)
    assert parse(head_slice("1.2.3.1", "7", raw), with_pixels=False)["pixels"] is None


def test_implicit_and_bare_files():
    body = plain("00080060", "CT") + plain("00081140", b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(i)) + i for i in [plain("00081155", "1.2")])) + plain("00280010", struct.pack("<H", 2)) + plain("00280011", struct.pack("<H", 1)) + plain("7FE00010", b"\x01\x00\x02\x00")
    for data in (meta(IMPLICIT, "1.2") + body, body):
        p = parse(data)
        assert p["error"] is None and values(p)["00080060"] == ["CT"] and values(p, "/00081140[0]")["00081155"] == ["1.2"] and p["pixels"] == b"\x01\x00\x02\x00"


def test_deflated_and_big_endian():
    import zlib

    c = zlib.compressobj(wbits=-15)
    data = meta(DEFLATED, "1.2") + c.compress(el("00080060", "CS", "CT") + el("7FE00010", "OW", b"\x01\x02")) + c.flush()
    p = parse(data)
    assert values(p)["00080060"] == ["CT"] and p["pixels"] == b"\x01\x02"
    big = struct.pack(">HH", 0x0028, 0x0010) + b"US" + struct.pack(">HH", 2, 513) + struct.pack(">HH", 0x7FE0, 0x0010) + b"OW" + struct.pack(">HIH", 0, 2, 7)
    p = parse(meta(BIG, "1.2") + big)
    assert values(p)["00280010"] == ["513"] and p["pixels"] == b"\x07\x00"


def test_run_lengths_and_other_compression():
    rows, cols = 4, 5
    pixels = (np.arange(20) // 7 * 300).astype("<u2")
    planes = [(pixels >> 8).astype(np.uint8).tobytes(), (pixels & 255).astype(np.uint8).tobytes()]
    coded = [b"".join(bytes([257 - 2, p[i]]) if p[i : i + 2] == p[i : i + 1] * 2 else bytes([len(p[i : i + 2]) - 1]) + p[i : i + 2] for i in range(0, len(p), 2)) for p in planes]
    frame = struct.pack("<16I", 2, 64, 64 + len(coded[0]), *[0] * 13) + b"".join(coded)
    assert unpacked([frame], rows, cols) == pixels.tobytes()
    box = struct.pack("<HH", 0x7FE0, 0x0010) + b"OW" + struct.pack("<HI", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0) + struct.pack("<HHI", 0xFFFE, 0xE000, len(frame)) + frame + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    size = el("00280010", "US", struct.pack("<H", rows)) + el("00280011", "US", struct.pack("<H", cols))
    assert parse(meta(RLE, "1.2") + size + box)["pixels"] == pixels.tobytes()
    assert "unsupported" in parse(meta("1.2.840.10008.1.2.4.70", "1.2") + size + box)["error"]


@pytest.mark.parametrize("data", [b"", b"\x00" * 10, b"\x00" * 200, b"hello world, no image at all", head_slice("1.2", "1", phantom())[:700]])
def test_any_bytes_give_a_row(data):
    assert parse(data)["error"]


def test_round_trip():
    p = parse(head_slice("1.2.3.1", "7", phantom(), extra=el("00281101", "US", struct.pack("<3H", 1, 2, 3)) + seq("00400275", [el("00400007", "LO", "x"), seq("00400008", [el("00080100", "SH", "c")])])))
    names = ["scope", "depth", "item_path", "ancestor_tags", "ancestor_items", "grp", "tag", "vr", "value"]
    rows = [dict(zip(names, e)) for e in p["elements"]]
    q = parse(written(rows, p["pixels"]))
    assert q["error"] is None and q["pixels"] == p["pixels"] and q["preamble"] == b"\x00" * 128
    drop = {"00020000", "00020001", "00080005"}
    key = lambda e: (e[0], e[2], e[6], e[7], e[8])
    assert sorted(key(e) for e in q["elements"] if e[6] not in drop) == sorted(key(e) for e in p["elements"] if e[6] not in drop)
