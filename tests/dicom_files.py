"""Small Part 10 files for tests."""

from __future__ import annotations

import struct

import numpy as np

LONG = {"OB", "OW", "SQ", "UN", "UT"}


def el(tag: str, vr: str, value) -> bytes:
    raw = value if isinstance(value, bytes) else str(value).encode()
    raw += (b"\x00" if vr in ("UI", "OB", "OW", "UN") else b" ") * (len(raw) % 2)
    head = struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16)) + vr.encode()
    return head + (struct.pack("<HI", 0, len(raw)) if vr in LONG else struct.pack("<H", len(raw))) + raw


def plain(tag: str, value) -> bytes:
    """The same without its type."""
    raw = value if isinstance(value, bytes) else str(value).encode()
    raw += b" " * (len(raw) % 2)
    return struct.pack("<HHI", int(tag[:4], 16), int(tag[4:], 16), len(raw)) + raw


def seq(tag: str, items: list[bytes], open_ended: bool = False) -> bytes:
    if open_ended:
        body = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + i + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) for i in items) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
        return struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16)) + b"SQ" + struct.pack("<HI", 0, 0xFFFFFFFF) + body
    return el(tag, "SQ", b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(i)) + i for i in items))


def meta(syntax: str, sop: str) -> bytes:
    group = el("00020002", "UI", "1.2.840.10008.5.1.4.1.1.2") + el("00020003", "UI", sop) + el("00020010", "UI", syntax) + el("00020016", "AE", "SITE")
    return b"junk" + b"\x01" * 124 + b"DICM" + el("00020000", "UL", struct.pack("<I", len(group))) + group


def us(n: int) -> bytes:
    return struct.pack("<H", n)


def head_slice(sop: str, number: str | None, raw: np.ndarray, burned: str = "NO", study: str = "CT HEAD", extra: bytes = b"", syntax: str = "1.2.840.10008.1.2.1", pixels: bytes | None = None) -> bytes:
    rows, cols = raw.shape
    parts = [
        el("00080008", "CS", "ORIGINAL\\PRIMARY\\AXIAL"), el("00080016", "UI", "1.2.840.10008.5.1.4.1.1.2"), el("00080018", "UI", sop), el("00080020", "DA", "20200615"), el("00080060", "CS", "CT"), el("00080080", "LO", "Old Hospital"), el("00081030", "LO", study),
        seq("00081140", [el("00081150", "UI", "1.2.840.10008.5.1.4.1.1.2") + el("00081155", "UI", "1.2.3.1"), el("00081150", "UI", "") + el("00081155", "UI", "")], open_ended=True),
        el("00091001", "LO", "private"), el("00100010", "PN", "Doe^Jane"), el("00100020", "LO", "MRN1"), el("00100030", "DA", "19300101"), el("00180015", "CS", "HEAD"), el("0020000D", "UI", "1.2.3"), el("0020000E", "UI", "1.2.3.9"),
        *([el("00200013", "IS", number)] if number is not None else []), el("00280002", "US", us(1)), el("00280004", "CS", "MONOCHROME2"), el("00280010", "US", us(rows)), el("00280011", "US", us(cols)), el("00280030", "DS", "5.0\\5.0"),
        el("00280100", "US", us(16)), el("00280101", "US", us(16)), el("00280102", "US", us(15)), el("00280103", "US", us(1)), el("00280301", "CS", burned), el("00281052", "DS", "-1024"), el("00281053", "DS", "1"), extra,
    ]
    if pixels is None:
        pixels = el("7FE00010", "OW", raw.astype("<i2").tobytes())
    return meta(syntax, sop) + b"".join(parts) + pixels


def phantom(text: bool = False) -> np.ndarray:
    """Air around soft tissue inside a ring of bone; with bright strokes where asked."""
    y, x = np.mgrid[:64, :64]
    d = np.hypot(y - 32, x - 32)
    hu = np.full((64, 64), -1000)
    hu[d < 26] = 40
    hu[(d < 22) & (d >= 18)] = 900
    hu[d < 18] = 30
    if text:
        for k in range(5):
            hu[4:12, 4 + 6 * k : 6 + 6 * k] = 3000
    return hu + 1024
