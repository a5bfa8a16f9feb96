"""Writing elements and pixels as Part 10 files (explicit little-endian)."""

from __future__ import annotations

import base64
import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.dicom import BINARY, EXPLICIT, LONG_FORM, NUMBERS


def coded(vr: str, values: list[str]) -> bytes:
    if not values:
        return b""
    if vr in BINARY:
        raw = base64.b64decode(values[0]) if values[0] else b""
    elif vr in NUMBERS:
        kind = NUMBERS[vr]
        raw = b"".join(struct.pack("<" + kind, float(v) if kind in "fd" else int(float(v))) for v in values if v)
    elif vr == "AT":
        raw = b"".join(struct.pack("<HH", int(v[:4], 16), int(v[4:], 16)) for v in values if v)
    else:
        raw = "\\".join(values).encode("utf-8")
    return raw + (b"\x00" if vr in BINARY or vr == "UI" else b" ") * (len(raw) % 2)


def element(tag: str, vr: str, raw: bytes) -> bytes:
    head = struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16)) + vr.encode()
    return head + (struct.pack("<HI", 0, len(raw)) if vr.encode() in LONG_FORM else struct.pack("<H", len(raw))) + raw


def dataset(by_path: dict, path: str = "") -> bytes:
    """The elements of one item, sequences with theirs."""
    out = []
    for e in sorted(by_path.get(path, []), key=lambda e: e["tag"]):
        if e["vr"] == "SQ":
            items = []
            for i in range(1 << 16):
                own = f"{path}/{e['tag']}[{i}]"
                if own in by_path:
                    body = dataset(by_path, own)
                    items.append(struct.pack("<HHI", 0xFFFE, 0xE000, len(body)) + body)
                elif i >= int((e["value"] or ["0"])[0] or 0) and not any(p.startswith(f"{path}/{e['tag']}[") and int(p[len(path) + len(e["tag"]) + 2 :].split("]")[0]) > i for p in by_path):
                    break
            out.append(element(e["tag"], "SQ", b"".join(items)))
        else:
            out.append(element(e["tag"], e["vr"], coded(e["vr"], e["value"] or [])))
    return b"".join(out)


def written(elements: list[dict], pixels: bytes | None) -> bytes:
    """A file: a preamble of zeros, group 2, the data set, and the pixels as 16-bit words."""
    by_path: dict[str, list[dict]] = {}
    meta = {e["tag"]: e for e in elements if e["scope"] == "file_meta"}
    for e in elements:
        if e["scope"] == "dataset":
            by_path.setdefault(e["item_path"] or "", []).append(e)
    meta["00020010"] = {"tag": "00020010", "vr": "UI", "value": [EXPLICIT]}
    meta.pop("00020000", None)
    meta.setdefault("00020001", {"tag": "00020001", "vr": "OB", "value": [base64.b64encode(b"\x00\x01").decode()]})
    # text is written as UTF-8
    by_path[""] = [e for e in by_path.get("", []) if e["tag"] != "00080005"] + [{"tag": "00080005", "vr": "CS", "value": ["ISO_IR 192"]}]
    group = b"".join(element(t, meta[t]["vr"], coded(meta[t]["vr"], meta[t]["value"] or [])) for t in sorted(meta))
    body = dataset(by_path)
    if pixels is not None:
        body += element("7FE00010", "OW", pixels + b"\x00" * (len(pixels) % 2))
    return b"\x00" * 128 + b"DICM" + element("00020000", "UL", struct.pack("<I", len(group))) + group + body


def as_files(elements: DataFrame, images: DataFrame) -> DataFrame:
    """path, content: one row for each image (instance_id, out_path, pixels) with its elements."""
    import pyarrow as pa

    grouped = elements.groupBy("instance_id").agg(F.collect_list(F.struct("scope", "item_path", "tag", "vr", "value")).alias("elements"))
    d = images.join(grouped, "instance_id").select("out_path", "pixels", "elements")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("out_path"), pa.array([written(r["elements"], r["pixels"]) for r in b.to_pylist()], pa.binary())], ["path", "content"])

    return d.mapInArrow(run, "path string, content binary")


def publish(files: DataFrame, root: str) -> None:
    """Files under ``root``, a folder that all executors mount.  A file appears whole or not at all: retried tasks replace it."""

    def put(rows) -> None:
        for r in rows:
            path = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, path)

    files.foreachPartition(put)
