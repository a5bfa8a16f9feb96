"""DICOM Part 10 files as rows: a permissive parser and the scans built on it.

Any bytes are attempted; what can't be read becomes an error on the file's row.  Binary values are base64 text, so
that every element can be written again.  Pixel data never becomes an element.
"""

from __future__ import annotations

import base64
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.batches import pieces


IMPLICIT, EXPLICIT, BIG, DEFLATED, RLE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.5"
LONG_FORM = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "SV": "q", "UV": "Q"}
BINARY = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
ONE_TEXT = {"LT", "ST", "UT", "UR"}
PIXELS = "7FE00010"
#: Types of elements in files that don't state them; anything else there is UN.
TYPES = {
    "CS": "00080005 00080008 00080060 00100040 00180015 00120062 00280004 00280301 00280303 00185100",
    "UI": "00020002 00020003 00020010 00020012 00080016 00080018 00080014 00081150 00081155 0020000D 0020000E 00200052 00083010 00880140 00020100",
    "DA": "00080020 00080021 00080022 00080023 00100030 00181012 00380020 00400244 00400250",
    "TM": "00080030 00080031 00080032 00080033 00100032 00400245 00400251",
    "DT": "0008002A 0040A030 0040A120",
    "PN": "00080090 00081048 00081050 00081060 00081070 00100010 00101001 00101005 00101060 00321032",
    "SH": "00020013 00080050 00081010 00200010 00080100 00080102 00181160",
    "LO": "00080070 00080080 00081030 0008103E 00081040 00081090 00100020 00101000 00102160 00120063 00080104 00181030 00380300",
    "ST": "00080081", "LT": "00104000 00204000 001021B0", "AS": "00101010", "AE": "00020016 00080054", "SQ": "00081140 00082112 00120064 00880200 00400275 00081110 00081111",
    "IS": "00200011 00200012 00200013 00280008", "DS": "00101020 00101030 00180050 00180060 00200032 00200037 00201041 00280030 00281050 00281051 00281052 00281053",
    "US": "00280002 00280010 00280011 00280100 00280101 00280102 00280103", "OW": "7FE00010", "UL": "00020000",
}
KNOWN = {t: vr for vr, ts in TYPES.items() for t in ts.split()}


class Malformed(ValueError):
    pass


class Reader:
    """Elements of one file in order, with their nesting."""

    def __init__(self, data: bytes, with_pixels: bool):
        self.data, self.with_pixels, self.charset = data, with_pixels, "latin-1"
        self.elements: list[tuple] = []
        self.pixels: bytes | list[bytes] | None = None

    def read(self) -> str:
        """Parses all; returns the transfer syntax."""
        data, at, syntax = self.data, 0, IMPLICIT
        if data[128:132] == b"DICM":
            at = 132
        elif data[:4] == b"DICM":
            at = 4
        if data[at : at + 2] == b"\x02\x00":
            at = self.dataset(at, len(data), True, "<", "file_meta", "", [], [], 0)
            syntax = next((e[8][0] for e in self.elements if e[6] == "00020010" and e[8]), EXPLICIT)
        elif len(data) >= at + 6 and data[at + 4 : at + 6].isalpha() and data[at + 4 : at + 6].isupper():
            syntax = EXPLICIT
        if syntax == DEFLATED:
            self.data, at = zlib.decompress(data[at:], -15), 0
        self.dataset(at, len(self.data), syntax != IMPLICIT, ">" if syntax == BIG else "<", "dataset", "", [], [], 0)
        return syntax

    def dataset(self, at: int, end: int, explicit: bool, order: str, scope: str, path: str, tags: list, items: list, depth: int) -> int:
        """Elements from ``at`` on; returns where they end."""
        data = self.data
        while at + 8 <= end:
            grp, elem = struct.unpack_from(order + "HH", data, at)
            if (scope == "file_meta") != (grp == 2) and depth == 0 and scope == "file_meta":
                return at
            if grp == 0xFFFE:
                return at
            tag = f"{grp:04X}{elem:04X}"
            if explicit:
                code = data[at + 4 : at + 6]
                if not code.isalpha():
                    raise Malformed(f"type expected at {at}")
                if code in LONG_FORM:
                    size, at = struct.unpack_from(order + "I", data, at + 8)[0], at + 12
                else:
                    size, at = struct.unpack_from(order + "H", data, at + 6)[0], at + 8
                vr = code.decode()
            else:
                size, at = struct.unpack_from(order + "I", data, at + 4)[0], at + 8
                vr = KNOWN.get(tag, "SQ" if size == 0xFFFFFFFF else "UN")
            if tag == PIXELS and depth == 0:
                at = self.take_pixels(at, size, order)
                continue
            if vr == "SQ" or (vr == "UN" and size == 0xFFFFFFFF):
                row = len(self.elements)
                self.elements.append(())
                n, at = self.sequence(at, size, explicit and vr == "SQ", order, scope, path, tag, tags, items, depth)
                self.elements[row] = (scope, depth, path, tags, items, grp, tag, "SQ", [str(n)])
                continue
            if at + size > end or size == 0xFFFFFFFF:
                raise Malformed(f"{tag} ends outside the file")
            self.elements.append((scope, depth, path, tags, items, grp, tag, vr, self.value(vr, data[at : at + size], order)))
            if tag == "00080005" and any("192" in v for v in self.elements[-1][8]):
                self.charset = "utf-8"
            at += size
        return at

    def sequence(self, at: int, size: int, explicit: bool, order: str, scope: str, path: str, tag: str, tags: list, items: list, depth: int) -> tuple[int, int]:
        end, n = (len(self.data) if size == 0xFFFFFFFF else at + size), 0
        while at + 8 <= end:
            mark, length = struct.unpack_from(order + "HH", self.data, at), struct.unpack_from(order + "I", self.data, at + 4)[0]
            at += 8
            if mark == (0xFFFE, 0xE0DD):
                return n, at
            if mark != (0xFFFE, 0xE000):
                raise Malformed(f"item expected in {tag}")
            own = f"{path}/{tag}[{n}]"
            stop = end if length == 0xFFFFFFFF else at + length
            at = self.dataset(at, stop, explicit, order, scope, own, [*tags, tag], [*items, own], depth + 1)
            if length == 0xFFFFFFFF:
                at += 8
            n += 1
        return n, at

    def take_pixels(self, at: int, size: int, order: str) -> int:
        if size != 0xFFFFFFFF:
            if self.with_pixels:
                self.pixels = self.data[at : at + size]
            return at + size
        parts = []
        while at + 8 <= len(self.data):
            mark, length = struct.unpack_from(order + "HH", self.data, at), struct.unpack_from(order + "I", self.data, at + 4)[0]
            at += 8
            if mark == (0xFFFE, 0xE0DD):
                break
            parts.append(self.data[at : at + length])
            at += length
        self.pixels = parts[1:] if self.with_pixels else None
        return at

    def value(self, vr: str, raw: bytes, order: str) -> list[str]:
        if not raw:
            return []
        if vr in BINARY:
            return [base64.b64encode(raw).decode()]
        if vr in NUMBERS:
            kind = NUMBERS[vr]
            return [repr(v) if kind in "fd" else str(v) for (v,) in struct.iter_unpack(order + kind, raw[: len(raw) // struct.calcsize(kind) * struct.calcsize(kind)])]
        if vr == "AT":
            return [f"{a:04X}{b:04X}" for a, b in struct.iter_unpack(order + "HH", raw[: len(raw) // 4 * 4])]
        text = raw.decode(self.charset, "replace").rstrip("\x00 ")
        return [text] if vr in ONE_TEXT else [v.strip(" ") if vr not in ("UC",) else v for v in text.split("\\")]


def unpacked(frames: list[bytes], rows: int, cols: int) -> bytes:
    """The first frame of run-length coded 8- or 16-bit pixels, little-endian."""
    raw = frames[0]
    n = struct.unpack_from("<I", raw)[0]
    starts = [*struct.unpack_from(f"<{n}I", raw, 4), len(raw)]
    planes = []
    for a, b in zip(starts, starts[1:n + 1], strict=False):
        out, at = bytearray(), a
        while at < b and len(out) < rows * cols:
            c = raw[at]
            if c < 128:
                out += raw[at + 1 : at + 2 + c]
                at += 2 + c
            else:
                out += raw[at + 1 : at + 2] * (257 - c if c > 128 else 0)
                at += 2 if c > 128 else 1
        planes.append(bytes(out[: rows * cols]))
    out = bytearray(rows * cols * n)
    for i, plane in enumerate(reversed(planes)):
        out[i::n] = plane
    return bytes(out)


def parse(content: bytes, with_pixels: bool = True) -> dict:
    """Header facts, elements, and pixels (little-endian) of a file; ``error`` where something can't be read."""
    out: dict = {"preamble": content[:128] if content[128:132] == b"DICM" else None, "elements": [], "error": None, "pixels": None, "syntax": None}
    reader = Reader(content, with_pixels)
    try:
        out["syntax"] = reader.read()
    except (Malformed, struct.error, zlib.error, IndexError) as e:
        out["error"] = f"{type(e).__name__}: {e}"
    out["elements"] = [e for e in reader.elements if e]
    root = {e[6]: e[8] for e in reversed(out["elements"]) if e[0] == "dataset" and e[1] == 0}

    def number(tag: str, default):
        try:
            return type(default)(float(root[tag][0]))
        except (KeyError, IndexError, ValueError):
            return default

    out |= {"rows": number("00280010", 0), "cols": number("00280011", 0), "slope": number("00281053", 1.0), "intercept": number("00281052", 0.0), "photometric": (root.get("00280004") or [None])[0], "bits": number("00280100", 16), "signed": number("00280103", 0)}
    spacing = root.get("00280030") or []
    try:
        out["spacing_row"] = float(spacing[0].replace(",", "\\").split("\\")[0])
    except (IndexError, ValueError):
        out["spacing_row"] = None
    try:
        iop = [float(v) for v in root.get("00200037") or []]
        out["iop"] = iop if len(iop) == 6 else None
    except ValueError:
        out["iop"] = None
    if with_pixels and not out["error"]:
        pixels = reader.pixels
        if isinstance(pixels, list):
            if out["syntax"] == RLE and pixels:
                pixels = unpacked(pixels, out["rows"], out["cols"])
            else:
                out["error"], pixels = f"unsupported transfer syntax {out['syntax']}", None
        if pixels is not None and out["syntax"] == BIG and out["bits"] == 16:
            pixels = b"".join(pixels[i + 1 : i + 2] + pixels[i : i + 1] for i in range(0, len(pixels) - 1, 2))
        out["pixels"] = pixels
        if pixels is None and not out["error"]:
            out["error"] = "no pixel data"
    return out


ELEMENT = "struct<scope: string, depth: int, item_path: string, ancestor_tags: array<string>, ancestor_items: array<string>, grp: int, elem: int, tag: string, vr: string, value: array<string>>"
PARSED = f"instance_id string, patient_old string, rel_dir string, filename string, preamble binary, transfer_syntax string, rows int, cols int, slope double, intercept double, photometric string, spacing_row double, iop array<double>, bits int, signed int, pixels binary, error string, elements array<{ELEMENT}>"


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, content, patient_old, rel_dir, filename of every file below the root's sub-folders."""
    spark_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = spark_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark_path).toUri().getPath().rstrip("/")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index(F.col("path"), full + "/", -1)
    parts = F.split(rel, "/")
    d = d.select("path", "content", rel.alias("rel")).filter(F.col("rel").contains("/"))
    return d.select("path", "content", F.get(parts, F.lit(0)).alias("patient_old"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("rel_dir"), F.element_at(parts, -1).alias("filename"), F.col("rel").alias("instance_id"))


def parsed(found: DataFrame, with_pixels: bool = True, with_content: bool = False) -> DataFrame:
    """One row for each file, PARSED; without pixels the parser doesn't keep them.  With its content, it can be parsed again."""
    names = ["scope", "depth", "item_path", "ancestor_tags", "ancestor_items", "grp", "tag", "vr", "value"]

    def run(batches):
        import pyarrow as pa  # noqa: F811

        for b in pieces(batches, "content"):
            rows = []
            for r in b.to_pylist():
                p = parse(r["content"] or b"", with_pixels)
                elements = [dict(zip(names, e, strict=True)) | {"elem": int(e[6][4:], 16)} for e in p["elements"]]
                rows.append({k: r[k] for k in ("instance_id", "patient_old", "rel_dir", "filename")} | {"preamble": p["preamble"], "transfer_syntax": p["syntax"], **{k: p[k] for k in ("rows", "cols", "slope", "intercept", "photometric", "spacing_row", "iop", "bits", "signed", "pixels", "error")}, "elements": elements})
            out = pa.RecordBatch.from_pylist(rows, schema=ARROW)
            yield pa.RecordBatch.from_arrays([*out.columns, b.column("content")], [*ARROW.names, "content"]) if with_content else out

    d = found.select("content", "instance_id", "patient_old", "rel_dir", "filename")
    return d.mapInArrow(run, PARSED + ", content binary" * with_content)


TEXTS = pa.list_(pa.string())
ARROW = pa.schema([
    ("instance_id", pa.string()), ("patient_old", pa.string()), ("rel_dir", pa.string()), ("filename", pa.string()), ("preamble", pa.binary()), ("transfer_syntax", pa.string()),
    ("rows", pa.int32()), ("cols", pa.int32()), ("slope", pa.float64()), ("intercept", pa.float64()), ("photometric", pa.string()), ("spacing_row", pa.float64()), ("iop", pa.list_(pa.float64())),
    ("bits", pa.int32()), ("signed", pa.int32()), ("pixels", pa.binary()), ("error", pa.string()),
    ("elements", pa.list_(pa.struct([("scope", pa.string()), ("depth", pa.int32()), ("item_path", pa.string()), ("ancestor_tags", TEXTS), ("ancestor_items", TEXTS), ("grp", pa.int32()), ("elem", pa.int32()), ("tag", pa.string()), ("vr", pa.string()), ("value", TEXTS)]))),
])


def root_values(tag: str):
    """Value list of a root element, from the elements of a parsed row."""
    return F.get(F.filter("elements", lambda e: (e.tag == tag) & (e.depth == 0) & (e.scope == "dataset")), F.lit(0)).value


def elements(rows: DataFrame) -> DataFrame:
    """Element rows of parsed files, with their other columns but pixels and preamble left behind."""
    extra = [c for c in ("patient", "new_id") if c in rows.columns]
    return rows.select("instance_id", *extra, F.explode("elements").alias("e")).select("instance_id", *extra, "e.*")


def errors(rows: DataFrame) -> DataFrame:
    """file, error of what couldn't be read."""
    return rows.filter("error IS NOT NULL").select(F.col("instance_id").alias("file"), "error")


def image_dirs(rows: DataFrame) -> DataFrame:
    """Folders with a readable file."""
    return rows.filter("error IS NULL").select("patient_old", "rel_dir").distinct()


