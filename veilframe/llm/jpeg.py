"""Media columns as baseline JPEG (operator 4), in numpy.

Storing: each payload byte is the mean of one 8 x 8 block of a grey image 24 blocks wide; with a DC quantiser of 8 the
quantised DC coefficient is that byte less 128, so the file holds the payload without loss.  All AC coefficients are
zero.  Restart markers every 96 blocks make intervals that decode independently; payloads past a JPEG's height go on
in further images of the same medium.

Reading: markers are parsed, stuffed bytes and restart markers come out, and the Huffman-coded intervals of all images
of a slice that share their tables are decoded in lock-step, one symbol of each interval at a time, any baseline
sampling and any AC coefficients included.  The DC coefficients of the luminance are the thumbnail.

Texts longer than a step are stored and read back image by image, so that their memory is some times their own bytes.

Defined results: a null or empty text is one payload unit of 255s; a medium that isn't baseline JPEG gives null
features and the reason.  Rows keep their number, repeated rows and those that share a doc_id included; equal texts have equal values.
Other columns, also with clashing names, don't enter.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilframe.llm.common import only, ranges, slices, texts

UNIT, WIDE, INTERVAL = 576, 24, 96
MOST = UNIT * 340
#: The usual DC luminance code (numbers of codes by length, then the categories).
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))
#: One AC symbol, the end of a block, in one bit.
AC_COUNTS = [1] + [0] * 15
AC_VALUES = [0]


def canonical(counts, values) -> dict[int, tuple[int, int]]:
    """value -> (code, length) of a Huffman table."""
    code, at, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


@functools.lru_cache(64)
def lookup(counts: bytes, values: bytes) -> np.ndarray:
    """value << 8 | length for each 16 bits that may come; length 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    for value, (code, length) in canonical(counts, values).items():
        table[code << 16 - length : code + 1 << 16 - length] = value << 8 | length
    return table


@functools.lru_cache(1)
def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of a block whose DC differs by -255 ... 255 and that ends there."""
    dc = canonical(DC_COUNTS, DC_VALUES)
    codes, lengths = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = dc[size]
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        codes[diff + 255], lengths[diff + 255] = (code << size | extra) << 1, length + size + 1
    return codes, lengths


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def header(units: int) -> bytes:
    """All before the entropy-coded data of an image with so many payload units."""
    frame = struct.pack(">BHHB", 8, units * UNIT // WIDE * 8, WIDE * 8, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + segment(0xDB, bytes([0, 8] + [1] * 63)) + segment(0xC0, frame) + segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_VALUES])) + segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_VALUES])) + segment(0xDD, struct.pack(">H", INTERVAL)) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def store(payload: np.ndarray, units: np.ndarray) -> list[bytes]:
    """A medium for each of the payloads that lie one after another with so many units."""
    per = MOST // UNIT
    many = -(-units // per)
    image_units = np.full(int(many.sum()), per, np.int64)
    last = np.cumsum(many) - 1
    image_units[last] = units - (many - 1) * per
    level = payload.reshape(-1, INTERVAL).astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0) + 255
    codes, lengths = block_codes()
    n_int = len(level)
    size = np.zeros((n_int, INTERVAL + 1), np.int64)
    size[:, :INTERVAL] = lengths[diff]
    bits = size.sum(1)
    size[:, INTERVAL] = -bits % 8
    code = np.zeros((n_int, INTERVAL + 1), np.uint64)
    code[:, :INTERVAL] = codes[diff]
    code[:, INTERVAL] = (1 << size[:, INTERVAL]) - 1
    n_bytes = (bits + 7) // 8
    at = np.cumsum(size.ravel()) - size.ravel()
    word, off = at >> 5, at & 31
    value = code.ravel() << (64 - off - size.ravel()).astype(np.uint64) % np.uint64(64)
    value[size.ravel() == 0] = 0
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(value >> np.uint64(32), first)
    spill = np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
    words[word[first] + 1] |= spill
    data = words.astype(">u4").view(np.uint8)[: int(n_bytes.sum())]
    # places of all bytes in the media: headers, stuffed zeros, restart markers and end markers between them
    per_image = image_units * (UNIT // INTERVAL)
    image = np.repeat(np.arange(len(per_image)), per_image)
    heads = [header(u) for u in image_units.tolist()]
    head = len(heads[0])
    full = data == 255
    before = np.cumsum(full) - full
    nth = np.arange(n_int) - np.repeat(np.cumsum(per_image) - per_image, per_image)
    shift = 2 * (np.arange(n_int) - image) + head * (image + 1) + 2 * image
    place = np.arange(len(data)) + before + np.repeat(shift, n_bytes)
    ends = np.cumsum(n_bytes)
    total = len(data) + int(full.sum()) + 2 * (n_int - len(heads)) + (head + 2) * len(heads)
    out = np.zeros(total, np.uint8)
    out[place] = data
    tail = place[ends - 1] + 1 + full[ends - 1]
    mid = nth < per_image[image] - 1
    out[tail[mid]], out[tail[mid] + 1] = 255, 0xD0 + nth[mid] % 8
    stop = tail[~mid]
    out[stop], out[stop + 1] = 255, 0xD9
    start = np.concatenate(([0], stop[:-1] + 2))
    for s, h in zip(start.tolist(), heads, strict=True):
        out[s : s + head] = np.frombuffer(h, np.uint8)
    cuts = np.concatenate(([0], (stop + 2)[last]))
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class NotBaseline(ValueError):
    pass


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The image that starts at ``at``: its tables, frame and the bounds of its scan; and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    image: dict = {"dqt": {}, "dht": {}, "dri": 0}
    at += 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 255:
            raise NotBaseline("marker expected")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                step = 128 if wide else 64
                image["dqt"][body[0] & 15] = struct.unpack_from(">H" if wide else "B", body, 1)[0]
                body = body[1 + step :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image["dht"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise NotBaseline("8-bit samples expected")
            image["height"], image["width"] = struct.unpack_from(">HH", body, 1)
            image["parts"] = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5]))
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise NotBaseline(f"frame type {marker:02X}")
        elif marker == 0xDD:
            image["dri"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if "parts" not in image or body[0] != len(image["parts"]):
                raise NotBaseline("one scan of all components expected")
            image["coded"] = tuple((body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            end = data.find(b"\xff\xd9", at)
            if end < 0:
                raise NotBaseline("no end of image")
            image["scan"] = (at, end)
            return image, end + 2
        elif marker == 0xD9:
            raise NotBaseline("no scan")


def shape(image: dict) -> tuple:
    """What images must share to be decoded together."""
    try:
        tables = tuple((image["dht"][d], image["dht"][16 + a]) for d, a in image["coded"])
        return (tuple(p[1:3] for p in image["parts"]), tables, image["dqt"][image["parts"][0][3]])
    except KeyError as e:
        raise NotBaseline(f"missing table {e}") from e


def decode_group(data: np.ndarray, images: list[dict]) -> list[np.ndarray]:
    """Luminance DC means (0 to 255) of each image, rows x columns of blocks, for images of one ``shape``."""
    sampling, tables, quant = shape(images[0])
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    if len(sampling) == 1:
        sampling, most_h, most_v = ((1, 1),), 1, 1
    scan_a = np.array([i["scan"][0] for i in images])
    scan_n = np.array([i["scan"][1] for i in images]) - scan_a
    wide = np.array([-(-i["width"] // (8 * most_h)) for i in images])
    tall = np.array([-(-i["height"] // (8 * most_v)) for i in images])
    mcus = wide * tall
    raw = data[ranges(scan_a, scan_n)]
    owner = np.repeat(np.arange(len(images)), scan_n)
    after = np.concatenate((raw[1:], [0]))
    mark = (raw == 255) & (after >= 0xD0) & (after <= 0xD7)
    drop = mark | np.concatenate(([False], mark[:-1])) | ((raw == 0) & np.concatenate(([False], raw[:-1] == 255)))
    keep = np.flatnonzero(~drop)
    clean = np.concatenate((raw[keep], np.full(16, 255, np.uint8)))
    # intervals begin with each image and behind each restart marker
    begins = np.sort(np.concatenate((np.cumsum(scan_n) - scan_n, np.flatnonzero(mark) + 2)))
    lane_image = owner[np.minimum(begins, len(owner) - 1)]
    lane_at = np.searchsorted(keep, begins)
    nth = np.arange(len(begins)) - np.searchsorted(lane_image, lane_image)
    every = np.array([i["dri"] or m for i, m in zip(images, mcus.tolist(), strict=True)])
    lane_n = np.clip(mcus[lane_image] - nth * every[lane_image], 0, every[lane_image])
    order = np.argsort(-lane_n, kind="stable")
    pos, left = lane_at[order].astype(np.int64) * 8, lane_n[order]
    eight = np.lib.stride_tricks.sliding_window_view(clean, 8)
    window = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)
    last = len(window) - 1
    blocks_y = sampling[0][0] * sampling[0][1]
    steps = int(left[0]) if len(left) else 0
    means = np.zeros((len(pos), steps, blocks_y), np.int32)
    pred = np.zeros((len(sampling), len(pos)), np.int64)
    table = [(lookup(*map(bytes, d)), lookup(*map(bytes, a))) for d, a in tables]
    one = np.uint64(1)

    def peek(p: np.ndarray) -> np.ndarray:
        return window[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint64)

    for step in range(steps):
        live = int(np.searchsorted(-left, -step, side="left"))
        p = pos[:live]
        for part, (h, v) in enumerate(sampling):
            dc, ac = table[part]
            for block in range(h * v):
                w = peek(p)
                got = dc[(w >> np.uint64(48)).astype(np.int64)]
                size, length = got >> 8, got & 255
                if not length.all():
                    raise NotBaseline("bad DC code")
                w <<= length.astype(np.uint64)
                extra = ((w >> one) >> (63 - size).astype(np.uint64)).astype(np.int64)
                extra -= np.where(extra < (1 << size >> 1), (1 << size) - 1, 0)
                w <<= size.astype(np.uint64)
                p += length + size
                pred[part, :live] += extra
                if not part:
                    means[:live, step, block] = pred[0, :live]
                got = ac[(w >> np.uint64(48)).astype(np.int64)]
                if not (got & 255).all():
                    raise NotBaseline("bad AC code")
                p += got & 255
                more = np.flatnonzero(got >> 8)
                k = np.zeros(len(more), np.int64)
                got = got[more]
                while len(more):  # lanes whose block goes on: skip the coefficient, read the next symbol
                    run, size = got >> 12, (got >> 8) & 15
                    k += run + 1
                    p[more] += size
                    on = k < 63
                    more, k = more[on], k[on]
                    if not len(more):
                        break
                    got = ac[(peek(p[more]) >> np.uint64(48)).astype(np.int64)]
                    if not (got & 255).all():
                        raise NotBaseline("bad AC code")
                    p[more] += got & 255
                    on = got >> 8 != 0
                    more, k, got = more[on], k[on], got[on]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out = []
    lanes = np.searchsorted(lane_image, np.arange(len(images) + 1))
    for i, image in enumerate(images):
        mine = back[lanes[i] : lanes[i + 1]]
        dc = np.concatenate([means[r, :n] for r, n in zip(mine.tolist(), lane_n[lanes[i] : lanes[i + 1]].tolist(), strict=True)]) if len(set(lane_n[lanes[i] : lanes[i + 1]].tolist())) > 1 else means[mine, : lane_n[lanes[i]]].reshape(-1, blocks_y)
        if len(dc) < mcus[i]:
            raise NotBaseline("scan too short")
        h, v = sampling[0]
        grid = dc[: mcus[i]].reshape(tall[i], wide[i], v, h).transpose(0, 2, 1, 3).reshape(tall[i] * v, wide[i] * h)
        grid = grid[: -(-image["height"] * v // (8 * most_v)), : -(-image["width"] * h // (8 * most_h))]
        out.append(np.clip(np.rint(grid * quant / 8) + 128, 0, 255).astype(np.uint8))
    return out


def read(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]] | NotBaseline]:
    """For each medium its images as (width, height, thumbnail), or why it can't be read."""
    data = np.frombuffer(b"".join(media), np.uint8)
    base, at, found, groups = 0, 0, [], {}
    for m in media:
        try:
            images, at = [], 0
            while at < len(m):
                image, at = parse(m, at)
                image["scan"] = tuple(base + x for x in image["scan"])
                image["key"] = shape(image)
                images.append(image)
            if not images:
                raise NotBaseline("no image")
            for image in images:
                groups.setdefault(image["key"], []).append(image)
            found.append(images)
        except (NotBaseline, IndexError, struct.error) as e:
            found.append(e if isinstance(e, NotBaseline) else NotBaseline("cut short"))
        base += len(m)
    for images in groups.values():
        try:
            done = decode_group(data, images)
        except NotBaseline:  # one damaged image must not take the others along
            done = []
            for image in images:
                try:
                    done += decode_group(data, [image])
                except NotBaseline as e:
                    done.append(e)
        for image, thumb in zip(images, done, strict=True):
            image["thumb"] = thumb
    out = []
    for images in found:
        bad = images if isinstance(images, NotBaseline) else next((i["thumb"] for i in images if isinstance(i["thumb"], NotBaseline)), None)
        out.append(bad if bad is not None else [(i["width"], i["height"], i["thumb"]) for i in images])
    return out


def shrink(thumb: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means of a grid of cells; cells overlap where the thumbnail has fewer lines than the grid."""
    for axis, n in ((0, rows), (1, cols)):
        size = thumb.shape[axis]
        low = np.arange(n) * size // n
        high = np.maximum((np.arange(1, n + 1) * size) // n, low + 1)
        total = np.concatenate((np.zeros_like(np.take(thumb, [0], axis), np.float64), np.cumsum(thumb, axis=axis, dtype=np.float64)), axis=axis)
        thumb = (np.take(total, high, axis) - np.take(total, low, axis)) / (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
    return thumb


def feature(images: list[tuple[int, int, np.ndarray]]) -> str:
    """Dimensions, average hash and difference hash of each image."""
    out = []
    for width, height, thumb in images:
        grid = shrink(thumb, 8, 9)
        bits = lambda x: int("".join("1" if b else "0" for b in x.ravel()), 2)
        out.append(f"{width}x{height}:a{bits(grid[:, :8] > grid[:, :8].mean()):016x}:d{bits(grid[:, 1:] > grid[:, :-1]):016x}")
    return "+".join(out)


def payloads(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(payload bytes, sizes of the texts, units) of UTF-8 texts, each padded with 255."""
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    sizes = np.diff(edges)
    units = np.maximum(1, -(-sizes // UNIT))
    out = np.full(int(units.sum()) * UNIT, 255, np.uint8)
    out[ranges((np.cumsum(units) - units) * UNIT, sizes)] = raw[edges[0] : edges[-1]]
    return out, sizes, units


def runs_of(raw: np.ndarray, step: int):
    """The payload of one text, in padded runs of whole images of about ``step`` bytes; an empty text has one run."""
    per = max(1, step // MOST) * MOST
    for at in range(0, max(1, len(raw)), per):
        part = raw[at : at + per]
        size = max(1, -(-len(part) // UNIT)) * UNIT
        yield np.concatenate((part, np.full(size - len(part), 255, np.uint8)))


def stored_in_runs(raw: np.ndarray, step: int):
    """Media of the runs of one text; end to end they are its medium."""
    for payload in runs_of(raw, step):
        yield store(payload, np.array([len(payload) // UNIT]))[0]


def digest_in_runs(raw: np.ndarray, step: int) -> tuple:
    """What ``digests`` returns of one text, but for its doc_id."""
    payload, media, tail, sizes, features = hashlib.sha256(), hashlib.sha256(), b"", [0, 0], []
    for medium in stored_in_runs(raw, step):
        (images,) = read([medium])
        if isinstance(images, NotBaseline):
            raise images
        back = b"".join(t.tobytes() for _, _, t in images)
        payload.update(back)
        media.update(medium)
        tail = (tail + back)[-32:]
        sizes = [sizes[0] + len(back), sizes[1] + len(medium)]
        features.append(feature(images))
    return len(raw), sizes[0], payload.hexdigest(), zlib.crc32(tail), sizes[1], media.hexdigest(), "+".join(features)


def utf8(text: pa.Array) -> np.ndarray:
    """The bytes of the only text of an array."""
    a, z = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + 2]
    return np.frombuffer(text.buffers()[2] or b"", np.uint8)[a:z]


def stored_texts(docs: DataFrame, step: int = 1 << 20) -> DataFrame:
    """doc_id, media binary: each whole text as a medium."""

    def run(batches):
        for b in slices(batches, limit=step):
            text = texts(b)
            if b.num_rows == 1:
                media = [b"".join(stored_in_runs(utf8(text), step))]
            else:
                payload, _, units = payloads(text)
                media = store(payload, units)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, media binary")


def thumbnails(media: DataFrame, step: int = 1 << 20) -> DataFrame:
    """doc_id, width, height, feature, thumbnail, error of each medium; of several images the first gives the sizes."""

    def run(batches):
        for b in slices(batches, "media", step):
            got = read([m or b"" for m in b.column("media").to_pylist()])
            bad = [isinstance(g, NotBaseline) for g in got]
            pick = lambda f: [None if x else f(g) for x, g in zip(bad, got, strict=True)]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(pick(lambda g: g[0][0]), pa.int32()), pa.array(pick(lambda g: g[0][1]), pa.int32()), pa.array(pick(feature), pa.string()), pa.array(pick(lambda g: b"".join(t.tobytes() for _, _, t in g)), pa.binary()), pa.array([str(g) if x else None for x, g in zip(bad, got, strict=True)], pa.string())],
                ["doc_id", "width", "height", "feature", "thumbnail", "error"],
            )

    return only(media, doc_id="long", media="binary").mapInArrow(run, "doc_id long, width int, height int, feature string, thumbnail binary, error string")


def digests(docs: DataFrame, step: int = 1 << 20) -> DataFrame:
    """Sizes and digests of each text stored and read back, without the media themselves."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in slices(batches, limit=step):
            text = texts(b)
            if b.num_rows == 1:
                got = [[x] for x in digest_in_runs(utf8(text), step)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(got, kinds, strict=True))], names)
                continue
            payload, sizes, units = payloads(text)
            media = store(payload, units)
            back, features = [], []
            for images in read(media):
                if isinstance(images, NotBaseline):
                    raise images
                back.append(b"".join(t.tobytes() for _, _, t in images))
                features.append(feature(images))
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes), pa.array([len(x) for x in back], pa.int64()), sha(back), pa.array([zlib.crc32(x[-32:]) for x in back], pa.int64()), pa.array([len(m) for m in media], pa.int64()), sha(media), pa.array(features)],
                names,
            )

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
