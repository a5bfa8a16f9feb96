"""Exact Jaccard join on word shingles (operator 9) in a metric space of sets, with pivots and regions.

Unrelated documents are all at Jaccard distance exactly 1, so a document as a pivot tells nothing about them and the
triangle window of a plain Voronoi partition would replicate every document everywhere.  The first level therefore
takes single shingles as pivots: the nearest pivots of a set are its own members, and its region is the first of them
in one fixed order of all shingles (rarer first).  A document within distance r must share a member among the first
n - ceil((1 - r) n) + 1, so that boundary window of pivots is where a document is replicated; nothing else can link.
The second level works on regions with documents as pivots: all members are measured against the most central one;
those within r are one component and need no further pairs among themselves, the rest go on to the next pivots,
pruned by size, by position and by the triangle window |d(x, p) - d(y, p)| <= r, until one component or no pair is left.

Exact copies of a shingle set are one class before the join.  Shingles are 64-bit hashes.

Defined results: a null or empty text, or one without words, has no shingles and is a component by itself; fewer words
than the shingle length make one shingle; repeated rows and equal texts are one class; the component of a class is
the smallest doc_id that its links reach, null where all of them are.  Rows that share a doc_id are linked by their own texts alone.
Ties in the order of shingles or pivots change no result.  A text is cut into shingles as a whole, some 15 times its bytes of memory.  Other
columns, also with clashing names, don't enter; ``one_of_each`` returns them with their values.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import MADE, drop_staged, free_name, mix64, only, ranges, slices, staged, string_hashes, texts, word_codes


@dataclass(frozen=True)
class JoinParams:
    """Order and batch sizes change the work, never the result.  ``broadcast_rows`` ids and digests take some 20 MB.

    The order counts shingles in one of ``order_rate`` documents and puts at most ``order_size`` frequent ones last.
    Regions of up to ``small`` members compare all of them at once.
    """

    words: int = 5
    percent: int = 75
    order_rate: int = 16
    order_least: int = 3
    order_size: int = 1 << 18
    small: int = 16
    pivots: int = 16
    broadcast_rows: int = 400_000


def shingle_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the sorted distinct shingle hashes of each text."""
    codes, starts, names = word_codes(text, lower_ascii=True)
    w = string_hashes(names)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(starts)
    factors = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for j in range(words):
        h += w[j : j + len(h)] * factors[j]
    full = n >= words
    at = ranges(starts[:-1][full], n[full] - words + 1)
    h = mix64(h[at])
    bounds = np.concatenate(([0], np.cumsum(np.where(full, n - words + 1, 0))))
    out = []
    for i, (k, a, b) in enumerate(zip(n.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if k >= words:
            s = np.sort(h[a:b])
            if len(s) > 1:
                new = s[1:] != s[:-1]
                s = s if new.all() else s[np.concatenate(([True], new))]
        elif k:
            part = w[starts[i] : starts[i] + k]
            s = mix64(np.array([(part * factors[:k]).sum(dtype=np.uint64) ^ np.uint64(k)]))
        else:
            s = h[:0]
        out.append(s)
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return (np.concatenate(out) if out else h[:0]), np.concatenate(([0], np.cumsum(sizes)))


def frequent_order(docs: DataFrame, params: JoinParams) -> np.ndarray:
    """Frequent shingles of a fixed share of the documents, rarest first: at most ``order_size``."""

    def run(batches):
        for b in slices(batches, limit=4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(texts(b), params.words)[0].view(np.int64))], ["h"])

    part = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(params.order_rate)) == 0)
    got = part.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= params.order_least).orderBy(F.desc("count"), "h").limit(params.order_size).toArrow()
    return got.column("h").to_numpy()[::-1]


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def noded(docs: DataFrame) -> tuple[DataFrame, bool, bool]:
    """(doc_id (unique but for equal texts), own (the row's doc_id), text, text_key; whether the two ids differ; whether a row may be repeated).

    Where a doc_id is null or stands at different texts, all rows get a 64-bit hash of doc_id and text for an id.
    """
    d = only(docs, doc_id="long", text="string").withColumn("text_key", text_key(F.col("text"))).withColumn("own", F.col("doc_id"))
    ids = d.groupBy("doc_id").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.count("*").alias("n"))
    shared, most = ids.agg(F.bool_or(F.expr("doc_id IS NULL OR lo <> hi")), F.max("n")).first()
    return (d.withColumn("doc_id", F.xxhash64("own", "text_key")) if shared else d), bool(shared), (most or 0) > 1


def shingled(docs: DataFrame, params: JoinParams) -> DataFrame:
    """doc_id, own, text_key, cls (digest of the shingle set), n, common (frequent members), prefix: the window of pivots, in order."""
    spark = docs.sparkSession
    order = frequent_order(docs, params)
    by_hash = np.argsort(order.view(np.uint64))
    sent = spark.sparkContext.broadcast((order.view(np.uint64)[by_hash], by_hash.astype(np.int64)))

    def run(batches):
        known, place = sent.value
        for b in slices(batches, limit=4 << 20):
            h, at = shingle_sets(texts(b), params.words)
            n = np.diff(at)
            rank = np.full(len(h), -1, np.int64)
            if len(known) and len(h):
                pos = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[pos] == h, place[pos], -1)
            size = n - (params.percent * n + 99) // 100 + 1
            size[n == 0] = 0
            # a shingle's place in the order of all: rare ones by hash, then the frequent ones by rank
            keys = np.where(rank < 0, h >> np.uint64(1), np.uint64(1 << 63) + np.maximum(rank, 0).astype(np.uint64))
            often, cls, rows = np.concatenate(([0], np.cumsum(rank >= 0))), [], []
            common = often[at[1:]] - often[at[:-1]]
            for i, (doc, a, z, k) in enumerate(zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), size.tolist(), strict=True)):
                cls.append(hashlib.blake2b(h[a:z].tobytes() or str(doc).encode(), digest_size=16).digest())
                rows.append(np.sort(keys[a:z])[:k] if common[i] else keys[a : a + k])
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array((np.concatenate(rows) if rows else keys[:0]).view(np.int64)))
            columns = [b.column("doc_id"), b.column("own"), b.column("text_key"), pa.array(cls, pa.binary()), pa.array(n), pa.array(common), prefix]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own", "text_key", "cls", "n", "common", "prefix"])

    return docs.mapInArrow(run, "doc_id long, own long, text_key long, cls binary, n long, common long, prefix array<long>")


def may_link(percent: int) -> str:
    """Size and position filters of x and y in a region, in SQL."""
    m = "least(x.n - x.pos, y.n - y.pos)"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND 100 * {m} >= {percent} * (x.n + y.n - {m})"


def region_rows(classes: DataFrame, params: JoinParams) -> DataFrame:
    """s, doc, n, pos, size, pivot (doc, n, pos): members of each region that has two or more."""
    e = classes.select(F.col("doc_id").alias("doc"), "n", (1000 - F.floor(1000 * F.col("common") / F.col("n"))).cast("int").alias("far"), F.posexplode("prefix").alias("pos", "s"))
    w = Window.partitionBy("s")
    e = e.withColumn("size", F.count("*").over(w)).withColumn("pivot", F.min(F.struct("far", "doc", "n", "pos")).over(w))
    return e.filter("size > 1").select("s", "doc", "n", "pos", "size", "pivot")


def first_pairs(regions: DataFrame, params: JoinParams) -> DataFrame:
    """a < b: all pairs of small regions that may link, and each member of a large one with its pivot."""
    ok = may_link(params.percent)
    lists = regions.filter(F.col("size") <= params.small).groupBy("s").agg(F.sort_array(F.collect_list(F.struct("doc", "n", "pos"))).alias("m"))
    small = lists.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {params.small}), y -> x.doc < y.doc AND {ok}), y -> struct(x.doc AS a, y.doc AS b))))")).alias("p")).select("p.*")
    large = regions.filter(F.col("size") > params.small).select(F.struct("doc", "n", "pos").alias("x"), F.col("pivot").alias("y")).filter(f"x.doc <> y.doc AND {ok}")
    return small.unionByName(large.select(F.expr("least(x.doc, y.doc)").alias("a"), F.expr("greatest(x.doc, y.doc)").alias("b"))).distinct()


def possible(pairs: DataFrame, first: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs whose windows leave room for a link.

    Up to the smaller of their last pivots both windows are whole, so common members up to there are counted; beyond,
    no more can be common than either set has left.
    """
    own = first.select("doc_id", "n", "prefix")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    if ids.count() <= params.broadcast_rows:
        own = own.join(F.broadcast(ids), "doc_id", "left_semi")
    d = pairs.join(own.toDF("a", "na", "pa"), "a").join(own.toDF("b", "nb", "pb"), "b").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches):
        for b in batches:
            parts = []
            for c in ("pa", "pb"):
                column = b.column(c)
                offsets = column.offsets.to_numpy()
                parts.append((column.values.to_numpy().view(np.uint64), offsets.tolist()))
            (vx, ox), (vy, oy) = parts
            keep = np.zeros(b.num_rows, bool)
            for i, (nx, ny) in enumerate(zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True)):
                x, y = vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]]
                last = min(x[-1], y[-1])
                x, y = x[: np.searchsorted(x, last, "right")], y[: np.searchsorted(y, last, "right")]
                z = np.sort(np.concatenate((x, y)))
                most = int((z[1:] == z[:-1]).sum()) + min(nx - len(x), ny - len(y))
                keep[i] = 100 * most >= params.percent * (nx + ny - most)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])

    return d.mapInArrow(run, "a long, b long").distinct()


def bit(column: str) -> Column:
    """The bit of an id in a map of 2 ** 25 bits."""
    return F.pmod(F.xxhash64(column, F.lit(11)), F.lit(1 << 25))


def measured(docs: DataFrame, pairs: DataFrame, params: JoinParams) -> DataFrame:
    """a, b, inter, total (sizes of intersection and union) of each pair, from whole texts.

    A bitmap of fixed size (at most 4 MB) keeps most other documents from being cut into shingles again.
    """
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    got = ids.withColumn("place", bit("id")).groupBy(F.floor(F.col("place") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << 19, np.int64)
    bitmap[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(bitmap)
    keyed = docs.withColumn("place", bit("doc_id"))

    def members(batches):
        import pyarrow.compute as pc

        bits = sent.value
        for b in batches:
            place = pc.fill_null(b.column("place"), 0).to_numpy(zero_copy_only=False)
            hit = (bits[place >> 6] >> (place & 63)) & 1 == 1
            for part in slices([b.filter(pa.array(hit))], limit=4 << 20):
                h, at = shingle_sets(texts(part), params.words)
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets.cast(pa.binary())], ["id", "members"])

    sets = staged(keyed.mapInArrow(members, "id long, members binary").filter("id IS NOT NULL"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")

    def measure(batches):
        for b in batches:
            inter, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(b.column("ma"), b.column("mb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate((x, y)))
                inter[i] = (z[1:] == z[:-1]).sum()
                total[i] = len(z) - inter[i]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(inter), pa.array(total)], ["a", "b", "inter", "total"])

    return both.select("a", "b", "ma", "mb").mapInArrow(measure, "a long, b long, inter long, total long")


def components(links: DataFrame) -> DataFrame:
    """id, comp: the smallest id that each linked id reaches.  Rounds of neighbour minima and pointer jumps, each
    written to the shared folder; the number of rounds follows the logarithm of a component's diameter."""
    edges = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("comp")).withColumnRenamed("u", "id")
    labels = staged(labels, "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), F.col("comp").alias("c")), "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("c"))
        low = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        # a component's label is an id with a label of its own: jump to that
        jump = low.join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("further")), "comp").select("id", "old", F.least("comp", "further").alias("comp"))
        new = staged(jump, "labels")
        labels = new.select("id", "comp")
        if not new.filter("comp <> old").limit(1).count():
            return labels


def representatives(rows: DataFrame, reps: DataFrame, params: JoinParams) -> DataFrame:
    """doc_id, n, common, prefix of one document of each class.

    Where the copies to leave out are few by count, their ids are broadcast and the wide rows stay where they are;
    otherwise both sides are dealt by class and id.
    """
    keys = rows.filter("n > 0").select("doc_id", "cls").join(reps, "cls").filter("doc_id <> rep").select("doc_id", "cls").distinct()
    copies = staged(keys, "copies")
    wanted = ["doc_id", "n", "common", "prefix"]
    if copies.count() <= params.broadcast_rows:
        return rows.filter("n > 0 AND doc_id IS NOT NULL").join(F.broadcast(copies), ["doc_id", "cls"], "left_anti").select(*wanted)
    return rows.join(reps, (rows.cls == reps.cls) & (rows.doc_id == reps.rep)).select(*wanted)


def classes_of(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """own, text_key, cls, n, comp, least of each row: its class, that class's component and the component's smallest doc_id."""
    before = len(MADE)
    d, hashed, repeated = noded(docs)
    rows, reps, comps = linked(d, repeated, params)
    named = reps.join(comps, reps.rep == comps.id, "left").select("cls", F.coalesce("comp", "rep").alias("comp"))
    out = rows.join(named, "cls", "left").select("own", "text_key", "cls", "n", "comp")
    drop_staged(docs.sparkSession, MADE[before:], out)
    if not hashed:
        return out.withColumn("least", F.col("comp"))
    least = out.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("own").alias("least"))
    return out.join(least, "comp", "left")


def linked(d: DataFrame, repeated: bool, params: JoinParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, own, text_key, cls, n; members: cls, rep; components of linked representatives: id, comp)."""
    rows = staged(shingled(d, params), "shingles")
    reps = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    first = representatives(rows, reps, params)
    if repeated:  # aggregated before the shuffle too
        first = first.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("n", "common", "prefix")])
    regions = staged(region_rows(first, params), "regions")
    tried = staged(first_pairs(regions, params), "pairs")
    found = staged(measured(d, staged(possible(tried, first, params), "possible"), params), "measured")
    near = f"100 * inter >= {params.percent} * total"
    links = found.filter(near).select("a", "b")
    large = regions.filter(F.col("size") > params.small)
    if not large.limit(1).count():
        return rows, reps, components(links)
    # the first pivot's distance is each member's coordinate for the triangle window
    by_pair = found.select("a", "b", (1 - F.col("inter") / F.col("total")).alias("d"))
    large = large.withColumn("a", F.least("doc", "pivot.doc")).withColumn("b", F.greatest("doc", "pivot.doc")).join(by_pair, ["a", "b"], "left").filter("doc <> pivot.doc").select("s", "doc", "n", "pos", "d")
    left, m = staged(large, "large"), params.pivots
    comps = components(links)
    while True:
        own = left.join(comps.select(F.col("id").alias("doc"), "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        w = Window.partitionBy("s")
        own = own.withColumn("lo", F.min("comp").over(w)).withColumn("hi", F.max("comp").over(w)).filter("lo < hi").withColumn("mine", F.count("*").over(Window.partitionBy("s", "comp")))
        left = staged(own.withColumn("k", F.row_number().over(w.orderBy("mine", "comp", "doc"))).select("s", "doc", "n", "pos", "d", "comp", "k"), "open")
        pivots = left.filter(F.col("k") <= m)
        window = f"(x.d IS NULL OR y.d IS NULL OR abs(x.d - y.d) <= {1 - params.percent / 100} + 1e-9)"
        more = pivots.alias("x").join(left.alias("y"), F.expr(f"x.s = y.s AND x.k < y.k AND x.comp <> y.comp AND {window} AND {may_link(params.percent)}"))
        more = staged(more.select(F.expr("least(x.doc, y.doc)").alias("a"), F.expr("greatest(x.doc, y.doc)").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(more)
        more = staged(possible(more, first, params), "possible")
        if more.limit(1).count():
            found = staged(found.unionByName(measured(d, more, params)), "measured")
            comps = components(found.filter(near).select("a", "b"))
        left = left.filter(F.col("k") > m).select("s", "doc", "n", "pos", "d")
        if not left.limit(1).count():
            return rows, reps, comps
        m *= 4


def near_components(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("own"))
    return classes_of(docs, params).select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row of each component of linked rows: that of its smallest (doc_id, hash of the text), null ids last; of rows
    that share both, the smallest by their other columns.  Rows without words are linked with nothing and all stay;
    all columns of ``docs`` with their values."""
    before = len(MADE)
    d = classes_of(docs, params).filter("n > 0")
    row = F.struct(F.col("own").isNull().alias("last"), F.coalesce("own", F.lit(0)).alias("doc_id"), "text_key")
    d = d.select("comp", row.alias("row")).groupBy("comp", "row").count()
    # dealt by row, not by component, of which one may hold a large share of all rows
    first = d.groupBy("comp").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("stays"))
    d = d.join(first, "row", "left").select(F.expr("CASE WHEN NOT row.last THEN row.doc_id END AS doc_id"), "row.text_key", "count", F.coalesce("stays", F.lit(False)).alias("stays"))
    d = staged(d, "choice")
    drop_staged(docs.sparkSession, MADE[before:-1])
    doc, key = free_name(docs, "choice_doc"), free_name(docs, "choice_key")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_key(F.col("text")) == F.col(key))
    left = docs.join(d.filter("NOT stays").select("doc_id", "text_key").toDF(doc, key), same, "left_anti")
    many = d.filter("stays AND count > 1").select("doc_id", "text_key").toDF(doc, key)
    if not many.limit(1).count():
        return left
    # equal rows: a grouped minimum, which is taken before the shuffle too
    several = left.join(many, same).groupBy(doc, key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("r")).select("r.*")
    return left.join(many, same, "left_anti").unionByName(several)
