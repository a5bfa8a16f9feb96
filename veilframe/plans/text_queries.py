"""Text functions on documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import Policy
from veilframe.functions import text
from veilframe.plans.registry import query, t

POLICY = Policy()


@query("SELECT doc_id, sha256(regexp_replace(text, '[^0-9A-Za-z:\\-_/(). ]', '', 'g')) AS allowed FROM documents")
def allowlist_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(text.allowed(F.col("text")), 256).alias("allowed"))


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))::INTEGER AS n FROM documents")
def alnum_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.alnum_count(F.col("text")).alias("n"))


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) >= 2 AS plausible FROM documents")
def text_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.plausible(F.col("text"), POLICY).alias("plausible"))


@query("""
WITH tok AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations),
cnt AS (SELECT conv_id, turn, max(n) AS most FROM (SELECT conv_id, turn, w, count(*) AS n FROM tok WHERE w <> '' GROUP BY ALL) GROUP BY ALL)
SELECT c.conv_id, c.turn, length(text) > 300 AS too_long, coalesce(most >= 6, false) AS repetitive FROM conversations c LEFT JOIN cnt ON cnt.conv_id = c.conv_id AND cnt.turn = c.turn
""")
def hallucination_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = text.flags(F.col("text"), F.lit(False), POLICY)
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_contains(f, "too_long").alias("too_long"), F.array_contains(f, "repetitive").alias("repetitive"))


@query("""
WITH tok AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations),
cnt AS (SELECT conv_id, turn, max(n) AS most FROM (SELECT conv_id, turn, w, count(*) AS n FROM tok WHERE w <> '' GROUP BY ALL) GROUP BY ALL)
SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN cnt ON cnt.conv_id = c.conv_id AND cnt.turn = c.turn
WHERE length(text) <= 300 AND coalesce(most < 6, true) AND NOT coalesce(list_bool_or(list_transform(list_distinct(string_split(text, '')), lambda x: x <> chr(10) AND contains(text, repeat(x, 10)))), false)
""")
def hallucination_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without any mark of an invented reading."""
    marks = text.flags(F.col("text"), F.lit(False), POLICY)
    return t(spark, sf_dir, "conversations").filter(F.col("text").isNotNull() & (F.size(marks) == 0)).select("conv_id", "turn")


@query(f"""
SELECT doc_id, coalesce(regexp_matches(text || repeat(chr((97 + doc_id % 26)::INTEGER), (doc_id % 14)::INTEGER), '{"|".join(f"[{c}]{{10}}" for c in (chr(97 + i) for i in range(26)))}')
  OR list_bool_or(list_transform(list_distinct(string_split(text, '')), lambda c: c <> chr(10) AND contains(text, repeat(c, 10)))), false) AS run
FROM documents
""")
def char_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ten equal characters in whole texts, some with a run at their end."""
    k = F.col("doc_id")
    s = F.concat("text", F.coalesce(F.repeat(F.char((97 + k % 26).cast("int")), (k % 14).cast("int")), F.lit("")))
    return t(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.char_run(s), F.lit(False)).alias("run"))


@query("SELECT page_id, sha256(regexp_replace(regexp_replace('<s>' || html || '<pad></s><loc_' || page_id || '> ', '</?s>|<pad>|<loc_[0-9]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS stripped FROM pages")
def strip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<s>"), "html", F.lit("<pad></s><loc_"), F.col("page_id").cast("string"), F.lit("> "))
    return t(spark, sf_dir, "pages").select("page_id", F.sha2(text.without_markers(marked), 256).alias("stripped"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_.'), ''), 'unknown') AS name FROM pages")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '.\\.[^.]*$') THEN regexp_replace(url, '\\.[^.]*$', '') ELSE url END AS stem FROM pages")
def file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", text.stem(F.col("url")).alias("stem"))


@query("""
SELECT conv_id, string_agg(s, ' | ' ORDER BY turn) AS hits FROM (SELECT conv_id, turn, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS s FROM conversations) WHERE s <> '' GROUP BY 1
""")
def joined_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("h"))
    return d.select("conv_id", text.joined_hits(F.transform("h", lambda x: x.text)).alias("hits")).filter("hits <> ''")


@query("""
SELECT conv_id, turn, substr(replace(text || CASE WHEN turn = 1 THEN ' (conf n/a)' ELSE ' (0.50)' END || CASE WHEN length(text) > 300 THEN ' [too_long]' ELSE '' END, chr(10), ' '), 1, 60) AS label FROM conversations
""")
def hit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.filter(F.array(F.when(text.too_long(F.col("text"), POLICY), F.lit("too_long"))), lambda x: x.isNotNull())
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", text.hit_label(F.col("text"), F.when(F.col("turn") != 1, F.lit(0.5)), marks).alias("label"))


@query("SELECT l_orderkey, l_linenumber, '(' || upper(lpad(to_hex(l_orderkey % 65536), 4, '0')) || ',' || upper(lpad(to_hex(l_partkey % 65536), 4, '0')) || ')' AS label FROM lineitem")
def tag_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.format_string("%04X%04X", F.col("l_orderkey") % 65536, F.col("l_partkey") % 65536)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.tag_label(tag).alias("label"))
