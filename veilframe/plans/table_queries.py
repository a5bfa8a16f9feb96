"""Mapping, cohort, dates, ages, UIDs, order and accounting on the star-schema tables.

Customers stand for patients, orders for studies, line items for slices, parts for descriptors, events for actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import Policy
from veilframe.functions import cohort, geometry, identity, raster, text
from veilframe.operators import ordering, reports
from veilframe.plans.registry import dealt, query, sql_uid, t
from veilframe.sources import mapping
from veilframe.streaming import ingest

POLICY = Policy()
HARD = Policy(hardened=True)
DAY = "strftime(o_orderdate, '%Y%m%d')"


def day(c: str):
    return F.date_format(F.col(c), "yyyyMMdd")


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping of all customers but those divisible by 7."""
    c = t(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0")
    return c.select(F.col("c_custkey").cast("string").alias("original_folder_name"), F.concat(F.lit(" P"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(" ")).alias("new_folder_name"))


def study_uid():
    return F.concat_ws(".", F.lit("1.2"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))


SQL_UID = "'1.2.' || o_custkey || '.' || o_orderkey"


@query(f"""
SELECT 'P' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS patient, count(*) AS n_studies,
       count(*) FILTER ({DAY} <> '20000101') AS n_dates, min({sql_uid(f"'test-key|' || o_custkey || '|' || {SQL_UID}")}) AS first_uid,
       count(DISTINCT {sql_uid(f"'test-key|' || o_custkey || '|' || {SQL_UID}")}) AS n_uids
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 7 <> 0 GROUP BY 1
""")
def deid_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies of mapped patients with new dates and UIDs, and the changes counted by patient."""
    ids = mapping.clean_mapping(pseudonyms(spark, sf_dir))
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("patient_old"), day("o_orderdate").alias("old_date"), study_uid().alias("uid"))
    d = mapping.pseudonymised(o, ids)
    d = d.select(F.col("new_id").alias("patient"), identity.remapped(F.col("uid"), F.col("patient_old"), POLICY).alias("uid"), (F.col("old_date") != identity.swept(F.lit("DA"), F.col("old_date"), POLICY)).alias("changed"))
    return d.groupBy("patient").agg(F.count("*").alias("n_studies"), F.count_if("changed").alias("n_dates"), F.min("uid").alias("first_uid"), F.countDistinct("uid").alias("n_uids"))


@query("""
SELECT o_orderkey, 'P' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS new_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 7 <> 0
""")
def mapping_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("patient_old"))
    return mapping.pseudonymised(o, mapping.clean_mapping(pseudonyms(spark, sf_dir))).select("o_orderkey", "new_id")


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1
""")
def mapping_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.last_wins(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("SELECT count(*) AS n_shared FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1)")
def mapping_shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("new_folder_name"))
    return mapping.shared_names(m).agg(F.count("*").alias("n_shared"))


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS patient_old FROM customer WHERE c_custkey % 7 = 0")
def mapping_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("patient_old"))
    return mapping.unmapped(c, mapping.clean_mapping(pseudonyms(spark, sf_dir)))


# parts as series: the descriptors are made of name, brand and size, so that every conjunct decides some rows
PART = """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'O CT' WHEN 2 THEN 'MR' ELSE 'Computed Tomography' END AS modality,
       CASE p_size % 3 WHEN 0 THEN 'ORIGINAL PRIMARY AXIAL' WHEN 1 THEN 'ORIGINAL PRIMARY AXIAL HELIX' ELSE 'DERIVED SECONDARY AXIAL' END AS image_type,
       CASE p_partkey % 5 WHEN 0 THEN 'He ad ' WHEN 1 THEN 'BRAIN ' WHEN 2 THEN 'chest ' WHEN 3 THEN 'Skull CTA ' ELSE 'head cta ' END || p_name AS descr,
       p_type, CASE p_partkey % 11 WHEN 0 THEN '1.2.840.10008.5.1.4.1.1.7' WHEN 1 THEN '1.2.840.10008.5.1.4.1.1.7.2' ELSE '1.2.840.10008.5.1.4.1.1.2' END AS sop
FROM part
"""
PASSED = """
(contains(replace(lower(modality), ' ', ''), 'ct') OR contains(replace(lower(modality), ' ', ''), 'computedtomography'))
AND contains(lower(image_type), 'original') AND contains(lower(image_type), 'primary') AND contains(lower(image_type), 'axial')
AND regexp_matches(replace(lower(descr || ' ' || p_type), ' ', ''), 'head|brain|skull')
AND sop NOT IN ('1.2.840.10008.5.1.4.1.1.7', '1.2.840.10008.5.1.4.1.1.7.2')
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda c, n, values: F.get(F.array(*map(F.lit, values)), (c % n).cast("int"))
    return t(spark, sf_dir, "part").select(
        "p_partkey", pick(size, 4, ["CT", "O CT", "MR", "Computed Tomography"]).alias("modality"),
        pick(size, 3, ["ORIGINAL PRIMARY AXIAL", "ORIGINAL PRIMARY AXIAL HELIX", "DERIVED SECONDARY AXIAL"]).alias("image_type"),
        F.concat(pick(k, 5, ["He ad ", "BRAIN ", "chest ", "Skull CTA ", "head cta "]), "p_name").alias("descr"), "p_type",
        F.when(k % 11 == 0, "1.2.840.10008.5.1.4.1.1.7").when(k % 11 == 1, "1.2.840.10008.5.1.4.1.1.7.2").otherwise("1.2.840.10008.5.1.4.1.1.2").alias("sop"),
    )


def in_cohort(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    d = series(spark, sf_dir)
    return d.filter(cohort.in_cohort(F.col("modality"), F.col("image_type"), F.array("descr", "p_type"), F.col("sop"), policy)).select("p_partkey")


@query(f"SELECT p_partkey FROM ({PART}) WHERE {PASSED}")
def cohort_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_cohort(spark, sf_dir, Policy(allow_angio_perfusion=True))


@query(f"SELECT p_partkey FROM ({PART}) WHERE {PASSED} AND NOT regexp_matches(descr, 'angio|cta|perfusion') AND NOT regexp_matches(p_type, 'angio|cta|perfusion')")
def cta_exclude_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_cohort(spark, sf_dir, POLICY)


@query(f"SELECT p_partkey FROM ({PART}) WHERE {PASSED} AND NOT regexp_matches(lower(descr), 'angio|cta|perfusion') AND NOT regexp_matches(lower(p_type), 'angio|cta|perfusion')")
def cta_exclude_hardened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_cohort(spark, sf_dir, HARD)


FLAG = "CASE event_id % 6 WHEN 0 THEN ' YES ' WHEN 1 THEN 'y' WHEN 2 THEN '1' WHEN 3 THEN 'NO' WHEN 4 THEN 'True' END"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.get(F.array(*[F.lit(x) for x in (" YES ", "y", "1", "NO", "True", None)]), (F.col("event_id") % 6).cast("int"))
    return t(spark, sf_dir, "events").withColumn("burned", text.burned_in(flag))


@query(f"SELECT event_id, coalesce(lower(trim({FLAG})) IN ('yes', 'y', 'true', '1'), false) AS burned FROM events")
def burned_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("event_id", "burned")


@query(f"""
WITH e AS (SELECT *, coalesce(lower(trim({FLAG})) IN ('yes', 'y', 'true', '1'), false) AS burned FROM events)
SELECT event_id, burned OR event_type = 'error' AS want, (user_id % 5 >= 3) OR burned AS maybe_text FROM e
""")
def detect_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flagged(spark, sf_dir)
    want = geometry.wanted(F.col("burned"), F.col("event_type") == "error", POLICY)
    return d.select("event_id", want.alias("want"), geometry.passes_prescreen(F.col("user_id") % 5, F.col("burned"), POLICY).alias("maybe_text"))


@query(f"""
SELECT o_orderstatus, count(*) AS n, count(*) FILTER ({DAY} <> '20000101') AS n_changed, min('20000101') AS new_date, count(DISTINCT {DAY}) AS n_old FROM orders GROUP BY 1
""")
def date_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "orders").withColumn("old", day("o_orderdate")).withColumn("new", identity.swept(F.lit("DA"), F.col("old"), POLICY))
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("new") != F.col("old")).alias("n_changed"), F.min("new").alias("new_date"), F.countDistinct("old").alias("n_old"))


DT = "CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y%m%d') ELSE strftime(ts, '%Y%m%d%H%M%S') || '.123' END"


@query(f"SELECT event_id, '20000101' || substr({DT}, 9) AS new_value, '20000101' AS hardened FROM events")
def dt_keep_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".123"))
    old = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(full)
    return t(spark, sf_dir, "events").select("event_id", identity.swept(F.lit("DT"), old, POLICY).alias("new_value"), identity.swept(F.lit("DT"), old, HARD).alias("hardened"))


@query("SELECT event_id, '000000.00' AS zeroed, strftime(ts, '%H%M%S') AS kept FROM events")
def tm_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.date_format("ts", "HHmmss")
    return t(spark, sf_dir, "events").select("event_id", identity.swept(F.lit("TM"), old, POLICY).alias("zeroed"), identity.swept(F.lit("TM"), old, Policy(zero_times=False)).alias("kept"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) - CAST(l_partkey % 40000 AS INTEGER) AS birth, CAST(l_shipdate AS DATE) AS exam FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
y AS (SELECT *, year(exam) - year(birth) - CASE WHEN month(exam) * 100 + day(exam) < month(birth) * 100 + day(birth) THEN 1 ELSE 0 END AS years FROM d)
SELECT l_orderkey, l_linenumber, CASE WHEN exam >= birth THEN lpad(CAST(least(years, 89) AS VARCHAR), 3, '0') || 'Y' END AS age FROM y
""")
def age_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    birth = F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), (F.col("l_partkey") % 40000).cast("int")), "yyyyMMdd")
    exam = F.date_format("l_shipdate", "yyyy.MM.dd")
    return d.select("l_orderkey", "l_linenumber", identity.age(identity.parsed_date(birth), identity.parsed_date(exam), POLICY).alias("age"))


AGE = "CASE o_orderkey % 5 WHEN 0 THEN '095Y' WHEN 1 THEN '95Y' WHEN 2 THEN '012M' WHEN 3 THEN '089Y' ELSE 'x' END"


@query(f"""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '089Y' ELSE {AGE} END AS compat, CASE WHEN o_orderkey % 5 IN (0, 1) THEN '089Y' ELSE {AGE} END AS hardened FROM orders
""")
def age_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.get(F.array(*map(F.lit, ["095Y", "95Y", "012M", "089Y", "x"])), (F.col("o_orderkey") % 5).cast("int"))
    return t(spark, sf_dir, "orders").select("o_orderkey", identity.capped_age(age, POLICY).alias("compat"), identity.capped_age(age, HARD).alias("hardened"))


@query(f"SELECT o_orderkey, {sql_uid(f"'test-key|' || o_custkey || '|' || {SQL_UID}")} AS uid FROM orders")
def uid_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", identity.remapped(study_uid(), F.col("o_custkey").cast("string"), POLICY).alias("uid"))


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) NOT IN (SELECT o_orderkey FROM orders)
""")
def uid_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices that refer to a study that isn't in the output; equal originals have equal replacements."""
    new = lambda c: identity.remapped(F.concat(F.lit("1.2."), c.cast("string")), None, POLICY)
    wanted = F.col("l_orderkey") + (F.col("l_linenumber") == 3).cast("int")
    refs = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", new(wanted).alias("uid"))
    return refs.join(t(spark, sf_dir, "orders").select(new(F.col("o_orderkey")).alias("uid")), "uid", "left_anti").select("l_orderkey", "l_linenumber")


UID_CASE = "CASE o_orderkey % 7 WHEN 0 THEN '1.02.' || o_orderkey WHEN 1 THEN '1.2.0' WHEN 2 THEN '' WHEN 3 THEN repeat('1', 65) WHEN 4 THEN '1..2' WHEN 5 THEN ' 1.2.' || o_orderkey || ' ' ELSE '1.2.' || o_custkey END"


@query(f"""
SELECT o_orderkey, trim({UID_CASE}) = '' OR (length(trim({UID_CASE})) <= 64 AND regexp_full_match(trim({UID_CASE}), '(0|[1-9][0-9]*)(\\.(0|[1-9][0-9]*))*')) AS valid FROM orders
""")
def uid_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = k.cast("string")
    uid = F.when(k % 7 == 0, F.concat(F.lit("1.02."), s)).when(k % 7 == 1, "1.2.0").when(k % 7 == 2, "").when(k % 7 == 3, "1" * 65).when(k % 7 == 4, "1..2").when(k % 7 == 5, F.concat(F.lit(" 1.2."), s, F.lit(" "))).otherwise(F.concat(F.lit("1.2."), F.col("o_custkey").cast("string")))
    return t(spark, sf_dir, "orders").select("o_orderkey", identity.uid_valid(uid).alias("valid"))


VALUE = "CASE c_custkey % 8 WHEN 0 THEN 'Anonymous^Anonymous' WHEN 1 THEN '--' WHEN 2 THEN 'Anonuevo' WHEN 3 THEN '' WHEN 4 THEN CAST(c_custkey AS VARCHAR) WHEN 5 THEN ' Removed ' ELSE c_name END"


@query(f"""
WITH v AS (SELECT c_custkey, lower(trim({VALUE})) AS s FROM customer),
w AS (SELECT c_custkey, s = '' OR s IN ('anonymous^anonymous', 'removed') OR regexp_full_match(s, '[\\^ \\-_.]*') OR s = CAST(c_custkey AS VARCHAR) AS known, starts_with(s, 'anon') AS anon FROM v)
SELECT c_custkey, known OR anon AS compat, known AS hardened FROM w
""")
def placeholder_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 8 == 0, "Anonymous^Anonymous").when(k % 8 == 1, "--").when(k % 8 == 2, "Anonuevo").when(k % 8 == 3, "").when(k % 8 == 4, k.cast("string")).when(k % 8 == 5, " Removed ").otherwise(F.col("c_name"))
    known = F.array(k.cast("string"))
    return t(spark, sf_dir, "customer").select("c_custkey", identity.placeholder(v, known).alias("compat"), identity.placeholder(v, known, hardened=True).alias("hardened"))


NUMBER = "CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'x' WHEN 3 THEN ' 12 ' ELSE CAST(l_partkey AS VARCHAR) END"
NUMBERED = f"SELECT *, CASE WHEN {NUMBER} IS NULL THEN 1 ELSE coalesce(TRY_CAST(trim({NUMBER}) AS BIGINT), 9223372036854775807) END AS number FROM lineitem"


def slices_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    v = F.when(line == 1, None).when(line == 2, "x").when(line == 3, " 12 ").otherwise(F.col("l_partkey").cast("string"))
    return t(spark, sf_dir, "lineitem").withColumn("number", text.instance_number(F.coalesce(v, F.lit("")), v.isNull()))


@query(f"SELECT l_orderkey, l_linenumber, number FROM ({NUMBERED})")
def instance_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys of slices: missing, blank, padded and unreadable numbers."""
    return slices_of(spark, sf_dir).select("l_orderkey", "l_linenumber", "number")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN TRY_CAST(trim(regexp_extract(v, '^[^\\\\,]*')) AS DOUBLE) > 0 THEN TRY_CAST(trim(regexp_extract(v, '^[^\\\\,]*')) AS DOUBLE) END AS spacing
FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN ' ' || l_partkey || '.5\\0.6' WHEN 1 THEN l_partkey || ',0.4' WHEN 2 THEN '-' || l_partkey || '\\1' ELSE 'x' END AS v FROM lineitem)
""")
def pixel_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First number of a pair by backslash or comma; null unless positive."""
    k = F.col("l_partkey").cast("string")
    v = F.element_at(F.array(F.concat(F.lit(" "), k, F.lit(".5\\0.6")), F.concat(k, F.lit(",0.4")), F.concat(F.lit("-"), k, F.lit("\\1")), F.lit("x")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.spacing(v).alias("spacing"))


@query(f"SELECT l_orderkey, l_linenumber, number, row_number() OVER (PARTITION BY l_orderkey ORDER BY number, l_linenumber) AS position FROM ({NUMBERED})")
def slice_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.numbered(slices_of(spark, sf_dir), ["l_orderkey"], ["number", "l_linenumber"]).select("l_orderkey", "l_linenumber", "number", "position")


@query(f"""
SELECT l_orderkey, l_linenumber, 'P' || l_orderkey || '_' || lpad(CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY number, l_linenumber) AS VARCHAR), 5, '0') || '.dcm' AS name FROM ({NUMBERED})
""")
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ordering.numbered(slices_of(spark, sf_dir), ["l_orderkey"], ["number", "l_linenumber"])
    return d.select("l_orderkey", "l_linenumber", ordering.output_name(F.concat(F.lit("P"), F.col("l_orderkey").cast("string")), F.col("position")).alias("name"))


@query(f"""
SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY number, l_linenumber) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM ({NUMBERED})) WHERE r = n // 2 + 1
""")
def middle_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.middle(ordering.numbered(slices_of(spark, sf_dir), ["l_orderkey"], ["number", "l_linenumber"])).select("l_orderkey", "l_linenumber")


@query("""
WITH d AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders),
r AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS a, dense_rank() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderpriority) AS b FROM d)
SELECT o_custkey, o_orderstatus || '/' || o_orderpriority AS rel_dir, 'P' || o_custkey || '_' || a || '/P' || o_custkey || '_' || b AS new_dir FROM r
""")
def subdir_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    dirs = o.select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("new_id"), F.col("o_custkey").alias("patient_old"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("rel_dir"))
    return ordering.renamed_folders(dealt(dirs, "patient_old"), dealt=True).select(F.col("patient_old").alias("o_custkey"), "rel_dir", "new_dir")


DEEP_LEVELS = ["o_orderstatus", "o_orderpriority", "substr(CAST(o_orderdate AS VARCHAR), 1, 4)", "substr(CAST(o_orderdate AS VARCHAR), 6, 2)", "CAST(o_orderkey % 7 AS VARCHAR)", "'Doe^Jane'"]


def _deep_sql() -> str:
    ranks = ", ".join(f"dense_rank() OVER (PARTITION BY k{''.join(f', p{j}' for j in range(i))} ORDER BY p{i}) AS r{i}" for i in range(len(DEEP_LEVELS)))
    parts = ", ".join(f"{x} AS p{i}" for i, x in enumerate(DEEP_LEVELS))
    join = lambda made: " || '/' || ".join(made(i) for i in range(len(DEEP_LEVELS)))
    new_name = lambda i: f"'P' || k || '_' || r{i}"
    return f"SELECT k AS o_custkey, {join(lambda i: f'p{i}')} AS rel_dir, {join(new_name)} AS new_dir FROM (SELECT *, {ranks} FROM (SELECT DISTINCT o_custkey AS k, {parts} FROM orders))"


@query(_deep_sql())
def subdir_rank_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six levels of folders, a name in the last: none of the original names is left."""
    levels = [F.expr(x.replace("VARCHAR", "STRING")) for x in DEEP_LEVELS]
    o = t(spark, sf_dir, "orders")
    dirs = o.select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("new_id"), F.col("o_custkey").alias("patient_old"), F.concat_ws("/", *levels).alias("rel_dir"))
    return ordering.renamed_folders(dealt(dirs, "patient_old"), dealt=True).select(F.col("patient_old").alias("o_custkey"), "rel_dir", "new_dir")


CONF = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE abs(value) - floor(abs(value)) END"


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.abs("value")
    return t(spark, sf_dir, "events").withColumn("conf", F.when(F.col("event_id") % 9 != 0, v - F.floor(v)))


@query(f"WITH e AS (SELECT event_id, {CONF} AS conf FROM events) SELECT event_id, conf FROM e WHERE conf IS NULL OR conf >= 0.2")
def hit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidences(spark, sf_dir).filter(geometry.confident(F.col("conf"), POLICY)).select("event_id", "conf")


@query(f"SELECT user_id, max({CONF}) AS best FROM events GROUP BY 1")
def best_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidences(spark, sf_dir).groupBy("user_id").agg(F.max("conf").alias("best"))


@query(f"""
WITH e AS (SELECT event_type, {CONF} AS conf FROM events)
SELECT event_type, count(conf) AS known, count(*) FILTER (conf IS NULL) AS unknown, min(conf) AS least, round(quantile_cont(conf, 0.1), 9) AS p10, round(quantile_cont(conf, 0.5), 9) AS median, max(conf) AS most FROM e GROUP BY 1
""")
def conf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reports.confidence_summary(confidences(spark, sf_dir), ["event_type"], "conf")
    return d.withColumn("p10", F.round("p10", 9)).withColumn("median", F.round("median", 9))


@query("SELECT event_id, round(least(greatest(exp(-abs(value) / 100), 0), 1), 9) AS conf FROM events")
def log_prob_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", F.round(text.probability(-F.abs("value") / 100), 9).alias("conf"))


OUTCOME = """
SELECT user_id, event_type <> 'error' AS want, event_type = 'purchase' AS has_text, event_type <> 'signup' AS has_image, event_type = 'view' AND event_id % 2 = 0 AS skipped,
       (event_id % 5)::INTEGER AS n_boxes, (event_id % 3)::INTEGER AS n_boxless, event_id % 50 = 0 AS failed FROM events
"""


def outcomes(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    k, e = F.col("event_id"), F.col("event_type")
    d = t(spark, sf_dir, "events").select("event_id", "user_id", (e != "error").alias("want"), (e == "purchase").alias("has_text"), (e != "signup").alias("has_image"), ((e == "view") & (k % 2 == 0)).alias("skipped"), (k % 5).cast("int").alias("n_boxes"), (k % 3).cast("int").alias("n_boxless"), (k % 50 == 0).alias("failed"))
    act, forced, _ = geometry.action(F.col("n_boxes"), F.col("n_boxless"), policy)
    d = d.withColumn("bucket", geometry.bucket(F.col("want"), F.col("has_text"), F.col("has_image"), F.col("skipped")))
    return d.withColumn("decision", F.when(F.col("has_text"), geometry.decision(act, F.col("n_boxes") + F.col("n_boxless") * 4, policy))).withColumn("forced", forced & F.col("has_text"))


DECIDED = f"""
SELECT *, CASE WHEN NOT want THEN 'not_examined' WHEN has_text THEN 'detected' WHEN NOT has_image THEN 'no_image' WHEN skipped THEN 'prescreen_skipped' ELSE 'clean' END AS bucket,
       CASE WHEN has_text THEN CASE WHEN n_boxes + n_boxless > 0 THEN 'REDACTED' ELSE 'UNMASKED' END END AS decision FROM ({OUTCOME})
"""


@query(f"""
SELECT user_id, count(*) AS n_in, count(*) FILTER (NOT failed) AS kept, count(*) FILTER (decision = 'REDACTED') AS redacted, count(*) FILTER (decision = 'DROPPED') AS dropped, count(*) FILTER (decision = 'UNMASKED') AS unmasked,
       count(*) FILTER (failed) AS errors, count(*) FILTER (bucket = 'detected') AS n_detected, count(*) FILTER (bucket = 'clean') AS n_clean, count(*) FILTER (bucket = 'prescreen_skipped') AS n_prescreen_skipped,
       count(*) FILTER (bucket = 'not_examined') AS n_not_examined, count(*) FILTER (bucket = 'no_image') AS n_no_image, true AS balanced, count(*) FILTER (NOT failed) = 0 AS empty_result
FROM ({DECIDED}) GROUP BY 1
""")
def series_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.series_accounting(outcomes(spark, sf_dir, POLICY), ["user_id"])


@query(f"SELECT bucket, decision, count(*) AS n FROM ({DECIDED}) GROUP BY 1, 2")
def outcome_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir, POLICY).groupBy("bucket", "decision").agg(F.count("*").alias("n"))


@query(f"""
SELECT CASE WHEN has_text THEN CASE WHEN n_boxless > 0 AND n_boxes = 0 THEN 'DROPPED' WHEN n_boxes + n_boxless > 0 THEN 'REDACTED' ELSE 'UNMASKED' END END AS decision, count(*) AS n FROM ({OUTCOME}) GROUP BY 1
""")
def drop_boxless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir, Policy(never_drop=False, boxless="drop")).groupBy("decision").agg(F.count("*").alias("n"))


@query("""
SELECT user_id, list_slice(list_sort(list(DISTINCT event_type)), 1, 3) AS names, greatest(count(DISTINCT event_type) - 3, 0) AS more FROM events GROUP BY 1
""")
def changed_tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    return d.select("user_id", F.slice("names", 1, 3).alias("names"), F.greatest(F.size("names") - 3, F.lit(0)).cast("long").alias("more"))


# boxes from line items: quantity and discount give corners, the image is 100 x 120
BOX = "SELECT l_orderkey, l_linenumber, l_quantity * 2 - 4.5 AS x0, l_quantity * 2 + l_linenumber * 1.25 - 4.5 AS x1, l_discount * 900 AS y0, l_discount * 900 + l_tax * 200 AS y1 FROM lineitem"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, line = F.col("l_quantity"), F.col("l_linenumber")
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q * 2 - 4.5).alias("x0"), (q * 2 + line * 1.25 - 4.5).alias("x1"), (F.col("l_discount") * 900).alias("y0"), (F.col("l_discount") * 900 + F.col("l_tax") * 200).alias("y1"))
    return d.withColumn("points", F.array(geometry.point(F.col("x0"), F.col("y0")), geometry.point(F.col("x1"), F.col("y0")), geometry.point(F.col("x1"), F.col("y1")), geometry.point(F.col("x0"), F.col("y1"))))


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, greatest(0, floor(x0))::INTEGER AS rx0, greatest(0, floor(y0))::INTEGER AS ry0, least(120, ceil(x1))::INTEGER AS rx1, least(100, ceil(y1))::INTEGER AS ry1 FROM ({BOX}))
SELECT * FROM r WHERE rx1 > rx0 AND ry1 > ry0
""")
def rects_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geometry.box_rect(F.col("points"), F.lit(100), F.lit(120), POLICY)
    d = boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", r.alias("r")).filter("r IS NOT NULL")
    return d.select("l_orderkey", "l_linenumber", *[F.col(f"r.{c}").alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])


@query(f"""
WITH p AS (SELECT *, greatest(6, 0.6 * greatest(1.0, y1 * 0.5 - y0 * 0.5)) AS pad FROM ({BOX})),
r AS (SELECT l_orderkey, l_linenumber, greatest(0, floor(x0 * 2 - pad))::INTEGER AS rx0, greatest(0, floor(y0 * 0.5 - pad))::INTEGER AS ry0, least(240, ceil(x1 * 2 + pad))::INTEGER AS rx1, least(50, ceil(y1 * 0.5 + pad))::INTEGER AS ry1 FROM p)
SELECT * FROM r WHERE rx1 > rx0 AND ry1 > ry0
""")
def rects_padded_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geometry.box_rect(F.col("points"), F.lit(50), F.lit(240), Policy(exact=False), F.lit(100), F.lit(120))
    d = boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", r.alias("r")).filter("r IS NOT NULL")
    return d.select("l_orderkey", "l_linenumber", *[F.col(f"r.{c}").alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])


@query(f"SELECT l_orderkey, l_linenumber FROM ({BOX}) WHERE least(x1 - x0, y1 - y0) >= 6")
def box_big_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).filter(geometry.big_enough(F.col("points"), POLICY)).select("l_orderkey", "l_linenumber")


@query(f"""
WITH c AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM ({BOX})) SELECT l_orderkey, l_linenumber FROM c WHERE cx <= 36 OR cx >= 84 OR cy <= 30 OR cy >= 70
""")
def box_in_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = boxes(spark, sf_dir)
    return d.filter(geometry.in_band((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.lit(100), F.lit(120), POLICY.border_share)).select("l_orderkey", "l_linenumber")


@query("""
WITH s AS (SELECT DISTINCT (p_size * 10 + 5)::INTEGER AS rows, (p_size * 7 + 3)::INTEGER AS cols FROM part),
b AS (SELECT *, greatest(1, least(round_even(cols * 0.18, 0)::INTEGER, cols // 2)) AS bx, greatest(1, least(round_even(rows * 0.18, 0)::INTEGER, rows // 2)) AS bh FROM s)
SELECT rows, cols, [0, 0, cols, bh, 0, rows - bh, cols, rows, 0, 0, bx, rows, cols - bx, 0, cols, rows] AS corners FROM b
""")
def border_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "part").select((F.col("p_size") * 10 + 5).cast("int").alias("rows"), (F.col("p_size") * 7 + 3).cast("int").alias("cols")).distinct()
    four = geometry.border_band(F.col("rows"), F.col("cols"), POLICY)
    return d.select("rows", "cols", F.flatten(F.transform(four, lambda r: F.array(r.x0, r.y0, r.x1, r.y1))).alias("corners"))


@query(f"""
WITH c AS (SELECT l_orderkey, l_linenumber, x0 AS a0, y0 AS b0, x1 AS a1, y1 AS b1, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM ({BOX}))
SELECT l_orderkey, l_linenumber, cx <= 36 OR cx >= 84 OR cy <= 30 OR cy >= 70 OR (a0 < 60 + 60 AND a1 > 50 - 60 AND b0 < 45 + 60 AND b1 > 40 - 60) AS relevant,
       a0 < 60 AND a1 > 50 AND b0 < 45 AND b1 > 40 AS overlaps FROM c
""")
def rect_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("x0", "y0", "x1", "y1")
    seed = geometry.rect(F.lit(50), F.lit(40), F.lit(60), F.lit(45))
    d = boxes(spark, sf_dir).withColumn("line", line).withColumn("seed", seed)
    rel = geometry.relevant(F.col("line"), F.array("seed"), F.lit(100), F.lit(120), POLICY)
    return d.select("l_orderkey", "l_linenumber", rel.alias("relevant"), geometry.near(F.col("line"), F.col("seed"), 0.0).alias("overlaps"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN [l_quantity, 1.0, l_tax, 1.0, l_tax, 2.0, l_quantity, 2.0] WHEN 1 THEN [0.0, l_quantity, 5.0, l_quantity, 5.0, 9.0, 0.0, 9.0, 1.0, 1.0] END AS xy FROM lineitem
""")
def coerce_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, x, f = F.col("l_quantity"), F.col("l_tax"), lambda v: F.lit(float(v))
    numbers = F.when(F.col("l_linenumber") % 4 == 0, F.array(q, f(1), x, f(2))).when(F.col("l_linenumber") % 4 == 1, F.array(f(0), q, f(5), q, f(5), f(9), f(0), f(9), f(1), f(1))).otherwise(F.array(q, q, q, q, q, q))
    points = geometry.coerced_points(numbers)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.flatten(F.transform(points, lambda p: F.array(p.x, p.y))).alias("xy"))


SPACING = "CASE p_size % 5 WHEN 0 THEN '0.5' || chr(92) || '0.6' WHEN 1 THEN ' 0.43,0.43' WHEN 2 THEN '-1' WHEN 3 THEN 'x' ELSE CAST(p_size / 40.0 AS VARCHAR) END"


@query(f"""
WITH s AS (SELECT p_partkey, TRY_CAST(trim(regexp_split_to_array({SPACING}, '[\\\\,]')[1]) AS DOUBLE) AS v FROM part),
p AS (SELECT p_partkey, CASE WHEN v > 0 THEN v END AS spacing FROM s)
SELECT p_partkey, spacing, (CASE WHEN spacing IS NULL THEN 50 ELSE greatest(1, least(ceil(50 / spacing), 999)) END)::INTEGER AS lo, (CASE WHEN spacing IS NULL THEN 60 ELSE greatest(1, least(ceil(60 / spacing), 999)) END)::INTEGER AS hi FROM p
""")
def kernel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    v = F.when(n % 5 == 0, "0.5\\0.6").when(n % 5 == 1, " 0.43,0.43").when(n % 5 == 2, "-1").when(n % 5 == 3, "x").otherwise((n / 40.0).cast("string"))
    d = t(spark, sf_dir, "part").select("p_partkey", text.spacing(v).alias("spacing"))
    lo, hi = raster.kernel_bounds(F.col("spacing"), POLICY.kernel_mm)
    return d.select("p_partkey", "spacing", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


@query("""
SELECT n_nationkey, CASE WHEN a >= b THEN 0 ELSE 1 END AS axis, CASE WHEN CASE WHEN a >= b THEN -r ELSE -c END > 0 THEN 1 ELSE -1 END AS sign
FROM (SELECT n_nationkey, (n_nationkey - 12) / 12.0 AS r, (n_nationkey % 5 - 2) / 2.0 AS c, abs((n_nationkey - 12) / 12.0) AS a, abs((n_nationkey % 5 - 2) / 2.0) AS b FROM nation)
""")
def anterior_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, f = F.col("n_nationkey"), lambda v: F.lit(float(v))
    axis, sign = raster.anterior(F.array(f(1), (k - 12) / 12.0, f(0), f(0), (k % 5 - 2) / 2.0, f(1)))
    return t(spark, sf_dir, "nation").select("n_nationkey", axis.alias("axis"), sign.alias("sign"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by hour; the same function counts on streams, with a watermark."""
    return ingest.windowed_actions(t(spark, sf_dir, "events").withColumnRenamed("event_type", "action"), "ts")


@query("""
SELECT o_custkey, max(o_orderkey) FILTER (o_orderkey % 3 <> 0) AS best, string_agg(CAST(o_orderkey AS VARCHAR), ' | ' ORDER BY o_orderkey) AS hits FROM orders GROUP BY 1
""")
def best_and_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best known value and joined texts of a group, unknown values ignored."""
    d = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))).alias("best"), F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return d.select("o_custkey", "best", text.joined_hits(F.transform("k", lambda x: x.cast("string"))).alias("hits"))
