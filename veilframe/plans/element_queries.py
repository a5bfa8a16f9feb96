"""The element rewriting engine on synthetic headers: one header for each customer, with nested sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import Policy
from veilframe.functions import cohort, identity
from veilframe.operators import elements, qc
from veilframe.plans.registry import dealt, query, sql_uid, t
from veilframe.rules import ABSENT_TAGS, policy_rules

POLICY = Policy(uid_key="k")

#: (tag, vr, item path, SQL of the value), with k the customer's number and n the name.  Paths nest by "/TAG[i]".
HEADER = [
    ("00080016", "UI", "", "'1.2.840.10008.5.1.4.1.1.2'"),
    ("00080018", "UI", "", "'1.9.' || k"),
    ("00080020", "DA", "", "'20100615'"),
    ("0008002A", "DT", "", "'20130605142311.123'"),
    ("00080031", "TM", "", "'101500'"),
    ("00080080", "LO", "", "'Site ' || n"),
    ("00081030", "LO", "", "'Head ' || n"),
    ("00080201", "SH", "", "'+0100'"),
    ("00091001", "LO", "", "'private ' || n"),
    ("00100010", "PN", "", "n"),
    ("00100020", "LO", "", "'ID' || k"),
    ("00100030", "DA", "", "'19500616'"),
    ("00102160", "SH", "", "'group'"),
    ("00102180", "SH", "", "'trade'"),
    ("00181012", "DA", "", "'20111111'"),
    ("0020000D", "UI", "", "'1.8.' || k"),
    ("00200052", "UI", "", "'1.02.' || k"),
    ("00204000", "LT", "", "'comment ' || n"),
    ("00321032", "PN", "", "n"),
    ("00400010", "SH", "", "'station'"),
    ("00400241", "AE", "", "'AE'"),
    ("50000010", "US", "", "'1'"),
    ("60000010", "US", "", "'512'"),
    ("00880200", "SQ", "", "'1'"),
    ("00280010", "US", "/00880200[0]", "'64'"),
    ("00081140", "SQ", "", "'3'"),
    ("00081150", "UI", "/00081140[0]", "'1.2.840.10008.5.1.4.1.1.2'"),
    ("00081155", "UI", "/00081140[0]", "'1.9.' || k"),
    ("00081150", "UI", "/00081140[1]", "''"),
    ("00081155", "UI", "/00081140[1]", "''"),
    ("00081150", "UI", "/00081140[2]", "'1.2.840.10008.5.1.4.1.1.2'"),
    ("00081155", "UI", "/00081140[2]", "'1.9.9.' || k"),
    ("00082112", "SQ", "", "'1'"),
    ("00081155", "UI", "/00082112[0]", "''"),
    ("0040A730", "SQ", "", "'1'"),
    ("0040A121", "DA", "/0040A730[0]", "'20150505'"),
    ("0040A123", "PN", "/0040A730[0]", "n"),
    ("0040A730", "SQ", "/0040A730[0]", "'1'"),
    ("00200052", "UI", "/0040A730[0]/0040A730[0]", "'1.7.' || k"),
    ("00321064", "SQ", "/0040A730[0]", "'1'"),
    ("00080100", "SH", "/0040A730[0]/00321064[0]", "'X'"),
    ("04000561", "SQ", "", "'1'"),
    ("00100010", "PN", "/04000561[0]", "n"),
]
META = [("00020002", "UI", "'1.2.840.10008.5.1.4.1.1.2'"), ("00020003", "UI", "'1.9.' || k"), ("00020010", "UI", "'1.2.840.10008.1.2.1'"), ("00020012", "UI", "'1.02.' || k"), ("00020016", "AE", "'SITE'")]


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n of all customers, dealt by k before they explode into elements: few bytes, much work."""
    return dealt(t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("n")), "k", piece=1 << 20)


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element rows of all customers, dealt by instance; every tenth has no PatientID."""
    def row(scope: str, tag: str, vr: str, path: str, value: str) -> str:
        steps = path.split("/")[1:]
        tags = ", ".join(f"'{s.partition('[')[0]}'" for s in steps)
        items = ", ".join(f"'/{'/'.join(steps[: i + 1])}'" for i in range(len(steps)))
        arr = lambda s: f"cast(array({s}) AS array<string>)"
        text, _, column = value.rpartition(" || ") if value[-1] in "kn" else (value, "", "")
        return f"named_struct('scope', '{scope}', 'depth', {len(steps)}, 'item_path', '{path}', 'ancestor_tags', {arr(tags)}, 'ancestor_items', {arr(items)}, 'tag', '{tag}', 'vr', '{vr}', 'text', {text or repr('')}, 'column', '{column}', 'grp', {int(tag[:4], 16)}, 'elem', {int(tag[4:], 16)})"

    rows = [row("dataset", tag, vr, path, v) for tag, vr, path, v in HEADER] + [row("file_meta", tag, vr, "", v) for tag, vr, v in META]
    # the array is a constant, made once and not for every customer; its texts are completed after the explosion
    d = people(spark, sf_dir).select("k", "n", F.explode(F.expr(f"array({', '.join(rows)})")).alias("e"))
    value = F.array(F.when(F.col("e.column") == "k", F.concat("e.text", "k")).when(F.col("e.column") == "n", F.concat("e.text", "n")).otherwise(F.col("e.text")))
    fields = [F.col(f"e.{c}") for c in ("scope", "depth", "item_path", "ancestor_tags", "ancestor_items", "tag", "vr")]
    d = d.select(F.col("k").alias("instance_id"), F.col("k").alias("patient"), F.concat(F.lit("P"), "k").alias("new_id"), *fields, value.alias("value"), F.col("e.grp"), F.col("e.elem"))
    return d.filter("NOT (tag = '00100020' AND depth = 0 AND instance_id % 10 = 0)")


def uid(text: str) -> str:
    return sql_uid(f"'k|' || k || '|' || {text}")


#: What rewriting must leave: (scope, item path, tag, vr, SQL of the value).
EXPECTED = [
    ("dataset", "", "00080016", "UI", "'1.2.840.10008.5.1.4.1.1.2'"),
    ("dataset", "", "00080018", "UI", uid("'1.9.' || k")),
    ("dataset", "", "00080020", "DA", "'20000101'"),
    ("dataset", "", "0008002A", "DT", "'20000101142311.123'"),
    ("dataset", "", "00080031", "TM", "'000000.00'"),
    ("dataset", "", "00080050", "SH", "'P' || k"),
    ("dataset", "", "00080080", "LO", "''"),
    ("dataset", "", "00081030", "LO", "''"),
    ("dataset", "", "00080201", "SH", "'anonymous'"),
    ("dataset", "", "00100010", "PN", "'Anonymous^Anonymous'"),
    ("dataset", "", "00100020", "LO", "'P' || k"),
    ("dataset", "", "00100030", "DA", "'20000101'"),
    ("dataset", "", "00101010", "AS", "'059Y'"),
    ("dataset", "", "00102160", "SH", "'group'"),
    ("dataset", "", "00181012", "DA", "'20000101'"),
    ("dataset", "", "0020000D", "UI", uid("'1.8.' || k")),
    ("dataset", "", "00200052", "UI", uid("'1.02.' || k")),
    ("dataset", "", "00204000", "LT", "''"),
    ("dataset", "", "00081140", "SQ", "'2'"),
    ("dataset", "/00081140[0]", "00081150", "UI", "'1.2.840.10008.5.1.4.1.1.2'"),
    ("dataset", "/00081140[0]", "00081155", "UI", uid("'1.9.' || k")),
    ("dataset", "/00081140[2]", "00081150", "UI", "'1.2.840.10008.5.1.4.1.1.2'"),
    ("dataset", "/00081140[2]", "00081155", "UI", uid("'1.9.9.' || k")),
    ("dataset", "", "0040A730", "SQ", "'1'"),
    ("dataset", "/0040A730[0]", "0040A121", "DA", "'20000101'"),
    ("dataset", "/0040A730[0]", "0040A123", "PN", "'Anonymous^Anonymous'"),
    ("dataset", "/0040A730[0]", "0040A730", "SQ", "'1'"),
    ("dataset", "/0040A730[0]/0040A730[0]", "00200052", "UI", uid("'1.7.' || k")),
    ("dataset", "", "04000561", "SQ", "'1'"),
    ("dataset", "/04000561[0]", "00100010", "PN", "'Anonymous^Anonymous'"),
    ("dataset", "", "00120062", "CS", "'YES'"),
    ("dataset", "", "00120063", "LO", f"'{POLICY.method}'"),
    ("dataset", "", "00120064", "SQ", "'5'"),
    *[("dataset", f"/00120064[{i}]", tag, vr, f"'{v}'") for i, (code, meaning) in enumerate(elements.PROFILE_CODES) for tag, vr, v in (("00080100", "SH", code), ("00080102", "SH", "DCM"), ("00080104", "LO", meaning))],
    ("dataset", "", "00280303", "CS", "'REMOVED'"),
    ("file_meta", "", "00020002", "UI", "'1.2.840.10008.5.1.4.1.1.2'"),
    ("file_meta", "", "00020003", "UI", uid("'1.9.' || k")),
    ("file_meta", "", "00020010", "UI", "'1.2.840.10008.1.2.1'"),
    ("file_meta", "", "00020012", "UI", uid("'1.02.' || k")),
]
WHO = "(SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS n FROM customer)"
HEADER_SQL = " UNION ALL ".join(f"SELECT k, n, '{tag}' AS tag, '{vr}' AS vr, '{path}' AS item_path, {v} AS value FROM {WHO}" for tag, vr, path, v in HEADER)


@query(" UNION ALL ".join(f"SELECT k AS instance_id, '{s}' AS scope, '{p}' AS item_path, '{tag}' AS tag, '{vr}' AS vr, {v} AS value FROM {WHO}" for s, p, tag, vr, v in EXPECTED))
def element_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on whole headers: what is left, tag by tag."""
    out, _ = elements.rewrite(header_rows(spark, sf_dir), POLICY, dealt=True)
    return out.select("instance_id", "scope", "item_path", "tag", "vr", F.array_join("value", "\\").alias("value"))


COUNTS = {"private": 1, "curve": 1, "overlay": 1, "extra_identifier": 2, "order_entry": 3, "icon": 1, "descriptor_blanked": 3, "date": 5, "uid_fixed": 1, "file_meta": 1}


@query(" UNION ALL ".join(f"SELECT '{a}' AS action, {n} * count(*) AS n FROM customer" for a, n in COUNTS.items() if n))
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each action was taken."""
    _, marked = elements.rewrite(header_rows(spark, sf_dir), POLICY, dealt=True)
    return elements.action_counts(marked).groupBy("action").agg(F.sum("count").alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS patient, 5::BIGINT AS changes, ['AcquisitionDateTime', 'Date', 'DateOfSecondaryCapture', 'SeriesTime', 'StudyDate'] AS names FROM customer")
def changed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that the sweep changed after the listed ones, with their names."""
    _, marked = elements.rewrite(header_rows(spark, sf_dir), POLICY, dealt=True)
    return elements.changed_dates(marked).select("patient", "changes", "names")


@query(f"SELECT k AS instance_id, tag, CASE WHEN tag = '00100010' THEN 'Anonymous^Anonymous' WHEN tag = '00100020' THEN 'P' || k WHEN tag = '00100030' THEN '20000101' WHEN tag IN ('00080018', '0020000D', '00200052') THEN {uid('value')} WHEN tag = '00321032' THEN 'Anonymous^Anonymous' WHEN tag IN ('00080201', '00400010') THEN 'anonymous' ELSE value END AS value FROM ({HEADER_SQL}) WHERE item_path = '' AND tag IN ('00100010', '00100020', '00100030', '00080018', '0020000D', '00200052', '00080201', '00400010', '00321032') AND NOT (tag = '00100020' AND CAST(k AS INTEGER) % 10 = 0)")
def dummy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = header_rows(spark, sf_dir).filter((F.col("depth") == 0) & (F.col("scope") == "dataset") & F.col("tag").isin("00100010", "00100020", "00100030", "00080018", "0020000D", "00200052", "00080201", "00400010", "00321032"))
    return d.select("instance_id", "tag", identity.dummy_by_type(F.col("tag"), F.col("vr"), F.get("value", F.lit(0)), F.col("new_id"), F.col("patient"), POLICY).alias("value"))


@query(f"SELECT k AS instance_id, tag, item_path FROM ({HEADER_SQL}) WHERE NOT (tag IN ('00091001', '50000010')) AND NOT (tag = '60000010')  AND tag NOT IN ('00102180', '00400241', '00400010', '00321032') AND NOT (tag = '00880200' OR starts_with(item_path, '/00880200')) AND NOT (tag = '00321064' OR contains(item_path, '00321064')) AND NOT (tag = '00100020' AND CAST(k AS INTEGER) % 10 = 0)")
def drop_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion of private, curve, overlay, identifier, order-entry and icon elements with all inside them."""
    d = elements.labelled(header_rows(spark, sf_dir), POLICY)
    return d.filter("action IS NULL AND scope = 'dataset'").select("instance_id", "tag", "item_path")


@query(f"SELECT k AS instance_id, tag FROM ({HEADER_SQL}) WHERE tag IN ('00080080', '00081030', '00204000')")
def blank_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.labelled(header_rows(spark, sf_dir), POLICY).filter("blanked").select("instance_id", "tag")


@query(f"SELECT k AS instance_id, tag, item_path, CASE WHEN tag = '00081140' THEN '2' ELSE value END AS value FROM ({HEADER_SQL}) WHERE (tag = '00081140' OR item_path IN ('/00081140[0]', '/00081140[2]'))")
def drop_dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a value go with their items; a sequence that lost all its items goes too."""
    d = elements.without_dangling(header_rows(spark, sf_dir).filter("scope = 'dataset'"), POLICY)
    refs = F.col("tag").isin("00081140", "00082112") | F.col("item_path").rlike("^/0008(1140|2112)")
    return d.filter(refs).select("instance_id", "tag", "item_path", F.get("value", F.lit(0)).alias("value"))


@query("""
SELECT l_orderkey, l_linenumber, g % 2 = 1 AS private, g BETWEEN 24576 AND 24606 AND g % 2 = 0 AS overlay, g BETWEEN 24576 AND 24606 AS overlay_group, (g & 65280) = 20480 AS curve
FROM (SELECT l_orderkey, l_linenumber, (CASE l_linenumber % 3 WHEN 0 THEN 20480 + l_partkey % 300 WHEN 1 THEN 24570 + l_partkey % 50 ELSE l_partkey % 65536 END)::INTEGER AS g FROM lineitem)
""")
def private_overlay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("l_partkey"), F.col("l_linenumber")
    d = t(spark, sf_dir, "lineitem").withColumn("g", F.when(line % 3 == 0, 20480 + k % 300).when(line % 3 == 1, 24570 + k % 50).otherwise(k % 65536).cast("int"))
    g = F.col("g")
    return d.select("l_orderkey", "l_linenumber", cohort.is_private(g).alias("private"), cohort.is_overlay(g).alias("overlay"), cohort.in_overlay_groups(g).alias("overlay_group"), cohort.is_curve(g).alias("curve"))


#: Findings on headers that weren't rewritten: (kind, tag, name, SQL of the detail).
RAW = [
    ("tag_not_removed", "(0010,2180)", "Occupation", "'trade'"), ("tag_not_removed", "(0032,1032)", "RequestingPhysician", "n"), ("tag_not_removed", "(0040,0010)", "ScheduledStationName", "'station'"), ("tag_not_removed", "(0040,0241)", "PerformedStationAETitle", "'AE'"),
    ("value_not_removed", "(0008,0080)", "InstitutionName", "'Site ' || n"), ("value_not_removed", "(0010,0010)", "PatientName", "n"),
    ("private_tag_present", "(0009,1001)", "private", "'LO'"), ("overlay_present", "(6000,0010)", "overlay", "'US'"), ("curve_present", "(5000,0010)", "curve", "'US'"), ("icon_image_present", "(0088,0200)", "IconImageSequence", "'SQ'"),
    ("invalid_uid", "(0020,0052)", "UID", "'1.02.' || k"), ("empty_type1_reference", "(0008,1150)", "ReferencedSOPClassUID", "''"), ("empty_type1_reference", "(0008,1155)", "ReferencedSOPInstanceUID", "''"), ("empty_type1_reference", "(0008,1155)", "ReferencedSOPInstanceUID", "''"),
    ("invalid_uid_file_meta", "(0002,0012)", "file_meta UID", "'1.02.' || k"), ("unresolved_reference", "(0008,1155)", "ReferencedSOPInstanceUID", "'1.9.9.' || k"),
    ("missing_declaration", "(0012,0062)", "PatientIdentityRemoved", "''"), ("missing_declaration", "(0012,0064)", "DeidentificationMethodCodeSequence", "''"), ("missing_declaration", "(0028,0303)", "LongitudinalTemporalInformationModified", "''"),
    ("file_meta_not_removed", "(0002,0016)", "SourceApplicationEntityTitle", "'SITE'"), ("preamble_not_zeroed", "", "128-byte preamble", "'3 non-zero byte(s)'"),
]


def found(spark: SparkSession, sf_dir: str, rewritten: bool) -> DataFrame:
    rows = header_rows(spark, sf_dir)
    if rewritten:
        rows, _ = elements.rewrite(rows, POLICY, dealt=True)
    preamble = F.lit(b"\x00" * 128) if rewritten else F.lit(b"II*" + b"\x00" * 125)
    instances = people(spark, sf_dir).select(F.col("k").alias("instance_id"), preamble.alias("preamble"))
    return qc.findings(rows, instances, qc.produced_instances(rows), POLICY)


@query(" UNION ALL ".join(f"SELECT k AS instance_id, '{f}' AS finding, '{tag}' AS tag, '{name}' AS name, {d} AS detail FROM {WHO}" for f, tag, name, d in RAW))
def qc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all kinds on headers as they came."""
    return found(spark, sf_dir, rewritten=False).select("instance_id", "finding", "tag", "name", "detail")


@query(" UNION ALL ".join(f"SELECT '{f}' AS finding, {sum(r[0] == f for r in RAW)} * count(*) AS count FROM customer" for f in dict.fromkeys(r[0] for r in RAW)))
def qc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.counts(found(spark, sf_dir, rewritten=False))


@query("SELECT 'unresolved_reference' AS finding, count(*) AS count FROM customer HAVING count(*) > 0")
def qc_after_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten headers have no findings but the reference to an instance that isn't there."""
    return qc.counts(found(spark, sf_dir, rewritten=True))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS instance_id, u.tag, u.value FROM customer, (SELECT unnest(['00080050', '00100010', '00100020', '00120062', '00120063', '00120064', '00280303']) AS tag, unnest(['', 'Anonymous^Anonymous', '', 'YES', '""" + POLICY.method + """', '5', 'REMOVED']) AS value) u WHERE u.tag IN ('00120062', '00120063', '00120064', '00280303', '00100010')
UNION ALL SELECT CAST(c_custkey AS VARCHAR), tag, 'P' || c_custkey FROM customer, (SELECT unnest(['00080050', '00100020']) AS tag)
""")
def upsert_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and declarations are there once, whether the header had them or not."""
    out, _ = elements.rewrite(header_rows(spark, sf_dir), POLICY, dealt=True)
    wanted = ["00080050", "00100010", "00100020", "00120062", "00120063", "00120064", "00280303"]
    return out.filter((F.col("depth") == 0) & F.col("tag").isin(*wanted)).select("instance_id", "tag", F.get("value", F.lit(0)).alias("value"))


@query(f"SELECT {len(ABSENT_TAGS)}::BIGINT AS n, 106::BIGINT AS n_dummy, 34::BIGINT AS n_blank")
def rule_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the rule tables; the deletion tables' union is distinct."""
    r = policy_rules(spark)
    n = lambda a: F.count_distinct(F.when(F.col("action").isin(*a), F.col("tag")))
    return r.agg(n(["delete_order_entry", "delete_extra"]).alias("n"), n(["dummy"]).alias("n_dummy"), n(["blank"]).alias("n_blank"))
