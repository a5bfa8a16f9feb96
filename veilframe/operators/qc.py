"""Quality control of rewritten elements: thirteen kinds of findings from one pass and two joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import Policy
from veilframe.functions import cohort, identity
from veilframe.functions.text import strip, tag_label
from veilframe.rules import ABSENT_TAGS, EMPTY_TAGS, FILE_META_TAGS, ICON_SEQUENCE, NEVER_REMAPPED, TYPE1_REFERENCES


def names(table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("tag"))


def finding(test: Column, kind: str, name: Column, detail: Column) -> Column:
    return F.when(test, F.struct(F.lit(kind).alias("finding"), F.col("tag").alias("tag"), name.alias("name"), F.substring(detail, 1, 120).alias("detail")))


#: Declarations that every file must have.
NEEDED = {"00120062": "PatientIdentityRemoved", "00120064": "DeidentificationMethodCodeSequence", "00280303": "LongitudinalTemporalInformationModified"}
EVENT = "array<struct<finding: string, tag: string, name: string, detail: string, said: string>>"


def element_findings(elements: DataFrame, instances: DataFrame, policy: Policy) -> DataFrame:
    """instance_id, finding, tag, name, detail of single elements, missing declarations and preambles.

    One pass over the elements leaves what may be a finding, with the ids and declarations of the instance as marks
    ("=id", "=declared", "=instance"); these few rows meet by instance, where values that are known ids go.
    """
    data, meta = F.col("scope") == "dataset", F.col("scope") == "file_meta"
    root, deep = data & (F.col("depth") == 0), data & (F.col("depth") <= policy.max_depth)
    tag, vr, grp = F.col("tag"), F.col("vr"), F.col("grp")
    value = F.coalesce(F.array_join("value", "\\"), F.lit(""))
    private, overlay, curve = cohort.is_private(grp), cohort.in_overlay_groups(grp), cohort.is_curve(grp)
    bad_uid = F.filter(F.when((vr == "UI") & ~tag.isin(*NEVER_REMAPPED), F.col("value")), lambda v: ~identity.uid_valid(v))
    each = lambda test, kind, name: F.transform(F.when(test, bad_uid), lambda v: F.struct(F.lit(kind).alias("finding"), tag.alias("tag"), F.lit(name).alias("name"), F.substring(v, 1, 120).alias("detail")))
    single = F.array(
        finding(root & tag.isin(*ABSENT_TAGS), "tag_not_removed", names(ABSENT_TAGS), value),
        finding(root & tag.isin(*EMPTY_TAGS) & ~identity.placeholder(value, None, policy.hardened), "value_not_removed", names(EMPTY_TAGS), value),
        # of these four one at most fires
        finding(deep & private, "private_tag_present", F.lit("private"), vr),
        finding(deep & ~private & overlay, "overlay_present", F.lit("overlay"), vr),
        finding(deep & ~private & ~overlay & curve, "curve_present", F.lit("curve"), vr),
        finding(deep & ~private & ~overlay & ~curve & (tag == ICON_SEQUENCE), "icon_image_present", F.lit("IconImageSequence"), F.lit("SQ")),
        finding(data & F.col("depth").between(1, policy.max_depth + 1) & tag.isin(*TYPE1_REFERENCES) & (strip(value) == ""), "empty_type1_reference", names(TYPE1_REFERENCES), F.lit("")),
        finding(meta & tag.isin(*FILE_META_TAGS), "file_meta_not_removed", names(FILE_META_TAGS), value),
    )
    empty = F.array().cast("array<struct<finding: string, tag: string, name: string, detail: string>>")
    found = F.concat(F.filter(single, lambda x: x.isNotNull()), F.coalesce(each(deep, "invalid_uid", "UID"), empty), F.coalesce(each(meta, "invalid_uid_file_meta", "file_meta UID"), empty))
    mark = lambda test, kind, said: F.when(test, F.struct(F.lit(kind).alias("finding"), tag.alias("tag"), F.lit("").alias("name"), F.lit("").alias("detail"), said.alias("said")))
    declared = (tag != "00120062") | (F.upper(F.coalesce(F.array_join("value", ""), F.lit(""))) == "YES")
    marks = F.array(
        mark(root & tag.isin("00100020", "00200010"), "=id", F.lower(strip(F.get("value", F.lit(0))))),
        mark(root & tag.isin(*NEEDED) & declared, "=declared", tag),
    )
    whole = F.lower(strip(value))
    found = F.transform(found, lambda f: f.withField("said", F.when(f.finding == "value_not_removed", whole)))
    here = elements.select("instance_id", F.explode(F.concat(found, F.filter(marks, lambda x: x.isNotNull()))).alias("f"))
    there = F.array(F.struct(F.lit("=instance").alias("finding"), F.lit("").alias("tag"), F.lit("").alias("name"), F.lit("").alias("detail"), F.lit(None).cast("string").alias("said")))
    if policy.zero_preamble and "preamble" in instances.columns:
        # every byte is a character of this encoding
        n = F.length(F.replace(F.decode("preamble", "ISO-8859-1"), F.lit("\x00"), F.lit("")))
        bad = F.struct(F.lit("preamble_not_zeroed").alias("finding"), F.lit("").alias("tag"), F.lit("128-byte preamble").alias("name"), F.format_string("%d non-zero byte(s)", n).alias("detail"), F.lit(None).cast("string").alias("said"))
        there = F.concat(there, F.when(n > 0, F.array(bad)).otherwise(F.array().cast(EVENT)))
    d = here.unionByName(instances.select("instance_id", F.explode(there).alias("f"))).groupBy("instance_id").agg(F.collect_list("f").alias("all"))
    of = lambda kind: F.transform(F.filter("all", lambda f: f.finding == kind), lambda f: f.said)
    d = d.select("instance_id", "all", of("=id").alias("known"), of("=declared").alias("declared"), F.exists("all", lambda f: f.finding == "=instance").alias("listed"))
    missing = F.array(*[F.struct(F.lit("missing_declaration").alias("finding"), F.lit(t).alias("tag"), F.lit(n).alias("name"), F.lit("").alias("detail"), F.lit(None).cast("string").alias("said")) for t, n in NEEDED.items()])
    missing = F.when(F.col("listed"), F.filter(missing, lambda m: ~F.array_contains(F.col("declared"), m.tag))).otherwise(F.array().cast(EVENT))
    kept = F.filter("all", lambda f: ~f.finding.startswith("=") & (f.said.isNull() | ~F.coalesce(F.array_contains(F.col("known"), f.said), F.lit(False))))
    d = d.select("instance_id", F.explode(F.concat(kept, missing)).alias("f"))
    return d.select("instance_id", "f.finding", "f.tag", "f.name", "f.detail")


def produced_instances(elements: DataFrame) -> DataFrame:
    """patient, uid of the SOP instances in ``elements``, those of the published files."""
    own = elements.filter((F.col("scope") == "dataset") & (F.col("depth") == 0) & (F.col("tag") == "00080018"))
    return own.select("patient", F.explode("value").alias("uid"))


def unresolved_references(elements: DataFrame, produced: DataFrame) -> DataFrame:
    """References to instances that the patient's output doesn't hold; ``produced`` has patient, uid."""
    refs = elements.filter((F.col("scope") == "dataset") & (F.col("depth") >= 1) & (F.col("tag") == "00081155")).select("instance_id", "patient", "tag", strip(F.get("value", F.lit(0))).alias("uid")).filter("uid <> ''")
    return refs.join(produced.select("patient", "uid").distinct(), ["patient", "uid"], "left_anti").select("instance_id", F.lit("unresolved_reference").alias("finding"), "tag", F.lit("ReferencedSOPInstanceUID").alias("name"), F.substring("uid", 1, 120).alias("detail"))


def findings(elements: DataFrame, instances: DataFrame, produced: DataFrame, policy: Policy) -> DataFrame:
    """All findings; tags as (GGGG,EEEE)."""
    out = element_findings(elements, instances, policy).unionByName(unresolved_references(elements, produced))
    return out.withColumn("tag", F.when(F.col("tag") == "", F.col("tag")).otherwise(tag_label(F.col("tag"))))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("finding").count()
