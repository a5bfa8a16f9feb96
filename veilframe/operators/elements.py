"""Rewriting of header elements: one row-local pass, then upserts keyed by instance.

Nesting is flattened (``ancestor_tags``, ``ancestor_items``), so deleting a sequence deletes its descendants by a test on
the row itself.  The order of stages shows only in which action wins; ``labelled`` spells that order out as one CASE.
Rows of a sequence carry the number of its items as their value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import PERSON_DUMMY, Policy
from veilframe.functions import cohort, identity
from veilframe.functions.text import strip, tag_label
from veilframe.rules import DATE_TAGS, DESCRIPTOR_TAGS, DUMMY_TAGS, ETHNIC_GROUP, EXTRA_TAGS, FILE_META_TAGS, HARDENED_SEQUENCES, ICON_SEQUENCE, NEVER_REMAPPED, ORDER_ENTRY_TAGS, PROFILE_CODES, TYPE1_REFERENCES

def is_root() -> Column:
    return (F.col("scope") == "dataset") & (F.col("depth") == 0)


def group_of(tag: Column) -> Column:
    return F.conv(F.substring(tag, 1, 4), 16, 10).cast("int")


def deletions(policy: Policy, root: bool = False) -> list[tuple[str, Column]]:
    """(action, condition on the row itself or its ancestors) in the order in which they win; ``root``: for rows without ancestors."""

    def self_or_ancestor(test) -> Column:
        return test(F.col("tag")) if root else test(F.col("tag")) | F.exists("ancestor_tags", test)

    sq = F.col("vr") == "SQ"
    extra = [*EXTRA_TAGS, *[ETHNIC_GROUP] * policy.remove_ethnic_group]
    anc = F.col("ancestor_tags")
    within = lambda table: F.lit(False) if root else F.exists(anc, lambda t: t.isin(*table))
    shallow = F.col("depth") <= policy.max_depth
    near = lambda table: F.col("tag").isin(*table) & shallow if root else (F.col("tag").isin(*table) & shallow) | F.exists(F.slice(anc, 1, policy.max_depth + 1), lambda t: t.isin(*table))
    overlay = self_or_ancestor(lambda t: cohort.is_overlay(group_of(t))) if policy.hardened else F.when(F.col("depth") == 0, cohort.is_overlay(F.col("grp"))).otherwise(cohort.is_overlay(group_of(F.get(anc, 0))))
    out = [
        ("private", self_or_ancestor(lambda t: cohort.is_private(group_of(t)))),
        ("curve", self_or_ancestor(lambda t: cohort.is_curve(group_of(t)))),
        ("dummy_sequence", (sq & F.col("tag").isin(*DUMMY_TAGS)) | within(DUMMY_TAGS)),
    ]
    if policy.hardened:
        out.append(("earlier_identity", self_or_ancestor(lambda t: t.isin(*HARDENED_SEQUENCES) | (group_of(t) == 4))))
    if policy.remove_overlays:
        out.append(("overlay", F.coalesce(overlay, F.lit(False))))
    out += [("extra_identifier", near(extra)), ("order_entry", near(ORDER_ENTRY_TAGS))]
    if policy.remove_icons:
        out.append(("icon", self_or_ancestor(lambda t: t == ICON_SEQUENCE)))
    if policy.blank_descriptors and policy.delete_emptied:
        out.append(("descriptor", (sq & F.col("tag").isin(*DESCRIPTOR_TAGS)) | within(DESCRIPTOR_TAGS)))
    return out


def labelled(elements: DataFrame, policy: Policy) -> DataFrame:
    """``elements`` (with new_id and patient) plus action, old value and new value; deleted rows are still there.

    ``action`` is null for kept rows; ``top`` tells the deleted element itself from what lies inside it.
    ``dated``, ``fixed`` and ``blanked`` mark changes of value.
    """
    tag, vr = F.col("tag"), F.col("vr")
    data = F.col("scope") == "dataset"
    rules = deletions(policy)
    action = F.lit(None).cast("string")
    for name, test in reversed(rules):
        action = F.when(test, name).otherwise(action)
    # most rows are at the root: no tests on ancestors there
    at_root = F.lit(None).cast("string")
    for name, test in reversed(deletions(policy, root=True)):
        at_root = F.when(test, name).otherwise(at_root)
    action = F.when(F.size("ancestor_tags") == 0, at_root).otherwise(action)
    inside = [*DUMMY_TAGS, *EXTRA_TAGS, *ORDER_ENTRY_TAGS, ICON_SEQUENCE, *DESCRIPTOR_TAGS, *HARDENED_SEQUENCES * policy.hardened]
    own = F.exists("ancestor_tags", lambda t: t.isin(*inside))
    private_parent = F.exists("ancestor_tags", lambda t: cohort.is_private(group_of(t)) | cohort.is_curve(group_of(t)) | cohort.is_overlay(group_of(t)))
    action = F.when(data, action).when(tag.isin(*FILE_META_TAGS) & F.lit(policy.sync_file_meta), "file_meta")
    d = elements.withColumn("old", F.col("value")).withColumn("action", action).withColumn("top", ~(own | private_parent))
    scope = F.col("patient")
    filled = F.when(F.size("value") > 0, F.col("value")).otherwise(F.array(F.lit("")))
    listed = data & (vr != "SQ") & tag.isin(*DUMMY_TAGS)
    value = F.when(listed, F.transform(filled, lambda v: identity.dummy_by_type(tag, vr, v, F.col("new_id"), scope, policy))).otherwise(F.col("value"))
    d = d.withColumn("value", value)
    if policy.replace_dates:
        swept = F.when(data & vr.isin("DA", "DT", "TM"), F.transform("value", lambda v: identity.swept(vr, v, policy))).otherwise(F.col("value"))
        d = d.withColumn("before", F.col("value")).withColumn("value", swept).withColumn("dated", F.coalesce(~F.col("value").eqNullSafe(F.col("before")), F.lit(False)) & F.col("action").isNull()).drop("before")
    else:
        d = d.withColumn("dated", F.lit(False))
    if policy.fix_uids:
        bad = (vr == "UI") & ~tag.isin(*NEVER_REMAPPED) & F.exists("value", lambda v: ~identity.uid_valid(v))
        fixed = F.transform("value", lambda v: F.when(identity.uid_valid(v), v).otherwise(identity.remapped(v, scope, policy)))
        d = d.withColumn("fixed", F.coalesce(bad, F.lit(False))).withColumn("value", F.when(F.col("fixed"), fixed).otherwise(F.col("value")))
    else:
        d = d.withColumn("fixed", F.lit(False))
    if policy.blank_descriptors:
        full = data & tag.isin(*DESCRIPTOR_TAGS) & (F.size("value") > 0) & ((vr != "SQ") | F.lit(not policy.delete_emptied)) & (F.array_join("value", "") != "")
        blank = F.when(vr == "SQ", F.array(F.lit("0"))).otherwise(F.array(F.lit("")))
        d = d.withColumn("blanked", F.coalesce(full, F.lit(False)) & F.col("action").isNull()).withColumn("value", F.when(F.col("blanked"), blank).otherwise(F.col("value")))
    else:
        d = d.withColumn("blanked", F.lit(False))
    return d


def person_facts(elements: DataFrame, policy: Policy) -> DataFrame:
    """instance_id, age, sop_instance, sop_class of the original root elements: one small grouped pass."""
    at = lambda t: F.max(F.when(is_root() & (F.col("tag") == t), F.get("value", F.lit(0))))
    d = elements.filter(F.col("tag").isin("00100030", "00080020", "00101010", "00080018", "00080016") & is_root())
    d = d.groupBy("instance_id", "patient").agg(at("00100030").alias("birth"), at("00080020").alias("exam"), at("00101010").alias("age"), at("00080018").alias("sop"), at("00080016").alias("sop_class"))
    own = strip(F.col("age"))
    made = F.coalesce(identity.age(identity.parsed_date(F.col("birth")), identity.parsed_date(F.col("exam")), policy), F.when(own != "", own))
    return d.select("instance_id", identity.capped_age(made, policy).alias("age"), (made != identity.capped_age(made, policy)).alias("capped"), identity.remapped(F.col("sop"), F.col("patient"), policy).alias("sop"), "sop_class")


def literal_rows(instances: DataFrame, rows: list[tuple[str, str, int, list[str], list[str], Column, Column]]) -> DataFrame:
    """Element rows of each instance: (tag, vr, depth, ancestor tags, ancestor items, value, wanted)."""
    text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    made = F.array(*[F.when(want, F.struct(F.lit("dataset").alias("scope"), F.lit(depth).alias("depth"), F.lit(items[-1] if items else "").alias("item_path"), text(ts).alias("ancestor_tags"), text(items).alias("ancestor_items"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), value.alias("value"))) for tag, vr, depth, ts, items, value, want in rows])
    d = instances.select("instance_id", "patient", "new_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("instance_id", "patient", "new_id", "e.*")
    return d.withColumn("grp", group_of(F.col("tag"))).withColumn("elem", F.conv(F.substring("tag", 5, 4), 16, 10).cast("int"))


def declarations(policy: Policy) -> list[tuple]:
    """What every file declares about its de-identification."""
    one = lambda v: F.array(F.lit(v))
    always = F.lit(True)
    codes = [(c, m) for c, m in PROFILE_CODES if (c != "113105" or policy.blank_descriptors) and (c != "113108" or policy.keep_age)]
    rows = [("00120062", "CS", 0, [], [], one("YES"), always), ("00120063", "LO", 0, [], [], one(policy.method), always), ("00120064", "SQ", 0, [], [], one(str(len(codes))), always)]
    for i, (code, meaning) in enumerate(codes):
        item = [f"/00120064[{i}]"]
        rows += [(t, vr, 1, ["00120064"], item, one(v), always) for t, vr, v in (("00080100", "SH", code), ("00080102", "SH", "DCM"), ("00080104", "LO", meaning))]
    return [*rows, ("00280303", "CS", 0, [], [], one("REMOVED" if policy.replace_dates else "UNMODIFIED"), always)]


def by_instance(facts: DataFrame) -> DataFrame:
    """``facts`` (few small rows an instance) as the side that a join keeps at hand, so that elements aren't sorted for it."""
    return facts.hint("shuffle_hash")


def dangling(elements: DataFrame, policy: Policy) -> DataFrame:
    """instance_id, gone: the items whose reference is blank."""
    blank = F.col("tag").isin(*TYPE1_REFERENCES) & (strip(F.coalesce(F.array_join("value", ""), F.lit(""))) == "")
    deep = (F.size("ancestor_items") >= 1) & (F.size("ancestor_items") <= policy.max_depth + 1) & (F.col("scope") == "dataset")
    return elements.filter(blank & deep).groupBy("instance_id").agg(F.collect_set("item_path").alias("gone"))


def without_dangling(elements: DataFrame, policy: Policy) -> DataFrame:
    """Without items whose reference is blank, and without sequences that lost their last item that way."""
    d = elements.join(by_instance(dangling(elements, policy)), "instance_id", "left").filter(~F.coalesce(F.arrays_overlap("ancestor_items", "gone"), F.lit(False)))
    mine = F.concat("item_path", F.lit("/"), "tag", F.lit("["))
    lost = F.size(F.filter("gone", lambda g: g.startswith(mine)))
    left = F.get("value", F.lit(0)).try_cast("int") - F.coalesce(lost, F.lit(0))
    touched = (F.col("vr") == "SQ") & F.coalesce(lost > 0, F.lit(False))
    d = d.withColumn("items_left", F.when(touched, left))
    return d.filter(F.col("items_left").isNull() | (F.col("items_left") > 0)).withColumn("value", F.when(F.col("items_left").isNotNull(), F.array(F.col("items_left").cast("string"))).otherwise(F.col("value"))).drop("gone", "items_left")


def rewrite(elements: DataFrame, policy: Policy, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rewritten elements, labelled rows of the first pass for counts).

    ``elements`` has patient (scope of UID replacement) and new_id beside its own columns.  Rows are dealt by
    instance once, or come so (``dealt``); what is known of an instance is brought to them by joins on that key.
    """
    columns = [*elements.columns]
    if not dealt:
        elements = elements.repartition("instance_id")
    marked = labelled(elements, policy)
    facts = person_facts(elements, policy)
    instances = elements.select("instance_id", "patient", "new_id").distinct().join(by_instance(facts.drop("capped")), "instance_id", "left")
    replaced = ["00100020", "00100010", "00080050", "00120062", "00120063", "00120064", "00280303"]
    kept = marked.filter(F.col("action").isNull()).select(*columns)
    kept = kept.filter(~(is_root() & F.col("tag").isin(*replaced)) & ~(F.coalesce(F.get("ancestor_tags", F.lit(0)) == "00120064", F.lit(False))))
    known = facts.select("instance_id", F.col("age").isNotNull().alias("aged"), "sop", "sop_class")
    if policy.drop_dangling:
        kept = without_dangling(kept, policy)
    kept = kept.join(by_instance(known), "instance_id", "left")
    one, always = F.array, F.lit(True)
    rows = [("00100020", "LO", 0, [], [], one("new_id"), always), ("00100010", "PN", 0, [], [], one(F.lit(PERSON_DUMMY)), always), ("00080050", "SH", 0, [], [], one("new_id"), always), *declarations(policy)]
    if policy.keep_age:
        old = is_root() & (F.col("tag") == "00101010")
        # a blank age without a computed one stays
        kept = kept.filter(~(old & F.coalesce("aged", F.lit(False))))
        rows.append(("00101010", "AS", 0, [], [], one("age"), F.col("age").isNotNull()))
    made = literal_rows(instances, rows)
    if policy.sync_file_meta:
        meta = (F.col("scope") == "file_meta") & F.col("tag").isin("00020002", "00020003")
        wanted = F.when(F.col("tag") == "00020003", F.col("sop")).otherwise(F.col("sop_class"))
        kept = kept.withColumn("value", F.when(meta & (F.coalesce(wanted, F.lit("")) != ""), F.array(wanted)).otherwise(F.col("value")))
    return kept.select(*columns).unionByName(made.select(*columns)), marked


def action_counts(marked: DataFrame) -> DataFrame:
    """patient, instance counts of what was done: one row for each action and patient."""
    kinds = F.array(F.when(F.col("top"), F.col("action")), F.when(F.col("dated"), F.lit("date")), F.when(F.col("fixed"), F.lit("uid_fixed")), F.when(F.col("blanked"), F.lit("descriptor_blanked")))
    return marked.select("patient", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("action")).groupBy("patient", "action").count()


def date_name(tag: Column) -> Column:
    """Name of a date tag, or its hexadecimal label."""
    names = F.create_map(*[F.lit(x) for kv in DATE_TAGS.items() for x in kv])
    return F.coalesce(F.element_at(names, tag), tag_label(tag))


def changed_dates(marked: DataFrame) -> DataFrame:
    """patient, changes, names (the first ten), more (how many further)."""
    d = marked.filter("dated").groupBy("patient").agg(F.count("*").alias("changes"), F.array_sort(F.collect_set(date_name(F.col("tag")))).alias("names"))
    return d.select("patient", "changes", F.slice("names", 1, 10).alias("names"), F.greatest(F.size("names") - 10, F.lit(0)).alias("more"))
