"""Small cases of the column functions."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import rules
from veilframe.config import Policy
from veilframe.functions import cohort, geometry, identity, raster, text
from veilframe.operators import ordering, reports

P = Policy()
H = Policy(hardened=True)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def null(kind="string"):
    return F.lit(None).cast(kind)


CASES = [
    (lambda: [text.burned_in(F.lit(v)) for v in ("YES", " y ", "1", "NO")] + [text.burned_in(null())], [True, True, True, False, False]),
    (lambda: [identity.swept(F.lit("DA"), F.lit("19990102"), P), identity.swept(F.lit("DA"), null(), P), identity.swept(F.lit("LO"), F.lit("x"), P)], ["20000101", None, "x"]),
    (lambda: [identity.dt(F.lit(v), P) for v in ("20130605142311.123", "20130605", "", " 2013060514 ")] + [identity.dt(F.lit("20130605142311"), H)], ["20000101142311.123", "20000101", "20000101", "2000010114", "20000101"]),
    (lambda: [identity.age(identity.parsed_date(F.lit(b)), identity.parsed_date(F.lit(e)), P) for b, e in (("20040229", "20050228"), ("20040229", "20050301"), ("19000101", "20200101"), ("20200102", "20200101"), ("x", "20200101"), ("20201301", "20210101"), ("1990.05.06", "20200506"))], ["000Y", "001Y", "089Y", None, None, None, "030Y"]),
    (lambda: [identity.capped_age(F.lit(v), P) for v in ("095Y", "95Y", "012M")] + [identity.capped_age(F.lit("95Y"), H)], ["089Y", "95Y", "012M", "089Y"]),
    (lambda: [identity.uid_valid(F.lit(v)) for v in ("1.02.3", "1.2.0", "", "1" * 65, "1..2", " 1.2 ", "1.2.")], [False, True, True, False, False, True, False]),
    (lambda: [identity.placeholder(F.lit(v), None) for v in ("Anonymous^Anonymous", "--", "Anonuevo", "Smith", " ")] + [identity.placeholder(F.lit("Anonuevo"), None, True), identity.placeholder(F.lit("P1"), F.array(F.lit("p1")))], [True, True, True, False, True, False, True]),
    (lambda: [text.plausible(F.lit(v), P) for v in ("A-1", "-a-", "é1ü2")] + [text.plausible(null(), P)], [True, False, True, False]),
    (lambda: [geometry.confident(c, P) for c in (null("double"), F.lit(0.19), F.lit(0.2))] + [geometry.confident(null("double"), Policy(keep_unknown_confidence=False))], [True, False, True, False]),
    (lambda: [text.flags(F.lit(v), F.lit(b), P) for v, b in (("x" + "ab " * 101, False), ("a b a b a b a b a b a b", False), ("z" * 10, True), ("ok", False), ("z" * 9, False))], [["too_long", "repetitive"], ["repetitive"], ["char_run", "blank_source_image"], [], []]),
    (lambda: [text.file_name(F.lit(v)) for v in ("a/b c..", "a\\b", "", "___", "x.dcm")] + [text.file_name(null())], ["a_b_c", "a_b", "unknown", "unknown", "x.dcm", "unknown"]),
    (lambda: [text.stem(F.lit(v)) for v in ("a.b.dcm", ".hidden", "none")], ["a.b", ".hidden", "none"]),
    (lambda: [text.without_markers(F.lit("<s> Hi<loc_12></s><pad> "))], ["Hi"]),
    (lambda: [F.size(geometry.coerced_points(F.array(*[F.lit(float(i)) for i in range(n)]))) for n in (4, 8, 10)] + [geometry.coerced_points(F.array(*[F.lit(1.0)] * 6)).isNull()], [4, 4, 5, True]),
    (lambda: [geometry.padded(F.lit(1.2), F.lit(0.0), F.lit(3.1), F.lit(2.0), F.lit(10), F.lit(10), P), geometry.padded(F.lit(12.0), F.lit(0.0), F.lit(13.0), F.lit(2.0), F.lit(10), F.lit(10), P)], [(1, 0, 4, 2), None]),
    (lambda: [F.transform(geometry.border_band(F.lit(100), F.lit(100), P), lambda r: F.array(r.x0, r.y0, r.x1, r.y1))], [[[0, 0, 100, 18], [0, 82, 100, 100], [0, 0, 18, 100], [82, 0, 100, 100]]]),
    (lambda: [raster.hounsfield(F.array(F.lit(-2000), F.lit(0), F.lit(40000)), F.lit(1.0), F.lit(-1024))], [[-1024, -1024, -26560]]),
    (lambda: [raster.air_mask(F.array(F.lit(-800), F.lit(-799)), P.air)], [[1, 0]]),
    (lambda: [raster.gray8(F.array(F.lit(5), F.lit(5))), raster.gray8(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(True))], [[0, 0], [255, 128, 0]]),
    (lambda: [text.instance_number(F.lit(v), F.lit(m)) for v, m in (("2", False), ("", True), ("x", False), ("", False))], [2, 1, 2**63 - 1, 2**63 - 1]),
    (lambda: [text.spacing(F.lit(v)) for v in ("0.5\\0.6", "0.4,0.4", "0", "x")], [0.5, 0.4, None, None]),
    (lambda: [text.joined_hits(F.array(F.lit(" a\nb "), F.lit(" "), F.lit("c")))], ["a b | c"]),
    (lambda: [text.hit_label(F.lit("hit"), F.lit(0.256), F.array().cast("array<string>")), text.hit_label(F.lit("h\nt"), null("double"), F.array(F.lit("f1"), F.lit("f2")))], ["hit (0.26)", "h t (conf n/a) [f1,f2]"]),
    (lambda: [cohort.is_modality(F.lit("OCT")), cohort.is_modality(F.lit("MR"))], [True, False]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(spark, k):
    build, want = CASES[k]
    columns = build()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    plain = lambda v: tuple(v) if isinstance(v, T.Row) else v
    assert [plain(v) for v in row] == want


def test_cohort_cases(spark):
    def ok(policy, study, sop="1.2"):
        return one(spark, cohort.in_cohort(F.lit("CT"), F.lit("ORIGINAL PRIMARY AXIAL"), F.array(F.lit(study)), F.lit(sop), policy))

    assert ok(P, "HEAD CTA") and not ok(P, "head cta") and not ok(H, "HEAD CTA") and ok(Policy(allow_angio_perfusion=True), "head cta")
    assert not ok(P, "chest") and not ok(P, "head", "1.2.840.10008.5.1.4.1.1.7.3") and ok(P, "h e a d")
    assert one(spark, cohort.in_cohort(null(), F.lit("ORIGINAL PRIMARY AXIAL"), F.array(F.lit("head")), F.lit("1"), P)) is False


def test_uids_agree_and_differ(spark):
    uid = lambda v, scope=None, key="k": one(spark, identity.remapped(F.lit(v), F.lit(scope) if scope else None, Policy(uid_key=key)))
    assert uid("1.2") == uid(" 1.2 ") != uid("1.3") and uid("1.2", "a") != uid("1.2", "b") and uid("1.2", key="x") != uid("1.2", key="y") and uid("  ") == ""
    assert one(spark, identity.uid_valid(F.lit(uid("1.2"))))


def test_actions(spark):
    def out(n_boxes, n_boxless, policy):
        a, forced, strategy = geometry.action(F.lit(n_boxes), F.lit(n_boxless), policy)
        return tuple(spark.range(1).select(a, forced, strategy).first())

    assert out(0, 1, Policy(boxless="drop")) == ("redact", True, "border_band") and out(0, 1, Policy(boxless="drop", never_drop=False)) == ("drop", False, "drop")
    assert out(1, 1, P) == ("redact", False, "border_band") and out(1, 0, Policy(action="drop")) == ("redact", True, "border_band")


def test_kernel_size_is_reproducible(spark):
    d = spark.range(200).select(raster.kernel_size(F.lit(0.5), F.col("id").cast("string"), P.kernel_mm).alias("k"), raster.kernel_size(null("double"), F.col("id").cast("string"), P.kernel_mm).alias("f"))
    rows = d.collect()
    assert rows == d.collect() and {r.k for r in rows} == set(range(100, 121)) and {r.f for r in rows} == set(range(50, 61))


def test_folders(spark):
    rows = [("P", "A", ""), ("P", "A", "b"), ("P", "A", "a/z"), ("P", "A", "a/y/q"), ("P", "A", "s/t/u/v/w/DOE_JOHN"), ("P", "A", "s/t/u/v/w/DOE_JANE/1"), ("Q", "B", "m")]
    got = {(r.patient_old, r.rel_dir): r.new_dir for r in ordering.renamed_folders(spark.createDataFrame(rows, "new_id string, patient_old string, rel_dir string")).collect()}
    assert got == {("A", ""): "", ("A", "b"): "P_2", ("A", "a/z"): "P_1/P_2", ("A", "a/y/q"): "P_1/P_1/P_1", ("A", "s/t/u/v/w/DOE_JOHN"): "P_3" + "/P_1" * 4 + "/P_2", ("A", "s/t/u/v/w/DOE_JANE/1"): "P_3" + "/P_1" * 4 + "/P_1/P_1", ("B", "m"): "Q_1"}


def test_empty_series_is_an_error(spark):
    d = spark.createDataFrame([("s", "f1", True, "bad", "no_image", None), ("s", "f2", True, "bad", "no_image", None), ("t", "f3", False, None, "clean", None)], "series_folder string, source_filename string, failed boolean, error string, bucket string, decision string")
    account = reports.series_accounting(d, ["series_folder"])
    errors = sorted((r.file, r.error) for r in reports.error_rows(d, account, True).collect())
    assert errors == [("f1", "bad"), ("f2", "bad"), ("s", "all_slices_failed_to_process")] and datetime


def test_table_sizes():
    assert [len(set(x)) for x in (rules.DUMMY_TAGS, rules.ORDER_ENTRY_TAGS, rules.EXTRA_TAGS, rules.DESCRIPTOR_TAGS, rules.DATE_TAGS, rules.ABSENT_TAGS, rules.EMPTY_TAGS, rules.PLACEHOLDERS, rules.FILE_META_TAGS, rules.NEVER_REMAPPED, rules.TYPE1_REFERENCES, rules.PROFILE_CODES)] == [106, 52, 10, 34, 38, 62, 13, 12, 6, 4, 2, 5]
    dummy, order, extra, text_tags = set(rules.DUMMY_TAGS), set(rules.ORDER_ENTRY_TAGS), set(rules.EXTRA_TAGS), set(rules.DESCRIPTOR_TAGS)
    assert (len(dummy & order), dummy & extra, dummy & text_tags, len(order & text_tags), order & extra) == (11, {"00400241"}, {"00080080", "00080081", "4008011A"}, 6, set())
