"""Column functions on dates, ages, UIDs and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.config import PERSON_DUMMY, TEXT_DUMMY, Policy
from veilframe.functions.text import strip
from veilframe.rules import NEVER_REMAPPED, PLACEHOLDERS

UID = "^(0|[1-9][0-9]*)(\\.(0|[1-9][0-9]*))*$"
TEXT_TYPES = ["LO", "SH", "ST", "LT", "UT", "CS", "AE"]
NUMBER_TYPES = ["IS", "DS", "US", "UL", "SS", "SL", "FL", "FD"]


def uid_valid(c: Column) -> Column:
    """Blank or a UID; white space at the ends is only cut where the text as it stands is none."""
    c = F.coalesce(c, F.lit(""))
    s = strip(c)
    return ((F.length(c) <= 64) & c.rlike(UID)) | (s == "") | ((F.length(s) <= 64) & s.rlike(UID))


def remapped(c: Column, scope: Column | None, policy: Policy) -> Column:
    """A UID of the same key, scope (patient) and original each time; blank stays blank.

    Keyed hashing needs no table, so equal originals agree in every file and task without a shuffle.
    """
    s = strip(c)
    seed = F.concat_ws("|", F.lit(policy.uid_key), F.coalesce(scope, F.lit("")) if scope is not None else F.lit(""), s)
    digest = F.sha2(seed, 256)
    part = lambda at: F.lpad(F.conv(F.substring(digest, at, 15), 16, 10), 19, "0")
    return F.when(s == "", s).otherwise(F.concat(F.lit("2.25.1"), part(1), part(16)))


def placeholder(c: Column, known: Column | None, hardened: bool = False) -> Column:
    """Blank, a placeholder of the policy, or one of the ``known`` ids."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = (s == "") | s.isin(*PLACEHOLDERS) | s.rlike("^[\\^ \\-_.]*$")
    if not hardened:
        out = out | s.startswith("anon")
    return out | F.coalesce(F.array_contains(known, s), F.lit(False)) if known is not None else out


def da(policy: Policy) -> Column:
    return F.lit(policy.date)


def dt(c: Column, policy: Policy) -> Column:
    """The anonymisation date with the time that followed; hardened: with a time of zero."""
    s = strip(F.coalesce(c, F.lit("")))
    tail = F.expr("''") if policy.hardened else F.substr(s, F.lit(9))
    return F.when(F.length(s) > 8, F.concat(F.lit(policy.date), tail)).otherwise(F.lit(policy.date))


def parsed_date(c: Column) -> Column:
    """The first eight digits as a date, null unless there is such a day.  A cast is some times faster than a pattern."""
    digits = F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), 1, 8)
    part = lambda at, n: F.substring(digits, at, n)
    return F.when(F.length(digits) == 8, F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)).try_cast("date"))


def age(birth: Column, exam: Column, policy: Policy) -> Column:
    """Whole years as nnnY, capped; null unless both dates are valid and in order.  Dates as date columns.

    A lambda binds both dates, whose expressions would otherwise be copied for every use.
    """

    def years(z: Column) -> Column:
        before = (F.month(z.e) * 100 + F.day(z.e) < F.month(z.b) * 100 + F.day(z.b)).cast("int")
        n = F.year(z.e) - F.year(z.b) - before
        return F.when((z.e >= z.b) & (n >= 0), F.format_string("%03dY", F.least(n, F.lit(policy.max_age))))

    return F.get(F.transform(F.array(F.struct(birth.alias("b"), exam.alias("e"))), years), F.lit(0))


def capped_age(c: Column, policy: Policy) -> Column:
    """An existing age, capped.  Hardened: also ages of fewer digits than three."""
    digits = F.regexp_extract(c, "^\\s*([0-9]+)", 1) if policy.hardened else F.substring(c, 1, 3)
    over = (F.upper(c).endswith("Y")) & (digits.try_cast("int") > policy.max_age)
    return F.when(over, F.format_string("%03dY", F.lit(policy.max_age))).otherwise(c)


def dummy_by_type(tag: Column, vr: Column, value: Column, new_id: Column, scope: Column | None, policy: Policy) -> Column:
    """What replaces one value of a listed element."""
    return (
        F.when(tag == "00100020", new_id)
        .when(tag == "00100010", F.lit(PERSON_DUMMY))
        .when(tag == "00080050", new_id)
        .when(vr == "DA", da(policy))
        .when(vr == "TM", value)
        .when(vr == "DT", dt(value, policy))
        .when(vr == "UI", F.when(tag.isin(*NEVER_REMAPPED), value).otherwise(remapped(value, scope, policy)))
        .when(vr == "PN", F.lit(PERSON_DUMMY))
        .when(vr.isin(*TEXT_TYPES), F.lit(TEXT_DUMMY))
        .when(vr.isin(*NUMBER_TYPES), F.lit("0"))
        .when(vr == "AS", F.lit("000Y"))
        .otherwise(F.lit(TEXT_DUMMY))
    )


def swept(vr: Column, value: Column, policy: Policy) -> Column:
    """What the sweep by type makes of a date or time; other values stay."""
    out = F.when(vr == "DA", da(policy)).when(vr == "DT", dt(value, policy))
    if policy.zero_times:
        out = out.when(vr == "TM", F.lit("000000.00"))
    return F.when(value.isNull(), value).otherwise(out.otherwise(value))
