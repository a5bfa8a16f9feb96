"""Column functions on strings: normal forms, plausibility of detected text, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.config import ALLOWED_TEXT, Policy

PAD = "^\\s+|\\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, PAD, "")


def first_lower(values: Column) -> Column:
    """First of a value list, stripped and in lower case; empty for none."""
    return F.lower(strip(F.coalesce(F.get(values, 0), F.lit(""))))


def squeezed(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


def burned_in(flag: Column) -> Column:
    return F.coalesce(F.lower(strip(flag)).isin("yes", "y", "true", "1"), F.lit(False))


def allowed(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{ALLOWED_TEXT}]+", "")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", ""))


def plausible(c: Column, policy: Policy) -> Column:
    """At least ``min_alnum`` letters and digits, all of them allowed; the search ends at the last one it needs."""
    if policy.min_alnum < 1:
        return F.lit(True)
    return F.coalesce(c, F.lit("")).rlike("[A-Za-z0-9]" + "[^A-Za-z0-9]*+[A-Za-z0-9]" * (policy.min_alnum - 1))


def too_long(c: Column, policy: Policy) -> Column:
    return F.length(c) > policy.max_block


def repetitive(c: Column, policy: Policy) -> Column:
    """Some token occurs ``repeat_count`` times: among sorted tokens, one equals that so many places before it."""
    tokens = F.sort_array(F.filter(F.split(c, "\\s+"), lambda t: t != ""))
    k = policy.repeat_count - 1
    shifted = F.slice(tokens, k + 1, F.greatest(F.size(tokens) - k, F.lit(0)))
    return F.exists(F.zip_with(shifted, F.slice(tokens, 1, F.size(shifted)), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))


def char_run(c: Column) -> Column:
    """Ten equal characters in a row, of any kind but line feeds (a dot would leave out other line ends too)."""
    return c.rlike("([^\n])\\1{9}")


def flags(c: Column, blank: Column, policy: Policy) -> Column:
    """Names of the signs that a text was invented rather than read."""
    c = F.coalesce(c, F.lit(""))
    tests = {"too_long": too_long(c, policy), "repetitive": repetitive(c, policy), "char_run": char_run(c), "blank_source_image": F.coalesce(blank, F.lit(False))}
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def without_markers(c: Column) -> Column:
    """Without the markers that text models leave."""
    return strip(F.regexp_replace(c, "</?s>|<pad>|<loc_[0-9]+>", ""))


def file_name(c: Column) -> Column:
    """A name that is safe in any file system."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "[/\\\\]", "_")
    s = F.btrim(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_"), "_+", "_"), F.lit("_."))
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")


def joined_hits(texts: Column) -> Column:
    one = F.transform(texts, lambda t: strip(F.replace(t, F.lit("\n"), F.lit(" "))))
    return F.array_join(F.filter(one, lambda t: t != ""), " | ")


def hit_label(text: Column, conf: Column, marks: Column) -> Column:
    """Label of a hit in an annotated image."""
    known = F.concat(text, F.lit(" ("), F.format_string("%.2f", conf), F.lit(")"))
    label = F.when(conf.isNull(), F.concat(text, F.lit(" (conf n/a)"))).otherwise(known)
    label = F.when(F.size(marks) > 0, F.concat(label, F.lit(" ["), F.array_join(marks, ","), F.lit("]"))).otherwise(label)
    return F.substring(F.replace(label, F.lit("\n"), F.lit(" ")), 1, 60)


def probability(log_prob: Column) -> Column:
    return F.least(F.greatest(F.exp(log_prob), F.lit(0.0)), F.lit(1.0))


def tag_label(tag: Column) -> Column:
    """(GGGG,EEEE) of eight hex digits."""
    return F.concat(F.lit("("), F.substring(tag, 1, 4), F.lit(","), F.substring(tag, 5, 4), F.lit(")"))


def instance_number(value: Column, missing: Column) -> Column:
    """Sort key: 1 where there is none, past all others where it is no number."""
    return F.when(missing, F.lit(1).cast("long")).otherwise(F.coalesce(strip(value).try_cast("long"), F.lit(2**63 - 1)))


def spacing(value: Column) -> Column:
    """First number of a pixel spacing; null unless positive."""
    s = strip(F.get(F.split(value, "[\\\\,]"), 0)).try_cast("double")
    return F.when(s > 0, s)
