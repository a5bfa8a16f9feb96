"""Quality rules (operator 2), native: text statistics and the divergence of a document from its language.

One pass of DataFrame expressions gives each document's counts; they go to a narrow staged table, so that the second
pass (language references, then Jensen-Shannon distances) never reads a text again.  Arrays that a lambda refers to
are columns of an earlier select, which Catalyst doesn't inline since each is used more than once.

Defined results: a null text has no words and fails the base rules; a document whose language is null or has fewer
than ``min_reference`` usable documents is compared by its character classes with all usable documents, where these are
as many; one with fewer than ``min_words`` words is held to the base rules alone.
A language without a list of frequent words below has a word distance of 0: there only the character classes tell.
Repeated rows and rows that share a doc_id are judged each by itself.  Distances equal to their limit are kept.  Texts are judged whole, in
a row's memory.  ``judge`` reads no other columns, ``accepted`` returns all with their values.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import free_name, only, staged

SPACE = "[\\x20\\x09-\\x0D]"

#: Frequent words of languages, most frequent first.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "ist", "ein", "im", "auf", "für", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para"],
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})


def row_key() -> Column:
    return F.xxhash64(F.col("lang").cast("string"), F.col("text").cast("string"))


@dataclass(frozen=True)
class RuleParams:
    min_words: int = 30
    min_reference: int = 20
    max_char_distance: float = 0.22
    max_word_distance: float = 0.36


def common_list() -> Column:
    """The frequent words of the row's language; of an unknown language, none but as many."""
    out = F.array(*[F.lit("")] * 16)
    for name, words in COMMON.items():
        out = F.when(F.col("lang") == name, F.array(*map(F.lit, words))).otherwise(out)
    return out


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars array, common array."""
    d = only(docs, doc_id="long", lang="string", text="string").withColumn("row_key", row_key()).withColumn("text", F.coalesce("text", F.lit("")))
    stripped = F.regexp_replace("text", "[a-z]+", "")
    d = d.select(
        "doc_id", "row_key", "lang", F.length("text").alias("n_chars"),
        F.array_remove(F.split("text", f"{SPACE}+"), "").alias("ws"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("ls"),
        stripped.alias("rest"),
    )
    # what isn't a lower-case ASCII letter is a quarter of a text: the other classes are cut off that
    no_space = F.regexp_replace("rest", f"{SPACE}+", "")
    d = d.select(
        "*", F.size("ws").alias("n_words"), F.length("rest").alias("n1"), no_space.alias("r2"),
        F.expr("CASE WHEN size(ws) >= 5 THEN transform(sequence(0, size(ws) - 5), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])) END").alias("h"),
    )
    d = d.select(
        "*", F.length("r2").alias("n2"), F.regexp_replace("r2", "[A-Z]+", "").alias("r3"),
        F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS p))) END").alias("s"),
    )
    d = d.select(
        "*", F.length("r3").alias("n3"), F.regexp_replace("r3", "[^\\x00-\\x7F]+", "").alias("r4"),
        F.expr("sort_array(transform(filter(s, (e, i) -> (i > 0 AND s[greatest(i - 1, 0)].h = e.h) OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].h = e.h)), e -> e.p))").alias("at"),
        F.filter("ws", lambda w: w.isin([*WORDS, *(w.capitalize() for w in WORDS)])).alias("cw"),
    )
    d = d.select(
        "*", F.length("r4").alias("n4"), F.length(F.regexp_replace("r4", "[0-9]+", "")).alias("n5"), F.length(F.regexp_replace("r4", "[^#*$%&|<>]+", "")).alias("n_sym"),
        F.expr("CASE WHEN size(at) > 0 THEN aggregate(at, struct(-5 AS last, 0 AS total), (a, x) -> struct(x AS last, a.total + least(5, x - a.last) AS total), a -> a.total) ELSE 0 END").alias("covered"),
        F.transform("cw", F.lower).alias("cl"), common_list().alias("list"),
    )
    long = lambda c: c.cast("long")
    classes = [F.col("n_chars") - F.col("n1"), F.col("n1") - F.col("n2"), F.col("n2") - F.col("n3"), F.col("n3") - F.col("n4"), F.col("n4") - F.col("n5"), F.col("n_sym"), F.col("n5") - F.col("n_sym")]
    return d.select(
        "doc_id", "row_key", "lang", long(F.col("n_words")).alias("n_words"), long(F.length(F.array_join("ws", ""))).alias("word_chars"), long(F.col("n_sym")).alias("n_symbols"),
        long(F.size("ls") - F.size(F.array_distinct("ls"))).alias("n_dup_lines"), long(F.col("covered")).alias("n_repeat_words"),
        F.array(*[long(c) for c in classes]).alias("chars"),
        F.expr("transform(array(transform(list, w -> cast(size(cl) - size(array_remove(cl, w)) AS bigint))), c -> concat(c, array(n_words - aggregate(c, 0L, (a, x) -> a + x))))[0]").alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts."""
    half = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0D END), 0D, (s, v) -> s + v)"
    share = lambda a: f"transform({a}, x -> x / aggregate({a}, 0D, (s, v) -> s + v))"
    return F.expr(f"transform(array(struct({share(p)} AS p, {share(q)} AS q)), z -> sqrt(greatest(0D, ({half('z.p', 'z.q')} + {half('z.q', 'z.p')}) / 2)))[0]")


def references(features: DataFrame, params: RuleParams) -> tuple[DataFrame, DataFrame]:
    """(ref_lang, ref_chars, ref_common; all_chars): histograms over the documents that pass the base rules, of each
    language and of all of them, the latter in one row."""
    total = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    good = features.filter(~base_failed() & (F.col("n_words") >= params.min_words))
    enough = F.col("n_ref") >= params.min_reference
    sums = good.groupBy("lang").agg(F.count("*").alias("n_ref"), total("chars", 7).alias("ref_chars"), total("common", 17).alias("ref_common"))
    pooled = sums.agg(F.sum("n_ref").alias("n_ref"), total("ref_chars", 7).alias("all_chars")).filter(enough).drop("n_ref")
    return sums.filter(enough & F.col("lang").isNotNull()).select(F.col("lang").alias("ref_lang"), "ref_chars", "ref_common"), pooled


def verdicts(docs: DataFrame, params: RuleParams) -> DataFrame:
    features = staged(counts(docs), "rules")
    own, pooled = references(features, params)
    d = features.join(own, F.col("lang") == F.col("ref_lang"), "left")
    # one row at most
    d = d.join(F.broadcast(pooled), F.lit(True), "left").withColumn("ref_chars", F.coalesce("ref_chars", "all_chars"))
    long = F.col("n_words") >= params.min_words
    d = d.withColumn("char_distance", F.when(long & F.col("ref_chars").isNotNull(), distance("chars", "ref_chars")))
    d = d.withColumn("word_distance", F.when(long & F.col("ref_lang").isNotNull(), distance("common", "ref_common")))
    near = F.coalesce(F.col("char_distance") <= params.max_char_distance, F.lit(True)) & F.coalesce(F.col("word_distance") <= params.max_word_distance, F.lit(True))
    return d.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & near)


def judge(docs: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance, kept of each row."""
    return verdicts(docs, params).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), "kept")


def accepted(docs: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """The rows of ``docs`` that the rules keep; same columns.

    Rejections come back by doc_id and a hash of the row, so rows that share a doc_id but not a text stay apart.
    """
    doc, key = free_name(docs, "out_id"), free_name(docs, "out_key")
    out = verdicts(docs, params).filter(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("row_key").alias(key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (row_key() == F.col(key))
    return docs.join(out, same, "left_anti")
