"""Quality rules [native]: word, symbol and repetition statistics of whole texts,
and a decision list learned from `labels.quality` by sequential covering.

Defined results: a null or empty text has no words and fails the base rules. Rows are
judged one by one, so ties, repeated rows and null ids need no rule. Without labels
only the base rules decide. Extra columns of the input pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decision_list
from .common import columns, free_name, let, text_of, windows, words

FEATURES = [
    "f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_digits", "f_marks", "f_distinct",
]
#: Labelled rows used for learning at most: those with the smallest hash of the id.
MAX_LABELLED = 8_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(w: Column, size: int = 8) -> Column:
    """Words inside windows of `size` words that occur twice or more in the text.

    Most texts repeat nothing, which a distinct count of window hashes shows at once;
    only the others sort their windows by (hash, place) and look at the neighbours."""

    def again(s: Column) -> Column:
        return F.filter(
            s,
            lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"])),
        )

    def total(at: Column) -> Column:
        spans = F.transform(at, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - x, F.lit(size))))
        return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def slow(h: Column) -> Column:
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return let(F.sort_array(F.transform(let(s, again), lambda x: x["p"])), total)

    return let(
        windows(w, size),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(slow(h)),
    )


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts (long) and the features of the decision list."""
    t, w = free_name(df, "_t"), free_name(df, "_w")
    out = df.withColumn(t, text_of(text)).withColumn(w, words(F.col(t)))
    tc, wc = F.col(t), F.col(w)
    lines = F.filter(F.split(tc, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "n_words": F.size(wc).cast("bigint"),
        "word_chars": F.char_length(F.array_join(wc, "")).cast("bigint"),
        "n_symbols": F.regexp_count(tc, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeated_words(wc),
        "f_upper": F.regexp_count(tc, F.lit("[A-Z]")).cast("double"),
        "f_digits": F.regexp_count(tc, F.lit("[0-9]")).cast("double"),
        "f_marks": F.regexp_count(tc, F.lit("[!?]")).cast("double"),
        "f_distinct": F.size(F.array_distinct(wc)).cast("double"),
        # a filter on what comes later must not be moved below this step and run all of it again
        "_once": F.monotonically_increasing_id(),
    })
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return out.withColumns({
        "f_words": F.col("n_words").cast("double"),
        "f_word_length": F.col("word_chars") / n,
        "f_symbols": F.col("n_symbols") / chars,
        "f_dup_lines": F.col("n_dup_lines") / n,
        "f_repeats": F.col("n_repeat_words") / n,
        "f_upper": F.col("f_upper") / chars,
        "f_digits": F.col("f_digits") / chars,
        "f_marks": F.col("f_marks") / chars,
        "f_distinct": F.col("f_distinct") / n,
    }).drop(t, w)


def learn_rules(docs: DataFrame, labels: DataFrame | None, *, max_labelled: int = MAX_LABELLED, **limits) -> list:
    """The decision list for bad quality, from at most `max_labelled` labelled rows. A document with
    several labels is bad if one says so."""
    if labels is None:
        return []
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    # at most max_labelled rows of two numbers: bounded, whatever the input
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = (
        text_stats(sample)
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int"))
        .select(*FEATURES, "bad", "fold")
        .persist()
    )
    cuts, groups = decision_list.grouped_counts(stats, FEATURES, "bad", "fold")
    stats.unpersist()
    return decision_list.learn(cuts, groups, **limits)


def judge(docs: DataFrame, rules: list) -> DataFrame:
    """Adds the base counts, base_failed, rule (number of the rule that rejects, 0: none) and kept."""
    out = text_stats(docs).withColumn(
        "base_failed",
        (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    )
    out = out.withColumn("rule", decision_list.verdict(rules).cast("int"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame | None, **options) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, rule and kept."""
    return judge(docs.select("doc_id", "text"), learn_rules(docs, labels, **options)).select(
        "doc_id", *BASE, "base_failed", "rule", "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame | None, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    row = F.struct(*columns(docs)).alias("row")
    judged = judge(docs.select("doc_id", "text", row), learn_rules(docs, labels, **options))
    return judged.where(F.col("kept") & (F.col("_once") >= 0)).select(*[F.col("row")[c].alias(c) for c in docs.columns])
