"""Benchmark decontamination [native]: a broadcast hash set of normalised benchmark
n-grams is probed with every window of every document, hits are verified on the words
themselves, and spans or whole documents are removed.

Words: A-Z in lower case, runs of [0-9a-z] and of characters from U+0080 on. A window is
`size` consecutive words of an item; an item with fewer words, but not none, is one
window. Defined results: a null or empty text has no words, no hits and is clean; a null
or empty text of an item has no windows; an item with a null id counts for hits and spans, not for items; repeated rows each get their result; an empty benchmark
leaves every document clean. Extra columns do no harm.

The benchmark is broadcast. One of more than `MAX_BROADCAST` windows, counted once for each item that has
them, is dealt by hash into parts. Each part but the first passes over the documents in a job of its own that
stores its hits, so no plan holds more than one part, and a window that very many items share is split too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ascii_lower, columns, let, store, text_of, words

SIZE = 10
#: Pairs of a benchmark window and an item (a hash, a short string and an id, some 200 bytes) that may be broadcast.
MAX_BROADCAST = 500_000


def norm_words(text: Column) -> Column:
    return words(ascii_lower(text), ALNUM_WORD)


def _windows(w: Column, size: int) -> Column:
    """(p, k, h): place from 0, length and hash of each window of `size` words."""
    n = F.size(w)
    return F.when(
        n >= size,
        F.transform(
            F.sequence(F.lit(0), n - size),
            lambda i: F.struct(i.alias("p"), F.lit(size).alias("k"), F.xxhash64(F.slice(w, i + 1, size)).alias("h")),
        ),
    )


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per distinct window: k, h, window (its words, joined) and items (ids as sorted strings)."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), norm_words(text_of()).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(size))
    each = w.select("item", "w", k.alias("k"), F.explode(F.sequence(F.lit(1), F.size("w") - k + 1)).alias("i"))
    window = F.slice("w", F.col("i"), F.col("k"))
    return (
        each.select("item", "k", F.xxhash64(window).alias("h"), F.array_join(window, " ").alias("window"))
        .groupBy("k", "h", "window")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _part(b: DataFrame, i: int, parts: int) -> DataFrame:
    """Part i of the windows: each pair of a window and an item is in one part, a window without items too."""
    mine = F.filter("items", lambda x: F.pmod(F.xxhash64("bh", x), F.lit(parts)) == i)
    return b.withColumn("items", mine).where((F.size("items") > 0) | (F.pmod("bh", F.lit(parts)) == i))


def _alone(df: DataFrame) -> DataFrame:
    """df by a job of its own. Its broadcast is released with the plan, which the collector has to notice
    before the next one is sent."""
    out = store(df)
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def hits(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE, keep: list[str] | None = None, most: int = MAX_BROADCAST) -> DataFrame:
    """Per document row: row (a struct of the columns in `keep`), n_words, spans (sorted (p, k) of hit windows) and items.

    Windows are generated, probed and dropped inside one pass; only one row per document
    and the hits are shuffled. Rows of a document meet by two digests of all it holds, so the
    result does not depend on row order; equal rows are counted and given back as often.
    """
    keep = keep or ["doc_id"]
    bench = store(benchmark_windows(benchmark, size))
    pairs = F.sum(F.greatest(F.size("items"), F.lit(1)))  # at most `size` rows, whatever the benchmark
    sizes = [(r["k"], r["n"]) for r in bench.groupBy("k").agg(pairs.alias("n")).orderBy("k").collect()]
    parts = max(1, -(-sum(n for _, n in sizes) // most))
    row, text = F.struct(*[c for c, name in zip(columns(docs), docs.columns) if name in keep]), text_of()
    base = docs.select(
        row.alias("row"),
        F.xxhash64(row, text).alias("d1"),
        F.xxhash64(F.lit(7), row, text).alias("d2"),
        norm_words(text).alias("w"),
    )
    none = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("h")))
    cells = F.concat(none, *[F.coalesce(_windows(F.col("w"), k), F.slice(none, 1, 0)) for k, _ in sizes])
    # never empty; the plain explode would have the planner test its size first, at the same cost again
    # made in a step of its own, as a generator over a lambda would copy the words for every cell
    each = base.withColumn("cells", cells).select("row", "d1", "d2", "w", F.explode_outer("cells").alias("c"))
    b = bench.select(F.col("k").alias("bk"), F.col("h").alias("bh"), "window", "items")
    same = (
        (F.col("c.h") == F.col("bh"))
        & (F.col("c.k") == F.col("bk"))
        & (F.array_join(F.slice("w", F.greatest(F.col("c.p"), F.lit(0)) + 1, F.col("c.k")), " ") == F.col("window"))
    )
    first = F.col("c.p") == -1  # the one cell that stands for the document itself

    def probed(i: int) -> DataFrame:
        """Hits of one part of the windows; the documents' own cells come with the first."""
        own = b if parts == 1 else _part(b, i, parts)
        return each.join(F.broadcast(own), same, "left").where(F.col("items").isNotNull() | (first if i == 0 else F.lit(False))).select(
            "d1", "d2",
            F.when(first, F.col("row")).alias("row"),
            F.when(first, F.size("w")).cast("bigint").alias("n_words"),
            F.when(~first, F.struct(F.col("c.p").alias("p"), F.col("c.k").alias("k"))).alias("span"),
            "items",
        )

    found = reduce(DataFrame.unionByName, [_alone(probed(i)) for i in range(1, parts)], probed(0))
    out = found.groupBy("d1", "d2").agg(
        F.first("row", ignorenulls=True).alias("row"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if(F.col("span").isNull()).cast("int").alias("copies"),
    )
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("row", "n_words", "spans", "items")


def covered(spans: Column) -> Column:
    """Words inside sorted spans (p, k), each counted once."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        state,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["p"] + s["k"] - F.greatest(a["end"], s["p"]))).cast("bigint").alias("n"),
            F.greatest(a["end"], s["p"] + s["k"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return hits(docs, benchmark, size=size).select(
        "row.doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the hit words, and without what stands between two of them.

    Spans count words, so the text is cut at its words: piece i is word i with what precedes it."""
    hit = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["p"], s["p"] + s["k"] - 1))))
    piece = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]*[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    kept = let(hit, lambda hit: F.filter(pieces, lambda _, i: ~F.array_contains(hit, i)))
    tail = F.regexp_extract(text, r"[^0-9A-Za-z\x{80}-\x{10FFFF}]*\z", 0)
    return F.concat(F.array_join(kept, ""), tail)


def clean(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE, whole: bool = False) -> DataFrame:
    """Documents with their own columns; hit spans are cut out (n_chars follows), or whole
    documents go. A document of which no word is left goes too."""
    found = hits(docs, benchmark, size=size, keep=docs.columns)
    if whole:
        return found.where(F.size("spans") == 0).select("row.*")
    is_hit = F.size("spans") > 0
    out = found.where(~is_hit | (covered(F.col("spans")) < F.col("n_words")))
    out = out.withColumn("_new", F.when(is_hit, remove_spans(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text")))
    cols = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(is_hit, F.char_length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[cols.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), h AS (
  SELECT r, k, i, item_id FROM dw JOIN bw USING (k, g)
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM h)) GROUP BY r
), s AS (
  SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h WHERE item_id IS NOT NULL GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
