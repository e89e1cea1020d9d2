"""Mixing sources to target weights by systematic sampling: expected copies are
prefix-summed over a source's documents, one offset per source is added, and a document
is emitted once per integer boundary that its step crosses.

Sizes are word counts (null text: 0). Sources in code-point order, null last, weigh 3, 1,
2, repeating, and share `share` (a fraction in halves) of all sizes; a target stops at
twice its source's size and the excess is shared again by weight. Every document of a
source expects the same number of copies, target / size of the source, so at most 2.

Inside a source documents stand by size class, so the sample is stratified by length and
the words taken come near the target. Ranks are found in two levels (counts per cell of
source, size class and id bucket, then a rank inside the cell), so that a source with a
third of all rows is still spread over many tasks.

Defined results: ties in the order are rows equal in id and size, which are
interchangeable; a null id counts as bucket 0; an empty table gives no rows; a source
without words has target 0 and gives nothing. The number of sources is small (thousands).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, columns, free_name, store, text_of, words

WEIGHTS = (3, 1, 2)
BUCKETS = 64
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.size(words(text, SPACE_WORD)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Water filling in closed form: sources by cap per weight; those before the level are at
    their cap of 2 * size, the others at weight * level. All sums are of whole numbers."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1).cast("bigint")
    )
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumns({
        "twice": 3 * F.sum("source_size").over(Window.partitionBy()) - 4 * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "weights": F.sum("weight").over(rest),
    })
    # at its turn a source is at its cap if the level would lift it to 2 * size or more
    per = per.withColumn("capped", 4 * F.col("source_size") * F.col("weights") <= F.col("twice") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("twice"), F.col("weights")))).over(
        Window.partitionBy()
    )
    target = F.when(F.col("capped"), (2 * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * free["twice"]).cast("double") / (2 * free["weights"]).cast("double")
    )
    return per.select("source", F.col("source_size").cast("bigint").alias("source_size"), target.alias("target"))


def size_class(size: Column) -> Column:
    """Quarter octaves: bit length and the two bits below the highest."""
    b = F.bin(size)
    return F.concat(F.lpad(F.length(b).cast("string"), 2, "0"), F.substring(b, 1, 3))


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset in [0, 1), fixed by the seed."""
    digest = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(sized: DataFrame, *, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Adds source_size, target and copies to rows with doc_id, source and size."""
    sized = sized.withColumns({
        "_class": size_class(F.col("size")),
        "_bucket": F.coalesce(F.pmod(F.col("doc_id"), F.lit(buckets)), F.lit(0)),
    })
    cell = ["source", "_class", "_bucket"]
    counts = sized.groupBy(*cell).agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias("k" + c) for c in cell], F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_start"))
    starts = starts.join(targets(sized).withColumnRenamed("source", "s"), F.col("ksource").eqNullSafe(F.col("s")))
    # a few thousand cells per source, whatever the input
    on = F.col("source").eqNullSafe(F.col("ksource")) & (F.col("_class") == F.col("k_class")) & (F.col("_bucket") == F.col("k_bucket"))
    inside = Window.partitionBy(*cell).orderBy(F.col("size"), F.col("doc_id").asc_nulls_first())
    out = sized.withColumn("_rank", F.row_number().over(inside)).join(starts, on)
    rank = (F.col("_start") + F.col("_rank")).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("_each", each).withColumn("_u", offset(F.col("source"), seed))
    crossed = F.floor(F.col("_each") * rank + F.col("_u")) - F.floor(F.col("_each") * (rank - 1) + F.col("_u"))
    out = out.withColumn("copies", F.least(F.lit(2), crossed).cast("bigint"))
    return out.drop("_class", "_bucket", "_rank", "_each", "_u", "_start", "s", *["k" + c for c in cell])


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: counted in one pass over the texts and stored."""
    return store(docs.select("doc_id", "source", word_count(text_of()).alias("size")))


def mix(docs: DataFrame, *, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken (words)."""
    return copies(sizes_of(docs), seed=seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def emit(docs: DataFrame, *, seed: str = SEED) -> DataFrame:
    """The mix itself: each document once per copy, with its columns and copy (from 1; another
    free name where the documents have such a column).

    Copies per row are found from ids, sources and sizes alone; equal triples may swap
    copies, so rows meet them again by triple and a number within it."""
    key = ["doc_id", "source", "size"]
    number = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
    taken = copies(sizes_of(docs), seed=seed).withColumn("_no", number("copies")).select(*[F.col(c).alias("k_" + c) for c in [*key, "_no"]], "copies")
    rows = docs.select(F.struct(*columns(docs)).alias("row"), "doc_id", "source", word_count(text_of()).alias("size"), F.xxhash64(text_of()).alias("_h"))
    rows = rows.withColumn("_no", number("_h"))
    on = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")) & (F.col("_no") == F.col("k__no"))
    out = rows.join(taken, on).where("copies > 0")
    each = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("_copy").alias(free_name(docs, "copy")))


ORACLE = """
WITH w AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM w GROUP BY source
), n AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS weight FROM s
), o AS (
  SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (
             ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS twice,
         sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM n
), c AS (
  SELECT *, 4 * source_size * weights <= twice * weight AS capped FROM o
), f AS (
  SELECT twice AS t, weights AS ws FROM c WHERE NOT capped ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (2 * source_size)::DOUBLE
              ELSE (weight * (SELECT t FROM f))::DOUBLE / (2 * (SELECT ws FROM f))::DOUBLE END AS target
  FROM c
), r AS (
  SELECT doc_id, source, size, row_number() OVER (
           PARTITION BY source
           ORDER BY lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 3), doc_id % 64, size, doc_id) AS k
  FROM w
), e AS (
  SELECT r.*, t.source_size, t.target, t.target / t.source_size AS each,
         ('0x' || substr(md5('mix/' || coalesce('s' || r.source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (floor(each * k::DOUBLE + u) - floor(each * (k - 1)::DOUBLE + u))::BIGINT * size AS taken
FROM e
"""
