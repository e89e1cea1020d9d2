"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighing their number of occurrences, and its 5-word
shingles, weighing twice theirs (the whole sequence where there are fewer words). A-Z count as
a-z. For sample k and term x let r and c be gamma(2, 1) numbers and b a uniform one, all fixed
by (k, x). A term of weight w stands at t = floor(ln w / r + b) and at a = ln c - r (t - b + 1);
the sample is the (x, t) with the smallest a. Two texts have equal samples with the
probability of their generalised Jaccard similarity, sum of minima by sum of maxima of the
weights, so the share of equal samples estimates it with a standard error of at most 0.0625.

Random numbers: 65,536 triples (r, c, b) are drawn once, and a multiplicative hash of the term
picks the triple of sample k. As a small weight's t and a depend on the triple only, they are
looked up from tables per weight. Terms with the same triple are told apart by their own hash.

A document's edited text needs the head of the next document. Ids are ordered by range
partitions of narrow rows; each partition's last row gets the first of the next non-empty one.
Heads travel by key: the texts are shuffled once (the shuffle serves both joins), the heads once.

Defined results: a null text is empty; a text without words has no terms and the fingerprint of
zeros, like to other such texts (1) and to no text with words (0). Rows with the same doc_id
and different texts stand in the order of a hash of their texts; rows with the same doc_id and
text are one document, each with the same result; null ids stand last. A table of one document
has itself as next. An empty table gives no rows. No text is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, free_name, store, text_of
from .textvec import _PLACE, Words, mix, pieces

SAMPLES = 64
SHINGLE, SHINGLE_WEIGHT = 5, 2
#: Triples of random numbers; weights whose tables are kept.
DRAWS, TABLED = 1 << 16, 24
#: Bytes of text sampled at a time.
SLICE = 1 << 18
_ROW = np.uint64(44)
_TERM = np.uint64((1 << 44) - 1)


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of all triples. A gamma(2, 1) number is the sum of two exponential ones."""
    u = ((mix(np.arange(1, 5 * DRAWS + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    u = u.reshape(5, DRAWS)
    return -np.log(u[0]) - np.log(u[1]), np.log(-np.log(u[2]) - np.log(u[3])), u[4]


def packed(r: np.ndarray, ln_c: np.ndarray, b: np.ndarray, ln_w: np.ndarray | float) -> np.ndarray:
    """a as 32 bits whose order is that of the numbers, above 32 bits that name t."""
    t = np.floor(ln_w / r + b)
    a = (ln_c - r * (t - b + 1)).astype(np.float32).view(np.uint32)
    a = np.where(a >> np.uint32(31), ~a, a | np.uint32(1 << 31)).astype(np.uint64)
    return (a << np.uint64(32)) | (mix(t.astype(np.int64).astype(np.uint64)) & np.uint64(0xFFFFFFFF))


@lru_cache(maxsize=1)
def tables() -> np.ndarray:
    """packed() of all triples for the weights 1 to TABLED, one after the other."""
    return np.concatenate([packed(*draws(), np.log(w)) for w in range(1, TABLED + 1)])


@lru_cache(maxsize=1)
def factors(n: int) -> np.ndarray:
    return mix(np.arange(7, 7 + n, dtype=np.uint64)) | np.uint64(1)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a batch: row, term and weight, in the order of rows."""
    w = Words(texts)
    h = w.hashes()
    n = len(h)
    each = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE if n >= SHINGLE else 0):
        each += h[j : n - SHINGLE + 1 + j] * _PLACE[j]
    whole = np.repeat(w.count, w.count) >= SHINGLE  # of each word: its row has a whole shingle
    at = np.flatnonzero(whole[: len(each)] & (w.doc[: len(each)] == w.doc[SHINGLE - 1 :])) if len(each) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    spans = zip(w.first[short].tolist(), w.count[short].tolist())
    rest = np.array([(h[a : a + c] * _PLACE[:c]).sum(dtype=np.uint64) for a, c in spans], np.uint64) + _PLACE[40 + w.count[short]]
    row = np.concatenate([w.doc, w.doc[at], short]).astype(np.uint64)
    term = np.concatenate([mix(h + np.uint64(1)), mix(mix(each[at])), mix(mix(rest))])
    kind = np.repeat(np.array([1, SHINGLE_WEIGHT], np.int64), [n, len(at) + len(short)])
    # the lowest bit of a key tells words from shingles, so that sorting keeps them apart
    key = (row << _ROW) | (term & _TERM & ~np.uint64(1)) | (kind > 1).astype(np.uint64)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    weight = times * np.where(key & np.uint64(1), SHINGLE_WEIGHT, 1)
    return (key >> _ROW).astype(np.int64), mix(key & _TERM), weight


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """The fingerprint of each text: 16 bits per sample, 0 only without terms."""
    row, term, weight = terms(texts)
    out = np.zeros((len(texts), samples), np.uint16)
    if not len(row):
        return out
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    own = term & np.uint64(0xFFFFFFFF)
    base = (np.minimum(weight, TABLED) - 1) * DRAWS
    heavy = np.flatnonzero(weight > TABLED)
    ln_w = np.log(weight[heavy])
    table, (r, ln_c, b) = tables(), draws()
    for k, f in enumerate(factors(samples)):
        pick = ((term * f) >> np.uint64(48)).astype(np.int64)
        place = table[base + pick]
        if len(heavy):
            i = pick[heavy]
            place[heavy] = packed(r[i], ln_c[i], b[i], ln_w)
        least = np.minimum.reduceat(place ^ own, first)
        name = mix((least & np.uint64(0xFFFFFFFF)) + f) >> np.uint64(48)
        out[row[first], k] = np.maximum(name, np.uint64(1))
    return out


def prints(texts: pa.Array) -> pa.Array:
    raw, size = signatures(texts).astype(">u2").tobytes(), 2 * SAMPLES
    return pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints (binary)."""
    same = lambda i: F.when(F.substring(a, 2 * i + 1, 2) == F.substring(b, 2 * i + 1, 2), 1.0).otherwise(0.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), F.lit(0.0), lambda s, i: s + same(i)) / SAMPLES


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of their texts beside them (binary; another free name where taken)."""
    name = free_name(docs, name)
    schema = docs.select(*columns(docs), F.lit(b"").alias(name)).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at, SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, prints(part.column(at))], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def successors(keys: DataFrame) -> DataFrame:
    """n_id, n_hash of the next row beside each distinct (id, hash), by descending id, nulls last; the last row's is the first."""
    order = [F.col("id").desc_nulls_last(), F.col("hash")]
    ranged = store(keys.dropDuplicates(["kid", "hash"]).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    after = F.lead(F.struct("kid", "hash")).over(inside)
    # one row per range
    firsts = ranged.withColumn("no", F.row_number().over(inside)).where("no = 1").select("part", F.struct("kid", "hash").alias("head"))
    by_part = Window.orderBy("part")
    around = F.first("head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nexts = firsts.select(F.col("part").alias("p"), F.coalesce(F.lead("head").over(by_part), around).alias("beyond"))
    linked = ranged.withColumn("after", after).join(F.broadcast(nexts), F.col("part") == F.col("p"))
    follower = F.coalesce("after", "beyond")
    return linked.select("kid", "hash", "n_chars", follower["kid"].alias("n_kid"), follower["hash"].alias("n_hash"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """kid, hash, the compressed text with its size in bytes, and its fingerprint."""
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("kid"), F.xxhash64(text_of()).alias("hash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for part in pieces(batch, 2, SLICE):
                raw = [t.encode() for t in part.column(2).to_pylist()]
                small = pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), small, pa.array(list(map(len, raw)), pa.int64()), prints(part.column(2))],
                    names=["kid", "hash", "packed", "size", "fingerprint"])

    return docs.select(*key, text_of().alias("text")).mapInArrow(run, "kid string, hash bigint, packed binary, size bigint, fingerprint binary")


def unpacked(batch: pa.RecordBatch) -> list[str]:
    codec = pa.Codec("zstd")
    rows = zip(batch.column("packed").to_pylist(), batch.column("size").to_pylist())
    return [codec.decompress(p, size, asbytes=True).decode() for p, size in rows]


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint and next_print (that of the next document) of each row."""
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("kid"), F.xxhash64(text_of()).alias("hash")]
    keys = docs.select(F.col("doc_id").alias("id"), *key, F.char_length(text_of()).cast("bigint").alias("n_chars"))
    nexts = store(successors(keys))
    # both joins take the same columns, so that one shuffle of the texts serves them
    texts = packed_texts(docs)
    # one row per key: a running sum, as a rank filter would be moved below the shuffle, which then could not be shared
    once = F.sum(F.lit(1)).over(Window.partitionBy("kid", "hash").orderBy("kid", "hash").rowsBetween(Window.unboundedPreceding, 0))
    givers = texts.withColumn("no", once).where("no = 1").select(
        F.col("kid").alias("n_kid"), F.col("hash").alias("n_hash"), "packed", "size", F.col("fingerprint").alias("next_print"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 3, SLICE):
                heads = [t[: n // 3] for t, n in zip(unpacked(batch), batch.column("n_chars").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(heads, pa.string()), batch.column("next_print")], names=["kid", "hash", "n_chars", "head", "next_print"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2, SLICE):
                rows = zip(unpacked(batch), batch.column("n_chars").to_pylist(), batch.column("head").to_pylist())
                edited = [t[: n - n // 3] + head for t, n, head in rows]
                digest = pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], digest, batch.column("fingerprint"), prints(pa.array(edited, pa.string())), batch.column("next_print")],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_print"])

    asked = nexts.join(givers, ["n_kid", "n_hash"]).select("kid", "hash", "n_chars", "packed", "size", "next_print")
    heads = asked.mapInArrow(cut, "kid string, hash bigint, n_chars bigint, head string, next_print binary")
    doc_id = F.when(F.col("kid") != "null", F.col("kid")).cast("bigint").alias("doc_id")
    return texts.join(heads, ["kid", "hash"]).select(doc_id, "n_chars", "packed", "size", "head", "fingerprint", "next_print").mapInArrow(
        edit, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, next_print binary")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Texts travel
    compressed, with their fingerprints, which go to the next document as bytes and are spelled out at the end."""
    rows = with_edits(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")))
    # compared before they are spelled out: inside a lambda the names would mean the new columns
    compared = rows.withColumns({
        "near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_print"))})
    return compared.select("doc_id", "n_chars", "edited_sha256", *[F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")], "near_edited", "near_next")
