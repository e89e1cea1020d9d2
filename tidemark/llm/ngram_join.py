"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts in lower case (A-Z) are sets of distinct five-word shingles, as 64-bit hashes; two
link when 100 * |intersection| >= 75 * |union|. Equal sets are one class, so copies never
meet each other. A set x of n shingles needs at least a = ceil(0.75 n) common ones, so with
any global order and any number l a partner must share l shingles of the first n - a + l.
Each set takes the l whose estimated cost (postings to read, candidates to verify) is
least; a pair needs the smaller l of the two. The order is by estimated frequency, so very
frequent shingles (shared passages) come last.

Steps, each a Spark job on tables in the shared folder:
  1. one pass gives each document's class with a parity signature of its set, and the
     shingles frequent within a chunk
  2. one pass gives the postings (shingle, class, l) of the prefixes; only shingles of
     two classes or more are kept
  3. each class is verified against one centre: of the first classes of its posting lists
     (those with most frequent shingles in their prefix) the one it shares most with. This
     joins groups of near copies by stars instead of by all their pairs
  4. what the links so far do not join is paired in full: pairs of different components
     that share enough prefix shingles, at places that leave room for the rest, and whose
     signatures allow a link, are verified
A signature has one bit for each of `BITS` groups of shingles: whether the set has an odd number
of them. Each shingle of one set alone flips one bit, so sets with more different bits than
a link leaves room for cannot link: an exact filter, which spares reading most texts again.
No list, candidate or partner is capped. Estimates steer cost alone, never the result.

Comparisons in step 4 grow with the square of the number of texts that share most of their shingles
without linking (a family of edited copies just below the threshold); each is some bit counts
inside the join, and only those that pass become rows.

Defined results: a null or empty text has an empty set, is linked with nothing and is its
own component; equal rows are linked; a null doc_id takes part and has no own number (its
component is the smallest non-null id it reaches, else null). Different sets share a class
number with odds of 1 in 2^64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, small_batches, store, threshold
from .components import merged
from .textvec import Words, mix, pieces, shingles

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 75
#: Shingles whose frequency is known to the order at most (16 bytes each).
MAX_FREQUENT = 1_000_000
#: Shingles seen together when frequent ones are looked for.
CHUNK = 2_000_000
MAX_MATCHES = 16
#: Other classes that a shingle without a known frequency is taken to meet.
CHANCE = 0.1
#: Further rounds of stars, which verify only pairs that share 1 of so many shingles of the smaller set in their prefixes.
ROUNDS, STAR_SHARE = 1, 20
#: Bits of a signature.
BITS = 1024
#: Documents to read again whose keys (two numbers each) may be broadcast; beyond, they are joined by shuffle.
MAX_BROADCAST = 1_000_000
#: Postings of a frequent shingle that one group of a list holds, about.
LIST_PART = 20_000
#: Bytes of text that are split and hashed together.
PIECE = 1 << 18


def _class(s: np.ndarray) -> int:
    return int(mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BITS / 64 numbers per set."""
    cell = np.concatenate([(s >> np.uint64(20)).astype(np.int64) % BITS + i * BITS for i, s in enumerate(sets)])
    odd = np.bincount(cell, minlength=len(sets) * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sets), BITS // 64)


def _signatures(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """kind 0: a document's class, its size and signature; kind 1: shingles of two different sets of a chunk or more."""
    held: list[np.ndarray] = []
    seen: set[int] = set()
    total = 0
    lists = pa.list_(pa.int64())

    def frequent() -> pa.RecordBatch:
        t, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
        t, c = t[c > 1].view(np.int64), c[c > 1]
        n = len(t)
        null = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), null, null, null, pa.array(t), pa.array(c.astype(np.int64)), pa.nulls(n, lists)], names=names)

    names = ["kind", "doc_id", "digest", "n", "id", "count", "sig"]
    for batch in (part for whole in batches for part in pieces(whole, 1, PIECE)):
        sets = shingles(Words(batch.column(1)), SHINGLE)
        ids = [_class(s) for s in sets]
        n = len(ids)
        sig = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (BITS // 64)), pa.array(signatures(sets).ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(ids, pa.int64()), pa.nulls(n, pa.int64()), sig], names=names)
        for i, s in zip(ids, sets):
            if i not in seen:
                seen.add(i)
                held.append(s)
                total += len(s)
        if total > chunk:
            yield frequent()
            held, total = [], 0
            seen = set()
    yield frequent()


def matches(df: np.ndarray, n: int, need: int) -> int:
    """The number of common shingles to ask for, from the frequencies of a set in order.

    Asking for k costs k further postings of its own, the postings that these meet, and the
    candidates: each takes k of the postings met, and verifying one costs its shingles."""
    free = n - need
    met = np.cumsum(df[: free + MAX_MATCHES], dtype=np.float64)
    met += CHANCE * np.arange(1, len(met) + 1)
    k = np.arange(1, min(MAX_MATCHES, need) + 1)
    met = met[free : free + len(k)]
    return int(np.argmin(k + met + met / k * (1 + n / 16))) + 1


def _postings(batches: Iterator[pa.RecordBatch], percent: int, list_part: int, shared) -> Iterator[pa.RecordBatch]:
    token, count = shared.value
    seen: set[int] = set()
    for batch in (part for whole in batches for part in pieces(whole, 0, PIECE)):
        sets = shingles(Words(batch.column(0)), SHINGLE)
        out: list[tuple] = []
        for s in sets:
            n = len(s)
            if not n or (i := _class(s)) in seen:
                continue
            seen.add(i)
            need = -(-percent * n // 100)
            df = np.zeros(n, np.int64)
            if len(token):
                at = np.searchsorted(token, s)
                at[at == len(token)] = 0
                df = np.where(token[at] == s, count[at], 0)
                if df.any():
                    order = np.argsort(df, kind="stable")
                    s, df = s[order], df[order]
            ell = matches(df, n, need)
            p = n - need + ell
            often = int(np.count_nonzero(df[:p]))
            part = np.where(df[:p] > list_part, 1 + i % (1 + df[:p] // list_part), 0).astype(np.int32)
            row = (np.full(p, i, np.int64), np.arange(p, dtype=np.int32), *(np.full(p, v, np.int32) for v in (n, ell, often)))
            out.append((s[:p], part, *row))
        if out:
            t, part, i, pos, n, ell, often = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.view(np.int64)), *map(pa.array, (part, i, pos, n, ell, often))], names=["token", "part", "id", "pos", "n", "ell", "often"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole, 0, PIECE)):
        sets = shingles(Words(batch.column(0)), SHINGLE)
        offsets = np.zeros(len(sets) + 1, np.int32)
        np.cumsum([len(s) for s in sets], out=offsets[1:])
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))],
            names=["key", "id", "tokens"])


def similar(a: Column, b: Column, both: Column, percent: int) -> Column:
    return 100 * both >= percent * (a + b - both)


def differ(a: Column, b: Column) -> Column:
    """The number of bits in which two signatures differ: at most the number of shingles that one set alone has."""
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(BITS // 64)])


def may_link(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether signatures leave room for a link: |intersection| >= percent * (na + nb) / (100 + percent)."""
    return differ(a, b) <= na + nb - 2 * F.ceil(percent * (na + nb) / (100 + percent))


def _sets_of(asked: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, tokens) for rows (key, id): one document of each class asked for is read again,
    and goes out once per key straight from where it was read."""
    wanted = store(classes.join(asked, "id").select("digest", "doc_id", "key", "id").toDF("g", "i", "key", "id"))
    if wanted.count() <= MAX_BROADCAST:  # four numbers a row
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, (F.xxhash64("text") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("i")))
    return texts.select("text", "key", "id").mapInArrow(_sets, "key bigint, id bigint, tokens array<bigint>")


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets link; a pair may come twice where a row of docs does."""
    side = lambda c, n: classes.select(F.col("id").alias(c), F.col("n").alias(f"n{n}"), F.col("sig").alias(f"sig{n}"))
    able = pairs.join(side("x", 1), "x").join(side("y", 2), "y").where(may_link(F.col("sig1"), F.col("sig2"), F.col("n1"), F.col("n2"), percent))
    pairs = store(able.select("x", "y"))
    heads = _sets_of(pairs.select(F.col("x").alias("key"), F.col("x").alias("id")).distinct(), docs, classes)
    members = _sets_of(pairs.select(F.col("x").alias("key"), F.col("y").alias("id")), docs, classes)
    whole = members.join(heads.select("key", F.col("tokens").alias("head")), "key")
    both = F.size(F.array_intersect("tokens", "head"))
    return store(whole.where(similar(F.size("tokens"), F.size("head"), both, percent)).select(F.col("key").alias("x"), F.col("id").alias("y")))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _reach(n: Column, ell: Column, percent: int) -> Column:
    """Of the smaller set of a pair, the prefix that has `ell` of the common ones: it has at least as many as with a set of its own size."""
    return n - F.ceil(2 * percent * n / (100 + percent)) + ell


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, chunk: int = CHUNK, list_part: int = LIST_PART, star_share: int = STAR_SHARE) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable) and
    n_links (other classes that its text was found linked with: a star has them all at its
    centre, as links inside a component are not looked for once it is joined)."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, percent, chunk, list_part, star_share)


def _near_duplicates(docs: DataFrame, percent: int, chunk: int, list_part: int, star_share: int) -> DataFrame:
    spark = docs.sparkSession
    signed = store(
        docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(
            lambda it: _signatures(it, chunk), "kind int, doc_id bigint, digest bigint, n bigint, id bigint, count bigint, sig array<bigint>")
    )
    frequent = store(signed.where("kind = 1").groupBy("id").agg(F.sum("count").alias("c")))
    frequent = frequent.where(F.col("c") >= threshold(frequent, "c", MAX_FREQUENT)).toArrow()
    token, often = (frequent.column(c).to_numpy() for c in ("id", "c"))
    token = token.astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    shared = spark.sparkContext.broadcast((token[order], often.astype(np.int64)[order]))

    posted = docs.select("text").mapInArrow(
        lambda it: _postings(it, percent, list_part, shared), "token bigint, part int, id bigint, pos int, n int, ell int, often int")
    # a posting can only count if the list has a set of fitting size next to its own in order of size;
    # beyond the place where a pair's smaller set has its common ones it counts for smaller sets alone
    lists = Window.partitionBy("token", "part")
    by_size = lists.orderBy("n")
    n, before, after = F.col("n"), F.lag("n").over(by_size), F.lead("n").over(by_size)
    fits = lambda a, b: F.coalesce(100 * a >= percent * b, F.lit(False))
    inside = F.col("pos") < _reach(n, F.col("ell"), percent)
    live = store(
        posted.withColumn("fits", (F.col("part") > 0) | fits(before, n) | (fits(n, after) & (inside | (n == after)))).where("fits")
        .withColumn("head", F.min(F.struct(-F.col("often"), F.col("id"), F.col("n"))).over(lists))
        .withColumn("lo", F.min("id").over(lists)).withColumn("hi", F.max("id").over(lists))
        .where("lo <> hi or part > 0")
        .select("token", "part", "id", "pos", "n", "ell", F.col("head.id").alias("head"), F.col("head.n").alias("head_n"))
        .dropDuplicates(["token", "part", "id"])
    )
    shared.unpersist()
    classes = signed.where("kind = 0 and n > 0").groupBy("id").agg(F.min(F.struct("digest", "doc_id", "n", "sig")).alias("d")).select("id", "d.*")
    classes = store(classes)

    # the heads of a list's parts are a list of their own
    heads = live.where("part > 0").select("token", "head", "head_n").distinct()
    across = heads.groupBy("token").agg(F.min(F.struct("head", "head_n")).alias("h"))
    candidates = live.select(F.col("head").alias("x"), F.col("head_n").alias("nx"), F.col("id").alias("y"), F.col("n").alias("ny")).unionByName(
        heads.join(across, "token").select(F.col("h.head").alias("x"), F.col("h.head_n").alias("nx"), F.col("head").alias("y"), F.col("head_n").alias("ny"))
    )

    def best(candidates: DataFrame) -> DataFrame:
        """Of each class the centre that it shares most with."""
        fit = candidates.where((F.col("x") != F.col("y")) & _sizes_fit(F.col("nx"), F.col("ny"), percent))
        often = fit.groupBy("x", "y", F.least("nx", "ny").alias("n")).agg(F.count("*").alias("shared")).where(star_share * F.col("shared") >= F.col("n"))
        return often.groupBy("y").agg(F.max(F.struct("shared", "x")).alias("b")).select("b.x", "y")

    tried = store(best(candidates))
    links = _verify(tried, docs, classes, percent)
    joined = merged(None, links)

    def mixed(joined: DataFrame) -> DataFrame:
        """Postings of the lists that hold several components, with their labels."""
        at = live.join(joined.withColumnRenamed("node", "id"), "id", "left").select(
            "token", "id", "pos", "n", "ell", F.coalesce("label", "id").alias("label"))
        several = at.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
        return store(at.join(several, "token", "left_semi"))

    # another star, with other centres: nearly every group of near copies is one component then
    rest = mixed(joined)
    for turn in range(ROUNDS):
        centre = rest.groupBy("token").agg(F.min_by(F.struct("id", "n", "label"), F.xxhash64("id", F.lit(turn))).alias("c"))
        more = rest.join(centre, "token").where(F.col("label") != F.col("c.label")).select(
            F.col("c.id").alias("x"), F.col("c.n").alias("nx"), F.col("id").alias("y"), F.col("n").alias("ny"))
        more = store(best(more).join(tried, ["x", "y"], "left_anti"))
        tried = tried.unionByName(more)
        found = _verify(more, docs, classes, percent)
        links = links.unionByName(found)
        joined = merged(joined, found)
        rest = mixed(joined)
    # lists that still hold several components: all their pairs across components
    signs = classes.select("id", "sig")
    rest = rest.join(signs, "id").select("token", "id", "pos", "n", "ell", "label", "sig")
    other = rest.select("token", *[F.col(c).alias(c + "2") for c in ("id", "pos", "n", "ell", "label", "sig")])
    early = F.when(F.col("n") >= F.col("n2"), F.col("pos2") < _reach(F.col("n2"), F.col("ell2"), percent)).otherwise(F.col("pos") < _reach(F.col("n"), F.col("ell"), percent))
    able = may_link(F.col("sig"), F.col("sig2"), F.col("n"), F.col("n2"), percent)
    pairs = (
        rest.join(other, (rest["token"] == other["token"]) & (F.col("label") < F.col("label2")) & _sizes_fit(F.col("n"), F.col("n2"), percent) & early & able)
        .groupBy("id", "id2", "n", "n2", F.least("ell", "ell2").alias("least"))
        .agg(F.count("*").alias("shared"), F.max("pos").alias("last"), F.max("pos2").alias("last2"))
    )
    # every other common shingle comes after the last shared one, in both
    most = F.col("shared") + F.least(F.col("n") - 1 - F.col("last"), F.col("n2") - 1 - F.col("last2"))
    fit = (F.col("shared") >= F.col("least")) & similar(F.col("n"), F.col("n2"), most, percent)
    done = tried.unionByName(tried.select(F.col("y").alias("x"), F.col("x").alias("y")))
    pairs = store(pairs.where(fit).select(F.least("id", "id2").alias("x"), F.greatest("id", "id2").alias("y")).join(done, ["x", "y"], "left_anti"))
    if not pairs.isEmpty():
        found = _verify(pairs, docs, classes, percent)
        links = links.unionByName(found)
        joined = merged(joined, found)

    ends = links.distinct()
    degree = ends.select(F.col("x").alias("id")).unionByName(ends.select(F.col("y").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    member = signed.where("kind = 0").select("id", "doc_id", "n")
    own_id = member.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("lowest"))
    in_group = store(joined.withColumnRenamed("node", "id").join(own_id, "id"))
    lowest = store(in_group.groupBy("label").agg(F.min("lowest").alias("component_id")))
    named = store(in_group.join(lowest, "label").join(degree, "id", "left").select("id", F.col("component_id").alias("c"), "n_links"))
    per_class = own_id.join(named, "id", "left").select("id", F.when(F.col("n_links").isNull(), F.col("lowest")).otherwise(F.col("c")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    full = member.where("n > 0").join(per_class, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    empty = member.where("n = 0").select(
        "doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id (a null id is
    the largest), then digest of the text, then row number. Rows are told apart by number, so
    repeated and null ids need no rule of their own; documents without words stay."""
    number = free_name(docs, "_row")
    rows = store(docs.withColumn(number, F.monotonically_increasing_id()))
    marked = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), percent=percent).where("n_shingles > 0")
    key = rows.select(F.col(number).alias("r"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(number).alias("r")).alias("k"))
    group = store(marked.select(F.col("doc_id").alias("r"), "component_id").join(key, "r"))
    first = group.groupBy("component_id").agg(F.min("k").alias("k")).select(F.col("k.r").alias("r"))
    gone = group.select("r").join(first, "r", "left_anti").select(F.col("r").alias(number))
    return rows.join(store(gone), number, "left_anti").drop(number)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * inter >= 75 * (a.n + b.n - inter)
), r AS (
  SELECT doc_id, doc_id AS c FROM w UNION SELECT l.x, r.c FROM r JOIN l ON l.y = r.doc_id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
