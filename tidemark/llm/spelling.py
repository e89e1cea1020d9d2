"""Spelling variants: words of the corpus within one edit of each other, each with the form it
may be a misspelling of.

Words are maximal runs of letters, only A-Z in lower case; a run whose digest says so loses one
letter first (see `occurrences`). Words long and frequent enough are the vocabulary.

Near words come from a positional q-gram inverted index. With q - 1 pad signs on either side a
word of L letters has L + q - 1 q-grams. One edit touches at most q of them and shifts the
others by one place at most, so
- of two q-grams of a word that share no place, its near words keep at least one, at most one
  place away: every word looks up the postings of its two cheapest such grams, in the lists of
  its own length and of one letter less (the longer word of a pair asks, and both of equal length);
- two near words share at least max(L) - 1 q-grams at most one place apart: the merged postings
  are counted against this bound, and only pairs that reach it are verified by their letters.

A posting list is a cell of gram, place and length. Cell sizes are counted for all words in
2^20 hash classes, and this table of fixed size, not the words, goes to all tasks: it tells which
grams are cheap and into how many blocks a long list is cut. Postings and lookups meet by a
shuffle on the block; a task merges them as sorted arrays, block by block. Every pair comes out
once: where several grams bring it together, the first one counts.

A word's form is its near word of most occurrences (ties: smallest in code-point order) if that
has `ratio` times its own at least. Along forms occurrences grow by this factor, so roots
are found by a few doublings, as many as the largest count asks for.

Defined results: null and empty texts have no words; a null doc_id is digested as `null`; each
row counts, repeated ones, too; an empty table gives no rows; columns other than doc_id and
text are not looked at. No text is cut and no word or pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, store, text_of
from .textvec import mix

#: The runs that words come from, and the divisor of the digest.
RUN = r"[A-Za-zÀ-ÿ]+"
DIVISOR = 199
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
Q = 4
#: Hash classes of the table of cell sizes; postings of a block.
CLASSES = 1 << 20
BLOCK = 2048
#: Candidate pairs that a task looks at together.
PAIRS = 1 << 17


def occurrences(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """word: one row per run of the texts that is long enough. Where DIVISOR divides the crc32 of
    `doc_id:run`, the run loses its letter at crc32 mod length."""
    runs = F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0))
    long = F.filter(runs, lambda w: F.length(w) >= least)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(long).alias("run"))
    rows = rows.select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(h % DIVISOR == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    counts = occurrences(docs, least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


class Spelled:
    """Words of a batch as rows of code points of one width, zeros behind, with the q-grams of each.

    letters, size; gram[i, p]: hash of the q-gram of word i at place p."""

    def __init__(self, words: list[str], q: int = Q):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(self.size.max()) if len(words) else 0
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        inside = np.arange(self.width) < self.size[:, None]
        self.letters = np.zeros((len(words), self.width), np.uint32)
        self.letters[inside] = codes
        # pads: 1 before, 2 behind
        padded = np.full((len(words), self.width + 2 * (q - 1)), 2, np.uint64)
        padded[:, : q - 1] = 1
        padded[:, q - 1 : q - 1 + self.width] = np.where(inside, self.letters, 2)
        self.places = self.size + q - 1
        self.gram = np.zeros((len(words), self.width + q - 1), np.uint64)
        for j in range(q):
            self.gram = mix(self.gram * np.uint64(0x100000001B3) + padded[:, j : j + self.width + q - 1] + np.uint64(1))

    def used(self) -> np.ndarray:
        return np.arange(self.gram.shape[1]) < self.places[:, None]


def cell(gram: np.ndarray, place: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    """The posting list of a gram at a place in words of a size."""
    return mix(gram + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(size).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def classes(cells: np.ndarray) -> np.ndarray:
    return (cells >> np.uint64(44)).astype(np.int64)


def cell_sizes(words: DataFrame, q: int) -> np.ndarray:
    """Postings per hash class, of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            x = Spelled(batch.column(0).to_pylist(), q)
            row, place = np.nonzero(x.used())
            total += np.bincount(classes(cell(x.gram[row, place], place + 1, x.size[row])), minlength=CLASSES)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["class", "n"])

    counted = words.select("word").mapInArrow(run, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES, np.int64)
    out[counted["class"].to_numpy()] = counted["n"].to_numpy()
    return out


def probes(x: Spelled, cost: np.ndarray, q: int) -> np.ndarray:
    """Places of the two grams of each word that share no place and whose postings are fewest together."""
    n, width = x.gram.shape
    price = np.zeros((n, width), np.int64)
    for less in (0, 1):
        for shift in (-1, 0, 1):
            price += cost[classes(cell(x.gram, np.arange(width) + shift + 1, (x.size - less)[:, None]))]
    price[~x.used()] = 1 << 60
    best_so_far = np.minimum.accumulate(price, axis=1)
    pair = price[:, q:] + best_so_far[:, : width - q]
    second = pair.argmin(1) + q
    before = np.where(np.arange(width) <= (second - q)[:, None], price, 1 << 61)
    return np.stack([before.argmin(1), second], axis=1)


def index_rows(words: DataFrame, cost: np.ndarray, q: int, block: int) -> DataFrame:
    """Rows of the index (ask = -1) and lookups of it (ask: number of the gram and shift, 0 to 5) by block.

    The table of cells has places counted from 1, so that place 0 stands for one before the first."""
    shared = words.sparkSession.sparkContext.broadcast(cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = Spelled(batch.column(0).to_pylist(), q)
                own = mix(x.letters.astype(np.uint64) @ mix(np.arange(1, x.width + 1, dtype=np.uint64)))
                row, place = np.nonzero(x.used())
                c = cell(x.gram[row, place], place + 1, x.size[row])
                parts = 1 + size[classes(c)] // block
                out = [(row, c, (own[row] % parts.astype(np.uint64)).astype(np.int64), np.full(len(row), -1), place)]
                chosen = probes(x, size, q)
                every = np.arange(len(x.size))
                for k in (0, 1):
                    for shift in (-1, 0, 1):
                        for less in (0, 1):
                            c = cell(x.gram[every, chosen[:, k]], chosen[:, k] + shift + 1, x.size - less)
                            parts = np.where(size[classes(c)] > 0, 1 + size[classes(c)] // block, 0)
                            r = np.repeat(every, parts)
                            no = np.arange(len(r)) - np.repeat(np.cumsum(parts) - parts, parts)
                            # both grams' places travel, to tell which lookup finds a pair first
                            out.append((r, c[r], no, np.full(len(r), 3 * k + shift + 1), chosen[r, 0] * 256 + chosen[r, 1]))
                r, c, no, ask, place = map(np.concatenate, zip(*out))
                key = mix(c + no.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ask.astype(np.int32)), pa.array(place.astype(np.int32)), batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r))],
                    names=["key", "ask", "place", "word", "n"],
                )

    return words.mapInArrow(run, "key bigint, ask int, place int, word string, n bigint")


def shared_grams(x: Spelled, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many q-grams of words i stand in words j, at most one place away."""
    a, b = x.gram[i], x.gram[j]
    alive = x.used()
    live = alive[i]
    b = np.where(alive[j], b, 0)
    hit = (a == b) & live
    hit[:, 1:] |= (a[:, 1:] == b[:, :-1]) & live[:, 1:]
    hit[:, :-1] |= (a[:, :-1] == b[:, 1:]) & live[:, :-1]
    return hit.sum(1)


def one_edit(x: Spelled, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j differ by exactly one edit; word i has as many letters as j or one more."""
    a, b = x.letters[i], x.letters[j]
    same = a == b
    head = np.logical_and.accumulate(same, axis=1).sum(1)
    moved = np.zeros_like(same)
    moved[:, 1:] = a[:, 1:] == b[:, :-1]  # j against i without the letter behind the head
    place = np.arange(a.shape[1])
    replaced = (same | (place <= head[:, None])).all(1) & (head < x.size[i])
    deleted = (moved | (place <= head[:, None])).all(1)
    return np.where(x.size[i] == x.size[j], replaced, deleted)


def near_in(block: pa.RecordBatch, q: int) -> pa.RecordBatch:
    """Near pairs of complete blocks: word, n, other, other_n, the asking word first."""
    key, ask, place = (block.column(c).to_numpy() for c in (0, 1, 2))
    listed = np.flatnonzero(ask < 0)
    listed = listed[np.argsort(key[listed], kind="stable")]
    asks = np.flatnonzero(ask >= 0)
    start, stop = np.searchsorted(key[listed], key[asks], "left"), np.searchsorted(key[listed], key[asks], "right")
    asks, start, per = asks[stop > start], start[stop > start], (stop - start)[stop > start]
    found_i, found_j = [], []
    if len(asks):
        words = block.column(3).to_pylist()
        x = Spelled(words, q)
        ends = np.cumsum(per)
        at = 0
        while at < len(asks):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = per[at:to]
            i = np.repeat(asks[at:to], n)
            j = listed[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:to], n)]
            at = to
            lower = x.size[i] - x.size[j]
            ok = (lower == 1) | ((lower == 0) & (i != j))
            i, j = i[ok], j[ok]
            ok = shared_grams(x, i, j) >= x.size[i] - 1
            i, j = i[ok], j[ok]
            ok = one_edit(x, i, j)
            i, j = i[ok], j[ok]
            first, step = np.full(len(i), 9), ask[i] % 3 - 1
            for turn in range(5, -1, -1):  # the first lookup that brings the pair together
                p = place[i] // 256 if turn < 3 else place[i] % 256
                t = p + turn % 3 - 1
                inside = (t >= 0) & (t < x.places[j])
                hit = inside & (x.gram[j, np.clip(t, 0, x.gram.shape[1] - 1)] == x.gram[i, p])
                first[hit] = turn
            found_i.append(i[first == ask[i]])
            found_j.append(j[first == ask[i]])
    i, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_i, found_j))
    # words of equal length ask for each other: the smaller one's row stays
    if len(i):
        texts = np.array(words, dtype=object)
        ok = (x.size[i] > x.size[j]) | (texts[i] < texts[j])
        i, j = i[ok], j[ok]
    i, j = pa.array(i), pa.array(j)
    return pa.RecordBatch.from_arrays([block.column(3).take(i), block.column(4).take(i), block.column(3).take(j), block.column(4).take(j)], names=["word", "n", "other", "other_n"])


def near_pairs(words: DataFrame, *, q: int = Q, block: int = BLOCK) -> DataFrame:
    """word, n, other, other_n: each pair of words one edit apart, in one row."""
    rows = index_rows(words, cell_sizes(words, q), q, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = [], 0
        for batch in batches:
            held.append(batch)
            kept += batch.num_rows
            last = batch.column(0)[-1].as_py() if batch.num_rows else None
            if kept < 20_000 or batch.column(0)[0].as_py() == last:
                continue
            # blocks come in order, so all but the last one are complete
            cut = int(np.searchsorted(batch.column(0).to_numpy(), last, "left"))
            held[-1] = batch.slice(0, cut)
            yield near_in(pa.Table.from_batches(held).combine_chunks().to_batches()[0], q)
            held, kept = [batch.slice(cut)], batch.num_rows - cut
        if kept:
            yield near_in(pa.Table.from_batches(held).combine_chunks().to_batches()[0], q)

    sharded = rows.repartition("key").sortWithinPartitions("key")
    return sharded.mapInArrow(run, "word string, n bigint, other string, other_n bigint")


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """word, root from (word, form): forms followed to their end, doubling the way each time."""
    way = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(1 + math.log(max(2, most), ratio))))):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        way = store(way.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return way


def variants(docs: DataFrame, *, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = store(vocabulary(docs, least_letters, least_count))
    pairs = store(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best: Column = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = store(both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best.alias("best")))
    fits = -F.col("best.less") >= ratio * F.col("n")
    forms = near.where(fits).select("word", F.col("best.form").alias("form"))
    most = words.agg(F.max("n")).first()[0] or 0
    joined = words.join(near.select("word", "n_near", F.when(fits, F.col("best")).alias("best")), "word", "left").join(roots(forms, most, ratio), "word", "left")
    return joined.select(
        "word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), (-F.col("best.less")).alias("form_n"),
    )


ORACLE = """
WITH RECURSIVE bits AS (
  SELECT 0 AS step, i AS byte, i::BIGINT AS v FROM range(256) r(i)
  UNION ALL
  SELECT step + 1, byte, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE step < 8
), crc AS (
  SELECT list(v ORDER BY byte) AS t FROM bits WHERE step = 8
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6
), tallied AS (
  SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS raw FROM runs GROUP BY ALL
), digested AS (
  SELECT run, k, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(raw) // 2), lambda i: ('0x' || substr(raw, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM tallied, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM digested GROUP BY 1 HAVING sum(k) >= 5 AND length(word) >= 6
), cuts AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
), near AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, other)) AS form FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN x.form_n >= 5 * w.n THEN x.form END AS form, CASE WHEN x.form_n >= 5 * w.n THEN x.form_n END AS form_n
  FROM words w LEFT JOIN near x USING (word)
), walk AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT k.word, k.root FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NULL
)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM formed f LEFT JOIN ends e USING (word)
"""
