"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Every document is encoded once by both tokenizers and its ids are stored. The byte ranges of
its B tokens are a static interval index: as they lie end to end, their starts and their ends
are sorted, and two bisections per A token (the first B token that ends behind its start, the
first that starts at its end or later) list all that overlap it. An offset between two
neighbouring A tokens that no B token spans is a boundary of groups. Both bisections run for
all tokens of many documents at once, as the documents of a batch lie end to end, too.

The count of an id pair is the number of documents that hold it linked: distinct pairs per
document, summed in the task first, then by shuffle. Pairs at or above a threshold of their
counts, at most `max_broadcast`, go to all tasks; the occurrences of all others meet their
counts by shuffle, so every link has its count at every size.

Defined results: texts null or empty, and those whose tokens do not give back a blank and the
text (for example where the text has U+2581, which B takes for a blank), have no tokens: zeros
and an empty groups_sha256. Special strings inside texts are plain text. Rows are told apart
by number, so repeated and null ids need no rule; an empty table gives no rows; columns other
than doc_id and text are not looked at. No text is cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store, threshold
from .textvec import pieces

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Pairs that every task gets, at most: 17 bytes each.
MAX_BROADCAST = 1_000_000
#: Pairs that a task collects before it sums them.
GATHER = 500_000
#: Bits of a B id inside a pair.
SHIFT = 20
MASK = (1 << SHIFT) - 1


@lru_cache(maxsize=2)
def tokenizers(path_a: str | None, path_b: str | None):
    """Both encoders with the bytes of each of their tokens. The ranks of A are the vocabulary of
    its .json file; a test compares both libraries over all code points."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(path_a or public_tokenizers.path(VOCABULARY_A), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    a = tiktoken.Encoding("align", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bytes_a = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        bytes_a[rank] = token
    b = sentencepiece.SentencePieceProcessor(model_file=path_b or public_tokenizers.path(VOCABULARY_B))
    return a, bytes_a, b, [piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def encode(texts: list[str | None], a, bytes_a: list[bytes], b, bytes_b: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
    for text, ids_b in zip(texts, b.encode([t or "" for t in texts], num_threads=1)):
        if not text:
            yield [], []
            continue
        whole = " " + text
        ids_a, raw = a.encode_ordinary(whole), whole.encode()
        if b"".join(map(bytes_a.__getitem__, ids_a)) == raw == b"".join(map(bytes_b.__getitem__, ids_b)):
            yield ids_a, ids_b
        else:
            yield [], []


def encoded(docs: DataFrame, path_a: str | None, path_b: str | None) -> DataFrame:
    """row, doc_id and the ids of both tokenizers as 4-byte numbers, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(path_a, path_b)
        for batch in batches:
            for part in pieces(batch, 2):
                ids = [tuple(np.array(x, "<u4").tobytes() for x in pair) for pair in encode(part.column(2).to_pylist(), *tools)]
                sides = [pa.array([pair[k] for pair in ids], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sides], names=["row", "doc_id", "a", "b"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return store(rows.mapInArrow(run, "row bigint, doc_id bigint, a binary, b binary"))


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column end to end, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view("<u4").astype(np.int64), np.diff(offsets) // 4


class Aligned:
    """Links and groups of the tokens of a batch; both tokenizers' tokens cover the same bytes of each row.

    doc_a, doc_b: the row of each token; link_a, link_b: token numbers of each link;
    group_a, group_b: the group of each token, counted through the batch."""

    def __init__(self, a: np.ndarray, count_a: np.ndarray, b: np.ndarray, count_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b = a, b
        rows = np.arange(len(count_a))
        self.doc_a, self.doc_b = np.repeat(rows, count_a), np.repeat(rows, count_b)
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        start_a, start_b = end_a - size_a[a], end_b - size_b[b]
        first = np.searchsorted(end_b, start_a, "right")
        beyond = np.searchsorted(start_b, end_a, "left")
        per = beyond - first
        ends = np.cumsum(per)
        self.link_a = np.repeat(np.arange(len(a)), per)
        self.link_b = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - per, per) + np.repeat(first, per)
        # no B token spans the end of an A token if the first that starts there or later follows one that ends there
        self.closes = end_b[beyond - 1] == end_a if len(a) else np.zeros(0, bool)
        self.group_a = np.cumsum(self.closes) - self.closes
        self.group_b = np.searchsorted(end_a[self.closes], start_b, "right")

    def pairs(self) -> np.ndarray:
        return (self.a[self.link_a] << SHIFT) | self.b[self.link_b]

    def link_rows(self) -> np.ndarray:
        return self.doc_a[self.link_a]


@lru_cache(maxsize=2)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all ids below n, left-aligned with a free place behind, and their number."""
    text = np.arange(n).astype(f"S{len(str(n - 1))}")
    cells = np.zeros((n, text.dtype.itemsize + 1), np.uint8)
    cells[:, :-1] = text.view(np.uint8).reshape(n, -1)
    return cells, (cells != 0).sum(1)


def group_texts(x: Aligned, n_rows: int, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` of all rows end to end, as bytes, and where each row's begins (and the end)."""
    n_groups = int(x.closes.sum())
    in_a, in_b = np.bincount(x.group_a, minlength=n_groups), np.bincount(x.group_b, minlength=n_groups)
    before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
    at_a, at_b = np.arange(len(x.a)) + before_b[x.group_a], np.arange(len(x.b)) + upto_a[x.group_b]
    ids, sep, doc = (np.zeros(len(x.a) + len(x.b), t) for t in (np.int64, np.uint8, np.int64))
    last_b = np.append(x.group_b[1:] != x.group_b[:-1], True) if len(x.b) else np.zeros(0, bool)
    last_row = np.append(x.doc_b[1:] != x.doc_b[:-1], True) if len(x.b) else np.zeros(0, bool)
    ids[at_a], ids[at_b], doc[at_a], doc[at_b] = x.a, x.b, x.doc_a, x.doc_b
    sep[at_a] = np.where(x.closes, ord("|"), ord(","))
    sep[at_b] = np.where(last_row, 0, np.where(last_b, ord(";"), ord(",")))
    digits, width = decimals(n_ids)
    cells, width = digits[ids], width[ids]
    cells[np.arange(len(ids)), width] = sep
    used = np.arange(cells.shape[1]) < (width + (sep != 0))[:, None]
    begins = np.searchsorted(doc, np.arange(n_rows + 1))
    at = np.concatenate([[0], np.cumsum(width + (sep != 0))])
    return cells[used], at[begins]


def aligned(part: pa.RecordBatch, size_a: np.ndarray, size_b: np.ndarray) -> tuple[Aligned, np.ndarray, np.ndarray]:
    (a, count_a), (b, count_b) = numbers(part.column(2)), numbers(part.column(3))
    return Aligned(a, count_a, b, count_b, size_a, size_b), count_a, count_b


def sizes(path_a: str | None, path_b: str | None) -> tuple[np.ndarray, np.ndarray]:
    _, bytes_a, _, bytes_b = tokenizers(path_a, path_b)
    return np.array(list(map(len, bytes_a))), np.array(list(map(len, bytes_b)))


def pair_counts(ids: DataFrame, path_a: str | None, path_b: str | None) -> DataFrame:
    """pair, n (documents that hold it linked) and best (n is the highest of the pair's A id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sizes(path_a, path_b)
        held, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (held, counts * 0)
            both = np.union1d(held, pair)
            total = np.zeros(len(both), np.int64)
            total[np.searchsorted(both, held)] += counts
            total[np.searchsorted(both, pair)] += n
            return both, total

        for batch in batches:
            for part in pieces(batch, 2):
                x, _, _ = aligned(part, *size)
                pair, row = x.pairs(), x.link_rows()
                key = (row << (2 * SHIFT)) | pair  # a batch has fewer than 2^23 rows
                key.sort()
                new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
                waiting.append(key[new] & ((1 << (2 * SHIFT)) - 1))
                if sum(map(len, waiting)) > GATHER:
                    held, counts = merged()
                    waiting = []
                    if len(held) > GATHER:
                        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])
                        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])

    per = store(ids.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftright("pair", SHIFT).alias("a")
    top = per.groupBy(a).agg(F.max("n").alias("top"))  # as many rows as A has ids
    return per.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, *, path_a: str | None = None, path_b: str | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `path_a` names a vocabulary as ranks, `path_b` a sentencepiece model; both are opened on the executors."""
    spark = docs.sparkSession
    with small_batches(spark, 500):
        ids = encoded(docs, path_a, path_b)
        pairs = store(pair_counts(ids, path_a, path_b))
    least = threshold(pairs, "n", max_broadcast)
    often = pairs.where(F.col("n") >= least).toArrow().combine_chunks().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(often[c].to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sizes(path_a, path_b)
        known, count, best = shared.value
        for batch in batches:
            for part in pieces(batch, 2):
                n = part.num_rows
                x, count_a, count_b = aligned(part, *size)
                pair, row = x.pairs(), x.link_rows()
                at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
                found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                hit, where = row[found], at[found]
                totals = np.zeros(n, np.int64)
                np.add.at(totals, hit, count[where])
                rare = [[] for _ in range(n)], [[] for _ in range(n)]
                if not found.all():
                    left = np.stack([row[~found], pair[~found]])
                    for (r, p), t in zip(*map(np.ndarray.tolist, (lambda u, c: (u.T, c))(*np.unique(left, axis=1, return_counts=True)))):
                        rare[0][r].append(p)
                        rare[1][r].append(t)
                text, begins = group_texts(x, n, max(map(len, size)))
                text, begins = text.tobytes(), begins.tolist()
                digest = [hashlib.sha256(text[s:e]).hexdigest() if e > s else "" for s, e in zip(begins, begins[1:])]
                groups = np.bincount(x.doc_a[x.closes], minlength=n)
                longs = [count_a, count_b, groups, np.bincount(row, minlength=n), np.bincount(hit[best[where]], minlength=n), totals]
                lists = [pa.array(r, pa.list_(pa.int64())) for r in rare]
                arrays = [part.column(0), part.column(1), *(pa.array(v.astype(np.int64)) for v in longs), pa.array(digest, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kinds = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, rare array<bigint>, times array<bigint>"
    with small_batches(spark, 500):
        out = store(ids.mapInArrow(run, kinds))
    each = out.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    more = each.join(pairs.where(F.col("n") < least), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")
    )
    return out.join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
