"""Toxicity by a support vector machine with a gap-weighted subsequence string kernel.

The kernel compares words by their common subsequences, so inserted characters, endings and
small changes keep an insult near its landmark. Training is multiple-instance: of a sentence
that counts as toxic its most telling word is the witness, of clean sentences every word
counts. Landmarks and training words come from counts over labelled sentences, collected by
Spark; scoring runs the machine on the distinct words of each batch, and a text keeps its
three largest word margins and the number of distinct words above 0. A logistic curve over
these, fitted on training texts, makes them a score.

Units: words (A-Z in lower case, without punctuation at their ends); words of over `LENGTH` bytes in overlapping parts; runs of
four or more one-letter words, joined. Every word of a text is looked at.

Defined results: a null or empty text has the lowest margin and is not toxic; without labels of
both kinds every score is 0; a document with several labels is toxic if one says so; rows are scored one by one, so repeated rows, null ids and extra
columns need no rule. Ties among candidate words go to the word itself, in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of, words
from .string_kernel import LENGTH, KernelMachine
from .textvec import _ALNUM, _LOWER, Words, mix, pieces

FOLDS = 5
#: Labelled training rows (smallest hash of the id), witness words, other words, landmarks of either kind, at most.
MAX_LABELLED, MAX_WITNESSES, MAX_OTHERS, LANDMARKS, FOILS = 20_000, 600, 2_400, 260, 60
#: Hashes of words whose margins a worker remembers at most.
MAX_KNOWN = 2_000_000
#: Punctuation at the ends of a word.
EDGES = r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+$"
#: Margins are kept inside these bounds.
LOWEST, HIGHEST = -1.5, 2.5


def remainder(doc_id: Column | str = "doc_id", folds: int = FOLDS) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def matrix(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), LENGTH), np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t[:LENGTH], np.uint8)
    return out[:, : max(1, int((out > 0).any(0).sum()))]


def training_words(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, list, int, int]:
    """Counts of all words of labelled texts, (word, toxic texts, clean texts) of words that tell,
    and the number of texts of each kind.

    A sentence is a line or ends with a full stop; a word counts once per labelled text."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & (remainder() != 0))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return None, [], n1, n0
    sentences = rows.select("toxic", F.split(ascii_lower(text_of()), r"[\n.]").alias("s"))
    each = sentences.select("toxic", F.explode_outer(F.array_distinct(F.flatten(F.transform("s", lambda s: words(s))))).alias("word"))
    each = each.select("toxic", F.regexp_replace("word", EDGES, "").alias("word")).where("word <> ''")
    counts = each.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    rate = F.log((F.col("bad") + 0.1) / n1) - F.log((F.col("good") + 0.1) / n0)
    least = max(3, n1 // 1000)
    counts = counts.withColumn("gain", F.col("bad") * rate).withColumn("rate", rate).persist()
    tell = counts.where((F.col("bad") >= least) & (F.col("rate") > 2.5)).orderBy(F.desc("gain"), "word").limit(MAX_WITNESSES)
    good = [(r["word"].encode(), r["bad"], r["good"]) for r in tell.collect()]
    return counts, good, n1, n0


def train(docs: DataFrame, labels: DataFrame) -> KernelMachine | None:
    counts, good, n1, n0 = training_words(docs, labels)
    good = [g for g in good if len(g[0]) >= 3]
    if not good:
        return None
    first = KernelMachine(matrix([g[0] for g in good[:LANDMARKS]]))
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode()[:LENGTH] for x in batch.column(0).to_pylist()]
            k = shared.value.features(matrix(texts), raw=True).max(1) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k.astype(np.float64))], names=["word", "good", "k"])

    rows = counts.where("good > 0").select("word", "good").mapInArrow(near, "word string, good bigint, k double")
    rows = rows.orderBy(F.desc(F.col("k") * F.log(F.col("good") + 1.0)), "word").limit(MAX_OTHERS).collect()
    counts.unpersist()
    bad = [(r["word"].encode()[:LENGTH], r["good"]) for r in rows]
    machine = KernelMachine(matrix([g[0] for g in good[:LANDMARKS]] + [w for w, _ in bad[:FOILS]]))
    # a word of toxic texts is a witness as often as it stands there; one of clean texts is surely none
    w1 = np.array([float(b) for _, b, _ in good])
    w0 = np.array([max(0.3, 2.0 * n * n1 / n0) for _, n in bad])
    machine.fit(
        matrix([g[0] for g in good] + [w for w, _ in bad]), np.r_[np.ones(len(good)), -np.ones(len(bad))], np.minimum(np.r_[w1, w0], 50.0) / 5)
    return machine


def strip(w: Words) -> None:
    """Takes punctuation off the ends of words; words of nothing else stay."""
    inner = np.flatnonzero(_ALNUM[w.buf])
    first = np.searchsorted(inner, w.start)
    last = np.searchsorted(inner, w.end) - 1
    has = last >= first
    w.start[has], w.end[has] = inner[first[has]], inner[last[has]] + 1


def units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """start, end of the parts of words that are compared, and the text of each."""
    strip(w)
    size = w.end - w.start
    extra = np.maximum(0, -(-(size - LENGTH) // (LENGTH // 2)))
    part = np.arange(int((extra + 1).sum())) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
    start = np.repeat(w.start, extra + 1) + part * (LENGTH // 2)
    end = np.minimum(start + LENGTH, np.repeat(w.end, extra + 1))
    return start, end, np.repeat(w.doc, extra + 1)


class Scorer:
    """Largest margin per text; remembers the margins of words by hash."""

    def __init__(self, machine: KernelMachine):
        self.machine = machine
        self.known, self.margins = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def spaced(self, w: Words) -> list[tuple[int, bytes]]:
        """Runs of four or more one-letter words of a text, joined."""
        one = (w.end - w.start) == 1
        edge = np.flatnonzero(np.diff(np.r_[False, one, False].astype(np.int8)))
        out = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= 4:
                at = a
                while at < b:  # a run ends where its text does
                    to = min(b, int(w.first[w.doc[at] + 1]))
                    joined = _LOWER[w.buf[w.start[at:to]]].tobytes()
                    step = LENGTH // 2
                    out += [(int(w.doc[at]), joined[i : i + LENGTH]) for i in range(0, max(1, len(joined) - step), step)] if to - at >= 4 else []
                    at = to
        return out

    def features_of(self, texts: pa.Array) -> np.ndarray:
        """Three largest margins and log(1 + distinct words above 0), per text."""
        w = Words(texts)
        out = np.full((len(w.count), 4), LOWEST, np.float32)
        out[:, 3] = 0
        if not len(w.start):
            return out
        w.start, w.end, doc = units(w)
        h = w.hashes()
        u, first, at = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, u)
        place[place == len(self.known)] = 0
        hit = self.known[place] == u if len(self.known) else np.zeros(len(u), bool)
        m = np.zeros(len(u), np.float32)
        m[hit] = self.margins[place[hit]]
        new = first[~hit]
        if len(new):
            size = (w.end - w.start)[new]
            grid = w.start[new][:, None] + np.arange(int(size.max()))
            x = np.where(np.arange(int(size.max())) < size[:, None], _LOWER[w.buf[np.minimum(grid, len(w.buf) - 1)]], 0).astype(np.uint8)
            m[~hit] = self.machine.margin(x)
            if len(self.known) > MAX_KNOWN:
                self.known, self.margins = u, m
            else:
                keys, values = np.concatenate([self.known, u[~hit]]), np.concatenate([self.margins, m[~hit]])
                order = np.argsort(keys)
                self.known, self.margins = keys[order], values[order]
        m = np.clip(m, LOWEST, HIGHEST)
        keep = np.flatnonzero(m[at] > LOWEST / 2)
        pairs = np.unique(np.stack([doc[keep], at[keep]], 1), axis=0) if len(keep) else np.zeros((0, 2), np.int64)
        d, v = pairs[:, 0], m[pairs[:, 1]]
        runs = self.spaced(Words(texts))
        if runs:
            d = np.r_[d, [x for x, _ in runs]].astype(np.int64)
            v = np.r_[v, np.clip(self.machine.margin(matrix([x for _, x in runs])), LOWEST, HIGHEST)]
        order = np.lexsort((-v, d))
        d, v = d[order], v[order]
        rank = np.arange(len(d)) - np.searchsorted(d, d)
        top = rank < 3
        out[d[top], rank[top]] = v[top]
        out[:, 3] = np.log1p(np.bincount(d[v > 0], minlength=len(out)))
        return out


_SCORERS: dict = {}


def margins(docs: DataFrame, machine: KernelMachine, *keep: str) -> DataFrame:
    """The columns in keep and m (the text's features)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    name = int(mix(np.frombuffer(machine.w.tobytes() + bytes(-len(machine.w.tobytes()) % 8), np.uint64).copy()).sum(dtype=np.uint64))
    schema = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes) + ", m array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        for batch in batches:
            for part in pieces(batch, 0, 2 << 20):
                m = scorer.features_of(part.column(0))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], flat], names=[*keep, "m"])

    return docs.select(text_of().alias("text"), *keep).mapInArrow(run, schema)


def calibrate(features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a logistic curve, by Newton steps with a little shrinkage."""
    x = np.c_[features, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w -= np.linalg.solve(hess, g)
    return w


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted."""
    machine = train(docs, labels)
    held = (remainder() == 0).alias("held_out")
    if machine is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    chosen = (
        labels.where(F.col("toxic").isNotNull() & (remainder() != 0))
        .groupBy(F.col("doc_id").alias("i")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("i"), "i").limit(MAX_LABELLED // 4)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("i")).select("text", "toxic")
    seen = margins(sample, machine, "toxic").toPandas()
    w = calibrate(np.array(seen["m"].tolist(), np.float64).reshape(-1, 4), seen["toxic"].to_numpy(np.float64))
    line = F.lit(float(w[-1]))
    for i, x in enumerate(w[:-1]):
        line = line + F.lit(float(x)) * F.col("m")[i].cast("double")
    out = margins(docs.select("doc_id", "text"), machine, "doc_id").select("doc_id", held, (1 / (1 + F.exp(-line))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
