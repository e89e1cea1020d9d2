"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is a deterministic transducer over bytes: the state knows where
in the splitting pattern it stands and which tokens end the current piece, and each
transition carries the change in the number of tokens. Transitions are compiled when first
met and kept by the worker process, as an open-addressing hash table of (state, symbol).

Texts are cut into chunks of equal length. A chunk maps the state before it to the state
after it and a count. After the first blank that follows a visible ASCII character the state
no longer depends on what came before, so a map is that of its head, up to this blank, and a
constant tail. Tails of all chunks run in parallel; composing the maps is then a scan, in
which all heads whose predecessor is known run in parallel (chunks without such a blank wait
for theirs). Numpy advances all chunks of a batch by one byte at a time.

Defined results: a null or empty text has no tokens; the tokenizer's special strings inside
a text count as one token each; rows are counted one by one, so repeated rows, null ids and
extra columns need no rule. Nothing is truncated.
"""

from __future__ import annotations

import json
import marshal
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import pieces

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK = 512
#: States compiled before the table is started anew.
MAX_STATES = 600_000

#: Symbols: 128 ASCII bytes, 64 continuation bytes and 51 lead bytes in four classes at most.
WIDTH = 512
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Characters with the property White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in the contractions of the splitting pattern.
SHORT, LONG = b"stmd", {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every code point."""
    import unicodedata

    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


class Pieces:
    """The part of the state that concerns the tokens of one piece of text.

    A state is (u, ends): u is the longest suffix of the piece that some token begins with;
    ends[k] is (last token, count) of the piece without its last k bytes, counts relative to
    k = 0. BPE of a prefix is a prefix of BPE, so the next byte's last token is the one token
    that ends there and may follow the last token before it."""

    def __init__(self, vocab: dict[str, int], merges: list):
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in chars)}
        decode = lambda s: bytes(code[c] for c in s)
        self.tokens = {decode(t): i for t, i in vocab.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.rank = {(decode(a), decode(b)): i for i, (a, b) in enumerate(pairs)}
        self.heads = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.empty = (b"", ((None, 0),))

    def encode(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, a: bytes | None, b: bytes) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            known = self.follows[a, b] = self.encode((a or b"") + b) == ([a, b] if a else [b])
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        u, ends = state
        whole = u + bytes([byte])
        for k in range(len(whole)):
            token = whole[k:]
            if token not in self.tokens or ends[len(token) - 1] is None:
                continue
            last, count = ends[len(token) - 1]
            if self.may_follow(last, token):
                delta = count + 1
                break
        else:
            raise ValueError(f"no token ends at byte {byte}")
        k = 0
        while whole[k:] and whole[k:] not in self.heads:
            k += 1
        u = whole[k:]
        n = len(u)
        # an end matters only while some token begins with the bytes after it
        kept = ((e[0], e[1] - delta) if e and u[n - 1 - k :] in self.heads else None for k, e in enumerate(ends[:n]))
        return (u, ((token, 0), *kept)), delta

    def run(self, state: tuple, text: bytes) -> tuple[tuple, int]:
        total = 0
        for b in text:
            state, d = self.step(state, b)
            total += d
        return state, total


class Transducer:
    """States are numbers; a hash table takes (state, symbol) to next * 64 + change + 32.

    A state is (mode, pieces state, pending bytes). Modes: a class for a run of it, or
    `start`; in SPACE the last white character is pending, as it may join the next run;
    after an apostrophe at a piece's start (`apostrophe`) the pending bytes may become a
    contraction. Symbols: an ASCII byte, a lead byte with its character's class, or a
    continuation byte."""

    START, APOSTROPHE = "start", "apostrophe"

    def __init__(self, parts: Pieces):
        self.parts = parts
        self.classes = char_classes()
        self.reset()

    def reset(self) -> None:
        self.symbols: list[tuple[int, int | None]] = []
        self.column = np.full(256 * 5, -1, np.int16)  # by byte + 256 * class, class 4: continuation
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.keys = np.full(1 << 16, -1, np.int64)
        self.values = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.flushed: list[int] = []
        self.start = self.number((self.START, self.parts.empty, b""))

    def number(self, state: tuple) -> int:
        packed = marshal.dumps(state, 2)
        n = self.numbers.get(packed)
        if n is None:
            n = self.numbers[packed] = len(self.states)
            self.states.append(packed)
            self.flushed.append(self.flush(state))
        return n

    def slots(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (at * np.int64(0x1E3779B97F4A7C15) >> np.int64(20)) & np.int64(len(keys) - 1)

    def look_up(self, cells: np.ndarray) -> np.ndarray:
        """Values of the cells, -1 where not compiled."""
        slot = self.slots(self.keys, cells)
        found = self.keys[slot]
        out = np.where(found == cells, self.values[slot], -1)
        odd = np.flatnonzero((found != cells) & (found >= 0))  # taken by another cell
        while len(odd):
            slot[odd] = (slot[odd] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[odd]]
            hit = found == cells[odd]
            out[odd[hit]] = self.values[slot[odd[hit]]]
            odd = odd[~hit & (found >= 0)]
        return out

    def insert(self, cells: list[int], values: list[int]) -> None:
        self.used += len(cells)
        if 3 * self.used > len(self.keys):
            keep = self.keys >= 0
            cells, values = self.keys[keep].tolist() + cells, self.values[keep].tolist() + values
            size = len(self.keys)
            while size < 4 * self.used:
                size *= 2
            self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        at = np.array(cells, np.int64)
        value = np.array(values, np.int32)
        slot = self.slots(self.keys, at)
        while len(at):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = at[free]  # of several for a slot one stays
            own = self.keys[slot] == at
            self.values[slot[own]] = value[own]
            at, value, slot = at[~own], value[~own], (slot[~own] + 1) & (len(self.keys) - 1)

    def flush(self, state: tuple) -> int:
        """Tokens still to count if the text ends here."""
        mode, piece, pending = state
        if mode == SPACE:
            return self.parts.run(piece, pending)[1]
        if mode == self.APOSTROPHE:
            return sum(self.parts.run(self.parts.empty, pending[i : i + 1])[1] for i in range(len(pending)))
        return 0

    def step(self, state: tuple, byte: int, kind: int | None) -> tuple[tuple, int]:
        mode, piece, pending = state
        parts = self.parts
        if kind is None:  # a continuation byte belongs to what stands before it
            if mode == SPACE:
                return (SPACE, piece, pending + bytes([byte])), 0
            piece, d = parts.step(piece, byte)
            return (mode, piece, pending), d
        if mode == self.APOSTROPHE:
            if len(pending) == 1:
                if byte in SHORT or byte in LONG:
                    if byte in SHORT:
                        return (self.START, parts.empty, b""), parts.run(parts.empty, pending + bytes([byte]))[1]
                    return (mode, piece, pending + bytes([byte])), 0
                piece, d = parts.run(parts.empty, pending)  # a run of other characters
                mode = OTHER
            else:
                if LONG[pending[1]] == byte:
                    return (self.START, parts.empty, b""), parts.run(parts.empty, pending + bytes([byte]))[1]
                d = parts.run(parts.empty, pending[:1])[1]
                piece, e = parts.run(parts.empty, pending[1:])
                mode, d = LETTER, d + e
            after, e = self.step((mode, piece, b""), byte, kind)
            return after, d + e
        if mode == SPACE:
            if kind == SPACE:
                piece, d = parts.run(piece, pending)
                return (SPACE, piece, bytes([byte])), d
            if pending == b" ":
                piece, d = parts.run(parts.empty, b" " + bytes([byte]))
                return (kind, piece, b""), d
            d = parts.run(parts.empty, pending)[1]
            after, e = self.step((self.START, parts.empty, b""), byte, kind)
            return after, d + e
        if kind == SPACE:
            return (SPACE, parts.empty, bytes([byte])), 0
        if kind == mode:
            piece, d = parts.step(piece, byte)
            return (mode, piece, b""), d
        if byte == ord("'"):
            return (self.APOSTROPHE, parts.empty, b"'"), 0
        piece, d = parts.step(parts.empty, byte)
        return (kind, piece, b""), d

    def columns(self, buf: np.ndarray) -> np.ndarray:
        """The table column of each byte's symbol."""
        kinds = np.full(len(buf), 4, np.int32)
        kinds[buf < 128] = self.classes[:128][buf[buf < 128]]
        lead = np.flatnonzero(buf >= 0xC0)
        if len(lead):
            b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
            first, c1, c2, c3 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
            point = np.where(
                first < 0xE0, (first & 31) << 6 | c1,
                np.where(first < 0xF0, (first & 15) << 12 | c1 << 6 | c2, (first & 7) << 18 | c1 << 12 | c2 << 6 | c3))
            kinds[lead] = self.classes[np.minimum(point, 0x10FFFF)]
        key = buf + 256 * kinds
        out = self.column[key]
        if (out < 0).any():
            for k in np.unique(key[out < 0]).tolist():
                self.column[k] = len(self.symbols)
                self.symbols.append((k % 256, None if k >= 1024 else k // 256))
            out = self.column[key]
        return out

    def compile(self, cells: np.ndarray) -> None:
        cells = np.unique(cells).tolist()
        values = []
        for cell in cells:
            after, d = self.step(marshal.loads(self.states[cell // WIDTH]), *self.symbols[cell % WIDTH])
            if not -32 <= d < 32:
                raise ValueError(f"a transition changes the count by {d}, which six bits do not hold")
            values.append(self.number(after) * 64 + d + 32)
        self.insert(cells, values)

    def advance(self, cols: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs each lane over its bytes; gives its last state and its count."""
        order = np.argsort(-length, kind="stable")
        begin, length, state = begin[order], length[order], state[order].astype(np.int64)
        count = np.zeros(len(begin), np.int64)
        active = len(begin)
        for j in range(int(length[0]) if len(length) else 0):
            while active and length[active - 1] <= j:
                active = int(np.searchsorted(-length, -j, "left"))
            col = cols[begin[:active] + j]
            cell = state[:active] * WIDTH + col
            hit = self.look_up(cell)
            if hit.min() < 0:
                self.compile(cell[hit < 0])
                hit = self.look_up(cell)
            state[:active] = hit >> 6
            count[:active] += (hit & 63) - 32
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text buf[offsets[i]:offsets[i + 1]]."""
        if len(self.states) > MAX_STATES:
            self.reset()
        sizes = np.diff(offsets)
        total = np.zeros(len(sizes), np.int64)
        per = -(-sizes // CHUNK)
        n = int(per.sum())
        if not n:
            return total
        text = np.repeat(np.arange(len(sizes)), per)
        place = np.arange(n) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[:-1][text] + place * CHUNK
        end = np.minimum(begin + CHUNK, offsets[1:][text])
        cols = self.columns(buf)
        # where the state forgets: a blank after a visible ASCII character
        visible = (buf > 32) & (buf < 127)
        forget = np.flatnonzero(visible[:-1] & (buf[1:] == 32)) + 1
        at = np.searchsorted(forget, begin + 1)
        reset = np.append(forget, len(buf))[at]
        reset = np.where(place == 0, begin, np.minimum(reset, end))  # end: nowhere in this chunk
        known = (place == 0) | (reset < end)
        state = np.full(n, -1, np.int64)
        count = np.zeros(n, np.int64)
        i = np.flatnonzero(known)
        state[i], count[i] = self.advance(cols, reset[i], end[i] - reset[i], np.full(len(i), self.start))
        waits = np.flatnonzero(place > 0)
        while len(waits):
            ready = waits[state[waits - 1] >= 0]
            after, c = self.advance(cols, begin[ready], reset[ready] - begin[ready], state[ready - 1])
            ends = np.asarray(self.flushed)[after]
            count[ready] += c + np.where(known[ready], ends, 0)
            state[ready[~known[ready]]] = after[~known[ready]]
            waits = waits[~np.isin(waits, ready)]
        np.add.at(total, text, count)
        last = np.flatnonzero(np.append(text[1:] != text[:-1], True))
        total[text[last]] += np.asarray(self.flushed)[state[last]]
        return total


@lru_cache(maxsize=2)
def transducer(path: str) -> tuple[Transducer, tuple[bytes, ...]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = tuple(t["content"].encode() for t in spec.get("added_tokens", ()))
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t.encode() not in special}
    return Transducer(Pieces(vocab, spec["model"]["merges"])), special


def count_batch(texts: pa.Array, machine: Transducer, special: tuple[bytes, ...]) -> np.ndarray:
    import re

    texts = texts.cast(pa.large_binary()).fill_null(b"")
    raw = pa.concat_arrays([texts])
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    found = [m.span() for m in re.finditer(b"|".join(map(re.escape, special)), buf)] if special else []
    found = [(a, b) for a, b in found if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b, "left")]
    if not found:
        return machine.counts(buf, offsets)
    cut = np.array(found)
    # special strings become texts of their own, which count as one token
    bounds = np.unique(np.concatenate([offsets, cut.ravel()]))
    count = machine.counts(buf, bounds)
    count[np.searchsorted(bounds, cut[:, 0])] = 1
    sums = np.concatenate([[0], np.cumsum(count)])
    return sums[np.searchsorted(bounds, offsets[1:])] - sums[np.searchsorted(bounds, offsets[:-1])]


def count_tokens(docs: DataFrame, *, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and over_limit. `path` names a byte-level BPE
    vocabulary file; it is opened on the executors, where the tokenizer package is installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path(VOCABULARY)
        machine, special = transducer(where)
        for batch in batches:
            for part in pieces(batch, 1, 4 << 20):
                n = count_batch(part.column(1), machine, special)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes")
    ).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
