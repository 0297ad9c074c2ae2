"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words. The CGK random walk reads a window step by step:
it emits the word it stands on and moves on or stays by a random bit of (step,
word), so texts a small edit distance apart are emitted a small Hamming
distance apart. A repetition draws new bits and, for each window size, some
steps; the words emitted there are the window's key. Windows begin at every
``STRIDE``-th word of a document and at every word of a benchmark item, in the
sizes that fit the item, so a passage has many chances to share a key with its
item. Each hit is verified by the exact edit distance of the whole item against
the place in the document (bit-parallel dynamic programming).

Items of fewer than ``PIECED`` words have too few windows for that. Such an item
is cut into one piece more than it may have edits; one piece at least then stands
unedited in the document, where pieces are looked up at every word. So none of
these items is missed, whatever else is in the benchmark.

Benchmark items are a stated query set. They are taken in blocks of a bounded
number of bytes; a block is broadcast and every document is compared with it.
Documents are neither exchanged nor joined.

Defined cases: null texts count as empty; items without words match nothing;
repeated rows each get their rows; null ids stay null; other columns are
ignored by :func:`find_leaks` and kept by :func:`drop_leaks`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ._runtime import lean, texts_of

#: Least share of an item's words that stand unedited: edits <= (1 - SIMILARITY) * words.
SIMILARITY = 0.8
SIZES = (8, 16, 32)
STRIDE = 4
#: Items of fewer words are searched by unedited pieces.
PIECED = 24
STEPS = 64
REPETITIONS = 4
#: Steps sampled for a key, by window size (others: all but few).
SAMPLED = {8: 4, 16: 5, 32: 6}
#: Bytes of benchmark texts that are broadcast at once.
BLOCK_BYTES = 8 << 20
AT_ONCE = 1 << 20
#: Entries of the table of items' words, and candidates that are looked at together.
MEMBERS = 1 << 22
CANDIDATES = 1 << 16
MULTIPLIER = W.U64(0x9FB21C651E98DF25)
SCHEMA = "doc_id long, item_id long, edits int, similarity double, start_word long"


def edits(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to a part of ``text``, and where that part ends."""
    n = len(pattern)
    at: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        at[w] |= 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text, 1):
        equal = at.get(w, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, less = minus | (full & ~(across | plus)), plus & across
        score += 1 if up & high else -1 if less & high else 0
        up, less = (up << 1) & full, (less << 1) & full
        plus, minus = less | (full & ~(down | up)), up & down
        if score < best:
            best, end = score, j
    return best, end


class Queries:
    """A block of benchmark items, embedded."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float, seed: int = 7):
        self.letters, self.lower = W.letters_digits()
        data = [(t or "").encode() for _, t in items]
        buf = np.frombuffer(b"".join(data), np.uint8)
        words = W.Words(buf, np.cumsum([0, *map(len, data)]), self.letters, self.lower)
        h = words.hashes()
        self.vocabulary = np.unique(h)  # ids are 1 and up; 0 is any other word, the last is a text's end
        self.end = len(self.vocabulary) + 1
        self._small = np.zeros(1 << 16, bool)
        self._small[(self.vocabulary & W.U64(0xFFFF)).astype(np.int64)] = True
        ids = self.number(h)
        self.items = [(items[i][0], ids[words.first[i] : words.first[i + 1]].tolist()) for i in range(len(items))]
        self.items = [x for x in self.items if x[1]]
        self.allowed = [int((1 - similarity) * len(w) + 1e-9) for _, w in self.items]
        self.sizes_of, self.slack_of = (np.array(x, np.int64) for x in ([len(w) for _, w in self.items], self.allowed))
        self.members = np.zeros(MEMBERS, bool)
        if self.items:
            own = np.repeat(np.arange(len(self.items)), self.sizes_of)
            self.members[self._member(own, np.array([w for _, ws in self.items for w in ws], np.int64))] = True
        rng = np.random.default_rng(seed)
        longest = max([0, *(len(w) for _, w in self.items)])
        self.sizes = [s for s in SIZES if longest >= max(s, PIECED)]
        self.masks, self.steps, self.tables = [], [], []
        for _ in range(REPETITIONS):
            mask = rng.integers(0, 1 << 64, self.end + 1, dtype=W.U64)
            mask[self.end] = 0
            self.masks.append(mask)
            # A walk of 2n steps goes about n words far; short windows are sampled densely.
            self.steps.append({s: np.sort(rng.choice(min(STEPS, 2 * s), min(SAMPLED.get(s, 4), 2 * s), replace=False)).tolist() for s in self.sizes})
        self._index()

    def number(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self._small[(h & W.U64(0xFFFF)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[spot] == h[maybe], spot + 1, 0)
        return out

    @staticmethod
    def _member(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place in ``members`` that stands for an item that has a word."""
        mixed = (item.astype(W.U64) * MULTIPLIER + word.astype(W.U64)) * MULTIPLIER
        return (mixed >> W.U64(64 - MEMBERS.bit_length() + 1)).astype(np.int64)

    def _worth(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which candidates (item, the word at which it would begin, bounds of the text) may pass: an item with e
        edits has all but e of its words in its place, so so many words there must be words of the item."""
        slack = self.slack_of[item]
        a, b = np.maximum(first, at - slack), np.minimum(last, at + self.sizes_of[item] + slack)
        n = np.maximum(0, b - a)
        begin = np.cumsum(n) - n
        where = np.repeat(a - begin, n) + np.arange(int(n.sum()))
        hit = np.zeros(len(where) + 1, np.int64)
        np.cumsum(self.members[self._member(np.repeat(item, n), ids[where])] & (ids[where] > 0), out=hit[1:])
        return hit[begin + n] - hit[begin] >= self.sizes_of[item] - slack

    def keys(self, x: np.ndarray, start: np.ndarray, t: int) -> dict[int, np.ndarray]:
        """By window size: the keys of repetition t of the windows at ``start``
        in x, word numbers with an end mark behind each text."""
        bits = self.masks[t][x]
        at = start.copy()
        out = {s: np.zeros(len(start), W.U64) for s in self.sizes}
        for j in range(1 + max([0, *(s[-1] for s in self.steps[t].values())])):
            chosen = [s for s in self.sizes if j in self.steps[t][s]]
            if chosen:
                word = x[at].astype(W.U64) + W.U64(1)
                for s in chosen:
                    out[s] = (out[s] + word) * MULTIPLIER
                    out[s] ^= out[s] >> W.U64(29)
            at += ((bits[at] >> W.U64(j)) & W.U64(1)).astype(np.int64)
        return out

    def piece_keys(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in x where n words of the vocabulary begin, and the keys of these words."""
        m = max(0, len(x) - n + 1)
        inside = (x > 0) & (x < self.end)
        at = np.flatnonzero(np.logical_and.reduce([inside[i : i + m] for i in range(n)]))
        key = np.zeros(len(at), W.U64)
        for i in range(n):
            key = (key + x[at + i].astype(W.U64) + W.U64(1)) * MULTIPLIER
            key ^= key >> W.U64(29)
        return at, key

    @staticmethod
    def _table(key: np.ndarray, fits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        table = np.zeros(1 << 20, bool)
        table[(key >> W.U64(44)).astype(np.int64)] = True
        return table, key[order], np.array(fits, np.int64).reshape(-1, 2)[order]

    def _index(self) -> None:
        """By repetition and size, and by size of pieces: a bit table and the sorted keys with (item, offset)."""
        flat = np.array([w for _, ids in self.items for w in [*ids, self.end]] or [self.end], np.int64)
        begin = np.cumsum([0, *(len(ids) + 1 for _, ids in self.items)])[:-1]
        for t in range(REPETITIONS):
            tables = {}
            for s in self.sizes:
                fits = [(i, o) for i, (_, ids) in enumerate(self.items) if len(ids) >= max(s, PIECED) for o in range(len(ids) - s + 1)]
                start = np.array([begin[i] + o for i, o in fits], np.int64)
                tables[s] = self._table(self.keys(flat, start, t)[s], fits)
            self.tables.append(tables)
        cuts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, ids) in enumerate(self.items):
            if len(ids) < PIECED:
                n = min(self.allowed[i] + 1, len(ids))
                ends = [len(ids) * k // n for k in range(n + 1)]
                for a, b in zip(ends, ends[1:], strict=False):
                    cuts[b - a].append((i, a))
        self.pieces = {}
        for n, fits in sorted(cuts.items()):
            words = np.array([w for i, o in fits for w in self.items[i][1][o : o + n]], np.int64)
            at, key = self.piece_keys(words, n)
            self.pieces[n] = self._table(key[at % n == 0], fits)

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, first word) of verified items, the best place of each."""
        buf, offsets = W.buffer_of(texts)
        found = []
        for a, b in W.slices(offsets, AT_ONCE):
            found += [(a + d, *x) for d, *x in self._leaks(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
        return found

    def _leaks(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        words = W.Words(buf, offsets, self.letters, self.lower)
        ids = self.number(words.hashes())
        n = len(offsets) - 1
        x = np.full(len(ids) + n, self.end, np.int64)
        place = np.arange(len(ids)) + words.doc
        x[place] = ids
        within = np.arange(len(ids)) - words.first[words.doc]
        own = np.flatnonzero(within % STRIDE == 0)
        start = place[own]
        at_word = np.cumsum(x != self.end) - 1

        def probes():
            for t in range(REPETITIONS if self.sizes else 0):
                keys = self.keys(x, start, t)
                for s, known in self.tables[t].items():
                    yield own, keys[s], *known
            for n, known in self.pieces.items():
                at, key = self.piece_keys(x, n)
                yield at_word[at], key, *known

        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for begins, key, table, known, fits in probes():
            hit = np.flatnonzero(table[(key >> W.U64(44)).astype(np.int64)])
            low, high = np.searchsorted(known, key[hit], "left"), np.searchsorted(known, key[hit], "right")
            hit, low, high = (v[low < high] for v in (hit, low, high))
            total, i = np.cumsum(high - low), 0
            while i < len(hit):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CANDIDATES, "right")))
                counts = (high - low)[i:j]
                which = np.repeat(low[i:j] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
                item, begin = fits[which, 0], np.repeat(begins[hit[i:j]], counts)
                d = words.doc[begin]
                at = begin - fits[which, 1]
                once = np.unique(np.stack([item, at, d]), axis=1, return_index=True)[1]
                item, at, d = item[once], at[once], d[once]
                keep = self._worth(ids, words.first[d], words.first[d + 1], item, at)
                for t, p, k in zip(item[keep].tolist(), at[keep].tolist(), d[keep].tolist(), strict=True):
                    if best.get((k, t), (1,))[0] == 0 or (k, t, p) in tried:
                        continue
                    tried.add((k, t, p))
                    first, last = int(words.first[k]), int(words.first[k + 1])
                    pattern, slack = self.items[t][1], self.allowed[t]
                    a = max(first, p - slack)
                    e, end = edits(pattern, ids[a : min(last, p + len(pattern) + slack)].tolist())
                    if e <= slack and e < best.get((k, t), (e + 1,))[0]:
                        best[k, t] = (e, max(0, a + end - len(pattern) - first))
                i = j
        return [(d, item, e, at) for (d, item), (e, at) in sorted(best.items())]


def _blocks(benchmark: DataFrame, similarity: float, id_col: str, text_col: str) -> list:
    """Broadcasts of the benchmark's blocks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    out = []
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        out.append(spark.sparkContext.broadcast(([(r.item_id, r.text) for r in part.collect()], similarity)))
    return out


_held: list = [None, None]


def _of(block) -> Queries:
    """The worker's queries of a broadcast block; it keeps the last block's."""
    value = block.value
    if _held[0] is not value:
        _held[:] = [value, Queries(*value)]
    return _held[1]


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it contains: edits, similarity and where the passage begins."""

    def search(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = _of(block)
            for batch in batches:
                found = queries.leaks(batch.column("text"))
                ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
                items = [queries.items[x[1]] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([i for i, _ in items], pa.int64()),
                        pa.array([x[2] for x in found], pa.int32()),
                        pa.array([1 - x[2] / len(w) for x, (_, w) in zip(found, items, strict=True)], pa.float64()),
                        pa.array([x[3] for x in found], pa.int64()),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

        return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(search, _blocks(benchmark, similarity, item_col, item_text)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""

    def clean(kept: DataFrame, block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[x[0] for x in _of(block).leaks(batch.column(text_col))]] = False
                yield batch.filter(pa.array(mask))

        return kept.mapInArrow(lean(run), kept.schema)

    return reduce(clean, _blocks(benchmark, similarity, item_col, item_text), docs)
