"""Exact substring dedup by difference-cover anchors.

A window is ``length`` consecutive words of one document. With a difference
cover D modulo a period v, any two positions have an offset below v that takes
both to positions in D. So two equal windows share an aligned anchor: the
``length - v + 1`` words at a cover position, at the same offset in both. Only
anchors at cover positions (4 of 13) are hashed and compared. Windows around
an anchor that occurs twice are extended to the full length and compared by
128-bit hashes, and the first of each class in document order is found.

Documents are dealt to groups by their id. Everything exchanged is packed by
(bucket of the hash, group) and distinct within the group: a passage in a third
of all documents is one entry per group, never one per copy. The answer to a
group is one bit for each entry that it asked about, in the order in which it
asked; the group finds that order again. Texts are exchanged once; the three
passes over a group read that one exchange.

Defined cases: a null text has no words; texts shorter than a window lose
nothing; rows that repeat an id are ordered by their texts, and of equal rows
the first stays whole; a null id comes last; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ._runtime import dealing_key, dealing_keys, groups_for, texts_of

#: A difference cover: every residue modulo 13 is a difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Scanned bytes of documents in a group.
GROUP_BYTES = 6 << 20
LAST = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
ASKED = "deal int, bucket int, grp int, hashes binary, more binary, docs binary"
TOLD = "grp int, bucket int, kind int, bits binary"


class Group:
    """The documents of one group in document order, as words and hashes."""

    def __init__(self, table: pa.Table, length: int):
        ids = table.column("doc_id").combine_chunks()
        keys = np.asarray(ids.fill_null(LAST).cast(pa.int64()))
        texts = table.column("text").combine_chunks().cast(pa.large_binary())
        order = np.argsort(keys, kind="stable")
        if len(np.unique(keys)) < len(keys):
            order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], texts[i].as_py())), np.int64)
        self.ids, self.keys, self.texts = ids.take(pa.array(order)), keys[order], texts.take(pa.array(order))
        self.length = length
        buf, offsets = W.buffer_of(self.texts)
        self.words = W.Words(buf, offsets, W.not_space())
        self.h = self.words.hashes()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors at cover positions, and their words' indexes."""
        words = self.words
        key, at = words.rolling(self.h, self.length - PERIOD + 1)
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        doc = words.doc[at]
        use = cover[(at - words.first[doc]) % PERIOD] & (words.counts[doc] >= self.length)
        return key[use], at[use]

    def candidates(self, buckets: int, told: pa.Table) -> np.ndarray:
        """Starts of the windows that hold an anchor which occurs twice here or, as ``told``, in another group too."""
        key, at = self.anchors()
        asked, which = np.unique(key, return_inverse=True)
        hit = _answered(asked, buckets, told, 0)[which] if len(key) else np.zeros(0, bool)
        hit[W.repeated(key)] = True
        words = self.words
        near = np.zeros(len(words) + 1, bool)
        spots = at[hit]
        for offset in range(PERIOD):
            near[np.maximum(spots - offset, words.first[words.doc[spots]])] = True
        start = np.flatnonzero(near[: len(words)])
        return start[start + self.length <= words.first[words.doc[start] + 1]]

    def windows(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the windows at ``start``."""
        out = []
        for lane in (0, 1):
            h = self.h if lane == 0 else self.words.hashes(1)
            total = np.zeros(len(start), W.U64)
            for i in range(self.length):
                total *= W.U64(0xE7037ED1A0B428DB)
                total += h[start + i]
            out.append(W.mix(total))
        return out[0], out[1]


def _classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first index of each (a, b), in their order, and the class of each pair."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which  # lexsort is stable, so the first of a class is the first in the text


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket is a range of hashes."""
    return ((hashes >> W.U64(32)) * W.U64(buckets) >> W.U64(32)).astype(np.int32)


def _answered(asked: np.ndarray, buckets: int, told: pa.Table, kind: int) -> np.ndarray:
    """The bits that came back for sorted hashes that were asked about."""
    bucket = _bucket(asked, buckets)
    out = np.zeros(len(asked), bool)
    for b, k, bits in zip(*(told.column(c).to_pylist() for c in ("bucket", "kind", "bits")), strict=True):
        if k == kind:
            first, last = np.searchsorted(bucket, [b, b + 1])
            out[first:last] = np.unpackbits(np.frombuffer(bits, np.uint8), count=last - first).astype(bool)
    return out


def _packed(grp: int, hashes: np.ndarray, buckets: int, *more: np.ndarray) -> pa.Table:
    """Rows by bucket of what is sorted by hash."""
    bucket = _bucket(hashes, buckets)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    bounds = np.r_[first, len(hashes)]
    cut = lambda x: pa.array([_planes(x[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
    none = pa.nulls(len(first), pa.binary())
    columns = [cut(hashes), *map(cut, more), *[none] * (2 - len(more))]
    own = bucket[first]
    return pa.table([pa.array(dealing_keys(own)), pa.array(own, pa.int32()), pa.array(np.full(len(first), grp, np.int32)), *columns], names=["deal", "bucket", "grp", "hashes", "more", "docs"])


def _planes(x: np.ndarray) -> bytes:
    """64-bit words, all first bytes before all second ones: high bytes of sorted
    hashes and of ids are much alike, and the exchange compresses them."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _joined(table: pa.Table, name: str) -> np.ndarray:
    """The words of all rows of a column."""
    parts = [np.frombuffer(x, np.uint8).reshape(8, -1).T for x in table.column(name).to_pylist()]
    return np.ascontiguousarray(np.concatenate(parts)).view(W.U64).ravel() if parts else np.zeros(0, W.U64)


def _told(table: pa.Table, marked: np.ndarray, kind: int) -> pa.Table:
    """For each row that asked: which of its entries are marked; rows without any get no answer."""
    bounds = np.cumsum([0, *(len(x.as_py()) // 8 for x in table.column("hashes"))])
    rows = [i for i in range(table.num_rows) if marked[bounds[i] : bounds[i + 1]].any()]
    bits = [np.packbits(marked[bounds[i] : bounds[i + 1]]).tobytes() for i in rows]
    own = table.select(["grp", "bucket"]).take(pa.array(rows, pa.int64()))
    return pa.table([own.column("grp"), own.column("bucket"), pa.array(np.full(len(rows), kind, np.int32)), pa.array(bits, pa.binary())], names=["grp", "bucket", "kind", "bits"])


def dedup_substrings(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: words, words removed, and the digest of those kept.

    ``group_bytes``: scanned bytes of a group; a worker needs some 40 times as much memory."""
    n = groups_for(docs, group_bytes, text_col)
    buckets = max(8, n // 4)  # fewer than groups, so that a group's entries for a bucket are worth a row
    dealt = texts_of(docs, id_col, text_col).withColumn("grp", dealing_key(F.pmod(F.xxhash64("doc_id"), F.lit(n))))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        hashes, _ = Group(table, length).anchors()
        return _packed(key[0].as_py(), np.unique(hashes), buckets)

    def shared(table: pa.Table) -> pa.Table:
        """Anchors that two groups have."""
        hashes = _joined(table, "hashes")
        marked = np.zeros(len(hashes), bool)
        marked[W.repeated(hashes)] = True
        return _told(table, marked, 0)

    def extend(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        group = Group(table, length)
        start = group.candidates(buckets, told)
        a, b = group.windows(start)
        first, _ = _classes(a, b)
        return _packed(key[0].as_py(), a[first], buckets, b[first], group.keys[group.words.doc[start[first]]])

    def later(table: pa.Table) -> pa.Table:
        """Windows that another group has in an earlier document."""
        a, b = _joined(table, "hashes"), _joined(table, "more")
        doc = _joined(table, "docs").view(np.int64)
        at = W.repeated(a)
        at = at[np.lexsort((doc[at], b[at], a[at]))]
        again = np.zeros(len(at), bool)
        again[1:] = (a[at[1:]] == a[at[:-1]]) & (b[at[1:]] == b[at[:-1]])
        marked = np.zeros(len(a), bool)
        marked[at[again]] = True
        return _told(table, marked, 1)

    def remove(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        group = Group(table, length)
        words = group.words
        start = group.candidates(buckets, told)
        a, b = group.windows(start)
        first, which = _classes(a, b)
        again = _answered(a[first], buckets, told, 1)[which]
        repeats = np.ones(len(start), bool)
        repeats[first] = False
        again |= repeats
        gone = W.covered(len(words), start[again], length)
        removed = W.per_text(gone, words.first)
        digests = []
        for i, text in enumerate(group.texts):
            own = text.as_py().split()
            if removed[i]:
                own = compress(own, ~gone[words.first[i] : words.first[i + 1]])
            digests.append(sha256(b" ".join(own)).hexdigest())
        return pa.table([group.ids, pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    # A partition for each group and for each bucket: a task's share does not grow with the input.
    by_group = lambda df: df.repartition(n, "grp").groupBy("grp")
    by_bucket = lambda df: df.repartition(buckets, "deal").groupBy("deal")
    groups = by_group(dealt)
    anchors = by_bucket(groups.applyInArrow(ask, ASKED)).applyInArrow(shared, TOLD)
    windows = by_bucket(groups.cogroup(by_group(anchors)).applyInArrow(extend, ASKED)).applyInArrow(later, TOLD)
    return groups.cogroup(by_group(anchors.unionByName(windows))).applyInArrow(remove, SCHEMA)
