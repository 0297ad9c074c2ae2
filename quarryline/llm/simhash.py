"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most R bits apart share a variant at most R / 2 bits from
each. Every distinct fingerprint stands for all its variants within R / 2. The
exchange is on the variants' leading bits: a fingerprint is sent once to each
leading part that one of its variants has, and the task that owns a leading
part makes the variants that begin with it, sorts them and links those that
collide. So each of the 2081 variants of 64 bits (R = 4) is made exactly once,
but only some 80 rows of a fingerprint are exchanged, packed by leading part.
Colliding fingerprints are verified by their Hamming distance. Links of a task
are reduced to a spanning forest before they are exchanged; components are
found by :mod:`.components`.

:func:`near_duplicates` links fingerprints of word shingles as they are.
:func:`similar_texts` is for dropping documents whose five-word shingles have a
similarity of 0.8, which mostly differ in more bits than a ball reaches. So
texts that share a band of least shingle hashes are candidates beside those of
the balls, and candidates are compared by their whole sets of shingles.

Hot groups: exact copies share a fingerprint, which is taken once; parts of
the variants' space with many fingerprints are split by further bits inside
the task, so its memory is bounded; links per task number fewer than its
fingerprints, never all pairs.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero, linked like any other; repeated rows each get their row; a
null id is never the smallest id; other columns are ignored by
:func:`near_duplicates` and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._runtime import durable, lean, texts_of
from .components import connected_components
from .words import U64, buffer_of, mix, slices

BITS = 64
#: Variants that are sorted together, and texts' bytes that are hashed together.
VARIANTS_AT_ONCE = 1 << 21
AT_ONCE = 1 << 20
#: Fingerprints that a task deals.
AT_A_DEAL = 1 << 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in h[first[i]:first[i + 1]], by eight byte-wide counters in a word at a time."""
    n = len(first) - 1
    out = np.zeros((n, BITS), np.int64)
    if not len(h):
        return out
    sizes = np.diff(first)
    blocks = -(-sizes // 255)  # a byte counts to 255
    text = np.repeat(np.arange(n), blocks)
    within = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = first[text] + 255 * within
    begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    for k in range(8):
        lanes = np.add.reduceat((h >> U64(k)) & U64(0x0101010101010101), starts)
        counts = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[text[begins], k::8] = np.add.reduceat(counts, begins, axis=0)
    return out


def _majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each h[bounds[i]:bounds[i + 1]]: bits set in over half of them."""
    over = 2 * _bit_counts(h, bounds) > np.diff(bounds)[:, None]
    return (over.astype(U64) << np.arange(BITS, dtype=U64)).sum(axis=1, dtype=U64)


def fingerprints(texts: list[bytes], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    first = [0]
    for data in texts:
        words = data.translate(_LOWER).split()
        if words:
            joined = memoryview(b" ".join(words))
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            last = ends[min(shingle, len(words)) - 1 :].tolist()
            starts = [0, *(ends[: len(last) - 1] + 1).tolist()]
            hashes += [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, last, strict=True)]
        first.append(len(hashes))
    return _majority(np.array(hashes, U64), np.array(first))


def with_fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffer_of(batch.column("text"))
            data = [buf[offsets[i] : offsets[i + 1]].tobytes() for i in range(batch.num_rows)]
            parts = [fingerprints(data[a:b], shingle, seed) for a, b in slices(offsets, AT_ONCE)]
            fp = np.concatenate(parts) if parts else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def masks(bits: int, flips: int) -> list[np.ndarray]:
    """By number of flips: the words of ``bits`` bits with so many bits set."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(bits), k)], U64) for k in range(flips + 1)]


def variants_of(bits: int, flips: int) -> int:
    return sum(math.comb(bits, k) for k in range(flips + 1))


def _links(fp: np.ndarray, used: np.ndarray, bits: int, half: int, step: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indexes into fp that share a variant of the last ``bits`` bits,
    where ``used`` flips are spent already and leading bits are agreed on."""
    cost = sum(int((used == u).sum()) * variants_of(bits, half - u) for u in range(half + 1))
    if len(fp) < 2:
        return
    if cost > VARIANTS_AT_ONCE and bits > step:
        left = bits - step
        lead = (fp >> U64(left)) & U64((1 << step) - 1)
        for q in range(1 << step):
            spent = used + np.bitwise_count(lead ^ U64(q)).astype(np.int64)
            at = np.flatnonzero(spent <= half)
            for a, b in _links(fp[at], spent[at], left, half, step):
                yield at[a], at[b]
        return
    tail = fp & U64((1 << bits) - 1)
    by_flips = masks(bits, half)
    keys, who = [], []
    for u in range(half + 1):
        at = np.flatnonzero(used == u)
        ball = np.concatenate(by_flips[: half - u + 1])
        keys.append((tail[at][:, None] ^ ball[None, :]).ravel())
        who.append(np.repeat(at, len(ball)))
    key, own = np.concatenate(keys), np.concatenate(who)
    # Most variants are alone: a table of truncated hashes drops them before the sort.
    size = 1 << max(8, (len(key) * 2).bit_length())
    low = ((key * U64(0x9E3779B97F4A7C15)) >> U64(65 - size.bit_length())).astype(np.int64)
    keep = np.flatnonzero(np.bincount(low, minlength=size)[low] > 1)
    key, own = key[keep], own[keep]
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    head = own[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else own
    other = np.flatnonzero(own != head)
    if len(other):
        pairs = np.unique(head[other] * np.int64(len(fp)) + own[other])
        yield pairs // len(fp), pairs % len(fp)


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the verified links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for a, b in pairs:
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        for p, q in zip(a[near].tolist(), b[near].tolist(), strict=True):
            x, y = find(p), find(q)
            if x != y:
                root[max(x, y)] = min(x, y)
                yield p, q


def _leading_bits(n: int, half: int, least: int) -> int:
    """Leading bits for n fingerprints: parts of a few million variants each."""
    return min(40, max(least, math.ceil(math.log2(max(1, n) * variants_of(BITS, half) / VARIANTS_AT_ONCE))))


def _planes(x: np.ndarray) -> bytes:
    """64-bit words, all first bytes before all second ones; like bytes of ids are compressed by the exchange."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _words(parts: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(x, np.uint8).reshape(8, -1).T for x in parts]
    return np.ascontiguousarray(np.concatenate(rows)).view(U64).ravel()


def _dealt(fp: np.ndarray, node: np.ndarray, trial: int, lead: int, flips: np.ndarray) -> pa.RecordBatch:
    """By leading part: the fingerprints that have a variant in it, and their nodes."""
    part = ((fp >> U64(BITS - lead))[:, None] ^ flips[None, :]).ravel()
    who = np.repeat(np.arange(len(fp)), len(flips))
    order = np.argsort(part, kind="stable")
    part, who = part[order], who[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    spans = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True))
    cut = lambda x: pa.array([_planes(x[who[a:b]]) for a, b in spans], pa.binary())
    keys = part[first].view(np.int64) * np.int64(64) + trial
    return pa.RecordBatch.from_arrays([pa.array(keys), cut(fp), cut(node)], names=["part", "fps", "nodes"])


def _meetings(marked: DataFrame, trials: int, radius: int, count: int, least_lead: int, meet) -> DataFrame:
    """(src, dst): what ``meet`` makes of each leading part of each trial of
    ``marked`` (node long, fps array<long>); it gets fingerprints, nodes, a
    generator of pairs of indexes that share a variant, and a test of which
    variants begin with the leading part."""
    half = radius // 2
    lead = _leading_bits(count, half, least_lead)
    flips, rest = np.concatenate(masks(lead, half)), BITS - lead
    rows = count * len(flips) * trials
    parts = max(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / 2_000_000))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.asarray(batch.column("node")).view(U64)
            flat = np.asarray(batch.column("fps").flatten()).view(U64).reshape(-1, trials)
            for a in range(0, len(node), 8192):
                for t in range(trials):
                    yield _dealt(np.ascontiguousarray(flat[a : a + 8192, t]), node[a : a + 8192], t, lead, flips)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for p, fps, nodes in zip(*(batch.column(c).to_pylist() for c in ("part", "fps", "nodes")), strict=True):
                by_part.setdefault(p, []).append((fps, nodes))
        for p in list(by_part):
            held = by_part.pop(p)
            fp, node = _words([x for x, _ in held]), _words([y for _, y in held])
            order = np.argsort(node.view(np.int64), kind="stable")  # the earliest heads each meeting
            fp, node = fp[order], node[order]
            used = np.bitwise_count((fp >> U64(rest)) ^ U64(p >> 6)).astype(np.int64)
            found = meet(fp, node, _links(fp, used, rest, half), lambda v, p=p: (v >> U64(rest)) == U64(p >> 6))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, i].view(np.int64)) for i in (0, 1)], names=["src", "dst"])

    # Few large batches: the fingerprints of a batch that go to one leading part are one row.
    packed = marked.select("node", "fps").coalesce(max(1, math.ceil(count / AT_A_DEAL))).mapInArrow(deal, "part long, fps binary, nodes binary")
    dealt = packed.repartition(parts, "part")
    return dealt.mapInArrow(run, "src long, dst long")


def links(distinct: DataFrame, radius: int = 4, count: int | None = None, node: str = "fp") -> DataFrame:
    """(src, dst) between fingerprints at most ``radius`` bits apart that
    connect all that are linked; ``distinct`` has the column fp, without
    repeats, and ``node``, which the links name."""

    def meet(fp: np.ndarray, node: np.ndarray, pairs, here) -> np.ndarray:
        found = np.array(list(_forest(pairs, fp, radius)), np.int64).reshape(-1, 2)
        return node[found]

    own = distinct.select(F.col(node).alias("node"), F.array("fp").alias("fps"))
    return _meetings(own, 1, radius, distinct.count() if count is None else count, 12, meet)


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of ``marked`` (doc_id, fp): the smallest doc_id that the fingerprint reaches."""
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(distinct, radius))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", "component")
    # Written first, so that adaptive execution may split the fingerprints of a large component, and documents of one fingerprint.
    least = durable(rooted.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id")))
    return durable(rooted.join(least, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    marked = durable(with_fingerprints(docs, shingle, seed, id_col, text_col))
    out = marked.join(_classes(marked, radius), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of :func:`similar_texts`: the least similarity, as a fraction of whole numbers, so that it is decided exactly;
#: bands of a text and least hashes in each. Two texts 0.8 alike share no band with probability (1 - 0.8**7)**48, 1 in 80,000.
ALIKE = (4, 5)
BANDS = 48
ROWS = 7
#: Texts of either side that meet in a task, those of them that are compared at once, and shingles of these at once.
UNIT = 256
BLOCK = 128
COLUMNS = 1 << 13
_RNG = np.random.default_rng(11)
_FLIPS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FACTORS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def _digest(joined: bytes) -> int:
    """64 bits that stand for a sequence of words, as a signed long."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(joined, 5) - (1 << 63)


def _shingles(joined: bytes, shingle: int) -> np.ndarray:
    """Hashes of the shingles of words joined by blanks; of all words where they are fewer, and one for no words."""
    from xxhash import xxh64_intdigest

    ends = np.r_[np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined)]
    last = ends[min(shingle, len(ends)) - 1 :].tolist()
    starts = [0, *(ends[: len(last) - 1] + 1).tolist()]
    view = memoryview(joined)
    return np.array([xxh64_intdigest(view[a:b], 42) for a, b in zip(starts, last, strict=True)], U64)


def _joined(text: bytes) -> bytes:
    return b" ".join(text.translate(_LOWER).split())


def _bands(grams: list[np.ndarray]) -> np.ndarray:
    """By text and band: a hash of the band's least hashes."""
    first = np.cumsum([0, *map(len, grams)])[:-1]
    x = (mix(np.concatenate(grams)) >> U64(32)).astype(np.uint32)
    out = np.zeros((len(grams), BANDS), U64)
    for k, (flip, factor) in enumerate(zip(_FLIPS, _FACTORS, strict=True)):
        least = np.minimum.reduceat((x ^ flip) * factor, first)
        out[:, k // ROWS] = mix(out[:, k // ROWS] * U64(0x9E3779B97F4A7C15) + least + U64(k + 1))
    return out


def with_bands(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, fp, bands): node stands for the words, fp is their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffer_of(batch.column("text"))
            for a, b in slices(offsets, AT_ONCE):
                texts = [_joined(buf[offsets[i] : offsets[i + 1]].tobytes()) for i in range(a, b)]
                grams = [_shingles(t, shingle) for t in texts]
                bands, fp = _bands(grams), _majority(np.concatenate(grams), np.cumsum([0, *map(len, grams)]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([_digest(t) for t in texts], pa.int64()), pa.array(fp.view(np.int64)), lists], names=["doc_id", "node", "fp", "bands"])

    return texts_of(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, node long, fp long, bands array<long>")


def distinct_texts(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, least, fp, bands) of each distinct sequence of words: least is the
    smallest doc_id that has it; texts without any id are left out."""
    marked = with_bands(docs, shingle, id_col, text_col).where("doc_id is not null")
    return durable(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), release=True)


def _met(own: DataFrame, n: int) -> DataFrame:
    """(band, node) of the bands that two texts or more share, of n texts."""
    rows = own.select("node", F.explode("bands").alias("band"))
    shared = durable(rows.groupBy("band").count().where(F.col("count") > 1), rows=n * BANDS // 2)
    return durable(rows.join(shared, "band"), rows=n * BANDS)


def _leaders(met: DataFrame, n: int) -> DataFrame:
    """(node, unit): each text that shares a band, and the leader that it is to be compared
    with. A band's leader is the text whose bands hold the most texts, so
    the one in the midst of a crowd; a text's is the leader of most of its bands."""
    weight = met.groupBy("node").agg(F.sum("count").alias("weight"))
    ranked = met.join(weight, "node").select("band", F.struct("weight", "node").alias("rank"))
    best = durable(ranked.groupBy("band").agg(F.max("rank").alias("best")), rows=n * BANDS // 2)
    pairs = ranked.join(best, "band").where("rank < best").groupBy(F.col("rank.node").alias("node"), "best").count()
    chosen = pairs.groupBy("node").agg(F.max(F.struct("count", "best")).alias("m")).select("node", F.col("m.best.node").alias("unit"))
    return chosen


def _ball_pairs(own: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(node, unit) of texts whose fingerprints are at most ``radius`` bits apart: by meet-in-the-middle balls as in
    :func:`links`; of texts of one fingerprint each with the first."""
    first = durable(own.groupBy("fp").agg(F.min("node").alias("unit"), F.count("*").alias("n")), rows=n)
    same = own.select("fp", "node").join(first.where("n > 1"), "fp").where("node != unit").select("node", "unit")
    return same.union(links(first, radius, node="unit").select("src", "dst"))


def _with_visits(pairs: DataFrame) -> DataFrame:
    """(unit, node, component, visits): pairs (node, unit) as members, the unit visits; each is its own component."""
    sits = pairs.select("unit", "node", F.lit(False).alias("visits"))
    visits = pairs.select("unit", F.col("unit").alias("node"), F.lit(True).alias("visits")).distinct()
    return sits.union(visits).withColumn("component", F.col("node"))


def _labels(links: DataFrame, n: int) -> DataFrame:
    """(node, component) of the linked texts: the leader's leader, or the leader. Texts of one label are connected;
    connected ones may have different labels, then some of them are compared once more."""
    leader = durable(links.groupBy("dst").agg(F.min("src").alias("unit")), rows=n)
    above = leader.select(F.col("dst").alias("unit"), F.col("unit").alias("above"))
    return durable(leader.join(above, "unit", "left").select(F.col("dst").alias("node"), F.coalesce("above", "unit").alias("component")), rows=n)


def _strays(met: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(unit, node, component, visits) of the bands in which texts of several
    components are left. A band belongs to the component of most of its texts;
    its other texts are strays and visit all texts that share a band of that
    component with a stray, the strays themselves among them."""
    named = met.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    parts = named.groupBy("band", "component").count()
    mixed = parts.groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("count", "component")).component.alias("unit")).where("kinds > 1")
    units = durable(mixed.select("band", "unit"), rows=n * BANDS // 2)
    inside = durable(named.join(units, "band").select("unit", "node", "component").distinct(), rows=n * BANDS)
    return inside.withColumn("visits", F.lit(False)).unionByName(inside.where("component != unit").withColumn("visits", F.lit(True)))


def _alike(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """By text of a and of b, sets of shingles: whether they are alike."""
    sets = [*a, *b]
    sizes = np.array([len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(len(sets)), sizes)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    text, at = text[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    text, at = text[order], at[order]
    both = np.zeros((len(a), len(b)))
    for low in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(at, [low, low + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - low)), np.float32)
        has[text[i:j], at[i:j] - low] = 1
        both += has[: len(a)] @ has[len(a) :].T
    up, down = ALIKE
    return both * (up + down) >= up * (sizes[: len(a), None] + sizes[None, len(a) :])


def _compared(sits: list[tuple[int, int, np.ndarray]], visits: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Pairs of (node, component, shingles) that are alike, as nodes; of those between two components one is enough."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for a in range(0, len(visits), BLOCK):
        for b in range(0, len(sits), BLOCK):
            p, q = visits[a : a + BLOCK], sits[b : b + BLOCK]
            if len({find(x[1]) for x in p} | {find(x[1]) for x in q}) == 1:
                continue
            for i, j in np.argwhere(_alike([x[2] for x in p], [x[2] for x in q])).tolist():
                x, y = find(p[i][1]), find(q[j][1])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    yield p[i][0], q[j][0]


def _verified(texts: DataFrame, members: DataFrame, shingle: int, n: int) -> DataFrame:
    """(src, dst): of each unit of ``members`` the pairs of a visiting and a
    sitting text that are alike by all their shingles, as many as connect them.

    Both sides of a unit are cut into blocks by their nodes, and each two blocks
    meet in a task of their own; so memory does not grow with a unit."""
    sizes = durable(members.groupBy("unit").agg(F.count_if("visits").alias("v"), F.count_if(~F.col("visits")).alias("s")), rows=n)
    cut = lambda n: F.ceil(F.col(n) / UNIT).cast("int")
    dealt = members.join(sizes, "unit").where("v > 0 and s > 0").withColumns({"v": cut("v"), "s": cut("s")})
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.col("node"), F.col(n)).cast("int"))
    dealt = dealt.withColumn("i", F.explode(F.when(F.col("visits"), all_of("s")).otherwise(own("s"))))
    dealt = dealt.withColumn("j", F.explode(F.when(F.col("visits"), own("v")).otherwise(all_of("v"))))
    rows = dealt.select("unit", "i", "j", "node", "component", "visits").join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(sits: dict, visits: dict) -> Iterator[tuple[int, int]]:
            if sits and visits:
                yield from _compared(*([(n, c, np.unique(_shingles(t, shingle))) for n, (c, t) in sorted(x.items())] for x in (sits, visits)))

        key, held, found = None, ({}, {}), []
        for batch in batches:
            for *at, node, component, visits, text in zip(*(batch.column(c).to_pylist() for c in ("unit", "i", "j", "node", "component", "visits", "text")), strict=True):
                if at != key:
                    found += told(*held)
                    key, held = at, ({}, {})
                held[visits][node] = (component, text)
        found += told(*held)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return rows.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j").mapInArrow(lean(run), "src long, dst long")


def _named_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text): the words of each of ``wanted`` (node, least), joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, t) for n, t in zip(batch.column("node").to_pylist(), map(_joined, batch.column("text").cast(pa.binary()).to_pylist()), strict=True) if _digest(t) == n]
            # else another text of the same id
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "text"])

    rows = texts_of(docs, id_col, text_col).join(wanted, F.col("doc_id") == F.col("least")).select("node", "text")
    return durable(rows.mapInArrow(lean(run), "node long, text binary"), release=True)  # a row that repeats its id and text is there again


def similar_texts(docs: DataFrame, own: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", n: int | None = None) -> DataFrame:
    """(node, component) of those of :func:`distinct_texts` that have a
    near-duplicate; a component is named by one of its nodes. n is how many
    :func:`distinct_texts` there are, if that is known.

    Candidates are texts whose fingerprints share a ball, and texts that share a
    band. They are compared by all of their shingles unless they are connected
    already: first those of a ball, and each text with one leader of its bands;
    then, in bands in which several components are left, each with all others.
    So no choice of leaders hides a link."""
    n = own.count() if n is None else n
    met = _met(own, n)
    pairs = durable(_leaders(met, n).union(_ball_pairs(own, n)).distinct(), release=True, rows=4 * n)
    wanted = met.select("node").union(pairs.select("node")).union(pairs.select("unit")).distinct()
    texts = _named_texts(docs, own.join(wanted, "node", "left_semi").select("node", "least"), id_col, text_col)
    first = durable(_verified(texts, _with_visits(pairs), shingle, n), release=True)
    return connected_components(first.union(_verified(texts, _strays(met, _labels(first, n), n), shingle, n)), rows=4 * n)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: of each group of :func:`similar_texts`
    the text with the smallest id. Rows that repeat its id and words are repeats
    and go too; rows without an id stay, for nothing names them."""
    own = distinct_texts(docs, shingle, id_col, text_col)
    n = own.count()
    found = durable(similar_texts(docs, own, shingle, id_col, text_col, n).join(own.select("node", "least"), "node"), rows=n)
    first = found.groupBy("component").agg(F.min(F.struct("least", "node")).node.alias("node"))
    gone = found.join(first, "node", "left_anti").select("node")
    best = own.select("node", "least").join(gone, "node", "left_anti")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffer_of(batch.column(text_col))
            nodes = [_digest(_joined(buf[offsets[i] : offsets[i + 1]].tobytes())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "_node"])

    named = docs.mapInArrow(lean(name), StructType([*docs.schema.fields, StructField("_node", LongType())]))
    kept = named.join(best, (named[id_col] == best.least) & (named._node == best.node), "left_semi")
    return kept.dropDuplicates([id_col, "_node"]).drop("_node").unionByName(docs.where(F.col(id_col).isNull()))
