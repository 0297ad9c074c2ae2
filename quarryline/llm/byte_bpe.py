"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a batch that the worker has not met yet are laid
out in one array of symbols. An inverted index from token pair to places says
where each merge applies; merges are replayed over all words at once, lowest
rank first, and a merge touches only the pairs beside it. The ids of a text
are then those of its pre-tokens in order, and decoding joins the ids' bytes.

The vocabulary file is read once by each worker from an installed package or a
path on every machine. Nothing is exchanged between tasks.

Defined cases: a null text counts as empty; an empty text has no ids; special
strings are ordinary text; repeated rows each get their row; a null id stays
null; other columns are ignored (:func:`encode_texts`) or kept
(:func:`with_tokens`).
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._runtime import lean, texts_of
from .pretokens import split

#: Ids are below 2**SHIFT - 2; the last two mark walls between words and merged places.
SHIFT = 20
WALL, DEAD = (1 << SHIFT) - 1, (1 << SHIFT) - 2
#: Words of one replay: their arrays stay in the processor's cache.
REPLAY_WORDS = 4096
#: Pre-tokens after which a worker's cache ages; results don't depend on it.
CACHE_ENTRIES = 300_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean"


def default_ranks() -> tuple[str, str]:
    """The rank file and the pre-token pattern of the public vocabulary."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class Replay:
    """An encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = pattern
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.token_bytes = _table(self.bytes_of)
        self.token_digits = _table({r: b"%d " % r for r in self.bytes_of})
        #: pre-token -> its ids; once full it becomes the older one, from which what is met again returns
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: left id << SHIFT | right id -> the id that the two merge into
        self.pair: dict[int, int] = {}
        for word, r in self.ranks.items():
            for i in range(1, len(word)):
                left, right = self.ranks.get(word[:i]), self.ranks.get(word[i:])
                if left is not None and right is not None:
                    self.pair[left << SHIFT | right] = r

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        ranks, merged = self.ranks, self.pair.get
        out: list = [None if (r := ranks.get(w)) is None else (r,) for w in words]
        parts = [i for i, ids in enumerate(out) if ids is None]
        one = [ranks[bytes([b])] for b in range(256)]
        token: list[int] = []  # by place; DEAD once merged into the place to its left
        begins = []
        for i in parts:
            begins.append(len(token))
            token += [one[b] for b in words[i]]
            token.append(WALL)
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}  # merged id -> left places of its pairs, in order
        for p, key in enumerate(map(lambda a, b: a << SHIFT | b, token, token[1:])):
            if (r := merged(key)) is not None:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            places = index.pop(r)
            places.sort()
            held: set[int] = set()  # words in which a lower rank has come up meanwhile
            for p in places:
                q = after[p]
                if merged(token[p] << SHIFT | token[q]) != r:
                    continue
                if held and bisect_right(begins, p) in held:
                    if r not in index:
                        index[r] = []
                        heappush(heap, r)
                    index[r].append(p)
                    continue
                token[p], token[q] = r, DEAD
                q = after[p] = after[q]
                before[q] = p
                left = before[p]
                new = merged(r << SHIFT | token[q])
                if new is not None:
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        heappush(heap, new)
                    if new < r:
                        held.add(bisect_right(begins, p))
                if left >= 0:
                    new = merged(token[left] << SHIFT | r)
                    if new is not None:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heappush(heap, new)
                        if new < r:
                            held.add(bisect_right(begins, p))
        alive = [t for t in token if t != DEAD]
        a = 0
        for i in parts:
            b = alive.index(WALL, a)
            out[i] = tuple(alive[a:b])
            a = b + 1
        return out

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids (32-bit) of each of ``pieces``, which are distinct; those not known yet are encoded together."""
        known, older = self.known, self.older
        found = list(map(known.get, pieces))
        new = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = older.get(pieces[i])
                if ids is None:
                    new.append(i)
                else:
                    found[i] = known[pieces[i]] = ids
        for a in range(0, len(new), REPLAY_WORDS):
            part = new[a : a + REPLAY_WORDS]
            for i, ids in zip(part, self.replay([pieces[i].encode() for i in part]), strict=True):
                found[i] = known[pieces[i]] = array("i", ids).tobytes()
        if len(known) > CACHE_ENTRIES:
            self.known, self.older = {}, known
        return found

    def encode_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the bounds of each text's."""
        split_texts = [split(t, self.pattern) for t in texts]
        coded = pa.array([p for pieces in split_texts for p in pieces], pa.large_string()).dictionary_encode()
        own = self.learn(coded.dictionary.to_pylist())
        codes = np.asarray(coded.indices)
        sizes = np.array([len(x) for x in own], np.int64) // 4
        ids = spread(np.frombuffer(b"".join(own), np.int32), np.cumsum(sizes) - sizes, sizes, codes)
        ends = np.r_[0, np.cumsum(sizes[codes])] if len(codes) else np.zeros(1, np.int64)
        return ids, ends[np.cumsum([0, *map(len, split_texts)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_group([text])[0].tolist()

    def decode_group(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the bounds that ``bounds`` of ids have in them."""
        return self._joined(self.token_bytes, ids, bounds)

    def say_group(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with each id in decimal digits and a space behind it."""
        return self._joined(self.token_digits, ids, bounds)

    def _joined(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, starts, sizes = table
        ends = np.r_[0, np.cumsum(sizes[ids])] if len(ids) else np.zeros(1, np.int64)
        return spread(flat, starts, sizes, ids), ends[bounds]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[starts[w]:starts[w] + sizes[w]] for each w of ``which``, in a row."""
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(total)]


def _table(parts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts by number, joined; their starts and sizes."""
    rows = [parts.get(i, b"") for i in range(max(parts) + 1)]
    sizes = np.array(list(map(len, rows)), np.int64)
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(sizes) - sizes, sizes


@lru_cache(maxsize=2)
def replay_of(path: str, pattern: str) -> Replay:
    return Replay(path, pattern)


#: Characters whose pre-tokens are gathered before one replay.
AT_ONCE = 512 << 10


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts by turns, about AT_ONCE characters together."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size < AT_ONCE):
            size += len(texts[b])
            b += 1
        yield texts[a:b]
        a = b


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: digests of its ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = replay_of(path, pattern)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for texts in _groups(batch.column("text").to_pylist()):
                ids, at = codec.encode_group(texts)
                decoded, d = codec.decode_group(ids, at)
                said, s = codec.say_group(ids, at)
                for i, text in enumerate(texts):
                    own, back = text.encode(), decoded[d[i] : d[i + 1]].tobytes()
                    digest = sha256(said[s[i] : max(s[i], s[i + 1] - 1)].tobytes()).hexdigest()
                    for c, v in zip(cols, (int(at[i + 1] - at[i]), digest, sha256(back).hexdigest(), len(own), back == own), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def with_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text in ``out_col``, their number in
    ``n_tokens`` and, in ``round_trip``, whether they decode to the text
    (columns of these names are replaced)."""
    docs = docs.drop(out_col, "n_tokens", "round_trip")
    more = [T.StructField(out_col, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = replay_of(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            ids, sizes, same = [np.zeros(0, np.int32)], [0], []
            for group in _groups(texts):
                own, at = codec.encode_group(group)
                decoded, d = codec.decode_group(own, at)
                ids.append(own)
                sizes += np.diff(at).tolist()
                same += [decoded[d[i] : d[i + 1]].tobytes() == t.encode() for i, t in enumerate(group)]
            offsets = np.cumsum(sizes).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            columns = [*batch.columns, lists, pa.array(np.array(sizes[1:], np.int64)), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.mapInArrow(lean(run), schema)


def decode_ids(tokens: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that each row's ids stand for (null ids: empty; an unknown id: null)."""
    tokens = tokens.drop(out_col)
    schema = T.StructType([*tokens.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = replay_of(path, pattern)
        for batch in batches:
            rows = [codec.decode(r or []) if all(i in codec.bytes_of for i in r or []) else None for r in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*batch.schema.names, out_col])

    return tokens.mapInArrow(run, schema)
