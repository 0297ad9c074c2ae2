"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of frequent pre-tokens and their numbers of
tokens, broadcast once. Its size has a proven bound whatever the corpus: it
holds the pre-tokens that the vocabulary itself has entries for (a BPE
vocabulary lists the frequent ones), so it is never larger than the
vocabulary. Tier two is a cache in each worker: pre-tokens that miss both are
encoded in batches by the tokenizer library and kept. No pre-token is
exchanged between tasks.

Defined cases: a null text counts as empty; an empty text has no tokens; the
vocabulary's special strings inside a text count as the library counts them by
default (one token each); repeated rows each get their row; a null id stays
null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._runtime import texts_of
from .pretokens import split

#: Pre-tokens after which a worker's cache ages; results don't depend on it.
CACHE_ENTRIES = 600_000
#: Characters of text whose pre-tokens are looked up together.
AT_ONCE = 512 << 10
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_specials long, n_encoded long"


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer file and its pre-token pattern."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.PATTERN


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    visible Latin-1 bytes are themselves, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _specials(path: str):
    """A pattern of the special strings, or None."""
    found = sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


def _count(path: str, pieces: list[str]) -> list[int]:
    return [len(e) for e in _tokenizer(path).encode_batch_fast(pieces, add_special_tokens=False)]


def frequent_table(path: str, pattern: str) -> tuple[bytes, np.ndarray]:
    """Tier one: texts of the vocabulary that are one pre-token, joined, and their token counts."""
    back = {c: b for b, c in byte_letters().items()}
    texts = []
    for word in _tokenizer(path).get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[c] for c in word).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if "\x00" not in text and split(text, pattern) == [text]:
            texts.append(text)
    return "\x00".join(texts).encode(), np.array(_count(path, texts), np.uint8)


class Counter:
    """Counts tokens with both tiers."""

    def __init__(self, path: str, pattern: str, joined: bytes, lengths: np.ndarray):
        self.path, self.pattern, self.specials = path, pattern, _specials(path)
        self.frequent = dict(zip(joined.decode().split("\x00"), lengths.tolist(), strict=True))
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _learn(self, missed: set[str]) -> tuple[dict[str, int], int]:
        """Token counts of pre-tokens that tier one lacks, and how many were encoded for them."""
        cache, older = self.cache, self.older
        new = []
        for p in missed:
            if p not in cache:
                if p in older:
                    cache[p] = older[p]
                else:
                    new.append(p)
        if new:
            cache.update(zip(new, _count(self.path, new), strict=True))
        found = {p: cache[p] for p in missed}
        if len(cache) > CACHE_ENTRIES:
            self.cache, self.older = {}, cache
        return found, len(new)

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """Of each text: tokens, special strings, and the pre-tokens that were
        encoded for the group of texts that it begins (else 0)."""
        out: list[tuple[int, int, int]] = []
        frequent = self.frequent
        a = 0
        while a < len(texts):
            group, size = [], 0
            while a < len(texts) and (not group or size < AT_ONCE):
                parts = [texts[a]]
                if self.specials is not None and self.specials.search(texts[a]):
                    parts = self.specials.split(texts[a])
                group.append(([p for part in parts for p in split(part, self.pattern)], len(parts) - 1))
                size += len(texts[a])
                a += 1
            distinct = set().union(*(g[0] for g in group))
            both, new = self._learn(distinct - frequent.keys())
            both.update((p, frequent[p]) for p in distinct & frequent.keys())
            for pieces, specials in group:
                out.append((sum(map(both.__getitem__, pieces)) + specials, specials, new))
                new = 0
        return out


_counters: dict[tuple[str, str], Counter] = {}


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its bytes, its tokens and whether they exceed ``limit``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _counters:
            _counters[path, pattern] = Counter(path, pattern, *table.value)
        counter = _counters[path, pattern]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = counter.count(texts)
            tokens = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([t > limit for t in tokens], pa.bool_()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)
