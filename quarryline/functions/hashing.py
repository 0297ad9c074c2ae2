"""Hashes and partition placement that must agree with stored data."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fnv1a64


def fnv1a32(data: bytes) -> int:
    h = 0x811C9DC5
    for b in data:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def shard_of(key: Column, shards: int = 64) -> Column:
    """FNV-1a (32 bits) of a key modulo the number of shards."""

    @F.pandas_udf(T.IntegerType())
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series((fnv_column(keys) % np.uint32(shards)).astype(np.int32))

    return run(key)


def fnv_column(keys: pd.Series, bits: int = 32) -> np.ndarray:
    """FNV-1a of each key's UTF-8 bytes (null: none), a byte of all keys at a step."""
    kind, start, prime = (np.uint32, 0x811C9DC5, 0x01000193) if bits == 32 else (np.uint64, 0xCBF29CE484222325, 0x100000001B3)
    data = [(k or "").encode() for k in keys]
    size = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    first = np.cumsum(size) - size
    out = np.full(len(data), start, kind)
    at, step = np.flatnonzero(size), 0
    while len(at):
        out[at] = (out[at] ^ flat[first[at] + step]) * kind(prime)
        step += 1
        at = at[size[at] > step]
    return out


def partition_of(key: Column, partitions: int = 16) -> Column:
    """The partition of a key among a fixed number of them (none or less: 16): its ring hash modulo that number."""
    n = np.uint64(partitions if partitions > 0 else 16)

    @F.pandas_udf(T.IntegerType())
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series((ring_hashes(keys) % n).astype(np.int32))

    return run(key)


def ring_hashes(keys: pd.Series) -> np.ndarray:
    """:func:`ring_hash` of many keys."""
    h = fnv_column(keys, 64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def ring_hash(key: str) -> int:
    """FNV-1a (64 bits), its bits spread."""
    h = fnv1a64(key.encode())
    h ^= h >> 33
    h = (h * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 33
    h = (h * 0xC4CEB9FE1A85EC53) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 33)


def ring(nodes: Sequence[str], copies: int = 128) -> list[tuple[int, str]]:
    """The tokens of a hash ring, sorted."""
    return sorted((ring_hash(f"{node}#{i}"), node) for node in nodes for i in range(copies))


def ring_node(key: Column, nodes: Sequence[str], copies: int = 128, replicas: int = 1) -> Column:
    """The first ``replicas`` different nodes at or behind a key on the ring."""
    tokens = ring(nodes, copies)
    hashes = np.array([h for h, _ in tokens], np.uint64)
    names = [node for _, node in tokens]
    most = min(replicas, len(set(nodes)))
    behind = []  # by token: the first different nodes from it on
    for i in range(len(names)):
        found: list[str] = []
        for k in range(len(names)):
            if (node := names[(i + k) % len(names)]) not in found:
                found.append(node)
                if len(found) >= most:
                    break
        behind.append(found)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(hashes, ring_hashes(keys)) % max(1, len(hashes))
        return pd.Series([behind[i] for i in at.tolist()], dtype=object)

    return run(key)


def vbyte_encode(values: Sequence[int]) -> bytes:
    """Seven bits a byte, low ones first, the high bit set while more follow."""
    out = bytearray()
    for v in values:
        while v >= 0x80:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        out.append(v)
    return bytes(out)


def vbyte_decode(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(value)
            value = shift = 0
    return out


def encode_postings(doc_ids: Sequence[int], tfs: Sequence[int]) -> bytes:
    """A posting block: gaps between ids, and frequencies, by turns."""
    gaps = np.diff([0, *doc_ids]).tolist()
    return vbyte_encode([x for pair in zip(gaps, tfs, strict=True) for x in pair])


def decode_postings(data: bytes) -> tuple[list[int], list[int]]:
    flat = vbyte_decode(data)
    return np.cumsum(flat[::2]).tolist(), flat[1::2]
