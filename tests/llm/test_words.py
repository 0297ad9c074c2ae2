"""Hashes of words and lines."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import quality, substring_dedup
from quarryline.llm import words as W


def thue_morse(a: str, b: str, n: int) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def hashed(texts: list[str], lane: int = 0) -> list[int]:
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64)
    starts = ends - np.array([len(x) for x in data], np.int64)
    return W.hash_spans(np.frombuffer(b"".join(data), np.uint8), starts, ends, lane).tolist()


def test_equal_bytes_alone_have_equal_hashes():
    rng = random.Random(5)
    made = {"".join(rng.choices("ab", k=n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 63, 1023, 1024, 1025, 5000) for _ in range(40)}
    texts = sorted(made)
    for lane in (0, 1):
        first = hashed(texts, lane)
        assert len(set(first)) == len(texts)
        mixed = rng.sample(texts, len(texts))
        assert dict(zip(mixed, hashed(mixed, lane), strict=True)) == dict(zip(texts, first, strict=True))
    assert not set(hashed(texts, 0)) & set(hashed(texts, 1))


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 4096])
def test_thue_morse_words_and_lines_differ(n):
    """Such words are equal to every polynomial hash modulo a power of two."""
    a, b = thue_morse("a", "b", n), thue_morse("b", "a", n)
    assert len(set(hashed([a, b]))) == len(set(hashed([a, b], 1))) == 2
    text = "\n".join([f"w {a}", f"w {b}", f"w {a}"])
    assert quality.measure(pa.array([text]))["n_dup_lines"].tolist() == [1]


def test_thue_morse_words_are_not_removed(spark):
    a, b = thue_morse("a", "b", 2048), thue_morse("b", "a", 2048)
    words = [f"k{i}" for i in range(40)]
    texts = [" ".join([*words[:10], x, *words[10:30]]) for x in (a, b, a)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == {0: 0, 1: 20, 2: 31}
