"""Quality rules: how much of a text repeats itself.

Words, lines and n-word windows are hashed by rolling hashes in numpy for a
whole Arrow batch; a text is judged by the share of its characters inside
duplicated n-grams and duplicated lines, its length and its symbols.
A row needs nothing but itself: no exchange, and a lost executor costs only
its running tasks.

Defined cases: a null text counts as empty; an empty text has no words and
fails; repeated rows each get their row; a null id stays null; other columns
are ignored by :func:`quality_rules` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from ._runtime import lean, texts_of

#: n-gram length -> the largest share of characters inside duplicated n-grams.
MAX_COVERAGE = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
MAX_LINE_CHARS = 0.5
MAX_SYMBOLS_PER_WORD = 0.1
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
#: Bytes of text that are measured together; their arrays take some 20 times as much.
AT_ONCE = 1 << 20

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup_ngram_share double, reason string"
)


def _measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = W.Words(buf, offsets, W.not_space())
    chars = words.chars()
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_words = words.counts.astype(np.int64)
    out = {"n_words": n_words, "word_chars": W.per_text(chars, words.first), "n_symbols": W.per_text(symbol[buf], offsets)}

    not_newline = np.ones(256, bool)
    not_newline[10] = False
    lines = W.Words(buf, offsets, not_newline)
    with_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    key = lines.hashes() ^ W.mix(lines.doc.astype(W.U64))
    at = np.flatnonzero(with_word)
    again = at[W.repeated(key[at])]  # sorted by key, then by place: all but the first of a key are copies
    if len(again):
        again = again[np.flatnonzero(np.r_[False, key[again[1:]] == key[again[:-1]]])]
    copy = np.zeros(len(lines), bool)
    copy[again] = True
    out["n_dup_lines"] = W.per_text(copy, lines.first)
    out["dup_line_chars"] = W.per_text(np.where(copy, lines.chars(), 0), lines.first)

    h, salt = words.hashes(), W.mix(np.arange(len(n_words), dtype=W.U64))
    share, worst = np.zeros(len(n_words)), np.zeros(len(n_words), bool)
    for n, most in MAX_COVERAGE.items():
        key, at = words.rolling(h, n)
        at = at[W.repeated(key ^ salt[words.doc[at]])]
        inside = W.covered(len(words), at, n)
        if n == 5:
            out["n_repeat_words"] = W.per_text(inside, words.first)
        part = W.per_text(np.where(inside, chars, 0), words.first) / np.maximum(out["word_chars"], 1)
        share = np.maximum(share, part)
        worst |= part > most
    out["dup_ngram_share"] = share
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    lines_bad = out["dup_line_chars"] > MAX_LINE_CHARS * np.maximum(out["word_chars"], 1)
    symbols_bad = out["n_symbols"] > MAX_SYMBOLS_PER_WORD * n_words
    out["kept"] = ~(out["base_failed"] | worst | lines_bad | symbols_bad)
    out["reason"] = np.select(
        [n_words < MIN_WORDS, out["base_failed"], worst, lines_bad, symbols_bad],
        ["short", "repeated_words", "repeated_ngrams", "repeated_lines", "symbols"],
        "",
    )
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of an Arrow array."""
    buf, offsets = W.buffer_of(texts)
    parts = [_measure(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in W.slices(offsets, AT_ONCE)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``kept`` and the first reason against it."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = measure(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(m[k]) for k in names[1:])], names=names)

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(measure(batch.column(text_col))["kept"]))

    return docs.mapInArrow(lean(run), docs.schema)
