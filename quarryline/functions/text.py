"""Text as columns: tokens, stems, n-gram features, sanitizers, Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import EMBED_TRIM, STOPWORDS, TOKEN_TRIM


#: Unicode's white space but the blank.
SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def blanks(text: Column) -> Column:
    """A text with a blank for each white space (Unicode's); null: empty."""
    bare = F.coalesce(text, F.lit(""))
    for c in SPACES:
        bare = F.replace(bare, F.lit(c), F.lit(" "))
    return bare


def fields(text: Column) -> Column:
    """The runs between white space (Unicode's), as an array; none for null or blank texts.

    Searches for single characters and a split at blanks need no regular expression, which would test each character."""
    return F.array_remove(F.split(blanks(text), " "), "")


def trimmed(token: Column, chars: str = TOKEN_TRIM) -> Column:
    edges = list(chars)
    edge = F.substring(token, 1, 1).isin(edges) | F.substring(token, -1, 1).isin(edges)
    return F.when(edge, F.btrim(token, F.lit(chars))).otherwise(token)  # trimming is dear, and few need it


def is_stopword(token: Column) -> Column:
    return F.lower(token).isin(*STOPWORDS)


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl, pos, term): terms that are neither empty nor stopwords. pos
    counts all tokens, so stopwords leave gaps; dl is the number of all tokens."""
    raw = docs.select(F.col(id_col).alias("doc_id"), fields(F.lower(F.col(text_col))).alias("raw"))
    # An inner explosion would make the optimizer split each text once more, to filter empty ones.
    flat = raw.select("doc_id", F.size("raw").cast("long").alias("dl"), F.posexplode_outer("raw").alias("pos", "token"))
    terms = flat.select("doc_id", "dl", "pos", trimmed(F.col("token")).alias("term"))
    return terms.where((F.col("term") != "") & ~F.col("term").isin(*STOPWORDS))


# --- stemming -----------------------------------------------------------------

_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _kinds(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last none of w, x, y."""
    return len(stem) > 2 and _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _kinds(stem)[-1] == "c"


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    """The first rule whose suffix fits decides, whether or not its stem is long enough."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Porter stem (published algorithm) of a lower-cased word; words of up to two bytes stay."""
    word = word.lower().strip()
    if len(word.encode()) <= 2:
        return word
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-3] + "i"
    elif len(word) > 1 and word[-1] == "s" != word[-2]:
        word = word[:-1]

    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                base = word[: -len(suffix)]
                if "v" in _kinds(base):
                    if base.endswith(("at", "bl", "iz")):
                        word = base + "e"
                    elif _double(base):
                        word = base if base[-1] in "lsz" else base[:-1]
                    elif _measure(base) == 1 and _short(base):
                        word = base + "e"
                    else:
                        word = base
                break

    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    if len(word) > 1:
        word = _replace(word, _STEP2)
    word = _replace(word, _STEP3)

    # Of suffixes that end alike the longest counts.
    fits = max((s for s in _STEP4 if word.endswith(s)), key=len, default="")
    if fits:
        base = word[: -3 if fits in ("sion", "tion") else -len(fits)]
        if _measure(base) > 1:
            word = base

    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """``terms`` with ``column`` stemmed. Only distinct words reach Python; the vocabulary is joined back."""
    words = terms.select(column).distinct().withColumn("_stem", stem_column(column))
    return terms.join(words, column).withColumn(column, F.col("_stem")).drop("_stem")


# --- hashed n-gram embedding ----------------------------------------------------


def fnv1a64(data: bytes, seed: int = 0xCBF29CE484222325) -> int:
    h = seed
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=100_000)
def _fnv_text(text: str) -> int:
    return fnv1a64(text.encode())


def embed(text: str, dim: int = 128) -> np.ndarray:
    """Hashed features of each kept word, its 3-grams and 4-grams, L2-normalized.

    Both hashes of the model have one seed, so a feature's sign is the parity
    of its place when ``dim`` is even; kept as it is."""
    out = np.zeros(dim)
    for token in (text or "").lower().split():
        word = token.strip(EMBED_TRIM)
        if not word or word in _STOP:
            continue
        for feature in [word, *(word[i : i + n] for n in (3, 4) for i in range(len(word) - n + 1))]:
            h = _fnv_text(feature)
            out[h % dim] += -1.0 if h & 1 else 1.0
    norm = np.sqrt((out * out).sum())
    return out / norm if norm > 0 else out


_STOP = frozenset(STOPWORDS)
#: Characters of text, and words, that are embedded at once.
EMBED_CHARS, EMBED_WORDS = 1 << 19, 1 << 13
#: Bytes up to which words are hashed side by side.
SHORT = 32


def _spans(letters: np.ndarray, lengths: np.ndarray, n: int | None, dim: int) -> np.ndarray:
    """By word: the sums of its features of ``n`` letters (None: the word itself) in each dimension.
    letters: bytes of words, 0 behind their ends."""
    size, width = letters.shape
    starts = 1 if n is None else width - n + 1
    if starts < 1:
        return np.zeros((size, dim))
    h = np.full((size, starts), 0xCBF29CE484222325, np.uint64)
    for i in range(width if n is None else n):
        byte = letters[:, i : i + starts].astype(np.uint64)
        moved = (h ^ byte) * np.uint64(0x100000001B3)
        h = np.where(lengths[:, None] > i, moved, h) if n is None else moved
    there = np.arange(starts) <= (lengths - (n or 1))[:, None] if n is not None else lengths[:, None] > 0
    word, place = np.nonzero(there)
    own = h[word, place]
    sign = np.where(own & np.uint64(1), -1.0, 1.0)
    return np.bincount(word * dim + (own % np.uint64(dim)).astype(np.int64), sign, minlength=size * dim).reshape(size, dim)


def _features(words: list[str], dim: int) -> np.ndarray:
    """By word: the sum of its features in each dimension; zeros for words that are left out."""
    bare = [w.strip(EMBED_TRIM) for w in words]
    bare = ["" if w in _STOP else w for w in bare]
    short = [w.encode() if w.isascii() and len(w) <= SHORT and "\0" not in w else b"" for w in bare]
    lengths = np.fromiter(map(len, short), np.int64, len(short))
    letters = np.array(short, f"S{max(1, int(lengths.max(initial=0)))}")
    letters = letters.view(np.uint8).reshape(len(short), -1)
    out = sum(_spans(letters, lengths, n, dim).astype(np.float32) for n in (None, 3, 4))
    for at, word in enumerate(bare):
        if word and not lengths[at]:
            for feature in [word, *(word[i : i + n] for n in (3, 4) for i in range(len(word) - n + 1))]:
                h = _fnv_text(feature)
                out[at, h % dim] += -1.0 if h & 1 else 1.0
    return out


def embed_all(texts: list[str | None], dim: int = 128) -> np.ndarray:
    """:func:`embed` of each text: distinct words of neighbouring texts are hashed once, side by side."""
    out = np.zeros((len(texts), dim))
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high] or "") <= EMBED_CHARS):
            size += len(texts[high] or "")
            high += 1
        numbers: dict[str, int] = {}
        words = [[numbers.setdefault(w, len(numbers)) for w in (t or "").lower().split()] for t in texts[low:high]]
        distinct = list(numbers)
        features = np.concatenate([np.zeros((0, dim), np.float32), *(_features(distinct[i : i + EMBED_WORDS], dim) for i in range(0, len(distinct), EMBED_WORDS))])
        for row, own in enumerate(words, low):
            for i in range(0, len(own), EMBED_WORDS):
                out[row] += features[own[i : i + EMBED_WORDS]].sum(axis=0, dtype=float)
        low = high
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


#: Texts that are embedded before their vectors are handed on.
EMBED_TEXTS = 512


def embedding(text: Column, dim: int = 128) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for low in range(0, len(texts), EMBED_TEXTS):
                own = embed_all(texts.slice(low, EMBED_TEXTS).to_pylist(), dim)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * dim, pa.int32()), pa.array(own.ravel()))

    return run(text)


# --- Markdown and prompts ---------------------------------------------------------


def sanitize_context(text: Column) -> Column:
    """Escapes opening and closing context delimiters."""
    return F.regexp_replace(text, r"(?i)<(/?context)>", "&lt;$1&gt;")


def sanitize_untrusted(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)<(/?untrusted_webpage_content)>", "&lt;$1&gt;")


def extract_field(markdown: Column, field: str) -> Column:
    """The first line that has ``field`` in it, without one # and one -, or null."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.contains(F.lower(x), F.lit(field.lower())))
    bare = F.trim(F.get(lines, 0))
    for mark in ("#", "-"):
        bare = F.trim(F.regexp_replace(bare, f"^{mark}", ""))
    return bare


def truncate_markdown(markdown: str, budget: int) -> tuple[str, int, bool]:
    """Text within a budget of words: cut at four bytes a word, back to the last heading."""
    n = len(markdown.split())
    if n <= budget:
        return markdown, n, False
    cut = markdown.encode()[: 4 * budget]
    heading = cut.rfind(b"\n#")
    kept = (cut[:heading] if heading > 0 else cut).decode(errors="ignore").strip()
    return kept, len(kept.split()), True


def plain_title(text: Column, fallback: Column) -> Column:
    """A plain text's title: its first ``# `` line, else its first line of 1 to 80 bytes, else ``fallback``."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    heading = F.get(F.filter(lines, lambda x: x.startswith("# ")), 0)
    short = F.get(F.filter(lines, lambda x: (F.octet_length(x) > 0) & (F.octet_length(x) <= 80)), 0)
    name = F.regexp_replace(F.regexp_replace(heading, "^# ", ""), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.when(name != "", name), short, fallback)


def slugify(text: Column) -> Column:
    """White space to hyphens, other characters than letters, digits and hyphens dropped; case is kept."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", "-"), r"[^A-Za-z0-9-]", "")
