"""Pre-tokens of byte-level BPE: the pattern's matches, found fast.

The public pattern needs Unicode properties. For texts in which the standard
library's classes agree with them (ASCII and Latin-1 letters, checked by one
scan), an equivalent ``re`` pattern runs; other texts take the ``regex`` one.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Letters, digits, spaces and other characters mean the same to both patterns here.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7f\xa1-\xa9\xab\xac\xae-\xb1\xb4-\xb8\xbb\xbf-ſ‐-‧€]*")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=2)
def _exact(pattern: str):
    import regex

    return regex.compile(pattern)


def split(text: str, pattern: str) -> list[str]:
    """All matches of ``pattern`` in ``text``; together they are the text."""
    return _FAST.findall(text) if _PLAIN.fullmatch(text) else _exact(pattern).findall(text)
