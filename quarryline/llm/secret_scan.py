"""Secret scans by one combined deterministic automaton.

Each rule has a probe, the shortest beginning that shows a match is there. All
probes are compiled together (subset construction, minimisation) into one
transition array, and one pass over a text's bytes runs all rules. Where a
probe ends, the rule's own small automata fix the span: the reversed probe
finds the leftmost start, the whole rule the longest end. Spans of a rule are
leftmost and do not overlap; those that fail its length test are dropped after
they were taken, as a scan with the plain expression would do.

A row needs nothing but itself: no exchange.

Defined cases: a null text counts as empty; an empty text has no spans;
repeated rows each get their row; a null id stays null; other columns are
ignored by :func:`find_secrets` and kept by :func:`redact`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._runtime import lean, texts_of
from .automaton import Dfa, parse, reverse

VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?"""


@dataclass(frozen=True)
class Rule:
    """kind; probe; the whole expression; least bytes of the match; least bytes from the probe's last byte on."""

    kind: str
    probe: str
    whole: str
    least: int = 1
    least_value: int = 1


#: The first three are the base kinds, in the order in which they are listed.
RULES = (
    Rule("assign", ASSIGN + VALUE, ASSIGN + VALUE + "+", least_value=6),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]+", least=24),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]", "gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]+", least=24),
    Rule("cloud", "AIza[A-Za-z0-9_-]", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]", "[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


class Scanner:
    """The rules, compiled. rows: by state a list of 256 next rows and, last, the rules whose probe ends there."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        dfa = Dfa([parse(r.probe) for r in rules], anywhere=True)
        self.states, self.subsets = len(dfa.next), dfa.subsets
        rows: list[list] = [[] for _ in dfa.next]
        for row, to, accepts in zip(rows, dfa.next, dfa.accepts, strict=True):
            row.extend(rows[t] for t in to)
            row.append(accepts)
        self.start = rows[0]
        self.back = [Dfa([reverse(parse(r.probe))]) for r in rules]
        self.whole = [Dfa([parse(r.whole)]) for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order."""
        found = []
        done = [0] * len(self.rules)
        row = self.start
        for i, b in enumerate(data, 1):
            row = row[b]
            if row[256]:
                for r in row[256]:
                    if i <= done[r]:
                        continue
                    start = self.back[r].longest(data, i, -1, done[r])
                    if start < 0:
                        continue
                    end = self.whole[r].longest(data, start, 1, len(data))
                    if end < 0:
                        continue
                    done[r] = end
                    if end - start >= self.rules[r].least and end - i + 1 >= self.rules[r].least_value:
                        found.append((start, r, end))
        return sorted(found)

    def char_spans(self, text: str) -> list[tuple[int, int, int]]:
        """The same in code points."""
        data = text.encode()
        found = self.spans(data)
        if found and len(data) != len(text):
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=total[1:])
            found = [(int(total[s]), r, int(total[e])) for s, r, e in found]
        return found


@lru_cache(maxsize=4)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base kinds' counts and digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(rules)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(BASE)]
            digests, all_spans, numbers = [], [], []
            for text in batch.column("text").to_pylist():
                found = scanner.char_spans(text)
                base = [x for x in found if x[1] < BASE]
                for k in range(BASE):
                    counts[k].append(sum(x[1] == k for x in base))
                said = [",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in x) for x in (base, found)]
                digests.append(sha256(said[0].encode()).hexdigest())
                all_spans.append(said[1])
                numbers.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(numbers, pa.int64())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret (overlapping spans as one) replaced by ``mark``."""

    def clean(scanner: Scanner, text: str | None) -> str | None:
        found = scanner.char_spans(text) if text else []
        if not found:
            return text
        parts, at = [], 0
        until = -1
        for start, _, end in found:
            if start >= until:
                parts += [text[max(at, 0) : start], mark]
            until = max(until, end)
            at = until
        return "".join(parts) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(rules)
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = pa.array([clean(scanner, t) for t in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], texts, *batch.columns[k + 1 :]], schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
