"""Secrets in texts, found by one automaton for all rules in one pass over the bytes.

Each rule has a trigger, a pattern for the shortest text that shows it is there. The triggers of all rules are compiled together by
subset construction and minimisation. Where the pass reaches an accepting state, the rule's reversed trigger leads back to the start
and its whole pattern, anchored there, on to the end: leftmost, longest, and not overlapping an earlier match of the same rule.

Defined cases: null text counts as empty and has no span; rows that repeat are scanned each by itself; an empty table gives no row;
offsets are code points, ends exclusive. Patterns are over ASCII, so letters of other scripts never fold onto theirs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.automaton import Automaton, backwards, parse
from sparkloom.llm.common import table


@dataclass(frozen=True)
class Rule:
    """whole: the pattern of a match; trigger: of its shortest beginning that tells it apart; a match counts if it has least bytes in
    all, and least_tail of tail's characters at its end."""

    kind: str
    whole: str
    trigger: str
    any_case: bool = False
    least: int = 0
    tail: str = ""
    least_tail: int = 0


_KEYS = "(password|passwd|secret|token|api_?key)"
_SEP = "[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=\\-]"
_KEY_HEAD = "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
_KEY_BODY = "(-{0,4}[^\\-])*-----END [A-Z ]{0,24}PRIVATE KEY-----"  # on to the next five dashes, which begin the END line

BASE = (
    Rule("assign", f"{_KEYS}{_SEP}{_VALUE}+", f"{_KEYS}{_SEP}{_VALUE}", any_case=True, tail=_VALUE, least_tail=6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", least=20),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}"),
)
MORE = (
    Rule("private_key", f"{_KEY_HEAD}({_KEY_BODY})?", _KEY_HEAD),
    Rule("host_token", "gh[opsur]_[A-Za-z0-9]{36,}", "gh[opsur]_[A-Za-z0-9]", least=40),
    Rule("signed_token", "eyJ[A-Za-z0-9_\\-]{10,}\\.eyJ[A-Za-z0-9_\\-]{10,}\\.[A-Za-z0-9_\\-]{10,}", "eyJ[A-Za-z0-9_\\-]{10}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9\\-]{10,}", "xox[abprs]-[A-Za-z0-9\\-]"),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([parse(r.trigger, r.any_case) for r in rules], anywhere=True)
        self.back = [Automaton([backwards(parse(r.trigger, r.any_case))], anywhere=False) for r in rules]
        self.on = [Automaton([parse(r.whole, r.any_case)], anywhere=False) for r in rules]
        self.tail = [Automaton([parse(r.tail + "+")], anywhere=False) if r.tail else None for r in rules]

    def triggers(self, data: bytes) -> list[tuple[int, int]]:
        """The one pass: (position, accepting state)."""
        t, least, s = self.all.table, self.all.accepting, self.all.start
        found = []
        for p, b in enumerate(data):
            s = t[s + b]
            if s >= least:
                found.append((p, s))
        return found

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, by start and then rule."""
        data = (text or "").encode("utf-8", "surrogatepass")
        ends, out = [0] * len(self.rules), []
        for p, state in self.triggers(data):
            for rule in self.all.rules[state]:
                if p < ends[rule]:
                    continue
                start = self._start(rule, data, p, ends[rule])
                if start is None:
                    continue
                size = self.on[rule].longest(data, start)
                if size < 0:
                    continue
                ends[rule] = start + size
                r = self.rules[rule]
                if size >= r.least and (not r.tail or self._tail(rule, data, start, start + size) >= r.least_tail):
                    out.append((start, start + size, rule))
        out.sort(key=lambda x: (x[0], x[2]))
        if out and not (text or "").isascii():
            points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            points = np.concatenate([[0], points])
            out = [(int(points[a]), int(points[b]), r) for a, b, r in out]
        return out

    def _start(self, rule: int, data: bytes, p: int, least: int) -> int | None:
        n = self.back[rule].longest(data[least : p + 1], p - least, -1)
        return p + 1 - n if n > 0 else None

    def _tail(self, rule: int, data: bytes, start: int, end: int) -> int:
        """Bytes of the last part of a match: what follows the shortest beginning that the trigger takes, less one."""
        a = self._trigger_end(rule, data, start)
        return end - a

    def _trigger_end(self, rule: int, data: bytes, start: int) -> int:
        auto = self._anchored(rule)
        s, t, i = auto.start, auto.table, start
        while s < auto.accepting:
            s = t[s + data[i]]
            i += 1
        return i - 1

    @functools.lru_cache(maxsize=64)  # noqa: B019  a scanner lives as long as its worker
    def _anchored(self, rule: int) -> Automaton:
        return Automaton([parse(self.rules[rule].trigger, self.rules[rule].any_case)], anywhere=False)


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[r].kind}:{a}:{b}" for a, b, r in spans)


def _scan(rules: tuple[Rule, ...]) -> Callable:
    def run(batches):
        import pyarrow as pa

        scan, base = scanner(rules), len(BASE)
        for batch in batches:
            all_spans = [scan.spans(t) for t in batch.column(1).to_pylist()]
            own = [[x for x in s if x[2] < base] for s in all_spans]
            counts = [pa.array([sum(x[2] == k for x in s) for s in own], pa.int64()) for k in range(base)]
            digest = [hashlib.sha256(_joined(s, rules).encode()).hexdigest() for s in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest), pa.array([_joined(s, rules) for s in all_spans])], ["doc_id", *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by base kind, a digest of the base spans, and all spans."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_scan(RULES), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        found = scanner(RULES)
        for batch in batches:
            texts = [_masked(t, found) for t in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def _masked(text: str | None, found: Scanner) -> str | None:
    spans = found.spans(text) if text else []
    out, at = [], 0
    for a, b, r in spans:
        if a >= at:
            out += [text[at:a], f"[{found.rules[r].kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
