"""Secret scans by one combined deterministic automaton.

All rules are compiled into one minimal automaton (see ``automaton``). One pass over the bytes of a batch notes where
any rule can end; there, a backward automaton of the rule finds the leftmost start and a forward one the longest end.
Almost all text takes part in the one pass only. Narrow plan without a shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .automaton import Automaton, ends_in_one_pass


@dataclass(frozen=True)
class Rule:
    """``head`` is what stands before the value; matches whose value is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    head: str = ""
    least: int = 0


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The first three are the base; their order is that of equal starts. Only the hex rule counts inside the automaton, or
#: every short run would end somewhere; counts of several rules would multiply its states.
RULES = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=\-]+", _ASSIGN, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN( [A-Z0-9]+)* PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_", 36),
)
BASE = 3
MASK = "[SECRET]"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([r.pattern for r in rules], search=True)
        self.forward = [Automaton([r.pattern]) for r in rules]
        self.backward = [Automaton([r.pattern], back=True) for r in rules]
        self.heads = [Automaton([r.head]) if r.head else None for r in rules]

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end) in code points, sorted; leftmost and apart within a rule."""
        data, offsets = common.raw(texts)
        n = len(offsets) - 1
        # a zero byte, which no rule takes, keeps texts apart
        joined = np.insert(data, offsets[1:], 0) if n else data
        begin = offsets + np.arange(n + 1)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        if not len(data):
            return out
        view = None
        for k, ends in ends_in_one_pass(self.all, joined).items():
            if not len(ends):
                continue
            view = joined.tobytes() if view is None else view
            docs = np.searchsorted(begin, ends - 1, side="right") - 1
            edges = np.flatnonzero(np.diff(docs, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                d = int(docs[a])
                out[d].extend(self._one(k, view, int(begin[d]), int(begin[d + 1]) - 1, ends[a:b]))
        for d, found in enumerate(out):
            if found:
                low = int(begin[d])
                chars = np.concatenate([[0], np.cumsum((joined[low : int(begin[d + 1]) - 1] & 0xC0) != 0x80)])
                out[d] = sorted((int(chars[s - low]), k, int(chars[e - low])) for s, k, e in found)
        return out

    def _one(self, k: int, data: bytes, low: int, high: int, ends: np.ndarray):
        rule, head, at, i = self.rules[k], self.heads[k], low, 0
        while i < len(ends):
            start = self.backward[k].earliest(data, int(ends[i]), at)
            if start < 0:
                i += 1
                continue
            end = self.forward[k].longest(data, start, high)
            if end - (head.longest(data, start, high) if head else start) >= rule.least:
                yield start, k, end
            at = end
            i = max(i + 1, int(np.searchsorted(ends, end, side="right")))


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end`` in code points, comma-joined).

    Null and empty texts have no spans: the joined string is empty, its digest that of no bytes. Repeated rows are
    scanned each; an empty table gives no rows.
    """

    def scan(batches):
        common.forget()
        find = scanner(rules)
        for batch in common.text_slices(batches, limit=2 << 20):
            found = find.spans(batch.column(1))
            say = [[f"{rules[k].kind}:{s}:{e}" for s, k, e in x] for x in found]
            base = [",".join(y for y, (_, k, _) in zip(a, x, strict=True) if k < BASE) for a, x in zip(say, found, strict=True)]
            counts = [pa.array([sum(k == j for _, k, _ in x) for x in found], pa.int64()) for j in range(BASE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([",".join(a) for a in say], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return common.id_text(docs).mapInArrow(common.tidy(scan), SCHEMA)


def mask(text: str, spans: list[tuple[int, int, int]], sign: str = MASK) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by ``sign``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], sign]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same columns with secrets masked in ``text`` and ``n_chars``, if there, recounted where a text changed.

    Null texts stay null, empty ones empty; all rows stay, repeated ones each. Other columns of any name pass through. An
    empty table gives an empty one.
    """
    names = docs.columns

    def run(batches):
        common.forget()
        find = scanner(rules)
        for batch in common.text_slices(batches, limit=2 << 20):
            column = batch.column(names.index("text"))
            found = find.spans(column)
            if any(found):
                texts = column.to_pylist()
                changed = {i: mask(texts[i], x) for i, x in enumerate(found) if x}
                arrays = list(batch.columns)
                arrays[names.index("text")] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field("text").type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    arrays[at] = pa.array([len(changed[i]) if i in changed else c for i, c in enumerate(arrays[at].to_pylist())], arrays[at].type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(common.tidy(run), docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.documents(spark, sf_dir))
