"""Secret scans by one deterministic automaton over bytes.

All rule regexes become one minimal automaton (:mod:`.automaton`), a transition
array that each text passes once, byte by byte, in UTF-8. It tells which rules
match and where matches end. Only for rules that do match in a text, a reversed
automaton marks where matches begin, and the rule's own automaton gives the
longest match from there; so a rule's matches are the leftmost ones, the
longest from their start, and do not overlap.

A null text counts as empty. Texts of any length are read whole; equal texts
and repeated rows give equal results; an empty table gives no rows. Other
columns of the input are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import length_hint

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton
from .common import slices, table, whole


@dataclass(frozen=True)
class Rule:
    """``pattern`` is what matches; ``value`` and ``least`` then drop matches.

    ``value`` is a regex for the whole match; its last group, or the match if
    it is None, must have ``least`` characters.
    """

    kind: str
    pattern: str
    least: int = 0
    value: str | None = None
    ignore_case: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"([A-Za-z0-9+/_.=-]+)"

# The base kinds in their order, then further credentials. A run
# of hex characters is one match, so part of its floor can stand in the pattern;
# all of it would multiply the automaton's states.
RULES: tuple[Rule, ...] = (
    Rule("assign", _ASSIGN + _VALUE, 6, _ASSIGN + _VALUE, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
)
BASE = ("assign", "access", "hex")

_CONTINUATION = bytes(range(0x80, 0xC0))


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(rules)
        trees = [automaton.parse(r.pattern, r.ignore_case) for r in self.rules]
        self.all = automaton.build(trees, search=True)
        self.forward = [automaton.build([t], search=False) for t in trees]
        self.starts = [automaton.build([automaton.backward(t)], search=True) for t in trees]
        self.values = [r.value and re.compile(r.value.encode(), re.IGNORECASE if r.ignore_case else 0) for r in self.rules]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in that order."""
        step, state, accepting = self.all.next, self.all.start, self.all.accepting
        last: dict[int, int] = {}
        rest = iter(data)
        for b in rest:
            state = step[state + b]
            if state >= accepting:
                end = len(data) - length_hint(rest)
                for k in self.all.labels[state]:
                    last[k] = end
        found = []
        for k, end in last.items():
            found += self._matches(k, data[:end])
        return sorted(found)

    def _matches(self, k: int, data: bytes) -> Iterator[tuple[int, int, int]]:
        """Matches of one rule; ``data`` ends where its last one may."""
        dfa, starts = self.starts[k], []
        state = dfa.start
        rest = iter(data[::-1])
        for b in rest:
            state = dfa.next[state + b]
            if state >= dfa.accepting:
                starts.append(length_hint(rest))
        dfa, over = self.forward[k], 0
        for start in reversed(starts):
            if start < over:
                continue
            state, end = dfa.start, start
            for i in range(start, len(data)):
                state = dfa.next[state + data[i]]
                if state >= dfa.accepting:
                    end = i + 1
                elif state == dfa.dead:
                    break
            over = end
            if self._kept(k, data[start:end]):
                yield start, k, end

    def _kept(self, k: int, match: bytes) -> bool:
        value = self.values[k]
        if value:
            match = value.fullmatch(match).groups()[-1]
        return len(match) >= self.rules[k].least

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        found = self.scan(data)
        if found and not data.isascii():
            points = lambda i: len(data[:i].translate(None, _CONTINUATION))
            found = [(points(s), k, points(e)) for s, k, e in found]
        return [(self.rules[k].kind, s, e) for s, k, e in found]


@lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col`` and ``spans``, an array of (kind, start, end) by start, then by the rules' order.

    One task reads each part of the scan; nothing is shuffled. A row without a
    secret has an empty array.
    """
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("data"))
    kind = {f.name: f.dataType for f in rows.schema}["id"].simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = scanner(rules)
        for part in (p for batch in batches for p in slices(batch, 1)):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in compiled.spans(x)] for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, span)], ["id", "spans"])

    out = rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(F.col("id").alias(id_col), "spans")


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, as counts and digests."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.filter("spans", lambda x: x.kind.isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The gaps between matches give the places of the matches."""
    patterns = {
        "assign": ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + r"""["'']?\x20*[:=]\x20*["'']?""" + _VALUE, "length(regexp_extract(m, '{p}', 2)) >= 6"),
        "access": (r"AKIA[A-Z0-9]+", "length(m) >= 20"),
        "hex": (r"[0-9a-f]+", "length(m) >= 24"),
        "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
        "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "true"),
        "slack": (r"xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
    }
    parts = [
        f"SELECT r, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(string_split_regex(t, '{p}')[:-2]) AS g, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i FROM d"
        for k, (kind, (p, _)) in enumerate(patterns.items())
    ]
    kept = " OR ".join(f"(kind = '{kind}' AND {keep.replace('{p}', p)})" for kind, (p, keep) in patterns.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT r, k, kind, m, sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM matches),
spans AS (SELECT r, k, kind, CAST(e - length(m) AS BIGINT) AS s, kind || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT) AS w FROM placed WHERE {kept})
SELECT d.doc_id,
       count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(w, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
       coalesce(string_agg(w, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN spans USING (r) GROUP BY d.r, d.doc_id"""


OP1_SQL = _sql()
