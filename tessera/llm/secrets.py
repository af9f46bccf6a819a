"""Secret scans with a trigram inverted index.

From each rule's regex a Boolean query over lower-cased trigrams is derived that every match
satisfies. Documents are indexed a segment (an Arrow batch) at a time: the segment's texts lie
side by side, and for each trigram that some rule asks for the index has a posting list of the
documents that hold it. A rule's query intersects and unites posting lists, and only the
documents left are verified with the regex itself. A rule whose regex demands no trigram scans
all documents. Segments are independent, so nothing is shuffled and a lost one is built again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import as_bytes

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_constants as _c
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    """A match counts if it, or its ``group``, has ``least`` characters. ``base`` rules are the fixed ones."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


# Fixed patterns: the base rules in their order, then the formats of well-known credentials.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]+", 32, 0, True),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"\b[sr]k_live_[A-Za-z0-9]{20,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no demand), or ("and" | "or", frozenset of trigrams and queries).
Query = bool | tuple


def _all(parts: list) -> Query:
    parts = {p for p in parts if p is not True}
    if not parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any(parts: list) -> Query:
    if any(p is True for p in parts):
        return True
    parts = set(parts)
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _grams(text: str) -> Query:
    raw = text.lower().encode()
    return _all([raw[i : i + 3] for i in range(len(raw) - 2)])


#: Strings that a part can be are followed up to this many at once.
MOST = 16


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """What a parsed regex matches: all the strings it can be (None: too many to list), and a query that any match meets."""
    exact = {""}
    demands: list = []

    def flush() -> None:
        nonlocal exact
        if exact != {""}:
            demands.append(_any([_grams(x) for x in exact]))
        exact = {""}

    whole = True
    for op, arg in parsed:
        strings, query = _step(op, arg)
        if strings is not None and len(exact) * len(strings) <= MOST:
            exact = {a + b for a in exact for b in strings}
            continue
        flush()
        whole = False
        if strings is not None:
            exact = set(strings)
        else:
            demands.append(query)
    if whole:
        return exact, True
    flush()
    return None, _all(demands)


def _step(op, arg) -> tuple[set[str] | None, Query]:
    if op is _c.LITERAL:
        return {chr(arg)}, True
    if op is _c.AT:
        return {""}, True
    if op is _c.IN:
        chars = {chr(a) for o, a in arg if o is _c.LITERAL}
        listed = all(o is _c.LITERAL for o, _ in arg) and len(chars) <= MOST
        return (chars if listed else None), True
    if op is _c.SUBPATTERN:
        return _walk(arg[-1])
    if op is _c.BRANCH:
        each = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in each) and len(union := set().union(*[s for s, _ in each])) <= MOST:
            return union, True
        return None, _any([_any([_grams(x) for x in s]) if s is not None else q for s, q in each])
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT, getattr(_c, "POSSESSIVE_REPEAT", None)):
        low, high, body = arg
        strings, query = _walk(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, True
        if low == 0:
            return None, True
        return None, _any([_grams(x) for x in strings]) if strings is not None else query
    return None, True


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-cased trigrams that every text with a match satisfies; True: no trigram is mandatory."""
    strings, query = _walk(_parser.parse(pattern, re.ASCII))
    return _any([_grams(x) for x in strings]) if strings is not None else query


def query_grams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*[query_grams(q) for q in query[1]])


class Segment:
    """The posting lists of some texts, for the trigrams asked for."""

    def __init__(self, texts: list[bytes], grams: list[bytes]) -> None:
        self.n = len(texts)
        codes = np.array(sorted({g[0] << 16 | g[1] << 8 | g[2] for g in grams}), np.uint32)
        wanted = np.zeros(1 << 24, bool)
        wanted[codes] = True
        pairs = []
        start, held, size = 0, [], 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= 1 << 22 or i == len(texts) - 1:  # a bounded stretch at a time
                pairs.append(self._stretch(held, start, wanted))
                start, held, size = i + 1, [], 0
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        gram, doc = found >> 32, found & 0xFFFFFFFF
        first = np.searchsorted(gram, codes.astype(np.int64))
        last = np.searchsorted(gram, codes.astype(np.int64), "right")
        self.postings = {int(c): doc[a:b] for c, a, b in zip(codes, first, last, strict=True)}

    @staticmethod
    def _stretch(texts: list[bytes], start: int, wanted: np.ndarray) -> np.ndarray:
        joined = np.frombuffer(b"\n\n".join(texts).lower(), np.uint8)
        if len(joined) < 3:
            return np.zeros(0, np.int64)
        code = joined[:-2].astype(np.uint32)
        code <<= 8
        code |= joined[1:-1]
        code <<= 8
        code |= joined[2:]
        at = np.flatnonzero(wanted[code])
        ends = np.cumsum([len(t) + 2 for t in texts])
        return np.unique(code[at].astype(np.int64) << 32 | (np.searchsorted(ends, at, "right") + start))

    def find(self, query: Query) -> np.ndarray:
        """The documents that satisfy a query, in order."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query[0] << 16 | query[1] << 8 | query[2]]
        lists = sorted((self.find(q) for q in query[1]), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_TOKEN_START = re.compile(r"\beyJ[A-Za-z0-9_-]{10}", re.ASCII)


def jwt_spans(text: str) -> list[tuple[int, int]]:
    """The matches of the ``jwt`` rule, each run of its characters looked at once: a match is three parts between dots, of which the first may begin inside its part."""
    found = []
    for run in _DOTTED.finditer(text):
        if text.find(".eyJ", run.start(), run.end()) < 0:
            continue
        parts, at, i = run[0].split("."), run.start(), 0
        while i + 2 < len(parts):
            start = None
            if len(parts[i + 2]) >= 10 and len(parts[i + 1]) >= 13 and parts[i + 1].startswith("eyJ"):
                start = _TOKEN_START.search(parts[i])
            step = 3 if start else 1
            size = sum(map(len, parts[i : i + step])) + step
            if start:
                found.append((at + start.start(), at + size - 1))
            at += size
            i += step
    return found


def matches(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    if rule.kind == "jwt":
        return jwt_spans(text)
    return [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]


_LONG_HEX = re.compile(rb"[0-9a-f]{32}")
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def span_text(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """``kind:start:end`` by start, then by the kinds' order."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_batch(texts: list[bytes], rules: tuple[Rule, ...], queries: list[Query]) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, rule's place, end) of all matches, in code points."""
    segment = Segment(texts, sorted(set().union(*[query_grams(q) for q in queries])))
    decoded: dict[int, str] = {}
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        pattern = rule.compiled()
        for i in segment.find(query).tolist():
            if rule.kind == "hex" and not _LONG_HEX.search(texts[i]):
                continue  # its own scan of the whole text, over bytes
            text = decoded.get(i)
            if text is None:
                text = decoded[i] = texts[i].decode()
            found[i] += [(a, k, b) for a, b in matches(rule, pattern, text)]
    return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` plus the columns of ``SCHEMA`` for each row's whole text (null: empty).

    A span of a rule that is not a base one is dropped where it lies in a base span. Equal rows
    give equal rows; an empty table none; other columns are not read.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    kinds = [r.kind for r in rules]
    base = [k for k, r in enumerate(rules) if r.base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in scan_batch(as_bytes(batch, "text"), rules, queries):
                own = [s for s in spans if s[1] in base]
                more = [s for s in spans if s[1] not in base and not any(o[0] <= s[0] and s[2] <= o[2] for o in own)]
                counts = [sum(s[1] == k for s in own) for k in base]
                rows.append((*counts, hashlib.sha256(span_text(own, kinds).encode()).hexdigest(), span_text(own + more, kinds)))
            columns = list(zip(*rows, strict=True)) or [()] * (len(base) + 2)
            types = [pa.int64()] * len(base) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", *names])

    names = [f"n_{kinds[k]}" for k in base] + ["base_sha256", "spans"]
    schema = "doc_id long, " + ", ".join(f"{n} {'long' if n.startswith('n_') else 'string'}" for n in names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op9_secret_scan(docs: DataFrame) -> DataFrame:
    return scan(docs)


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _oracle() -> str:
    """DuckDB SQL of the scan with all rules: matches and what lies between them give the matches' places."""
    keyword = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
    patterns = [RULES[0].pattern.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{keyword})"), *[r.pattern for r in RULES[1:]]]
    parts = []
    for k, (rule, p) in enumerate(zip(RULES, patterns, strict=True)):
        q = "'" + p.replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, {q}) AS m, regexp_extract_all(t, {q}, {rule.group}) AS g, string_split_regex(t, {q}) AS s, {rule.least} AS least FROM d")
    base = sum(r.base for r in RULES)
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    line = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT doc_id, k, kind, least, generate_subscripts(m, 1) AS i, unnest(m) AS x, unnest(g) AS y, unnest(s[1:len(m)]) AS z FROM m WHERE len(m) > 0),
p AS (SELECT doc_id, k, kind, length(y) >= least AS ok,
  CAST(sum(length(z) + length(x)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(x) AS BIGINT) AS a,
  CAST(sum(length(z) + length(x)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS b FROM e),
f AS (SELECT * FROM p WHERE ok),
o AS (SELECT * FROM f WHERE k < {base} OR NOT EXISTS (SELECT 1 FROM f w WHERE w.doc_id = f.doc_id AND w.k < {base} AND w.a <= f.a AND f.b <= w.b)),
n AS (SELECT doc_id, {counts}, {line} FILTER (k < {base}) AS own, {line} AS spans FROM o GROUP BY 1)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in RULES if r.base)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""


OP9_SQL = _oracle()
