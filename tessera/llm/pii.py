"""Personal data by fixed patterns and a skip-chain conditional random field.

The fixed patterns' spans always stand. The field then labels the tokens of each whole document:
neighbours are linked as in a chain, and skip edges link distant tokens that repeat or resemble
each other, so that what is clearly an entity in one place is recognised in another where its
own form is weaker (a phone number without its plus sign, an address with its at sign spelt out).
Loopy belief propagation passes messages along both kinds of edges until they settle.

Only tokens that hold a digit or an at sign, or stand beside one, can be part of an entity; all
others are outside by a hard zero in their potentials. A token that is surely outside passes on a
constant, so inference over the whole document needs the other tokens alone. All its potentials
are trained together, by pseudo-likelihood: each candidate token's label given its features and
the labels at the other ends of its edges, where the documents' own base spans are the labels and
every token is seen once whole and once with its strong form hidden. Spark counts the distinct
configurations over all documents; the fit needs these counts alone.
"""

from __future__ import annotations

import hashlib
import re
from ast import literal_eval
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_text

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LABELS = OUTSIDE + 1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each at sign back over the local part, not into the last match, then forth over the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end()))
            at = text.find("@", end)
        else:
            # what lies before this sign can't start a later match
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns' matches, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# Candidates start where a word does: numbers in groups with single blanks between, or a word with a digit or an at sign.
_CANDIDATE = re.compile(
    r"(?<![^\x20\x09-\x0D])(?:\+?\(?[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+)++|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
# An address spelt out: its sign, from which the part before is found backwards, and the part after.
_SPELT_AT = re.compile(r"\x20?[\[(](?:at|AT)[\])]\x20?")
_SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++")
_TRIM = "\"'.,;:!?()[]{}<>*#$%&|="


@dataclass
class Token:
    start: int
    end: int
    text: str
    label: int  # of the base span that it lies in or that lies in it, else OUTSIDE
    word: int  # how many words come before it


def _spelt(text: str) -> list[tuple[int, int]]:
    """Where addresses stand that spell out their signs; every character is looked at a bounded number of times."""
    out, end = [], 0
    m = _SPELT_AT.search(text)
    while m:
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        after = _SPELT_DOMAIN.match(text, m.end()) if start < m.start() else None
        if after:
            out.append((start, after.end()))
        end = after.end() if after else m.end()
        m = _SPELT_AT.search(text, end)
    return out


def tokens(text: str, spans: list[tuple[int, int, int]]) -> list[Token]:
    """The document's candidate tokens in order, in time proportional to the text."""
    out, k = [], 0
    words_before, last = 0, 0
    found = [m.span() for m in _CANDIDATE.finditer(text)]
    if spelt := _spelt(text):
        ends = [b for _, b in spelt]
        apart = lambda a, b: (i := bisect_right(ends, a)) == len(spelt) or b <= spelt[i][0]
        found = sorted(spelt + [s for s in found if apart(*s)])
    for at, stop in found:
        raw = text[at:stop]
        a = at + len(raw) - len(raw.lstrip(_TRIM.replace("(", "")))
        b = stop - (len(raw) - len(raw.rstrip(_TRIM)))
        if b <= a:
            continue
        while k and spans[k - 1][2] > a:
            k -= 1
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        label = spans[k][1] if k < len(spans) and spans[k][0] < b else OUTSIDE
        words_before += len(text[last:at].split())
        last = stop
        out.append(Token(a, b, text[a:b], label, words_before))
        words_before += 1
    return out


_SPELT = re.compile(r"\x20?[\[(](at|dot)[\])]\x20?", re.I)


def normal_form(token: str) -> str:
    """What tokens that mean the same have in common: digits of a number, an address in lower case."""
    plain = _SPELT.sub(lambda m: "@" if m[1].lower() == "at" else ".", token)
    if "@" in plain:
        return plain.lower()
    digits = _NOT_DIGIT.sub("", plain)
    letters = sum(c.isalpha() for c in plain)
    if len(digits) >= 7 and not letters:
        return digits if plain.count(".") != 3 else plain
    return plain.lower()


FEATURES = 24


def features(token: str, hide: bool = False) -> list[int]:
    """The places of the features that hold. ``hide``: without the strong form that the base patterns demand."""
    plain = _SPELT.sub(lambda m: "@" if m[1].lower() == "at" else ".", token)
    digits = _NOT_DIGIT.sub("", plain)
    n, letters = len(digits), sum(c.isalpha() for c in plain)
    dots = plain.count(".")
    shape = plain.replace("(", "").replace(")", "")
    quad = re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", plain) is not None
    address = re.fullmatch(r"[^@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", plain) is not None
    on = [
        True, "@" in plain, address, letters == 0, n == len(plain), quad, quad and all(int(p) <= 255 for p in plain.split(".")), dots >= 3,
        n == 0, 1 <= n <= 6, 7 <= n <= 9, 10 <= n <= 15, 14 <= n <= 19, n > 19, letters == 0 and 14 <= n <= 19 and luhn(digits),
        letters == 0 and 10 <= n <= 15 and bool(re.search(r"[0-9][\x20().-]+[0-9]", plain)), bool(re.search(r"[0-9]{3}[\x20.-][0-9]{4}$", shape)),
        "=" in plain or '"' in plain, letters > 0 and n > 0 and "@" not in plain, bool(re.search(r"[A-Z]{4}", plain)), len(plain) > 30,
        plain.startswith("+") and not hide, _SPELT.search(token) is not None, "/" in plain,
    ]
    return [i for i, x in enumerate(on) if x]


@dataclass(frozen=True)
class Field:
    """Log potentials: of a token's features by label, of chain neighbours and of linked similar tokens."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@dataclass(frozen=True)
class Params:
    """``configurations``: of the distinct configurations of all documents, on how many of the most frequent the field is fitted."""

    configurations: int = 50_000
    near: int = 3  # words between chain neighbours at most
    rounds: int = 30
    add_at: float = 0.9  # the probability from which a span is added


def links(found: list[Token], near: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between candidates close by; skip edges from each token to the one before it of equal or similar form.

    Linking each to its last like makes a path, so a form that occurs n times has n - 1 edges.
    """
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1].word - found[i].word <= near]
    skip, last = [], {}
    for i, t in enumerate(found):
        form = normal_form(t.text)
        keys = {form}
        if form.isdigit() and len(form) >= 9:
            keys |= {form[-9:]}  # with or without a country code
        elif "@" in form:
            keys |= {form.partition("@")[0]} if len(form.partition("@")[0]) >= 5 else set()
        joined = {last[k] for k in keys if k in last}
        skip += [(j, i) for j in sorted(joined)]
        for k in keys:
            last[k] = i
    return chain, skip


#: Features that hold, labels of the chain's neighbours (-1: none) and of skip neighbours, the token's label.
Configuration = tuple[tuple[int, ...], int, int, tuple[int, ...], int]


def configurations(text: str, near: int) -> Iterator[Configuration]:
    """Of each candidate token, whole and with its strong form hidden."""
    found = tokens(text, base_spans(text))
    chain, skip = links(found, near)
    left, right = [-1] * len(found), [-1] * len(found)
    for i, j in chain:
        left[j], right[i] = found[i].label, found[j].label
    others: list[list[int]] = [[] for _ in found]
    for i, j in skip:
        others[i].append(found[j].label)
        others[j].append(found[i].label)
    for i, t in enumerate(found):
        for hide in (False, True):
            yield tuple(features(t.text, hide)), left[i], right[i], tuple(sorted(others[i])), t.label


def fit(counts: list[tuple[Configuration, int]], rounds: int = 1500) -> Field:
    """All potentials at once, by penalised maximum pseudo-likelihood (convex; accelerated descent)."""
    unary, chain, skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    if not counts:
        return Field(unary, chain, skip)
    x = np.zeros((len(counts), FEATURES + 3 * LABELS))
    for i, ((on, left, right, others, _), _) in enumerate(counts):
        x[i, list(on)] = 1
        if left >= 0:
            x[i, FEATURES + left] = 1
        if right >= 0:
            x[i, FEATURES + LABELS + right] = 1
        for other in others:
            x[i, FEATURES + 2 * LABELS + other] += 1
    y = np.eye(LABELS)[[c[-1] for c, _ in counts]]
    # of rare and of common configurations alike something has to be learned
    w = np.sqrt([n for _, n in counts])
    w = w / w.sum()
    cut = [FEATURES, FEATURES + LABELS, FEATURES + 2 * LABELS]
    now = ahead = np.concatenate((unary, chain, skip))
    rate = 1.0 / (x**2).sum(1).max()
    for k in range(rounds):
        u, c, s = np.split(ahead, cut[:2])
        z = x @ np.concatenate((u, c, c.T, s))
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        gu, gl, gr, gs = np.split(x.T @ (w[:, None] * (q - y)), cut)
        new = ahead - rate * (np.concatenate((gu, gl + gr.T, gs + gs.T)) + 1e-4 * ahead)
        ahead, now = new + k / (k + 3) * (new - now), new
    return Field(*np.split(now, cut[:2]))


def propagate(unary: np.ndarray, edges: np.ndarray, table: np.ndarray, rounds: int) -> np.ndarray:
    """Label probabilities by loopy sum-product: ``edges`` (m, 2) and their log potentials (m, labels, labels)."""
    n, m = len(unary), len(edges)
    if not m:
        z = unary
    else:
        source = np.concatenate((edges[:, 0], edges[:, 1]))
        target = np.concatenate((edges[:, 1], edges[:, 0]))
        reverse = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
        pot = np.concatenate((table, table.transpose(0, 2, 1)))
        msg = np.zeros((2 * m, LABELS))
        for _ in range(rounds):
            z = unary.copy()
            np.add.at(z, target, msg)
            new = np.empty_like(msg)
            for at in range(0, 2 * m, 1 << 14):  # a bounded number of edges at a time
                part = slice(at, at + (1 << 14))
                raw = (z[source[part]] - msg[reverse[part]])[:, :, None] + pot[part]
                top = raw.max(1)
                new[part] = np.log(np.exp(raw - top[:, None, :]).sum(1)) + top
            new = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))  # damped
            done = np.abs(new - msg).max() < 1e-4
            msg = new
            if done:
                break
        z = unary.copy()
        np.add.at(z, target, msg)
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def label(text: str, field: Field, p: Params) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the field adds: tokens outside all base spans that it labels surely."""
    base = base_spans(text)
    found = tokens(text, base) if _may_hold(text) else []
    if not found:
        return base, []
    unary = np.stack([field.unary[features(t.text)].sum(0) for t in found])
    for i, t in enumerate(found):
        if t.label != OUTSIDE:  # evidence: a base span stands
            unary[i] = -50.0
            unary[i, t.label] = 0.0
    chain, skip = links(found, p.near)
    edges = np.array(chain + skip, np.int64).reshape(-1, 2)
    table = np.concatenate((np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)))
    prob = propagate(unary, edges, table, p.rounds)
    more = []
    for t, q in zip(found, prob, strict=True):
        k = int(q[:OUTSIDE].argmax())
        if t.label == OUTSIDE and q[k] >= p.add_at:
            more.append((t.start, k, t.end))
    return base, more


def _learn(docs: DataFrame, p: Params) -> Field:
    """The field of all documents: Spark counts the configurations of their candidate tokens, the driver gets the distinct ones.

    There are a few thousand of these, whatever the number of rows; ``p.configurations`` bounds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in as_text(batch, "text"):
                if _may_hold(text):
                    seen.update(configurations(text, p.near))
            yield pa.RecordBatch.from_arrays([pa.array([repr(c) for c in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["c", "n"])

    counts = docs.select("text").mapInArrow(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "c").limit(p.configurations).collect()
    return fit(sorted((literal_eval(r["c"]), r["n"]) for r in rows))


def _may_hold(text: str) -> bool:
    """Whether a text can have a candidate."""
    return "@" in text or _DIGIT.search(text) is not None or _SPELT_AT.search(text) is not None


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, p: Params = Params(), field: Field | None = None) -> DataFrame:
    """``doc_id``, counts of the base spans by kind, their digest and all ``spans``, for whole texts (null: empty).

    Equal rows give equal rows; an empty table none; other columns are not read.
    """
    field = field or _learn(docs, p)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for text in as_text(batch, "text"):
                base, more = label(text, shared.value, p)
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(span_text(base).encode()).hexdigest())
                spans.append(span_text(base + more))
            columns = [*[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def op8_pii_spans(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of each row's whole text, by a field trained on all of ``docs``; odd rows: see ``scan``."""
    return scan(docs.select("doc_id", "text"))
