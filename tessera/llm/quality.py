"""Quality rules: fixed base rules, then a hashed n-gram logistic regression with calibrated scores.

The classifier sees word 1- and 2-grams and character 3- and 4-grams, hashed into buckets. A
family's features are the shares of its n-grams that fall into each bucket, so a text's score is
a bias plus, for each family, the mean weight of its n-grams; texts of any length compare. It is
fitted on a bounded sample of labelled rows, calibrated on rows held out of the fit, and then
scores every text in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, as_bytes, hashed_share

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
FAMILIES = 4
BITS = 16  # of a family's buckets
_MASK = np.uint64((1 << BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    """Bounds and thresholds. ``sample``: about how many labelled rows of each class are fitted on."""

    sample: int = 1000
    sample_chars: int = 60_000  # longer labelled texts are not fitted on; all are scored
    min_words: int = 50
    max_repeat_percent: int = 50
    keep_at: float = 0.5  # calibrated probability of quality
    rounds: int = 200
    scale: float = 10.0  # of the features, against the penalty
    l2: float = 1e-4


@dataclass(frozen=True)
class Model:
    """``weights``: one row of buckets a family. No weights: every text scores as quality."""

    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, scores: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(scores))
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.shift, -500, 500)))


def _word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return ids, list(known)


def repeated_window_words(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words that the text holds at least twice."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key, base = ids[:n], distinct
    for k in range(1, width):
        if base > (1 << 62) // max(1, distinct):
            _, key = np.unique(key, return_inverse=True)
            base = int(key.max()) + 1
        key, base = key * distinct + ids[k : n + k], base * distinct
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for k in range(width):
        inside[k : n + k] |= repeated
    return int(inside.sum())


def buckets(text: bytes, ids: np.ndarray, distinct: list[bytes]) -> list[np.ndarray]:
    """The bucket of each n-gram of each family."""
    hashed = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))[ids] * _MIX
    # code points, of 21 bits each
    chars = (np.frombuffer(text, np.uint8) if text.isascii() else np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)).astype(np.uint64)
    n = len(chars)
    tri = (chars[: n - 2] << np.uint64(42) | chars[1 : n - 1] << np.uint64(21) | chars[2:]) if n > 2 else np.zeros(0, np.uint64)
    four = ((tri[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ chars[3:]) if n > 3 else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BITS)
    pairs = (hashed[:-1] ^ (hashed[1:] * np.uint64(3))) * _MIX if len(hashed) > 1 else np.zeros(0, np.uint64)
    return [(hashed >> shift), (pairs >> shift), (tri * _MIX) >> shift, (four * _MIX) >> shift]


def _score(weights: np.ndarray, bias: float, grams: list[np.ndarray]) -> float:
    return bias + sum(float(weights[f][g.view(np.int64)].mean()) for f, g in enumerate(grams) if len(g))


def _features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, distinct = _word_ids(text.split())
    at, share = [], []
    for f, g in enumerate(buckets(text, ids, distinct)):
        if len(g):
            u, c = np.unique(g.view(np.int64), return_counts=True)
            at.append(u + (f << BITS))
            share.append(c / len(g))
    return (np.concatenate(at), np.concatenate(share)) if at else (np.zeros(0, np.int64), np.zeros(0))


def fit(texts: list[bytes], good: np.ndarray, weight: np.ndarray, p: Params) -> Model:
    """Logistic regression by accelerated full-batch descent, then Platt calibration on every fourth row.

    Bounded by the sample; rows come in a fixed order, so equal samples give equal models.
    """
    if len(texts) < 8 or good.all() or not good.any():
        return Model()
    rows = [_features(t) for t in texts]
    held = np.arange(len(rows)) % 4 == 3
    if not held.any() or len(set(good[held])) < 2 or len(set(good[~held])) < 2:
        held[:] = False

    def matrix(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pick = [rows[i] for i in np.flatnonzero(which)]
        return np.repeat(np.arange(len(pick)), [len(a) for a, _ in pick]), np.concatenate([a for a, _ in pick]), np.concatenate([v for _, v in pick])

    r, c, v = matrix(~held)
    y, m = good[~held].astype(float), weight[~held] / weight[~held].sum()
    used, c = np.unique(c, return_inverse=True)
    v = v * p.scale
    w, b, n = np.zeros(len(used)), 0.0, len(y)
    # the loss curves by at most a fourth of a row's squared norm
    ahead_w, ahead_b, rate = w, b, 4.0 / (1 + np.bincount(r, v * v, n).max() + 4 * p.l2)
    balance = np.where(y == 1, 0.5 / m[y == 1].sum(), 0.5 / m[y == 0].sum()) * m
    for k in range(p.rounds):
        z = np.bincount(r, v * ahead_w[c], n) + ahead_b
        g = balance * (1 / (1 + np.exp(-z)) - y)
        new_w = ahead_w - rate * (np.bincount(c, v * g[r], len(used)) + p.l2 * ahead_w)
        new_b = ahead_b - rate * g.sum()
        pull = k / (k + 3)
        ahead_w, ahead_b, w, b = new_w + pull * (new_w - w), new_b + pull * (new_b - b), new_w, new_b
    weights = np.zeros(FAMILIES << BITS)
    weights[used] = w * p.scale
    check = held if held.any() else ~held
    r, c, v = matrix(check)
    s = np.bincount(r, v * weights[c], int(check.sum())) + b
    slope, shift = platt(s, good[check], weight[check])
    return Model(weights.reshape(FAMILIES, -1).astype(np.float32), b, slope, shift)


def platt(scores: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve through the scores, by damped Newton steps."""
    good_n, bad_n = weight[good == 1].sum(), weight[good == 0].sum()
    y = np.where(good == 1, (good_n + 1) / (good_n + 2), 1 / (bad_n + 2))
    x = np.stack([scores, np.ones(len(scores))], 1)
    a = np.zeros(2)
    loss = lambda a: float((weight * (np.logaddexp(0, x @ a) - y * (x @ a))).sum()) + 1e-3 * float(a @ a)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ a, -500, 500)))
        grad = x.T @ (weight * (q - y)) + 2e-3 * a
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 2e-3 * np.eye(2)
        step, scale = np.linalg.solve(hess, grad), 1.0
        while loss(a - scale * step) > loss(a) and scale > 1e-6:
            scale /= 2
        a = a - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """The model of a sample: of each label about ``p.sample`` labelled texts, by a share of their ids' hashes.

    Labels that contradict each other on a ``doc_id`` count as bad; null labels and ids are left
    out. The sample's classes are weighed back to their shares of all labels, so the calibrated
    probability is that of the labelled corpus. The fit runs in one task, over the sample alone. Without
    labels of both kinds (an empty table, say) the model keeps every text that passes the fixed rules.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    shares = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    in_sample = F.lit(False)
    for label, n in shares.items():
        in_sample |= (F.col("good") == label) & hashed_share(F.xxhash64("doc_id", F.lit(3)), p.sample / n)
    first = known.where(F.col("good").isin(0, 1) & in_sample)
    text = F.coalesce("text", F.lit(""))
    fits = docs.where("doc_id is not null").where(F.length(text) <= p.sample_chars).select("doc_id", text.alias("text"))
    # a doc_id may repeat any number of times: its smallest text stands for it
    sample = fits.join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("good").alias("good"))

    def one(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["doc_id"].to_pylist(), t["text"].cast(pa.binary()).to_pylist(), t["good"].to_pylist(), strict=True))
        order = sorted(range(len(rows)), key=lambda i: zlib.crc32(str(rows[i][0]).encode()))
        good = np.array([rows[i][2] for i in order])
        have = np.bincount(good, minlength=2)
        weight = np.array([shares.get(int(g), 0) / have[g] for g in good])
        model = fit([rows[i][1] for i in order], good, weight, p)
        w = model.weights.tobytes() if model.weights is not None else None
        return pa.table({"w": pa.array([w], pa.binary()), "f": pa.array([[model.bias, model.slope, model.shift]], pa.list_(pa.float64()))})

    got = sample.groupBy(F.lit(0).alias("all")).applyInArrow(one, "w binary, f array<double>").collect()
    if not got or got[0]["w"] is None:
        return Model()
    return Model(np.frombuffer(bytes(got[0]["w"]), np.float32).reshape(FAMILIES, -1), *got[0]["f"])


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def judge(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """``docs`` plus the columns of ``SCHEMA``, over whole texts (null: no words, so it fails).

    Equal rows get equal verdicts; a probability equal to the threshold keeps; an empty table gives none;
    columns of ``docs`` with names of the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[tuple[list, pa.DataType]]:
        m = shared.value
        rows, scores = [], []
        for text in as_bytes(batch, "text"):
            words = text.split()
            ids, distinct = _word_ids(words)
            n = len(words)
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            # code points: bytes that don't continue one
            chars = len(text) if text.isascii() else int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())
            repeats = repeated_window_words(ids, len(distinct))
            failed = n < p.min_words or 100 * repeats > p.max_repeat_percent * n
            rows.append((n, chars - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeats, failed))
            scores.append(0.0 if failed or m.weights is None else _score(m.weights, m.bias, buckets(text, ids, distinct)))
        failed = np.array([r[5] for r in rows], bool)
        prob = m.probability(np.array(scores))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64()] * 5 + [pa.bool_()]
        out = [(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        return [*out, ([None if f else float(x) for f, x in zip(failed, prob, strict=True)], pa.float64()), ((~failed & (prob >= p.keep_at)).tolist(), pa.bool_())]

    return add_columns(docs, SCHEMA, make)


_SPACES = [bytes([b]) for b in SPACE]
_SYMBOLS = [bytes([b]) for b in SYMBOLS]


def op4_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of each row's whole text; odd rows: see ``judge`` and ``train``."""
    judged = judge(docs.select("doc_id", "text"), train(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    # under names that can't clash with the verdict's
    safe = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    kept = judge(docs.toDF(*safe), train(docs, labels)).where("kept")
    return kept.select(*[F.col(s).alias(c) for s, c in zip(safe, docs.columns, strict=True)])
