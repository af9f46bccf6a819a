"""Collocations of two to five words: best-first branch and bound over prefix counts.

A phrase q that begins with word w scores at most 1000 n / f(w): cut after w, its score is 1000 f(q) n / (f(w) f(rest)),
and f(q) <= f(rest). Words are therefore expanded rarest first, in rounds: a round takes the words of a language whose
bound is next, grows their phrases a word at a time from prefixes that occur often enough, and scores them. A language
is settled once its 2000th surviving score lies above the bound of every word that is left; a round that finds 2000
says which words these are.

Texts are split once, into words told by a 64-bit hash (no hash of a frequent word is shared, else another seed is
taken). What a task knows of the frequent words and prefixes is a bitmap of at most 16 MB, whatever their number: a bit
set by chance costs a count that is dropped later, never a wrong one. Counts are exact, by shuffles of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_slices
from tessera.scratch import materialize

#: Words of a phrase, at least and at most.
SHORT, LONG = 2, 5
#: Bits of a bitmap at most (16 MB).
MOST_BITS = 1 << 27
#: A-Z to lower case, separators to one byte, tab to blank.
_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


class Ids(dict):
    """Words by order of appearance, from 1; a separator (a byte that UTF-8 has not) is 0."""

    def __init__(self) -> None:
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def stretches(data: bytes, mark: bytes, size: int) -> Iterator[bytes]:
    """``data`` cut behind marks, ``size`` bytes at most but where no mark comes."""
    at = 0
    while at < len(data):
        cut = len(data)
        if cut - at > size:
            cut = data.rfind(mark, at, at + size) + 1 or data.find(mark, at + size) + 1 or len(data)
        yield data[at:cut]
        at = cut


class Encoder:
    """The words of one language in a task."""

    def __init__(self, seed: int) -> None:
        self.seed, self.ids, self.hashes, self.counts = seed, Ids(), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def codes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the distinct words, 0 first for the separator, and each place's index into them."""
        parts = []
        for part in stretches(data, b" ", 1 << 20):
            words = part.replace(b"\n", b" \xff ").split()
            parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        if (more := len(self.ids) - len(self.hashes)) > 0:
            fresh = list(self.ids)[-more:]
            made = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in fresh], _U).view(np.int64)
            self.hashes = np.concatenate([self.hashes, np.where(made == 0, 1, made)])
            self.counts = np.concatenate([self.counts, np.zeros(more, np.int64)])
        self.counts += np.bincount(ids, minlength=len(self.counts))
        distinct, at = np.unique(np.concatenate([[0], ids]), return_inverse=True)
        return self.hashes[distinct], at[1:]

    def rows(self, lang: str) -> pa.RecordBatch:
        words = pa.array(list(self.ids)[1:], pa.binary()).cast(pa.string())
        n = len(words)
        none = pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([lang] * n), words, pa.array(self.hashes[1:]), pa.array(self.counts[1:]), none, none], names=["lang", "word", "h", "n", "words", "codes"])


ENCODED = "lang string, word string, h long, n long, words binary, codes binary"


def encoded(seed: int, most_words: int = 100_000, size: int = 1 << 20):
    """Rows of counted words (``word, h, n``) and of coded stretches of text (``words, codes``). A task holds about ``most_words`` of all languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Encoder] = {}
        for batch in batches:
            for part in text_slices(batch, size):
                lang, text = pc.fill_null(part.column("lang"), "und"), part.column("text").cast(pa.binary())
                for name in pc.unique(lang).to_pylist():
                    data = b"\n".join(x for x in text.filter(pc.equal(lang, name)).to_pylist() if x).translate(_BYTES)
                    for stretch in stretches(data, b"\n", size):
                        enc = held.setdefault(name, Encoder(seed))
                        words, at = enc.codes(stretch)
                        kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
                        row = [[name], [None], [None], [None], [words.tobytes()], [at.astype(kind).tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["lang", "word", "h", "n", "words", "codes"])
                        if sum(len(e.ids) for e in held.values()) > most_words:
                            yield from (held.pop(x).rows(x) for x in list(held))
        for name, enc in held.items():
            yield enc.rows(name)

    return run


def mixed(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A key of the words so far and the next one."""
    x = g * _U(0x9E3779B97F4A7C15) + h.view(_U)
    x ^= x >> _U(31)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def salt(lang: str, n: int) -> np.ndarray:
    return np.full(n, xxhash.xxh64_intdigest(lang), _U)


def has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & _U(64 * len(bits) - 1)
    return (bits[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1


WORDS = [f"w{i}" for i in range(1, LONG + 1)]


def bitmap(grams: DataFrame):
    """A broadcast bitmap of the keys of ``grams(lang, w1 .. w5)``; 0 is no word."""
    n = grams.count()
    bits = 1 << 12
    while bits < min(MOST_BITS, 64 * n):
        bits *= 2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            w = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in WORDS], 1)
            size = (w != 0).sum(1)
            for name in pc.unique(lang).to_pylist():
                own = pc.equal(lang, name).to_numpy(zero_copy_only=False)
                g, keys = salt(name, int(own.sum())), []
                for j in range(LONG):
                    g = mixed(g, np.ascontiguousarray(w[own, j]))
                    keys.append(g[size[own] == j + 1])
                at = np.unique(np.concatenate(keys) & _U(bits - 1))
                bit = np.left_shift(_U(1), at & _U(63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array(bit)], names=["slot", "bit"])

    made = grams.select("lang", *WORDS).mapInArrow(slots, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, _U)
    out[made["slot"].to_numpy()] = made["bits"].to_numpy().view(_U)
    return grams.sparkSession.sparkContext.broadcast(out)


def regrouped(parts: list[tuple]) -> tuple:
    """(keys, words, counts, lowest and highest neighbour before and behind) with equal phrases as one row."""
    g, w, n, *ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(g, kind="stable")
    g, w = g[order], w[order]
    # phrases that share a key stay apart: a phrase may then have several rows, which Spark sums
    start = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]).any(1)])[: len(g)])
    low, high = np.minimum.reduceat, np.maximum.reduceat
    return g[start], w[start], np.add.reduceat(n[order], start), *(f(x[order], start) for f, x in zip((low, high, low, high), ends, strict=True))


GRAM = ", ".join(["lang string", *(f"{w} long" for w in WORDS), "f long", "before_low long", "before_high long", "behind_low long", "behind_high long"])


def phrases_of(row: dict, frequent: np.ndarray, first: np.ndarray, known: list[np.ndarray], lengths: range, wanted: np.ndarray | None) -> Iterator[tuple]:
    """Phrases of frequent words in a coded stretch that begin with a word in ``first``, each shorter prefix of two words or more in ``known``.

    With ``wanted`` the phrases of ``lengths`` that it holds.
    """
    words = np.frombuffer(row["words"], np.int64)
    at = np.frombuffer(row["codes"], np.uint16 if len(words) <= 1 << 16 else np.uint32)
    key = mixed(salt(row["lang"], len(words)), words)
    often = has(frequent, key)
    often[0] = False
    here = np.flatnonzero((often & has(first, key))[at])
    g = key[at[here]]
    kept = np.where(often, words, 0)
    for k in range(SHORT, lengths[-1] + 1):
        ok = here + k - 1 < len(at)
        here, g = here[ok], g[ok]
        ok = often[at[here + k - 1]]
        here, g = here[ok], g[ok]
        g = mixed(g, words[at[here + k - 1]])
        take = slice(None)
        if wanted is not None and k in lengths:
            take = has(wanted, g)
        if k in lengths and len(mine := here[take]):
            w = np.zeros((len(mine), LONG), np.int64)
            for j in range(k):
                w[:, j] = words[at[mine + j]]
            before = np.where(mine > 0, kept[at[mine - 1]], 0)
            after = mine + k
            behind = np.where(after < len(at), kept[at[np.minimum(after, len(at) - 1)]], 0)
            yield regrouped([(g[take], w, np.ones(len(mine), np.int64), before, before, behind, behind)])
        if k < lengths[-1] and k - SHORT < len(known):
            ok = has(known[k - SHORT], g)
            here, g = here[ok], g[ok]


def counted(coded: DataFrame, frequent, first, known: list, lengths: range, wanted=None, most: int = 200_000) -> DataFrame:
    """The counts of such phrases over all texts, with the words that stand on either side of all their places (0: not one word).

    A task holds about ``most`` phrases of all languages; what it has by then goes to the sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        n = 0
        kinds = [frequent.value, first.value, [b.value for b in known], lengths, wanted and wanted.value]

        def out(lang: str, parts: list[tuple]) -> pa.RecordBatch:
            _, w, *rest = regrouped(parts)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(w), pa.string()), *(pa.array(w[:, j]) for j in range(LONG)), *map(pa.array, rest)], names=[x.split()[0] for x in GRAM.split(", ")])

        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            for part in phrases_of(row, *kinds):
                parts = held.setdefault(row["lang"], [])
                parts.append(part)
                n += len(part[0])
                if n > most:
                    held = {lang: [regrouped(p)] for lang, p in held.items()}
                    n = sum(len(p[0][0]) for p in held.values())
                    if n > most // 2:
                        yield from (out(lang, held.pop(lang)) for lang in list(held))
                        n = 0
        for lang, parts in held.items():
            yield out(lang, parts)

    sums = coded.mapInArrow(run, GRAM).groupBy("lang", *WORDS).agg(F.sum("f").alias("f"), F.min("before_low").alias("bl"), F.max("before_high").alias("bh"), F.min("behind_low").alias("al"), F.max("behind_high").alias("ah"))
    return sums.select("lang", *WORDS, "f", F.when(F.col("bl") == F.col("bh"), F.col("bl")).otherwise(0).alias("before"), F.when(F.col("al") == F.col("ah"), F.col("al")).otherwise(0).alias("behind"))


def size_of() -> Column:
    return reduce(lambda a, b: a + b, [(F.col(w) != 0).cast("int") for w in WORDS])


def head(n: int) -> Column:
    """The first ``n`` words, as w1 .. w5."""
    return F.struct(*[(F.col(w) if i < n else F.lit(0).cast("long")).alias(w) for i, w in enumerate(WORDS)])


def tail(n: int) -> Column:
    """What follows the first ``n`` words, as w1 .. w5."""
    return F.struct(*[(F.col(WORDS[i + n]) if i + n < LONG else F.lit(0).cast("long")).alias(w) for i, w in enumerate(WORDS)])


def suffixes(grams: DataFrame) -> DataFrame:
    """The distinct proper suffixes of two words or more."""
    each = F.array(*[F.when(F.col(WORDS[j + 1]) != 0, tail(j)) for j in range(1, LONG - 1)])
    return grams.select("lang", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("lang", "x.*").distinct()


def scored(grams: DataFrame, counts: DataFrame, langs: DataFrame) -> DataFrame:
    """Each phrase's lowest-scoring cut: ``a, l, r, score``. ``counts``: of all its prefixes and suffixes."""
    each = F.array(*[F.when(F.col(WORDS[j]) != 0, F.struct(F.lit(j).alias("cut"), head(j).alias("left"), tail(j).alias("right"))) for j in range(1, LONG)])
    cut = grams.select("lang", *WORDS, "f", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("lang", *WORDS, "f", "x.*")
    of = counts.select("lang", F.struct(*WORDS).alias("key"), F.col("f").alias("count"))
    cut = cut.join(of.select("lang", F.col("key").alias("left"), F.col("count").alias("l")), ["lang", "left"])
    cut = cut.join(of.select("lang", F.col("key").alias("right"), F.col("count").alias("r")), ["lang", "right"]).join(langs, "lang")
    # exact: 38 digits hold 1000 a n of any corpus
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cut = cut.withColumns({"top": ((big("f") * big("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), "below": (big("l") * big("r")).cast("decimal(38,0)")})
    best = cut.groupBy("lang", *WORDS).agg(F.max("f").alias("a"), F.max("n").alias("n"), F.min(F.struct(F.expr("top div below").alias("score"), "cut", "l", "r")).alias("x"))
    return best.select("lang", *WORDS, "a", "x.l", "x.r", "n", "x.score")


def split_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coded texts, words (``lang, h, f, word``) and languages (``lang, n``)."""
    for seed in range(42, 50):
        made = materialize(docs.select("lang", "text").mapInArrow(encoded(seed), ENCODED), "phrase-codes")
        words = made.where("word is not null").groupBy("lang", "h").agg(F.sum("n").alias("f"), F.min("word").alias("word"), F.max("word").alias("other"))
        words = materialize(words, "phrase-words")
        if words.where((F.col("word") != F.col("other")) & (F.col("f") >= least)).isEmpty():
            langs = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-langs")
            return made.where("codes is not null").select("lang", "words", "codes"), words.select("lang", "h", "f", "word"), langs
    raise RuntimeError("frequent words share a hash under every seed")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, growth: int = 16) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to 5 words of ``docs(lang, text)``.

    A null ``lang`` is ``und``, a null text is empty, texts of any length are read whole, repeated rows count each time,
    further columns are ignored; without frequent phrases there are no rows. The first round takes words of up to
    ``growth * least`` occurrences; a round that leaves fewer than ``top`` survivors is followed by one of ``growth``
    times as frequent words.
    """
    coded, words, langs = split_words(docs, least)
    often = materialize(words.where(F.col("f") >= least).select("lang", F.col("h").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in WORDS[1:]], "f", "word"), "phrase-frequent")
    frequent = bitmap(often)
    state = materialize(langs.select("lang", "n", F.lit(0).cast("long").alias("done"), F.lit(least * growth).cast("long").alias("upto")), "phrase-state")
    counts = often.select("lang", *WORDS, "f")
    found: DataFrame | None = None
    while True:
        chosen = materialize(often.join(state, "lang").where("f > done and f <= upto").select("lang", *WORDS), "phrase-chosen")
        if chosen.isEmpty():
            break
        fresh = grown(coded, frequent, chosen, least)
        if fresh is not None:
            counts = counts.unionByName(fresh.select("lang", *WORDS, "f"))
            missing = materialize(suffixes(fresh).join(counts, ["lang", *WORDS], "left_anti"), "phrase-missing")
            if not missing.isEmpty():
                first = bitmap(missing.select("lang", head(1).alias("x")).select("lang", "x.*").distinct())
                more = counted(coded, frequent, first, [], range(SHORT, LONG), bitmap(missing)).join(missing, ["lang", *WORDS], "left_semi")
                counts = counts.unionByName(materialize(more.select("lang", *WORDS, "f"), "phrase-suffixes"))
            kept = scored(fresh, counts, langs).join(fresh.select("lang", *WORDS, "before", "behind"), ["lang", *WORDS])
            # inside a longer candidate that occurs as often: one word stands on a side of all its places
            kept = kept.where((size_of() == LONG) | (F.col("before") == 0) & (F.col("behind") == 0)).drop("before", "behind")
            kept = materialize(kept, "phrase-scored")
            found = kept if found is None else found.unionByName(kept)
        state = settled(state, often, found, top, growth)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    near = found.withColumn("k", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("k") <= top).drop("k")
    spelt = near.select("*", F.posexplode(F.filter(F.array(*WORDS), lambda w: w != 0)).alias("i", "h")).join(often.select("lang", F.col("w1").alias("h"), "word"), ["lang", "h"])
    same = ["lang", "a", "l", "r", "n", "score"]
    spelt = spelt.groupBy(*same, *WORDS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def grown(coded: DataFrame, frequent, chosen: DataFrame, least: int) -> DataFrame | None:
    """All phrases that begin with a chosen word and occur ``least`` times, a word longer in each step."""
    first, known, levels = bitmap(chosen), [], []
    for k in range(SHORT, LONG + 1):
        level = counted(coded, frequent, first, known, range(k, k + 1)).where(F.col("f") >= least)
        level = materialize(level.join(chosen.select("lang", "w1"), ["lang", "w1"], "left_semi"), f"phrase-{k}")
        if level.isEmpty():
            break
        levels.append(level)
        if k < LONG:
            known.append(bitmap(level))
    return reduce(DataFrame.unionByName, levels) if levels else None


def settled(state: DataFrame, often: DataFrame, found: DataFrame | None, top: int, growth: int) -> DataFrame:
    """The words that come next: up to the frequency whose bound is the ``top``-th score, or ``growth`` times as frequent ones."""
    left = often.join(state.select("lang", "upto"), "lang").where("f > upto").groupBy("lang").agg(F.min("f").alias("next"))
    s = state.join(left, "lang", "left")
    if found is None:
        s = s.withColumns({"have": F.lit(0).cast("long"), "score": F.lit(0).cast("long")})
    else:
        best = found.select("lang", "score").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))).where(F.col("k") <= top)
        s = s.join(best.groupBy("lang").agg(F.count("*").alias("have"), F.min("score").alias("score")), "lang", "left")
    bound = F.when(F.col("have") >= top, F.when(F.col("score") > 0, F.expr("1000 * n div score")).otherwise(F.col("n")))
    return materialize(s.select("lang", "n", F.col("upto").alias("done"), F.coalesce(bound, F.greatest(F.col("upto") * growth, "next")).alias("upto")), "phrase-state")


def op12_collocations(documents: DataFrame) -> DataFrame:
    """Each language's 2000 best collocations over all whole texts; odd rows: see ``collocations``."""
    return collocations(documents)


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + k - 1] AS q, k, count(*) AS f FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 100),
x AS (SELECT c.lang, c.q, c.f AS a, j, l.f AS l, r.f AS r, n.n, 1000 * CAST(c.f AS HUGEINT) * CAST(n.n AS HUGEINT) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g l ON l.lang = c.lang AND l.q = c.q[1:j] JOIN g r ON r.lang = c.lang AND r.q = c.q[j + 1:] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, q ORDER BY score, j) = 1),
d AS (SELECT lang, q[2:] AS q, f FROM c UNION ALL SELECT lang, q[1:k - 1], f FROM c),
y AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.q = b.q AND d.f >= b.a)),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(q, ' ')) AS rank, array_to_string(q, ' ') AS phrase, a, l, r, n, score FROM y)
SELECT lang, CAST(rank AS INT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z WHERE rank <= 2000
"""
