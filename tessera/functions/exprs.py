"""Scalar functions of the model as Column expressions; all stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import schema


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def lookup(values: dict, key: Column | str, default=None) -> Column:
    """A fixed map as a chain of conditions."""
    out = None
    for k, v in values.items():
        out = F.when(col(key) == k, F.lit(v)) if out is None else out.when(col(key) == k, F.lit(v))
    return out.otherwise(F.lit(default))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 where a norm is 0 or lengths differ."""
    a, b = col(a), col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def freshness(age_days: Column | str, sigma: float = 30.0, floor: float = 0.25) -> Column:
    """Gaussian decay with age, 1 for the future, never below ``floor``."""
    d = col(age_days)
    return F.when(d <= 0, 1.0).otherwise(F.greatest(F.lit(floor), F.exp(-0.5 * F.pow(d / sigma, 2))))


def half_life(age: Column | str, half: float) -> Column:
    return F.lit(1.0) if half <= 0 else F.pow(F.lit(0.5), col(age) / half)


def heat_contribution(weight: Column | str, cap: float = 10_000) -> Column:
    return F.least(F.lit(1.0), F.log1p(col(weight)) / F.log1p(F.lit(cap)))


def tier(heat: Column | str) -> Column:
    h = col(heat)
    return F.when(h >= 0.66, "HOT").when(h >= 0.33, "WARM").otherwise("COLD")


def level(heat: Column | str) -> Column:
    h = col(heat)
    return F.when(h >= 0.66, "FULL").when(h >= 0.33, "WARM").when(h >= 0.1, "STRUCTURE").otherwise("MINIMAL")


def decay_multiplier(label: Column | str) -> Column:
    return lookup(schema.DECAY_MULTIPLIER, label, 1.0)


def effective_confidence(c: Column | str, missing: float = 1.0) -> Column:
    return clamp(F.coalesce(col(c), F.lit(missing)))


def credibility(source_tier: Column | str, method: Column | str, confidence: Column | str, n: Column | str) -> Column:
    """Tier weight x method weight x confidence x saturation with the number of sources."""
    return (
        lookup(schema.TIER_WEIGHT, source_tier, 0.4) * lookup(schema.METHOD_WEIGHT, method, 0.75) * clamp(confidence)
        * (1 - F.exp(-0.5 * F.greatest(F.lit(1), col(n))))
    )


def memory_decay(confidence: Column | str, hours: Column | str, rate: float = 0.95) -> Column:
    return clamp(col(confidence) * F.pow(F.lit(rate), col(hours)))


def tombstone_eligible(decay_class: Column | str, age_hours: Column | str, heat: Column | str) -> Column:
    c, a, h = col(decay_class), col(age_hours), col(heat)
    return (
        F.when(c == "ephemeral", a >= 24).when(c == "standard", (a >= 7 * 24) & (h < 0.3)).when(c == "durable", (a >= 30 * 24) & (h < 0.2)).otherwise(False)
    )


def content_id(*parts: Column | str) -> Column:
    """A stable id of canonical parts (nulls kept apart from empty)."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("~")) for p in parts]), 256)


def pair_id(a: Column | str, b: Column | str, kind: str) -> Column:
    """An id of an unordered pair."""
    x, y = col(a), col(b)
    return F.sha2(F.concat_ws("|", F.lit(kind), F.least(x, y).cast("string"), F.greatest(x, y).cast("string")), 256)


def glob_regex(pattern: Column | str) -> Column:
    """A shell glob as an anchored regex: * any run, ? one character, [...] and [!...] one of a class, all else literal."""
    quoted = F.regexp_replace(col(pattern), r"([\\.+^$|(){}])", r"\\$1")
    # a bracket that no later one closes, or an empty class, is literal
    quoted = F.regexp_replace(quoted, r"\[(?![!^]?[^\]]+\])", r"\\[")
    negated = F.replace(quoted, F.lit("[!"), F.lit("[^"))
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(negated, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def trigrams(text: Column | str) -> Column:
    """The distinct trigrams of a lower-cased text padded with two blanks before and one after, in time proportional to it."""
    chars = F.split(F.concat(F.lit("  "), F.lower(col(text)), F.lit(" ")), "")
    after = lambda k: F.slice(chars, k, F.size(chars))
    pairs = F.zip_with(chars, after(2), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(F.zip_with(pairs, after(3), lambda a, b: F.concat(a, b)), lambda g: g.isNotNull()))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def edge_chain_confidence(confidences: Column | str, formula: str = "multiplicative") -> Column:
    c = col(confidences)
    product = F.aggregate(c, F.lit(1.0), lambda s, v: s * v)
    if formula == "minimum":
        return F.array_min(c)
    return F.pow(product, F.lit(1.0) / F.size(c)) if formula == "geometric_mean" else product


# Words that make a question hard.
ABSTRACT_VERBS = (
    "rejected", "approved", "denied", "accepted", "failed", "succeeded", "postponed", "cancelled", "confirmed",
    "dismissed", "granted", "abandoned", "dropped", "removed", "added", "changed", "decided",
)
QUESTION_WORDS = ("what", "where", "when", "how", "which", "who", "why", "true", "is", "are", "does", "do", "can", "should")


def is_hard_query(text: Column | str) -> Column:
    """Whether a query asks for more than likeness: it is or starts like a question, asks for true or false, is short with an abstract verb, or is about what is one's own."""
    t = F.regexp_replace(F.lower(col(text)), r"^[\x09-\x0D ]+|[\x09-\x0D ]+$", "")
    bare = lambda w: F.regexp_replace(w, r"[!-/:-@\[-`{-~]+$", "")
    words = F.transform(F.filter(F.split(t, r"[\x09-\x0D ]+"), lambda w: w != ""), bare)
    starts = F.coalesce(F.get(words, 0).isin(*QUESTION_WORDS), F.lit(False))
    short = (F.size(words) <= 5) & F.arrays_overlap(words, F.array(*[F.lit(v) for v in ABSTRACT_VERBS]))
    own = t.rlike(r"^(my|our) [^\n]+\z") | t.rlike(r"^(is|are|was|were) [^\n]+ (approved|rejected|denied)\??\z")
    return t.contains("?") | t.contains("true or false") | starts | F.coalesce(short, F.lit(False)) | own


def time_range(text: Column | str, now: Column) -> Column:
    """The ``(start, end)`` that a phrase names relative to ``now``; null where it names none."""
    t = F.lower(col(text))
    day = F.date_trunc("day", now)
    n = F.regexp_extract(t, r"(?:last|past) (\d+) (hour|day|week|month|year)s?", 1).try_cast("int")
    unit = F.regexp_extract(t, r"(?:last|past) (\d+) (hour|day|week|month|year)s?", 2)
    ago = F.regexp_extract(t, r"(\d+) (day|week|month|year)s? ago", 1).try_cast("int")
    ago_unit = F.regexp_extract(t, r"(\d+) (day|week|month|year)s? ago", 2)
    short = F.regexp_extract(t, r"^(\d+)([dwm])$", 1).try_cast("int")
    short_unit = F.regexp_extract(t, r"^(\d+)([dwm])$", 2)
    back = lambda k, u: F.when(u == "hour", now - F.make_interval(hours=k)).when(u.isin("day", "d"), now - F.make_interval(days=k)).when(
        u.isin("week", "w"), now - F.make_interval(weeks=k)
    ).when(u.isin("month", "m"), now - F.make_interval(months=k)).when(u == "year", now - F.make_interval(years=k))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    one = F.make_interval(days=F.lit(1))
    out = F.when(t.rlike(r"\btoday\b"), span(day, now)).when(t.rlike(r"\byesterday\b"), span(day - one, day))
    out = out.when(n.isNotNull(), span(back(n, unit), now)).when(short.isNotNull(), span(back(short, short_unit), now))
    at = F.date_trunc("day", back(ago, ago_unit))
    out = out.when(ago.isNotNull(), span(at, at + one))
    for u in ("week", "month", "year"):
        this = F.date_trunc(u, now)
        before = this - F.make_interval(**{f"{u}s": F.lit(1)})
        out = out.when(t.rlike(rf"\bthis {u}\b"), span(this, now)).when(t.rlike(rf"\blast {u}\b"), span(before, this))
    for i, name in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")):
        last = day - F.make_interval(days=F.pmod(F.weekday(now) - i - 1, F.lit(7)) + 1)
        out = out.when(t.rlike(rf"\bsince {name}\b"), span(last, now)).when(t.rlike(rf"\bon {name}\b"), span(last, last + one))
    return out


def canonical_url(url: Column | str) -> Column:
    """Lower-case scheme and host, no ``www.``, trailing slash, fragment or tracking parameters, the other parameters sorted."""
    u = F.regexp_replace(F.trim(col(url)), r"#.*$", "")
    scheme, host = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.rtrim(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), F.lit("/"))
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[a-z]+|gclid|fbclid|ref|mc_[a-z]+)(=|$)")))
    tail = F.array_join(parts, "&")
    clean = F.concat(scheme, F.lit("://"), F.regexp_replace(host, r"^www\.", ""), path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))
    return F.when(scheme == "", u).otherwise(clean)


def tier_from_uri(uri: Column | str) -> Column:
    u = col(uri)
    return F.when(u.contains("arxiv"), "authoritative").when(u.isNotNull() & (u != ""), "validated").otherwise("community")


def inline_summary(steps: Column | str, sep: str = " -> ") -> Column:
    """The texts of a chain's steps, joined."""
    return F.array_join(F.transform(col(steps), lambda s: s["text"]), sep)


def typed_props(text: Column, fields: dict[str, tuple[str, str]]) -> list[Column]:
    """Columns of free properties, each by path and type (``{"n": ("$.step.n", "bigint")}``), and ``valid``: whether the text is JSON.

    The text is parsed once, as a VARIANT. A text that is null or no JSON has null in each; so has a path that is missing or a
    value that its type cannot hold.
    """
    parsed = F.try_parse_json(text)
    return [*[F.try_variant_get(parsed, path, kind).alias(name) for name, (path, kind) in fields.items()], parsed.isNotNull().alias("valid")]


def nfkc_fold(surface: Column) -> Column:
    """A surface form's key: compatibility forms composed (NFKC), case folded. Spark has no function for either."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC").str.casefold()

    return fold(surface)
