import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.llm.common import table

# the contract's patterns, written out again
PLAIN = {
    "assign": (re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def slow(text):
    spans = sorted((m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if ok(m))
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
    return [sum(s[2] == k for s in spans) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest()


def compare(docs):
    got = {r.doc_id: r for r in secrets.op9_secret_scan(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        counts, digest = slow(r.text)
        assert [got[r.doc_id][f"n_{k}"] for k in PLAIN] == counts
        assert got[r.doc_id].base_sha256 == digest
    return got


def test_documents_against_plain_regexes(spark, sf_dir):
    compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


def test_made_up_texts_against_plain_regexes(spark):
    rng = random.Random(2)
    bits = ["password", "PassWD", "secret", "TOKEN", "api_key", "ApiKey", "apikey", "=", ":", " ", '"', "'", "abcdefgh", "x=y", "ſecret", "toKen", "AKIA", "AKIAABCDEFGHIJKLMN", "AKIA1", "é日", "0123456789abcdef", "deadbeef" * 4, "\n", "Z"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(2000)]
    compare(spark.createDataFrame([*rows, (5000, None), (5001, "a" * 100_000), (5002, "k" * 50_000 + "token=" + "b" * 50_000)], "doc_id long, text string"))


def test_derived_queries():
    q = secrets.trigram_query
    assert q(r"[0-9a-f]+") is True
    assert q(r"AKIA[A-Z0-9]+") == ("and", frozenset({b"aki", b"kia"}))
    assert q(r"(abc|abd)x?") == ("or", frozenset({b"abc", b"abd", ("and", frozenset({b"abc", b"bcx"})), ("and", frozenset({b"abd", b"bdx"}))}))
    assert q(r"(abc)*def") == b"def"
    assert q(r"(abc)+.def") == ("and", frozenset({b"abc", b"def"}))
    assert q(r"ab|abc") is True
    assert all(q(r.pattern) is not True for r in secrets.RULES if r.kind != "hex")


def test_queries_hold_for_all_matches():
    rng = random.Random(4)
    samples = {"pem": "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----", "jwt": ".".join(["eyJ" + "a" * 12] * 2 + ["b" * 12]), "github": "ghp_" + "A1" * 18, "slack": "xoxb-12345678901", "google": "AIza" + "b" * 35, "stripe": "sk_live_" + "a" * 24}
    for rule in secrets.MORE_RULES:
        text = samples[rule.kind]
        assert rule.compiled().search(text)
        texts = [("x" * rng.randint(0, 5) + " " + text + " y").encode(), b"none", b""]
        found = secrets.scan_batch(texts, (rule,), [secrets.trigram_query(rule.pattern)])
        assert [len(f) for f in found] == [1, 0, 0]


def test_edge_rows(spark):
    rows = [(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(3))
    got = secrets.op9_secret_scan(docs).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.spans) for r in got) == [("1", 1, "assign:0:14"), ("1", 1, "assign:0:14"), ("2", 0, ""), ("None", 0, "")]
    assert secrets.op9_secret_scan(docs.limit(0)).count() == 0


def test_query_against_sql(spark, sf_dir):
    from .oracle import same

    same(secrets.op9_secret_scan(table(spark, sf_dir, "documents")), sf_dir, secrets.OP9_SQL)


def test_jwt_spans_are_the_rules():
    """The single look at each run finds what the rule's pattern finds."""
    import random
    import re

    rule = next(r for r in secrets.RULES if r.kind == "jwt")
    rng = random.Random(6)
    bits = ["eyJ", "eyJabcdefghij", "a", "-", ".", ".eyJ0123456789", "_x", " ", "é", "0123456789", "..", "eyJ-eyJ-eyJ-eyJ-"]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randrange(14)))
        assert secrets.jwt_spans(text) == [m.span() for m in re.compile(rule.pattern, re.ASCII).finditer(text)]


def test_hostile_megabytes_take_seconds():
    import time

    queries = [secrets.trigram_query(r.pattern) for r in secrets.RULES]
    for part in ("eyJ-", "eyJx.eyJ-", "-----BEGIN ", "token:", "a1", "token ", "xoxa-", "eyJaaaaaaaaaa.eyJ"):
        began = time.time()
        secrets.scan_batch([(("eyJaaaaaaaaaa." if "eyJ" in part else "") + part * ((1 << 20) // len(part))).encode()], secrets.RULES, queries)
        assert time.time() - began < 5, part
