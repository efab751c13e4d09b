import hashlib
import random
import re

from graphloom.llm import registry
from graphloom.llm.secrets import base_spans, novel_spans, scan

LEAST = {"access": 20, "hex": 24}
PATTERNS = {
    "assign": r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute_force(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= LEAST[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def texts():
    rng = random.Random(2)
    parts = ["é ", "password", "Secret", "tOKEN", "api_key", "APIKEY", "ſecret", "toKen", "=", ": ", "  ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "x" * 30, "===", ".", "日本"]
    return [None, "", "a" * 30, *("".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(400)), "word " * 100_000 + "token=abcdef1"]


def test_base_spans():
    for t in texts():
        got = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base_spans(t or "")]
        assert got == brute_force(t)


def test_novelty():
    random_key = "q7Zt0PwXk3LmB9vRj2HsY5cNd8FgUa4E"
    assert novel_spans(f"# the auth header sends {random_key} each time") == [(24, 3, 56)]
    assert not novel_spans("the auth header client_password_manager.default_key1 is set")
    assert not novel_spans(f"{random_key} and again, the private part {random_key}")
    assert not novel_spans(f"a plain sentence and {random_key}")


def test_query_columns(spark, tmp_path):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())] * 2
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in registry.op3_secrets(spark, str(tmp_path)).collect()}
    want = set()
    for _, t in rows:
        b = brute_force(t)
        want.add((*(sum(x.startswith(k) for x in b) for k in PATTERNS), hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert got == want
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
