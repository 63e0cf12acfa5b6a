"""Secret scans against Python's expressions on every text."""

import random
import re

from corpuslens.llm import secrets

RULES = secrets.BASE_RULES + secrets.MORE_RULES


BASE = (RULES[0], secrets.Rule("access", "AKIA[A-Z0-9]+", 0, 16), secrets.Rule("hex", "[0-9a-f]+", 0, 32))


def slow(text):
    out = []
    for rank, rule in enumerate(BASE + secrets.MORE_RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(9)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API_KEY", "'", '"', " ", "  ", ":", "=", "abcdefgh", "ABC/+=-_.9", "short",
             "AKIA", "AKIA2345ABCD", "Z9", "é", "日本😀", "0123456789abcdef" * 2, "0123456789abcdef" * 2, "deadbeef", "AKIA", "ZZZZ99998888", "\n", "ghp_" + "a1B2" * 10, "xoxb-1234567890-abc",
             "AIza" + "x" * 35, "sk_live_" + "0" * 20, "eyJhbGciOiJ9.eyJzdWIiOiIx.abc_-9", "-----BEGIN RSA PRIVATE KEY-----", "K", "ſ"]
    out = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(400)]
    out += [None, "", "token:secret:abcdefghij", "x" * 10 + "password=abcdefgh" * 300, "f" * 31, "é" * 5000 + " token = 'abcdefgh1' " + "é" * 5000, "toKen=ABCDEFGHI"]
    return out + out[:5]


def test_spans(spark):
    rows = list(enumerate(texts())) + [(None, "secret: 12345678")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kinds string, spans int")
    got = secrets.scan(df)
    assert got.columns == ["doc_id", "text", "kinds", "spans"]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in got.collect()}
    assert found == {i: slow(t) for i, t in rows}


def test_redaction(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    got = secrets.redacted(df)
    assert got.columns == df.columns
    for r in got.collect():
        text, out, at = rows[r.doc_id][1], "", 0
        for start, _, end in slow(text):
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert r.text == (None if text is None else out + text[at:])


def test_trigram_queries():
    got = {rule.kind: secrets.trigram_query(rule.pattern) for rule in RULES}
    assert got["hex"] is None
    assert got["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in got["assign"] and frozenset({"api", "pik", "ike", "key"}) in got["assign"]
    assert got["private_key"] == [frozenset(w[i : i + 3] for w in ("-----begin ", "private key-----") for i in range(len(w) - 2))]
    for text in filter(None, texts()):
        low = text.lower()
        for rule in RULES:
            if got[rule.kind] is not None and re.search(rule.pattern, text, re.ASCII):
                assert any(all(t in low for t in wanted) for wanted in got[rule.kind])


def test_empty_table_and_rules_without_trigrams(spark):
    df = spark.createDataFrame([(1, "f" * 40)], "doc_id long, text string")
    assert secrets.scan(df.limit(0)).collect() == []
    assert [tuple(s) for s in secrets.scan(df, secrets.BASE_RULES[2:]).first().spans] == [(0, 0, 40)]


def test_very_many_matches_in_one_text(spark):
    """Twenty thousand and a hundred thousand keys: the time follows their number."""
    import time

    key, took = "0123456789abcdef" * 2, {}
    for n in (20_000, 100_000):
        text = "".join(f"é{key} token=abcdefgh{i % 10} " if i % 2 else key + "\n" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        started = time.time()
        (row,) = secrets.scan(df).collect()
        assert [tuple(s) for s in row.spans] == slow(text)
        clean = secrets.redacted(df).first().text
        took[n] = time.time() - started
        assert clean.count("[SECRET]") == n + n // 2 and key not in clean
    assert took[100_000] < 8 * took[20_000] + 5 and took[100_000] < 60


def test_redaction_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 7)
    test_redaction(spark)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "f" * 40)], "doc_id long, text string")
    plan = secrets.redacted(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
