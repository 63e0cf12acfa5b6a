"""URL filters against trying every rule on every URL."""

import random
import re

from corpuslens.llm import urls

SCHEMA = "page_id long, url string, host int, key string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def slow(url, rules):
    rules = [(h, "/" if p is None else p, v) for h, p, v in rules]
    host, path = split(url)
    fits = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def case():
    rng = random.Random(3)
    labels = ["com", "net", "example", "www", "a", "b-c", "a0", "EXAMPLE", "é", ""]
    rules = [*urls.RULES, ("a.com", "/x", "block"), ("b-c.a.com", "", "allow"), ("a0.com", "/", "block"), ("a0.com", "/", "allow"), ("com", None, "block"), ("", "/", "block"), (None, "/", "allow")]
    rules += [(".".join(rng.choices(["com", "net", "a", "www", "example"], k=rng.randint(1, 4))), rng.choice(["/", "/en/", "/en/x", ""]), rng.choice(["allow", "block"])) for _ in range(25)]
    pages = []
    for i in range(600):
        host = ".".join(rng.choices(labels, k=rng.randint(1, 5)))
        pages.append((i, rng.choice(["http://", "https://", "x://y://", "://", ""]) + host + rng.choice(["", ":80"] if i % 9 == 0 else [""]) + rng.choice(["", "/", "/en/", "/en/x?y", "/es/#", "?q=/en/", "/fr/a\nb", "/EN/"])))
    pages += [(1000, None), (1001, ""), (1002, "http://"), (None, "http://example.com/en/1"), (5, "http://a.com/" + "x" * 100_000)]
    return pages + [(2000 + i, "http://www.example.com/en/1") for i in range(800)] + pages[:3], rules


def test_judged(spark):
    pages, rules = case()
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], SCHEMA)
    found = urls.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert found.columns == ["c0", "c1", "c2", "c3", "host", "path", "rule", "verdict"]
    got = sorted(((r.c0, r.c1, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=str)
    assert got == sorted(((i, u, *slow(u, rules)) for i, u in pages), key=str)


def test_empty_tables(spark):
    pages, rules = case()
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], SCHEMA)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in urls.judged(df, none, default="block").collect()} == {(None, "block")}
    assert urls.judged(df.limit(0), urls.rule_table(spark)).collect() == []


def test_plan(spark):
    pages, _ = case()
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], SCHEMA)
    plan = urls.judged(df, urls.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
