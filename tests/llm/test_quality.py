"""Quality rules against a plain Python version."""

import math
import random
import re
from collections import Counter

import xxhash

from corpuslens.llm import quality

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def base(text):
    w, text = words(text), text or ""
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if words(line)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def grams(text):
    def signed(x):
        return x - 2**64 if x >> 63 else x

    w = words(text)
    first = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    pairs = [xxhash.xxh64_intdigest(b.encode(), a) for a, b in zip(first, w[1:])]
    return [signed(x) % quality.BUCKETS for x in first + pairs]


def slow(docs, labels):
    good = {}
    for d, q, t in labels:
        good[d] = good.get(d, True) and q == 1 and t == 0
    trusted = {d for d, g in good.items() if g and d is not None}
    raw, target = Counter(), Counter()
    for d, text in docs:
        raw.update(grams(text))
        if d in trusted:
            target.update(grams(text))
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    weight = [round(math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n), 5) for b in range(quality.BUCKETS)]
    score = {text: sum(weight[b] for b in grams(text)) / len(grams(text)) if words(text) else None for _, text in docs}
    sample = [round(score[t] * 1e6) for d, t in docs if d in trusted and len(words(t)) >= 50]
    mean = sum(sample) / len(sample)
    limit = mean - quality.DEVIATIONS * math.sqrt(max(0, sum(s * s for s in sample) / len(sample) - mean * mean))
    return {(d, t): (*base(t), not base(t)[-1] and round(score[t] * 1e6) >= limit) for d, t in docs}


def case():
    rng = random.Random(8)
    normal, junk = [f"w{i}" for i in range(200)], [f"#{i}%%" for i in range(200)]
    docs, labels = [], []
    for d in range(120):
        bad = d % 6 == 0
        text = " ".join(rng.choices(junk if bad else normal, k=rng.choice([20, 49, 50, 80, 300])))
        docs.append((d, text))
        if d % 2:
            labels.append((d, 0 if bad else 1, int(d % 11 == 0)))
    docs += [(300, None), (301, ""), (302, " \n\t "), (303, "a b c a b c a b c " * 30), (304, "line one\nline one\n\n \nother\x0bline é x\n" * 9), (305, "ü " * 60_000)]
    docs += [(None, "null id " * 40), docs[3], docs[3]]
    labels += [(3, 1, 0), (None, 1, 0), (5, None, None)]
    return docs, labels


def test_judged(spark):
    docs, labels = case()
    df = spark.createDataFrame([(d, t, "x", 2) for d, t in docs], "doc_id long, text string, kept string, n_words int")
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rows = quality.judged(df, model).collect()
    assert len(rows) == len(docs)
    wanted = slow(docs, labels)
    for r in rows:
        assert tuple(r[n] for n in names) == wanted[r.doc_id, r.text], r.doc_id
    kept = {r.doc_id for r in rows if r.kept}
    assert kept and not any(d is not None and d < 120 and d % 6 == 0 for d in kept)


def test_without_labels_or_rows(spark):
    docs, labels = case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(df, empty)
    rows = quality.judged(df, model).collect()
    assert all(r.kept == (not base(r.text)[-1]) for r in rows)
    model = quality.fit(df.limit(0), spark.createDataFrame(labels, empty.schema))
    assert quality.judged(df.limit(0), model).collect() == []


def test_no_python_in_the_plan(spark):
    docs, labels = case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plan = quality.judged(df, quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_all_trusted_documents_count(spark):
    """Where all documents are trusted, target and raw corpus are one, whatever their number."""
    docs = spark.range(20_500).selectExpr("id AS doc_id", "'w' || id AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted_ids(labels).count() == 20_500
    assert set(quality.fit(docs, labels).weights) == {0.0}


def test_shuffled_ids_give_the_same_model(spark):
    docs, labels = case()
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sent, shuffled = quality.fit(df, marks), quality.fit(df, marks, broadcast_ids=0)
    assert sent.threshold and (sent.weights, sent.threshold) == (shuffled.weights, shuffled.threshold)
