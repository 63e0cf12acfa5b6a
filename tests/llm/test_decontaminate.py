"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def case():
    rng = random.Random(4)
    vocabulary = ["a", "b", "Été", "straße", "X9", "日本", "k"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([10, 12, 25])))) for i in range(30)]
    items += [(100, "Only three, words!"), (101, "only THREE words"), (102, " .. "), (103, None), (104, "")]
    docs = []
    for d in range(60):
        text = ", ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))
        if d % 3 == 0:
            text += "\n" + rng.choice(items[:30])[1].upper().replace(" ", "-")
        if d % 7 == 0:
            text += " only-three.words "
        docs.append((d, text))
    docs += [(None, None), (None, "x"), (200, ""), (201, "z " * 100_000 + items[0][1] + " q" * 100_000), (201, "twice"), (201, "twice")]
    return docs, items


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_scan(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BYTES", most)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 50)
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.digest(decontaminate.scan(d, spark.createDataFrame(items, "item_id long, text string"), [F.col("doc_id")]))
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == slow(docs, items)


def test_removal_keeps_columns_and_clean_documents(spark):
    docs, items = case()
    d = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, spans string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    dirty = {(r[0]) for r in slow([(i, t) for i, t in enumerate(t for _, t in docs)], items) if r[5]}
    whole = decontaminate.decontaminate(d, b)
    assert whole.columns == d.columns
    texts = [t for _, t in docs]
    assert sorted((r.text or "") for r in whole.collect()) == sorted((t or "") for i, t in enumerate(texts) if i not in dirty)
    cut = decontaminate.decontaminate(d, b, remove="spans").collect()
    assert len(cut) == len(docs)
    assert {r.text for r in cut} >= {t for i, t in enumerate(texts) if i not in dirty}
    one = spark.createDataFrame([(1, "é é - Only three, words! (b)")], "doc_id long, text string")
    assert decontaminate.decontaminate(one, b, remove="spans").first().text == "é é - ! (b)"


def test_empty_tables(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.scan(d.limit(0), b, [F.col("doc_id")]).collect() == []
    assert decontaminate.decontaminate(d, b.limit(0)).count() == len(docs)


def test_one_window_beyond_the_bound_has_a_result(spark):
    """Ten words of half a million letters each: 5 MB in one window."""
    long = " ".join(c * 500_000 for c in "abcdefghij")
    items = [(1, long), (2, "x y"), (None, "x y")]
    docs = [(1, "p " + long.upper() + " q"), (2, long[1:]), (3, "x  y"), (4, None)]
    assert len(long) > decontaminate.MOST_BYTES
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digest(decontaminate.scan(d, b, [F.col("doc_id")]))
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == slow(docs, items)
    assert [r.text for r in decontaminate.decontaminate(d, b, remove="spans").orderBy("doc_id").collect()] == ["p  q", long[1:], "", None]


def test_documents_are_read_once_however_large_the_benchmark(spark, monkeypatch):
    """Many times the bound, a passage in a third of the documents, names that clash, and long lists of windows in one text."""
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 100)
    monkeypatch.setattr(decontaminate, "CHUNK", 16)
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(40))) for i in range(50)]
    docs = [(i, (items[0][1] if i % 3 == 0 else f"clean {i}") + f" tail{i} " + items[i % 50][1][:60]) for i in range(150)]
    docs.append((999, " and ".join(text for _, text in items)))
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    d = spark.createDataFrame(docs, "_r long, text string").repartition(5).mapInPandas(count, "_r long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digest(decontaminate.scan(d, b, [F.col("_r"), F.lit(1).alias("_spans"), F.lit(2).alias("_likely")]))
    got = [tuple(r) for r in found.select("_r", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == slow(docs, items)
    assert found.agg(F.sum(F.col("_spans") + F.col("_likely"))).first()[0] == 3 * len(docs)
    assert read.value == len(docs)


def test_long_items_and_repeated_rows_have_a_result(spark, monkeypatch):
    """One item of many times the bound, and one row that is most of the benchmark."""
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 150)
    rng = random.Random(9)
    long = " , ".join(f"word{rng.randrange(10**6)}" for _ in range(120))
    items = [(1, long), (3, "b " + "z" * 130), (5, "5 6"), *[(2, " ".join(f"r{i}" for i in range(30)))] * 40]
    w = long.split(" , ")
    docs = [(i, " ".join(w[i : i + 9 + i % 3])) for i in range(110)]
    docs += [(200, long.upper()), (201, items[-1][1]), (202, items[1][1] + " 5 6"), (203, "none")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digest(decontaminate.scan(d, b, [F.col("doc_id")]))
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == slow(docs, items)
