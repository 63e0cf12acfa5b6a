"""The pipeline and each stage against brute force on a small table."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
import test_decontaminate as leaks  # noqa: E402
import test_quality as rules  # noqa: E402
import test_secrets as spans  # noqa: E402
import test_simhash as prints  # noqa: E402
import test_tokens as ids  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(150)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(5)]
    docs = []
    for d in range(60):
        words = rng.choices([f"#{w}%" for w in vocabulary] if d % 8 == 0 else vocabulary, k=rng.choice([20, 60, 200]))
        if d % 9 == 1:
            words += items[d % 5][1].split()
        if d % 7 == 2:
            words += ["password=abcdef123456", "AKIA" + "Z" * 16]
        docs.append((d, " ".join(words)))
        if d % 5 == 3:
            docs.append((1000 + d, " ".join(words)))
            docs.append((2000 + d, " ".join([*words, "end"])))
    docs += [(5000, None), (5001, ""), (None, "no id " + docs[3][1]), docs[4], docs[4]]
    labels = [(d, 0 if d % 8 == 0 else 1, 0) for d in range(0, 60, 2)]
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "en", f"s{i % 3}", len(t or ""), float(i), "x") for i, (d, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, labels, items


def slow(docs, labels, items):
    kept = [r for r in docs if rules.slow(docs, labels)[r][-1]]
    yield kept
    roots = prints.slow_components([prints.slow_fingerprint(t) for _, t in kept])
    groups = {}
    for row, root in zip(kept, roots):
        groups.setdefault(root, []).append(row)
    kept = [min(rows, key=lambda r: (r[0] is None, r[0] or 0)) for rows in groups.values()]
    yield kept
    dirty = [r[5] for r in (leaks.slow([row], items)[0] for row in kept)]
    kept = [row for row, bad in zip(kept, dirty) if not bad]
    yield kept
    out = []
    for d, text in kept:
        clean, at = "", 0
        for start, _, end in spans.slow(text):
            if start >= at:
                clean += text[at:start] + "[SECRET]"
            at = max(at, end)
        out.append((d, clean + text[at:]))
    yield out
    pieces = []
    for d, text in out:
        tokens = [*ids.library(text), 0]
        for a in range(0, len(tokens), 1024):
            pieces.append((d, a, len(tokens[a : a + 1024]), zlib.crc32(np.array(tokens[a : a + 1024], "<u4").tobytes()), len(tokens)))
    yield pieces


def test_each_stage(spark, folder):
    at, docs, labels, items = folder
    now = spark.read.parquet(f"{at}/documents.parquet")
    columns, before = now.columns, len(docs)
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, slow(docs, labels, items)):
        path = f"{at}/{name}"
        stage(spark, now, at).write.parquet(path)
        now = spark.read.parquet(path)
        if name != "packing":
            assert now.columns == columns
            got = [(r.doc_id, r.text) for r in now.collect()]
            assert all(r.n_chars == len(r.text) for r in now.collect())
            assert len(got) < before or name == "secret_scans"
            before = len(got)
        else:
            got = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in now.collect()]
        assert Counter(map(str, got)) == Counter(map(str, wanted)), name


def test_run(spark, folder):
    at, docs, labels, items = folder
    *_, wanted = slow(docs, labels, items)
    found = corpus_pipeline.run(spark, at).collect()
    assert Counter(str(tuple(r)[:5]) for r in found) == Counter(map(str, wanted))
    fill = Counter()
    for r in found:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_empty_tables(spark, folder, tmp_path):
    at, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
