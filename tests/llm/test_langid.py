"""Language identification: counts and distances against a plain version, held-out accuracy, and the odd cases."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import langid

KIND = langid.kinds()


def plain_counts(text):
    text = "\x01" + "".join(c if unicodedata.category(c)[0] in "LM" else "\x01" for c in text.lower()) + "\x01"
    grams = Counter(c for c in text if c != "\x01")
    grams.update(text[i : i + 2] for i in range(len(text) - 1) if text[i : i + 2] != "\x01\x01")
    grams.update(text[i : i + 3] for i in range(len(text) - 2) if text[i + 1] != "\x01")
    return {sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g)): n for g, n in grams.items()}


def plain_prediction(text, profiles):
    own = sorted(plain_counts(text).items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]
    best = min((sum(abs(p[g] - i) if g in p else langid.PROFILE for i, (g, _) in enumerate(own)), name) for name, p in profiles.items())
    return best[1], 1 - best[0] / (langid.PROFILE * len(own))


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_counts(block):
    for text in ("", "a", " a ", "The the  THE", "naïve—été 12 ß𝒳 हिन्दी", "x1y--z\n", "ab" * 40):
        keys, counts, letter = langid.gram_counts(text, KIND, block)
        assert dict(zip(keys.tolist(), counts.tolist())) == plain_counts(text)
        assert letter == any(c.isalpha() for c in text)


def test_top_breaks_ties_by_key():
    keys, counts = np.array([1, 2, 3, 4, 5]), np.array([2, 9, 2, 2, 1])
    assert langid.top(keys, counts, 3).tolist() == [2, 1, 3]


def test_query_against_plain_version(spark, sf_dir):
    from corpuslens.llm.queries import op12_language_id

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    total = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None:
            total.setdefault(r.lang, Counter()).update(plain_counts(r.text))
    profiles = {name: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE])} for name, c in total.items()}
    found = {r.doc_id: r for r in op12_language_id(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    right = tested = 0
    for r in rows:
        name, score = plain_prediction(r.text, profiles)
        got = found[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (got.lang_pred, round(got.score, 9)) == (name, round(score, 9)) and 0 <= score <= 1
        tested += got.held_out
        right += got.held_out and name == r.lang
    assert tested > 20 and right / tested > 0.97


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, LANG_PRED int, score string"
    rows = [(1, "der die das und", "de", 1, "s"), (2, "the and of that", "en", 1, "s"), (2, "the and of that", "en", 1, "s"), (None, "the and", "en", 1, "s"), (3, "the", None, 1, "s"), (4, None, "en", 1, "s")]
    docs = spark.createDataFrame(rows, schema)
    profiles = langid.learn(docs)
    asked = spark.createDataFrame([(7, None, None, 0, ""), (8, "", "x", 0, ""), (9, "12 ... 3", "x", 0, ""), (None, "the the", None, 0, ""), (10, "und das", "en", 0, ""), (10, "und das", "en", 0, ""), (11, "the and " * 300_000, None, 0, "")], schema)
    found = langid.predicted(asked, profiles)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score > 0) for r in found.collect()))
    assert got == [(0, "en", True), (7, "und", False), (8, "und", False), (9, "und", False), (10, "de", True), (10, "de", True), (11, "en", True)]
    ids = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in ids.select(langid.held_out("doc_id")).collect()] == [False, zlib.crc32(b"1") % 4 == 2]


def test_equal_profiles_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    same = langid.learn(spark.createDataFrame([(1, "abc abc", "zz"), (2, "abc abc", "aa")], schema))
    docs = spark.createDataFrame([(1, "abc", None)], schema)
    assert langid.predicted(docs, same).first().lang_pred == "aa"
    nothing = langid.learn(docs.limit(0))
    assert tuple(langid.predicted(docs, nothing).first()[-2:]) == ("und", 0.0)
    assert langid.predicted(docs.limit(0), same).collect() == []


def test_tasks_hand_on_partial_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} and more", "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    want = sorted(map(tuple, langid.learn(docs).collect()))
    monkeypatch.setattr(langid, "HELD", 10)
    assert sorted(map(tuple, langid.learn(docs).collect())) == want
