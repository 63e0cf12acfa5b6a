"""Language identification by rank order: a document's most frequent n-grams against each language's, by out-of-place distance.

Words are runs of letters and marks in lower case, with a pad on either side; n-grams are of one to three characters, over the whole
text. The profile of a language is its PROFILE most frequent n-grams over all learnable documents (a tie: the smaller key first), that
of a document likewise. The distance sums how far each n-gram of the document is out of place in the language's profile, PROFILE
for one that is not in it. The nearest language is predicted (a tie: the smaller name); the score is one minus the
distance over the greatest possible one.

Tasks add counts up before they leave them: what is shuffled is one row per task, language and n-gram. The profiles, languages times
PROFILE rows, go to every task. A null text, or one without a letter, is ``und`` with score 0; so is any text if nothing could be learnt.
Rows are judged each, so repeated rows and ids do no harm; a null id counts as the empty text. Very long texts are counted in blocks.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm.common import kept

#: N-grams of a profile.
PROFILE = 400
#: The character that stands for all that is not in a word; no code point of a letter or mark.
PAD = 1
BITS = 21
#: Characters that are counted at once.
BLOCK = 1_000_000
#: Distinct n-grams that a task holds before it hands them on.
HELD = 2_000_000
UNKNOWN = "und"


def kinds() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark, else 0."""
    by_category = {"L": 2, "M": 1}
    return np.array([by_category.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.int8)


def gram_counts(text: str, kind: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, bool]:
    """(keys ascending, counts, has a letter) of the 1- to 3-grams of a text's padded words. A key holds the code points, 21 bits each."""
    text = text.lower()
    grams, counts, letter = [], [], False
    # The padded text is PAD, characters, PAD; a gram belongs to the block of its first character.
    for at in range(0, len(text) + 1, block):
        end = min(at + block, len(text) + 1)
        codes = np.frombuffer(text[max(at - 1, 0) : end + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind_of = kind[codes]
        letter = letter or bool((kind_of == 2).any())
        x = np.full(end - at + 2, PAD, np.int64)
        first = 1 if at == 0 else 0
        x[first : first + len(codes)] = np.where(kind_of > 0, codes, PAD)
        a, b, c = x[:-2], x[1:-1], x[2:]
        in_a, in_b = a != PAD, b != PAD
        pairs = (a << BITS) | b
        keys = np.concatenate([a[in_a], pairs[in_a | in_b], ((pairs << BITS) | c)[in_b]])
        found = np.unique(keys, return_counts=True)
        grams.append(found[0])
        counts.append(found[1])
    return *summed(grams, counts), letter


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return distinct, total


def top(keys: np.ndarray, counts: np.ndarray, profile: int) -> np.ndarray:
    """The most frequent keys, in order."""
    if len(keys) > profile:
        least = np.partition(counts, len(counts) - profile)[len(counts) - profile]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))][:profile]


def held_out(doc_id: str | Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32(doc_id as text) mod folds is the fold that nothing is learnt from."""
    key = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % folds == fold


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of each language's profile, ranks from 0, over all rows with a text and a language."""
    source = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    most = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = kept("langid.kinds", kinds)
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            new: dict[str, list] = {}
            size = 0
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts, _ = gram_counts(value.as_py(), kind)
                new.setdefault(name, []).append((keys, counts))
                size += len(keys)
                if size > most:
                    _add(held, new)
                    new, size = {}, 0
            _add(held, new)
            if sum(len(keys) for keys, _ in held.values()) > most:
                yield from out()
        yield from out()

    counted = source.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counted.withColumn("rank", rank).where(F.col("rank") < profile).select("lang", "gram", "rank")


def _add(held: dict, new: dict) -> None:
    for name, found in new.items():
        if name in held:
            found = [held[name], *found]
        held[name] = summed([k for k, _ in found], [c for _, c in found])


def predicted(docs: DataFrame, profiles: DataFrame, text: str = "text", profile: int = PROFILE) -> DataFrame:
    """The rows with lang_pred and score; columns of these names are replaced."""
    ranks: dict[str, dict[int, int]] = {}
    for name, gram, rank in profiles.select("lang", "gram", "rank").collect():
        ranks.setdefault(name, {})[gram] = rank
    names = sorted(ranks)
    vocabulary = np.array(sorted({g for own in ranks.values() for g in own}), np.int64)
    places = np.full((len(vocabulary), len(names)), -1, np.int32)
    for column, name in enumerate(names):
        at = np.searchsorted(vocabulary, np.array(list(ranks[name]), np.int64))
        places[at, column] = list(ranks[name].values())

    kept_columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept_columns], F.col(text).alias("_langid_text"))
    schema = source.drop("_langid_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = kept("langid.kinds", kinds)
        for batch in batches:
            found, scores = [], []
            for value in batch.column(batch.num_columns - 1):
                value, best, score = value.as_py(), UNKNOWN, 0.0
                keys, counts, letter = gram_counts(value, kind) if value and names else ((), (), False)
                if letter:
                    own = top(keys, counts, profile)
                    at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
                    there = np.flatnonzero(vocabulary[at] == own)
                    rows = places[at[there]]
                    out_of_place = np.where(rows < 0, profile, np.abs(rows - there[:, None])).sum(axis=0) + profile * (len(own) - len(there))
                    nearest = int(out_of_place.argmin())
                    best, score = names[nearest], 1.0 - float(out_of_place[nearest]) / (profile * len(own))
                found.append(best)
                scores.append(score)
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*kept_columns, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
