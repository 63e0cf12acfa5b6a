"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Single words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials are counted: the raw one over all documents, the
target over trusted ones. A document's score is the mean of log(target / raw) over its n-grams, so length does not matter. It is
kept if it passes the base rules and its score is above the threshold: a fixed number of standard deviations below the mean score of
the trusted documents, the same for every document and every run over the same rows.

All trusted documents make the target and the threshold, as all documents make the raw counts and get verdicts. Everything is
DataFrame expressions. Up to ``BROADCAST_IDS`` trusted ids go to all tasks; beyond that texts are shuffled once to meet them.

A null text has no words and fails the base rules. A document counts as trusted if all its labels are good (quality 1, toxic 0); null
labels and ids don't count. Without trusted documents only the base rules decide. Repeated rows are judged alike, each for itself. An
empty table gives no rows. Repeats are found by 64-bit hashes of which as many bits are given up as a position in the text needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.common import BLANKS, Scratch, discard, free_name, written

BUCKETS = 10_000
BROADCAST_IDS = 1_000_000
DEVIATIONS = 6.0
LEAST_WORDS = 50
MOST_REPEATED = 50  # of a hundred words
_BLANK_CHARACTERS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    trimmed = F.btrim(text, F.lit(_BLANK_CHARACTERS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS + "+"))


def n_dup_lines(text: Column) -> Column:
    """How many lines with a word equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(_BLANK_CHARACTERS)) != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def _pairs(of: str) -> Column:
    """Hashes of each two neighbours in an array column of words."""
    return _neighbours(F.col(of), F.col(of))


def _neighbours(first: Column, second: Column) -> Column:
    """Hashes of first[i] and second[i + 1], where second has as many elements as first, or one more."""
    n = F.greatest(F.size(second) - 1, F.lit(0))
    return F.zip_with(F.slice(first, 1, n), F.slice(second, 2, n), lambda a, b: F.xxhash64(a, b))


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ids of all trusted documents."""
    good = F.min(F.coalesce(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"), F.lit(0)))
    rows = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_trusted")).agg(good.alias("good"))
    return rows.filter("good = 1").select("_trusted")


class Model:
    """Weights of the buckets, and the threshold; None without trusted documents."""

    def __init__(self, weights: list[float] | None, threshold: float | None) -> None:
        self.weights, self.threshold = weights, threshold

    def score(self, tokens: str, pairs: str) -> Column:
        """Mean weight of the n-grams in an array column of words and one of pair hashes; null for none."""
        table = F.expr("cast(split('" + ",".join(f"{w:.5f}" for w in self.weights) + "', ',') as array<double>)")
        total = F.aggregate(tokens, F.lit(0.0), lambda s, w: s + F.get(table, _bucket(F.xxhash64(w))))
        total += F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(table, _bucket(p)))
        return F.when(F.size(tokens) > 0, total / (F.size(tokens) + F.size(pairs)))


def _bucket_counts(rows: DataFrame) -> list[float]:
    """How often the n-grams in a column of words fall in each bucket, plus one."""
    hashed = rows.select("_words", _pairs("_words").alias("_pairs"))
    buckets = F.concat(F.transform("_words", lambda w: _bucket(F.xxhash64(w))), F.transform("_pairs", _bucket))
    # The outer form: from the plain one Spark derives a "not empty" filter, which computes the array once more.
    grams = hashed.select(F.explode_outer(buckets).alias("bucket")).filter("bucket IS NOT NULL")
    counts = [1.0] * BUCKETS
    for row in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each bucket at most
        counts[row["bucket"]] += row["n"]
    return counts


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", deviations: float = DEVIATIONS, broadcast_ids: int = BROADCAST_IDS) -> Model:
    """Count both multinomials over the documents, then score the trusted ones for the threshold."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    good = written(trusted_ids(labels), "trusted")
    good = good.hint("broadcast" if good.count() <= broadcast_ids else "shuffle_hash")
    texts = Scratch(docs.sparkSession, "chosen")
    chosen = texts.put(rows.join(good, F.col("_id") == F.col("_trusted")).select("_text")).select(words(F.col("_text")).alias("_words"))
    target = _bucket_counts(chosen)
    if sum(target) == BUCKETS:
        return Model(None, None)
    raw = _bucket_counts(rows.select(words(F.col("_text")).alias("_words")))
    model = Model([math.log(t / sum(target)) - math.log(r / sum(raw)) for t, r in zip(target, raw)], None)
    scored = chosen.withColumn("_pairs", _pairs("_words"))
    # In whole millionths, so that the sums do not depend on their order.
    score = F.when(F.size("_words") >= LEAST_WORDS, F.round(model.score("_words", "_pairs") * 1_000_000).cast("long"))
    scores = written(scored.select(score.alias("s")), "scores")
    discard(docs.sparkSession, texts.path)
    n, mean, square = scores.agg(F.count("s"), F.sum("s"), F.sum(F.col("s").cast("decimal(38,0)") * F.col("s"))).first()
    if n:
        mean = mean / n
        model.threshold = (mean - deviations * math.sqrt(max(0.0, float(square) / n - mean * mean))) / 1_000_000
    return model


def judged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept. Columns of these names
    are replaced; the text itself stays."""
    own = free_name(docs, "_q")
    body, tokens, pairs, windows, packed, hits = (f"{own}_{x}" for x in ("text", "words", "pairs", "windows", "packed", "hits"))
    rows = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(tokens, words(F.col(body)))
    n = F.size(tokens)
    rows = rows.withColumn(f"{own}_shift", F.ceil(F.log2(n + F.lit(1))).cast("int")).withColumn(pairs, _pairs(tokens))
    rows = rows.withColumn(windows, F.when(n >= 3, _neighbours(F.col(pairs), F.slice(tokens, 2, n - 1))).otherwise(F.array().cast("array<bigint>")))
    # Where a window repeats: hashes above their positions, so that equal windows become neighbours when sorted.
    placed = F.expr(f"sort_array(transform({windows}, (h, i) -> shiftleft(h, {own}_shift) | i))")
    rows = rows.withColumn(packed, F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed).otherwise(F.array().cast("array<bigint>")))
    same = lambda k: f"coalesce(shiftrightunsigned(get({packed}, i + {k}), {own}_shift) = shiftrightunsigned(x, {own}_shift), false)"
    rows = rows.withColumn(hits, F.expr(f"transform(filter({packed}, (x, i) -> {same(-1)} OR {same(1)}), x -> x & (shiftleft(1L, {own}_shift) - 1))"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.col(hits), lambda p: F.array(p, p + 1, p + 2)))))
    symbols = F.length(F.regexp_replace(F.col(body), r"[^#*$%&|<>]+", ""))
    out = rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(F.col(tokens), "")).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": n_dup_lines(F.col(body)).cast("long"),
            "n_repeat_words": covered.cast("long"),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    if model.weights is None:
        out = out.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    else:
        out = out.withColumn("score", model.score(tokens, pairs))
        above = F.lit(True) if model.threshold is None else F.round(F.col("score") * 1_000_000) >= model.threshold * 1_000_000
        out = out.withColumn("kept", ~F.col("base_failed") & above)
    return out.drop(body, tokens, pairs, windows, packed, hits, f"{own}_shift")


def passing(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose verdict is ``kept``.

    The verdict goes through a generator of one row: a filter on a plain column would be moved below the projections, and
    compute the words of a text anew for every use of them.
    """
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    verdict = judged(plain, model, f"c{own.index(text)}").select(*plain.columns, F.explode_outer(F.array("kept")).alias("verdict"))
    return verdict.filter("verdict").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
