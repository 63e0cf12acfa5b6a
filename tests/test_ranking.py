import pytest
from pyspark.sql import Window, functions as F

from corpuslens.operators import bounded, history, ranking


def skewed(spark, n=3000):
    """Two thirds of the rows share one key."""
    return spark.range(n).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'hot' ELSE 'k' || id % 7 END AS k", "CAST(id * 7919 % 4000 AS INT) - 1500 AS pos", "id"
    )


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n_equals_plain_rank(spark, n):
    df = skewed(spark)
    order = [F.col("pos").desc(), F.col("id")]
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter(F.col("r") <= n)
    got = ranking.top_n_per_key(df.repartition(5), "k", order, n, "r")
    assert sorted(map(tuple, got.select("k", "id", "r").collect())) == sorted(map(tuple, plain.select("k", "id", "r").collect()))


def test_top_n_prunes_before_the_shuffle(spark):
    order = [F.col("pos"), F.col("id")]
    small = ranking.top_n_per_key(skewed(spark), "k", order, 5)._jdf.queryExecution().executedPlan().toString()
    assert small.index("WindowGroupLimit") < small.index("Exchange") < small.rindex("WindowGroupLimit")


def test_top_n_beyond_sparks_limit_deals_a_hot_key_over_shares(spark):
    """Equal rows among them; no task ranks more of a key than its shares let through."""
    df = skewed(spark, 6000).withColumn("pos", F.expr("pos % 50")).selectExpr("k", "pos", "id % 5000 AS id")
    order, limit = [F.col("pos").desc(), F.col("id")], "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "10")
    try:
        got = ranking.top_n_per_key(df.repartition(5), "k", order, 700, "r")
        rows, plan = sorted(map(tuple, got.collect())), got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter("r <= 700")
    assert rows == sorted(map(tuple, plain.collect())) and got.columns == ["k", "pos", "id", "r"]
    assert plan.count("Window") >= 2 and "_share" in plan


def test_hot_keys_are_split_at_run_time(spark):
    """AQE splits the hot partition of a join; thresholds are lowered to the size of the test."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        runs = spark.range(60_000, numPartitions=8).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS repository_id")
        repositories = spark.range(60_000).selectExpr("id", "'n' || id AS name")
        out = history.with_repository(runs, repositories)
        rows = out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 60_000 and all(r.repository_name == f"n{r.repository_id}" for r in rows)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("position", ["pos", "CAST(pos AS BIGINT) * 1000000007", "7", "CASE WHEN id % 4 > 0 THEN pos END"])
def test_row_number_per_key_equals_plain_rank(spark, position):
    """Dense, sparse, equal and null positions, two thirds of them in one key."""
    df = skewed(spark).withColumn("pos", F.expr(position).cast("bigint")).withColumn("k", F.expr("CASE WHEN k = 'k1' THEN NULL ELSE k END"))
    order = [F.col("pos").desc_nulls_last(), F.col("id")]
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    got = ranking.row_number_per_key(df.repartition(7), "k", order, "r")
    rows = got.select("k", "id", "r").collect()
    assert sorted(map(str, rows)) == sorted(map(str, plain.select("k", "id", "r").collect()))


def test_a_hot_key_is_ranked_by_many_tasks(spark):
    # Equal rows stay together, all others spread: the rows lie in about as many partitions as there are.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.row_number_per_key(skewed(spark, 20_000).repartition(7), "k", [F.col("pos"), F.col("id")], "r")
        placed = spark.read.parquet(*[f for f in got.inputFiles()])
        sizes = [r["count"] for r in placed.filter("k = 'hot'").groupBy(F.shiftright("_place", 33)).count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ordered_distinct_and_last_match(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "z", 1)], "k string, v string, p int")
    first = ranking.ordered_distinct(df, "k", "v", "p").orderBy("k", "first_position")
    assert [(r.k, r.v) for r in first.collect()] == [("a", "x"), ("a", "y"), ("b", "z")]
    assert {(r.k, r.v) for r in ranking.last_match(df, "k", "v", "p").collect()} == {("a", "x"), ("b", "z")}


def test_retention_keeps_the_newest(spark):
    runs = spark.range(8).selectExpr("'r' AS repo", "'app_' || id AS run_id").union(
        spark.range(3).selectExpr("'s' AS repo", "'app_' || id AS run_id")
    )
    out = history.retention(runs, ["repo"]).filter("expired").collect()
    assert sorted((r.repo, r.run_id) for r in out) == [("r", "app_0"), ("r", "app_1")]
    overall = history.retention_overall(runs.filter("repo = 'r'").select("run_id"), 3)
    assert sorted(r.run_id for r in overall.filter("expired").collect()) == [f"app_{i}" for i in range(5)]


def test_bounded_listing_and_tail(spark):
    df = spark.range(100).selectExpr("id % 2 AS k", "CAST(id AS INT) AS line_no")
    assert sorted(r.line_no for r in bounded.tail(df, ["k"], 2).collect()) == [96, 97, 98, 99]
    assert bounded.tail(df.filter("line_no < 2"), ["k"], 80).count() == 2
    texts = spark.createDataFrame([(1, "a\nb\nc"), (2, "x"), (3, "")], "k int, t string")
    last = bounded.text_tail(texts, ["k"], "t", 2)
    assert {(r.k, r.line_no, r.line) for r in last.collect() if r.k < 3} == {(1, 2, "b"), (1, 3, "c"), (2, 1, "x")}
    assert "Exchange" not in last._jdf.queryExecution().executedPlan().toString()
    files = df.selectExpr("k AS repo", "lpad(line_no, 3, '0') AS path")
    totals = bounded.scan_totals(files).orderBy("repo").collect()
    assert [(r.total_files, r.scanned_files, r.truncated) for r in totals] == [(50, 50, False), (50, 50, False)]
    first = bounded.bounded_scan(files.filter("repo = 0 OR path < '020'"), 20)
    totals = bounded.scan_totals(files.filter("repo = 0 OR path < '020'"), scanned=first).orderBy("repo").collect()
    assert [(r.total_files, r.scanned_files, r.truncated) for r in totals] == [(50, 20, True), (10, 10, False)]
    assert max(r.path for r in first.collect()) == "038"
    preview = bounded.listing_preview(df.selectExpr("k", "lpad(line_no, 3, '0') AS item"), ["k"], "item", 2)
    assert {(r.n_items, r.preview) for r in preview.collect()} == {(50, "000, 002, ..."), (50, "001, 003, ...")}
