"""URL filters: a sort-merge range join of reversed-host keys with nested rules.

The labels of a host, reversed and each ended by a dot, make a key: a rule's host is a prefix of the keys of its subdomains, so a rule covers
an interval of keys, and two rules' intervals are nested or apart. Where an interval begins, or ends, the stack of active rules
changes. These events and the URLs are sorted together by key; every URL takes the stack of the last event before it, and in the stack
the longest rule whose path begins the URL's path decides.

Events and URLs are range-partitioned by (key, id), so a frequent host, or URL, is spread over partitions. A partition that begins inside
an interval takes the stack from the last event of an earlier partition: one row per partition. Everything is DataFrame expressions.

The longest rule is that with the longest host and path together, then the longest host, then ``block`` before ``allow``; equal rules count
once. Null rules and rules without a host are ignored; a null path is /. A null URL, or one without ``://``, has empty host and path and
meets no rule. Repeated rows are each judged. Empty tables give no rows, or default verdicts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm.common import written

#: Host, path and verdict of the rules that the query uses.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
STACK = "array<struct<size:int,host:string,path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, with A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels of a host in reverse, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def events(rules: DataFrame) -> DataFrame:
    """(key, stack): from each key on, the rules that are active, up to the next key."""
    known = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "verdict")
    known = known.filter("host <> '' AND verdict IS NOT NULL").dropDuplicates(["host", "path", "verdict"])
    entry = F.struct(F.length(F.concat("host", "path")).alias("size"), "host", "path", "verdict")
    hosts = known.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("own"))
    # Each host with the rules of every host that it is below: its own are the top of the stack.
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = hosts.select(F.col("host").alias("at"), F.explode(above).alias("parent"))
    met = below.join(hosts.select(F.col("host").alias("parent"), "own"), "parent")
    stacks = met.groupBy("at").agg(
        F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("parent") != F.col("at"), F.col("own")))).alias("rest")
    )
    start = reversed_host(F.col("at"))
    # '/' follows '.', so the end of an interval is the key with its last dot raised.
    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    opened = stacks.select(start.alias("key"), "stack", "rest")
    return opened.select("key", "stack").unionByName(opened.select(end.alias("key"), F.col("rest").alias("stack"))).select("key", F.col("stack").cast(STACK).alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The columns of pages (named c0, c1, ... in order) with host, path, rule and verdict."""
    own = pages.columns
    rows = pages.toDF(*[f"c{i}" for i in range(len(own))])
    where = F.col(f"c{own.index(url)}")
    points = rows.select(F.struct(*rows.columns).alias("row"), host_of(where).alias("host"), path_of(where).alias("path"))
    points = points.withColumns({"key": reversed_host(F.col("host")), "stack": F.lit(None).cast(STACK), "spread": F.xxhash64("host", "path", F.monotonically_increasing_id())})
    changes = events(rules).withColumns({"row": F.lit(None).cast(points.schema["row"].dataType), "host": F.lit(None).cast("string"), "path": F.lit(None).cast("string")})
    # An event comes before the URLs at its key.
    changes = changes.withColumn("spread", F.lit(None).cast("long"))
    order = [F.col("key").asc(), F.col("spread").asc_nulls_first()]
    both = points.unionByName(changes).repartitionByRange(*order)
    # Partition numbers must hold for both reads below, so the sorted rows are written.
    placed = written(both.withColumn("part", F.spark_partition_id()), "urls")
    last = placed.filter("stack IS NOT NULL").groupBy("part").agg(F.max_by("stack", "key").alias("left"))
    # One row per partition: the stack with which it begins.
    parts = placed.select("part").distinct().join(last, "part", "left")
    begun = parts.select("part", F.last("left", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("begun"))
    swept = placed.withColumn("active", F.last("stack", ignorenulls=True).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    urls = swept.filter("row IS NOT NULL").join(begun, "part", "left").withColumn("active", F.coalesce("active", "begun", F.array().cast(STACK)))
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.array_max(F.transform(fits, lambda r: F.struct(r["size"], F.length(r["host"]).alias("n"), (r["verdict"] == "block").alias("b"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    urls = urls.withColumn("best", ranked)
    return urls.select(
        *[F.col("row")[f"c{i}"].alias(f"c{i}") for i in range(len(own))], "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


#: The same verdicts by trying every rule.
ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), met AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM met WHERE n = 1"""
