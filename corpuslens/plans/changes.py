"""Change sets over line items, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators import changes
from corpuslens.plans.registry import query
from corpuslens.session import table


def _items(spark, sf_dir):
    """Items: lines by supplier and flag, positioned by order and line."""
    return table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").selectExpr(
        "l_suppkey AS file_path", "l_returnflag AS kind", "l_orderkey * 8 + l_linenumber AS item_pos"
    ).distinct()


def _suggestions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").selectExpr(
        "l_suppkey AS file_path", "l_returnflag AS kind", "l_orderkey * 8 + l_linenumber AS list_pos",
        "'doc ' || l_orderkey || '/' || l_partkey AS text",
    ).distinct()


_MATCH = """
WITH i AS (SELECT DISTINCT l_suppkey AS file_path, l_returnflag AS kind, l_orderkey * 8 + l_linenumber AS item_pos
  FROM lineitem WHERE l_linestatus = 'O'),
s AS (SELECT DISTINCT l_suppkey AS file_path, l_returnflag AS kind, l_orderkey * 8 + l_linenumber AS list_pos,
  'doc ' || l_orderkey || '/' || l_partkey AS text FROM lineitem WHERE l_linestatus = 'F'),
ri AS (SELECT *, row_number() OVER (PARTITION BY file_path, kind ORDER BY item_pos {direction}) AS occurrence FROM i),
rs AS (SELECT *, row_number() OVER (PARTITION BY file_path, kind ORDER BY list_pos, text) AS occurrence FROM s),
matched AS (SELECT file_path, kind, item_pos, occurrence, text FROM ri JOIN rs USING (file_path, kind, occurrence))"""


@query("j5_match_bottom_up", _MATCH.format(direction="DESC") + " SELECT * FROM matched")
def match_bottom_up(spark, sf_dir):
    """The last item of a key takes the first suggestion."""
    return changes.match_occurrences(
        _items(spark, sf_dir), _suggestions(spark, sf_dir), ["file_path", "kind"], "item_pos", "list_pos", "text"
    )


@query("j5_match_top_down", _MATCH.format(direction="") + " SELECT * FROM matched")
def match_top_down(spark, sf_dir):
    """J5 with the other order."""
    return changes.match_occurrences(
        _items(spark, sf_dir), _suggestions(spark, sf_dir), ["file_path", "kind"], "item_pos", "list_pos", "text",
        order="top_down",
    )


@query(
    "w5_budget",
    _MATCH.format(direction="DESC")
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY file_path, item_pos DESC) AS budget_no FROM matched)
SELECT file_path, kind, item_pos, text, CAST(budget_no AS INT) AS budget_no FROM b WHERE budget_no <= 50""",
)
def budget(spark, sf_dir):
    """Matches accepted file by file, bottom-up, until each kind has spent its 50."""
    matched = match_bottom_up(spark, sf_dir)
    order = [F.col("file_path"), F.col("item_pos").desc()]
    return changes.within_budget(matched, ["kind"], order, fixed.CHANGE_BUDGET).drop("occurrence")


@query(
    "u1_generated_items",
    """
WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'doc ' || l_partkey END AS text FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS budget_no FROM g WHERE text IS NOT NULL)
SELECT * REPLACE (CAST(budget_no AS INT) AS budget_no) FROM b WHERE budget_no <= 5""",
)
def generated_items(spark, sf_dir):
    """A generator column that answers some items only; null answers cost no budget."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    generator = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("doc "), F.col("l_partkey").cast("string")))
    made = changes.generated_items(df, generator, "text").drop("l_returnflag")
    return changes.within_budget(made, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 5)


_INSERTIONS_SQL = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'MATLAB' ELSE 'julia' END AS language, CAST((doc_id * 7 + k) % 40 AS INT) AS line_number, k, 'new ' || k AS line
FROM documents, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks"""


def _insertions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).selectExpr(
        "doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'MATLAB' ELSE 'julia' END AS language",
        "CAST((doc_id * 7 + k) % 40 AS INT) AS line_number", "k", "'new ' || k AS line",
    )


def _valid_insertions(spark, sf_dir):
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.size(fn.lines_of(F.col("text"))).alias("n_lines"))
    return changes.valid_insertions(_insertions(spark, sf_dir), lengths, ["doc_id"])


_VALID_SQL = f"""v AS (SELECT i.*, CASE WHEN language = 'MATLAB' THEN line_number ELSE line_number - 1 END AS anchor
  FROM ({_INSERTIONS_SQL}) i JOIN documents d USING (doc_id)
  WHERE line_number >= 1 AND line_number <= len(string_split(text, chr(10))))"""


@query("w7_insertion_anchors", f"WITH {_VALID_SQL} SELECT doc_id, language, line_number, k, anchor FROM v")
def insertion_anchors(spark, sf_dir):
    """Where text goes; a line outside its file is rejected."""
    return _valid_insertions(spark, sf_dir).select("doc_id", "language", "line_number", "k", "anchor")


@query(
    "w6_patched_lines",
    f"""
WITH {_VALID_SQL},
o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
u AS (SELECT doc_id, line_no * 2 AS spot, 0 AS k, line, false AS inserted FROM o
  UNION ALL SELECT doc_id, anchor * 2 + 1, k, line, true FROM v)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot, k) AS new_line_no, line, inserted FROM u""",
)
def patched_lines(spark, sf_dir):
    """Whole documents with lines inserted, renumbered."""
    return changes.patched_lines(table(spark, sf_dir, "documents"), _insertions(spark, sf_dir), ["doc_id"], "text")


@query(
    "f14_changed_only",
    """
WITH new AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ' ELSE text END AS content FROM documents),
base AS (SELECT doc_id, text AS content FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CAST(length(new.content) AS INT) AS n_chars FROM new LEFT JOIN base USING (doc_id) WHERE new.content <> coalesce(base.content, '')""",
)
def changed_only(spark, sf_dir):
    """documents that differ from their base; a missing base is empty."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    new = documents.withColumn(
        "content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content"))
    )
    out = changes.changed_only(new, documents.filter("doc_id % 5 <> 0"), ["doc_id"])
    return out.select("doc_id", F.length("content").alias("n_chars"))


def _paths(spark, sf_dir, condition):
    return table(spark, sf_dir, "orders").filter(condition).selectExpr(
        "'repo' || o_custkey % 50 AS repo", "o_orderpriority || '/' || o_orderkey AS path"
    )


_NOW, _THEN = "o_orderstatus IN ('F', 'O')", "o_orderstatus IN ('O', 'P') AND o_orderkey % 9 <> 0"
_PATH_SQL = "SELECT 'repo' || o_custkey % 50 AS repo, o_orderpriority || '/' || o_orderkey AS path FROM orders WHERE "


@query(
    "j6_path_diff",
    f"""
WITH n AS ({_PATH_SQL}{_NOW}), t AS ({_PATH_SQL}{_THEN})
SELECT repo, path, CASE WHEN t.path IS NULL THEN 'delete' WHEN n.path IS NULL THEN 'add' ELSE 'keep' END AS action
FROM n FULL JOIN t USING (repo, path)""",
)
def path_diff(spark, sf_dir):
    """What a new tree adds, keeps and deletes."""
    return changes.path_diff(_paths(spark, sf_dir, _NOW), _paths(spark, sf_dir, _THEN), ["repo", "path"])


@query(
    "j6_stale_paths",
    f"""
WITH n AS ({_PATH_SQL}{_NOW}), t AS ({_PATH_SQL}{_THEN})
SELECT repo, path FROM n ANTI JOIN t USING (repo, path) WHERE path LIKE '2-HIGH/%'""",
)
def stale_paths(spark, sf_dir):
    """Stale paths below one prefix."""
    return changes.stale_paths(
        _paths(spark, sf_dir, _NOW), _paths(spark, sf_dir, _THEN), ["repo", "path"], prefix="/2-HIGH/"
    )


@query(
    "j7_matching_proposals",
    """
WITH ours AS (SELECT o_custkey % 20 AS repo, 'p' || o_orderkey % 4 AS path, o_orderstatus AS content FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey % 20, o_orderkey % 4 ORDER BY o_orderkey) = 1),
theirs AS (SELECT o_custkey % 20 AS repo, o_custkey AS pr, 'p' || o_orderkey % 4 AS path, min(o_orderstatus) AS content FROM orders GROUP BY 1, 2, 3),
e AS (SELECT repo, count(*) AS expected FROM ours GROUP BY repo)
SELECT t.repo, t.pr, count(*) AS n_paths FROM theirs t LEFT JOIN ours o USING (repo, path) JOIN e USING (repo)
GROUP BY t.repo, t.pr, e.expected HAVING count(*) = e.expected AND bool_and(coalesce(o.content = t.content, false))""",
)
def matching_proposals(spark, sf_dir):
    """Proposals with exactly our paths and contents."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 20 AS repo", "o_custkey AS pr", "'p' || o_orderkey % 4 AS path", "o_orderkey", "o_orderstatus AS content"
    )
    ours = orders.groupBy("repo", "path").agg(F.min_by("content", "o_orderkey").alias("content"))
    theirs = orders.groupBy("repo", "pr", "path").agg(F.min("content").alias("content"))
    return changes.matching_proposals(theirs, ours, ["repo"], "pr")


@query(
    "so1_pattern_union",
    f"SELECT unnest({list(fixed.DEFAULT_IGNORE_PATTERNS)}) AS pattern UNION SELECT '*/' || lang || '/*' FROM documents UNION SELECT '*/urls.py'",
)
def pattern_union(spark, sf_dir):
    """SO1: default patterns and one per language found, once each."""
    defaults = spark.range(1).select(F.explode(F.array(*map(F.lit, fixed.DEFAULT_IGNORE_PATTERNS))).alias("pattern"))
    found = table(spark, sf_dir, "documents").selectExpr("'*/' || lang || '/*' AS pattern")
    return changes.pattern_union(defaults, found)


@query(
    "so2_new_patterns",
    "SELECT '*/' || source || '.py' AS pattern FROM documents EXCEPT SELECT '*/' || source || '.py' FROM documents WHERE lang = 'de' AND doc_id % 2 = 0",
)
def new_patterns(spark, sf_dir):
    """SO2: patterns that are not active yet."""
    documents = table(spark, sf_dir, "documents")
    pattern = "'*/' || source || '.py' AS pattern"
    return changes.new_patterns(documents.selectExpr(pattern), documents.filter("lang = 'de' AND doc_id % 2 = 0").selectExpr(pattern))
