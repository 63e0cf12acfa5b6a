import pandas as pd
from pyspark.sql import functions as F

from corpuslens import functions as fn
from corpuslens.operators import changes, reuse

KEYS = ["file", "name", "kind"]


def test_each_suggestion_is_used_once(spark):
    items = spark.createDataFrame([("f", "bar", "function", 5), ("f", "bar", "function", 9)], "file string, name string, kind string, line int")
    suggestions = spark.createDataFrame(
        [("f", "foo", "class", 0, "A"), ("f", "bar", "function", 1, "B")], "file string, name string, kind string, pos int, text string"
    )
    bottom = changes.match_occurrences(items, suggestions, KEYS, "line", "pos", "text").collect()
    assert [(r.line, r.text) for r in bottom] == [(9, "B")]
    top = changes.match_occurrences(items, suggestions, KEYS, "line", "pos", "text", order="top_down").collect()
    assert [(r.line, r.text) for r in top] == [(5, "B")]


def test_budget_goes_bottom_up(spark):
    items = spark.createDataFrame([("a.py", "first", 1), ("a.py", "second", 5), ("b.py", "third", 1)], "path string, name string, line int")
    items = items.withColumn("run", F.lit(1))
    order = [F.col("path"), F.col("line").desc()]
    assert [r.name for r in changes.within_budget(items, ["run"], order, 1).collect()] == ["second"]
    assert {r.name for r in changes.within_budget(items, ["run"], order, 2).collect()} == {"second", "first"}


def test_generator_may_be_a_pandas_udf(spark):
    @F.pandas_udf("string")
    def generate(names: pd.Series) -> pd.Series:
        return names.where(names != "skip", None)

    items = spark.createDataFrame([("skip", 1), ("keep", 2), ("also", 3)], "name string, line int").withColumn("run", F.lit(1))
    made = changes.generated_items(items, generate("name"), "text")
    assert {r.text for r in changes.within_budget(made, ["run"], [F.col("line")], 2).collect()} == {"keep", "also"}


def test_matlab_text_follows_its_header(spark):
    text = "function result = add(left, right)\n    result = left + right;\nend\n"
    files = spark.createDataFrame([("a.m", text), ("b.js", "function f() {\n}\n")], "path string, content string")
    lengths = files.select("path", F.size(fn.lines_of(F.col("content"))).alias("n_lines"))
    wanted = spark.createDataFrame(
        [("a.m", "matlab", 1, 0, "% Add two values."), ("a.m", "matlab", 9, 0, "% outside"), ("b.js", "javascript", 1, 0, "/** F. */")],
        "path string, language string, line_number int, k int, line string",
    )
    valid = changes.valid_insertions(wanted, lengths, ["path"])
    assert {(r.path, r.anchor) for r in valid.collect()} == {("a.m", 1), ("b.js", 0)}
    out = changes.patched_lines(files, wanted, ["path"]).orderBy("path", "new_line_no").collect()
    assert [r.line for r in out if r.path == "a.m"][:2] == ["function result = add(left, right)", "% Add two values."]
    assert [r.line for r in out if r.path == "b.js"] == ["/** F. */", "function f() {", "}"]
    assert [r.new_line_no for r in out if r.path == "a.m"] == [1, 2, 3, 4]


def test_insertions_merge_inside_the_row(spark):
    files = spark.createDataFrame(
        [("a", "1\n2\n3"), ("b", ""), ("c", None), ("d", "only\n"), ("e", "\n".join(map(str, range(5000))))], "path string, content string"
    )
    rows = [("a", "julia", 1, 2, "x2"), ("a", "julia", 1, 1, "x1"), ("a", "matlab", 3, 0, "last"), ("a", "julia", 3, 9, "y"), ("a", "julia", 0, 0, "no"),
            ("a", "julia", 4, 0, "no"), ("b", "julia", 1, 0, "no"), ("c", "julia", 1, 0, "no"), ("z", "julia", 1, 0, "no file")]
    rows += [("e", "julia", n, 0, f"before {n - 1}") for n in range(1, 5001)]
    insertions = spark.createDataFrame(rows, "path string, language string, line_number int, k int, line string")
    out = {}
    for r in changes.patched_lines(files, insertions, ["path"]).orderBy("path", "new_line_no").collect():
        assert r.new_line_no == len(out.setdefault(r.path, [])) + 1
        out[r.path].append((r.line, r.inserted))
    assert out["a"] == [("x1", True), ("x2", True), ("1", False), ("2", False), ("y", True), ("3", False), ("last", True)]
    assert out["d"] == [("only", False)] and set(out) == {"a", "d", "e"}
    assert out["e"][:4] == [("before 0", True), ("0", False), ("before 1", True), ("1", False)] and len(out["e"]) == 10_000
    new = {r.path: (r.content, r.n_lines, r.n_inserted) for r in changes.patched_files(files, insertions, ["path"]).collect()}
    assert new["a"] == ("x1\nx2\n1\n2\ny\n3\nlast", 7, 4) and set(new) == {"a", "e"}


def test_changed_only_and_paths(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "x"), ("d", "")], "path string, content string")
    base = spark.createDataFrame([("a", "1"), ("b", "0")], "path string, content string")
    assert {r.path for r in changes.changed_only(new, base, ["path"]).collect()} == {"b", "c"}
    actions = {r.path: r.action for r in changes.path_diff(base, new.filter("path <> 'a'"), ["path"]).collect()}
    assert actions == {"a": "delete", "b": "keep", "c": "add", "d": "add"}
    current = spark.createDataFrame([("docs/a",), ("docs/b",), (".nojekyll",), ("x",)], "path string")
    desired = spark.createDataFrame([("docs/a",)], "path string")
    assert {r.path for r in changes.stale_paths(current, desired, ["path"]).collect()} == {"docs/b", "x"}
    assert {r.path for r in changes.stale_paths(current, desired, ["path"], prefix="docs").collect()} == {"docs/b"}


def test_matching_proposals(spark):
    ours = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "repo string, path string, content string")
    proposals = spark.createDataFrame(
        [("r", 1, "a", "1"), ("r", 1, "b", "2"), ("r", 2, "a", "1"), ("r", 3, "a", "1"), ("r", 3, "b", "x"),
         ("r", 4, "a", "1"), ("r", 4, "b", "2"), ("r", 4, "c", "3"), ("s", 5, "a", "1"), ("s", 5, "b", "2")],
        "repo string, pr int, path string, content string",
    )
    assert [r.pr for r in changes.matching_proposals(proposals, ours, ["repo"], "pr").collect()] == [1]


def test_patterns(spark):
    a = spark.createDataFrame([("x",), ("y",)], "pattern string")
    b = spark.createDataFrame([("y",), ("z",), ("z",)], "pattern string")
    assert sorted(r.pattern for r in changes.pattern_union(a, b).collect()) == ["x", "y", "z"]
    assert [r.pattern for r in changes.new_patterns(b, a).collect()] == ["z"]


SUGGESTION = (
    "repo_path string, branch string, run_id string, pos int, file_path string, function_name string, block_type string, "
    "line_number int, language string, generated_docstring string"
)
ITEM = "repo_path string, branch string, file_path string, function_name string, block_type string, line_number int, language string"


def test_reuse_by_exact_then_fuzzy_key(spark):
    suggestions = spark.createDataFrame(
        [
            ("r", "main", "app_1", 0, "a.py", "f", "function", 1, "python", "old"),
            ("r", "main", "app_2", 1, "a.py", "f", "function", 1, "python", "newer"),
            ("r", "main", "app_2", 0, "a.py", "g", "function", 7, "python", "moved"),
            ("r", "main", "app_3", 0, "a.py", "f", "function", 1, "python", ""),
            ("r", "dev", "app_9", 0, "a.py", "f", "function", 1, "python", "other branch"),
        ],
        SUGGESTION,
    )
    items = spark.createDataFrame(
        [("r", "main", "a.py", name, "function", line, "python") for name, line in (("f", 1), ("g", 9), ("h", 1))], ITEM
    )
    out = {r.function_name: (r.generated_docstring, r.source) for r in reuse.reuse(items, suggestions).collect()}
    assert out == {"f": ("newer", "exact-cache"), "g": ("moved", "fuzzy-cache"), "h": (None, None)}
    made = reuse.reuse(items, suggestions, generator=F.concat(F.lit("doc of "), F.col("function_name")))
    assert {r.source for r in made.filter("function_name = 'h'").collect()} == {"generated"}


def test_suggestions_by_file_in_parts(spark):
    df = spark.range(25).selectExpr("'f' AS file", "CAST(25 - id AS INT) AS pos", "'s' || (25 - id) AS text")
    parts = reuse.suggestions_by_file(df.repartition(3), ["file"], "pos", F.col("text"), part_size=10).orderBy("part").collect()
    assert [len(r.suggestions) for r in parts] == [10, 10, 5]
    assert parts[0].suggestions[:2] == ["s1", "s2"] and parts[2].suggestions[-1] == "s25"


def test_occurrences_of_a_hot_key_with_null_and_equal_positions(spark):
    """One key with most rows; every item and suggestion is used once, and null keys match nothing."""
    items = spark.range(900).selectExpr("CASE WHEN id < 800 THEN 'hot' WHEN id < 850 THEN NULL ELSE 'k' END AS path", "'f' AS kind", "CASE WHEN id % 9 > 0 THEN id * id * 100003 END AS line")
    texts = spark.range(700).selectExpr("CASE WHEN id < 600 THEN 'hot' WHEN id < 650 THEN NULL ELSE 'k' END AS path", "'f' AS kind", "CAST(id % 3 AS INT) AS pos", "concat('t', id) AS text")
    out = changes.match_occurrences(items, texts, ["path", "kind"], "line", "pos", "text").collect()
    by_key = {key: [r for r in out if r.path == key] for key in ("hot", "k", None)}
    assert (len(by_key["hot"]), len(by_key["k"]), len(by_key[None])) == (600, 50, 0)
    assert len({r.text for r in out}) == 650 and sorted(r.occurrence for r in by_key["hot"]) == list(range(1, 601))
    lines = [r.line for r in sorted(by_key["hot"], key=lambda r: r.occurrence)]
    assert lines == sorted(lines, reverse=True)
    plan = changes.match_occurrences(items, texts, ["path", "kind"], "line", "pos", "text")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
