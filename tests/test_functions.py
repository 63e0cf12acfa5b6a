"""Scalar columns against golden pairs; each test evaluates all of its pairs in one job."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from corpuslens import functions as fn
from corpuslens.operators import classify, navigation


def evaluate(spark, column, values, kind="string"):
    """The column over one value per row, in input order."""
    rows = [(i, value) for i, value in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", column(F.col("v")).alias("out"))
    return [row.out for row in df.orderBy("i").collect()]


def check(spark, column, pairs, kind="string"):
    assert evaluate(spark, column, [value for value, _ in pairs], kind) == [expected for _, expected in pairs]


def test_redaction(spark):
    secret = "a" * 24
    placeholder = "***REDACTED-TOKEN***"
    families = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"]
    families += [f"gl{code}-" for code in ("pat", "dt", "rt", "cbt", "ptt", "ft", "imt", "agent", "soat", "oas")]
    families += ["sk-", "sk-proj-"]
    pairs = [(f"use {family}{secret} now", f"use {placeholder} now") for family in families]
    pairs += [
        (f"fatal: https://x-access-token:ghp_{secret}@host.example/o/r.git/", "fatal: https://***:***@host.example/o/r.git/"),
        ("see ://a:b:c@h and ://nobody@h and ://x:@h", "see ://***:***@h and ://nobody@h and ://x:@h"),
        ("Authorization: Bearer abcdefgh1234", f"Authorization: Bearer {placeholder}"),
        ("authorization: basic dXNlcjpwYXNz=", f"authorization: basic {placeholder}"),
        ("Bearer short", "Bearer short"),
        ("ghp_short and plain text", "ghp_short and plain text"),
        ("xghp_" + secret, "xghp_" + secret),
        ("", ""),
        (None, None),
    ]
    check(spark, fn.redact_secrets, pairs)


def test_scrub_payload(spark):
    pairs = [
        ('{"token":"x","a":1,"n":{"token":2}}', '{"a":1,"n":{"token":2}}'),
        ('{"a":1}', '{"a":1}'),
        ("not json", "not json"),
        ('["token"]', '["token"]'),
        (None, None),
    ]
    check(spark, fn.scrub_payload, pairs)
    check(spark, lambda c: fn.payload_has_key(c, "token"), [(v, i == 0) for i, (v, _) in enumerate(pairs)])


def test_scrubbing_cuts_only_the_member(spark):
    big = "12345678901234567890123456789012345678901234"
    pairs = [
        ('{ "token" : "x" , "a": ' + big + ',  "b":1.10 }', '{ "a": ' + big + ',  "b":1.10 }'),
        ('{"b": 1.10, "token": {"token": [1, "}"]} , "a":2}', '{"b": 1.10, "a":2}'),
        ('{"a": 1e3,\n "token": 2\n}', '{"a": 1e3\n}'),
        ('{"token":1,"token":2,"a":3}', '{"a":3}'),
        ('{"token":1,"a":3,"token":2}', '{"a":3}'),
        (' {"token": null} ', " {} "),
        ('{"to\\u006ben":1,"é,{":"\\"token\\": 5"}', '{"é,{":"\\"token\\": 5"}'),
        ('{"a":"token","n":[{"token":1}]}', '{"a":"token","n":[{"token":1}]}'),
        ('{"token":1} x', '{"token":1} x'),
        ('{"token":1}{"token":2}', '{"token":1}{"token":2}'),
        ("{'token':1}", "{'token':1}"),
        ('{"token":1,}', '{"token":1,}'),
        ('{"token":"' + "x\\n" * 50_000 + '","a":"' + "é" * 50_000 + '"}', '{"a":"' + "é" * 50_000 + '"}'),
        ("{}", "{}"),
        ("", ""),
    ]
    check(spark, fn.scrub_payload, pairs)
    check(spark, lambda c: fn.payload_has_key(c, "token"), [(v, v != kept) for v, kept in pairs])


def test_scrubbing_equals_a_parser(spark):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind > 3:
            members = [value(depth - 1) for _ in range(rng.randrange(4))]
            return members if kind == 4 else {rng.choice(["token", "a", 'q"', "b\\"]): m for m in members}
        return [rng.randrange(99), None, rng.choice(["", "token", '"},{', "é\n"]), 1.5][kind]

    texts = []
    for _ in range(300):
        keys = rng.sample(["token", "a", 'x"y', "to", "é", "tokens"], rng.randrange(6))
        texts.append(json.dumps({k: value(3) for k in keys}, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
    for text, kept in zip(texts, evaluate(spark, fn.scrub_payload, texts)):
        expected = [(k, v) for k, v in json.loads(text).items() if k != "token"]
        assert list(json.loads(kept).items()) == expected
        if '"token"' not in text:
            assert kept == text


def test_languages(spark):
    check(spark, fn.reporting_language, [
        ("app.py", "python"), ("Main.java", "java"), ("solver.jl", "julia"), ("README.md", None),
        ("package.json", None), ("A.PY", "python"), (".py", None), ("x.tar.KTS", "kotlin"),
    ])
    check(spark, fn.supported_language, [
        ("a.py", "python"), ("a.PY", None), (".py", "python"), ("a.tsx", "typescript"), ("a.matlab", "matlab"), ("a", None),
    ])
    check(spark, lambda c: fn.resolve_language(c, F.lit("")), [("a.JS", "javascript"), ("a.rb", ""), ("a", "")])
    check(spark, lambda c: fn.resolve_language(F.lit("a.py"), c), [("JULIA", "julia"), ("", "python"), (None, "python")])


def test_folders(spark):
    check(spark, fn.normalise_folder, [
        (" src ", "src"), ("/docs/", "docs"), ("nested/path//", "nested/path"), ("", ""), ("/", ""),
        ('"src"', "src"), ("' a '", "a"), ("\t'/x/'\n", "x"),
    ])
    check(spark, lambda c: fn.in_folders(c, ["src", "docs/guides"]), [
        ("src/main.py", True), ("docs/guides/setup.md", True), ("docs/api/index.md", False),
        ("scripts/build.py", False), ("srcs/a.py", False), ("src", True), ("/src/a", True),
    ])
    check(spark, lambda c: fn.in_folders(c, ["", " / "]), [("anything", True)])
    check(spark, lambda c: F.array_join(fn.parse_folders(c), "|"), [
        ("a, b/\n'c'\n\n", "a|b|c"), ("", ""), (None, ""),
    ])
    check(spark, fn.has_parent_reference, [("../a", True), ("a/../b", True), ("a/..", True), ("a..b/c", False)])
    check(spark, lambda c: fn.in_folder_column(c, F.array(F.lit("a"))), [("a/b", True), ("b", False)])
    check(spark, lambda c: fn.in_folder_column(c, F.lit(None).cast("array<string>")), [("b", True)])


def test_globs(spark):
    names = ["a.pyc", "build", "x1.log", "x9.log", "xa.log", "a[b", "a+b", "q.txt"]
    globs = ["*.pyc", "build/", "x[0-4].log", "a[b", "a+b", "?.txt"]
    expected = [True, True, True, False, False, True, True, True]
    assert evaluate(spark, lambda c: fn.matches_globs(c, globs), names) == expected
    # Patterns from a column give the same answers.
    rules = spark.createDataFrame([(g,) for g in globs], "glob string").select(fn.glob_to_regex(F.col("glob")).alias("r"))
    merged = "|".join(row.r for row in rules.collect())
    assert evaluate(spark, lambda c: c.rlike(merged) | F.concat(c, F.lit("/")).rlike(merged), names) == expected
    check(spark, lambda c: F.array_join(classify.gitignore_globs(c), "|"), [("# c\n\n  *.pyc \n!x\n", "*.pyc|!x"), ("", "")])


def test_paths(spark):
    check(spark, fn.ignored_directory, [
        ("a/node_modules/b.js", True), (".git/x", True), ("a/.tox", False), ("venv2/a", False), ("a.py", False),
    ])
    check(spark, fn.repo_path_from_url, [
        ("https://github.com/user/repo.git", "user/repo"), ("https://gitlab.com/a/b/?x=1#y", "a/b"),
        ("user/repo", "user/repo"), ("http://h", ""), ("https://h/a b", "a b"),
    ])
    check(spark, fn.repo_key, [("/o/r name/", "o__r__name"), ("", "unknown"), (None, "unknown"), ("a.b-c_d", "a.b-c_d")])
    check(spark, fn.project_title, [("o/my-cool_repo/", "My Cool Repo"), ("", "Project"), ("x", "X")])
    check(spark, fn.module_name, [("a/b/__init__.py", "a.b"), ("a/b.py", "a.b"), ("a/b.pyw", "a.b.pyw")])
    check(spark, fn.ignore_pattern, [("/a/b.py", "*/a/b.py")])
    check(spark, fn.toctree_entry, [("docs/project/x.rst", "project/x"), ("notes/x.rst", "notes/x"), ("docs/a.md", "a.md")])
    check(spark, fn.is_preserved_artifact, [("a.csv", True), ("a.log", False), ("a.json.bak", False)])
    check(spark, fn.is_log_artifact, [("a.txt", True), ("a.log", True), ("a.csv", False)])


def test_lines_and_text(spark):
    check(spark, lambda c: F.array_join(fn.lines_of(c), "|"), [
        ("a\nb\n", "a|b"), ("a\r\nb\rc", "a|b|c"), ("\n", ""), ("a\n\n", "a|"), ("a b\x0cc", "a|b|c"), ("a\r\n", "a"),
    ])
    check(spark, lambda c: F.size(fn.lines_of(c)), [("", 0), ("\n", 1), ("a\n\n", 2), ("x", 1)])
    check(spark, fn.nonblank_line_count, [("a\n \n\tb\n", 2), ("", 0), ("\n\n", 0)])
    check(spark, fn.indent_width, [("    a", 4), ("\ta", 1), ("", 0), ("  ", 2)])
    check(spark, lambda c: fn.bounded_text(c, 2), [("abc", "ab"), ("a", "a")])
    check(spark, lambda c: fn.truncated(c, 2), [("abc", True), ("ab", False)])
    check(spark, lambda c: fn.preview(F.split(c, ",")), [
        ("a,b", "a, b"), ("1,2,3,4,5,6,7,8", "1, 2, 3, 4, 5, 6, 7, 8"), ("1,2,3,4,5,6,7,8,9", "1, 2, 3, 4, 5, 6, 7, 8, ..."),
    ])
    check(spark, fn.generated_marker, [(None, False), ("x", False), ("y .. GENERATED ARCHITECTURE DRAFT (z)", True)])


def test_values(spark):
    check(spark, fn.confidence_bucket, [(0, "low"), (1, "low"), (2, "medium"), (4, "medium"), (5, "high")], "int")
    check(spark, fn.clamp, [(-1.0, 0.0), (50.0, 50.0), (101.0, 100.0), (None, None)], "double")
    check(spark, fn.lenient_int, [("7", 7), (" 8 ", 8), ("x", 0), (None, 0), ("", 0)])
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    later = F.lit(start + datetime.timedelta(seconds=5))
    check(spark, lambda c: fn.duration_seconds(c, later), [(start, 5.0), (None, 0.0)], "timestamp")
    check(spark, lambda c: F.array_join(fn.safe_array(c, "string", "suggestions"), ","), [
        ('{"suggestions":["a","b"]}', "a,b"), ("nope", ""), (None, ""), ('{"x":1}', ""),
    ])
    check(spark, lambda c: F.array_join(fn.safe_array(c, "string"), ","), [('["a"]', "a"), ("x", "")])


def test_build_logs(spark):
    check(spark, fn.failure_summary, [
        ("Extension error (autoapi.extension)!\nAttributeError: 'NoneType' has no name", "AutoAPI extension failure: 'NoneType' has no name"),
        ("some preamble\nAttributeError: boom", "AutoAPI failure: boom"),
        ("[AutoAPI] Reading files... [ 10%]\n[AutoAPI] Reading files... [ 20%]\n actual failure line", "actual failure line"),
        ("[AutoAPI] Reading files... [ 10%]", "[AutoAPI] Reading files... [ 10%]"),
        ("", "AutoAPI build failure"), ("   ", "AutoAPI build failure"), (None, "AutoAPI build failure"),
        ("x" * 300, "x" * 240),
    ])
    check(spark, lambda c: F.array_join(navigation.failing_modules(c), ","), [
        ("autoapi.extension: error loading module 'widgets.core'", "widgets.core"),
        ("failed to import autoapi/widgets/core/index.rst", "widgets.core"),
        ("[AutoAPI] Reading files... [ 10%] autoapi_include/w/a.py\n[AutoAPI] Reading files... [ 42%] autoapi_include/widgets/broken.py", "widgets.broken"),
        ("module 'a.b' failed\nmodule 'a.b' failed again\nmodule 'c.d' failed", "a.b,c.d"),
        ("everything is fine", ""), (None, ""),
    ])
    check(spark, navigation.log_issue_summary, [
        ("Found 1 error.\na.py:1:1: E402 x\nb.py:2: E402 y", "a.py:1:1: E402 x (2 E402 issue(s) in analyzed project)"),
        (" \n", "unknown Ruff error"), ("no colon", "no colon"),
    ])


@pytest.mark.parametrize("is_valid", [None, False])
def test_inclusion(spark, is_valid):
    valid = None if is_valid is None else F.lit(is_valid)
    body = "def build():\n    return 1\n\n\ndef teardown():\n    return None\n"
    rows = [
        ("widgets.py", body, "included"),
        ("app/tests/test_widgets.py", body, r"path-pattern:(^|/)tests?/"),
        ("a/urls_v2.py", body, r"path-pattern:(^|/)urls(_v\d+)?\.py$"),
        ("reexport.py", "from other_module import *\n\n\ndef build():\n    return 1\n", "import-star"),
        ("stub.py", "x = 1\n", "low-content"),
        ("constants.py", "FOO = 1\nBAR = 2\nBAZ = 3\nQUX = 4\n", "non-meaningful-module"),
    ]
    df = spark.createDataFrame(rows, "path string, content string, expected string")
    out = df.select("expected", classify.inclusion_reason(F.col("path"), F.col("content"), is_valid=valid).alias("r"))
    for row in out.collect():
        risky = row.expected.startswith("path-pattern")
        assert row.r == (row.expected if is_valid is None or risky else "syntax-error")


def test_row_quality(spark):
    base = ("n", "github", "https://github.com/o/r", "main", "src", "docs/project/architecture.rst", 0.5, 4)
    def row(**changes):
        names = ("name", "provider", "repo_url", "branch", "folders", "output_path", "threshold", "min_lines")
        return tuple(changes.get(name, value) for name, value in zip(names, base))
    cases = [
        (row(), ""),
        (row(repo_url="o/r"), ""),
        (row(name=" "), "name_missing"),
        (row(provider="svn"), "provider_unknown,host_not_allowed"),
        (row(repo_url=""), "url_missing"),
        (row(repo_url="http://github.com/o/r"), "url_not_https"),
        (row(repo_url="https://u:p@github.com/o/r"), "url_has_credentials"),
        (row(repo_url="https://evil.example/o/r"), "host_not_allowed"),
        (row(repo_url="https://github.com/o"), "repo_path_malformed"),
        (row(repo_url="o/-r"), "repo_path_malformed"),
        (row(provider="gitlab", repo_url="https://gitlab.com/o/-r"), ""),
        (row(branch=""), "branch_missing"),
        (row(folders="a/../b"), "folder_leaves_root"),
        (row(threshold=1.1), "threshold_out_of_range"),
        (row(min_lines=-1), "min_lines_negative"),
        (row(output_path=""), "output_path_unsafe"),
        (row(output_path="../outside.rst"), "output_path_unsafe,output_path_outside_docs"),
        (row(output_path="docs/../../outside.rst"), "output_path_unsafe"),
        (row(output_path="notes/a.rst"), "output_path_outside_docs"),
    ]
    schema = (
        "name string, provider string, repo_url string, branch string, folders string, output_path string, "
        "threshold double, min_lines int, expected string"
    )
    df = spark.createDataFrame([(*values, expected) for values, expected in cases], schema)
    got = df.select("expected", F.array_join(classify.quality_violations(*map(F.col, df.columns[:-1])), ",").alias("v"))
    for item in got.collect():
        assert item.v == item.expected
