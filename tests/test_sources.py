import json
import random

from pyspark.sql import functions as F

from corpuslens.session import written
from corpuslens.sources import corpus, reports


def test_corpus_scan_sees_every_file(spark, tmp_path):
    root = tmp_path / "clones"
    files = {
        "r1/a.py": b"x = 1\n", "r1/sub dir/b+c.py": "é\n".encode(), "r2/bad.py": b"\xff\xfe", "r2/empty.py": b"", "r1/.gitignore": b"*.log",
        "r1/.env": b"A=1", "r1/pkg/__init__.py": b"", "r1/_private/x.py": b"y", "r1/.github/a.py": b"z", "r1/a%41.py": b"1", "r1/100%.py": b"2",
        f"r3{root}/b.py": b"root again",
    }
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    scanned = corpus.scan_corpus(spark, f"{root}/")
    rows = {f"{r.repo}/{r.path}": (r.name, r.content) for r in scanned.collect()}
    assert rows == {p: (p.rsplit("/", 1)[-1], None if p == "r2/bad.py" else c.decode()) for p, c in files.items()}
    assert corpus.scan_corpus(spark, str(root), folders=["r2"], name_glob="b*").count() == 1
    assert scanned.filter("branch = 'main' AND type = 'file'").count() == len(files)
    listing = spark.createDataFrame([("r1", "a.py"), ("r2", "gone.py")], "repo string, path string")
    assert {(r.path, r.content) for r in corpus.with_listing(scanned, listing).collect()} == {("a.py", "x = 1\n"), ("gone.py", None)}
    assert corpus.scan_corpus(spark, str(tmp_path / "none")).collect() == []


def test_long_files_come_in_numbered_chunks(spark, tmp_path):
    rng = random.Random(1)
    texts = {
        "lines": "".join("é日x"[i % 3] * rng.randrange(9) + "\n" for i in range(400)), "one": "日é\U0001f600" * 300, "short": "a\nb", "even": "x" * 64,
    }
    (tmp_path / "r").mkdir()
    for name, text in texts.items():
        (tmp_path / "r" / name).write_bytes(text.encode())
    (tmp_path / "r" / "bad").write_bytes(b"x" * 300 + b"\xff" + b"y" * 300)
    for size in (1, 64, 1000):
        rows = corpus.scan_corpus(spark, str(tmp_path), chunk_bytes=size).orderBy("path", "chunk").collect()
        for name, text in texts.items():
            chunks = [r for r in rows if r.path == name]
            assert "".join(r.content for r in chunks) == text and [r.chunk for r in chunks] == list(range(len(chunks)))
            assert all(len(r.content.encode()) <= max(size, 8) for r in chunks)
        assert [(r.content, r.chunk) for r in rows if r.path == "bad"] == [(None, 0)]


def test_a_wide_tree_is_listed_by_many_tasks(spark, tmp_path):
    """One provider holds everything; its folders are listed apart, and files read apart, though their rows are few bytes."""
    for i in range(12):
        folder = tmp_path / "github" / f"repo{i}" / "run"
        folder.mkdir(parents=True)
        for j in range(5):
            (folder / f"{j}.txt").write_text("x")
    listed = corpus.list_files(spark, str(tmp_path), name_glob="[1-3].t?t")
    assert listed.count() == 36
    assert len(listed.select(F.input_file_name()).distinct().collect()) > 3
    assert corpus.scan_corpus(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1


def test_listing_reads_no_bytes(spark, tmp_path):
    run = tmp_path / "github" / "o__r" / "app_1"
    run.mkdir(parents=True)
    (run / "a.csv").write_text("12345")
    (run / "_SUCCESS").write_text("")
    df = corpus.run_artifacts(spark, str(tmp_path))
    got = {(r.provider, r.repo_key, r.run_id, r.artifact, r.length) for r in df.collect()}
    assert got == {("github", "o__r", "app_1", "a.csv", 5), ("github", "o__r", "app_1", "_SUCCESS", 0)}


def test_analysis_csv(spark, tmp_path):
    row = ("a.py", 'x/"a", b.py', "Module: a\nb", "module", True, "python", 1)
    df = spark.createDataFrame([row], "file_name string, file_path string, function_name string, block_type string, missing_docstring boolean, language string, line_number int")
    reports.write_analysis_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in reports.read_analysis_csv(spark, str(tmp_path / "csv")).collect()] == [row]


def test_one_csv_with_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    parts = ["\n", '"', ",", "é", "x", "\r\n", " ", '""', "\n\n", "日本"]
    rows = [
        (f"f{i}", rng.choice([None, "", "a,b"]), "".join(rng.choices(parts, k=rng.randrange(12))) + "." * rng.choice([0, 0, 400]) + "e",
         "function", rng.random() < 0.5, rng.choice(["python", None]), rng.choice([None, i]))
        for i in range(300)
    ]
    schema = "file_name string, file_path string, function_name string, block_type string, missing_docstring boolean, language string, line_number int"
    folder = str(tmp_path / "csv")
    reports.write_analysis_csv(spark.createDataFrame(rows, schema).coalesce(1), folder)
    whole = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(folder)
    expected = sorted(map(str, whole.collect()))
    assert len(expected) == len(rows)
    for size in (333, 5_000, 10**9):
        got = reports.read_analysis_csv(spark, folder, split_bytes=size)
        assert sorted(map(str, got.collect())) == expected, size
    parts = reports.read_analysis_csv(spark, folder, split_bytes=5_000)
    assert parts.select(F.spark_partition_id()).distinct().count() > 1

    (tmp_path / "crlf.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,\r\n3,"last"')
    got = reports.read_quoted_csv(spark, str(tmp_path / "crlf.csv"), "a int, b string", 3)
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, "x\r\ny"), (2, None), (3, "last")]
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(b"a,b\n")
    assert reports.read_quoted_csv(spark, str(tmp_path / "[eh]*.csv"), "a int, b string").collect() == []


def test_suggestion_documents(spark, tmp_path):
    for run, branch, line in (("app_1", "main", "7"), ("app_2", "main", None), ("app_3", "dev", "x")):
        folder = tmp_path / run
        folder.mkdir()
        suggestion = {"file_path": "a.py", "function_name": "f", "block_type": "function", "line_number": line, "generated_docstring": "d"}
        document = {"provider": "github", "repo_path": "o/r", "branch": branch, "suggestions": [suggestion]}
        (folder / "suggested.json").write_text(json.dumps(document, indent=2))
    df = reports.read_suggestions(spark, str(tmp_path / "app_*"), "o/r", "main", multi_line=True)
    assert sorted((r.run_id, r.pos, r.line_number, r.language) for r in df.collect()) == [("app_1", 0, 7, ""), ("app_2", 0, 0, "")]

    many = spark.range(95).selectExpr(
        "'o/r' AS repo_path", "'main' AS branch", "'f' || id AS file_path", "'n' AS file_name", "'g' AS function_name",
        "'function' AS block_type", "CAST(id AS INT) AS line_number", "'python' AS language", "'d' AS generated_docstring",
        "94 - id AS pos",
    )
    reports.write_suggestions(many, str(tmp_path / "out" / "app_9"), "GitHub", per_document=20)
    assert spark.read.json(str(tmp_path / "out" / "app_9")).count() > 1
    back = reports.read_suggestions(spark, str(tmp_path / "out" / "app_9")).orderBy("pos").collect()
    assert [r.file_path for r in back] == [f"f{i}" for i in range(94, -1, -1)]


def test_run_output_prunes_partitions(spark, tmp_path):
    base = str(tmp_path / "runs")
    corpus.write_run_output(spark.range(3), base, "", F.lit(""), "app_1")
    corpus.write_run_output(spark.range(2).withColumn("extra", F.lit(1)), base, "GitHub", F.lit("/o/r/"), "app_2")
    both = corpus.read_run_output(spark, base)
    assert both.count() == 5 and both.filter("extra IS NULL").count() == 3
    one = corpus.read_run_output(spark, base, repo_key="o__r")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(repo_key" in one._jdf.queryExecution().executedPlan().toString()
    assert written(one, "copy").count() == 2
