import textwrap

import pytest
from pyspark.sql import functions as F

from corpuslens import functions as fn
from corpuslens.operators import segment


def analysed(spark, name, text):
    text = textwrap.dedent(text).strip("\n")
    files = spark.createDataFrame([("r", name, name, text)], "repo string, path string, name string, content string")
    files = files.withColumn("language", fn.supported_language(F.col("name")))
    blocks = segment.analyse_blocks(segment.code_blocks(files)).orderBy("start_line")
    return blocks.collect()


def spans(rows):
    return [(r.function_name, r.start_line, r.end_line) for r in rows]


def test_python_function_class_and_method(spark):
    rows = analysed(spark, "a.py", '''
        def first():
            """Doc."""
            return 1

        class Sample:
            def method(self):
                return 2
        x = 1
    ''')
    assert spans(rows) == [("first", 1, 4), ("Sample", 5, 7), ("method", 6, 7)]
    assert [r.block_type for r in rows] == ["function", "class", "function"]
    assert [r.missing_docstring for r in rows] == [False, True, True]
    assert rows[0].docstring == "Doc."


def test_python_signature_over_several_lines(spark):
    rows = analysed(spark, "a.py", """
        def foo(
            a,
            b=1,
        ) -> int:
            # note
            'the doc'
            return a

        async def bar(): return 1
        def baz():  # trailing
            return "no doc"
    """)
    assert spans(rows) == [("foo", 1, 8), ("bar", 9, 9), ("baz", 10, 11)]
    assert [r.block_type for r in rows] == ["function", "async_function", "function"]
    assert [r.docstring for r in rows] == ["the doc", None, None]
    assert "b=1" in rows[0].code


def test_python_signature_that_never_ends(spark):
    assert analysed(spark, "a.py", "def foo(a") == []


@pytest.mark.parametrize("name", ["a.m", "a.jl"])
def test_keyword_nesting(spark, name):
    header = "function y = foo(x)" if name == "a.m" else "function foo(x)"
    rows = analysed(spark, name, f"""
        {header}
        if x > 0
            y = 1;
        end
        end
        z = 2
    """)
    assert spans(rows) == [("foo", 1, 5)]
    assert sum(line.strip() == "end" for line in rows[0].code.splitlines()) == 2


def test_matlab_class_keeps_its_methods(spark):
    rows = analysed(spark, "a.m", """
        classdef Sample
          properties
            value
          end
          methods
            function r = twice(obj)
              % Doubles it.
              % Really.
              r = 2;
            end
          end
        end
    """)
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 12), (6, 10)]
    assert rows[1].function_name == "twice" and rows[1].docstring == "Doubles it."


def test_braces(spark):
    rows = analysed(spark, "a.js", """
        function greet(name)
        {
          if (name) { return name; }
          function inner() { return 1; }
          return "x";
        }
        /** Adds. */
        function add(a, b) { return a + b; }
        /**
         * Long.
         */
        export default class Thing {
          run() {
            // http://example.org is no comment start inside
            return 1;
          }
        }
        function bar(x)
    """)
    assert spans(rows) == [("greet", 1, 6), ("add", 8, 8), ("Thing", 12, 17)]
    assert [r.missing_docstring for r in rows] == [True, False, False]
    assert rows[1].docstring == "Adds."
    assert rows[2].block_type == "class"


def test_url_is_no_comment(spark):
    rows = analysed(spark, "a.ts", """
        function get() {
          return "https://example.org";
        }
    """)
    assert rows[0].missing_docstring


def test_julia_documentation_above(spark):
    rows = analysed(spark, "a.jl", '''
        """
            add_one(value)

        Add one to value.
        """
        function add_one(value)
            return value + 1
        end
        """ Short. """
        mutable struct P
            x
        end
    ''')
    assert spans(rows) == [("add_one", 6, 8), ("P", 10, 12)]
    assert "Add one to value." in rows[0].docstring
    assert rows[1].docstring == "Short."
    assert [r.block_type for r in rows] == ["function", "class"]


@pytest.mark.parametrize(
    "name, content, expected",
    [
        ("a.py", "# c\n\n'''Top.'''\nx = 1\n", "Top."),
        ("a.py", "x = 1\n'''Not top.'''\n", None),
        ("a.py", "", None),
        ("a.js", "/**\n * One.\n * Two.\n */\nvar x;\n", "One.\nTwo."),
        ("a.m", "% One\n\n%Two\nx = 1;\n% no\n", "One\nTwo"),
        ("a.m", "% only\n", "only"),
        ("a.jl", '"""Top."""\nx = 1\n', "Top."),
        ("a.jl", "x = 1\n", None),
    ],
)
def test_module_rows(spark, name, content, expected):
    files = spark.createDataFrame(
        [("r", name, name, content)], "repo string, path string, name string, content string"
    ).withColumn("language", fn.supported_language(F.col("name")))
    rows = segment.block_analysis(files).collect()
    if content == "":
        assert rows == []
        return
    (row,) = rows
    assert (row.function_name, row.block_type, row.docstring) == (f"Module: {name}", "module", expected)
    assert row.missing_docstring == (expected is None)


def test_blueprint(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "python", "class A:\n    def f(self):\n        pass\n")],
        "repo string, path string, language string, content string",
    )
    (row,) = segment.blueprint(files).collect()
    assert row.signatures == ["class A:", "def f(self):"]


def test_many_blocks_in_linear_time(spark):
    import time

    sources = {
        "a.py": lambda n: "\n".join(f"def f{i}():\n    pass" for i in range(n)),
        "a.js": lambda n: "\n".join(f"function f{i}() {{\n}}" for i in range(n)),
        "a.m": lambda n: "classdef C\n" + "\n".join(f"function f{i}(x)\nend" for i in range(n)) + "\nend",
        "deep.py": lambda n: "\n".join(" " * i + f"def f{i}():" for i in range(n // 100)),
    }
    took = {}
    for n in (2_000, 16_000):
        rows = [("r", name, name, make(n)) for name, make in sources.items()]
        files = spark.createDataFrame(rows, "repo string, path string, name string, content string").withColumn("language", fn.supported_language(F.col("name")))
        started = time.time()
        counts = {r.path: r["count"] for r in segment.block_spans(files).groupBy("path").count().collect()}
        took[n] = time.time() - started
        assert counts == {"a.py": n, "a.js": n, "a.m": n + 1, "deep.py": n // 100}
    assert took[16_000] < 20


def test_events_across_chunks(spark, monkeypatch):
    text = "class A:\n" + "".join(f"    def m{i}(\n        self,\n    ):\n        # c\n        return {i}\n\n" for i in range(40)) + "x = 1"
    files = spark.createDataFrame([("r", "a.py", "python", text)], "repo string, path string, language string, content string")
    want = sorted(map(tuple, segment.block_spans(files).collect()))
    assert len(want) == 41 and want[0][5:8] == (1, 241, 2)
    for size in (1, 7):
        monkeypatch.setattr(segment, "CHUNK", size)
        assert sorted(map(tuple, segment.block_spans(files).collect())) == want


def test_names_have_letters_of_every_script(spark):
    sources = [("a.py", "def größe(x):\n    return x\n", "python", "größe"), ("b.jl", "function α(x)\n    x\nend\n", "julia", "α"), ("c.js", "function été(a) {\n}\n", "javascript", "été")]
    files = spark.createDataFrame([("r", p, p, lang, text) for p, text, lang, _ in sources], "repo string, path string, name string, language string, content string")
    found = {r.path: r.function_name for r in segment.block_analysis(files).collect()}
    assert found == {p: name for p, _, _, name in sources}


def test_blank_lines_are_passed_in_linear_time(spark):
    import time

    from corpuslens import fixed_values as fixed

    texts = spark.createDataFrame([("\n" * 100_000 + "import os",), ("\n" * 100_000 + '"""doc"""',), (" " * 100_000,)], "content string")
    started = time.time()
    names = texts.select(F.regexp_extract_all("content", F.lit(fixed.IMPORT_PATTERN), F.lit(1)).alias("m")).collect()
    assert [r.m for r in names] == [["os"], [], []]
    assert time.time() - started < 30
