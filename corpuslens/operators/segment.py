"""Block segmentation inside the row of each file: no exchange, and one read of the content.

A file is one content cell, and its lines never leave the row. Each line is tested for what it can open, close, end or
document; lines that do nothing of it are dropped, and what is left of them are numbers. A fold over these
events carries a stack of open blocks, so its work is linear in the events times the depth of nesting, but for copies of the spans
found so far, which grow with the power 1.5 of the events (a file of 128,000 blocks takes seconds).

Python: a line closes the open headers whose indent is not smaller than its own. Others: a running depth of openers and
closers; a block ends where the depth falls back to that of its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import functions as fn
from corpuslens.operators.rows import pinned

FILE = ["repo", "path"]
KEYWORD_LANGUAGES = ("matlab", "julia")
BRACE_LANGUAGES = ("javascript", "typescript")

# Names may have letters of every script.
UNICODE = "(?U)"
# Header patterns per language.
HEADERS = {
    "python": r"^\s*(?:async\s+)?def\s+\w+\s*\(|^\s*class\s+\w+\s*(?:\(.*?\))?:",
    "javascript": (
        r"^\s*(?:export\s+)?(?:default\s+)?function\s+\w+\s*\(|^\s*(?:export\s+)?(?:default\s+)?class\s+\w+"
        r"|^\s*document\.\w+\s*\(|^\s*\w+\s*=\s*function\s*\("
    ),
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:function\s+\w+\s*\(|class\s+\w+)",
    "matlab": r"^\s*function\s+(?:.*=|\w+)|^\s*classdef\s+\w+",
    "julia": r"^\s*function\s+\w+\s*\(|^\s*(?:mutable\s+)?struct\s+\w+",
}
# Lines that open one level, and lines that close one, in keyword languages.
OPENERS = {
    "matlab": (
        r"^\s*(?:if|for|parfor|while|switch|try|function|classdef)\b"
        r"|^\s*(?:properties|methods|events|enumeration)\b\s*(?:\(.*\))?\s*$"
    ),
    "julia": (
        r"^\s*(?:function\b|if\b|for\b|while\b|try\b|let\b|do\b|begin\b|quote\b|module\s|macro\s"
        r"|(?:mutable\s+)?struct\b)"
    ),
}
CLOSER = r"^\s*end\b"
# Whitespace of every kind a line can hold.
SPACE = r"[\s\x1C-\x1F\x{85}\x{A0}]"
NONSPACE = r"[^\s\x1C-\x1F\x{85}\x{A0}]"

# Names, kinds and documentation inside a block, per language.
FUNCTION_NAME = {
    "javascript": r"(?:function\s+(\w+)\s*\()|(?:(?<![\w.])([\w.]+)\s*\.\s*(\w+)\s*\()",
    "typescript": r"(?:function\s+(\w+)\s*\()|(?:(?<![\w.])([\w.]+)\s*\.\s*(\w+)\s*\()",
    "matlab": r"function\s+(?:.*=\s*)?(\w+)\s*\(",
    "julia": r"function\s+(\w+)\s*\(",
}
CLASS_NAME = {
    "javascript": r"class\s+(\w+)\s*\{",
    "typescript": r"class\s+(\w+)\s*\{",
    "matlab": r"classdef\s+(\w+)",
    "julia": r"(?:mutable\s+)?struct\s+(\w+)",
}
DOCUMENTATION = {
    "javascript": (r"(?s)/\*\*(.*?)\*/", r"(?m)^[^\S\n]*+//\s*(.*?)$"),
    "typescript": (r"(?s)/\*\*(.*?)\*/", r"(?m)^[^\S\n]*+//\s*(.*?)$"),
    "matlab": (r"(?s)%\s+(.*?)(?=\n\s*(?:%|\w))", r"(?s)%\{(.*?)%\}"),
    "julia": (r'(?s)"""(.*?)"""',),
}
FIRST_STRING = r"""(?s)^\s*[rRuU]?(?:\"{3}(.*?)\"{3}|'{3}(.*?)'{3}|"([^"\n]*)"|'([^'\n]*)')"""


def _by_language(language: Column, table: dict[str, Column]) -> Column:
    chain = None
    for name, value in table.items():
        chain = F.when(language == name, value) if chain is None else chain.when(language == name, value)
    return chain


#: The least number of events in a chunk.
CHUNK = 64

_EVENT = (
    "struct<at:int,header:boolean,delta:int,indent:int,statement:boolean,ends:boolean,opens:boolean,classdef:boolean,"
    "doc_open:boolean,doc_close:boolean,doc_single:boolean>"
)
_BLOCK = "struct<start:int,level:int,line:int>"
_SPAN = "struct<start_line:int,end_line:int,body_line:int,code_line:int>"
#: What the fold carries: open blocks (line: the first statement in Python, else the first line of the code), a header that waits for
#: its signature's end or its brace, the running depth, the last lines of documentation, and the spans found.
_STATE = (
    f"struct<stack:array<{_BLOCK}>,waiting:{_BLOCK},open:{_BLOCK},depth:int,doc_open:int,doc_open_before:int,doc_close:int,"
    f"doc_single:int,found:array<{_SPAN}>>"
)


def _readable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("language").isNotNull() & (F.coalesce(F.col("content"), F.lit("")) != ""))


def _header(language: Column, line: Column) -> Column:
    """B1: whether a line starts a block in its language."""
    tests = {name: line.rlike(UNICODE + pattern) for name, pattern in HEADERS.items()}
    return F.coalesce(_by_language(language, tests), F.lit(False))


def blueprint(files: DataFrame) -> DataFrame:
    """Class and function signatures of every file that has some, in line order."""
    split = pinned(_readable(files), "_lines", fn.lines_of(F.col("content")))
    headers = F.filter("_lines", lambda line: _header(F.col("language"), line))
    found = split.select(*FILE, F.transform(headers, lambda line: fn.strip(line)).alias("signatures"))
    return found.select(*FILE, F.size("signatures").alias("n_signatures"), "signatures").filter(F.col("n_signatures") > 0)


def _event(language: Column, line: Column, number: Column) -> Column:
    """What one line opens, closes, ends or documents. Every test runs for its own languages only."""
    is_python, is_julia = language == "python", language == "julia"
    is_brace, is_keyword = language.isin(*BRACE_LANGUAGES), language.isin(*KEYWORD_LANGUAGES)

    def flag(where: Column, test: Column) -> Column:
        return F.coalesce(F.when(where, test), F.lit(False))

    openers = {name: line.rlike(UNICODE + pattern) for name, pattern in OPENERS.items()}
    keyword_delta = F.when(F.coalesce(_by_language(language, openers), F.lit(False)), 1).when(line.rlike(CLOSER), -1).otherwise(0)
    opens = F.regexp_count(line, F.lit(r"\{"))
    brace_delta = opens - F.regexp_count(line, F.lit(r"\}"))
    ends = fn.rstrip(F.regexp_replace(line, r"\s#.*$", "")).endswith(":")
    whole = line.rlike(r"^\s*class\b") | line.rlike(UNICODE + r"^\s*(?:async\s+)?def\s+\w+\s*\([^()]*\)\s*(?:->[^:]*)?:\s*[^\s#]")
    header = _header(language, line)
    doc_open = flag(is_julia, line.rlike(f'^{SPACE}*"""')) | flag(is_brace, line.rlike(rf"^{SPACE}*/\*\*"))
    end = fn.rstrip(line)
    doc_close = flag(is_julia, end.endswith('"""')) | flag(is_brace, end.endswith("*/"))
    doc_single = doc_open & doc_close & (is_brace | flag(is_julia, F.regexp_count(line, F.lit('"""')) == 2))
    return F.struct(
        number,
        header,
        F.when(is_keyword, keyword_delta).when(is_brace, brace_delta).otherwise(0),
        # A blank Python line has no indent and is no event.
        F.when(is_python & line.rlike(NONSPACE), fn.indent_width(line)),
        flag(is_python, ~line.rlike(f"^{SPACE}*#")),
        flag(is_python, ends | (header & whole)),
        flag(is_brace, opens > 0),
        flag(language == "matlab", line.rlike(r"^\s*classdef\b")),
        doc_open,
        doc_close,
        doc_single,
    ).cast(_EVENT)


def _matters(event: Column) -> Column:
    return (
        event["indent"].isNotNull() | event["header"] | (event["delta"] != 0) | event["opens"] | event["doc_open"] | event["doc_close"]
    )


def _block(start: Column, level: Column, line: Column) -> Column:
    return F.struct(start, level, line).cast(_BLOCK)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _several(kind: str, *values: Column) -> Column:
    return F.array(*values).cast(f"array<{kind}>")


def _python_step(state: Column, event: Column) -> Column:
    """B2: pop what the line's indent closes; a header whose signature goes on waits, and lines of its signature close nothing."""
    at, indent, waiting = event["at"], event["indent"], state["waiting"]
    continued = waiting.isNotNull()
    closed = F.filter(state["stack"], lambda b: ~continued & (b["level"] >= indent))
    rest = F.filter(state["stack"], lambda b: continued | (b["level"] < indent))
    # The first statement below a signature starts the body of the block that was opened last.
    body = F.when(~continued & event["statement"], at)
    rest = F.transform(rest, lambda b: _block(b["start"], b["level"], F.coalesce(b["line"], body)))
    opened = F.when(continued & event["ends"], waiting).when(
        ~continued & event["header"] & event["ends"], _block(at, indent, _none("int"))
    )
    stack = F.when(opened.isNotNull(), F.concat(rest, _several(_BLOCK, opened))).otherwise(rest)
    still = F.when(continued & ~event["ends"], waiting).when(
        ~continued & event["header"] & ~event["ends"], _block(at, indent, _none("int"))
    )
    spans = F.transform(closed, lambda b: F.struct(b["start"], at - 1, b["line"], b["start"]).cast(_SPAN))
    return F.struct(
        stack, still, state["open"], state["depth"], state["doc_open"], state["doc_open_before"], state["doc_close"],
        state["doc_single"], F.concat(state["found"], spans),
    )


def _depth_step(state: Column, event: Column, is_brace: Column) -> Column:
    """Follow the depth; ``open`` is the outermost block, ``stack`` holds classdefs, whose methods are blocks, too."""
    at, before = event["at"], state["depth"]
    after = before + event["delta"]
    falls = event["delta"] < 0
    ends_open = state["open"].isNotNull() & falls & (after <= state["open"]["level"])
    closed = F.filter(state["stack"], lambda b: falls & (after <= b["level"]))
    classes = F.filter(state["stack"], lambda b: ~(falls & (after <= b["level"])))
    # Documentation that ends on the line above belongs to the header.
    doc_above = F.when(state["doc_open"] <= at - 2, state["doc_open"]).otherwise(state["doc_open_before"])
    code = F.when(state["doc_single"] == at - 1, at - 1).when(state["doc_close"] == at - 1, F.coalesce(doc_above, at)).otherwise(at)
    fresh = F.when(event["header"] & state["open"].isNull(), _block(at, before, code))
    # A brace header waits for its brace; the next header, or a brace at a lower depth, ends the wait in vain.
    waits = F.when(is_brace, F.coalesce(fresh, state["waiting"]))
    braced = waits.isNotNull() & event["opens"] & (before >= waits["level"])
    at_once = braced & (after <= waits["level"])
    opened = F.when(~is_brace & ~event["classdef"], fresh).when(braced & ~at_once, waits)
    new_class = F.when(~is_brace & event["classdef"], fresh)
    spans = F.concat(
        F.transform(closed, lambda b: F.struct(b["start"], at, _none("int"), b["line"]).cast(_SPAN)),
        F.when(ends_open, _several(_SPAN, F.struct(state["open"]["start"], at, _none("int"), state["open"]["line"]))).otherwise(_several(_SPAN)),
        F.when(at_once, _several(_SPAN, F.struct(waits["start"], at, _none("int"), waits["line"]))).otherwise(_several(_SPAN)),
    )
    return F.struct(
        F.when(new_class.isNotNull(), F.concat(classes, _several(_BLOCK, new_class))).otherwise(classes),
        F.when(~event["opens"], waits),
        F.coalesce(F.when(~ends_open, state["open"]), opened),
        after,
        F.when(event["doc_open"], at).otherwise(state["doc_open"]),
        F.when(event["doc_open"], state["doc_open"]).otherwise(state["doc_open_before"]),
        F.when(event["doc_close"], at).otherwise(state["doc_close"]),
        F.when(event["doc_single"], at).otherwise(state["doc_single"]),
        F.concat(state["found"], spans),
    )


def _folded(step, n_lines: Column, body: bool) -> Column:
    """The spans of a file's events; what is still open reaches to the file's end.

    Spark copies a fold's state at every step. So events are folded in chunks of about the square root of their number, and the spans of
    finished chunks lie in the state of an outer fold, which is copied once a chunk. No later state is cast, as that would copy, too.
    """
    first = F.struct(_several(_BLOCK), _none(_BLOCK), _none(_BLOCK), F.lit(0), *[_none("int")] * 4, _several(_SPAN)).cast(_STATE)
    names = ("stack", "waiting", "open", "depth", "doc_open", "doc_open_before", "doc_close", "doc_single")

    def chunk(state: Column, events: Column) -> Column:
        def carried(last: Column) -> Column:
            carry = F.struct(*[last[n].alias(n) for n in names], _several(_SPAN).alias("found"))
            return F.struct(carry.alias("carry"), F.concat(state["kept"], F.array(last["found"])).alias("kept"))

        return F.aggregate(events, state["carry"], step, carried)

    def finished(state: Column) -> Column:
        carry = state["carry"]
        left = F.concat(carry["stack"], F.when(carry["open"].isNotNull(), F.array(carry["open"])).otherwise(_several(_BLOCK)))
        line = (lambda b: b["line"]) if body else (lambda b: _none("int"))
        code = (lambda b: b["start"]) if body else (lambda b: b["line"])
        rest = F.transform(left, lambda b: F.struct(b["start"], n_lines, line(b), code(b)).cast(_SPAN))
        return F.sort_array(F.concat(F.flatten(state["kept"]), rest))

    n = F.size("_events")
    size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(n)).cast("int"))
    chunks = F.when(
        n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda c: F.slice("_events", c * size + 1, size))
    ).otherwise(F.array().cast(f"array<array<{_EVENT}>>"))
    begin = F.struct(first.alias("carry"), F.array().cast(f"array<array<{_SPAN}>>").alias("kept"))
    return F.aggregate(chunks, begin, chunk, finished)


SPAN = ["block_number", "header_text", "start_line", "end_line", "body_line", "code_line"]


def with_spans(files: DataFrame) -> DataFrame:
    """Files that can be read, with their ``_lines`` and ``_spans``: every block in line order, as line numbers.

    Python blocks nest and are all kept. Of other languages the outermost blocks are kept, and MATLAB methods
    inside a classdef. A block that never ends reaches to the end of its file; a signature that never ends starts none.
    """
    language, n_lines = F.col("language"), F.size("_lines")
    is_python, is_brace = language == "python", language.isin(*BRACE_LANGUAGES)
    lines = pinned(_readable(files), "_lines", fn.lines_of(F.col("content")))
    events = F.filter(F.transform("_lines", lambda line, i: _event(language, line, i + 1)), _matters)
    marked = pinned(lines, "_events", events)
    spans = F.when(is_python, _folded(_python_step, n_lines, True)).otherwise(
        _folded(lambda state, event: _depth_step(state, event, is_brace), n_lines, False)
    )
    numbered = F.transform(
        "_found",
        lambda b, i: F.struct(
            (i + 1).alias("block_number"), F.element_at("_lines", b["start_line"]).alias("header_text"),
            b["start_line"], b["end_line"], b["body_line"], b["code_line"],
        ),
    )
    found = pinned(marked, "_found", spans).drop("_events")
    return pinned(found, "_spans", numbered).drop("_found")


def block_spans(files: DataFrame) -> DataFrame:
    """One row per block: line numbers, no text but the header."""
    exploded = with_spans(files).select(*FILE, "language", F.explode("_spans").alias("_b"))
    return exploded.select(*FILE, "language", "_b.*")


def _exploded_blocks(files: DataFrame, *more: str) -> DataFrame:
    """One row per span with its text, cut out of the file's lines; files without spans keep one row of nulls."""

    def text(first: Column, last: Column) -> Column:
        part = F.slice("_lines", first, F.greatest(last - first + 1, F.lit(0)))
        return F.array_join(F.transform(part, lambda line: fn.rstrip(line)), "\n")

    def block(span: Column) -> Column:
        end = span["end_line"]
        body = F.when(span["body_line"] <= end, text(span["body_line"], end))
        fields = [span[name].alias(name) for name in SPAN]
        return F.struct(*fields, text(span["code_line"], end).alias("code"), body.alias("body"))

    n_lines = F.size("_lines").alias("n_lines")
    exploded = files.select(*FILE, "language", n_lines, *more, F.explode_outer(F.transform("_spans", block)).alias("_b"))
    return exploded.select(*FILE, "language", "n_lines", *more, "_b.*")


def code_blocks(files: DataFrame) -> DataFrame:
    """D3: spans with their text; ``body`` starts at the first statement of a Python block."""
    return _exploded_blocks(with_spans(files)).filter(F.col("block_number").isNotNull())


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_string(text: Column) -> Column:
    """The string literal a text starts with, null if it starts with anything else."""
    return F.coalesce(*[_group(text, FIRST_STRING, group) for group in (1, 2, 3, 4)])


def analyse_blocks(blocks: DataFrame) -> DataFrame:
    """Name, kind, documentation and whether it is missing; function beats class."""
    language, code = F.col("language"), F.col("code")
    is_python = language == "python"

    def matched(table: dict[str, str]) -> Column:
        tests = {name: code.rlike(UNICODE + pattern) for name, pattern in table.items()}
        return F.coalesce(_by_language(language, tests), F.lit(False))

    function_name = _by_language(
        language,
        {
            name: F.coalesce(_group(code, UNICODE + pattern, 3), _group(code, UNICODE + pattern, 1))
            if name in BRACE_LANGUAGES
            else _group(code, UNICODE + pattern, 1)
            for name, pattern in FUNCTION_NAME.items()
        },
    )
    class_name = _by_language(language, {name: _group(code, UNICODE + pattern, 1) for name, pattern in CLASS_NAME.items()})
    documents = {
        name: F.coalesce(*[F.when(code.rlike(p), fn.strip(F.regexp_extract(code, p, 1))) for p in patterns])
        for name, patterns in DOCUMENTATION.items()
    }
    python_doc = F.nullif(fn.strip(first_string(F.col("body"))), F.lit(""))
    header = F.col("header_text")
    python_kind = (
        F.when(header.rlike(r"^\s*class\b"), "class")
        .when(header.rlike(r"^\s*async\b"), "async_function")
        .otherwise("function")
    )
    return blocks.withColumns(
        {
            "function_name": F.when(
                is_python, F.regexp_extract(header, UNICODE + r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1)
            ).otherwise(
                F.when(matched(FUNCTION_NAME), F.coalesce(function_name, F.lit("unknown"))).otherwise(
                    F.coalesce(class_name, F.lit("unknown"))
                )
            ),
            "block_type": F.when(is_python, python_kind)
            .when(matched(FUNCTION_NAME), "function")
            .when(matched(CLASS_NAME), "class")
            .otherwise("unknown"),
            "docstring": F.when(is_python, python_doc).otherwise(_by_language(language, documents)),
        }
    ).withColumn("missing_docstring", F.col("docstring").isNull())


def _from_line(position: Column) -> Column:
    start = F.when(position > 0, position)
    return F.array_join(F.slice(F.col("_head"), start, F.size("_head")), "\n")


def with_module_documentation(files: DataFrame, only: Column | None = None) -> DataFrame:
    """Documentation of a file as a whole, as column ``docstring``; null where ``only`` is false."""
    content, language = F.col("content"), F.col("language")
    only = F.lit(True) if only is None else only
    # Only the line-based languages need lines, and only around their first line of code.
    marker = F.when(language == "python", "#").otherwise("%")
    code = F.transform(
        "_head", lambda line: (fn.strip(line) != "") & ~F.startswith(fn.lstrip(line), marker)
    )
    lines = F.when(only & language.isin("python", "matlab"), fn.lines_of(content))
    staged = files.withColumn("_head", lines).withColumn("_code_at", F.array_position(code, True))
    python_doc = first_string(_from_line(F.col("_code_at")))
    leading = F.when(F.col("_code_at") > 0, F.slice("_head", F.lit(1), F.col("_code_at") - 1)).otherwise(
        F.col("_head")
    )
    comments = F.filter(F.transform(leading, lambda line: fn.strip(line)), lambda line: line.startswith("%"))
    matlab_doc = F.array_join(F.transform(comments, lambda line: fn.strip(F.substring(line, 2, 1 << 30))), "\n")
    script_doc = F.regexp_replace(
        F.regexp_extract(content, r"(?ms)^[^\S\n]*+/\*\*\s*\n(.*?)\n\s*\*/", 1), r"(?m)^\s*\*\s?", ""
    )
    julia_doc = F.regexp_extract(content, r'(?ms)^[^\S\n]*+"""(.*?)"""', 1)
    text = _by_language(
        language,
        {
            "python": python_doc,
            "javascript": script_doc,
            "typescript": script_doc,
            "matlab": matlab_doc,
            "julia": julia_doc,
        },
    )
    found = F.when(only, F.nullif(fn.strip(text), F.lit("")))
    return staged.withColumn("docstring", found).drop("_head", "_code_at")


def module_blocks(files: DataFrame) -> DataFrame:
    """One module row for every analysable file without blocks."""
    rest = with_spans(files).filter(F.size("_spans") == 0)
    out = with_module_documentation(rest).select(
        *FILE, "language",
        F.lit(1).alias("block_number"),
        F.lit(1).alias("start_line"),
        F.concat(F.lit("Module: "), F.col("name")).alias("function_name"),
        F.lit("module").alias("block_type"),
        "docstring",
    )
    return out.withColumn("missing_docstring", F.col("docstring").isNull())


def block_analysis(files: DataFrame) -> DataFrame:
    """Blocks, and module rows of files without any, of a files table with ``name`` and ``language``."""
    joined = with_module_documentation(with_spans(files), F.size("_spans") == 0)
    rows = _exploded_blocks(joined.withColumnRenamed("docstring", "_module"), "name", "_module")
    is_module = F.col("start_line").isNull()
    docstring = F.when(is_module, F.col("_module")).otherwise(F.col("docstring"))
    return analyse_blocks(rows).select(
        *FILE, "language",
        F.coalesce("block_number", F.lit(1)).alias("block_number"),
        F.coalesce("start_line", F.lit(1)).alias("start_line"),
        F.when(is_module, F.concat(F.lit("Module: "), F.col("name"))).otherwise(F.col("function_name")).alias("function_name"),
        F.when(is_module, "module").otherwise(F.col("block_type")).alias("block_type"),
        docstring.alias("docstring"),
        docstring.isNull().alias("missing_docstring"),
    )
