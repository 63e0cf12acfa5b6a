"""Analysis CSV (SR2) and suggestion documents (SR3, SR4)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuslens import functions as fn
from corpuslens.schemas import BLOCK_ANALYSIS, SUGGESTION, SUGGESTION_DOCUMENT, ddl
from corpuslens.sources import corpus
from corpuslens.sources.corpus import MOST_TASKS, _system

FIELDS = list(SUGGESTION)
#: Bytes of a CSV file that one task reads at once, and steps in which the end of its last record is looked for.
SPLIT_BYTES, TAIL_BYTES = 16_000_000, 1_000_000
#: Records in one Arrow batch.
RECORDS = 4096


def write_analysis_csv(analysis: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SR2: the seven columns, with a header; written by every task on its own."""
    columns = [F.col(name).cast(kind).alias(name) for name, kind in BLOCK_ANALYSIS.items()]
    analysis.select(*columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_analysis_csv(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """SR2 with its declared schema."""
    return read_quoted_csv(spark, path, ddl(BLOCK_ANALYSIS), split_bytes)


def read_quoted_csv(spark: SparkSession, path: str, schema: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """CSV files with a header line and line breaks within quotes, each read by as many tasks as it has ranges of ``split_bytes``.

    A line break ends a record if the number of quotes before it is even. One pass counts the quotes of each range; sums over the earlier
    ranges of a file tell a task whether its range begins within quotes. A range has the records that follow the line breaks in it, and
    reads on to the end of the last one. Quotes within quoted values are doubled; a value with quotes is quoted; files are not compressed.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "length", start.alias("start")).select(
        "path", "start", F.least(F.col("start") + split_bytes, "length").alias("end")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(name, low) as f:
                    found.append(f.read(high - low).count(b'"'))
            arrays = [*batch.columns, pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "quotes"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, low, high, inside in zip(*(c.to_pylist() for c in batch.columns)):
                for records in _records(name, low, high, inside):
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    # A number of its own: the rows are small whatever the bytes they stand for, and adaptive execution would put them together.
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    counted = ranges.repartition(tasks, "path", "start").mapInArrow(count, "path string, start long, end long, quotes long")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    placed = counted.select("path", "start", "end", inside.alias("inside")).repartition(tasks, "path", "start")
    records = placed.mapInArrow(read, "record binary").select(F.col("record").cast("string").alias("record"))
    parsed = F.from_csv("record", schema, {"escape": '"', "multiLine": "true"})
    return records.select(parsed.alias("_row")).select("_row.*")


def _opened(name: str, at: int):
    system, path = _system(name)
    f = system.open_input_file(path)
    f.seek(at)
    return f


def _records(name: str, low: int, high: int, inside: bool) -> Iterator[list[bytes]]:
    """The records that follow the line breaks in [low, high), in lists."""
    with _opened(name, low) as f:
        data = f.read(high - low)
        breaks, inside = _breaks(data, inside)
        if not len(breaks):
            return
        # The last record ends at the first line break of the bytes behind, or with the file.
        tail, ends = [], []
        while not len(ends) and (more := f.read(TAIL_BYTES)):
            ends, inside = _breaks(more, inside)
            tail.append(more[: ends[0]] if len(ends) else more)
    bounds = breaks.tolist()
    for i in range(0, len(bounds) - 1, RECORDS):
        some = bounds[i : i + RECORDS + 1]
        yield [r for a, b in zip(some, some[1:]) if (r := data[a + 1 : b].removesuffix(b"\r"))]
    if last := (data[bounds[-1] + 1 :] + b"".join(tail)).removesuffix(b"\r"):
        yield [last]


def _breaks(data: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """Places of the line breaks outside quotes, and whether the data ends within quotes."""
    letters = np.frombuffer(data, np.uint8)
    # Sums of one byte wrap around, which keeps their parity.
    odd = np.cumsum(letters == 0x22, dtype=np.uint8) & 1
    if inside:
        odd ^= 1
    return np.flatnonzero((letters == 0x0A) & (odd == 0)), bool(odd[-1]) if len(odd) else inside


def write_suggestions(
    suggestions: DataFrame, path: str, provider: str, per_document: int = 10_000, position: str = "pos",
    mode: str = "overwrite",
) -> None:
    """SR4: suggestion documents per (repo_path, branch), one JSON document per line.

    A document holds the suggestions of ``per_document`` consecutive list positions and says where it starts, so no
    document grows with the largest repository, and readers see one list in its order.
    """
    document = F.floor(F.col(position) / F.lit(per_document)).alias("_document")
    documents = suggestions.groupBy("repo_path", "branch", document).agg(
        F.array_sort(F.collect_list(F.struct(position, *FIELDS))).alias("_items")
    )
    plain = F.transform("_items", lambda item: F.struct(*[item[name].alias(name) for name in FIELDS]))
    documents.select(
        F.lit(provider.lower()).alias("provider"), "repo_path", "branch",
        (F.col("_document") * per_document).alias("first_position"), plain.alias("suggestions"),
    ).write.mode(mode).json(path)


def read_suggestions(
    spark: SparkSession, paths: str | list[str], repo_path: str | None = None, branch: str | None = None,
    run_pattern: str = r"(app_[^/]+)/", multi_line: bool = False,
) -> DataFrame:
    """SR3: suggestions of all runs as rows with run id and list position, filtered by repository and branch.

    A run may have several documents; one without ``first_position`` is a whole list.

    ``multi_line`` reads pretty-printed documents, one per file.
    """
    documents = spark.read.schema(SUGGESTION_DOCUMENT).option("multiLine", multi_line).json(paths)
    documents = documents.select("*", F.regexp_extract("_metadata.file_path", run_pattern, 1).alias("run_id"))
    if repo_path is not None:
        documents = documents.filter(F.col("repo_path") == repo_path)
    if branch is not None:
        documents = documents.filter(F.col("branch") == branch)
    rows = documents.select(
        "run_id", "provider", "repo_path", "branch", "first_position", F.posexplode("suggestions").alias("_i", "_s")
    ).withColumn("pos", F.coalesce("first_position", F.lit(0)) + F.col("_i"))
    line = fn.lenient_int(F.col("_s.line_number")).alias("line_number")
    return rows.select(
        "run_id", "provider", "repo_path", "branch", "pos",
        *[line if name == "line_number" else F.coalesce(F.col(f"_s.{name}"), F.lit("")).alias(name) for name in FIELDS],
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(corpus)
