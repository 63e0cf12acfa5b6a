"""ST4: incremental re-analysis: only items without a reusable result become work.

A suggestion index holds the newest usable suggestion of each exact and each fuzzy key, so a micro-batch of items reads one slim
row per key, whatever the history of runs. ``maintain_index`` keeps it up to date from a stream of suggestions: micro-batch b merges the
last complete version below b with its own rows into the folder ``v=<b>``. A version counts once its marker, the last file written, is
there; the newest such version is the current one. The merge keeps the greatest (run, first position) of a key, so the order of
micro-batches does not matter and a replayed one writes the same rows again.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.operators.reuse import SCOPE, newest_suggestion, reuse, reuse_from
from corpuslens.schemas import EXACT_KEY, FUZZY_KEY
from corpuslens.sources.corpus import _system

#: Tables of the index and the keys they hold one row for.
INDEX_KEYS = {"exact": [*SCOPE, *EXACT_KEY], "fuzzy": [*SCOPE, *FUZZY_KEY]}
MARKER = "COMPLETE"


def new_work(items: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Items no earlier suggestion answers."""
    return reuse(items, suggestions).filter("source IS NULL").drop("generated_docstring", "source")


def append_new_work(suggestions_path: str, work_path: str):
    """A ``foreachBatch`` function: J1/J2 against a whole suggestion table, misses to the work table.

    Every micro-batch ranks the table anew; with a history that grows, keep an index instead (``append_unanswered``). Each micro-batch writes
    its own folder and overwrites it when replayed, so a retry adds nothing twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        work = new_work(batch, spark.read.parquet(suggestions_path))
        work.write.mode("overwrite").parquet(f"{work_path}/batch_id={batch_id}")

    return handle


def index_versions(index_path: str) -> list[int]:
    """Numbers of the complete versions, ascending. Only folder names are listed."""
    system, top = _system(index_path.rstrip("/"))
    folders = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
    names = [f.base_name for f in folders if f.type == fs.FileType.Directory and f.base_name.startswith("v=")]
    marked = system.get_file_info([f"{top}/{name}/{MARKER}" for name in names])
    return sorted(int(name[2:]) for name, info in zip(names, marked) if info.type == fs.FileType.File)


def read_index(spark: SparkSession, index_path: str, version: int) -> dict[str, DataFrame]:
    """The tables of one complete version."""
    return {table: spark.read.parquet(f"{index_path.rstrip('/')}/v={version}/{table}") for table in INDEX_KEYS}


def maintain_index(index_path: str):
    """A ``foreachBatch`` function over suggestions: merges their newest usable rows into a new version of the index.

    Earlier versions stay for readers that hold them; delete those that no micro-batch of items can name any more.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        base = index_path.rstrip("/")
        below = [version for version in index_versions(base) if version < batch_id]
        earlier = read_index(spark, base, below[-1]) if below else {}
        for name, keys in INDEX_KEYS.items():
            rows = batch.select(*keys, "run_id", "pos", "generated_docstring")
            rows = rows.unionByName(earlier[name]) if below else rows
            newest_suggestion(rows, keys).write.mode("overwrite").parquet(f"{base}/v={batch_id}/{name}")
        system, top = _system(base)
        with system.open_output_stream(f"{top}/v={batch_id}/{MARKER}") as marker:
            marker.write(b"")

    return handle


def unanswered(items: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Items that the index does not answer.

    Index rows are filtered by the items' keys first. Read items from files, so that Spark knows their size: while they are small it
    broadcasts their keys and shuffles no index row that they do not meet.
    """
    found = {
        name: index[name].join(items.select(*keys).distinct(), keys, "left_semi") for name, keys in INDEX_KEYS.items()
    }
    work = reuse_from(items, found["exact"], found["fuzzy"])
    return work.filter("source IS NULL").drop("generated_docstring", "source")


def append_unanswered(index_path: str, work_path: str):
    """A ``foreachBatch`` function over items: those that the index does not answer go to the work table.

    The first attempt at a micro-batch pins the index version it reads; a replay reads the same one and overwrites the same folders, so
    it changes nothing even if the index has moved on. Without any version, all items are work.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        base = work_path.rstrip("/")
        version = _pinned_version(f"{base}/_index_versions/{batch_id}", index_path)
        batch.write.mode("overwrite").parquet(f"{base}/_items")
        items = spark.read.schema(batch.schema).parquet(f"{base}/_items")
        work = items if version is None else unanswered(items, read_index(spark, index_path, version))
        work.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")

    return handle


def _pinned_version(folder: str, index_path: str) -> int | None:
    """The index version of a micro-batch, chosen at its first attempt and kept as the name of an empty file in the folder."""
    system, top = _system(folder)
    pins = [f.base_name for f in system.get_file_info(fs.FileSelector(top, allow_not_found=True))]
    if not pins:
        pins = [str(version) for version in index_versions(index_path)[-1:]] or ["none"]
        system.create_dir(top)
        with system.open_output_stream(f"{top}/{pins[0]}") as pin:
            pin.write(b"")
    return None if pins[0] == "none" else int(pins[0])
