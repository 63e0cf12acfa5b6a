"""Reading a tree of files (SR1), its artifacts (SR8), and writing run-scoped output (SR7).

Trees are listed and read in tasks: Spark's own file sources leave out names that begin with ``_`` or ``.`` and files of no bytes, and
they encode paths. Names are kept as they are listed.
"""

from __future__ import annotations

import sys
from codecs import getincrementaldecoder
from collections.abc import Iterator
from fnmatch import translate
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens import functions as fn
from corpuslens.session import written

#: Bytes of content that a task holds at once, besides one chunk.
READ_BYTES = 8_000_000
#: A larger file is read as several chunks.
CHUNK_BYTES = 1 << 28
#: Bytes of files for one task, and the most tasks of one step.
TASK_BYTES, MOST_TASKS = 1 << 26, 50_000
#: Folders that one task lists, where there are many, and entries in one Arrow batch of a listing.
FOLDERS = 32
ENTRIES = 10_000


def _system(uri: str):
    """File system and path of a URI or path."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


def list_files(spark: SparkSession, root: str, name_glob: str | None = None, folders: list[str] | None = None) -> DataFrame:
    """SR1/SR8: path below the root, name and length of every file. File bytes are not read.

    Breadth first: each round lists the folders that the round before found, in many tasks, and writes what it
    finds; so a tree spreads over tasks wherever it is wide. With ``folders``, only those below the root are listed.
    """
    from pyarrow import fs

    base = root.rstrip("/")
    kinds = {"path": pa.string(), "is_folder": pa.bool_(), "length": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _system(base)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                entries = system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True))
                for i in range(0, len(entries), ENTRIES):
                    rows = [(e.path[len(top) + 1 :], e.type == fs.FileType.Directory, e.size or 0) for e in entries[i : i + ENTRIES]]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    frontier, found = spark.createDataFrame([(f,) for f in (folders if folders is not None else [""])], "path string"), None
    count = frontier.count()
    while count:
        tasks = max(-(-count // FOLDERS), min(count, spark.sparkContext.defaultParallelism))
        spread = frontier.repartition(min(tasks, MOST_TASKS))
        listed = written(spread.mapInArrow(run, "path string, is_folder boolean, length long"), "listing")
        frontier = listed.filter("is_folder").select("path")
        count = frontier.count()
        found = listed if found is None else found.unionByName(listed)
    if found is None:
        found = spark.createDataFrame([], "path string, is_folder boolean, length long")
    name = fn.file_name(F.col("path"))
    files = found.filter("NOT is_folder").select("path", name.alias("name"), "length")
    if name_glob is None:
        return files
    return files.filter(F.col("name").rlike("^" + translate(name_glob).removesuffix("\\Z") + "\\z"))


def scan_corpus(
    spark: SparkSession, root: str, branch: str = "main", folders: list[str] | None = None, name_glob: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """SR1: files below ``root/<repo>/`` with their text; text that is not UTF-8 is null, and a file of no bytes is empty.

    A file of more than ``chunk_bytes`` has several rows, numbered by ``chunk`` from 0; texts of chunks, put together, are its text. Chunks
    end between characters, behind a line break if there is one. Folders and the name pattern limit what is listed and read. Files
    are spread over tasks by their bytes.
    """
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _system(base)

        def rows(paths: list[str], chunks: list[int], texts: list[str | None]) -> pa.RecordBatch:
            arrays = [pa.array(paths, pa.string()), pa.array(chunks, pa.int32()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["full", "chunk", "content"])

        for batch in batches:
            paths, chunks, texts, held = [], [], [], 0
            for path in batch.column("path").to_pylist():
                for chunk, text in enumerate(_texts(system, f"{top}/{path}", chunk_bytes)):
                    paths.append(path)
                    chunks.append(chunk)
                    texts.append(text)
                    held += len(text or "")
                    if held > READ_BYTES:
                        yield rows(paths, chunks, texts)
                        paths, chunks, texts, held = [], [], [], 0
            yield rows(paths, chunks, texts)

    files = list_files(spark, base, name_glob, folders).filter(F.col("path").contains("/"))
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
    # A number of its own: the rows are small whatever the bytes they stand for, and adaptive execution would put them together.
    tasks = min(max(1, total["n"]), max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, total["size"] // TASK_BYTES)))
    return files.select("path").repartition(tasks, "path").mapInArrow(run, "full string, chunk int, content string").select(
        F.substring_index("full", "/", 1).alias("repo"),
        F.lit(branch).alias("branch"),
        F.regexp_replace("full", r"^[^/]*/", "").alias("path"),
        fn.file_name(F.col("full")).alias("name"),
        F.lit("file").alias("type"),
        "content",
        "chunk",
    )


def _texts(system, path: str, chunk_bytes: int) -> Iterator[str | None]:
    """A file's text in chunks; one null if any of it is not UTF-8."""
    with system.open_input_stream(path, compression=None) as f:
        data = f.read(chunk_bytes + 1)
        if len(data) <= chunk_bytes:
            yield _decoded(data)
            return
    decoder = getincrementaldecoder("utf-8")()
    with system.open_input_stream(path, compression=None) as f:  # a long file is read through once before its first chunk leaves
        try:
            while data := f.read(READ_BYTES):
                decoder.decode(data)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            yield None
            return
    with system.open_input_stream(path, compression=None) as f:
        rest = b""
        while more := f.read(max(4, chunk_bytes - len(rest))):
            data = rest + more
            cut = data.rfind(b"\n") + 1
            if cut <= len(data) // 2:  # a long line
                cut = _whole_characters(data)
            if cut:
                yield data[:cut].decode()
            rest = data[cut:]
        if rest:
            yield rest.decode()


def _decoded(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def _whole_characters(data: bytes) -> int:
    """Length of the data without a character that is cut off at its end."""
    for back in range(1, min(4, len(data)) + 1):
        byte = data[-back]
        if byte & 0xC0 != 0x80:
            need = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            return len(data) if need <= back else len(data) - back
    return len(data)


def with_listing(files: DataFrame, listing: DataFrame) -> DataFrame:
    """SR1: every listed (repo, path) with its content, null where nothing was read.

    A listing from the version control system may hold files that the tree lacks.
    """
    content = files.select("repo", "path", "content", *[c for c in ("chunk",) if c in files.columns])
    listed = listing.select("repo", "path", fn.file_name(F.col("path")).alias("name"))
    return listed.join(content, ["repo", "path"], "left")


def write_run_output(df: DataFrame, base: str, provider: str, repo_path: Column, run_id: str, mode: str = "append") -> None:
    """SR7: Parquet below provider, repository key and sortable run id."""
    keyed = df.withColumns(
        {"provider": F.lit(provider.strip().lower() or "unknown"), "repo_key": fn.repo_key(repo_path), "run_id": F.lit(run_id)}
    )
    keyed.write.mode(mode).partitionBy("provider", "repo_key", "run_id").parquet(base)


def read_run_output(spark: SparkSession, base: str, **scope: str) -> DataFrame:
    """SR7: run output; provider, repo_key and run_id prune partitions. Columns added by later runs are merged (SR6)."""
    df = spark.read.option("mergeSchema", "true").parquet(base)
    for column, value in scope.items():
        df = df.filter(F.col(column) == value)
    return df


def run_artifacts(spark: SparkSession, base: str) -> DataFrame:
    """SR8: run, artifact name and size below ``base/<provider>/<repo_key>/<run_id>/``; bytes are not read."""
    parts = F.split("path", "/")
    return (
        list_files(spark, base)
        .filter(F.size(parts) == 4)
        .select(
            parts[0].alias("provider"), parts[1].alias("repo_key"), parts[2].alias("run_id"),
            F.col("name").alias("artifact"), "length",
        )
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
