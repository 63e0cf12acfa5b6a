"""Benchmark decontamination: windows of normalised test words in a broadcast hash set, looked up in every document.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A window is ``n`` consecutive
words of a test item; a shorter item, if it has words, is one window. Document windows whose hash is in the set are verified word
by word. A word inside any verified window is hit.

Repeated rows of test items are dropped first. While the items' text is at most ``MOST_BYTES``, the set with its words is broadcast and
windows are verified where they are found. Beyond that only a bitmap of the hashes is broadcast, of 16 MB at most; documents are
still read once. The windows that pass it are known by the SHA-256 of their words from then on, which is joined with that of the test
windows, so neither the size of the benchmark nor that of one window matters. Results are the same.

A null text has no words; an item without words has no windows. Equal items under several ids all count. Repeated rows and null
ids of documents stay, one result each. Empty tables give no rows, or no hits. Documents without hits are untouched.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm.common import free_name, written

WINDOW = 10
#: Text of the test items in a broadcast set. Windows and their hashes take a small multiple of it.
MOST_BYTES = 4_000_000
#: Document bytes hashed at once; a longer document is hashed by itself, word by word and window by window.
BLOCK_BYTES = 250_000
#: Windows in one row of the joined scan.
CHUNK = 4096
SPANS = "array<struct<first:long,last:long,first_byte:long,last_byte:long>>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE, _MIX, _STEP = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Words:
    """Words of a UTF-8 text: lower-cased bytes, start and end of each word, and a hash of each."""

    def __init__(self, text: bytes) -> None:
        self.data = _LOWER[np.frombuffer(text, np.uint8)]
        inside = np.zeros(len(text) + 2, np.int8)
        inside[1:-1] = _LETTER[self.data]
        turns = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)

    def hashes(self) -> np.ndarray:
        """Polynomial hashes of the words, from sums that run over the letters."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):  # as many words as begin in a block; sums start anew in each
            low = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.starts, low + BLOCK_BYTES)))
            high = int(self.ends[to - 1])
            size = high - low
            power, inverse = _powers(size + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * power[:size])])
            a, b = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = (sums[b] - sums[a]) * inverse[a]
            at = to
        out ^= out >> np.uint64(29)
        out *= np.uint64(_MIX)
        return out ^ out >> np.uint64(32)

    def joined(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(first, first + n))

    def key(self, first: int, n: int) -> bytes:
        return hashlib.sha256(self.joined(first, n)).digest()


_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS[:] = [_cumulative(_BASE, size), _cumulative(pow(_BASE, -1, 2**64), size)]
    return _POWERS[0][:size], _POWERS[1][:size]


def _cumulative(base: int, size: int) -> np.ndarray:
    steps = np.full(max(size, 2 * BLOCK_BYTES), base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out *= np.uint64(_STEP)
        out += words[j : j + count]
    return out ^ out >> np.uint64(31)


class Windows:
    """The windows of test items: verified by their words, prefiltered by their hashes."""

    def __init__(self, items: list[tuple[object, bytes]], n: int) -> None:
        self.ids = [i for i, _ in items]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.items: dict[bytes, list[int]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for place, (_, text) in enumerate(items):
            words = Words(text)
            count = len(words.starts)
            if not count:
                continue
            size = min(n, count)
            hashes.setdefault(size, []).append(window_hashes(words.hashes(), size))
            for first in range(count - size + 1):
                owners = self.items.setdefault(words.joined(first, size), [])
                if not owners or owners[-1] != place:
                    owners.append(place)
        for size, found in hashes.items():
            known = np.unique(np.concatenate(found))
            bits = min(24, max(10, (64 * len(known)).bit_length()))
            marks = np.zeros(1 << bits, bool)
            marks[known >> np.uint64(64 - bits)] = True
            self.by_length[size] = (known, marks, 64 - bits)

    def hits(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, number of words, places of the items) of every verified window."""
        for size, (known, marks, shift) in self.by_length.items():
            found = window_hashes(hashes, size)
            likely = np.flatnonzero(marks[found >> np.uint64(shift)])
            likely = likely[known[np.minimum(np.searchsorted(known, found[likely]), len(known) - 1)] == found[likely]]
            for first in likely.tolist():
                owners = self.items.get(words.joined(first, size))
                if owners:
                    yield first, size, owners


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, benchmark: DataFrame, columns: list[Column], text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """``columns`` of every document with n_words, ``spans`` (merged runs of hit words: first and last word, first and last
    byte, ends exclusive) and ``items`` (sorted ids, as strings, of the items with windows in it)."""
    name = F.coalesce(F.col(item_id).cast("string"), F.lit("None"))
    items = benchmark.select(name.alias("id"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("text")).distinct()
    source = docs.select(*columns, F.col(text).cast("binary").alias("_text"))
    held = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return _scan_broadcast(source, items, n) if held <= MOST_BYTES else _scan_joined(source, items, n)


def _scan_broadcast(source: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """All windows of the items go to all tasks, with their words."""
    kept = source.columns[:-1]
    schema = source.drop("_text").withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast(SPANS), "items": F.lit(None).cast("array<string>")}).schema
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "first_byte", "last_byte")]))
    rows = [(r["id"], bytes(r["text"])) for r in items.orderBy("id", "text").collect()]
    shared = source.sparkSession.sparkContext.broadcast(Windows(rows, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            n_words, found, owners = [], [], []
            for value in batch.column(batch.num_columns - 1):
                words = Words(value.as_py() or b"")
                hits = list(windows.hits(words, words.hashes())) if len(words.starts) else []
                n_words.append(len(words.starts))
                merged = _merged([(first, first + size) for first, size, _ in hits])
                found.append([{"first": a, "last": b, "first_byte": int(words.starts[a]), "last_byte": int(words.ends[b - 1])} for a, b in merged])
                owners.append(sorted({windows.ids[i] for _, _, places in hits for i in places}))
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays = [*own, pa.array(n_words, pa.int64()), pa.array(found, kind), pa.array(owners, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "n_words", "spans", "items"])

    return source.mapInArrow(run, schema)


def _test_windows(items: DataFrame, n: int) -> DataFrame:
    """(id, size, hash, key) of every window of the items: ``key`` is the SHA-256 of its words, ``hash`` that of the prefilter."""
    schema = items.select("id", F.lit(0).alias("size"), F.lit(0).cast("long").alias("hash"), F.col("text").alias("key")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(1)):
                words = Words(value.as_py())
                size = min(n, len(words.starts))
                if not size:
                    continue
                hashes = window_hashes(words.hashes(), size)
                for low in range(0, len(hashes), CHUNK):
                    some = hashes[low : low + CHUNK]
                    keys = [words.key(first, size) for first in range(low, low + len(some))]
                    ids = batch.column(0).take(pa.array(np.full(len(some), row)))
                    arrays = [ids, pa.array(np.full(len(some), size, np.int32)), pa.array(some.view(np.int64)), pa.array(keys, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "size", "hash", "key"])

    return items.mapInArrow(run, schema).distinct()


def _bitmap(windows: DataFrame) -> tuple[list[int], np.ndarray]:
    """The sizes of the windows, and a bitmap of the first 27 bits of their hashes: at most 4096 rows of 4 KB."""
    top = F.shiftrightunsigned("hash", 64 - 27)
    per_block = F.lit(1 << 15)
    rows = windows.groupBy(F.floor(top / per_block).alias("block")).agg(
        F.bitmap_construct_agg(top % per_block).alias("bits"), F.collect_set("size").alias("sizes")
    )
    bits = np.zeros((1 << 12, 1 << 12), np.uint8)
    sizes: set[int] = set()
    for row in rows.collect():
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
        sizes.update(row["sizes"])
    return sorted(sizes), bits.reshape(-1)


def _scan_joined(source: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Windows that pass the bitmap are joined with those of the items.

    One pass over the documents writes a row for each, with its number, and its likely windows in further rows of at most CHUNK. All else
    reads that table, so numbers hold whatever the partitions of the source. A window that many documents share is a hot key of a
    semi join, which Spark splits.
    """
    kept = source.columns[:-1]
    windows = written(_test_windows(items, n), "test-windows")
    shared = source.sparkSession.sparkContext.broadcast(_bitmap(windows))
    likely = "array<struct<key:binary,first:long,last:long,first_byte:long,last_byte:long>>"
    row, n_words, placed, key_row, own_spans, own_items = (free_name(source, x) for x in ("_row", "_n", "_likely", "_r", "_spans", "_items"))
    schema = source.drop("_text").withColumns({row: F.lit(0).cast("long"), n_words: F.lit(None).cast("long"), placed: F.lit(None).cast(likely)}).schema
    kind = pa.list_(pa.struct([("key", pa.binary()), *((x, pa.int64()) for x in ("first", "last", "first_byte", "last_byte"))]))

    def candidates(words: Words) -> Iterator[list[dict]]:
        sizes, bits = shared.value
        hashes, out = words.hashes(), []
        for size in sizes:
            top = window_hashes(hashes, size) >> np.uint64(64 - 27)
            marked = bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1
            for first in np.flatnonzero(marked).tolist():
                last = first + size
                place = {"first": first, "last": last, "first_byte": int(words.starts[first]), "last_byte": int(words.ends[last - 1])}
                out.append({"key": words.key(first, size), **place})
                if len(out) == CHUNK:
                    yield out
                    out = []
        yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            heads, numbers, counts, found = [], [], [], []

            def ready(batch=batch, lists=(heads, numbers, counts, found)) -> pa.RecordBatch:
                own = [batch.column(c).take(pa.array(heads, pa.int64())) for c in range(len(kept))]
                arrays = [*own, pa.array(numbers, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, kind)]
                for x in lists:
                    x.clear()
                return pa.RecordBatch.from_arrays(arrays, names=[*kept, row, n_words, placed])

            held = 0
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                words = Words(value.as_py() or b"")
                for part, some in enumerate(candidates(words)):
                    # The first row of a document has its columns and n_words; the others have neither.
                    heads.append(None if part else i)
                    counts.append(None if part else len(words.starts))
                    numbers.append(number)
                    found.append(some)
                    held += len(some)
                    if held >= CHUNK:
                        yield ready()
                        held = 0
                number += 1
            yield ready()

    for field in schema.fields:
        field.nullable = True
    scanned = written(source.mapInArrow(run, schema), "likely-windows")
    found = scanned.select(F.col(row).alias("_r"), F.explode(placed).alias("_w")).select("_r", "_w.*")
    hits = written(found.join(windows.select("key"), "key", "left_semi"), "test-hits")
    in_order = Window.partitionBy("_r").orderBy("first", "last")
    reach = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("_r", "first", "last", "first_byte", "last_byte", F.coalesce(F.col("first") > reach, F.lit(True)).alias("_new"))
    runs = runs.withColumn("_run", F.sum(F.col("_new").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("_r", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("first_byte").alias("first_byte"), F.max("last_byte").alias("last_byte"))
    spans = merged.groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("first", "last", "first_byte", "last_byte"))).alias(own_spans))
    owners = hits.select("_r", "key").distinct().join(windows.select("key", "id"), "key")
    owners = owners.groupBy("_r").agg(F.array_sort(F.collect_set("id")).alias(own_items))
    verdicts = spans.join(owners, "_r").withColumnRenamed("_r", key_row)
    heads = scanned.filter(F.col(n_words).isNotNull())
    joined = heads.join(verdicts, heads[row] == verdicts[key_row], "left")
    empty = F.array()
    return joined.select(
        *kept, F.col(n_words).alias("n_words"), F.coalesce(own_spans, empty.cast(SPANS)).alias("spans"),
        F.coalesce(own_items, empty.cast("array<string>")).alias("items"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from what scan() returns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])
    return scanned.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
            "contaminated": F.size("spans") > 0,
        }
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """docs without what it shares with the test items: without the ``documents`` that have hit words, or without the ``spans``.

    A removed span goes from the first byte of its first word to the last byte of its last.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    found = scan(plain, benchmark, [F.col(c) for c in plain.columns], f"c{own.index(text)}", item_id, item_text, n)
    if remove == "documents":
        return found.filter(F.size("spans") == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
    data = f"cast(c{own.index(text)} as binary)"
    rest = F.expr(
        f"cast(concat(aggregate(spans, named_struct('at', 0L, 'out', cast('' as binary)), (a, s) -> named_struct('at', s.last_byte, 'out',"
        f" concat(a.out, substring({data}, int(a.at) + 1, int(s.first_byte - a.at))))).out,"
        f" substring({data}, int(coalesce(element_at(spans, -1).last_byte, 0)) + 1)) as string)"
    )
    cleaned = F.when(F.size("spans") > 0, rest).otherwise(F.col(f"c{own.index(text)}"))
    return found.select(*[(cleaned if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(own)])


_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The digest by joining all windows as text.
ORACLE = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, w, least(10, len(w)) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM iw)
), occ AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hit AS (
  SELECT DISTINCT doc_id, i, n, item_id FROM occ JOIN wins USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
