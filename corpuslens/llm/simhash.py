"""SimHash near-duplicates: fingerprints, a positional byte index with count filtering, connected components.

Two fingerprints at most ``distance`` bits apart differ in at most ``distance`` bytes, so they share ``8 - distance`` of their
eight positional bytes at least. The index has a posting list for each choice of that many positions and the bytes there: every
pair that reaches the guaranteed minimum meets in one of them, and pairs below it in none. Pairs that meet are verified by
their bit distance.

A list is linked without writing down its pairs. Short lists are compared row against row in NumPy. In a long list two
fingerprints are linked through a midpoint at most half the distance from both, so its cost is linear in its members. Its
midpoints are dealt into parts by a linear hash, ``PART_MIDPOINTS`` in each; a part is a task's, with all members that reach it,
and goes through its midpoints in passes. What is linked is kept as labels, not as edges. What leaves a task is one edge per
fingerprint and part, to the smallest one of its local component.

Rows: a null text is empty. A text without words has fingerprint 0 and is linked like any other; equal texts have equal
fingerprints and are one row of the index. Repeated rows are kept. A null ``doc_id`` is never a component's id unless the
component has no other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import Scratch, free_name, written

SEED = 42
#: A list longer than this is linked through midpoints: there are 529 of them for 32 free bits and two flips.
LONG_LIST = 1024
#: Midpoints held at once.
MIDPOINTS = 4_000_000
#: Midpoints of one part of a long list, on average.
PART_MIDPOINTS = 64_000_000  # a list of 120,000 members
#: Posting rows for each task.
ROWS_PER_TASK = 1_000_000


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, column: str = "fingerprint") -> DataFrame:
    """Every row with the fingerprint of its text, as a signed long, in place of the text."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).withColumn(column, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            values = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            kept = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values.view(np.int64))], names=[*rest, column])

    return docs.select(*rest, F.col(text).cast("binary")).mapInArrow(run, schema)


def _masks(distance: int) -> list[int]:
    """One mask for each choice of the positional bytes that a linked pair is sure to share, as signed longs."""
    return [
        int.from_bytes(bytes(255 if i in kept else 0 for i in range(8)), "big", signed=True)
        for kept in itertools.combinations(range(8), 8 - distance)
    ]


def _bits(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give every end of an edge the smaller label, until nothing changes."""
    while True:
        low = np.minimum(labels[a], labels[b])
        changed = (labels[a] != low) | (labels[b] != low)
        if not changed.any():
            return
        roots = np.concatenate([labels[a][changed], labels[b][changed], a[changed], b[changed]])
        np.minimum.at(labels, roots, np.tile(low[changed], 4))
        while True:
            higher = labels[labels]
            if np.array_equal(higher, labels):
                break
            labels[:] = higher


def _flips(free: list[int], distance: int) -> list[int]:
    """What leads from a fingerprint to its midpoints; an odd distance flips one bit more on one side."""
    far = distance - distance // 2
    return [sum(1 << b for b in c) for k in range(far + 1) for c in itertools.combinations(free, k)]


_SYNDROMES = np.random.default_rng(SEED).integers(0, 1 << 32, 64, dtype=np.uint64)


def _syndrome(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """A linear hash of 32 bits: that of a ^ b is the hash of a ^ that of b."""
    out = np.zeros(len(values), np.uint64)
    for b in bits:
        out ^= (values >> np.uint64(b) & np.uint64(1)) * _SYNDROMES[b]
    return out


def _link_long(members: np.ndarray, free: int, distance: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as places in members, one for a member at most) that connect all members at most ``distance`` bits apart whose midpoints
    are in the part.

    The members agree outside the ``free`` bits, so midpoints do, too. A midpoint's part and pass are the lowest bits of its
    syndrome. With the members in the order of theirs, those that a flip leads into a pass lie side by side.
    """
    bits = [i for i in range(64) if free >> i & 1]
    flips = np.array(_flips(bits, distance), np.uint64)
    near = _bits(flips) <= distance // 2
    passes = 1 << max(0, -(-len(members) * len(flips) // (parts * MIDPOINTS)) - 1).bit_length()
    last = np.uint64(parts * passes - 1)
    of_member, of_flip = _syndrome(members, bits) & last, (_syndrome(flips, bits) & last).astype(np.int64)
    place = np.argsort(of_member, kind="stable")
    members = members[place]
    begins = np.searchsorted(of_member[place], np.arange(parts * passes + 1, dtype=np.uint64))
    labels = np.arange(len(place))
    for k in range(part, parts * passes, parts):
        wanted = of_flip ^ k
        lows, highs = begins[wanted], begins[wanted + 1]
        used = np.flatnonzero(highs > lows)
        if not len(used):
            continue
        counts = (highs - lows)[used]
        at = np.arange(counts.sum()) + np.repeat(lows[used] - (np.cumsum(counts) - counts), counts)
        key, side = members[at] ^ np.repeat(flips[used], counts), np.repeat(near[used], counts)
        at = place[at]
        order = np.lexsort((~side, key))
        key, at, side = key[order], at[order], side[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        use = ~first & side[head]  # the head is on the near side, so each other member of the list is linked with it
        _hook(labels, at[use], at[head[use]])
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return moved, labels[moved]


def linked(keys: np.ndarray, values: np.ndarray, distance: int, masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges between values that share a posting list and are at most ``distance`` bits apart: to the smallest of each
    local component. keys: rows of (mask number, masked value), and for lists in parts their number and which one it is."""
    if keys.shape[1] == 2:
        keys = np.column_stack([keys, np.ones(len(keys), np.uint64), np.zeros(len(keys), np.uint64)])
    order = np.lexsort((values, keys[:, 3], keys[:, 1], keys[:, 0])) if len(values) else np.empty(0, int)
    number, masked, parts, part, values = *(keys[order, i] for i in range(4)), values[order]
    distinct, labels = np.unique(values, return_inverse=True)
    labels = labels.astype(np.int64)
    changes = (number[1:] != number[:-1]) | (masked[1:] != masked[:-1]) | (part[1:] != part[:-1])
    new = np.concatenate([[True], changes]) if len(values) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(values)))
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    rest = np.flatnonzero((size_of > 1) & (size_of <= LONG_LIST))
    group = np.repeat(np.arange(len(starts)), sizes)
    step = 1
    while len(rest):
        rest = rest[rest + step < len(values)]
        rest = rest[group[rest + step] == group[rest]]
        near = rest[_bits(values[rest] ^ values[rest + step]) <= distance]
        left.append(labels[near])
        right.append(labels[near + step])
        step += 1
    for at, size in zip(starts[sizes > LONG_LIST], sizes[sizes > LONG_LIST]):
        free = ~masks[int(number[at])] & (2**64 - 1)
        a, b = _link_long(values[at : at + size], free, distance, int(part[at]), int(parts[at]))
        left.append(labels[at + a])
        right.append(labels[at + b])
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    component = np.arange(len(distinct))
    _hook(component, np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(component != np.arange(len(distinct)))
    return distinct[moved], distinct[component[moved]]


def links(fingerprints: DataFrame, distance: int = 4, column: str = "fingerprint") -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs at most ``distance`` bits apart."""
    if not 0 < distance < 8:
        raise ValueError("distance must be 1 to 7")
    masks = _masks(distance)
    spark = fingerprints.sparkSession
    lists = F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.col(column).bitwiseAND(F.lit(m)).alias("masked")) for i, m in enumerate(masks)]))
    postings = fingerprints.select(F.col(column).alias("value"), lists.alias("list")).select("list.number", "list.masked", "value")
    flips = len(_flips(list(range(8 * distance)), distance))
    most = max(LONG_LIST, PART_MIDPOINTS // flips)  # members of a list of one part
    rows = fingerprints.count()
    in_parts = None
    if rows > most:  # no list is longer than the table
        # Counted in few bins first: a list is no longer than its bin, so only those of long bins are counted by themselves.
        binned = F.pmod(F.xxhash64("masked"), F.lit(max(1024, 16 * rows // most)))
        bins = postings.groupBy(F.col("number").alias("_of"), binned.alias("_bin")).agg(F.count(F.lit(1)).alias("size"))
        bins = written(bins.filter(F.col("size") > most).drop("size"), "long-bins")
        some = postings.join(bins, (F.col("number") == F.col("_of")) & (binned == F.col("_bin")), "left_semi") if bins.take(1) else postings.limit(0)
        sizes = some.groupBy(F.col("number").alias("_number"), F.col("masked").alias("_masked")).agg(F.count(F.lit(1)).alias("size"))
        parts = F.pow(F.lit(2), F.ceil(F.log2(F.col("size") / F.lit(most)))).cast("int")
        in_parts = written(sizes.filter(F.col("size") > most).withColumn("parts", parts), "long-lists")
    rows *= len(masks)
    if in_parts is None:
        postings = postings.select("number", "masked", F.lit(1).alias("parts"), F.lit(0).alias("part"), "value")
    else:
        rows += in_parts.agg(F.coalesce(F.sum(F.col("size") * (F.col("parts") - 1)), F.lit(0))).first()[0]
        met = postings.join(in_parts, (F.col("number") == F.col("_number")) & (F.col("masked") == F.col("_masked")), "left")
        parts = F.coalesce("parts", F.lit(1))
        each = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")  # each part gets all members
        postings = met.select("number", "masked", parts.alias("parts"), each, "value")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[batch.column(i).to_numpy() for i in range(5)] for batch in batches]
        if not columns:
            return
        *keys, value = (np.concatenate([c[i] for c in columns]) for i in range(5))
        del columns
        keys = np.stack([k.astype(np.int64).view(np.uint64) for k in keys], axis=1)
        a, b = linked(keys, value.view(np.uint64), distance, masks)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return postings.repartition(tasks, "number", "masked", "part").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the smallest node it is connected with, itself included.

    Alternates large-star and small-star steps until the edges are stars; each round is written to the shared folder.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame, both_ways: bool) -> DataFrame:
        near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else pairs
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        low = least.select("node", F.least("node", "low").alias("low"))
        met = near.join(low, F.col("a") == F.col("node"))
        if both_ways:
            out = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
                low.select(F.col("node").alias("a"), F.col("low").alias("b"))
            )
        return out.filter("a <> b").distinct()

    now = scratch.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while (seen := mark(now)) != before:
        before = seen
        now = scratch.put(star(star(now, True), False))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, extra: list | None = None
) -> DataFrame:
    """One row per row of docs: its id, ``fingerprint`` (signed long) and ``component_id``, the smallest id reachable over links.

    ``extra``: further columns to carry, as expressions of docs.
    """
    slim = written(
        with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), *(extra or []), F.col(text).alias("text")), shingle=shingle), "fingerprints"
    )
    distinct = written(slim.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, distance))
    of = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    ids = of.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    classes = of.join(ids, of["root"] == ids["_root"]).select(F.col("fingerprint").alias("_fp"), "component_id", "root")
    return slim.join(classes, slim["fingerprint"] == classes["_fp"]).drop("_fp")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest id (then text hash) stays.

    All columns are kept. Of repeated rows one stays.
    """
    row_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    found = near_duplicates(docs, doc_id, text, shingle, distance, [row_hash.alias("row_hash")])
    each = written(found.groupBy("root", "doc_id", "row_hash").agg(F.count(F.lit(1)).alias("copies")), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    best = each.groupBy(F.col("root").alias("_root")).agg(F.min(order).alias("best"))
    judged = each.join(best, each["root"] == best["_root"]).select(
        "doc_id", "row_hash", "copies", (order == F.col("best")).alias("stays")
    )
    away = judged.filter("NOT coalesce(stays, false) OR copies > 1").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"))
    again = judged.filter("stays AND copies > 1").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"))
    key = free_name(docs, "_row_hash")
    keyed = docs.withColumn(key, row_hash)

    def same(other: DataFrame):
        return keyed[doc_id].eqNullSafe(other["_id"]) & (keyed[key] == other["_hash"])

    once = keyed.join(away, same(away), "left_anti")
    repeated = keyed.join(again, same(again), "left_semi").dropDuplicates([doc_id, key])
    return once.unionByName(repeated).drop(key)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
