"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are those of its text and the end id. It is cut into pieces of ``capacity`` ids and a rest. Pieces are dealt into
groups by a seeded hash of their document's row and of each run of 512 pieces in it, so neither one long document nor rows that
repeat make a group large. (The row's number is written with the pieces. It follows the input's partitions, and so do the groups.) Each group is packed by itself: longest piece first, each into the first sequence with room for it. A tree
whose nodes hold the most room below them finds that sequence in logarithmic time.

Only (document, start, length, checksum) is shuffled; the ids stay where they were made. ``sequence_id`` is the group's number times
2^32 plus the sequence's number in the group. A null text is empty and packs as its end id alone. Repeated rows are packed each.
A null id is an id like others. An empty table gives no pieces.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm import tokens
from corpuslens.llm.common import written

CAPACITY = 1024
END_ID = 0
SEED = 20
#: Pieces that a group has on average.
GROUP_PIECES = 8192
#: Pieces of one document that are dealt together.
RUN_PIECES = 512


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size; none is larger than the capacity."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = int(np.count_nonzero(sizes == capacity))
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    leaves = 1
    while leaves < len(rest):
        leaves *= 2
    # room[i]: the most room in the bins below node i; bin k is leaf leaves + k, an unused one has all room.
    room = [capacity] * (2 * leaves)
    for at, size in zip(rest.tolist(), sizes[rest].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[at] = full + node - leaves
        offsets[at] = capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens) of every piece of every document; row numbers the documents."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = source.select("doc_id", "row", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in tokens.in_parts(texts):
                rows, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(texts[first:last]), first):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), capacity):
                        piece = ids[at : at + capacity]
                        rows.append(i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(ids))
                own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return source.mapInArrow(run, schema)


def pack(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """The pieces with sequence_id, offset, sequence_tokens and padded_tokens: capacity, or less at a power of two."""
    found = written(found, "pieces")
    groups = max(1, round(found.count() / group_pieces))
    run_of = F.floor(F.col("start") / F.lit(RUN_PIECES * capacity))
    dealt = found.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "row", run_of), F.lit(groups)))
    added = {c: F.lit(0).cast("long") for c in ("sequence_id", "offset", "sequence_tokens", "padded_tokens")}
    schema = found.drop("row").withColumns(added).schema

    def run(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        table = table.drop_columns(["_group", "row"]).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(sizes, capacity)
        filled = np.bincount(bins, weights=sizes).astype(np.int64)
        padded = np.where(filled & (filled - 1), capacity, filled)
        for name, values in (("sequence_id", (group << 32) + bins), ("offset", offsets), ("sequence_tokens", filled[bins]), ("padded_tokens", padded[bins])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return dealt.groupBy("_group").applyInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    return pack(pieces(docs, tokenizer, doc_id, text, capacity, end_id), capacity)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
