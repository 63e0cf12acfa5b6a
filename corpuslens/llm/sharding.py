"""Sharding: minimax contiguous partition of ordered atomic groups.

A group is all documents with equal text; it is never divided. Groups are put in an order: the large ones (more than a 64th of a mean
shard, at most ``64 * shards`` of them) by falling size, then all others by their smallest id, so the late cuts are fine ones. Groups no
smaller than a fair share of what is left are shards of their own. The others are cut into consecutive shards under the smallest capacity
for which greedy filling needs no more shards than there are; the capacity is found by binary search.

Feasibility is checked against a summary of the group ends: at most ``CELLS`` ranges with their first and last end. The true
greedy run lies between an optimistic and a pessimistic one over the summary, so the search gives an interval for the capacity. Where the two
runs differ, the ranges they touch are summarised more finely by one aggregate over the group ends, until capacity and cuts are exact.
Nothing larger than the summary reaches the driver.

Documents are range-sorted by (group, id), so one large group of copies is spread over partitions; positions are sums within
a partition plus one offset for each. Everything is DataFrame expressions.

A null text is empty: size 1, checksum 0, one group with empty texts. Repeated rows are documents of their own. Null ids come first. An
empty table gives no rows. With fewer groups than shards, some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.llm.common import text_hash, written

CELLS = 4096
LARGE = 64


class Ends:
    """A summary of sorted group ends: cells (first end, last end, number of ends), refined on demand."""

    def __init__(self, ends: DataFrame, base: int, total: int) -> None:
        self.base, self.total = base, total
        self.width = max(1, -(-(total - base) // CELLS))
        self.ends = ends.withColumn("bin", F.floor((F.col("end") - 1 - base) / self.width).cast("long"))
        rows = self.ends.groupBy("bin").agg(F.min("end"), F.max("end"), F.countDistinct("end")).collect()
        self.cells = sorted((r[1], r[2], r[3]) for r in rows)

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the last end that is not above x; the base, if there is none."""
        i = bisect_right(self.cells, (x, self.total + 1, 0)) - 1
        if i < 0:
            return self.base, self.base
        low, high, count = self.cells[i]
        if x >= high:
            return high, high
        return (low, low) if count <= 2 else (low, x)

    def run(self, capacity: int, shards: int, best: bool) -> list[int]:
        """Where greedy filling cuts, at best or at worst."""
        cuts, at = [], self.base
        for _ in range(shards):
            at = self.floor(at + capacity)[best]
            cuts.append(at)
        return cuts

    def least(self, shards: int, best: bool) -> int:
        """The smallest capacity that is enough, at best or at worst."""
        low, high = 0, self.total - self.base
        while low < high:
            middle = (low + high) // 2
            if self.run(middle, shards, best)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def refine(self, ranges: list[tuple[int, int]]) -> None:
        """Cut the cells that meet one of the ranges into smaller ones."""
        open_cells = [c for c in self.cells if c[2] > 2 and any(a < c[1] and c[0] <= b for a, b in ranges)]
        parts = max(2, CELLS // len(open_cells))
        spark = self.ends.sparkSession
        rows = []
        for low, high, _ in open_cells:
            rows.append(((low - 1 - self.base) // self.width, low, high, max(1, -(-(high - low + 1) // parts))))
        cells = spark.createDataFrame(rows, "cell_bin long, low long, high long, step long")
        inside = (F.col("bin") == F.col("cell_bin")) & F.col("end").between(F.col("low"), F.col("high"))
        met = self.ends.join(F.broadcast(cells), inside)
        found = met.groupBy("low", F.floor((F.col("end") - F.col("low")) / F.col("step"))).agg(F.min("end"), F.max("end"), F.countDistinct("end")).collect()
        self.cells = sorted((set(self.cells) - set(open_cells)) | {(r[2], r[3], r[4]) for r in found})

    def cuts(self, shards: int) -> list[int]:
        """The cuts of greedy filling under the smallest capacity."""
        while True:
            low, high = self.least(shards, True), self.least(shards, False)
            first, last = self.run(low, shards, False), self.run(high, shards, True)
            if low == high and first == last:
                return first
            self.refine([(a + low, b + high) for a, b in zip([self.base, *first], [self.base, *last])][:shards])


def shards_of(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), text_hash(text).alias("key"))
    slim = written(slim, "sizes")
    groups = written(slim.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if not total:
        return slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    large = groups.filter(F.col("bytes") * (LARGE * shards) > total).orderBy(F.desc("bytes"), F.col("first").asc_nulls_first(), "key").collect()
    alone, rest, left = 0, total, shards
    while left > 1 and alone < len(large) and large[alone]["bytes"] * left >= rest:
        rest, left, alone = rest - large[alone]["bytes"], left - 1, alone + 1
    spark = docs.sparkSession
    ranks = spark.createDataFrame([(bytearray(r["key"]), i) for i, r in enumerate(large)], "rank_key binary, rank int")
    ranked = groups.join(F.broadcast(ranks), F.col("key") == F.col("rank_key"), "left")
    ranked = ranked.select(F.col("key").alias("group_key"), "first", F.coalesce("rank", F.lit(len(large))).alias("rank"))
    order = [F.col("rank").asc(), F.col("first").asc_nulls_first(), F.col("key").asc(), F.col("doc_id").asc_nulls_first()]
    rows = slim.join(ranked, slim["key"] == ranked["group_key"]).drop("group_key").repartitionByRange(*order)
    # Partition numbers must hold for all that follows, so the sorted rows are written.
    placed = written(rows.withColumn("part", F.spark_partition_id()), "sorted")
    parts = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select(
        F.col("part").alias("_part"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("part_bytes", "part_rows")],
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns({"end": F.sum("size").over(inside), "row": F.count(F.lit(1)).over(inside)})
    placed = placed.join(parts, placed["part"] == parts["_part"])
    placed = written(
        placed.select("doc_id", "size", "text_crc32", "key", (F.col("end") + F.col("part_bytes_before")).alias("end"), (F.col("row") + F.col("part_rows_before")).alias("row")),
        "positions",
    )
    ends = written(placed.groupBy("key").agg(F.max("end").alias("end"), F.max("row").alias("row")).select("end", "row"), "ends")
    base, cuts = 0, []
    for r in large[:alone]:
        base += r["bytes"]
        cuts.append(base)
    if base < total:
        cuts += Ends(ends.filter(F.col("end") > base), base, total).cuts(left)
    at = {r["end"]: r["row"] for r in ends.filter(F.col("end").isin(cuts)).collect()}
    starts = F.array(*[F.lit(n).cast("long") for n in [0, *(at[c] for c in cuts)]])
    cut = F.array(*[F.lit(c).cast("long") for c in cuts])
    shard = F.size(F.filter(cut, lambda c: c < F.col("end")))
    return placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("row") - 1 - F.get(starts, shard)).alias("slot"))
