"""Prefix trie of conversations: balanced parentheses per shard, whose shared spines merge level by level.

A conversation is the sequence of its turns. A turn is known by the 128-bit digest of its role and text; a conversation's ``path``
is its digests one after another, so the byte order of paths is the trie's preorder. Equal conversations are one row before
anything is dealt (``n`` members, the smallest of them is ``low``). Paths are range-partitioned into shards. A shard writes its
nodes as a sequence of parentheses and reads everything from it:

* ``findclose``, over a tree of least excess per block, gives the end of each node's subtree;
* the rank of an opening parenthesis is its node's place in preorder, and the rank of ``()`` counts the leaves of a subtree;
* cumulative arrays over preorder give members and savings; a range minimum gives the smallest member.

Only nodes on a shard's first or last path can reach into its neighbours. They leave it as two spine rows that hold, for each depth,
what the finished subtrees below add. Spine rows are paths, too: the next level deals them into fewer shards and encodes them in the
same way, until one shard is left (a shard of SPINES rows gives two, so levels are few). The smallest member of a spine node then goes
back down to the nodes that have it as parent.

The empty path is the root; no conversation, no node. A null role or text is empty, null turns come first, equal turn numbers are
ordered by the turn's digest, repeated rows are turns each, rows without a conv_id belong to no conversation. A conversation's
digests (20 bytes a turn) are one cell.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.common import written

#: Turns in a shard, about; and the least in one, while there are fewer shards than cores.
SHARD_TURNS = 250_000
LEAST_TURNS = 16_000
#: Spine rows in a shard of the next level.
SPINES = 1024
#: Members whose ids are joined into one string.
RUN_MEMBERS = 8192
WIDTH = 16
BLOCK = 64
NONE = np.iinfo(np.int64).max
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_OWN = "array<struct<is_end:boolean,n:bigint,low:bigint,leaves:bigint,children:bigint,saved:bigint>>"
_NODE = "low bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, seq binary, parent_low bigint"
#: kind 0: a finished node; 1: a spine row; 2: the smallest members along the path of a row of the level below.
_SCHEMA = f"kind int, {_NODE}, link bigint, id bigint, cut int, path binary, sizes array<int>, own {_OWN}, lows array<bigint>"


class Parentheses:
    """A balanced sequence (+1 opens, -1 closes) with the least excess of each block, and of pairs of blocks, pairs of those and so on."""

    def __init__(self, steps: np.ndarray) -> None:
        self.excess = np.cumsum(steps, dtype=np.int64)
        blocks = 1 << max(0, math.ceil(len(steps) / BLOCK) - 1).bit_length()
        padded = np.full(blocks * BLOCK, NONE)
        padded[: len(steps)] = self.excess
        self.padded = padded
        self.least = np.full(2 * blocks, NONE)
        self.least[blocks:] = padded.reshape(blocks, BLOCK).min(axis=1)
        for first in (blocks >> k for k in range(1, blocks.bit_length())):
            self.least[first : 2 * first] = np.minimum(self.least[2 * first : 4 * first : 2], self.least[2 * first + 1 : 4 * first : 2])

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The place of the closing parenthesis of each opening one: the first place behind it with one less excess."""
        target, out = self.excess[opens] - 1, np.full(len(opens), -1)
        # Within the block: most subtrees are small, so fewer are left with each step.
        left, at = np.arange(len(opens)), opens + 1
        while len(left):
            inside = at % BLOCK != 0
            left, at = left[inside], at[inside]
            hit = self.padded[at] <= target[left]
            out[left[hit]] = at[hit]
            left, at = left[~hit], at[~hit] + 1
        left = np.flatnonzero(out < 0)
        blocks = len(self.least) // 2
        node, goal = opens[left] // BLOCK + blocks, target[left]
        # Up to the first subtree of blocks to the right that goes low enough, ...
        rising = np.arange(len(left))
        while len(rising):
            here = node[rising]
            right = (here & 1 == 0) & (self.least[np.minimum(here + 1, 2 * blocks - 1)] <= goal[rising])
            node[rising[right]] += 1
            rising = rising[~right]
            node[rising] >>= 1
        # ... down to its first block that does, and to the first place in it.
        while len(node) and node[0] < blocks or (node < blocks).any():
            inner = node < blocks
            child = 2 * node[inner]
            node[inner] = child + (self.least[child] > goal[inner])
        for first in range(0, len(left), 4096):
            some = slice(first, first + 4096)
            start = (node[some] - blocks) * BLOCK
            window = self.padded[start[:, None] + np.arange(BLOCK)] <= goal[some][:, None]
            out[left[some]] = start + window.argmax(axis=1)
        return out


def range_minimum(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of values[first : first + size], size 1 at least."""
    out, level = np.empty(len(first), np.int64), values
    power = np.frexp(size.astype(np.float64))[1] - 1
    for k in range(int(power.max(initial=0)) + 1):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(level[first[own]], level[first[own] + size[own] - (1 << k)])
        level = np.minimum(level[: -(1 << k)], level[1 << k :]) if len(level) > 1 << k else level
    return out


def common_turns(left: bytes, right: bytes) -> int:
    """The number of first turns that two paths share."""
    most = min(len(left), len(right))
    if left[:WIDTH] != right[:WIDTH] or not most:
        return 0
    if left[:most] == right[:most]:
        return most // WIDTH
    return int((np.frombuffer(left, np.uint8, most) != np.frombuffer(right, np.uint8, most)).argmax()) // WIDTH


def encoded(paths: list[bytes], sizes: np.ndarray, own: dict[str, np.ndarray], ids: list[int] | None, shard: int, last: bool) -> Iterator[dict]:
    """The finished nodes, spine rows and answers of one shard.

    paths are distinct and sorted; sizes: of all their turns in a row; own: per path and depth, the root first.
    """
    depths = np.array([len(p) // WIDTH for p in paths], np.int64)
    shared = np.array([0] + [common_turns(a, b) for a, b in zip(paths, paths[1:])], np.int64)
    new = depths - shared
    first_new = 1 + np.concatenate([[0], np.cumsum(new)])
    total = int(first_new[-1])
    row_of = np.repeat(np.arange(len(paths)), new)
    turn_start = np.concatenate([[0], np.cumsum(depths)])
    depth = np.zeros(total, np.int64)
    depth[1:] = np.arange(1, total) - first_new[row_of] + shared[row_of] + 1
    size = np.zeros(total, np.int64)
    size[1:] = sizes[turn_start[row_of] + depth[1:] - 1]

    # The sequence: before a path's new nodes open, those of the path before it close down to what they share.
    closing = np.concatenate([[0], depths[:-1] - shared[1:]])
    opens = np.arange(total)
    opens[1:] += np.cumsum(closing)[row_of]
    steps = np.full(2 * total, -1, np.int8)
    steps[opens] = 1
    closes = Parentheses(steps).findclose(opens)
    span = (closes - opens + 1) // 2
    stop = np.arange(total) + span

    # What the input adds at each node. A path's entries belong to its new nodes; those of shared depths are added to their nodes.
    def spread(name: str) -> np.ndarray:
        values = own[name]
        out = np.full(total, NONE) if name == "low" else np.zeros(total, values.dtype)
        np.minimum.at(out, entry_node, values) if name == "low" else np.add.at(out, entry_node, values) if values.dtype != bool else np.logical_or.at(out, entry_node, values)
        return out

    chains: list[np.ndarray] = []
    if ids is None:  # one entry a path: where it ends
        entry_node = np.where(new > 0, first_new[1:] - 1, 0)
    else:
        chain = np.zeros(1, np.int64)
        for i in range(len(paths)):
            chain = np.concatenate([chain[: shared[i] + 1], np.arange(first_new[i], first_new[i + 1])])
            chains.append(chain)
        entry_node = np.concatenate(chains)
    is_end, n, low, leaves, children, saved = (spread(k) for k in ("is_end", "n", "low", "leaves", "children", "saved"))

    parent = np.zeros(total, np.int64)
    by_depth = np.lexsort((np.arange(total), depth))
    keys = depth[by_depth] * total + by_depth
    parent[1:] = by_depth[np.searchsorted(keys, (depth[1:] - 1) * total + np.arange(1, total)) - 1]

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[stop] - sums[:-1]

    pairs = (steps[opens] == 1) & (steps[opens + 1] == -1)
    n_convs = below(n)
    n_children = children + np.bincount(parent[1:], minlength=total)
    n_leaves = below(leaves + (pairs & (children == 0)))
    saving = below(saved + (n_convs - 1) * size)
    lows = range_minimum(low, np.arange(total), span)

    spine = np.zeros(total, bool)
    if not last:
        spine[: depths[0] + 1] = True
        spine[stop == total] = True
    side = np.where(np.arange(total) <= depths[0], 0, 1)
    done = np.flatnonzero(~spine)
    under_spine = spine[parent] & (depth > 0)

    if len(done):
        if ids is None:
            node_row = np.zeros(total, np.int64)
            node_row[entry_node] = np.arange(len(paths))
        else:
            node_row = np.concatenate([[0], row_of])
        digest = [hashlib.md5(paths[r][: WIDTH * d]).digest() if e else None for r, d, e in zip(node_row[done].tolist(), depth[done].tolist(), is_end[done].tolist())]
        known = ~under_spine[done] & (depth[done] > 0)
        yield {
            "kind": 0, "low": lows[done], "depth": depth[done], "n_convs": n_convs[done], "n_children": n_children[done],
            "n_leaves": n_leaves[done], "saved": saving[done], "seq": pa.array(digest, pa.binary()),
            "parent_low": pa.array(lows[parent[done]], pa.int64(), mask=~known),
            "link": pa.array(2 * shard + side[parent[done]], pa.int64(), mask=~under_spine[done]),
        }
    if ids is not None:
        links, cuts, known_lows = [], [], []
        for chain in chains:
            cut = int(spine[chain].sum())
            links.append(2 * shard + int(side[chain[cut - 1]]) if cut else None)
            cuts.append(cut)
            known_lows.append(lows[chain[cut:]].tolist())
        yield {"kind": 2, "id": pa.array(ids, pa.int64()), "link": pa.array(links, pa.int64()), "cut": pa.array(cuts, pa.int32()), "lows": pa.array(known_lows, pa.list_(pa.int64()))}
    if last:
        return
    child = np.flatnonzero(under_spine & ~spine)
    for values, of in ((n, n_convs), (leaves, n_leaves), (saved, saving)):
        np.add.at(values, parent[child], of[child])
    np.add.at(children, parent[child], 1)
    np.minimum.at(low, parent[child], lows[child])
    rows = [(0, np.arange(depths[0] + 1))]
    if len(paths) > 1:
        rows.append((len(paths) - 1, np.flatnonzero(stop == total)))
    entries = []
    for place, (_, nodes) in enumerate(rows):
        mine = side[nodes] == place
        entries.append([
            {"is_end": e, "n": a, "low": w, "leaves": b, "children": c, "saved": s} if m else {"is_end": False, "n": 0, "low": NONE, "leaves": 0, "children": 0, "saved": 0}
            for m, e, a, w, b, c, s in zip(mine.tolist(), is_end[nodes].tolist(), n[nodes].tolist(), low[nodes].tolist(), leaves[nodes].tolist(), children[nodes].tolist(), saved[nodes].tolist())
        ])
    yield {
        "kind": 1, "id": pa.array([2 * shard + k for k in range(len(rows))], pa.int64()), "path": pa.array([paths[i] for i, _ in rows], pa.binary()),
        "sizes": pa.array([sizes[turn_start[i] : turn_start[i + 1]].tolist() for i, _ in rows], pa.list_(pa.int32())), "own": pa.array(entries),
    }


def _shard(first_level: bool, last: bool, kinds: pa.Schema):
    """The task of one shard; kinds: the schema of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        paths = table.column("path").to_pylist()
        sizes = table.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if first_level:
            zeros = np.zeros(len(paths), np.int64)
            own = {"is_end": np.ones(len(paths), bool), "n": table.column("n").to_numpy(), "low": table.column("low").to_numpy(), "leaves": zeros, "children": zeros, "saved": zeros}
            ids = None
        else:
            flat = table.column("own").combine_chunks().flatten()
            own = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
            ids = table.column("id").to_pylist()
        for found in encoded(paths, sizes, own, ids, TaskContext.get().partitionId(), last):
            rows = len(found["id"] if found["kind"] else found["low"])
            found["kind"] = np.full(rows, found["kind"], np.int32)
            for first in range(0, rows, 50_000):
                part = {k: v[first : first + 50_000] for k, v in found.items()}
                length = len(part["kind"])
                yield pa.RecordBatch.from_arrays([pa.array(part[f.name]).cast(f.type) if f.name in part else pa.nulls(length, f.type) for f in kinds], schema=kinds)

    return run


def _level(rows: DataFrame, shards: int, first_level: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    dealt = rows.repartitionByRange(shards, "path") if shards > 1 else rows.coalesce(1)
    kinds = to_arrow_schema(_parse_datatype_string(_SCHEMA))
    return written(dealt.sortWithinPartitions("path").mapInArrow(_shard(first_level, shards == 1, kinds), _SCHEMA), "trie")


def member_digests(convs: DataFrame) -> DataFrame:
    """(seq, ends_sha256): of the ids of the members that end at a path, ascending, joined by commas; seq is the path's MD5.

    Runs of ids are joined where they are sorted, so a path that very many share meets in one task as few long strings.
    """
    most = RUN_MEMBERS

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seqs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [0] + [i for i in range(1, len(seqs)) if seqs[i] != seqs[i - 1]] + [len(seqs)]
            runs = [(at, min(at + most, b)) for a, b in zip(starts, starts[1:]) for at in range(a, b, most)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([seqs[a] for a, _ in runs], pa.binary()), pa.array([ids[a] for a, _ in runs], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in runs], pa.string())],
                names=["seq", "first", "ids"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, hashlib.sha256()
        for batch in batches:
            seqs, sums = [], []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if seq == current:
                    state.update(b",")
                else:
                    if current is not None:
                        seqs.append(current)
                        sums.append(state.hexdigest())
                    current, state = seq, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary()), pa.array(sums, pa.string())], names=["seq", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["seq", "ends_sha256"])

    ids = convs.select(F.unhex(F.md5("path")).alias("seq"), "conv_id")
    runs = ids.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(joined, "seq binary, first bigint, ids string")
    return runs.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "seq binary, ends_sha256 string")


def nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS, spines: int = SPINES, least_turns: int = LEAST_TURNS) -> DataFrame:
    """The trie's nodes from (conv_id, path, sizes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest member; (conv_id, depth) tells nodes apart.
    """
    spark = paths.sparkSession
    convs = written(paths, "paths")
    rows = written(convs.groupBy("path", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("low")), "sequences")
    turns = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(1, math.ceil(turns / shard_turns), min(spark.sparkContext.defaultParallelism, turns // least_turns))
    levels = [_level(rows, shards, True)]
    while shards > 1:
        rows = levels[-1].where("kind = 1").select("id", "path", "sizes", "own")
        shards = min(math.ceil(rows.count() / spines), shards // 2)
        levels.append(_level(rows, shards, False))

    lows_above, found = None, None
    for k, level in reversed(list(enumerate(levels))):
        own = level.where("kind = 0").select("low", "depth", "n_convs", "n_children", "n_leaves", "saved", "seq", "parent_low", "link")
        if lows_above is not None:
            # The smallest member of a parent that was merged at a level above.
            linked = own.where("link is not null").join(lows_above, "link").withColumn("parent_low", F.element_at("lows", F.col("depth").cast("int"))).drop("lows")
            own = own.where("link is null").unionByName(linked)
        found = own.drop("link") if found is None else found.unionByName(own.drop("link"))
        if k:
            answers = level.where("kind = 2").select("id", "link", "cut", "lows")
            if lows_above is not None:
                up = answers.where("link is not null").join(lows_above.withColumnRenamed("lows", "_up"), "link")
                up = up.select("id", F.concat(F.slice("_up", F.lit(1), F.col("cut")), "lows").alias("lows"))
                answers = answers.where("link is null").select("id", "lows").unionByName(up)
            lows_above = answers.select(F.col("id").alias("link"), "lows")

    inner = found.where("seq is null").withColumn("ends_sha256", F.lit(EMPTY_SHA256)).drop("seq")
    ends = found.where("seq is not null").join(member_digests(convs), "seq").drop("seq")
    return inner.unionByName(ends).select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def _path(turns: Column) -> list[Column]:
    """path and sizes of an array of (digest, size)."""
    return [F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), "")).alias("path"), F.transform(turns, lambda t: t["size"]).alias("sizes")]


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int | None = None) -> DataFrame:
    """(conv_id, own): each conversation's turns in order, as (digest, size). With block, rows lie by conv_id - conv_id % block, in ``base``."""
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary")))
    key = F.col(conv_id).cast("long")
    slim = turns.where(key.isNotNull()).select(key.alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.length(what).alias("size")).alias("row"))
    keys = ["conv_id"]
    if block:
        slim = slim.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).repartition("base")
        keys = ["base", "conv_id"]
    grouped = slim.groupBy(*keys).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return grouped.select(*keys, F.transform("rows", lambda r: F.struct(r["digest"].alias("digest"), r["size"].alias("size"))).alias("own"))


def paths(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, path, sizes) of conversations as they are."""
    return conversations(turns, **columns).select("conv_id", *_path(F.col("own")))


def rebuilt_paths(turns: DataFrame, block: int = 100, heads: int = 6, **columns: str) -> DataFrame:
    """(conv_id, path, sizes) of conversations whose first h turns are those of their block's first conversation, h = crc32(id) % heads.

    Block and conversation are dealt once, by block; a block has at most ``block`` conversations (twice as many around id 0).
    """
    from pyspark.sql import Window

    own = conversations(turns, block=block, **columns)
    first = F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads - 1))
    with_head = own.withColumn("head", F.max(first).over(Window.partitionBy("base")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    built = with_head.withColumn("h", h).withColumn("turns", F.concat(head, F.slice("own", F.col("h") + 1, F.size("own"))))
    return built.select("conv_id", *_path(F.col("turns")))


#: crc32 of a decimal number's characters, as SQL has none.
_CRC32 = """xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
    lambda c, byte: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, byte)), 4294967295), 4294967295)"""

ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, k, digest, text FROM c JOIN t ON t.conv_id = c.base WHERE k <= h
  UNION ALL SELECT c.conv_id, k, digest, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE k > h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(digest, '') OVER w) AS node, length(text) AS size
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), m AS (
  SELECT * FROM p UNION ALL SELECT conv_id, 0, 'root', 0 FROM c
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saving FROM m GROUP BY node, depth
), parents AS (
  SELECT n.node, n.depth, m.node AS parent, q.conv_id AS parent_conv_id
  FROM nodes n JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 JOIN nodes q ON q.node = m.node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent
), subtrees AS (
  SELECT m.node, sum(CASE WHEN ch.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saving) AS saved_tokens
  FROM nodes n LEFT JOIN children ch ON ch.node = n.node JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node
), ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node
)
SELECT n.conv_id, n.depth, parents.parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN parents ON parents.node = n.node LEFT JOIN children ON children.node = n.node
JOIN subtrees ON subtrees.node = n.node LEFT JOIN ends ON ends.node = n.node
"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
