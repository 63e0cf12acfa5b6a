"""Sharding against a plain minimax search, and its laws."""

import random
import zlib
from collections import defaultdict

import pytest

from corpuslens.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard int"


def slow_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("cells", [4, 7, 4096])
def test_cuts_are_those_of_the_smallest_capacity(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    rng = random.Random(cells)
    for count, shards in ((1, 1), (3, 2), (60, 5), (300, 16)):
        sizes = [rng.choice([1, 1, 2, 50, rng.randint(1, 400)]) for _ in range(count)]
        ends, at = [], 100
        for s in sizes:
            at += s
            ends.append(at)
        cuts = sharding.Ends(spark.createDataFrame([(e,) for e in ends], "end long").coalesce(1), 100, at).cuts(shards)
        capacity, wanted, start = slow_capacity(sizes, shards), [], 100
        for _ in range(shards):
            start = max([e for e in ends if e <= start + capacity] + [start])
            wanted.append(start)
        assert cuts == wanted


def check(rows, found, shards, near):
    crcs = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == crcs
    slots, sizes, of = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in found:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        of[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    if near is not None:
        fair = sum(sizes.values()) / shards
        assert len(sizes) == shards and all(abs(s - fair) <= near for s in sizes.values())


def test_near_equal_shards(spark):
    rng = random.Random(1)
    rows = [(i, f"{i} " * rng.randint(1, 40)) for i in range(2000)] + [(5000 + i, "copy of a text " * 8) for i in range(60)] + [(7, None), (None, ""), (None, None), (7, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(5)
    check(rows, sharding.shards_of(df, 16).collect(), 16, 600)


def test_a_large_group_is_a_shard_of_its_own(spark):
    rng = random.Random(2)
    rows = [(i, f"{i} " * rng.randint(1, 40)) for i in range(500)] + [(9000 + i, "hot " * 30) for i in range(400)]
    found = sharding.shards_of(spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA), 8).collect()
    check(rows, found, 8, None)
    sizes = defaultdict(int)
    for r in found:
        sizes[r.shard] += r.size
    hot = 400 * 121
    assert sizes[0] == hot
    assert max(sizes[s] for s in range(1, 8)) - min(sizes[s] for s in range(1, 8)) < 1500


def test_small_and_empty_tables(spark):
    for rows in ([], [(1, "a")], [(1, "a"), (2, "a")], [(None, None)], [(i, "x" * i) for i in range(5)]):
        found = sharding.shards_of(spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA), 16).collect()
        check(rows, found, 16, None)
