"""SimHash near-duplicates against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from corpuslens.llm import simhash

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text, shingle=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \n", "One", "a b\x0bc", "É é A b c d e", *(" ".join(rng.choices(["x", "Yy", "ß", "zzz"], k=n)) for n in (3, 4, 5, 400))]
    for text in texts:
        assert simhash.fingerprint(text.encode(), 4) == slow_fingerprint(text)


@pytest.mark.parametrize("long_list", [2, 1024])
@pytest.mark.parametrize("distance", [2, 3, 4])
def test_links_connect_what_all_pairs_connect(monkeypatch, long_list, distance):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    monkeypatch.setattr(simhash, "MIDPOINTS", 3000)
    rng = random.Random(distance)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for s in seeds for _ in range(25)})
    masks = simhash._masks(distance)
    unsigned = [m & (2**64 - 1) for m in masks]
    keys = np.array([(i, p & m) for p in prints for i, m in enumerate(unsigned)], np.uint64)
    values = np.array([p for p in prints for _ in masks], np.uint64)
    a, b = simhash.linked(keys, values, distance, masks)
    place = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))
    for x, y in zip(a.tolist(), b.tolist()):
        parent[place[x]] = place[y]
    roots = []
    for i in range(len(prints)):
        while parent[i] != i:
            i = parent[i]
        roots.append(i)
    assert roots == slow_components(prints, distance)


def rows_of(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(15):
        words = rng.choices(vocabulary, k=120)
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(120)] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, "  ", "same text here", "same text here", "x " * 50_000]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_near_duplicates(spark):
    rows = rows_of(spark)
    got = {r.doc_id: (r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(prints)
    assert got == {d: (p, rows[r][0]) for (d, _), p, r in zip(rows, prints, roots)}
    assert len(set(roots)) < len(rows)


def test_one_of_each_keeps_all_columns_and_one_row(spark):
    rows = rows_of(spark)
    docs = spark.createDataFrame([(d, t, "s", d) for d, t in rows], "doc_id long, text string, root string, _row_hash long")
    kept = simhash.one_of_each(docs.union(docs))
    assert kept.columns == docs.columns
    roots = slow_components([slow_fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[r][0] for r in set(roots))


def test_null_ids_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c d e f g"), (7, "c d e f g")], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == [(7, 7), (None, 7), (None, None), (None, None)]
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(rows).collect() if r.doc_id) == [(7, "c d e f g")]
    assert simhash.one_of_each(rows).count() == 2


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(500, 400)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 500: 400, 400: 400}


def family(count, seed=3):
    """Distinct fingerprints: one template with up to six flips in its last 32 bits."""
    rng = np.random.default_rng(seed)
    flips = np.zeros(count, np.uint64)
    for _ in range(6):
        flips ^= np.where(rng.random(count) < 0.9, np.uint64(1) << rng.integers(0, 32, count).astype(np.uint64), np.uint64(0))
    return np.unique(np.uint64(0xABCDEF0123456789) ^ flips)


def test_a_long_list_leaves_one_edge_a_member_and_a_pass_sees_its_own_midpoints(monkeypatch):
    """What is sorted over all passes is each member's 529 midpoints once; no edge outlives its pass."""
    monkeypatch.setattr(simhash, "MIDPOINTS", 50_000)
    members = family(2000)
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(simhash.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    a, b = simhash._link_long(members, 0xFFFFFFFF, 4)
    assert sum(sizes) == 529 * len(members) and max(sizes) < 4 * 50_000
    assert len(a) == len(set(a.tolist())) < len(members)
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= 4
    labels = np.arange(len(members))
    labels[a] = b
    assert (labels[labels] == labels).all()
    same = labels[:, None] == labels[None, :]
    assert same[near].all()  # linked pairs are in one component, and components are no larger than that
    for root in np.unique(labels):
        group, seen = np.flatnonzero(labels == root), {root}
        while (more := set(np.flatnonzero(near[sorted(seen)].any(axis=0)).tolist())) != seen:
            seen = more
        assert seen == set(group.tolist())


@pytest.mark.parametrize("distance", [3, 4])
def test_parts_of_a_long_list_go_to_several_tasks(spark, monkeypatch, distance):
    for name, value in (("LONG_LIST", 20), ("PART_MIDPOINTS", 40 * 529), ("MIDPOINTS", 5000)):
        monkeypatch.setattr(simhash, name, value)
    prints = [int(x) for x in family(300)] + [1, 3, 2**60]
    got = simhash.components(simhash.links(spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fingerprint long"), distance))
    roots = {r.node & (2**64 - 1): r.root for r in got.collect()}
    groups = {}
    for p, r in zip(prints, slow_components(prints, distance)):
        groups.setdefault(r, set()).add(p)
    found = {}
    for p in prints:
        found.setdefault(roots.get(p, p - (p >> 63 << 64)), set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))
