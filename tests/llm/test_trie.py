"""Conversation tries: against a brute-force trie over all prefixes, for one shard, many, and several levels of spines."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpuslens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, low int, `id` string"


def brute(sequences):
    members, ends, texts = defaultdict(list), defaultdict(list), {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    rows = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        rows.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
            sum(not children[n] for n in below), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def ordered(rows):
    """Turns of each conversation from (conv_id, turn, role, text)."""
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        if conv is not None:
            found[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    return {conv: [t for _, t in sorted(turns, key=lambda x: x[0])] for conv, turns in found.items()}


def collected(df):
    assert df.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(map(tuple, df.collect()), key=str)


def rows(seed, conversations, common):
    rng = random.Random(seed)
    out = []
    for conv in range(conversations):
        turns = common if rng.random() < 0.3 else rng.choice([0, 1, 2, 3, 5, 9])
        for t in range(max(turns, 1)):
            out.append((conv, t, rng.choice(["user", "system"]) if t % 3 == 0 else "user", "ab" if turns == common else rng.choice(["", "x", "é𝒳", "long text"]), "p", 1, "i"))
    rng.shuffle(out)
    return out


def test_findclose():
    rng = random.Random(3)
    for size in (1, 2, 40, 700, 3000):
        steps, left, depth = [1], size - 1, 1
        while left or depth > 1:
            if left and (depth == 1 or rng.random() < 0.55):
                steps.append(1)
                left, depth = left - 1, depth + 1
            else:
                steps.append(-1)
                depth -= 1
        steps.append(-1)
        stack, want = [], {}
        for i, s in enumerate(steps):
            if s > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.array(sorted(want))
        assert trie.Parentheses(np.array(steps, np.int8)).findclose(opens).tolist() == [want[i] for i in opens.tolist()]
    deep = np.array([1] * 5000 + [-1] * 5000, np.int8)
    assert trie.Parentheses(deep).findclose(np.arange(5000)).tolist() == list(range(9999, 4999, -1))


def test_range_minimum():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 300)
    first = rng.integers(0, 300, 500)
    size = np.array([rng.integers(1, 301 - f) for f in first])
    assert trie.range_minimum(values, first, size).tolist() == [values[f : f + s].min() for f, s in zip(first, size)]


@pytest.mark.parametrize("shard_turns, spines", [(250_000, 1024), (40, 4), (9, 4)])
def test_trie(spark, shard_turns, spines):
    data = rows(7, 60, 4)
    turns = spark.createDataFrame(data, SCHEMA)
    assert collected(trie.nodes(trie.paths(turns), shard_turns, spines)) == brute(ordered(data))


def test_rebuilt(spark):
    rng = random.Random(5)
    data = [r for r in rows(11, 230, 3) if r[0] != 200]
    data += [(1_000 + k, t, "user", rng.choice("ab"), "p", 1, "i") for k in range(3) for t in range(40)]
    own = ordered(data)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not turns for turns in want.values())
    turns = spark.createDataFrame(data, SCHEMA)
    assert collected(trie.nodes(trie.rebuilt_paths(turns), 50, 4)) == brute(want)


def test_nulls_ties_and_repeats(spark):
    data = [
        (1, 0, None, None, "p", 1, "i"), (1, None, "a", "first", "p", 1, "i"), (2, None, "a", "first", "p", 1, "i"),
        (2, 0, "", "", "p", 1, "i"), (2, 0, "", "", "p", 1, "i"), (3, 5, "a", "y", "p", 1, "i"), (3, 5, "a", "x", "p", 1, "i"),
        (4, 5, "a", "x", "p", 1, "i"), (4, 5, "a", "y", "p", 1, "i"), (None, 1, "a", "lost", "p", 1, "i"), (-7, 0, "ab", "c", "p", 1, "i"), (-8, 0, "a", "bc", "p", 1, "i"),
        (9, 0, "a", "t" * 2_000_000, "p", 1, "i"),
    ]
    found = collected(trie.nodes(trie.paths(spark.createDataFrame(data, SCHEMA)), 4, 4))
    assert found == brute(ordered(data))
    assert (3, 2, 3, 2, 0, 1, 1, hashlib.sha256(b"3,4").hexdigest()) in found


def test_empty_table(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert collected(trie.nodes(trie.rebuilt_paths(turns))) == []


def test_a_conversation_that_very_many_share(spark):
    data = [(c, t, "user", f"t{t}", "p", 1, "i") for c in range(3_000) for t in range(2)] + [(c, 0, "user", "t0", "p", 1, "i") for c in range(3_000, 3_010)]
    found = collected(trie.nodes(trie.paths(spark.createDataFrame(data, SCHEMA)), 250_000, 1024))
    assert found == brute(ordered(data))
