"""Token ids, packing and record files against the library and brute force."""

import collections
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import packing, records, tokens
from corpuslens.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def texts():
    rng = random.Random(3)
    parts = ["a", "Bc", "é", " ", " ", "  ", "\n", "\t", " ", "12", ".", "'s", "'", "!,", "<|endoftext|>", "日本", "\r\n", "_", "😀", "½"]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    return [*out, "", " ", "word " * 5000, "x" * 3000, "the cat. The cat, the\ncat; (the cat)"]


@pytest.mark.parametrize("ranks", [True, False])
def test_ids_are_the_library_s(monkeypatch, ranks):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 500)
    encoder, rows = tokens.Encoder(PATH), texts()
    assert encoder.fast is not None
    encoder.fast = encoder.fast if ranks else None
    got = [ids for a, b in tokens.in_parts(rows, 300) for ids in encoder.encode(rows[a:b])]
    assert [g.tolist() for g in got] == [library(t) for t in rows]


def docs(spark):
    rows = [(i * 2, t) for i, t in enumerate(texts()[-400:])]
    rng = random.Random(6)
    rows += [(None, None), (None, "null id"), (8, "again"), (8, "again"), *((10_000 + i, "some words " * rng.randint(1, 900)) for i in range(60))]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, offset string")


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for count in (0, 1, 2, 7, 300):
        sizes = rng.integers(1, 101, count)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, slow = [], {}
        for i in sorted(range(count), key=lambda i: -sizes[i]):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if k == len(room):
                room.append(100)
            slow[i] = (k, 100 - room[k])
            room[k] -= sizes[i]
        assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist())] == [slow[i] for i in range(count)]


@pytest.mark.parametrize("group", [8192, 20])
def test_packing(spark, group):
    rows, df = docs(spark)
    found = packing.pack(packing.pieces(df, PATH, capacity=64), capacity=64, group_pieces=group).collect()
    wanted = defaultdict(list)
    for d, t in rows:
        wanted[d].append(library(t) + [0])
    got, places = defaultdict(list), defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length, r.sequence_tokens, r.padded_tokens))
    for d, all_ids in wanted.items():
        expected = [(a, len(i[a : a + 64]), zlib.crc32(np.array(i[a : a + 64], "<u4").tobytes()), len(i)) for i in all_ids for a in range(0, len(i), 64)]
        assert sorted(got[d]) == sorted(expected)
    padding = 0
    for pieces in places.values():
        end = 0
        for offset, length, filled, padded in sorted(pieces):
            assert offset == end
            end += length
        assert end == filled <= 64 and padded == (end if end & (end - 1) == 0 else 64)
        padding += padded - end
    if group > 20:
        assert padding < 0.02 * sum(r.length for r in found)


def test_packing_an_empty_table(spark):
    assert packing.packed(docs(spark)[1].limit(0), PATH).collect() == []


def test_record_files(spark):
    rows, df = docs(spark)
    folder = scratch_path(spark, "records")
    manifest = records.write(df, PATH, folder)
    order = sorted(((d, library(t) + [2]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted((tuple(r) for r in records.read(spark, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [d for d, _ in order]
    at = 0
    for d, start, n, crc in got:
        assert start == at
        at += n
    crcs = sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in order if d is not None)
    assert sorted((d, n, c) for d, _, n, c in got if d is not None) == crcs
    files = sorted(manifest.collect())
    for r in files:
        keys = [records.read_at(r["file"], r["index"], k)[0] for k in range(r["documents"])]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sum(r["documents"] for r in files) == len(rows)
    ids = {d: i for d, i in order}
    number = random.Random(1).randrange(files[0]["documents"])
    key, found = records.read_at(files[0]["file"], files[0]["index"], number)
    assert key is None or key == 8 or found.tolist() == ids[key]


def test_damaged_record_files(spark, tmp_path):
    good = records.frame(records.payload(5, np.array([1, 70_000], np.uint32)))
    for at in (0, 9, 14, len(good) - 1):
        bad = good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
        for data in (bad, good[:-1]):
            path = tmp_path / "x"
            path.write_bytes(data)
            with open(path, "rb") as f, pytest.raises(ValueError):
                records.read_record(f, "x")
    path.write_bytes(good)
    with open(path, "rb") as f:
        key, ids = records.content(records.read_record(f, "x"))
        assert key == 5 and ids.tolist() == [1, 70_000] and records.read_record(f, "x") is None


def test_records_of_an_empty_table(spark):
    assert records.round_trip(docs(spark)[1].limit(0), PATH).collect() == []


def test_equal_rows_spread_over_groups(spark):
    """Half of the rows are one row: no group is much larger than the others, and each piece is placed once."""
    rows = [(None, None)] * 4_000 + [(7, "the same text")] * 1_000 + [(i, f"text {i}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = packing.pack(packing.pieces(df, PATH, capacity=16), capacity=16, group_pieces=200).select("doc_id", "sequence_id", "offset", "length").collect()
    assert len(found) == 8_000 and len({(r.sequence_id, r.offset) for r in found}) == 8_000
    sizes = collections.Counter(r.sequence_id >> 32 for r in found)
    assert len(sizes) >= 38 and max(sizes.values()) < 300
