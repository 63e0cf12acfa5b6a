"""WARC archives: round trip, revisits, and salvage of damaged files."""

import hashlib
import io

import pytest

from corpuslens.llm import warc
from corpuslens.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest int, refers_to string"


def rows():
    long = "<p>é</p>" * 400
    out = []
    for i in range(1, 80):
        html = [long, "short", "WARC/1.1\r\n" * 200, None, "", f"<b>{i}</b>" * 300][i % 6]
        out.append((i, None if i % 9 == 0 else f"http://x/{i}%\r\n", html))
    return [*out, (500, "big", "x" * 3_000_000), (79, "again", out[-1][2]), (None, "no id", long), (None, "no id", "y" * 2000)]


def expected(pages):
    best = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, url, html in pages:
        data = (html or "").encode()
        last = best.get(data)
        revisit = last is not None and i != last
        out.append((i, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None, None if revisit else data))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, monkeypatch, compress):
    pages = rows()
    df = spark.createDataFrame([(*p, 1, "z") for p in pages], SCHEMA).repartition(3)
    found = warc.round_trip(df, compress=compress).collect()
    got = sorted(((*r[:6], bytes(r[6]) if r[6] is not None else None) for r in found), key=str)
    assert got == expected(pages)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = []
    for i in range(40):
        html = f"<p>page {i}</p>".encode() * (30 + i)
        data = warc.record(i, "u", html, hashlib.sha1(html).hexdigest(), None)
        parts.append(warc.member(data) if compress else data)
    starts = [sum(map(len, parts[:i])) for i in range(41)]
    whole = b"".join(parts)

    def read(data):
        found = list(warc.salvage(io.BytesIO(data), len(data)))
        pages = [warc.page_of(f[2], f[3])[0] for f in found if f[0] == "record"]
        return pages, [(f[1], f[2]) for f in found if f[0] == "gap"]

    assert read(whole) == (list(range(40)), [])
    hurt = bytearray(whole)
    for k in (3, 4, 20):
        hurt[starts[k] + len(parts[k]) // 2] ^= 0xFF
    assert read(bytes(hurt)) == (
        [i for i in range(40) if i not in (3, 4, 20)],
        [(starts[3], starts[5] - starts[3]), (starts[20], len(parts[20]))],
    )
    assert read(whole[:-5]) == (list(range(39)), [(starts[39], len(parts[39]) - 5)])
    junk = b"junk \x1f\x8b\x08 WARC/1. junk"
    assert read(junk + whole) == (list(range(40)), [(0, len(junk))])
    cut = whole[: starts[10]] + whole[starts[10] + 7 :]
    pages, gaps = read(cut)
    assert pages == [i for i in range(40) if i != 10] and gaps == [(starts[10], len(parts[10]) - 7)]
    assert read(b"") == ([], []) and read(junk) == ([], [(0, len(junk))])


def test_gaps_are_reported_and_later_records_recovered(spark):
    from pyarrow import fs

    pages = [(i, "u", f"page {i} " * 50) for i in range(30)]
    folder = scratch_path(spark, "warc")
    manifest = warc.write(warc.with_revisits(spark.createDataFrame([(*p, 1, "z") for p in pages], SCHEMA).coalesce(1)), folder)
    file = manifest.first()
    data = bytearray(fs.LocalFileSystem().open_input_file(file["file"]).read())
    start = data.find(warc.MEMBER, len(data) // 2)
    data[start + 25] ^= 0x55
    with fs.LocalFileSystem().open_output_stream(file["file"], compression=None) as f:
        f.write(bytes(data))
    assert warc.read(manifest).count() == 29
    gap = warc.gaps(manifest).collect()
    assert len(gap) == 1 and gap[0]["offset"] == start and gap[0]["length"] > 25


@pytest.mark.parametrize("compress", [True, False])
def test_headers_of_any_length(spark, compress):
    """A url of 100,000 characters, and one whose headers go beyond what is read at once; another page refers to the first."""
    long, longer = "http://x/" + "%a" * 50_000, "http://y/" + "WARC/1.1 %" * 120_000
    pages = [(1, "http://a", "first" * 300), (9, long, "body" * 500), (2, "http://b", "body" * 500), (3, longer, "last"), (4, "http://c", "x")]
    found = warc.round_trip(spark.createDataFrame([(*p, 1, "z") for p in pages], SCHEMA).coalesce(1), compress=compress).collect()
    got = sorted(((*r[:6], bytes(r[6]) if r[6] is not None else None) for r in found), key=str)
    assert got == expected(pages)


def test_headers_without_end_stop_at_the_next_version_line():
    html = b"<p>page</p>"
    good = warc.record(2, "u", html, hashlib.sha1(html).hexdigest(), None)
    for cut in (b"WARC/1.1\r\nWARC-Type: response\r\n", b"WARC/1.1\r\nWARC-Target-URI: " + b"a" * 3_000_000 + b"\r\n"):
        found = list(warc.salvage(io.BytesIO(cut + good), len(cut + good)))
        assert [f[:3] for f in found[:1]] == [("gap", 0, len(cut))]
        assert [(f[1], f[3]) for f in found[1:]] == [(len(cut), html)]
