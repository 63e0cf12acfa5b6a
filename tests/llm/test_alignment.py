"""Cross-tokenizer alignment: against the two libraries on whole texts and a plain walk over byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpuslens.llm import alignment, tokens
from corpuslens.llm.queries import tokenizer

A, B = tokenizer(), tokenizer("piece_bpe_32k.model")
LIBRARY_A, LIBRARY_B = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
LIBRARY_A.encode_special_tokens = True
ALPHABET = tokens.byte_alphabet()
ODD = [
    None, "", " ", "a", "a  b", " lead", "trail ", "\n\n x\t y ", "▁x y", "<|endoftext|> and <s>", "日本 語 𝒳é", "é ﬁ ①", "​   　", "no-blanks" * 300,
    "x" * 5000, "café naïve  \r\n end", "'s it's '' \"", "0123 4567 89", "\x00 \x1f", "<0x41> <unk>",
]


def bytes_b(i):
    piece = LIBRARY_B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if LIBRARY_B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """(ids of A, ids of B, groups, linked pairs) of a text."""
    if not text:
        return None
    a, b = LIBRARY_A.encode(" " + text, add_special_tokens=False).ids, LIBRARY_B.encode(text)
    raw_a, raw_b = [bytes(ALPHABET[c] for c in LIBRARY_A.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
    if b"".join(raw_a) != b" " + text.encode() or b"".join(raw_b) != b" " + text.encode():
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
    shared = sorted(set(ends_a) & set(ends_b))
    groups, links, first = [], [], (0, 0)
    for end in shared:
        last = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[first[0] : last[0]])) + "|" + ",".join(map(str, b[first[1] : last[1]])))
        links.append((a[last[0] - 1], b[last[1] - 1]))
        first = last
    return a, b, groups, links


def expected(docs):
    found = [(i, plain(t)) for i, t in docs]
    count = Counter(x for _, f in found if f for x in f[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for i, f in found:
        if f is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            rows.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(rows, key=str)


def aligned(docs):
    df = alignment.alignment(docs, A, B)
    assert df.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark, sf_dir):
    from corpuslens.llm.queries import op13_cross_tokenizer_alignment

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(i, t) for i, t in docs if t is None or len(t) < 30_000] if sf_dir.endswith("sf0.1") else docs
    assert sorted(map(tuple, op13_cross_tokenizer_alignment(spark, sf_dir).collect()), key=str) == expected(docs)


def test_odd_texts_repeated_rows_and_clashing_columns(spark):
    docs = list(enumerate(ODD)) + [(3, "a"), (None, "the end"), (None, "the end"), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, "x", [2]) for i, t in docs], "doc_id long, text string, n_a int, pairs string, times array<int>")
    got = aligned(frame)
    assert got == expected(docs)
    assert (8, 0, 0, 0, 0, 0, 0, "") in got and sum(r[1] > 0 for r in got) > 15


def test_empty_table(spark):
    assert aligned(spark.createDataFrame([], "doc_id long, text string")) == []


def test_parts_of_long_texts(spark, monkeypatch):
    text = "Some words here,\nothers  there. " * 40 + "unbroken" * 60 + " and the end"
    assert len(list(alignment.parts(text, 100))) > 8 and "".join(alignment.parts("ab", 1)) == "ab"
    assert " ".join(alignment.parts(text, 100)) == text
    docs = [(1, text), (2, "short"), (3, "▁" + text), (4, text + "▁")]
    monkeypatch.setattr(alignment, "PART", 100)
    assert aligned(spark.createDataFrame(docs, "doc_id long, text string")) == expected(docs)


@pytest.mark.parametrize("kept", [0, 10, 1000])
def test_memory_of_windows_does_not_change_results(kept, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", kept)
    own = alignment.Aligner(alignment.byte_level_side(A), alignment.piece_side(B))
    texts = ["the quick brown fox and the dog", "the fox", "thequickbrown  fox", "the fox"] * 3
    for _ in range(2):
        for text, (n_a, n_b, groups, linked) in zip(texts, own.aligned(texts)):
            a, b, want, links = plain(text)
            assert (n_a, n_b, groups) == (len(a), len(b), ";".join(want))
            assert linked.tolist() == [x * 32_000 + y for x, y in links]


def test_equal_hashes_are_told_apart(monkeypatch):
    own = alignment.Aligner(alignment.byte_level_side(A), alignment.piece_side(B))
    flat = [np.array([5, 6, 7, 5]), np.array([9, 9, 8, 9])]
    cuts = [np.array([0, 1, 2, 3, 4])] * 2
    first, kind = own._distinct(flat, cuts)
    assert kind[0] == kind[3] and len(set(kind.tolist())) == 3 and kind[first].tolist() == [0, 1, 2]
    real = np.unique

    def merged(values, **options):
        return real(np.zeros_like(values) if values.dtype == np.uint64 else values, **options)

    monkeypatch.setattr(np, "unique", merged)
    first, kind = own._distinct(flat, cuts)
    assert kind.tolist() == [0, 1, 2, 0] and first.tolist() == [0, 1, 2]
