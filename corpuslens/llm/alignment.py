"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, document by document and over the corpus.

A is a byte-level BPE, B a sentencepiece model that puts a blank before the text; A reads the text with one blank before it. Both
encode whole texts, where the strings of special tokens are ordinary text. Tokens are then known by their bytes. Where a
space-marked token begins at the same byte on both sides, the tokens before it share an end: such anchors split a document into windows
of ids, and a window's groups (cut where both sides end a token) and links (tokens of either side that end together) depend on its ids
alone. They are kept by the tuple of ids, in a table of bounded size, and its bytes are compared on both sides and with the text.

A linked pair's bytes are one a suffix of the other's, so the pairs that a corpus can hold are bounded by the two vocabularies (each
token has at most as many suffixes as bytes): their corpus-wide counts go to every task. Texts are encoded once; per document its pairs
and how often each occurs are written, counted over all documents, and read again with the counts.

A text that is null or empty, or that one side does not give back byte for byte, has no tokens: zeros and an empty string. Repeated
rows and ids, null ids included, are documents each. Texts beyond PART characters are handled in parts, cut before a single blank between other
characters, where no piece of B reaches across (checked in its vocabulary) and A splits, too.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.llm import tokens
from corpuslens.llm.common import kept, written

#: Windows that a worker keeps; the table is emptied when it is full. A window of more tokens is not kept.
KEPT_WINDOWS = 300_000
LONGEST_WINDOW = 64
#: Characters that are encoded at once.
PART = 2_000_000
SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")


class Side:
    """One vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, encode, token_bytes: list[bytes]) -> None:
        self.encode, self.token_bytes = encode, token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.marked = np.array([b[:1] == b" " for b in token_bytes], bool)


def byte_level_side(path: str) -> Side:
    """The ids of each text with a blank before it, by ranks where the vocabulary has them."""
    from tokenizers import Tokenizer

    library, alphabet = Tokenizer.from_file(path), tokens.byte_alphabet()
    library.encode_special_tokens = True
    vocabulary, special = library.get_vocab(), library.get_added_tokens_decoder()
    names = [""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        names[i] = token
    token_bytes = [name.encode() if i in special else bytes(alphabet[c] for c in name) for i, name in enumerate(names)]
    fast = tokens.rank_encoder(library)

    def one(text: str) -> list[int]:
        if fast is not None:
            try:
                return fast.encode_ordinary(text)
            except ValueError:  # a text that the pattern can't take, such as a million blanks in a row
                pass
        return library.encode(text, add_special_tokens=False).ids

    return Side(lambda texts: [np.array(one(" " + t), np.int64) for t in texts], token_bytes)


def piece_side(path: str) -> Side:
    """The ids of each text; the model adds the blank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i))):
        raise ValueError("the model has pieces that reach across a blank")
    token_bytes = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda texts: [np.array(ids, np.int64) for ids in model.encode(texts, num_threads=1)], token_bytes)


class Aligner:
    """Groups and links of the tokens of two vocabularies."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        self.narrow = max(len(a.token_bytes), len(b.token_bytes)) <= 65536
        self.known: dict[bytes, tuple[str, bytes | None]] = {}
        most = max(len(a.token_bytes), len(b.token_bytes))
        # The decimal digits of each id, and a place for what follows it.
        self.digits = np.zeros((most, len(str(most)) + 1), np.uint8)
        for i in range(most):
            self.digits[i, : len(str(i))] = np.frombuffer(str(i).encode(), np.uint8)

    def _align(self, flat: list[np.ndarray], cuts: list[np.ndarray], windows: np.ndarray) -> list[tuple[str, bytes | None]]:
        """(groups as text, linked pairs as a * |B| + b) of some windows; the pairs are None where the two sides' bytes differ."""
        ids, ends, raws, last = [], [], [], []
        for side, own, at in zip((self.a, self.b), flat, cuts):
            sizes = at[windows + 1] - at[windows]
            stops = np.cumsum(sizes)
            own = own[np.arange(int(stops[-1])) + np.repeat(at[windows] - stops + sizes, sizes)]
            ids.append(own)
            ends.append(np.cumsum(side.lengths[own]))
            raws.append(b"".join([side.token_bytes[i] for i in own.tolist()]))
            last.append(stops - 1)
        at = np.searchsorted(ends[1], ends[0])
        ends_a = ends[1][at] == ends[0]
        ends_b = np.zeros(len(ids[1]), bool)
        ends_b[at[ends_a]] = True
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        pairs = (ids[0][ends_a] * len(self.b.token_bytes) + ids[1][ends_b]).tobytes()
        # The text: each group's ids of A, then its ids of B, each followed by its mark.
        place_a = np.arange(len(ids[0])) + np.concatenate([[0], np.flatnonzero(ends_b) + 1])[group_a]
        place_b = np.arange(len(ids[1])) + (np.flatnonzero(ends_a) + 1)[group_b]
        items, marks = np.empty(len(ids[0]) + len(ids[1]), np.int64), np.full(len(ids[0]) + len(ids[1]), ord(","), np.uint8)
        items[place_a], items[place_b] = ids[0], ids[1]
        marks[place_a[ends_a]], marks[place_b[ends_b]] = ord("|"), ord(";")
        table = self.digits[items]
        table[:, -1] = marks
        shown = table > 0
        text = table[shown].tobytes().decode()
        text_ends = np.cumsum(shown.sum(axis=1))[place_b[last[1]]].tolist()
        pair_ends = (8 * (group_b[last[1]] + 1)).tolist()
        out = []
        from_text = from_pair = 0
        for to_text, to_pair in zip(text_ends, pair_ends):
            out.append((text[from_text : to_text - 1], pairs[from_pair:to_pair]))
            from_text, from_pair = to_text, to_pair
        if raws[0] != raws[1]:
            bounds = [0, *ends[0][last[0]].tolist()]
            for i, (first, stop) in enumerate(zip(bounds, bounds[1:])):
                if raws[0][first:stop] != raws[1][first:stop]:
                    out[i] = "", None
        return out

    def _distinct(self, flat: list[np.ndarray], cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(a window of each kind, the kind of each window); windows are ids between cuts, on both sides."""
        mixed = np.zeros(len(cuts[0]) - 1, np.uint64)
        steps = []
        for ids, at, base in zip(flat, cuts, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            sizes = np.diff(at)
            place = np.arange(len(ids)) - np.repeat(at[:-1], sizes)
            powers = np.cumprod(np.full(int(sizes.max()) + 1, base, np.uint64))
            own = np.add.reduceat((ids.astype(np.uint64) + np.uint64(1)) * powers[place], at[:-1])
            mixed = (mixed ^ (own + sizes.astype(np.uint64))) * np.uint64(base)
            steps.append((sizes, place))
        _, first, kind = np.unique(mixed, return_index=True, return_inverse=True)
        for ids, at, (sizes, place) in zip(flat, cuts, steps):
            same = first[kind]
            if not np.array_equal(sizes, sizes[same]) or not np.array_equal(ids, ids[np.repeat(at[same], sizes) + place]):
                # Two windows with one hash: tell them apart by their ids.
                numbers: dict[bytes, int] = {}
                keys = self._keys(flat, cuts, np.arange(len(mixed)))
                kind = np.array([numbers.setdefault(k, len(numbers)) for k in keys])
                return np.unique(kind, return_index=True)[1], kind
        return first, kind

    def _keys(self, flat: list[np.ndarray], cuts: list[np.ndarray], windows: np.ndarray) -> list[bytes]:
        """The id tuples of some windows, as bytes: the number of ids of A, those ids, and those of B."""
        sizes = [at[windows + 1] - at[windows] for at in cuts]
        stops = np.cumsum(sizes[0] + sizes[1] + 2)
        begin = stops - sizes[0] - sizes[1] - 2
        held = np.empty(int(stops[-1]), np.uint16 if self.narrow else np.uint32)
        held[begin], held[begin + 1] = sizes[0] & 0xFFFF, sizes[0] >> 16
        for ids, at, size, to in zip(flat, cuts, sizes, (begin + 2, begin + 2 + sizes[0])):
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            held[np.repeat(to, size) + place] = ids[np.repeat(at[windows], size) + place]
        raw, ends = held.tobytes(), (held.itemsize * stops).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def aligned(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray] | None]:
        """(tokens of A, tokens of B, groups as text, linked pairs in order) of each text; None if a side's bytes differ from it."""
        out: list = [None] * len(texts)
        sides = list(zip(self.a.encode(texts), self.b.encode(texts)))
        fit = [i for i, (ids_a, ids_b) in enumerate(sides) if len(ids_a) and len(ids_b) and self.a.lengths[ids_a].sum() == self.b.lengths[ids_b].sum()]
        if not fit:
            return out
        # All texts in a row: their bytes begin at the same places on both sides.
        flat, starts, marks, heads = [], [], [], []
        for k, side in enumerate((self.a, self.b)):
            ids = np.concatenate([sides[i][k] for i in fit]).astype(np.int64)
            long = side.lengths[ids]
            head = np.concatenate([[0], np.cumsum([len(sides[i][k]) for i in fit])])
            marked = side.marked[ids]
            marked[head[:-1]] = True
            flat.append(ids)
            starts.append(np.cumsum(long) - long)
            marks.append(np.flatnonzero(marked))
            heads.append(head)
        at = np.minimum(np.searchsorted(starts[1][marks[1]], starts[0][marks[0]]), len(marks[1]) - 1)
        anchor = starts[1][marks[1][at]] == starts[0][marks[0]]
        cuts = [np.append(marks[0][anchor], len(flat[0])), np.append(marks[1][at[anchor]], len(flat[1]))]
        first, kind = self._distinct(flat, cuts)
        if len(self.known) > KEPT_WINDOWS:
            self.known = {}
        keys = self._keys(flat, cuts, first)
        found = list(map(self.known.get, keys))
        new = [i for i, window in enumerate(found) if window is None]
        if new:
            most = (2 if self.narrow else 4) * (LONGEST_WINDOW + 2)
            for i, window in zip(new, self._align(flat, cuts, first[new])):
                found[i] = window
                if len(keys[i]) <= most:
                    self.known[keys[i]] = window
        groups, pairs = zip(*found)
        differ = {w for w, links in enumerate(pairs) if links is None}
        bounds = np.searchsorted(cuts[0], heads[0])
        given = b"".join(b" " + texts[i].encode() for i in fit)
        read = b"".join(map(self.a.token_bytes.__getitem__, flat[0].tolist()))
        if read != given:
            ends = [0, *np.cumsum([len(texts[i].encode()) + 1 for i in fit]).tolist()]
            byte_heads = [0, *np.cumsum(self.a.lengths[flat[0]])[heads[0][1:] - 1].tolist()]
            wrong = {i for n, i in enumerate(fit) if given[ends[n] : ends[n + 1]] != read[byte_heads[n] : byte_heads[n + 1]]}
        else:
            wrong = set()
        for n, i in enumerate(fit):
            own = kind[bounds[n] : bounds[n + 1]].tolist()
            if i in wrong or differ and not differ.isdisjoint(own):
                continue
            linked = np.frombuffer(b"".join(map(pairs.__getitem__, own)), np.int64)
            out[i] = len(sides[i][0]), len(sides[i][1]), ";".join(map(groups.__getitem__, own)), linked
        return out


def parts(text: str, most: int = PART) -> Iterator[str]:
    """The text without the blanks it is cut at: before a single blank, ``most`` characters or more apart."""
    at = 0
    while len(text) - at > most and (cut := SINGLE_BLANK.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def aligner(byte_level: str, piece: str) -> Aligner:
    """The worker's aligner."""
    return kept(f"aligner {byte_level} {piece}", lambda: Aligner(byte_level_side(byte_level), piece_side(piece)))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def links(docs: DataFrame, byte_level: str, piece: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every document; pairs hold a * |B| + b."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    added = {c: F.lit(0).cast("long") for c in _COUNTS} | {"groups_sha256": F.lit("")}
    schema = source.drop("text").withColumns(added | {"pairs": F.array(F.lit(0).cast("long")), "times": F.array(F.lit(0).cast("long"))}).schema
    part_size = PART

    nothing = (0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64)

    def document(found: Iterator[tuple | None]) -> tuple:
        sums, state, pairs, times = [0, 0, 0, 0], hashlib.sha256(), [], []
        for part in found:
            if part is None:
                return nothing
            n_a, n_b, groups, linked = part
            state.update((";" if sums[0] else "").encode() + groups.encode())
            distinct, n = np.unique(linked, return_counts=True)
            pairs.append(distinct)
            times.append(n)
            sums = [x + y for x, y in zip(sums, (n_a, n_b, len(linked), len(linked)))]
        if len(pairs) > 1:
            distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
            pairs, times = [distinct], [np.bincount(place, weights=np.concatenate(times)).astype(np.int64)]
        return sums, state.hexdigest(), pairs[0], times[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_level, piece)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in tokens.in_parts(texts):
                some = texts[first:last]
                short = iter(own.aligned([t for t in some if 0 < len(t) <= part_size]))
                rows = []
                for t in some:
                    if not t:
                        rows.append(nothing)
                    elif len(t) <= part_size:
                        rows.append(document([next(short)]))
                    else:
                        rows.append(document(own.aligned([p])[0] for p in parts(t, part_size)))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]), pa.int64())) for k in (2, 3)]
                sums = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *sums, pa.array([r[1] for r in rows], pa.string()), *lists], names=["doc_id", *_COUNTS, "groups_sha256", "pairs", "times"])

    return source.mapInArrow(run, schema)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each pair, and whether none with the same id of B has more."""
    counted = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % size_b))
    return counted.select("pair", "n", (F.col("n") == most).alias("best"))


def alignment(docs: DataFrame, byte_level: str, piece: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    found = written(links(docs, byte_level, piece, doc_id, text), "links")
    counts = pair_counts(found, len(piece_side(piece).token_bytes)).toArrow()
    order = np.argsort(counts.column("pair").to_numpy())
    pair, n, best = (counts.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    schema = found.drop("pairs", "times").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(np.diff(pairs.offsets.to_numpy()))])
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            sums = []
            for values in (times * best[at], times * n[at]):
                total = np.concatenate([[0], np.cumsum(values)])
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
            own = [batch.column(c) for c in ("doc_id", *_COUNTS, "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*own, *sums], names=["doc_id", *_COUNTS, "groups_sha256", "n_best", "count_sum"])

    return found.mapInArrow(run, schema).select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
