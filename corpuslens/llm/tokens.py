"""Token ids of many texts with a public tokenizer, for use in tasks.

Where a byte-level BPE's merges stand in the order of their ids, the ids are ranks, and tiktoken encodes the texts. Texts with the
string of a special token, and those its pattern can't take (a million blanks in a row), go to the tokenizers library.

For other vocabularies, the library encodes each distinct piece between blanks once; its ids are kept in a table of bounded size. A byte-level
BPE splits a text before its merges, and never inside "non-blank, blank, non-blank" but before the blank, so the ids of a text are
those of its pieces, each with its leading blank. Texts with a blank inside or at the end of longer white space are encoded whole.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np
from pyspark import cloudpickle

from corpuslens.llm.common import kept

#: A blank that is not the last character of its run of white space.
RUN = re.compile(r"\s (?!\S)")
#: A piece that keeps its ids beside others of the kind: no white space at either end.
PLAIN = re.compile(r"\S(?:.*\S)?", re.DOTALL)
#: Marks that the tokenizer's pattern splits off from letters, in any number.
MARKS = ".,;:!?"
#: Pieces whose ids are kept by a worker; the table is emptied when it is full. A longer piece is not kept.
KEPT_PIECES = 1_000_000
LONGEST_PIECE = 64


#: The fixed pattern that byte-level vocabularies split texts by before their merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_encoder(library):
    """tiktoken's encoder of a tokenizers library's byte-level vocabulary without its special tokens; None where ids are no ranks."""
    model = json.loads(library.to_str())
    first = model["pre_tokenizer"] or {}
    if model["normalizer"] is not None or first.get("type") != "ByteLevel" or not first.get("use_regex") or first.get("add_prefix_space"):
        return None
    vocabulary, special, alphabet = library.get_vocab(), library.get_added_tokens_decoder(), byte_alphabet()
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
    if not merged or any(vocabulary[left] >= vocabulary[right] for left, right in zip(merged, merged[1:])):
        return None
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if i not in special}
    if len(ranks) != len(merged) + 256 or not all(bytes([b]) in ranks for b in range(256)):
        return None
    import tiktoken

    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as unsigned 32-bit arrays, equal to the library's for each whole text."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = rank_encoder(self.library)
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        special = set(self.library.get_added_tokens_decoder())
        # One character of the vocabulary's alphabet stands for one byte; special tokens are written as they are.
        vocabulary = self.library.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token.encode()) if i in special else len(token)
        self.narrow = len(self.lengths) <= 65536

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, np.uint16 if self.narrow else np.uint32).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces after a blank. Marks after letters are encoded apart, as the library splits there, too. What is
        plain is encoded as one text, which is cut at its bytes."""
        ends_in_marks = {p: core for p in new if p[-1:] in MARKS and (core := p.rstrip(MARKS)).isalpha()}
        base = {p for p in new if p not in ends_in_marks} | {c for c in ends_in_marks.values() if c not in self.known}
        odd = [p for p in base if not PLAIN.fullmatch(p)]
        found = dict(zip(odd, self._library([" " + p for p in odd])))
        plain = [p for p in base if p not in found]
        for at in range(0, len(plain), 20_000):
            block = plain[at : at + 20_000]
            ids = np.array(self.library.encode(" " + " ".join(block), add_special_tokens=False).ids, np.uint32)
            ends = np.cumsum(self.lengths[ids])
            wanted = np.cumsum([len(p.encode()) + 1 for p in block])
            cuts = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[cuts - 1], wanted):
                raise ValueError("the tokenizer is not a byte-level BPE that splits at blanks")
            data, first = self._bytes(ids), 0
            for piece, last in zip(block, ((2 if self.narrow else 4) * cuts).tolist()):
                found[piece] = data[first:last]
                first = last
        for piece, core in ends_in_marks.items():
            marks = piece[len(core) :]
            if marks not in self.marks:
                self.marks[marks] = self._library([marks])[0]
            found[piece] = (found.get(core) or self.known[core]) + self.marks[marks]
        return found

    def _ranked(self, text: str) -> list[int]:
        if not any(token in text for token in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:
                pass
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array for each text."""
        if self.fast is not None:
            return [np.array(self._ranked(text), np.uint32) for text in texts]
        whole = [i for i, text in enumerate(texts) if RUN.search(text)]
        cut = [[""] if RUN.search(text) else text.split(" ") for text in texts]
        starts = dict(zip(whole, self._library([texts[i] for i in whole])))
        heads = [i for i, parts in enumerate(cut) if parts[0] and i not in starts]
        starts |= zip(heads, self._library([cut[i][0] for i in heads]))
        flat = [part for parts in cut for part in parts[1:]]
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        found = list(map(self.known.get, flat))
        places = [i for i, ids in enumerate(found) if ids is None]
        if places:
            fresh = self._pieces(list({flat[i] for i in places}))
            self.known.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST_PIECE)
            for i in places:
                found[i] = fresh[flat[i]]
        out, at = [], 0
        for i, parts in enumerate(cut):
            after = b"".join(found[at : at + len(parts) - 1])
            at += len(parts) - 1
            out.append(np.frombuffer(starts.get(i, b"") + after, np.uint16 if self.narrow else np.uint32).astype(np.uint32))
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def in_parts(texts: list, characters: int = 2_000_000):
    """(first, last) places of runs of texts with about so many characters, one text at least."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 16
        if size >= characters:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
