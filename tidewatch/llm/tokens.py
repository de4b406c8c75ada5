"""Whole-text tokenisation with a public tokenizer file, chunk by chunk.

Texts are cut where no token can cross. A batch's chunks are told apart as Arrow columns, so
Python looks at each distinct one only; its word, or all of it, is encoded by the tokenizers
library once per worker and remembered (emptied when it reaches ``CACHE`` of them, of
``LONG`` characters at most, so tens of MB). All texts' ids are then gathered at once. Texts in
which a cut could change the result go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewatch.llm.common import ragged

CACHE, LONG = 500_000, 48
#: White space on both sides of a space lets a token cross it.
CROSSING = re.compile(r"\s \s")
#: A Latin word, and the punctuation that may follow it: one pre-token each in either tokenizer.
LATIN = "[A-Za-zªµºÀ-ÖØ-öø-ÿ]+"
TAIL = ".,!?;:|$&*%#"
#: The end of a line between two words: a pre-token too where a chunk keeps the space before it.
LINED = re.compile(rf"({LATIN})([{re.escape(TAIL)}]*)\n({LATIN})([{re.escape(TAIL)}]*)")
#: Characters on which Python's and the tokenizers' notion of white space may differ.
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")


class ChunkEncoder:
    """``ids(text)``: the library's ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.spaced = self.tok.normalizer is None  # a chunk keeps the space before it
        self.seen: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        # byte-level models write each byte as a printable character: itself, or the next free one from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in plain]
        self.chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}
        self.lead = self.chars[32] if self.spaced else ""
        self.mark = next((c for c in "§¶ø" if len(self.whole(" " + c)) == 4), None)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def unit(self, piece: str, lead: str = "") -> bytes:
        """Ids of one pre-token, from the library's model itself; lead: the written form of what stands before it."""
        written = piece if piece.isascii() and piece.isprintable() else "".join(map(self.chars.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(lead + written)]).tobytes()

    def tail(self, marks: str) -> bytes:
        if not marks:
            return b""
        found = self.tails.get(marks)
        if found is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            found = self.tails[marks] = self.unit(marks)
        return found

    def word(self, w: str) -> bytes:
        """Ids of a Latin word that stands as a chunk."""
        return self.unit(w, self.lead) if self.spaced else self.unit(w.lower())

    def lined(self, word: str, marks: str, below: str, more: str) -> bytes:
        """Ids of a chunk of two words on two lines, each with its marks."""
        key = " " + below  # no chunk holds a space
        begun = self.seen.get(key)
        if begun is None:
            begun = self.unit("\n") + self.unit(below)
            if len(key) <= LONG:
                self.seen[key] = begun
        return (self.seen.get(word) or self.word(word)) + self.tail(marks) + begun + self.tail(more)

    def learn(self, hard: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not simple; but for words on two lines they are encoded in one call, parted by a mark that none holds."""
        out: dict[str, bytes] = {}
        lead = " " if self.spaced else ""
        if self.spaced:
            out.update((c, self.lined(*m.groups())) for c in hard if (m := LINED.fullmatch(c)))
            hard = [c for c in hard if c not in out]
        many = [c for c in hard if c and not c[0].isspace() and self.mark and self.mark not in c]
        if many:
            mark = np.frombuffer(self.whole(" " + self.mark), "<u4")[0]
            ids = np.array(self.tok.encode_batch_fast([lead + f" {self.mark} ".join(many)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == mark)
            if len(at) == len(many) - 1:
                flat = ids.tobytes()
                lo = [0, *((at + 1) * 4).tolist()]
                hi = [*(at * 4).tolist(), len(flat)]
                out.update((c, flat[a:b]) for c, a, b in zip(many, lo, hi))
        for c in hard:
            if c not in out:
                out[c] = self.whole(lead + c)
        return out

    def known(self, units: pa.Array, simple: np.ndarray) -> list[bytes]:
        """Ids of distinct words (simple) and other chunks."""
        names = units.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.seen.get, names))
        hard = []
        for i in [i for i, b in enumerate(found) if b is None]:
            if simple[i]:
                found[i] = self.word(names[i])
            else:
                hard.append(i)
                continue
            if len(names[i]) <= LONG:
                self.seen[names[i]] = found[i]
        fresh = self.learn([names[i] for i in hard]) if hard else {}
        for i in hard:
            found[i] = fresh[names[i]]
            if len(names[i]) <= LONG:
                self.seen[names[i]] = found[i]
        return found

    def spelled(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct chunks in a row, how many each has)."""
        words = pc.utf8_rtrim(chunks, TAIL)
        # only of Latin words is it sure that the marks behind are a pre-token of their own
        simple = pc.match_substring_regex(words, rf"\A{LATIN}\z")
        units = pc.if_else(simple, words, chunks).dictionary_encode()
        own = units.indices.to_numpy()
        is_word = np.zeros(len(units.dictionary), bool)
        is_word[own] = simple.to_numpy(zero_copy_only=False)
        found = self.known(units.dictionary, is_word)
        size = pc.utf8_length(words).to_numpy()
        ended = np.flatnonzero(is_word[own] & (pc.utf8_length(chunks).to_numpy() > size))
        tails, tail = {"": 0}, np.zeros(len(chunks), np.int64)
        tail[ended] = [tails.setdefault(c[n:], len(tails)) for c, n in zip(chunks.take(pa.array(ended)).to_numpy(zero_copy_only=False).tolist(), size[ended].tolist())]
        pieces = found + [self.tail(t) for t in tails]
        flat = np.frombuffer(b"".join(pieces), "<u4")
        n = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        order = np.column_stack([own, tail + len(found)]).ravel()
        return flat[ragged((np.cumsum(n) - n)[order], n[order])], n[order].reshape(-1, 2).sum(1)

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        crossing = CROSSING if self.spaced else ODD_SPACE
        out = [self.whole(t) if "<|" in t or crossing.search(t) else None for t in texts]
        cut = [i for i, b in enumerate(out) if b is None]
        if not cut:
            return out
        if self.spaced:
            parts = pc.split_pattern(pa.array([texts[i] for i in cut], pa.string()), " ")
            chunks, ends = parts.values, parts.offsets.to_numpy()
        else:
            split = [texts[i].split() for i in cut]
            chunks, ends = pa.array([c for each in split for c in each], pa.string()), np.cumsum([0, *map(len, split)])
        coded = chunks.dictionary_encode()
        flat, n = self.spelled(coded.dictionary)
        at = coded.indices.to_numpy()
        size = n[at]
        heads = [b""] * len(cut)
        if self.spaced:
            # no space stands before a text's first chunk
            size[ends[:-1]] = 0
            heads = [self.whole(h) if h else b"" for h in chunks.take(pa.array(ends[:-1])).to_pylist()]
        raw = flat[ragged((np.cumsum(n) - n)[at], size)].tobytes()
        stop = (np.concatenate([[0], np.cumsum(size)])[ends] * 4).tolist()
        for i, head, a, b in zip(cut, heads, stop, stop[1:]):
            out[i] = head + raw[a:b]
        return out

    @property
    def wide(self) -> bool:
        return self.tok.get_vocab_size() > 1 << 16


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path)


def tokenizer_path(name: str) -> str:
    """A public tokenizer file's place on this machine."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
