"""Byte-pair encoding by backtracking over longest matches, and decoding through a table of offsets.

The merges of a byte-level vocabulary define one segmentation of every word. It is the only one of which every two
neighbours are *compatible*: merging the bytes of both gives exactly the two tokens. The encoder takes, from left to right,
the longest token that an Aho-Corasick automaton finds at a place, falls back to the next shorter token that is its prefix
where the pair is not compatible, and steps back over the last token where none is. A place that was left is never
entered again, so the work is linear in the word. Answers for pairs and for short words are remembered up to a bound.

A null text counts as empty: it has no ids and decodes to the empty text. Texts and words may be of any length; rows that
repeat an id or a whole row give repeated rows, an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from tidebook.llm.common import map_texts

#: Fixed: how byte-level vocabularies split text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered words and pairs per task, and the longest word (in characters) that is remembered.
WORDS, PAIRS, WORD_LENGTH = 400_000, 1_000_000, 48
#: Tokens that are decoded at once.
DECODED = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself where printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _Remembered(dict):
    """Values by key, made when they are missing; emptied when full, so that memory stays bounded."""

    def __init__(self, make, limit: int, longest: int | None = None):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Merges of a byte-level vocabulary file, its special tokens and the tables made of them.

    Tokens are numbered here in the order in which merges apply: single bytes first, then one per merge.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        ids, merges = model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        made = [a + b for a, b in merges]
        added = spec.get("added_tokens") or []
        if len(set(made)) != len(made):
            raise ValueError("a token with two merges has no single way to be split")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("only special tokens that stand for their exact text are supported")
        names = [*letters, *made]
        number = {name: i for i, name in enumerate(names)}
        parts = [bytes(letters[c] for c in name) for name in names]
        by_bytes = {part: i for i, part in enumerate(parts)}
        self.n_single = len(letters)
        self.left = [*range(self.n_single), *(number[a] for a, _ in merges)]
        self.right = [*range(self.n_single), *(number[b] for _, b in merges)]
        self.merged = {(number[a], number[b]): number[a + b] for a, b in merges}
        self.size = [len(part) for part in parts]
        self.shorter = [next((by_bytes[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in by_bytes), -1) for p in parts]
        self.public = np.array([ids[name] for name in names], dtype="<u4")
        self.automaton = ahocorasick.Automaton()
        for i, part in enumerate(parts):
            self.automaton.add_word(part.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.special = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        special = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.split = regex.compile(WORD_PATTERN).findall
        self.pairs = _Remembered(self._is_compatible, PAIRS)
        self.words = _Remembered(self.word, WORDS, WORD_LENGTH)
        texts = {ids[name]: part for name, part in zip(names, parts, strict=True)}
        texts |= {t["id"]: self._special_bytes(t["content"], letters) for t in added}
        pieces = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    @staticmethod
    def _special_bytes(content: str, letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in content) if all(c in letters for c in content) else content.encode()

    def _is_compatible(self, pair: tuple[int, int]) -> bool:
        """Whether no merge crosses the border of two tokens before both are whole.

        The tokens are taken apart from the border outwards, newest merge first: at each step the token that was made
        last. A merge of what then meets at the border would have come before that token was made if it is older.
        """
        a, b = pair
        before = len(self.left)  # merges from this number on come too late to cross the border
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            # of equal tokens, the left one of two equal merges is made first
            if (a > b or b < self.n_single) and a >= self.n_single:
                a, before = self.right[a], a
            elif b >= self.n_single:
                b, before = self.left[b], b + 1
            else:
                return True

    def word(self, text: str) -> bytes:
        """Ids of one word as little-endian 32-bit numbers."""
        raw = text.encode().decode("latin-1")
        longest, size, shorter, pairs = [0] * len(raw), self.size, self.shorter, self.pairs
        for end, token in self.automaton.iter(raw):  # of tokens that start at one place, the longest comes last
            longest[end + 1 - size[token]] = token
        open_places = bytearray(b"\1") * (len(raw) + 1)
        found: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if open_places[end] and (not found or pairs[found[-1], token]):
                found.append(token)
                if end == len(raw):
                    return self.public[found].tobytes()
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_places[at] = 0
                token = found.pop()
                at -= size[token]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers; the text of a special token is that token."""
        look_up = self.words.__getitem__
        if self.cut is None or self.cut.search(text) is None:
            return b"".join(map(look_up, self.split(text)))
        parts = self.cut.split(text)  # special tokens are at odd places
        return b"".join(
            self.special[part] if i % 2 else b"".join(map(look_up, self.split(part))) for i, part in enumerate(parts)
        )

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a sequence of ids; ids that the vocabulary does not have are left out."""
        every = np.frombuffer(ids, dtype="<u4")
        done = []
        for at in range(0, len(every), DECODED):
            some = every[at : at + DECODED]
            some = some[some < len(self.offsets) - 1]
            start, lengths = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(lengths)
            place = np.repeat(start - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
            done.append(self.bytes[place].tobytes())
        return b"".join(done)

    def decode_text(self, ids: bytes) -> str:
        """The text of a sequence of ids; bytes that are no text become replacement characters."""
        return self.decode(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The tables of a file, once per Python worker; ``path`` has to be there on every executor."""
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text as little-endian unsigned 32-bit numbers."""

    def make():
        encode = vocabulary(path).encode
        return lambda texts: [[encode(t) for t in texts]]

    return map_texts(docs, make, "ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text."""

    def make():
        decode = vocabulary(path).decode_text
        return lambda found: [[decode(ids or b"") for ids in found]]

    return map_texts(rows, make, "text string", ("doc_id", "ids"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids of every text, and the text that they decode to."""
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def make():
        known = vocabulary(path)

        def work(texts: list[str]) -> list[list]:
            ids = [known.encode(t) for t in texts]
            back = [sha(known.decode_text(i).encode()) for i in ids]
            return [[len(i) // 4 for i in ids], [sha(i) for i in ids], back]

        return work

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
