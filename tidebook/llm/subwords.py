"""SentencePiece encoding and decoding by batched Viterbi passes over words of equal length."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPACE = "▁"
#: Words whose ids a task remembers; beyond that it starts anew.
REMEMBERED_WORDS = 600_000
#: Longest word that advances in a batch with others; longer ones go alone.
BATCH_CHARACTERS = 200_000

#: Leading bits of hashes by which most substrings are known not to be pieces.
FLAG_BITS = 21
#: Slots for remembered pairs of pieces, as a power of two.
MEMO_BITS = 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FLAG_SHIFT = np.uint64(64 - FLAG_BITS)
_MEMO_SHIFT = np.uint64(64 - MEMO_BITS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Model:
    """Pieces with their scores, as sorted hashes that substrings are looked up in.

    A unigram model wants the segmentation with the highest summed score. A merge model (BPE) wants the result of
    merging the best pair over and over; its segmentation is the only one in which every two neighbouring pieces are
    what merging makes of their own text, so there the pass goes through such neighbours only. Both are one
    left-to-right pass that keeps the best last piece for every prefix.
    """

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        library = sentencepiece.SentencePieceProcessor(model_file=path) if path else sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = model_settings(library.serialized_model_proto())
        self.merges = spec["type"] == 2
        self.prefix = spec["add_dummy_prefix"]
        self.collapse = spec["remove_extra_whitespaces"]
        if spec["charsmap"]:
            raise ValueError("models with a character map are not supported; only white space is normalised here")
        if spec["type"] not in (1, 2):
            raise ValueError("only unigram and merge models are supported")
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.unknown = library.unk_id()
        self.byte = {int(self.pieces[i][1:-1], 16): i for i in range(n) if library.is_byte(i)}
        self._byte_of = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(n) if library.is_control(i)}
        usable = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.score = np.array([library.get_score(i) for i in range(n)], dtype=np.float64)
        self.unknown_score = (min((self.score[i] for i in usable), default=0.0)) - 10.0
        self.ids = {self.pieces[i]: i for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        # a piece with a space inside or at its end, or with a line break, would let words run into each other
        by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        by_lines = not any("\n" in p and len(p) > 1 for p in self.ids)
        if by_words and by_lines:
            marks = re.escape("".join(sorted(self._apart_marks())))
            runs = f"{SPACE}*[^{SPACE}\n{marks}]+|{SPACE}*[{marks}]+" if marks else f"{SPACE}*[^{SPACE}\n]+"
            self.word = re.compile(f"{runs}|{SPACE}+|\n")
        else:
            self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if by_words else ".+", re.DOTALL)
        raw = np.array([self._raw_hash(p) for p in self.ids], dtype=np.uint64)
        keys = _mix(raw)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.fromiter(self.ids.values(), dtype=np.int64, count=len(keys))[order]
        self.flags = np.zeros(1 << FLAG_BITS, dtype=bool)
        self.flags[(keys >> _FLAG_SHIFT).view(np.int64)] = True
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.words: dict[str, bytes] = {}
        self.plain = [bytes([int(p[1:-1], 16)]).decode() if i in self._byte_of and self._byte_of[i] < 128 else p for i, p in enumerate(self.pieces)]
        self.special = np.array([i in self.control or i == self.unknown or self._byte_of.get(i, 0) > 127 for i in range(n)])
        if self.merges:
            self._prepare_merges(raw)

    def _apart_marks(self) -> set[str]:
        """Characters other than letters and digits that no piece has next to anything but a space or such punctuation: no piece can reach from a word
        into it or out of it."""
        marks = {c for p in self.ids for c in p if not (c.isalpha() or c.isdecimal())} - {SPACE, "\n"}
        neighbours = {pair for p in self.ids for pair in zip(p, p[1:], strict=False) if SPACE not in pair}
        while True:
            joined = {c for a, b in neighbours if (a in marks) != (b in marks) for c in (a, b) if c in marks}
            if not joined:
                return marks
            marks -= joined

    def _prepare_merges(self, raw: np.ndarray) -> None:
        """For each piece its place in the order of merges, its two parts and what its hash needs to be put behind another."""
        n = len(self.pieces)
        by_score = sorted(self.ids.values(), key=lambda i: -self.score[i])
        self.order = np.full(n, -1, dtype=np.int64)
        for k, i in enumerate(by_score):
            if len(self.pieces[i]) > 1:
                self.order[i] = k
        self.left, self.right = np.arange(n), np.arange(n)
        self.whole = np.zeros(n, dtype=bool)  # merging its own text gives the piece
        # merges of one score, or better than those of their parts, have no place of their own in the order
        scores, times = np.unique(self.score[by_score], return_counts=True)
        tied = set(scores[times > 1].tolist())
        self.odd = np.zeros(n, dtype=bool)
        for text, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            parts = self.merged(text, stop=2)
            if len(text) == 1:
                self.whole[i] = True
            elif len(parts) == 2 and all(p in self.ids for p in parts):
                self.whole[i] = True
                self.left[i], self.right[i] = self.ids[parts[0]], self.ids[parts[1]]
                late = max(self.order[self.left[i]], self.order[self.right[i]]) > self.order[i]
                self.odd[i] = late or self.score[i] in tied or self.odd[self.left[i]] or self.odd[self.right[i]]
        self.answers: dict[tuple[int, int], bool] = {}
        self.memo = np.full(1 << MEMO_BITS, -2, dtype=np.int64)
        self.hash = np.zeros(n, dtype=np.uint64)
        self.shift = np.ones(n, dtype=np.uint64)
        at = np.fromiter(self.ids.values(), dtype=np.int64)
        self.hash[at] = raw
        power = np.cumprod(np.full(self.longest, _BASE, dtype=np.uint64))
        self.shift[at] = power[np.array([len(p) - 1 for p in self.ids])]

    @staticmethod
    def _raw_hash(text: str) -> int:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        h = np.zeros(1, dtype=np.uint64)
        for c in codes:
            h = h * _BASE + c + np.uint64(1)
        return int(h[0])

    # --- text and words ---

    def normalised(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def split(self, text: str) -> list[str]:
        """Words that no piece runs across: spaces and what follows them up to the next space, line break or mark."""
        return self.word.findall(text)

    # --- the pass ---

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash of a substring, -1 where there is none."""
        keys = _mix(hashes).ravel()
        found = np.full(len(keys), -1, dtype=np.int64)
        likely = np.flatnonzero(self.flags[(keys >> _FLAG_SHIFT).view(np.int64)])
        some = keys[likely]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[at] == some
        found[likely[hit]] = self.key_ids[at[hit]]
        return found.reshape(hashes.shape)

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, all advancing together one character at a time, as 32-bit integers."""
        length = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), length)
        codes = codes.astype(np.uint64) + np.uint64(1)
        rows = np.arange(len(words))
        best = np.zeros((length + 1, len(words)))
        last = np.full((length + 1, len(words)), -2, dtype=np.int64)  # piece before a place; -2 at the start
        back = np.zeros((length + 1, len(words)), dtype=np.int32)
        reach = min(self.longest, length)
        running = np.zeros((reach, len(words)), dtype=np.uint64)  # hashes of the substrings that end here, by start
        for end in range(1, length + 1):
            spans = min(reach, end)
            running[1:] = running[:-1]
            running[0] = 0
            running = running * _BASE + codes[:, end - 1]
            found = self._look_up(running[:spans])  # row k: the piece of the last k + 1 characters
            lengths = np.arange(1, spans + 1)
            unknown = found[0] < 0
            if self.merges:
                chosen = self._joins(last[end - lengths], found, found >= 0).argmax(axis=0)  # one at most; 0 if unknown
            else:
                ways = np.where(found >= 0, best[end - lengths] + self.score[found], -np.inf)
                ways[0] = np.where(unknown, best[end - 1] + self.unknown_score, ways[0])
                chosen = spans - 1 - ways[::-1].argmax(axis=0)  # the longest piece of equal sums
                best[end] = ways[chosen, rows]
            last[end] = found[chosen, rows]
            back[end] = end - 1 - chosen
        return self._trace(words, last, back)

    def _trace(self, words: list[str], last: np.ndarray, back: np.ndarray) -> list[bytes]:
        """Follow the backpointers of all words at once and write each word's pieces from the right."""
        length = len(words[0])
        ids = np.zeros((len(words), length), dtype="<i4")
        free, at, open_ones = np.full(len(words), length), np.full(len(words), length), np.arange(len(words))
        while len(open_ones):
            here = at[open_ones]
            free[open_ones] -= 1
            ids[open_ones, free[open_ones]] = last[here, open_ones]
            at[open_ones] = back[here, open_ones]
            open_ones = open_ones[at[open_ones] > 0]
        raw, size = ids.tobytes(), 4 * length
        out = [raw[k * size + 4 * f : (k + 1) * size] for k, f in enumerate(free.tolist())]
        for k in np.flatnonzero((ids < 0).any(axis=1)).tolist():
            pieces, place = [], 0
            for i in ids[k, free[k] :].tolist():
                pieces += [i] if i >= 0 else self._unknown_ids(words[k][place])
                place += len(self.pieces[i]) if i >= 0 else 1
            out[k] = np.array(pieces, dtype="<i4").tobytes()
        return out

    def _unknown_ids(self, character: str) -> list[int]:
        """The bytes of a character that no piece has, or the id of the unknown."""
        if not self.byte:
            return [self.unknown]
        return [self.byte[b] for b in character.encode("utf-8", "surrogatepass")]

    def _joins(self, left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whether a piece may follow the last piece of the text before it: merging keeps the two apart."""
        out = wanted.copy()
        out[wanted] = self.whole[right[wanted]]
        ask = out & (left >= 0)
        out[ask] = self._remembered(left[ask] * len(self.pieces) + right[ask])
        return out

    def _remembered(self, pairs: np.ndarray) -> np.ndarray:
        """``stay_apart`` of numbered pairs, from a table of fixed size where the last answer per slot stays."""
        slot = (pairs.view(np.uint64) * _BASE >> _MEMO_SHIFT).view(np.int64)
        held = self.memo[slot]
        out = (held & 1).astype(bool)
        asked = np.flatnonzero(held >> 1 != pairs)
        if len(asked):
            fresh, inverse = np.unique(pairs[asked], return_inverse=True)
            answers = self.stay_apart(fresh // len(self.pieces), fresh % len(self.pieces))
            self.memo[(fresh.view(np.uint64) * _BASE >> _MEMO_SHIFT).view(np.int64)] = fresh << 1 | answers
            out[asked] = answers[inverse]
        return out

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of pieces: whether merging the text of both gives these two.

        Their merges are undone from the last to the first. Whenever the parts that face each other make a piece that
        would have been merged before the merge that was undone, the border would have been crossed. Of equal merges the
        left one comes first. The few pieces without a place in the order are merged one by one.
        """
        apart = np.ones(len(left), dtype=bool)
        odd = self.odd[left] | self.odd[right]
        for k in np.flatnonzero(odd).tolist():
            pair = int(left[k]), int(right[k])
            if pair not in self.answers:
                texts = [self.pieces[i] for i in pair]
                self.answers[pair] = self.merged("".join(texts)) == texts
            apart[k] = self.answers[pair]
        open_ones = np.flatnonzero(~odd)
        limit = np.full(len(open_ones), np.iinfo(np.int64).max)
        x, y = left[open_ones], right[open_ones]
        while len(open_ones):
            both = self._look_up(self.hash[x] * self.shift[y] + self.hash[y])
            crossed = (both >= 0) & (self.order[both] < limit)
            apart[open_ones[crossed]] = False
            of_x, of_y = self.order[x], self.order[y]
            going = ~crossed & (np.maximum(of_x, of_y) >= 0)
            open_ones, x, y, of_x, of_y = open_ones[going], x[going], y[going], of_x[going], of_y[going]
            undo_left = of_x > of_y
            limit = np.where(undo_left, of_x, of_y + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return apart

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """What merging the pair with the best score, the leftmost of equals, makes of a short text, at ``stop`` parts."""
        parts = list(text)
        while len(parts) > stop:
            scores = [(self.score[i], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (i := self.ids.get(a + b)) is not None]
            if not scores:
                break
            k = -max(scores)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    # --- texts ---

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. Distinct words are segmented once per batch, and remembered across batches."""
        split = [self.split(self.normalised(t)) for t in texts]
        if len(self.words) > REMEMBERED_WORDS:
            self.words = {}
        known = self.words
        new: dict[int, list[str]] = {}
        for w in set().union(*split):
            if w not in known:
                new.setdefault(len(w), []).append(w)
        for length, ordered in sorted(new.items()):
            step = max(1, BATCH_CHARACTERS // length)
            for at in range(0, len(ordered), step):
                part = ordered[at : at + step]
                known.update(zip(part, self.segment(part), strict=True))
        ids = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<i4") for words in split]
        if self.byte:
            return ids
        # neighbouring unknown characters are one unknown piece
        return [x[(x != self.unknown) | (np.concatenate([[-1], x[:-1]]) != self.unknown)] if len(x) else x for x in ids]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces vanish, bytes join to characters, and the dummy space in front is dropped."""
        if not self.special[ids].any():
            return self._with_spaces("".join(map(self.plain.__getitem__, ids)))
        out: list[str] = []
        run: list[int] = []
        byte_of = self._byte_of
        for i in [*ids, None]:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                out.append(_bytes_text(bytes(run)))
                run = []
            if i is None or i in self.control:
                continue
            out.append(" ⁇ " if i == self.unknown else self.pieces[i])
        return self._with_spaces("".join(out))

    def _with_spaces(self, text: str) -> str:
        if self.prefix or self.collapse:
            text = text.removeprefix(SPACE)
        return text.replace(SPACE, " ")


def _bytes_text(raw: bytes) -> str:
    """Characters of a run of bytes; each byte that is part of none becomes the replacement character."""
    out = []
    while raw:
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[:n].decode("utf-8"))
                raw = raw[n:]
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            raw = raw[1:]
    return "".join(out)


def model_settings(proto: bytes) -> dict:
    """The few settings of a serialized model that encoding depends on, read from the wire format of the file."""
    out = {"type": 1, "add_dummy_prefix": True, "remove_extra_whitespaces": True, "charsmap": b""}
    for field, value in _fields(proto):
        if field == 2:  # trainer: 3 is the model type
            out["type"] = next((v for f, v in _fields(value) if f == 3), 1)
        if field == 3:  # normaliser: 2 character map, 3 dummy prefix, 4 extra white space
            names = {2: "charsmap", 3: "add_dummy_prefix", 4: "remove_extra_whitespaces"}
            out |= {names[f]: v if f == 2 else bool(v) for f, v in _fields(value) if f in names}
    return out


def _fields(raw: bytes):
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


# --- tables ------------------------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids``: ids of every whole text; ``model`` is the path of a model file that all nodes have.

    A null or empty text has no ids. Any row gives one row; a null ``doc_id`` is passed through.
    """
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        pieces = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 384):
                part = batch.slice(at, 384)
                found = pieces.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=pa.int32())).cast(arrow.field(1).type)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), ids], schema=arrow)

    return narrow.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    narrow = rows.select("doc_id", "ids")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        pieces = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                column = part.column(1)
                texts = [pieces.decode(x.values.to_numpy()) if x.is_valid else None for x in column]
                columns = [part.column(0).cast(arrow.field(0).type), pa.array(texts, type=arrow.field(1).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return narrow.mapInArrow(run, schema)


def encoded_and_checked(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text_crc32``: ids of every text, and the checksum of what they decode to."""
    ids = encoded(docs, model).select(F.struct("doc_id", "ids").alias("doc_id"), "ids")
    found = decoded(ids, model)
    return found.select(
        "doc_id.doc_id", F.size("doc_id.ids").cast("long").alias("n_tokens"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        "doc_id.ids",
    )
