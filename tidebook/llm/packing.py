"""Token pieces of documents and their packing into sequences, by patterns fitted to the histogram of lengths."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.byte_pairs import WORD_PATTERN, byte_letters, vocabulary
from tidebook.llm.common import keep

CAPACITY = 1024
END_ID = 2
#: Pieces per ranking group; the number of groups per length grows with the table.
RANK_ROWS = 100_000
#: Shares of the fitted repeats that are tried.
SHARES = (0.1, 0.5, 0.8, 0.9, 1.0)


#: White space beyond this many characters in a row is left to the encoder that needs no stack.
LONG_RUN = 10_000
BLANKS = re.compile(r"\s{2,}")

# --- tokens ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary file of a byte-level tokenizer; the order of its ids is the order of its merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return tiktoken.Encoding(path, pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def text_encoder(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text of any kind. The fast encoder's pattern keeps a stack entry per blank of a run and fails where
    that overflows; texts with long runs of white space go to the encoder by backtracking, which gives the same ids."""
    fast = encoder(path)

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in BLANKS.finditer(text)):
            return np.frombuffer(vocabulary(path).encode(text), dtype="<u4")
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")

    return encode


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, tokens``: the ids of each document and ``end_id``, cut where longer than a sequence.

    ``tokens`` are little-endian unsigned 32-bit ids. Only longer documents are cut, into pieces of full length with the
    rest in front. A null or empty text is the single id ``end_id``; repeated rows give repeated pieces.
    """
    narrow = docs.select("doc_id", "text")
    schema = T.StructType(
        [narrow.schema["doc_id"]]
        + T._parse_datatype_string("piece int, start long, length long, tokens binary").fields
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        encode = text_encoder(path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[list] = [[], [], [], [], []]
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([encode(text or ""), end])
                    first = len(ids) % capacity or capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        for column, value in zip(rows, (key, piece, a, b - a, ids[a:b].tobytes()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(rows, arrow, strict=True)], schema=arrow
                )

    return narrow.mapInArrow(run, schema)


# --- the plan: bounded by the capacity, whatever the number of pieces ---------------------------------------------


def full_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill a sequence exactly with two or three of the present lengths, longest first; 0 for no third."""
    has = np.zeros(capacity + 1, dtype=bool)
    has[present] = True
    found = []
    for a in present[present < capacity]:
        rest = capacity - a
        if rest <= a and has[rest]:
            found.append(np.array([[a, rest, 0]]))
        b = present[(present <= a) & (present < rest) & (2 * present >= rest)]
        b = b[has[rest - b]]
        found.append(np.stack([np.full_like(b, a), b, rest - b], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, capacity: int, power: int, rounds: int = 300) -> np.ndarray:
    """Non-negative repeats per pattern whose lengths come nearest to ``counts``, weighed by length to the ``power``.

    Accelerated projected gradient steps on the least squares; the matrix stays implicit.
    """
    weight = (np.arange(capacity + 1) / capacity) ** power
    weight[0] = 0
    use = lambda x: sum(np.bincount(patterns[:, k], x, capacity + 1) for k in range(3))
    back = lambda r: r[patterns].sum(axis=1)
    probe, size = np.ones(len(patterns)), 1.0
    for _ in range(12):
        probe = back(weight * use(probe))
        size = np.linalg.norm(probe)
        probe /= size
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        nearer = np.maximum(0, y - 0.9 / size * back(weight * (use(y) - counts)))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nearer + (t - 1) / t_next * (nearer - x)
        x, t = nearer, t_next
    return x


def plan_patterns(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """``([(length, copies), ...], repeats)`` that together hold ``counts[length]`` pieces of every length.

    Exactly full patterns of up to three pieces get repeats by non-negative least squares. Repeats are rounded so that
    their running sum is kept, and limited by what is left. The rest is packed longest first into the fullest sequence
    that has room. A residual with a share of every length packs best, so a few shares of the fitted repeats are tried
    and the plan with the fewest sequences is taken.
    """
    left = np.array(counts, dtype=np.int64)
    full = [([(capacity, 1)], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = full_patterns(np.flatnonzero(left), capacity)
    if not len(patterns):
        return full + best_fit(left, capacity)
    plans = []
    for power in (0, 1):
        repeats = np.cumsum(fit_repeats(patterns, left.astype(float), capacity, power))
        for share in SHARES:
            rounded = np.diff(np.floor(repeats * share + 0.5).astype(np.int64), prepend=0)
            plans.append(_with_residual(patterns, rounded, left.copy(), capacity))
    return full + min(plans, key=lambda plan: sum(n for _, n in plan))


def _with_residual(patterns: np.ndarray, repeats: np.ndarray, left: np.ndarray, capacity: int) -> list:
    plan = []
    for k in np.flatnonzero(repeats):
        lengths, copies = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = int(min(repeats[k], (left[lengths] // copies).min()))
        if n > 0:
            left[lengths] -= n * copies
            plan.append((list(zip(lengths.tolist()[::-1], copies.tolist()[::-1], strict=True)), n))
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over the histogram: sequences with the same content are one entry with a count."""
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        for free in sorted(f for f in room if f >= length):
            fits = free // length
            while todo and room[free]:
                content, n = room[free].pop()
                use = min(n, todo // fits)
                if use:
                    room[free - fits * length].append(([*content, (length, fits)], use))
                    todo -= use * fits
                    if use < n:
                        room[free].append((content, n - use))
                else:  # fewer than one sequence takes
                    room[free - todo * length].append(([*content, (length, todo)], 1))
                    if n > 1:
                        room[free].append((content, n - 1))
                    todo = 0
            if not todo:
                break
        fits = capacity // length
        if todo // fits:
            room[capacity - fits * length].append(([(length, fits)], todo // fits))
        if todo % fits:
            room[capacity - todo % fits * length].append(([(length, todo % fits)], 1))
    return [entry for entries in room.values() for entry in entries]


def segments(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Where ranks of a length go: sorted by (length, first rank), with copies, first sequence and first offset."""
    rows, used, sequence = [], defaultdict(int), 0
    for content, n in plan:
        offset = 0
        for length, copies in content:
            rows.append((length, used[length], copies, sequence, offset))
            used[length] += n * copies
            offset += length * copies
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T, strict=True))


# --- the assignment ----------------------------------------------------------------------------------------------


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``: every piece has its own gapless place in a sequence.

    Pieces are ranked within their length. Ranks come from windows over (length, hash group) with about a hundred
    thousand pieces each, so that a length that most documents share is spread over tasks; group sizes give the offset
    of each group. The plan depends on the histogram only and its size is bounded by the capacity, so tasks get it whole.
    ``pieces`` is read twice and should be a stored table. Which of several equal pieces goes where is not defined.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row per length: at most `capacity`
        counts[row["length"]] = row["count"]
    groups = max(256, int(counts.sum()) // RANK_ROWS)
    place = segments(plan_patterns(counts, capacity))
    place["key"] = place["length"] << 44 | place["rank"]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(place["key"], (length.to_numpy() << 44) | rank.to_numpy(), side="right") - 1
        inside, copies = rank.to_numpy() - place["rank"][at], place["copies"][at]
        return pd.DataFrame(
            {
                "sequence_id": place["sequence"][at] + inside // copies,
                "offset": place["offset"][at] + inside % copies * length.to_numpy(),
            }
        )

    grouped = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    in_group = W.partitionBy("length", "__group").orderBy("doc_id", "piece")
    ranked = grouped.withColumn("__rank", F.row_number().over(in_group) - 1)
    before = W.partitionBy("length").orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    sizes = grouped.groupBy("length", "__group").agg(F.count("*").alias("n"))
    starts = sizes.select("length", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    full = ranked.join(starts, ["length", "__group"])
    done = full.withColumn("__place", placed(F.col("length"), (F.col("__first") + F.col("__rank")).cast("long")))
    return done.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents with their tokens and places: ``doc_id, piece, start, length, tokens, sequence_id, offset``."""
    return assign_sequences(keep(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, tokens, n_pieces``: the sequences themselves; a group holds at most one capacity of tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "tokens")))
    whole = F.aggregate(F.transform(parts, lambda p: p["tokens"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(whole.alias("tokens"), F.count("*").alias("n_pieces"))


def pack_digest(docs: DataFrame, path: str) -> DataFrame:
    """Places with a checksum in place of the tokens, which then take no part in the shuffle."""
    pieces = token_pieces(docs, path)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"))
    return assign_sequences(keep(narrow, "pieces"))
