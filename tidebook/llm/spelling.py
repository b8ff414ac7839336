"""Groups of spelling variants: frequent words whose neighbour, one code point away, is much more frequent.

Words are counted with column expressions. Their neighbourhoods are searched with generated edits: every word of a
vocabulary makes its deletions and those replacements that put a smaller code point in a place, which reaches every near
pair exactly once, from the longer or greater word. Edits probe blocked Bloom filters, one group of filters per word
length; only edits that a filter lets through become rows, and a join with the vocabulary removes the false ones.

A filter never grows beyond ``FILTER_WORDS`` words: words of a length are dealt over as many filters as they need, by the
upper bits of their hash, and filters are broadcast in rounds of at most ``ROUND_BYTES``. A larger vocabulary takes more
rounds, nothing else changes.

Null and empty texts have no words; a null id counts as an empty one in the hash of an occurrence; rows that repeat an id
or a whole row count as often as they come. Equal frequencies are decided by the order of code points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import keep

#: Fixed by the task: what a run is, which runs lose a code point, which words count and how much more frequent a form is.
RUN = r"[A-Za-zÀ-ÿ]+"
DIVISOR = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Words per filter, bits per word, and bytes of filters that are broadcast in one round.
FILTER_WORDS, BITS, ROUND_BYTES = 1 << 20, 32, 64 << 20
#: Words whose edits are made at once, and words per task of the search.
SLICE_ROWS, TASK_WORDS = 512, 50_000
#: Multiplier of the rolling hash (odd, so that it has an inverse), and its seed per code point.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


# --- words -------------------------------------------------------------------------------------------------------


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def occurrences(docs: DataFrame) -> DataFrame:
    """``word``: one row per run of every whole text, lower-cased, without the code point its hash may take away."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    found = found.select("id", lower_ascii(F.col("run")).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    changed = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    return found.select(F.when(F.col("h") % DIVISOR == 0, changed).otherwise(F.col("run")).alias("word"))


def frequent_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the distinct words of at least so many code points with at least so many occurrences."""
    long_enough = occurrences(docs).where(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# --- filters -----------------------------------------------------------------------------------------------------


def letter_hashes() -> np.ndarray:
    """A 64-bit number per code point below 256."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit number over all of its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(length: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(length - 1, 0), BASE, dtype=np.uint64))])[:length]


def codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of code points, all of which are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(-1, length)


def word_hashes(matrix: np.ndarray) -> np.ndarray:
    """The sum over the places of a word of the letter's number times a power of the base."""
    return (letter_hashes()[matrix] * powers(matrix.shape[1])).sum(axis=1, dtype=np.uint64)


def probes(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of a hash, a 64-bit word of the filter, and the five bits of it that the hash sets."""
    m = mixed(h)
    block = ((m >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits = np.zeros(h.shape, dtype=np.uint64)
    for k in range(5):
        bits |= np.uint64(1) << ((m >> np.uint64(6 * k)) & np.uint64(63))
    return block.astype(np.int64), bits


def shard(h: np.ndarray, shards: int) -> np.ndarray:
    """The filter of a hash among those of its length, independent of the bits that choose the block."""
    return (mixed(h ^ BASE) % np.uint64(shards)).astype(np.int64)


def filters(words: DataFrame, shards: dict[int, int]) -> DataFrame:
    """``length, shard, bits``: the filter of every group of words. Only hashes are shuffled; a group has about
    ``FILTER_WORDS`` of them at most."""

    @F.pandas_udf("struct<shard: int, h: long>")
    def hashed(word: pd.Series, length: pd.Series) -> pd.DataFrame:
        out = np.zeros(len(word), dtype=np.uint64)
        group = np.zeros(len(word), dtype=np.int32)
        for size in length.unique().tolist():
            at = np.flatnonzero(length.to_numpy() == size)
            out[at] = word_hashes(codes(word.iloc[at].tolist(), size))
            group[at] = shard(out[at], shards[size])
        return pd.DataFrame({"shard": group, "h": out.view(np.int64)})

    def united(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(max(1, len(group) * BITS // 64), dtype=np.uint64)
        block, mask = probes(group["h"].to_numpy().view(np.uint64), len(bits))
        np.bitwise_or.at(bits, block, mask)
        return pd.DataFrame({"length": [key[0]], "shard": [key[1]], "bits": [bits.tobytes()]})

    sized = words.select("word", F.length("word").alias("length"))
    found = sized.select("length", hashed("word", "length").alias("of")).select("length", "of.shard", "of.h")
    return found.groupBy("length", "shard").applyInPandas(united, "length int, shard int, bits binary")


# --- neighbours --------------------------------------------------------------------------------------------------


class Edits:
    """The edits of words of one length that the filters of one round let through."""

    def __init__(self, found: dict[tuple[int, int], np.ndarray], shards: dict[int, int], letters: np.ndarray):
        self.found, self.shards, self.letters, self.hashes = found, shards, letters, letter_hashes()

    def passed(self, h: np.ndarray, length: int) -> np.ndarray:
        """Which of the hashes of words of a length a filter of this round has."""
        out = np.zeros(h.shape, dtype=bool)
        n = self.shards.get(length, 0)
        group = shard(h, n) if n > 1 else None
        for number in range(n):
            bits = self.found.get((length, number))
            if bits is not None:
                at = ... if group is None else group == number
                block, mask = probes(h[at], len(bits))
                out[at] = bits[block] & mask == mask
        return out

    def of(self, words: list[str], length: int) -> list[tuple[int, str]]:
        """``(row, edit)`` of the deletions and of the replacements by a smaller code point."""
        matrix = codes(words, length)
        terms = self.hashes[matrix] * powers(length)
        whole = terms.sum(axis=1, dtype=np.uint64)
        edits = []
        if length - 1 in self.shards:
            before = np.cumsum(terms, axis=1, dtype=np.uint64)
            left = before - terms
            h = left + (whole[:, None] - before) * UNBASE
            once = np.ones(matrix.shape, dtype=bool)  # equal neighbours: taking either away gives the same word
            once[:, :-1] = matrix[:, :-1] != matrix[:, 1:]
            for row, at in zip(*np.nonzero(self.passed(h, length - 1) & once), strict=True):
                edits.append((row, words[row][:at] + words[row][at + 1 :]))
        for letter in self.letters:  # one letter at a time: memory stays a few matrices of a slice
            rows, places = np.nonzero(matrix > letter)
            if len(rows) and length in self.shards:
                new = self.hashes[letter] * powers(length)[places]
                kept = self.passed(whole[rows] - terms[rows, places] + new, length)
                for row, at in zip(rows[kept], places[kept], strict=True):
                    edits.append((row, words[row][:at] + chr(letter) + words[row][at + 1 :]))
        return edits


def candidates(words: DataFrame, round_filters: list, shards: dict[int, int], letters: np.ndarray) -> DataFrame:
    """``other, word, n``: edits of the words that the filters of a round let through, with the word they come from."""
    shared = words.sparkSession.sparkContext.broadcast(round_filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {(length, number): np.frombuffer(bits, dtype=np.uint64) for length, number, bits in shared.value}
        edits = Edits(found, shards, letters)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                word, n = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
                lengths = np.array([len(w) for w in word])
                for length in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == length)
                    made = edits.of([word[i] for i in at], length)
                    rows = at[[row for row, _ in made]] if made else np.zeros(0, dtype=int)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([e for _, e in made], pa.string()), pa.array([word[i] for i in rows], pa.string()), pa.array(n[rows], pa.int64())],
                        ["other", "word", "n"],
                    )

    return words.select("word", "n").mapInArrow(run, "other string, word string, n long")


def near_pairs(words: DataFrame, filter_words: int = FILTER_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``a, n_a, b, n_b``: all pairs of words of a stored vocabulary that differ by one code point, once each."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    letters = np.array(sorted(ord(r["c"]) for r in letters if r["c"]), dtype=np.int64)  # at most 90 of them
    shards = {length: math.ceil(n / filter_words) for length, n in sizes.items()}
    each = {length: sizes[length] / shards[length] * BITS / 8 for length in shards}
    made = keep(filters(words, shards), "filters")
    spread = words.repartition(max(1, sum(sizes.values()) // TASK_WORDS))
    pairs = None
    for wanted in rounds(shards, each, round_bytes):
        chosen = F.struct("length", "shard").isin([F.struct(F.lit(a), F.lit(b)) for a, b in wanted])
        held = [(r["length"], r["shard"], bytes(r["bits"])) for r in made.where(chosen).collect()]  # round_bytes
        found = candidates(spread, held, shards, letters)
        exact = found.join(words.select(F.col("word").alias("other"), F.col("n").alias("n_other")), "other")
        exact = keep(exact.selectExpr("word AS a", "n AS n_a", "other AS b", "n_other AS n_b"), "near-pairs")
        pairs = exact if pairs is None else pairs.unionByName(exact)
    if pairs is None:
        return words.selectExpr("word AS a", "n AS n_a", "word AS b", "n AS n_b").limit(0)
    return pairs


def rounds(shards: dict[int, int], each: dict[int, float], limit: int) -> list[list[tuple[int, int]]]:
    """Filters in order of length and number, as many per round as fit into the limit, at least one."""
    done, size = [], 0.0
    for length in sorted(shards):
        for number in range(shards[length]):
            if not done or size + each[length] > limit:
                done.append([])
                size = 0.0
            done[-1].append((length, number))
            size += each[length]
    return done


# --- forms -------------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last of the forms that follow from a word.

    A form is several times as frequent as its word, so a chain is as short as the logarithm of the greatest frequency,
    and every round doubles the steps that were taken.
    """
    at = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = keep(step, "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    filter_words: int = FILTER_WORDS,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every frequent word, its more frequent spelling and the last of its forms."""
    words = keep(frequent_words(docs, min_length, min_count), "vocabulary")
    pairs = near_pairs(words, filter_words, round_bytes)
    both = pairs.unionByName(pairs.selectExpr("b AS a", "n_b AS n_a", "a AS b", "n_a AS n_b"))
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    far = -F.col("best.n") >= ratio * F.col("n")
    found = keep(
        joined.select(
            "word",
            F.when(far, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(far, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(found.where(F.col("form").isNotNull()))
    whole = found.join(last, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
