"""Near-duplicate documents by min-max hashing, banding and confirmation on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.common import components, keep, map_texts

#: Every permutation gives two values. A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS:
#: all but 8 in a million at 0.8, 2 in ten thousand at 0.2.
PERMUTATIONS = 256
ROWS = 8
BANDS = 2 * PERMUTATIONS // ROWS
SEED = 20_11
CHUNK = 512
#: Classes on each side of a block of exact comparisons.
BLOCK = 128


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; one for all words of a shorter text, none for none.

    Words are what stands between the blanks \\x20 and \\x09 to \\x0D, with A-Z in lower case.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(hashes))
    runs = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(runs)]
    runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(runs ^ (runs >> np.uint64(32)))


def _permutations() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    scale = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
    mixer = rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return scale[:, None], shift[:, None], mixer


def signature(shingles: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation; the maxima are half a turn away from their minima."""
    low = np.full(len(scale), 0xFFFFFFFF, dtype=np.uint32)
    high = np.zeros(len(scale), dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), CHUNK):
        values = scale * short[at : at + CHUNK] + shift
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, np.roll(high, len(high) // 2)])


def band_keys(values: np.ndarray, mixer: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: half of its rows are minima, the other half maxima of other permutations."""
    half = mixer.shape[1] // 2
    low, high = values[: len(values) // 2].reshape(-1, half), values[len(values) // 2 :].reshape(-1, half)
    mixed = (np.concatenate([low, high], axis=1).astype(np.uint64) * mixer).sum(axis=1, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * mixer[:, 0]
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def features(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, text_key, bands``; no bands for an empty set. ``text_key`` is ``xxhash64`` of the text."""

    def make():
        scale, shift, mixer = _permutations()

        def work(texts):
            sets = [shingle_set(t, words) for t in texts]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            bands = [band_keys(signature(s, scale, shift), mixer) if len(s) else [] for s in sets]
            own = [np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64) for t in texts]
            return [[len(s) for s in sets], keys, own, bands]

        return work

    return map_texts(docs, make, "n_shingles long, set_key binary, text_key long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``a, b`` whose full sets are similar enough: 100 * intersection >= percent * union.

    The text of the second document travels to that of the first, so a first document with very many partners is a
    skewed equi-join, which can be split.
    """
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    schema = T._parse_datatype_string("a long, b long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for k, (i, text_a, text_b) in enumerate(zip(a, batch.column(2), batch.column(3), strict=True)):
                if i != last:
                    last, held = i, shingle_set(text_a.as_py(), words)
                other = shingle_set(text_b.as_py(), words)
                common = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * common >= percent * (len(held) + len(other) - common):
                    good.append(k)
            rows = [pa.array([x[k] for k in good], type=pa.int64()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(rows, schema=arrow)

    return both.mapInArrow(run, schema)


def block_links(near: DataFrame, groups: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` between members of one neighbourhood that are in different components so far.

    ``near(low, id)`` names the neighbourhoods: all classes that share a bucket with the class ``low``, so two classes
    of one bucket are in one neighbourhood. Members outside the component of ``low`` are compared with all members, in
    blocks of about ``BLOCK`` by ``BLOCK`` that are dealt to tasks one by one; pairs never become rows, only links do.
    """
    named = near.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    main = named.where("id = low").select("low", F.col("component").alias("main"))
    sided = keep(named.join(main, "low").withColumn("outside", F.col("component") != F.col("main")), "neighbourhoods")
    sizes = sided.groupBy("low").agg(F.count("*").alias("all"), F.count_if("outside").alias("out")).where("out > 0")
    sizes = keep(sizes, "neighbourhood-sizes")  # as a table, so that the join with a large neighbourhood can be split
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    open_ones = sided.join(sizes.select("low", blocks("out").alias("rows"), blocks("all").alias("columns")), "low")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    with_text = open_ones.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    first = with_text.where("outside").select(
        "low", place("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"), "id", "component", "text"
    )
    second = with_text.select(
        "low", every("rows").alias("i"), place("columns").alias("j"), F.lit(1).alias("side"), "id", "component", "text"
    )
    dealt = first.unionByName(second).repartition("low", "i", "j").sortWithinPartitions("low", "i", "j", "side")
    schema = T._parse_datatype_string("a long, b long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, rows = None, []
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
            found = []
            for (*here, side, doc, component), text in zip(names, batch.column(6), strict=True):
                if here != key:
                    found += _links_of_block(rows, percent)
                    key, rows = here, []
                rows.append((side, doc, component, shingle_set(text.as_py(), words)))
            yield pa.RecordBatch.from_pylist(found, schema=arrow)
        yield pa.RecordBatch.from_pylist(_links_of_block(rows, percent), schema=arrow)

    return dealt.mapInArrow(run, schema)


def _links_of_block(rows: list[tuple], percent: int) -> list[dict]:
    """One link for every two components that have one between the two sides; rows are (side, id, component, set)."""
    first = [r for r in rows if r[0] == 0]
    second = [r for r in rows if r[0] == 1]
    if not first or not second:
        return []
    sizes = np.array([len(r[3]) for r in first])
    owner = np.repeat(np.arange(len(first)), sizes)
    merged = np.concatenate([r[3] for r in first])
    order = np.argsort(merged, kind="stable")
    merged, owner = merged[order], owner[order]
    parts = np.array([r[2] for r in first])
    found = {}
    for _, b, component, shingles in second:
        low, high = np.searchsorted(merged, shingles, "left"), np.searchsorted(merged, shingles, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(first))
        linked = (100 * common >= percent * (sizes + len(shingles) - common)) & (parts != component)
        for k in np.flatnonzero(linked):
            found.setdefault((first[k][2], component), {"a": first[k][1], "b": b})
    return list(found.values())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: groups of documents whose shingle sets have similarity >= percent.

    Texts with equal sets are one class, with a number of its own and the text of its smallest ``doc_id``. Classes meet in the buckets of
    their bands. Every class is first compared with one smallest and one largest member of its buckets, those that it
    shares most bands with, which joins groups of copies by stars: a group of a million copies costs two million
    comparisons. Then members of a bucket that are not yet in one component are compared with each other in blocks, so
    that no link between candidates is left out. Full sets decide each link.

    A null, empty or blank text has no shingles and links with nothing. Rows that repeat a ``doc_id`` give a
    row each, as documents of their own: with the same text they are in one class, with other texts each has its own links. A null ``doc_id`` has no component and is kept. An empty table gives none.
    """
    rows = keep(features(docs, words), "shingle-bands")
    known = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("text_key", "doc_id").alias("of"))
    classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    own = known.join(classes, "set_key").where((F.col("doc_id") == F.col("rep")) & (F.col("text_key") == F.col("of")))
    members = own.select("id", F.explode("bands").alias("band"))
    ends = members.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = keep(members.join(ends, "band"), "shared-bands")

    each_end = F.array(
        F.struct(F.lit(0).alias("end"), F.col("low").alias("a")), F.struct(F.lit(1).alias("end"), F.col("high").alias("a"))
    )
    stars = shared.select(F.col("id").alias("b"), F.explode(each_end).alias("x")).select("b", "x.end", "x.a")
    votes = stars.where("a <> b").groupBy("b", "end", "a").agg(F.count("*").alias("n"))
    best = votes.groupBy("b", "end").agg(F.max_by("a", "n").alias("a"))
    pairs = keep(best.select("a", "b").distinct(), "star-pairs")
    candidates = classes.join(shared.select("id").distinct(), "id").select(F.col("id").alias("class"), "rep", "of")
    keyed = docs.select(F.col("doc_id").alias("rep"), "text", F.xxhash64("text").alias("of"))
    texts = keyed.join(candidates, ["rep", "of"]).select(F.col("class").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    texts = keep(texts, "candidate-texts")
    links = keep(confirmed(pairs, texts, words, percent), "star-links")
    groups = components(links)

    more = keep(block_links(shared.select("low", "id").distinct(), groups, texts, words, percent), "block-links")
    if not more.isEmpty():
        groups = components(links.unionByName(more))

    # the smallest doc_id of each component, over classes
    placed = classes.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = placed.groupBy("component").agg(F.min("rep").alias("first"))
    named = placed.join(smallest, "component").select("set_key", "first")
    found = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), linked)
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
