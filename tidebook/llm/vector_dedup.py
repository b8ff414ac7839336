"""Near-duplicate vectors of a label by p-stable hashing of normalised vectors and exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.common import components, keep

#: Normalised vectors of cosine c are sqrt(2 - 2c) apart: 0.2 at 0.98. One projection of width 1.2 puts such a pair in
#: the same cell with probability 0.867, all twelve of a table with 0.18, and one of 80 tables but once in ten million.
#: Orthogonal vectors share a table once in a million times.
TABLES = 80
PROJECTIONS = 12
WIDTH = 1.2
SEED = 98
#: Vectors on each side of a block of exact comparisons.
BLOCK = 256


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64) for x in column]


def hashed(vectors: DataFrame) -> DataFrame:
    """``id, cells``: one key per table, made of the label, the table and the cells of all its projections."""
    schema = T._parse_datatype_string("id long, cells array<long>")
    arrow = to_arrow_schema(schema)

    def run(batches):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rng = np.random.default_rng(SEED)
        mixer = rng.integers(0, 1 << 63, (TABLES, PROJECTIONS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            found = []
            for label, x in zip(batch.column(1).to_pylist(), _matrix(batch.column(2)), strict=True):
                if len(x) not in planes:
                    draw = np.random.default_rng((SEED, len(x)))
                    planes[len(x)] = draw.normal(size=(TABLES * PROJECTIONS, len(x))), draw.random(TABLES * PROJECTIONS)
                direction, shift = planes[len(x)]
                cell = np.floor(direction @ (x / np.linalg.norm(x)) / WIDTH + shift).astype(np.int64).view(np.uint64)
                key = (cell.reshape(TABLES, PROJECTIONS) * mixer[:, 1:]).sum(axis=1, dtype=np.uint64)
                key = (key ^ (key >> np.uint64(31))) * mixer[:, 0] + np.uint64(label % (1 << 64)) * np.uint64(len(x) * 2 + 1)
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                found.append((key ^ (key >> np.uint64(32))).view(np.int64))
            cells = pa.array(found, type=arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], schema=arrow)

    return vectors.select("id", F.col("label").cast("long"), "embedding").mapInArrow(run, schema)


def block_links(members: DataFrame, cosine: float) -> DataFrame:
    """``id, n, root`` per block: rows linked with ``id`` there, and the smallest id reachable inside the block.

    ``members`` has ``low, id, n, lows, embedding``: neighbourhoods with the sizes of classes. Blocks of a neighbourhood
    are compared two by two, each pair of blocks in one place. Two vectors can be in several neighbourhoods; a link
    counts in the one with the smallest name only.
    """
    # as a table, so that the join with a large neighbourhood can be split
    sizes = keep(members.groupBy("low").agg(F.count("*").alias("size")), "neighbourhood-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.join(sizes, "low").withColumn("blocks", blocks)
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "low", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "n", "lows", "embedding"
    )
    dealt = dealt.repartition("low", "i", "j").sortWithinPartitions("low", "i", "j", "mine", "id")
    schema = T._parse_datatype_string("id long, n long, root long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, rows = None, []
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True))
            found = []
            for (*here, mine, doc, n, lows), x in zip(names, _matrix(batch.column(7)), strict=True):
                if here != key:
                    found += _links_of_block(key, rows, cosine)
                    key, rows = here, []
                rows.append((mine, doc, n, lows, x))
            yield pa.RecordBatch.from_pylist(found, schema=arrow)
        yield pa.RecordBatch.from_pylist(_links_of_block(key, rows, cosine), schema=arrow)

    return dealt.mapInArrow(run, schema)


def _links_of_block(key: list | None, rows: list[tuple], cosine: float) -> list[dict]:
    if len(rows) < 2:
        return []
    low, i, j = key
    block, ids, sizes = (np.array([r[k] for r in rows]) for k in range(3))
    if len({len(r[4]) for r in rows}) > 1:  # a chance meeting of vectors that can't be compared
        parts: dict[int, list[tuple]] = {}
        for r in rows:
            parts.setdefault(len(r[4]), []).append(r)
        return [x for part in parts.values() for x in _links_of_block(key, part, cosine)]
    x = np.stack([r[4] for r in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    linked = x @ x.T / np.outer(norm, norm) >= cosine
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= block[:, None] != block[None, :]
    a, b = np.nonzero(linked)
    earlier = [sorted(v for v in r[3] if v < low) for r in rows]
    most = max(map(len, earlier))
    if most and len(a):  # of the neighbourhoods that both are in, is this the first?
        table = np.full((len(rows), most), -1, dtype=np.int64)
        known = np.zeros((len(rows), most), dtype=bool)
        for k, e in enumerate(earlier):
            table[k, : len(e)], known[k, : len(e)] = e, True
        again = np.zeros(len(a), dtype=bool)
        for k in range(most):
            again |= ((table[a] == table[b, k][:, None]) & known[a] & known[b, k][:, None]).any(axis=1)
        linked[a[again], b[again]] = False
    count = linked @ sizes
    root = ids.copy()
    while True:  # labels of neighbours until nothing changes; a block is small
        nearer = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (nearer == root).all():
            break
        root = nearer
    used = np.flatnonzero(count)
    return [{"id": int(ids[k]), "n": int(count[k]), "root": int(root[k])} for k in used]


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: links between vectors of equal labels with at least this cosine.

    Equal vectors of a label are one class with a number of its own, also where rows share a ``vec_id``; classes meet in the cells of the
    tables and every two that meet are compared in double precision. Vectors that are null, zero, of another length, or
    hold null or non-finite numbers, and those with a null label or id link with nothing. Repeated rows are vectors of
    their own: each counts as a link of the others. Only ids break ties. An empty table gives none.
    """
    vector = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull()
        & F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
        & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))
    )
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"), usable.alias("usable"))
    keys = [F.xxhash64("embedding").alias("a"), F.xxhash64("embedding", F.lit(1)).alias("b")]
    keyed = rows.select("vec_id", "label", "usable", *keys)
    classes = keyed.where("usable").groupBy("label", "a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    first = rows.where("usable").select(F.col("vec_id").alias("rep"), "label", "embedding", *keys)
    first = first.join(classes, ["label", "a", "b", "rep"]).dropDuplicates(["id"])
    first = keep(first.select("id", "label", "n", "embedding"), "class-vectors")

    members = hashed(first).select("id", F.explode("cells").alias("cell"))
    ends = members.groupBy("cell").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    near = keep(members.join(ends.select("cell", "low"), "cell").select("low", "id").distinct(), "neighbourhoods")
    lows = near.groupBy("id").agg(F.collect_set("low").alias("lows"))  # at most one per table
    described = first.select("id", "n", "embedding").join(lows, "id")
    blocks = keep(block_links(near.join(described, "id"), cosine), "vector-links")
    links = blocks.groupBy("id").agg(F.sum("n").alias("links"))
    groups = components(blocks.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())

    # the smallest vec_id of each component, over classes
    placed = classes.join(links, "id", "left").join(groups, "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    smallest = placed.groupBy("component").agg(F.min("rep").alias("smallest"))
    named = placed.join(smallest, "component").select("label", "a", "b", "n", "links", "smallest")
    found = keyed.join(named, ["label", "a", "b"], "left")
    component = F.when(F.col("usable"), F.col("smallest")).otherwise(F.col("vec_id"))
    others = F.when(F.col("usable"), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0).cast("long"))
    return found.select(
        "vec_id", others.alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
