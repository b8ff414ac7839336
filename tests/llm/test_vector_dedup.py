import math

import numpy as np

from tidebook.llm import vector_dedup as v

SCHEMA = "vec_id long, embedding array<float>, label int, n int, low int, id int, cells int"


def brute(rows, cosine):
    good = [
        i for i, x, l in rows
        if i is not None and l is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)
    ]
    ok = [i is not None and l is not None and bool(x) and all(c is not None and math.isfinite(c) for c in x) and any(x) for i, x, l in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    data = [np.array(x, dtype=np.float32).astype(float) if o else None for (_, x, _), o in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(data[i]) == len(data[j]):
                a, b = data[i], data[j]
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    root[top(i)] = top(j)
    assert good is not None
    out = []
    for i, r in enumerate(rows):
        component = min(rows[j][0] for j in range(len(rows)) if top(j) == top(i)) if ok[i] else r[0]
        out.append((r[0], n[i], component, r[0] is None or component == r[0]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for group in range(14):
        base = rng.normal(size=24)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.choice([1, 3, 8, 30]))):
            noise = rng.normal(size=24) / math.sqrt(24)
            rows.append((k, (base + noise * rng.uniform(0, 0.25)).tolist(), group % 3))
            k += 1
    order = rng.permutation(1000)
    rows = [(int(order[i]), x, l) for i, x, l in rows]
    same = rows[0][1]
    rows += [(1000 + i, same, rows[0][2]) for i in range(9)] + [(1100, [2 * c for c in same], rows[0][2]), (1101, same, None)]
    rows += [(1200, None, 1), (1201, [0.0] * 24, 1), (1202, [None, *same[1:]], 1), (1203, [float("nan"), *same[1:]], 1)]
    rows += [(1204, [float("inf"), *same[1:]], 1), (1205, [], 1), (1206, same[:5], 0), (None, same, 0), (1207, same[:5], 0)]
    rows += [rows[3], rows[3]]
    far = rng.normal(size=24).tolist()  # rows that share an id but not the vector, or not the label
    rows += [(7, far, 0), (7, far, 1), (2000, far, 0), (2001, [c * 1.001 for c in far], 1), (7, rows[40][1], 2), (2002, rows[40][1], 2)]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    found = sorted((tuple(r) for r in v.near_vectors(frame).collect()), key=str)
    assert found == brute(rows, 0.98)


def test_blocks_and_neighbourhoods_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(v, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.17).tolist(), 0) for i in range(150)]
    found = sorted((tuple(r) for r in v.near_vectors(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)).collect()), key=str)
    assert found == brute(rows, 0.98) and sum(r[1] for r in found) > 300


def test_empty_table(spark):
    assert v.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
