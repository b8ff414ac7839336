import hashlib
import math

import numpy as np

from tidebook.llm import centroids as c

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance int, v int, norm int, inertia int"


def usable(x):
    return x is not None and len(x) == 64 and all(a is not None and math.isfinite(a) for a in x)


def brute(rows, k=16, rounds=3):
    points = [(i, [math.floor(64 * a) for a in x]) for i, x in rows if usable(x)]
    named = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in points if i is not None]
    centroids = [v for _, v in sorted(named)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, z)), n) for n, z in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in points:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centroids[n] = [sum(column) // len(members) for column in zip(*members)]
    out = [(i, *reversed(nearest(v))) for i, v in points]
    inertia = {n: sum(d for _, m, d in out if m == n) for n in range(len(centroids))}
    shas = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centroids]
    return sorted([(i, n, d, inertia[n], sum(inertia.values()), shas[n]) for i, n, d in out], key=str)


def found(spark, rows):
    frame = spark.createDataFrame([(i, x, 1, 2, 3, 4, 5, 6) for i, x in rows], SCHEMA)
    return sorted((tuple(r) for r in c.digest(frame).collect()), key=str)


def vectors(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 64)) / 3
    return [(int(i), (centres[i % 5] + rng.normal(size=64) / 9).tolist()) for i in range(n)]


def test_against_brute_force_with_unusable_repeated_and_tied_rows(spark):
    rows = vectors(150)
    same = rows[0][1]
    rows += [rows[3], rows[3], (3, rows[7][1]), (None, same), (None, same), (900, None), (901, []), (902, same[:63])]
    rows += [(903, [*same, 0.0]), (904, [None, *same[1:]]), (905, [math.nan, *same[1:]]), (906, [math.inf, *same[1:]])]
    rows += [(907, [-math.inf, *same[1:]]), (908, [0.0] * 64), (909, [-0.0] * 64)] + [(1000 + i, same) for i in range(40)]
    assert found(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [0.5] * 64) for i in range(30)]  # all centroids are equal: the first takes every vector
    result = found(spark, rows)
    assert result == brute(rows)
    assert {r[1] for r in result} == {0}


def test_few_and_no_vectors(spark):
    rows = vectors(5)
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [1.0])]) == []
    assert found(spark, [(None, [1.0] * 64)]) == [(None,) * 6]


def test_large_components_are_exact(spark):
    rows = vectors(40) + [(500 + i, [(-1) ** i * (2.0**21 - i) + 0.3] * 64) for i in range(6)]
    assert found(spark, rows) == brute(rows)


def test_no_python_worker_in_the_plan(spark):
    rows = [(i, x, 1, 2, 3, 4, 5, 6) for i, x in vectors(20)]
    points = c.quantised(spark.createDataFrame(rows, SCHEMA))
    plan = c.assigned(points, [[1] * 64, [2] * 64])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
