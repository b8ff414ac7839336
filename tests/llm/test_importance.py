import math
import random

import numpy as np
import pytest

from tidebook.llm import importance as imp


def corpus(n=400):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        junk = i % 4 == 0
        pool = [f"junk{k}" for k in range(40)] if junk else [f"fine{k}" for k in range(60)]
        pool += [f"both{k}" for k in range(20)]
        rows.append((i, " ".join(rnd.choices(pool, k=rnd.randint(1, 90)))))
        if i % 3 == 0:
            labels.append((i, int(not junk)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(corpus()[1] + [(None, 1), (1, None)], "doc_id long, quality int")


def test_counts_are_those_of_all_texts(make_docs, labelled, spark):
    rows, labels = corpus()
    good = {i for i, q in labels if q}
    marked = spark.createDataFrame([(t, i in good) for i, t in rows], "text string, is_target boolean")
    found = {r.bucket: (r.target, r.raw) for r in imp.bucket_counts(marked).collect()}
    raw, target = np.zeros(imp.BUCKETS, int), np.zeros(imp.BUCKETS, int)
    for i, t in rows:
        for b in imp.text_buckets(t):
            raw[b] += 1
            target[b] += i in good
    assert found == {b: (target[b], raw[b]) for b in np.flatnonzero(raw)}
    ratio = imp.fit(make_docs(rows), labelled).values
    expected = np.log((target + 0.5) / (target.sum() + imp.BUCKETS / 2)) - np.log((raw + 0.5) / (raw.sum() + imp.BUCKETS / 2))
    assert np.allclose(ratio, expected)


def test_selection_against_brute_force_and_held_out_labels(make_docs, labelled):
    rows, _ = corpus()
    found = imp.selected(make_docs(rows), labelled, share=0.75).collect()
    order = sorted(found, key=lambda r: (-r.draw, r.doc_id))
    assert {r.doc_id for r in found if r.kept} == {r.doc_id for r in order[:300]}
    unseen = [r for r in found if r.doc_id % 3]
    assert np.mean([r.kept == bool(r.doc_id % 4) for r in unseen]) > 0.95
    ratio = imp.fit(make_docs(rows), labelled)
    texts = dict(rows)
    for r in found[:50]:
        grams = ratio.values[imp.text_buckets(texts[r.doc_id])]
        assert r.log_weight == pytest.approx(imp.SHARPNESS * grams.mean())
        assert ratio.log_weight(texts[r.doc_id], None) == pytest.approx(grams.sum())


def test_sum_of_the_log_ratios_as_weight(make_docs, labelled):
    rows = [*corpus()[0], (1000, None), (1001, "")]
    ratio = imp.fit(make_docs(rows), labelled)
    texts = dict(rows)
    found = imp.selected(make_docs(rows), labelled, share=0.5, sharpness=None).collect()
    for r in found:
        assert r.log_weight == pytest.approx(ratio.values[imp.text_buckets(texts[r.doc_id] or "")].sum())
    order = sorted(found, key=lambda r: (-r.draw, r.doc_id))
    assert {r.doc_id for r in found if r.kept} == {r.doc_id for r in order[:201]}


def test_noise_is_gumbel_and_repeatable(make_docs):
    flat = imp.Ratio(np.zeros(imp.BUCKETS))
    docs = make_docs([(i, "x") for i in range(4000)])
    draws = np.array([r.draw for r in imp.weighed(docs, flat).collect()])
    assert abs(draws.mean() - 0.5772) < 0.07 and abs(draws.var() - math.pi**2 / 6) < 0.15
    assert sorted(draws) == sorted(r.draw for r in imp.weighed(docs.repartition(7), flat).collect())
    assert sorted(draws) != sorted(r.draw for r in imp.weighed(docs, flat, seed=1).collect())


@pytest.mark.parametrize("bound", [3, 10_000])
def test_kth_largest(spark, bound):
    rnd = random.Random(1)
    for values in ([rnd.random() ** 9 for _ in range(500)], [rnd.randrange(6) * 1.0 for _ in range(500)], [1.0] * 40, [5.0], []):
        rows = spark.createDataFrame([(v,) for v in values], "draw double")
        for k in (0, 1, len(values) // 3, len(values) - 1, len(values)):
            value, ties = imp.largest(rows, k, bins=8, bound=bound)
            assert sum(v > value for v in values) + ties == max(min(k, len(values)), 0)
            assert ties <= sum(v == value for v in values)


def test_edges(make_docs, labelled, spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "fine1 " * 50_000), (None, "fine2"), (None, None), (4, "junk1 junk2")]
    found = imp.selected(make_docs(rows), labelled, share=0.5).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == 4  # two equal rows draw the same
    assert imp.selected(make_docs([]), labelled).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.kept for r in imp.selected(make_docs(rows), none).collect()} == {True}
    assert imp.target_share(labelled) == pytest.approx(0.75, abs=0.03)


def test_repeated_rows_are_kept_as_often_as_asked(make_docs, labelled):
    rows = [(1, "fine1 fine2")] * 6 + [(2, "junk1 junk2")] * 5 + [(None, "fine3")] * 7 + [(None, None)] * 2 + [(3, "fine1")]
    for share in (0.0, 0.15, 0.3, 0.5, 0.75, 1.0):
        found = imp.selected(make_docs(rows).repartition(5), labelled, share=share).collect()
        assert len(found) == len(rows) and sum(r.kept for r in found) == math.ceil(len(rows) * share)
        least = min((r.draw for r in found if r.kept), default=math.inf)
        assert all(r.kept for r in found if r.draw > least) and not any(r.kept for r in found if r.draw < least)


def test_equal_draws_go_to_the_smaller_ids(make_docs, labelled, monkeypatch):
    def flat(docs, ratio, seed, sharpness):
        zero = imp.F.lit(0.0)
        return docs.select("doc_id", zero.alias("log_weight"), zero.alias("draw"))

    monkeypatch.setattr(imp, "weighed", flat)
    rows = [(i, "x") for i in (5, -2, 9, 9, 9, 4)] + [(None, "x")] * 3
    for k, ids in ((2, [-2, 4]), (4, [-2, 4, 5, 9]), (6, [-2, 4, 5, 9, 9, 9]), (7, [-2, 4, 5, 9, 9, 9, None])):
        found = imp.selected(make_docs(rows), labelled, share=k / len(rows) - 1e-9).collect()
        assert sorted((r.doc_id for r in found if r.kept), key=lambda i: (i is None, i or 0)) == ids


def test_every_target_counts(make_docs, spark):
    n = 30_000  # more than any sample that was ever drawn
    docs = make_docs([(i, f"w{i}") for i in range(n)] + [(None, "w0 other")])
    labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
    counted = np.bincount(np.concatenate([imp.text_buckets(f"w{i}") for i in range(n)]), minlength=imp.BUCKETS)
    everything = counted + np.bincount(imp.text_buckets("w0 other"), minlength=imp.BUCKETS)
    expected = np.log((counted + 0.5) / (counted.sum() + imp.BUCKETS / 2))
    expected -= np.log((everything + 0.5) / (everything.sum() + imp.BUCKETS / 2))
    assert np.allclose(imp.fit(docs, labels).values, expected)
