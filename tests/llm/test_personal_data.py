import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebook.llm import personal_data as p
from tidebook.llm import tagger

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.1-+ ()0é5\n4", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert p.base_spans(text) == brute(text)


def test_base_spans_of_hard_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "@." * 100_000, "a.b@" + "c." * 100_000):
        p.base_spans(text)
    assert p.base_spans("x" * 300_000 + "@y.z") == [("email", 0, 300_004)]


def with_luhn(rnd):
    digits = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
    return next(digits + str(k) for k in range(10) if p.luhn(digits + str(k)))


def datum(rnd, kind):
    return {
        "email": f"{rnd.choice(['ann', 'bob.x', 'kim'])}{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.org",
        "ip": ".".join(str(rnd.randrange(1, 255)) for _ in range(4)),
        "card": with_luhn(rnd),
        "phone": f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}",
    }[kind]


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 8))) for _ in range(rnd.randint(5, 60))]
        if i % 2:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randint(0, len(words)), datum(rnd, rnd.choice(p.KINDS)))
        if i % 7 == 0:
            words.insert(0, "token=" + "".join(rnd.choices("0123456789abcdef", k=32)))
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def weights(spark, make_docs):
    return p.fit(make_docs(corpus(900, 1)))


def test_held_out_windows_are_tagged_right(weights):
    right = total = 0
    for _, text in corpus(300, 2):
        for symbols, tags in p.examples(text, 0):
            path = tagger.decode(weights, symbols[None])[0]
            right, total = right + (path == tags).all(), total + 1
    assert right / total > 0.85


def test_more_spans_than_the_patterns_find_and_none_in_clean_texts(weights):
    rnd = random.Random(4)
    missed = found = 0
    for _ in range(60):
        text = f"abc de {datum(rnd, 'phone')} {datum(rnd, 'card')} cde abce"
        (base, spans), = p.all_spans(weights, [text])
        missed += len(base) < 2
        found += len(spans) == 2
        assert set(base) <= set(spans)
    assert missed > 20 and found > 45
    assert all(not spans for _, spans in p.all_spans(weights, [t for i, t in corpus(200, 5) if i % 2 == 0]))


def test_results_and_edges(make_docs, spark, weights):
    rows = corpus(60, 3) + [(100, None), (101, ""), (101, ""), (None, "a@b.cd"), (102, "1 " * 60_000), (103, "é" * 10 + "1.2.3.4" + "\U0001f600 5.6.7.8")]
    found = p.found_spans(make_docs(rows), weights).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, text in rows:
        base = [tuple(s) for s in by_id[i].base]
        spans = [tuple(s) for s in by_id[i].spans]
        assert base == brute(text) and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (p.KINDS.index(s[0]), s[1]))
    digests = {r.doc_id: r for r in p.digest(make_docs(rows)).collect()}
    for i, text in rows:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
        assert digests[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [digests[i][f"n_{k}"] for k in p.KINDS] == [sum(s[0] == k for s in brute(text)) for k in p.KINDS]
    for empty in (make_docs([]), make_docs([(1, "no data here"), (2, None)])):
        assert p.digest(empty).where("spans <> ''").count() == 0


def test_masking(make_docs, weights):
    rows = [(1, "x a.b@c.de 1.2.3.4"), (2, None), (3, "nothing")]
    docs = make_docs(rows)
    found = p.masked(docs, weights)
    assert found.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in found.collect()} == {1: ("x [EMAIL] [IP]", 14), 2: (None, None), 3: ("nothing", 7)}
    assert p.masked_text("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a[IP]f"


def test_windows_cover_all_digits_and_overlapping_ones_are_reconciled(weights):
    rnd = random.Random(6)
    text = " ".join(datum(rnd, "ip") for _ in range(60))
    starts = p.windows_of(text)
    assert all(any(s <= k < s + p.WINDOW for s in starts) for k, c in enumerate(text) if c.isdigit())
    (spans,) = p.tagged(weights, [text])
    assert len({(a, b) for _, a, b in spans} & {(a, b) for _, a, b in brute(text)}) > 50


def test_gradient():
    rng = np.random.default_rng(0)
    shape = tagger.Shape(7, 5, 3, 4)
    weights = tagger.initial(shape, 1)
    symbols, tags = rng.integers(0, 7, (3, 6)), rng.integers(0, 5, (3, 6))
    _, grads = tagger.loss(weights, symbols, tags)
    for name, value in weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            nudged = []
            for sign in (1, -1):
                moved = value.copy()
                moved[at] += sign * 1e-5
                nudged.append(tagger.loss({**weights, name: moved}, symbols, tags)[0])
            assert (nudged[0] - nudged[1]) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)


def test_rare_personal_data_is_found_for_training(spark):
    # 80 of 70,000 documents hold a digit and 40 a span; one footer stands in every one of the 80
    text = F.when(F.col("id") % 875 != 0, F.lit("nothing")).otherwise(
        F.concat(F.lit("token 7 "), F.when(F.col("id") % 2 == 0, F.concat(F.lit("ann"), F.col("id"), F.lit("@b.cd "))).otherwise(""), F.lit("x " * 100 + "page 1 of 2"))
    )
    docs = spark.range(70_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    found = p.training_windows(docs, 60, 200).toPandas()
    assert not found.duplicated(["symbols", "tags"]).any()
    assert found["holds"].sum() > 12 and (~found["holds"]).sum() > 1  # all digits are one symbol
    unnamed = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert p.training_windows(unnamed, 60, 200).where("holds").count() > 12
    few = spark.range(70_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 69_999, "a@b.cd").otherwise("no").alias("text"))
    assert p.fit(few, 60, 200) is not None


def test_training_does_not_depend_on_partitions(make_docs):
    docs = make_docs(corpus(300, 5))
    drawn = [p.training_windows(docs.repartition(n), 200, 150).toPandas() for n in (1, 9)]
    assert len(drawn[0]) == 150
    for column in ("symbols", "tags", "holds"):
        assert [bytes(x) if column != "holds" else x for x in drawn[0][column]] == [
            bytes(x) if column != "holds" else x for x in drawn[1][column]
        ]


def test_span_pool_is_bounded_and_holds_spans_of_the_texts(make_docs):
    texts = make_docs(corpus(200, 6) + [(9_000, "a" * 100 + "@example.org"), (9_001, None), (9_002, "")]).withColumnRenamed("doc_id", "row")
    every = p.span_pool(texts)
    assert every and all((k, 0, len(form)) in p.base_spans(form) and len(form) <= 64 for k, form in every)
    assert p.span_pool(texts.repartition(5), 7) == every[:7]
    assert p.span_pool(texts.limit(0)) == []
