import random
import re

import numpy as np

from tidebook.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def sample_rows():
    rnd = random.Random(2)
    pool = ["a", "b", "été", "日本", "x#", "|", "word", "\n", "\t", "\x1f", "x\n", "\n a", "$%"]
    rows = [(i, " ".join(rnd.choices(pool, k=rnd.choice([0, 5, 60, 200])))) for i in range(60)]
    return rows + [(60, None), (61, ""), (61, ""), (None, "a b c " * 30), (62, "w " * 100_000), (63, "\n\n")]


def test_statistics_and_base_rules(make_docs, spark):
    labels = spark.createDataFrame([(1, None), (None, 0), (2, 1)], "doc_id long, quality int")
    found = q.judged(make_docs(sample_rows()), labels)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found.collect()]
    short = [(i, t) for i, t in sample_rows() if len(t or "") < 100_000]
    assert sorted((g for g in got if g[0] != 62), key=str) == sorted(((i, *brute(t)) for i, t in short), key=str)
    assert (62, 100_000, 100_000, 0, 0, 100_000, True) in got
    assert all(r.kept != r.base_failed for r in found.collect())


def learnable(spark, n=900):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        kind = i % 4
        words = [rnd.choice("abcdefghij") * rnd.randint(2, 9) + str(rnd.randrange(999)) for _ in range(rnd.randint(60, 120))]
        if kind == 0:
            words = [w + "##" for w in words]
        if kind == 1:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if kind < 2 else 1))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int")


def test_learned_rules_reject_what_is_labelled_bad_and_keep_the_rest(make_docs, spark):
    rows, labels = learnable(spark)
    docs = make_docs(rows)
    rules = q.fit(q.statistics(docs), labels)
    assert len(rules) == 2 and all(len(r) == 1 for r in rules)
    kept = {r.doc_id for r in q.judged(docs, labels).where("kept").collect()}
    assert kept == {i for i, _ in rows if i % 4 >= 2}
    # the expression and the learner's own evaluation agree
    filtered = q.kept_documents(docs, labels)
    assert filtered.columns == docs.columns and {r.doc_id for r in filtered.collect()} == kept
    assert q.rule_text(rules)


def test_learner_on_noise_and_little_data():
    rng = np.random.default_rng(0)
    x, order = rng.random((600, 3)), rng.integers(0, 3, 600)
    assert q.learn_rules(x, rng.random(600) < 0.3, order) == []
    assert q.learn_rules(x[:0], np.zeros(0, dtype=bool), order[:0]) == []
    assert q.learn_rules(x, np.ones(600, dtype=bool), order) == []
    both = (x[:, 0] > 0.5) & (x[:, 1] < 0.4)
    rules = q.learn_rules(x, both, order)
    assert rules and (np.logical_or.reduce([q._holds(r, x) for r in rules]) == both).mean() > 0.98


def test_filter_keeps_rows_as_they_are(make_docs, spark):
    docs = make_docs(sample_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = q.kept_documents(docs, none)
    assert sorted(map(str, found.collect())) == sorted(
        str(r) for r in docs.collect() if not (brute(r.text)[5] if len(r.text or "") < 100_000 else True)
    )
    assert q.judged(make_docs([]), none).count() == 0 and q.kept_documents(make_docs([]), none).count() == 0
