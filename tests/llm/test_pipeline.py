import random

import pytest

import corpus_pipeline
from tidebook.llm import packing, personal_data, quality_rules
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_groups


def corpus():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7)))
    rows, labels = [], []

    def add(text, good=1):
        rows.append((len(rows), text, "en", f"site{len(rows) % 14}", len(text or "")))
        labels.append((len(labels), good, 0))

    for _ in range(160):
        paragraphs = [" ".join(word() for _ in range(rnd.randint(20, 40))) for _ in range(4)]
        if rnd.random() < 0.5:
            paragraphs.insert(rnd.randint(0, 4), "Home About Contact us")
        if rnd.random() < 0.3:
            paragraphs[0] += f" {word()}@example.org or 10.1.2.{rnd.randrange(99)}"
        add("\n".join(paragraphs))
    for k in range(30):
        add(rows[k][1].replace("a", "b", 1))  # near copies
    for k in range(20):
        add(rows[40 + k][1])
    for _ in range(12):
        add(rows[80][1])
    for _ in range(60):
        add(" ".join(word() + "%%" for _ in range(70)), 0)
    for _ in range(12):
        add("too short", 0)
    add("Home About Contact us\n" * 30)
    add(None)
    add("")
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    outs = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if k < 4:
            assert made.columns == columns
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(docs.collect())

    stats = {r.doc_id: quality_rules.text_statistics(r.text or "") for r in outs[0]}
    base = {i for i, s in stats.items() if s[0] < 50 or 2 * s[4] > s[0]}
    good = {i for i, q, _ in corpus()[1] if q}
    assert {r.doc_id for r in outs[1]} == good - base
    assert all(r in outs[0] for r in outs[1])

    cleaned = brute_lines([(r.doc_id, r.text, r.source) for r in outs[1]], 10)
    expected = sorted((i, t) for i, _, gone, t in cleaned if not gone or t.strip())
    assert sorted((r.doc_id, r.text) for r in outs[2]) == expected
    assert all(r.n_chars == len(r.text) for r in outs[2]) and len(outs[2]) < len(outs[1])

    kept = {i for i, _, _, k in brute_groups([(r.doc_id, r.text) for r in outs[2]], 5, 80) if k}
    assert {r.doc_id for r in outs[3]} == kept and len(kept) < len(outs[2])
    assert all(r in outs[2] for r in outs[3])

    before = {r.doc_id: r.text for r in outs[3]}
    assert {r.doc_id for r in outs[4]} == set(before)
    for r in outs[4]:
        assert not personal_data.base_spans(r.text) and r.n_chars == len(r.text)
        if not personal_data.base_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]

    encode = packing.encoder(corpus_pipeline.BYTE_VOCABULARY).encode
    lengths = {}
    for r in outs[5]:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: len(encode(r.text, allowed_special="all")) + 1 for r in outs[4]}
    assert {r.asDict()["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in outs[5]}


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_one_row_of_repeated_rows_and_of_rows_without_id_stays(spark):
    long = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcde"]
    rows = [(7, long[0], "x"), (7, long[0], "y"), (7, long[0], "y"), (None, long[1], "x"), (None, long[1], "x")]
    rows += [(None, long[2], "x"), (3, long[2] + " more", "x"), (5, long[2], "x"), (9, long[3], "x"), (9, long[4], "x"), (1, None, "x"), (2, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    expected = [(7, long[0]), (None, long[1]), (3, long[2] + " more"), (9, long[3]), (9, long[4]), (1, None), (2, "")]
    kept = [tuple(r) for r in found.collect()]
    assert sorted((r[:2] for r in kept), key=str) == sorted(expected, key=str)
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(5), "").collect()
    assert sorted(kept, key=str) == sorted((tuple(r) for r in again), key=str)
