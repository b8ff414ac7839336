import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidebook.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_tokenizer_library(text):
    expected = Tokenizer.from_file(PATH) if not hasattr(test_ids_equal_the_tokenizer_library, "t") else None
    t = test_ids_equal_the_tokenizer_library.t = getattr(test_ids_equal_the_tokenizer_library, "t", expected)
    assert packing.encoder(PATH).encode(text, allowed_special="all") == t.encode(text, add_special_tokens=False).ids


def test_ids_with_special_text(library):
    text = "a<|endoftext|>b  <|endoftext|>"
    assert packing.encoder(PATH).encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


N = 1_000_000


@pytest.mark.parametrize(
    "text",
    [
        "a" + " " * N + "b",
        "a" + "\t" * N,
        "\n" * N + "<|endoftext|>" + " " * N + "x",
        "a" + "\r\n \t" * (N // 4) + "'s",
        ("\u3000 " * 9_000 + "word ") * 3,
        (" " * 9_999 + "x") * 20,
        "word" * (N // 4) + " " * 20_000 + "7" * N + "?!" * (N // 2),
    ],
    ids=range(7),
)
def test_long_runs(library, text):
    assert packing.text_encoder(PATH)(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents_with_long_runs_are_packed(make_docs):
    rows = packing.pack_digest(make_docs([(1, "a" + " " * N + "b"), (2, "x")]), PATH).collect()
    first = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["piece"])
    ids = Tokenizer.from_file(PATH).encode("a" + " " * N + "b", add_special_tokens=False).ids
    assert sum(r["length"] for r in first) == len(ids) + 1
    assert first[-1]["ids_crc32"] == zlib.crc32(np.array([*ids, 2][-first[-1]["length"] :], dtype="<u4").tobytes())


def check_plan(counts, capacity):
    plan = packing.plan_patterns(counts, capacity)
    used = np.zeros(capacity + 1, dtype=np.int64)
    for content, n in plan:
        assert n > 0 and sum(length * copies for length, copies in content) <= capacity
        for length, copies in content:
            used[length] += n * copies
    assert (used == counts).all()
    return sum(n for _, n in plan)


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_once_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, dtype=np.int64)
    counts[1:] = rng.poisson(rng.choice([0.3, 4, 60]), 256) * (rng.random(256) < rng.choice([0.3, 1]))
    bound = math.ceil((counts * np.arange(257)).sum() / 256)
    plain = sum(n for _, n in packing.best_fit(counts.copy(), 256))
    assert bound <= check_plan(counts, 256) <= plain * 1.005


def test_plan_edges():
    assert packing.plan_patterns(np.zeros(17, dtype=np.int64), 16) == []
    one = np.zeros(17, dtype=np.int64)
    one[1] = 1000
    assert check_plan(one, 16) == 63
    one[16] = 5
    assert check_plan(one, 16) == 68
    hot = np.zeros(17, dtype=np.int64)
    hot[9] = 10**9
    hot[7] = 10**9
    assert check_plan(hot, 16) == 10**9


def brute_pieces(library, doc_id, text, capacity):
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(doc_id, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_pack_edges(spark, make_docs, library):
    rnd = random.Random(3)
    words = ["the", "Œuvre", "1234", "\n\n", "  x", "été", "don't", "<|endoftext|>", "日本"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "word " * 500), (62, "word " * 500), (None, "no id"), (63, "x" * 31), (64, " ")]
    packed = packing.pack(make_docs(rows), PATH, capacity=32)
    found = packed.collect()
    expected = sorted((p for r in rows for p in brute_pieces(library, *r, 32)), key=str)
    assert sorted(((*r[:4], bytes(r.tokens)) for r in found), key=str) == expected
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.tokens)))
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    whole = {r.sequence_id: bytes(r.tokens) for r in packing.sequences(spark.createDataFrame(found, packed.schema)).collect()}
    assert whole == {k: b"".join(t for _, _, t in sorted(v)) for k, v in by_sequence.items()}
    assert len(by_sequence) <= math.ceil(sum(r.length for r in found) / 32) * 1.05 + 1


def test_pack_of_nothing(make_docs):
    assert packing.pack_digest(make_docs([]), PATH).count() == 0


def test_digest(make_docs, library):
    row = packing.pack_digest(make_docs([(5, "some text")]), PATH).collect()[0]
    ids = np.array([*library.encode("some text").ids, 2], "<u4")
    assert row.asDict() == {
        "doc_id": 5, "piece": 0, "start": 0, "length": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()),
        "sequence_id": 0, "offset": 0,
    }
