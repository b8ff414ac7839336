import random
import zlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from tidebook.llm import subwords

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = subwords.load(PATH)


def unigram(byte_fallback=True, collapse=False, prefix=True):
    """The same pieces as a model of the other type, which the library also reads."""
    proto = pb.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = byte_fallback
    if not byte_fallback:
        kept = [p for p in proto.pieces if p.type != 6]
        del proto.pieces[:]
        proto.pieces.extend(kept)
    proto.normalizer_spec.remove_extra_whitespaces = collapse
    proto.normalizer_spec.add_dummy_prefix = prefix
    raw = proto.SerializeToString()
    return subwords.Model(proto=raw), sentencepiece.SentencePieceProcessor(model_proto=raw)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=50))
def test_any_text_equals_the_library(text):
    ids = MODEL.encode([text])[0].tolist()
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeinorst   ▁\nTh.é1", max_size=60))
def test_near_words_equals_the_library(text):
    assert MODEL.encode([text])[0].tolist() == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 260)), max_size=12))
def test_any_ids_decode_like_the_library(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("settings", [{}, {"byte_fallback": False}, {"collapse": True}, {"prefix": False}])
def test_unigram_models_equal_the_library(settings):
    model, library = unigram(**settings)
    assert not model.merges
    rnd = random.Random(1)
    for _ in range(400):
        text = "".join(rnd.choice("the and ing of er  \n xq日本.é\U0001f600") for _ in range(rnd.randint(0, 40)))
        assert model.encode([text])[0].tolist() == library.encode(text), repr(text)


def test_every_neighbourhood_test_agrees_with_merging():
    rnd = random.Random(2)
    ids = list(MODEL.ids.values())
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(4000)]
    words = LIBRARY.encode("the thing is that there are other words in the world of letters and merging " * 3)
    pairs += [(a, b) for a in set(words) for b in set(words)]
    import numpy as np

    left, right = np.array(pairs).T
    expected = [MODEL.merged(MODEL.pieces[a] + MODEL.pieces[b]) == [MODEL.pieces[a], MODEL.pieces[b]] for a, b in pairs]
    whole = MODEL.whole[left] & MODEL.whole[right]
    assert (MODEL.stay_apart(left, right) & whole).tolist() == expected


def test_tables_and_edges(make_docs, spark):
    rows = [(1, "Hello world.\nNext  line"), (2, None), (3, ""), (3, ""), (None, " x "), (4, "word " * 30_000), (5, "a" * 50_000), (6, "\x00�")]
    docs = make_docs(rows)
    found = subwords.encoded_and_checked(docs, PATH).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, text in rows:
        r = by_id[i]
        assert r.ids == LIBRARY.encode(text or "") and r.n_tokens == len(r.ids)
        assert r.text_crc32 == zlib.crc32((text or "").encode())
    ids = spark.createDataFrame([(1, [1, 15043, 3186, 2]), (2, []), (3, None)], "doc_id long, ids array<int>")
    texts = {r.doc_id: r.text for r in subwords.decoded(ids, PATH).collect()}
    assert texts == {1: LIBRARY.decode([1, 15043, 3186, 2]), 2: "", 3: None}
    assert subwords.encoded_and_checked(make_docs([]), PATH).count() == 0
