import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidebook.llm import byte_pairs as b

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ["ab", "aä€😀 \n\t'sréll", " \n\t　x ", "0123456789 a.,-", "etaoin shrdlu", "ABCabc'dt ve", "\u0000\u001f\u0085 x"]
LONG = ["a" * 300_000, " " * 300_000 + "b", "\n\t " * 70_000 + "x", "ab" * 150_000, "é" * 100_000, "-" * 200_000, "1" * 200_000]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def texts():
    r = random.Random(2)
    found = ["".join(r.choice(a) for _ in range(r.choice([1, 3, 9, 40]))) for a in ALPHABETS for _ in range(150)]
    return [*found, "", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "<|endoftext|", "don't  we'Ll 'S\r\n\r\n  x"]


def test_ids_and_text_as_the_library(library):
    known = b.vocabulary(PATH)
    for text in texts() + LONG:
        expected = library.encode(text, add_special_tokens=False).ids
        found = known.encode(text)
        assert ids(found) == expected, text[:50]
        assert known.decode_text(found) == library.decode(expected, skip_special_tokens=False) == text


def test_memory_of_words_and_pairs_is_bounded():
    known = b.Vocabulary(PATH)
    known.words.limit, known.pairs.limit = 50, 50
    expected = b.vocabulary(PATH)
    for text in texts():
        assert known.encode(text) == expected.encode(text)
    assert len(known.words) <= 50 and len(known.pairs) <= 50


def test_any_ids_decode_as_in_the_library(library):
    r = random.Random(3)
    known = b.vocabulary(PATH)
    for _ in range(300):
        some = [r.randrange(50_257) for _ in range(r.randrange(30))]
        data = np.array(some, "<u4").tobytes()
        assert known.decode_text(data) == library.decode(some, skip_special_tokens=False)
    assert known.decode(np.array([60_000, 64, 4_000_000_000], "<u4").tobytes()) == known.decode(np.array([64], "<u4").tobytes())


def test_every_token_is_its_own_segmentation_and_splits_again():
    known = b.vocabulary(PATH)
    for token in range(0, len(known.left), 37):
        whole = known.decode(known.public[token : token + 1].tobytes())
        left, right = known.left[token], known.right[token]
        if token >= known.n_single:
            parts = known.decode(known.public[[left, right]].tobytes())
            assert parts == whole
            assert not known.pairs[left, right]


def test_tables(spark, make_docs, library):
    rows = [(i, t) for i, t in enumerate(texts()[:200])] + [(1, "same"), (1, "same"), (None, "no id"), (7, None), (8, "")]
    docs = make_docs(rows, extra=("ids", "n_tokens"))
    sha = lambda data: hashlib.sha256(data).hexdigest()
    expected = []
    for key, text in rows:
        found = library.encode(text or "", add_special_tokens=False).ids
        expected.append((key, len(found), sha(np.array(found, "<u4").tobytes()), sha((text or "").encode())))
    assert sorted(map(tuple, b.digest(docs, PATH).collect()), key=str) == sorted(expected, key=str)
    back = b.decoded(b.encoded(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(k, t or "") for k, t in rows], key=str)
    assert b.digest(make_docs([]), PATH).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert b.decoded(none, PATH).first()["text"] == ""


def test_files_that_are_not_supported(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "a.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="special"):
        b.Vocabulary(str(tmp_path / "a.json"))
    spec["added_tokens"][0]["lstrip"] = False
    spec["model"]["merges"].append(["Ġt", "he"])
    (tmp_path / "b.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="two merges"):
        b.Vocabulary(str(tmp_path / "b.json"))
