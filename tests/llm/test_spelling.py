import random
import re
import zlib
from collections import Counter

import numpy as np

from tidebook.llm import spelling as s


def words_of(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    return (found | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def brute(rows):
    n = words_of(rows)
    letters = sorted(set("".join(n)))
    near = {w: [o for o in edits(w, letters) if o in n] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(make_docs, rows, **options):
    return sorted((tuple(r) for r in s.variants(make_docs(rows, extra=("word", "n", "root")), **options).collect()), key=str)


def corpus(seed, size=300):
    r = random.Random(seed)
    letters = "abeéßÿÀ"
    base = ["".join(r.choice(letters) for _ in range(r.choice([5, 6, 7, 8, 12]))) for _ in range(25)]
    variants = [v for w in base for v in r.sample(sorted(edits(w, letters)), 6)]
    weights = [r.choice([1, 30, 150]) for _ in base] + [r.choice([1, 3, 8]) for _ in variants]
    return [(r.choice([None, 1, 2, i, i]), " ".join(r.choices(base + variants, weights, k=60)) + ". ABE") for i in range(size)]


def test_against_brute_force(make_docs):
    rows = corpus(3) + [(5, None), (6, ""), (7, "no words here: 12345 ..."), (None, None)]
    rows += rows[:20] + [(9, "Ab-" * 50 + "abcdeÿ" * 30_000), (10, "Éßéabe " * 40_000)]
    rows += [(11 + i, "qqqqqqq qqqqqqe qqqqqqe qqqqqqe qqqqqqe qqqqqqe qqqqqqe " + "qqqqqee " * 40) for i in range(7)]
    expected = brute(rows)
    assert sum(e[1] is not None for e in expected) > 10
    assert any(e[2] not in (e[0], e[1]) for e in expected)
    assert found(make_docs, rows) == expected


def test_many_filters_and_rounds_give_the_same(make_docs):
    rows = corpus(4, 120)
    assert found(make_docs, rows, filter_words=7, round_bytes=64) == brute(rows)


def test_ties_chains_and_one_edit_by_two_ways(make_docs):
    text = "aabbcc " * 5 + "abbccd " * 25 + "aabbcd " * 25 + "abbbcd " * 125 + "aabbccc " * 5 + "zzzzzz " * 5 + "zzzzzzz " * 26
    rows = [(1, text)]
    assert found(make_docs, rows) == brute(rows)


def test_no_words(make_docs):
    assert found(make_docs, []) == []
    assert found(make_docs, [(1, None), (2, "short words only, all rare")]) == []


def test_hashes_of_edits_are_hashes_of_the_edited_words():
    words = ["aabbcé", "zyxwvu", "aaaaaa"]
    every = {w for x in words for w in edits(x, "abcyé") if len(w) in (5, 6)}
    hashes = {}
    for length in (5, 6):
        group = sorted(w for w in every if len(w) == length)
        hashes[length, 0] = np.full(64, np.uint64(2**64 - 1)), group
    full = {key: bits for key, (bits, _) in hashes.items()}
    letters = np.array(sorted(map(ord, "abcyé")))
    made = s.Edits(full, {5: 1, 6: 1}, letters).of(words, 6)
    assert sorted(made) == sorted(set(made))
    smaller = {(i, e) for i, w in enumerate(words) for e in edits(w, "abcyé") if len(e) == 5 or (len(e) == 6 and e < w)}
    assert set(made) == smaller


def test_a_filter_has_all_its_words_and_few_others(spark):
    words = [f"{a}{b}{c}word" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    bits = {(r["length"], r["shard"]): np.frombuffer(bytes(r["bits"]), np.uint64) for r in s.filters(table, {7: 3}).collect()}
    look = s.Edits(bits, {7: 3}, np.array([97]))
    assert look.passed(s.word_hashes(s.codes(words, 7)), 7).all()
    others = [w.replace("word", "ward") for w in words]
    assert look.passed(s.word_hashes(s.codes(others, 7)), 7).mean() < 0.01
