import random

import numpy as np

from tidebook.llm import minhash


def brute(rows, words, percent):
    """Union-find over all pairs on the sets of word runs themselves."""

    def runs(text):
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in "\t\n\v\f\r":
            lower = lower.replace(c, " ")
        parts = [w for w in lower.split(" ") if w]
        if not parts:
            return set()
        return {tuple(parts)} if len(parts) < words else {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}

    sets = [runs(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = None if doc is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and top(j) == top(i))
        out.append((doc, len(sets[i]), component, doc is None or component == doc))
    return sorted(out, key=str)


def variants(rnd, words, n, most):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rnd.randint(0, most)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = [rnd.choice(["new", "other", "word"]) + str(rnd.randrange(50))]
        out.append(" ".join(w))
    return out


def test_groups_against_brute_force(spark, make_docs):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 150))]
        texts += variants(rnd, base, 12, 14)
    chain = [rnd.choice(vocabulary) for _ in range(200)]
    for k in range(12):  # neighbours are similar, ends are not
        texts.append(" ".join(chain[k * 5 : k * 5 + 100]))
    texts += ["Same  Text", "same text", "same\ttext\n", "same", "SAME", "Éa b", "éa b", "x y z", "x y z x y z", "a\x1cb", "a b"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts, 100)) + [(1, None), (2, ""), (3, " \n"), (4, "w " * 30000), (5, "w w"), (None, "same text"), (None, None)]
    rows += [rows[0], rows[0], (2, "")]
    for words in (2, 5):
        found = minhash.near_duplicates(make_docs(rows), words=words)
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, words, 80)


def test_min_max_signature_is_unbiased_and_tighter():
    scale, shift, _ = minhash._permutations()
    rng = np.random.default_rng(0)
    estimates, errors = [], []
    for similarity in (0.3, 0.6, 0.8, 0.95):
        for _ in range(30):
            n = 400
            same = round(2 * n * similarity / (1 + similarity))
            pool = rng.integers(0, 1 << 63, 2 * n - same, dtype=np.uint64) * np.uint64(2)
            a, b = pool[:n], np.concatenate([pool[:same], pool[n:]])
            true = same / len(pool)
            equal = minhash.signature(a, scale, shift) == minhash.signature(b, scale, shift)
            estimates.append(equal.mean() - true)
            errors.append((equal.mean() - true) ** 2 / (true * (1 - true)))
    assert abs(np.mean(estimates)) < 0.006
    assert np.mean(errors) < 1.3 / 512


def test_pairs_at_the_threshold_share_a_band():
    scale, shift, mixer = minhash._permutations()
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
        a, b = pool[:180], pool[20:]
        keys = [minhash.band_keys(minhash.signature(x, scale, shift), mixer) for x in (a, b)]
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_rows_that_share_an_id_keep_the_links_of_each_text(make_docs):
    one = " ".join(f"a{i}" for i in range(60))
    two = " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (0, "c d e f g h"), (0, one + " z"), (1, one), (4, "d e")]
    found = sorted(tuple(r)[::2] for r in minhash.near_duplicates(make_docs(rows), words=2).collect())
    assert found == [(0, 0), (0, 0), (1, 0), (1, 0), (1, 1), (2, 0), (3, 1), (4, 4)]
