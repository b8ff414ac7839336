import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebook.llm import licences
from tidebook.llm.licence_texts import TEMPLATES

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute_base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=30))
def test_matches_are_the_longest_common_runs(templates, words):
    automaton = licences.SuffixAutomaton(templates)
    runs = {}
    for t, w in enumerate(templates):
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                runs.setdefault(tuple(w[a:b]), set()).add((t, b))
    longest = [max((n for n in range(end + 1) if tuple(words[end - n : end]) in runs), default=0) for end in range(len(words) + 1)]
    expected = [
        (end, longest[end]) for end in range(1, len(words) + 1)
        if longest[end] and (end == len(words) or longest[end + 1] <= longest[end])
    ]
    found = automaton.maximal_matches(words, 1)
    assert [(e, n) for e, n, _ in found] == expected
    for end, n, state in found:
        assert set(automaton.ends[state]) == runs[tuple(words[end - n : end])]


def test_base_and_edges_against_brute_force(make_docs):
    rnd = random.Random(1)
    pool = ["MIT", "mit", "License", "license.", "Apache", "apache-license", "general", "Public", "PUBLIC LICENSE", "x", "é", "mit\nlicense", "Ä"]
    rows = [(i, " ".join(rnd.choices(pool, k=rnd.randint(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (201, ""), (None, "MIT license"), (202, "mit license " * 20_000), (203, "\x00\x7f")]
    found = [tuple(r)[:6] for r in licences.scanned(make_docs(rows)).collect()]
    assert sorted(found, key=str) == sorted(((i, *brute_base(t)) for i, t in rows), key=str)
    assert licences.digest(make_docs([])).count() == 0


def test_every_template_is_found_where_it_stands():
    scanner = licences.Scanner()
    rnd = random.Random(2)
    noise = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    for label, text in TEMPLATES:
        size = len(licences.words_of(text))
        result = scanner.scan(f"{noise(30)} {text} {noise(20)}")
        spans = {(s["label"], s["first_word"], s["last_word"]): s["score"] for s in result[7]}
        assert spans[(label, 30, 30 + size - 1)] == 1.0 and label in result[5].split(",") and result[6] == 1.0


def test_edited_and_partial_texts():
    scanner = licences.Scanner()
    rnd = random.Random(3)
    words = dict(reversed(TEMPLATES))["isc"].split()
    assert "isc" not in scanner.scan(" ".join(words[: len(words) // 3]))[5]
    for k in range(9, len(words), 13):
        words[k] = f"edit{rnd.randrange(99)}"
    result = scanner.scan("before " * 5 + " ".join(words) + " after" * 9)
    assert result[5] == "isc" and 0.8 < result[6] < 1
    half = scanner.scan(" ".join(words[: len(words) * 2 // 3]))
    assert half[5] == "isc" and 0.5 <= half[6] < result[6]


def test_clean_text_has_no_labels():
    scanner = licences.Scanner()
    common = list(scanner.number)
    rng = np.random.default_rng(0)
    for _ in range(50):
        text = b" ".join(rng.choice(common, 400)).decode()
        text = re.sub(r"mit license|apache license|general public license", "x", text)
        assert scanner.scan(text)[4:7] == ("", "", 0.0)


def test_repeated_notices_give_a_span_each():
    result = licences.Scanner().scan("Released under the MIT License. " * 300)
    assert result[1] == 300 and [s["label"] for s in result[7]] == ["mit"] * 300
