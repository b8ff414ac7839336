"""Licence texts in documents: matching statistics from a suffix automaton of templates, chained into covered spans."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Sequence
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import map_texts
from tidebook.llm.licence_texts import BASE_PHRASES, TEMPLATES

#: Words of a match to be used, words that may lie between two matches of a chain in the text or in the template.
MIN_MATCH = 4
MAX_GAP = 12
#: Share of a template's words that a chain has to cover; notices of up to SHORT words need all of them.
MIN_COVERED = 0.5
SHORT = 14
#: Score of a document that only names a licence.
NAMED_SCORE = 0.5

_WORD = {*range(48, 58), *range(97, 123), *range(128, 256)}
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split()


class SuffixAutomaton:
    """Generalised suffix automaton: recognises every run of words of every template.

    A state stands for the runs that end at the same places; ``ends`` lists these places as (template, words up to there).
    """

    def __init__(self, templates: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(templates):
            last = 0
            for k, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((t, k + 1))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The part of ``target`` that is ``state`` and one word, as a state of its own."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another template has had this run
            return self._split(last, word, self.next[last][word])
        state = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, word, self.next[last][word])
        return state

    def maximal_matches(self, words: Sequence[int], least: int) -> list[tuple[int, int, int]]:
        """``(end, length, state)`` of the longest runs that no following word extends, with ``least`` words or more."""
        found, state, length = [], 0, 0
        following, link, longest = self.next, self.link, self.length
        for end, word in enumerate(words):
            step = following[state].get(word)
            if step is None:
                if length >= least:
                    found.append((end, length, state))
                while step is None and state:
                    state = link[state]
                    length = longest[state]
                    step = following[state].get(word)
            if step is None:
                length = 0
            else:
                state, length = step, length + 1
        if length >= least:
            found.append((len(words), length, state))
        return found


class Scanner:
    """The automaton of a set of templates with the chaining of matches."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = BASE_PHRASES):
        self.number: dict[bytes, int] = {}
        as_words = [words_of(t) for _, t in templates]
        as_phrases = [words_of(p) for p, _ in phrases]
        for words in [*as_words, *as_phrases]:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.labels = [label for label, _ in templates]
        self.sizes = [len(w) for w in as_words]
        self.automaton = SuffixAutomaton([[self.number[w] for w in words] for words in as_words])
        self.phrases = [([self.number[w] for w in p], label) for p, (_, label) in zip(as_phrases, phrases, strict=True)]

    def spans(self, codes: np.ndarray) -> list[tuple[str, int, int, int, float]]:
        """``(label, first, last, covered, score)`` of the chains that cover enough of a template, best first per place."""
        known = np.concatenate([[0], (codes > 0).astype(np.int8), [0]])
        starts, stops = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        chains: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b in zip(starts[stops - starts >= MIN_MATCH].tolist(), stops[stops - starts >= MIN_MATCH].tolist(), strict=True):
            for end, length, state in self.automaton.maximal_matches(codes[a:b].tolist(), MIN_MATCH):
                for template, upto in self.automaton.ends[state]:
                    chains.setdefault(template, []).append((a + end - length, a + end, upto - length, upto))
        found = []
        for template, matches in chains.items():
            need = self.sizes[template] if self.sizes[template] <= SHORT else MIN_COVERED * self.sizes[template]
            for first, last, covered in best_chains(matches):
                if covered >= need:
                    found.append((self.labels[template], first, last, covered, covered / self.sizes[template]))
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))

    def scan(self, text: str) -> tuple:
        """All results for one text, in the order of the columns of ``scanned``."""
        words = words_of(text)
        codes = np.fromiter(map(self.number.get, words, repeat(0)), dtype=np.int32, count=len(words))
        places, labels = [], set()
        for phrase, label in self.phrases:
            held = np.ones(max(len(codes) - len(phrase) + 1, 0), dtype=bool)
            for k, code in enumerate(phrase):
                held &= codes[k : k + len(held)] == code
            at = np.flatnonzero(held)
            if len(at):
                labels.add(label)
                places.append(at)
        spans = self.spans(codes)
        starts = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        return (
            len(words),
            len(starts),
            int(starts.min()) if len(starts) else None,
            int(starts.max()) if len(starts) else None,
            ",".join(sorted(labels)),
            ",".join(sorted(labels | {s[0] for s in spans})),
            min(1.0, max([NAMED_SCORE if labels else 0.0, *(s[4] for s in spans)])),
            [{"label": s[0], "first_word": s[1], "last_word": s[2] - 1, "covered": s[3], "score": s[4]} for s in spans],
        )


def best_chains(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """``(first, last, covered)`` per run of matches that follow each other in text and template with small gaps.

    A match is (first, end) in the text and (first, end) in the template. Every match continues the best chain among
    those that end at most ``MAX_GAP`` words before it in the text; overlaps count once. Chains that overlap in the text
    compete and the one with the most covered words wins.
    """
    ordered = sorted(matches, key=lambda m: (m[1], m[0], m[2]))
    covered: list[int] = []
    first: list[int] = []
    for k, (a, b, ta, tb) in enumerate(ordered):
        best, origin = b - a, a
        for p in range(k - 1, -1, -1):
            pa, pb, pta, ptb = ordered[p]
            if pb < a - MAX_GAP - (b - a):
                break
            if pa < a and pb < b and pta < ta and ptb < tb and a - pb <= MAX_GAP and ta - ptb <= MAX_GAP:
                new = min(b - a, b - pb, tb - ptb)
                if covered[p] + new > best:
                    best, origin = covered[p] + new, first[p]
        covered.append(best)
        first.append(origin)
    chosen: list[tuple[int, int, int]] = []  # sorted and apart from each other
    for k in sorted(range(len(ordered)), key=lambda k: (-covered[k], first[k], ordered[k][1])):
        span = (first[k], ordered[k][1], covered[k])
        at = bisect(chosen, span)
        if (not at or chosen[at - 1][1] <= span[0]) and (at == len(chosen) or span[1] <= chosen[at][0]):
            chosen.insert(at, span)
    return chosen


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for every whole text.

    ``n_base`` counts the places of the base phrases and ``first_word, last_word`` are the smallest and largest of their
    starts, null without any. ``labels`` adds those of templates that a chain of matches covers; ``spans`` has these
    chains, with inclusive word positions from 0. The score is the largest covered share of a template, at least one half
    where a licence is named. A null or empty text has no words and no labels (''); every row gives one row.
    """

    def make():
        scanner = Scanner()
        return lambda texts: list(zip(*map(scanner.scan, texts), strict=True))

    fields = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first_word: long, last_word: long, covered: long, score: double>>"
    )
    return map_texts(docs, make, fields)


def digest(docs: DataFrame) -> DataFrame:
    return scanned(docs).withColumn("n_spans", F.size("spans")).drop("spans")
