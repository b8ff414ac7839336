"""Quality statistics of documents and an ordered list of threshold rules learned from labelled ones."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import keep, map_texts, sampled

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled rows that rules are learned from, at most.
SAMPLE_ROWS = 20_000
#: A rule has to be right for this share of the rows it was not grown on, and to reject this many of them.
MIN_PRECISION = 0.97
MIN_REJECTED = 5
MAX_RULES = 24
MAX_CONDITIONS = 4
THRESHOLDS = 48

STATISTICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_punctuation long, n_digits long, n_distinct_words long, n_bars long"
)
_SYMBOLS = bytes(b"#*$%&|<>")
_PUNCTUATION = bytes(b"!?.,;:")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def _count(raw: bytes, wanted: bytes) -> int:
    return len(raw) - len(raw.translate(None, wanted))


def text_statistics(text: str) -> tuple[int, ...]:
    """The values of ``STATISTICS`` for one text; words stand between the blanks \\x20 and \\x09 to \\x0D."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n >= 3:
        window = (codes[:-2] * len(number) + codes[1:-1]) * len(number) + codes[2:]  # below 2**63 up to 2 million words
        if len(number) > 2_000_000:
            _, pair = np.unique(codes[:-2] * len(number) + codes[1:-1], return_inverse=True)
            window = pair * len(number) + codes[2:]
        _, which, times = np.unique(window, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[at + k] = True
        repeated = int(covered.sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    joined = b"".join(words)
    return (
        n,
        len(joined) - _count(joined, bytes(range(0x80, 0xC0))),
        _count(raw, _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        _count(raw, _UPPER),
        _count(raw, _PUNCTUATION),
        _count(raw, _DIGITS),
        len(number),
        _count(raw, b"|"),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``STATISTICS`` of every whole text; a null text has no words."""
    return map_texts(docs, lambda: lambda texts: list(zip(*map(text_statistics, texts), strict=True)), STATISTICS)


def measures() -> dict[str, Column]:
    """What rules may ask: sizes and ratios that mean the same for short and long texts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "line_words": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper": F.col("n_upper") / chars,
        "punctuation": F.col("n_punctuation") / words,
        "digits": F.col("n_digits") / chars,
        "distinct": F.col("n_distinct_words") / F.sqrt(words),
        "bars": F.col("n_bars") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# --- learning ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    measure: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        values = x[:, self.measure]
        return values >= self.threshold if self.above else values < self.threshold


def _holds(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(x), dtype=bool)


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Add the condition with the largest information gain for bad rows until no good row is left."""
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < MAX_CONDITIONS and bad[inside].any() and not bad[inside].all():
        rows, wrong = x[inside], bad[inside]
        before = np.log2(wrong.mean())
        best, gain = None, 1e-9
        for measure in range(x.shape[1]):
            values = rows[:, measure]
            # middle between neighbours, so that a threshold does not sit on a value of either side
            marks = np.unique(np.quantile(values[wrong], np.linspace(0, 1, THRESHOLDS)))
            ordered = np.unique(values)
            place = np.searchsorted(ordered, marks)
            lower = (ordered[np.maximum(place - 1, 0)] + ordered[place]) / 2
            upper = (ordered[place] + ordered[np.minimum(place + 1, len(ordered) - 1)]) / 2
            for above, cuts in ((True, lower), (False, upper)):
                for cut in np.unique(cuts):
                    held = values >= cut if above else values < cut
                    p = int(wrong[held].sum())
                    if p:
                        value = p * (np.log2(p / held.sum()) - before)
                        if value > gain:
                            best, gain = Condition(measure, above, float(cut)), value
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Drop last conditions while the rule does better on rows that it was not grown on."""

    def worth(r):
        held = _holds(r, x)
        p, n = int(bad[held].sum()), int((~bad[held]).sum())
        return (p - n) / max(p + n, 1)

    sizes = range(len(rule), 0, -1)
    return max((rule[:k] for k in sizes), key=worth) if rule else rule


def learn_rules(x: np.ndarray, bad: np.ndarray, order: np.ndarray) -> list[list[Condition]]:
    """Sequential covering: each rule is grown on two thirds and pruned on the rest of the rows no rule has taken yet.

    ``order`` is a number per row that deals rows to the thirds. Learning ends when a rule is not precise enough on the
    pruning rows: what no rule takes is kept. No rows, or rows of one kind only, give no rules.
    """
    rules: list[list[Condition]] = []
    left = np.ones(len(x), dtype=bool)
    for turn in range(MAX_RULES):
        prune_part = left & ((order + turn) % 3 == 0)
        grow_part = left & ~prune_part
        if not bad[grow_part].any() or not bad[prune_part].any():
            break
        rule = _prune(_grow(x[grow_part], bad[grow_part]), x[prune_part], bad[prune_part])
        held = _holds(rule, x[prune_part])
        right = int(bad[prune_part][held].sum())
        if not rule or right < MIN_REJECTED or right < MIN_PRECISION * held.sum():
            break
        rules.append(rule)
        left &= ~_holds(rule, x)
    return rules


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Rules from at most ``sample_rows`` labelled documents that pass the base rules, chosen by a hash of their id.

    ``labels`` has ``doc_id, quality``; null labels and ids are left out, of several labels of a document the lowest counts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(known, "doc_id")
    deal = F.xxhash64("doc_id")
    named = [c.alias(f"m{k}") for k, c in enumerate(measures().values())]
    sample = rows.select("doc_id", deal.alias("deal"), "quality", *named)
    found = sampled(sample, sample_rows, "doc_id", *[f"m{k}" for k in range(len(named))]).toPandas()
    x = found[[f"m{k}" for k in range(len(measures()))]].to_numpy(dtype=float)
    bad = (found["quality"] == 0).to_numpy()
    return learn_rules(x, bad, (found["deal"].to_numpy(dtype=np.int64) >> 7) % 3)


def rule_text(rules: list[list[Condition]]) -> list[str]:
    names = list(measures())
    return [" and ".join(f"{names[c.measure]} {'>=' if c.above else '<'} {c.threshold!r}" for c in r) for r in rules]


def decision(rules: list[list[Condition]]) -> Column:
    """The 1-based number of the first rule that rejects a document, 0 for the base rules, null if it is kept."""
    asked = list(measures().values())
    verdict = F.when(base_failed(), F.lit(0))
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            holds = holds & (asked[c.measure] >= c.threshold if c.above else asked[c.measure] < c.threshold)
        verdict = verdict.when(holds, F.lit(number))
    return verdict


def judged(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, all statistics, ``base_failed, rejected_by, kept`` for every document.

    A null or empty text has no words, which the base rules reject. Repeated rows give repeated results, a null
    ``doc_id`` is judged like any other; without labels only the base rules decide. An empty table gives none.
    """
    stats = keep(statistics(docs), "statistics")
    verdict = decision(fit(stats, labels, sample_rows))
    judged_rows = stats.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    return judged_rows.withColumn("kept", F.col("rejected_by").isNull())


def kept_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    Statistics travel with each row in its own struct, so neither repeated ids nor clashing names matter.
    """
    rules = fit(statistics(docs), labels, sample_rows)
    return filter_by(docs, rules)


def filter_by(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``docs`` without those that ``rules`` or the base rules reject, in one pass without a shuffle."""
    schema = docs.schema
    names = [f.split()[0] for f in STATISTICS.split(", ")]
    stats = F.pandas_udf(_statistics_frame, STATISTICS)
    with_stats = docs.select(F.struct("*").alias("row"), stats(F.col("text")).alias("s"))
    found = with_stats.select("row", *[F.col(f"s.{n}").alias(n) for n in names]).where(decision(rules).isNull())
    return found.select(*[F.col(f"row.`{f.name}`") for f in schema])


def _statistics_frame(texts: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in STATISTICS.split(", ")]
    return pd.DataFrame([text_statistics(t or "") for t in texts], columns=names)
