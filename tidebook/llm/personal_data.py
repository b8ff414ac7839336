"""Personal data in texts: exact base patterns, and further spans from a character tagger trained on labelled ones."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import tagger
from tidebook.llm.common import keep, map_texts, sampled

KINDS = ("email", "ip", "card", "phone")
#: Length of a window, and characters around digits and at signs that it has to hold.
WINDOW = 96
STRIDE = 48
CONTEXT = 28
#: Documents that the tagger is trained on, at most, and windows of them.
SAMPLE_ROWS = 3_000
SAMPLE_WINDOWS = 2_400
#: Distinct spans of these documents that are put behind others in training texts, at most.
POOL_SPANS = 1_000
STEPS = 400

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]")


# --- base patterns ------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def valid(kind: str, found: str) -> bool:
    """What a span of a kind has to fulfil besides its pattern."""
    if kind == "ip":
        return all(int(p[-4:]) <= 255 and (len(p) <= 3 or not p[:-3].strip("0")) for p in found.split("."))
    if kind == "card":
        digits = _digits(found)
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(_digits(found)) <= 15


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from the at signs on: a long word without one costs nothing."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` in code points, by kind and start. No match of a kind overlaps another of it.

    An address with numbers in front has its match start at the first digit of a run in any case, so looking only there
    finds the same matches in time that grows with the text.
    """
    found = emails(text)
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return found


# --- windows and tags -----------------------------------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_MARKS = " \n\t@.-+()_%:/=\"'[]{},;#*&|<>!?\\"
_SYMBOL = {c: k + 5 for k, c in enumerate(_MARKS)}
#: 0 outside of the text, 1 other ASCII, 2 beyond ASCII, 3 digits, 4 capitals, then marks and small letters.
SYMBOLS = 5 + len(_MARKS) + len(_LETTERS)
_ASCII = np.ones(128, dtype=np.int64)
for _c, _k in _SYMBOL.items():
    _ASCII[ord(_c)] = _k
_ASCII[48:58], _ASCII[65:91] = 3, 4
_ASCII[97:123] = np.arange(26) + 5 + len(_MARKS)
TAGS = 1 + 2 * len(KINDS)


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], 2)


def windows_of(text: str) -> list[int]:
    """Starts of the windows that together hold each digit and at sign of the text with its surroundings.

    Without a digit or an at sign nothing can be personal data of these kinds, so other places need no window.
    Windows overlap by at least half where one is not enough.
    """
    starts: list[int] = []
    first = last = None
    for m in _ANCHOR.finditer(text):
        if first is not None and m.start() - last <= CONTEXT:
            last = m.start()
            continue
        if first is not None:
            starts += _cover(first - CONTEXT, last + CONTEXT + 1)
        first = last = m.start()
    if first is not None:
        starts += _cover(first - CONTEXT, last + CONTEXT + 1)
    return starts


def _cover(a: int, b: int) -> list[int]:
    if b - a <= WINDOW:
        return [(a + b - WINDOW) // 2]
    return [*range(a, b - WINDOW, STRIDE), b - WINDOW]


def cut(symbols: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, dtype=np.int64)
    a, b = max(start, 0), min(start + WINDOW, len(symbols))
    out[a - start : b - start] = symbols[a:b]
    return out


def tags_of(spans: list[Span], length: int) -> np.ndarray:
    """1 + 2k where a span of kind k begins and 2 + 2k inside; of overlapping spans the first kind counts."""
    tags = np.zeros(length, dtype=np.int8)
    for kind, a, b in reversed(spans):
        tags[a:b] = 2 + 2 * KINDS.index(kind)
        tags[a] = 1 + 2 * KINDS.index(kind)
    return tags


def spans_of(tags: np.ndarray) -> list[Span]:
    """Runs of one kind, split where a new one begins."""
    kind = (tags + 1) // 2
    edge = np.flatnonzero((np.diff(kind, prepend=0) != 0) | ((tags % 2 == 1) & (tags > 0)))
    bounds = [*edge.tolist(), len(tags)]
    return [(KINDS[kind[a] - 1], a, b) for a, b in zip(bounds, bounds[1:], strict=False) if kind[a]]


def tagged(weights: tagger.Weights, texts: list[str]) -> list[list[Span]]:
    """Spans of each text: all windows are decoded in batches of one size, and every character takes the tag of the
    window in which it stands farthest from an edge."""
    symbols = [symbols_of(t) for t in texts]
    places = [(k, s) for k, t in enumerate(texts) for s in windows_of(t)]
    merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for at in range(0, len(places), 512):
        part = places[at : at + 512]
        paths = tagger.decode(weights, np.stack([cut(symbols[k], s) for k, s in part]))
        for (k, s), path in zip(part, paths, strict=True):
            n = len(symbols[k])
            tags, best = merged.setdefault(k, (np.zeros(n, dtype=np.int8), np.full(n, -1)))
            a, b = max(s, 0), min(s + WINDOW, n)
            deeper = depth[a - s : b - s] > best[a:b]
            tags[a:b][deeper] = path[a - s : b - s][deeper]
            best[a:b][deeper] = depth[a - s : b - s][deeper]
    return [spans_of(merged[k][0]) if k in merged else [] for k in range(len(texts))]


# --- training -------------------------------------------------------------------------------------------------------


def _rewritten(kind: str, found: str, turn: int) -> str:
    """The same datum in a form that the base patterns don't take: labelled examples for what they miss."""
    digits = _digits(found)
    if kind == "card":
        return (".", "/", "_")[turn % 3].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == "phone" and len(digits) >= 10:
        area, rest = digits[-10:-7], f"{digits[-7:-4]}-{digits[-4:]}"
        return (f"({area}) {rest}", f"{area}-{rest}", f"{area}.{rest.replace('-', '.')}")[turn % 3]
    if kind == "email":
        return found.replace("@", (" @ ", "(@)", "[@]")[turn % 3])
    return found


def doubtful(text: str) -> list[tuple[int, int]]:
    """Long numbers that a base pattern takes but that aren't valid, as of two numbers with only a blank between them:
    what they are is not known, so they are no examples of anything."""
    found = [m.span() for pattern in (_CARD, _PHONE) for m in pattern.finditer(text)]
    known = {(a, b) for _, a, b in base_spans(text)}
    return [(a, b) for a, b in found if (a, b) not in known and len(_digits(text[a:b])) > 12]


def examples(text: str, turn: int, pool: list[tuple[str, str]] = []) -> list[tuple[np.ndarray, np.ndarray]]:  # noqa: B006
    """Windows with their tags: those of the text, the same with every span in another form, and with every span
    followed by one of ``pool`` after a blank."""
    spans = base_spans(text)
    out = []
    for mode in range(3 if spans and pool else 2 if spans else 1):
        new, tags, done = [], [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a < done:
                continue
            forms = [(kind, _rewritten(kind, text[a:b], turn + a) if mode == 1 else text[a:b])]
            if mode == 2:
                forms += [("", " "), pool[(turn + a) % len(pool)]]
            new.append(text[done:a])
            tags.append(np.zeros(a - done, np.int8))
            for k, form in forms:
                new.append(form)
                tags.append(tags_of([(k, 0, len(form))] if k else [], len(form)))
            done = b
        whole = "".join([*new, text[done:]])
        marks = np.concatenate([*tags, np.zeros(len(text) - done, np.int8)])
        symbols = symbols_of(whole)
        unclear = doubtful(whole) if mode != 2 else []
        for s in windows_of(whole):
            if not any(a < s + WINDOW and s < b and not marks[a:b].all() for a, b in unclear):
                out.append((cut(symbols, s), cut(marks, s)))
    return out


def balanced(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most ``n`` rows by a hash of ``columns``: three quarters with ``holds`` and one without, or more of one where
    the other has fewer. Both are counted on their own, so rare rows are found in a table of any size."""
    counts = {r["holds"]: r["count"] for r in rows.groupBy("holds").count().collect()}
    with_any, without = counts.get(True, 0), counts.get(False, 0)
    first = min(with_any, max(n - n // 4, n - without))
    rest = sampled(rows.where("NOT holds"), min(without, n - first), *columns)
    return sampled(rows.where("holds"), first, *columns).unionByName(rest)


def span_pool(texts: DataFrame, n: int = POOL_SPANS) -> list[tuple[str, str]]:
    """At most ``n`` distinct base spans of ``texts(row, text)`` as kind and form, in the order of a hash.

    It depends on the texts alone, not on the tasks they are in. Spans of more than 64 characters are left out, since
    they would fill a training window.
    """

    def work(batch):
        return [[[{"kind": k, "form": t[a:b]} for k, a, b in base_spans(t) if b - a <= 64] for t in batch]]

    found = map_texts(texts, lambda: work, "spans array<struct<kind: string, form: string>>", ("row", "text"))
    forms = keep(found.select(F.explode("spans").alias("s")).select("s.*").distinct(), "tagger-forms")
    return [tuple(r) for r in sampled(forms, n, "kind", "form").collect()]


def training_windows(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """``symbols, tags, holds``: distinct windows of documents that hold digits or at signs, most of them with spans."""
    anchored = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", "text").alias("row"), "text")
    marks = map_texts(anchored, lambda: lambda texts: [[bool(base_spans(t)) for t in texts]], "holds boolean", ("row", "text"))
    marks = keep(marks.groupBy("row").agg(F.max("holds").alias("holds")), "tagger-marks")  # equal rows are one
    chosen = keep(balanced(marks, sample_rows, "row").select("row"), "tagger-sample")
    texts = keep(anchored.join(chosen, "row").dropDuplicates(["row"]), "tagger-texts")
    pool = span_pool(texts)

    def make():
        def work(batch):
            made = [examples(t, zlib.crc32(t.encode("utf-8", "surrogatepass")), pool) for t in batch]
            rows = [[[x.tobytes() for x in pair] + [bool(pair[1].any())] for pair in e] for e in made]
            return [[[{"symbols": s, "tags": t, "holds": h} for s, t, h in e] for e in rows]]

        return work

    found = map_texts(texts, make, "windows array<struct<symbols: binary, tags: binary, holds: boolean>>", ("row", "text"))
    windows = found.select(F.explode("windows").alias("w")).select("w.*").distinct()
    return balanced(keep(windows, "tagger-windows"), sample_windows, "symbols", "tags")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS) -> tagger.Weights | None:
    """A tagger trained on windows of at most ``sample_rows`` documents that hold digits or at signs, chosen by a hash,
    those that hold a base span first; at most ``sample_windows`` distinct windows, chosen in the same way, reach the
    driver. None without any.

    The labelled spans are those of the base patterns, each as it stands, in a form that they don't take, and with
    another one behind it, which they would often take for one number.
    """
    rows = training_windows(docs, sample_rows, sample_windows).toPandas()
    if rows.empty:
        return None
    symbols = np.stack([np.frombuffer(x, dtype=np.int64) for x in rows["symbols"]])
    tags = np.stack([np.frombuffer(x, dtype=np.int64) for x in rows["tags"]])
    return tagger.train(tagger.Shape(SYMBOLS, TAGS), symbols, tags, steps=STEPS)


# --- results --------------------------------------------------------------------------------------------------------


def trimmed(text: str, span: Span) -> Span | None:
    """A tagged span without blanks around it, if what is left can be a datum of its kind."""
    kind, a, b = span
    while a < b and text[a] in " \n\t.,;:":
        a += 1
    while a < b and text[b - 1] in " \n\t.,;:-(":
        b -= 1
    inner = text[a:b]
    if kind == "email":
        local, _, domain = inner.partition("@")
        fine = bool(local.strip(" ([")) and "." in domain and not re.search(r"\s\S+\s+\S+\s", inner)
    elif kind == "ip":
        fine = bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", inner)) and valid(kind, inner)
    elif kind == "card":
        fine = bool(re.fullmatch(r"[0-9][0-9 ./_-]+[0-9]", inner)) and valid(kind, inner)
    else:
        fine = bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", inner)) and 10 <= len(_digits(inner)) <= 15
    return (kind, a, b) if fine else None


def all_spans(weights: tagger.Weights | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; what the tagger adds is valid for its kind and touches no base span."""
    base = [base_spans(t) for t in texts]
    more = tagged(weights, texts) if weights is not None else [[] for _ in texts]
    out = []
    for text, own, extra in zip(texts, base, more, strict=True):
        taken = np.zeros(len(text), dtype=bool) if extra else None
        for _, a, b in own if extra else ():
            taken[a:b] = True
        added = []
        for span in extra:
            fit_span = trimmed(text, span)
            if fit_span and not taken[fit_span[1] : fit_span[2]].any():
                added.append(fit_span)
                taken[fit_span[1] : fit_span[2]] = True
        out.append((own, sorted(own + added, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def found_spans(docs: DataFrame, weights: tagger.Weights | None) -> DataFrame:
    """``doc_id, base, spans``: arrays of (kind, start, end) in code points, ends exclusive, for every whole text.

    A null or empty text has none; repeated rows give repeated results; any ``doc_id``, also null, is passed through.
    """

    def make():
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

        def work(texts):
            found = all_spans(weights, texts)
            return [[as_rows(base) for base, _ in found], [as_rows(spans) for _, spans in found]]

        return work

    kind = "array<struct<kind: string, start: long, end: long>>"
    return map_texts(docs, make, f"base {kind}, spans {kind}")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their checksum, and the text of all spans."""
    found = found_spans(docs, fit(docs))
    text = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with ``[KIND]`` in place of each span; of overlapping spans one place stays."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, weights: tagger.Weights | None) -> DataFrame:
    """``docs`` with the personal data in ``text`` masked, and ``n_chars`` to match; null texts stay null."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 256):
            part = [t if t is not None else "" for t in texts[at : at + 256]]
            out += [masked_text(t, spans) for t, (_, spans) in zip(part, all_spans(weights, part), strict=True)]
        return pd.Series(out, dtype=object)

    new = docs.withColumn("text", F.when(F.col("text").isNotNull(), mask("text")))
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new
