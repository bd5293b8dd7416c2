"""Personal data: fixed rules, and candidates judged by boosted trees.

The rules (``base_spans``) find e-mail addresses, IP addresses, card and telephone numbers in their usual form;
what they find stays. Generators of high recall (``candidates``) propose whatever may be one of these in another
form: numbers without a plus, other separators, "(at)" and "[dot]", IPv6. Proposals may overlap. Boosted trees look
at the form of a proposal and at the text around it; their log-odds are calibrated for each kind on rows that
the trees had not seen, and a proposal is taken where its probability reaches the least one at which ``PRECISION``
of those unseen rows were right. Of overlapping proposals the most probable stands, and none overlaps a rule's span.

Nothing is labelled, so the trees learn from the text itself: in a sample of ``SAMPLE`` documents that hold a
digit or an at sign (by a hash of id and text, ``EACH`` proposals of a document at the most), what the rules find is right and
other proposals are wrong. As the rules know one form only, every find is also rewritten in its place: into
other forms of the same value, which are right, and into values that break what makes it one (check digit,
range, number of digits, a number inside a word), which are wrong.

Every text is searched whole. Null texts are empty; empty and wordless texts have no spans. Rows that repeat an
id or are equal get a row each. Without anything to learn from, the rules alone decide. Other columns pass
through ``found`` and ``redacted``; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm import boosting
from fleetfold.llm.common import stored, wide_enough

KINDS = ("email", "ip", "card", "phone")
SAMPLE, EACH, FOLDS = 3_000, 60, 3
PRECISION, LEAST = 0.98, 0.5
NEAR = 32  # characters of context on either side
Span = tuple[str, int, int]

# The rules. A run of digits is taken whole at once, which changes no match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = r"@|＠|[(\[{] ?(?:at|AT) ?[)\]}]| at (?=[\w-]+ dot )"
_DOT = r"(?:\.| ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?| dot )"
_WIDE_AT = re.compile(_AT)
_WIDE_LOCAL = re.compile(r"[\w.%+'-]+ ?\Z")
_WIDE_DOMAIN = re.compile(rf" ?[\w-]+(?:{_DOT}[\w-]+)+")
_WIDE = {
    "ip": re.compile(
        rf"(?<![\w.])(?:[0-9]{{1,4}}(?:{_DOT}[0-9]{{1,4}}){{3}}(?![\w]|\.[0-9])|[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{0,4}}){{3,7}}(?![\w:]))"
    ),
    "card": re.compile(r"(?<![\w.])[0-9](?:[ ./_-]{0,2}[0-9]){11,18}(?![\w])"),
    "phone": re.compile(r"(?<![\w.])(?:\+ ?|00 ?)?\(?[0-9](?:[ ().\\/-]{0,3}[0-9]){6,14}(?![\w])"),
}
_TRIGGER = re.compile(r"[0-9@＠]")
_MAIL_WORDS = ("(at)", "[at]", "{at}", "( at )", "[ at ]", "(AT)", "[AT]", " dot ")
# Words that stand before such data, in the languages of the tables, and words that stand before other numbers.
_CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "addr", "dirección", "adresse"),
    "card": ("card", "visa", "master", "credit", "tarjeta", "carte", "karte"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "móvil", "appel", "anruf"),
    "other": ("version", "isbn", "order", "no.", "nr", "id", "§", "$", "€", "£", "page", "section", "="),
}


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """At every at sign: the longest run of local characters before it, if a domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield "email", start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points of what the rules find, by start, then kind."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def suspicious(text: str) -> bool:
    """Whether any rule or generator could find something."""
    return _TRIGGER.search(text) is not None or any(w in text for w in _MAIL_WORDS)


def candidates(text: str) -> list[Span]:
    """Everything that may be personal data in some form; proposals may overlap."""
    out = []
    for m in _WIDE_AT.finditer(text):
        before = _WIDE_LOCAL.search(text, max(0, m.start() - 2 * NEAR), m.start())
        after = _WIDE_DOMAIN.match(text, m.end())
        if before and after:
            out.append(("email", before.start(), after.end()))
    for kind, pattern in _WIDE.items():
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


_FORM = " .-()/_:@[+"


def features(text: str, span: Span) -> list[float]:
    """Form of a proposal and of the text around it."""
    kind, start, end = span
    value = text[start:end]
    digits = _digits(value)
    groups = re.findall("[0-9]+", value)
    parts = [int(g[:9]) for g in groups]
    last = re.split(r"\W+", value)[-1]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    sizes = [len(g) for g in groups] or [0]
    form = [
        *(float(kind == k) for k in KINDS), len(value), len(digits), sum(c.isalpha() for c in value), sum(ord(c) > 127 for c in value),
        len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(set(digits)), float(digits[:1] or -1), len(last), float(last.isalpha()),
        float(_luhn(digits)) if digits else 0.0, float(all(p <= 255 for p in parts)), max(parts, default=0), *(value.count(c) for c in _FORM),
    ]
    low = before.lower()
    beside = [
        *(float(any(w in low for w in words)) for words in _CONTEXT.values()),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:].isspace() or not before), float(after[:1] in (" ", "\n", "")),
        len(_digits(before)), len(_digits(after)), float(after[:1] in ".,;:!?"), float(before[-1:] in "\"'=#/"),
    ]
    return [float(v) for v in form + beside]


WIDTH = len(features("0", ("card", 0, 1)))


# -- learning ---------------------------------------------------------------------------------


def _rewrites(kind: str, value: str, rng: random.Random) -> list[tuple[str, int]]:
    """(other text, 1 if it still says the same) for a find of the rules."""
    digits = _digits(value)
    draw = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        local, domain = value.split("@", 1)
        name, top = domain.rsplit(".", 1)
        right = [f"{local} (at) {domain}", f"{local}[at]{name}[dot]{top}", f"{local} at {name.replace('.', ' dot ')} dot {top}", f"{local} @ {domain}", f"{local}＠{domain}"]
        wrong = [f"{local[:3]}@{draw(1)}.{draw(2)}", f"{draw(2)} @ {draw(1)}.{draw(2)}"]
    elif kind == "ip":
        p = value.split(".")
        right = ["[.]".join(p), " (dot) ".join(p), ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8))]
        wrong = [".".join([*p[:3], str(rng.randint(256, 9999))]), ".".join([str(rng.randint(256, 999)), *p[1:]]), f"{draw(2)}:{draw(2)}:{draw(2)}:{draw(2)}"]
    elif kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        right = [".".join(fours), "/".join(fours), "  ".join(fours), "_".join(fours)]
        broken = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        wrong = [broken, " ".join(broken[i : i + 4] for i in range(0, len(broken), 4)), f"{draw(6)}.{draw(8)}", f"{draw(4)}-{draw(2)}-{draw(2)} {draw(2)}.{draw(2)}.{draw(2)}"]
    else:
        area, middle, end = digits[-10:-7], digits[-7:-4], digits[-4:]
        right = [f"({area}) {middle}-{end}", f"{area}-{middle}-{end}", f"00{digits[:-10]} {area} {middle} {end}", f"{area}.{middle}.{end}", f"{digits[:-10]} ({area}) {middle}-{end}"]
        wrong = [draw(rng.randint(7, 9)), f"{draw(4)}-{draw(2)}-{draw(2)}", f"{draw(3)},{draw(3)}.{draw(2)}", f"{draw(5)}.{draw(4)}", f"{draw(4)}-{draw(4)}", draw(rng.randint(12, 15)), f"{draw(2)}.{draw(2)}.{draw(4)}"]
    return [(v, 1) for v in right] + [(v, 0) for v in wrong]


class Covered:
    """Stretches of a text that are taken; disjoint and in order, so one question costs a binary search."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[2])
        return at > 0 and self.ends[at - 1] > span[1]

    def add(self, span: Span) -> None:
        """Take a stretch that meets none."""
        at = bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def examples(text: str, seed: int) -> list[tuple[str, list[float], int]]:
    """(kind, features, right) of proposals of a text and of its finds rewritten."""
    rng = random.Random(seed)
    known = base_spans(text)
    true, covered = set(known), Covered(known)
    some = lambda rows: rows if len(rows) <= EACH else rng.sample(rows, EACH)
    proposed = some([span for span in candidates(text) if span in true or not covered.meets(span)])
    out = [(span[0], features(text, span), int(span in true)) for span in proposed]
    for kind, start, end in some(known):
        for other, right in _rewrites(kind, text[start:end], rng):
            left, tail = text[max(0, start - 2 * NEAR) : start], text[end : end + 2 * NEAR]
            around, stop = left + other + tail, len(left) + len(other)
            for span in candidates(around):
                if span[1] < stop and len(left) < span[2]:
                    whole = span[1] == len(left) and span[2] == stop and span[0] == kind
                    out.append((span[0], features(around, span), int(right and whole)))
    return some(out)


def training_rows(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(fold, kind, y, x) of a sample of documents, chosen and folded by a hash of id and text."""
    some = docs.filter(F.col("text").rlike("[0-9@]"))
    mark = F.pmod(F.xxhash64("doc_id", "text", F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)
    share = size / max(size, some.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                seed = zlib.crc32(text.encode())
                rows += [(seed % FOLDS, kind, y, np.array(x).tobytes()) for kind, x, y in examples(text, seed)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "kind", "y", "x"])

    return some.filter(mark < share).select("text").mapInArrow(run, "fold INT, kind STRING, y INT, x BINARY")


def calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(a, b, threshold): probability 1 / (1 + exp(-(a * odds + b))), and the least one that is right often enough.

    Targets are drawn in a little (Platt), so perfectly parted rows give finite slopes. A kind without
    unseen rows of both outcomes takes nothing.
    """
    positive, negative = int((y > 0).sum()), int((y == 0).sum())
    if not positive or not negative:
        return 1.0, 0.0, 2.0
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    design = np.stack([odds, np.ones(len(odds))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order] > 0) / np.arange(1, len(y) + 1)
    # Rows of equal probability stand or fall together.
    ends = np.flatnonzero(np.append(np.diff(p[order]) != 0, True))
    good = ends[right[ends] >= PRECISION]
    return float(w[0]), float(w[1]), max(LEAST, float(p[order[good[-1]]])) if len(good) else 2.0


def fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Trees over all rows, calibrated for each kind by trees that had not seen the fold; one row of JSON."""
    rows = rows.sort_values(["fold", "kind", "y", "x"], kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), dtype=float).reshape(len(rows), WIDTH)
    y, fold, kind = (rows[c].to_numpy() for c in ("y", "fold", "kind"))
    odds = np.zeros(len(rows))
    seen = np.zeros(len(rows), dtype=bool)
    for k in range(FOLDS):
        rest, own = fold != k, fold == k
        if own.any() and 0 < y[rest].sum() < rest.sum():
            odds[own] = boosting.log_odds(boosting.train(x[rest], y[rest].astype(float)), x[own])
            seen |= own
    scales = {k: calibrate(odds[seen & (kind == k)], y[seen & (kind == k)]) for k in KINDS}
    trees = boosting.train(x, y.astype(float)) if 0 < y.sum() < len(y) else None
    model = None if trees is None else {"scales": scales, **{k: v.tolist() for k, v in trees.items()}}
    return pd.DataFrame({"model": [json.dumps(model)]})


def train(docs: DataFrame, size: int = SAMPLE) -> dict | None:
    """The model, fitted in one task on at most about size * EACH rows; None where there is nothing to learn."""
    rows = training_rows(docs, size).groupBy().applyInPandas(fit, "model STRING")
    found = stored(rows, "pii").first()
    model = None if found is None else json.loads(found[0])
    return model and {"scales": model["scales"], **{k: np.array(model[k]) for k in ("features", "cuts", "leaves")}}


# -- finding ----------------------------------------------------------------------------------


def chosen(scored: list[tuple[float, Span]], known: list[Span]) -> list[tuple[float, Span]]:
    """Proposals that stand: the most probable first, none over another or over a known span."""
    taken, out = Covered(known), []
    for p, span in sorted(scored, key=lambda s: (-s[0], s[1][1], KINDS.index(s[1][0]), s[1][2])):
        if not taken.meets(span):
            taken.add(span)
            out.append((p, span))
    return out


def spans_of(texts: list[str | None], model: dict | None) -> list[list[tuple[Span, float | None]]]:
    """Spans of each text in order: the rules' (no probability) and the model's."""
    found, rows, places = [], [], []
    for i, text in enumerate(texts):
        if not text or not suspicious(text):
            found.append([])
            continue
        known = base_spans(text)
        found.append(known)
        if model is None:
            continue
        covered = Covered(known)
        for span in candidates(text):
            if not covered.meets(span):
                rows.append(features(text, span))
                places.append((i, span))
    more: dict[int, list[tuple[float, Span]]] = {}
    if rows:
        odds = boosting.log_odds(model, np.array(rows))
        for (i, span), value in zip(places, odds):
            a, b, least = model["scales"][span[0]]
            p = float(1 / (1 + np.exp(-np.clip(a * value + b, -30, 30))))
            if p >= least:
                more.setdefault(i, []).append((p, span))
    out = []
    for i, known in enumerate(found):
        both = [(span, None) for span in known] + [(span, p) for p, span in chosen(more.get(i, []), known)]
        out.append(sorted(both, key=lambda s: (s[0][1], KINDS.index(s[0][0]), s[0][2])))
    return out


FOUND = "spans ARRAY<STRUCT<kind: STRING, start: INT, end: INT, probability: DOUBLE>>"


def found(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Add ``spans`` to every document, in order; ``probability`` is null for a span of the rules."""
    model = train(docs.select("doc_id", "text"), size)

    @F.pandas_udf(FOUND[len("spans ") :])
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = spans_of(series.tolist(), model)
            yield pd.Series([[{"kind": s[0], "start": s[1], "end": s[2], "probability": p} for s, p in each] for each in out], dtype=object)

    kept = [c for c in docs.columns if c != "spans"]
    return wide_enough(docs.select(*kept)).withColumn("spans", spans("text"))


def digests(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Per document: how many spans of each kind the rules found, their digest, and all spans as text."""
    listed = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size).select("doc_id", "spans")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["probability"].isNull())
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    text = F.array_join(F.transform(base, line), ",")
    return listed.select("doc_id", *counts, F.sha2(text.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))


def redacted(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""

    def one(text: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind']}]"]
            at = max(at, s["end"])
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([one(t, s) if t and len(s) else t for t, s in zip(texts, spans)], dtype=object)

    # The document lives in a struct, so a column of its own called spans is kept.
    whole = docs.select(F.struct("*").alias("_doc"), "doc_id", "text")
    done = found(whole, size).withColumn("_text", replaced("text", "spans"))
    return done.select("_doc.*", "_text").withColumn("text", F.col("_text")).select(*docs.columns)
