"""Personal data in texts: exact patterns, and a character tagger that adds what is written in other ways.

The tagger is a bidirectional LSTM with CRF transitions (``bilstm``), trained on the driver from labelled spans of a bounded
sample: the pattern matches of the corpus itself, a part of them rewritten into forms that the patterns do not cover (a
telephone number without its plus, an address with a blank around the sign or spelled out, a card number with other separators). All
kinds hold a digit, an ``@`` or a spelled-out sign, so the surroundings of these are the regions looked at, wherever they stand in a text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.bilstm import WIDTH, Tagger, codes, decode_scored
from sheaf.session import ship_package

KINDS = ("email", "ip", "card", "phone")  # in this order of ties
TRAIN_TEXTS = 400  # texts that teach the tagger at most, chosen by hash: those with matches, and
PLAIN = 4  # one in so many of them chosen whether it has a match or not
TRAIN_WINDOWS = 1200  # windows of theirs at most, dealt evenly over the kinds and what is none
UPDATES = 240  # training steps
ROUNDS = 6  # through a small sample, each with rewritings of its own
STRETCHES = 20  # of one text in the sample
REACH = 40  # characters looked at on both sides of a digit, an @ or a spelled-out sign
MARGIN = 4.0  # log-odds of a telephone number in one or two groups against none

# The base patterns. Domains are tried at each @, all else from left to right.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: No candidate without one of these; the same for Spark. "at" alone is a common word, so a domain or a dot must follow.
TRIGGERS = r"[0-9@]|[(\[{<] ?(?:[aA][tT]|[dD][oO][tT]) ?[)\]}>]|\b(?:at|AT) [A-Za-z0-9-]+(?:\.| dot | DOT )[A-Za-z]"
TRIGGER = re.compile(TRIGGERS)
AT = re.compile(r"(?i) ?[(\[{<] ?at ?[)\]}>] ?| at ")
DOT = re.compile(r"(?i) ?[(\[{<] ?dot ?[)\]}>] ?| dot ")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, place of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @: the characters before it back to the last match, and a domain behind it."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        last = end
        at = text.find("@", end)


def _card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, by start and kind; kinds may overlap one another."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for run in DOTTED.finditer(text):  # an address lies within one run of digits and dots
        if run.group().count(".") >= 3:
            for m in IP.finditer(text, *run.span()):
                parts = [p.lstrip("0") for p in m.group().split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    out.append((m.start(), 1, m.end()))
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and _card(_digits(m.group()))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# The tagger

TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]


def _allowed() -> np.ndarray:
    """Inside a kind only behind its begin or inside."""
    out = np.ones((len(TAGS), len(TAGS)), bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = False
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of a text within reach of a digit, an @ or a spelled-out sign, disjoint."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _rewritten(kind: int, value: str, rng: np.random.Generator) -> str:
    """The same data in a form the base patterns may not cover."""
    if kind == 0:
        local, _, domain = value.partition("@")
        if rng.random() < 0.5:
            return str(rng.choice([f"{local} @ {domain}", f"{local}@ {domain}", f"{local} @{domain}"]))
        at, dot = rng.choice(["(at)", "[at]", "at"]), rng.choice([".", "(dot)", "[dot]", "dot"])
        close = "" if at != "at" and rng.random() < 0.3 else " "
        return f"{local}{close}{at}{close}" + domain.replace(".", "." if dot == "." else f" {dot} ")
    if kind == 1:
        return value.replace(".", str(rng.choice([". ", " . "])))
    digits = _digits(value)
    if kind == 2:
        sep = str(rng.choice([".", "  ", "_", "/"]))
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, head, tail = digits[-10:-7], digits[-7:-4], digits[-4:]
    if rng.random() < 0.5:
        return str(rng.choice([f"({area}){head}{tail}", f"({area}) {head}{tail}", f"0{area} {head}{tail}", f"0{area}{head}{tail}", f"0{digits[-11:-8]} {digits[-8:]}"]))
    return str(rng.choice([f"({area}) {head}-{tail}", f"{area}-{head}-{tail}", f"{area}.{head}.{tail}", f"00{digits[:-10]} {area} {head} {tail}"]))


def examples(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows and classes from texts and their base matches, half of the matches rewritten; in several rounds where they are few."""
    rng = np.random.default_rng(seed)
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in range(-1, len(KINDS))}
    share = most // len(found)
    for text in (t for _ in range(ROUNDS) if any(len(group) < share for group in found.values()) for t in texts):
        spans = base_spans(text)
        for a, b in regions(text):
            inside = [s for s in spans if a <= s[0] and s[2] <= b]
            if not inside:
                kind, part, tags = -1, text[a:b], np.zeros(b - a, np.int64)
            else:
                kind, pieces, marks, at = inside[0][1], [], [], a
                for s, k, e in inside:
                    if s < at:
                        continue
                    value = text[s:e] if rng.random() < 0.5 else _rewritten(k, text[s:e], rng)
                    pieces += [text[at:s], value]
                    marks += [0] * (s - at) + [1 + 2 * k] + [2 + 2 * k] * (len(value) - 1)
                    at = e
                pieces.append(text[at:b])
                marks += [0] * (b - at)
                part, tags = "".join(pieces), np.array(marks, np.int64)
            shift = int(rng.integers(0, max(1, len(part) - WIDTH + 1)))
            ids, y = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
            own, marks = codes(part)[shift : shift + WIDTH], tags[shift : shift + WIDTH]
            if marks[0] and marks[0] % 2 == 0:
                marks = marks.copy()
                marks[0] -= 1  # a cut span begins at the edge
            ids[: len(own)], y[: len(marks)] = own, marks
            found[kind].append((ids, y))
    rows = [x for group in found.values() for x in group[:share]]
    if not rows:
        return np.zeros((0, WIDTH), np.int64), np.zeros((0, WIDTH), np.int64)
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def train(docs: DataFrame, text: str = "text", texts: int = TRAIN_TEXTS, most: int = TRAIN_WINDOWS, updates: int = UPDATES) -> Tagger | None:
    """A tagger from the base matches of at most ``texts`` texts; none without any match.

    The texts are those with the smallest hashes among all that hold a match, and a share of those with the smallest hashes whatever
    they hold, so that the sample depends on nothing but the corpus. From each, up to ``STRETCHES`` stretches around digits
    and signs travel to the driver, those with a match first.
    """
    ship_package(docs.sparkSession)
    candidates = docs.where(F.col(text).rlike(TRIGGERS)).select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    plain = {r.h for r in candidates.select("h").distinct().orderBy("h").limit(texts // PLAIN).collect()}

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, near, marks = [], [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = base_spans(t)
                if not spans and h not in plain:
                    continue
                places, starts = regions(t), [s for s, _, _ in spans]
                held = [bisect_left(starts, a) < bisect_left(starts, b) for a, b in places]
                chosen = sorted(sorted(range(len(places)), key=lambda i: not held[i])[:STRETCHES])  # noqa: B023
                hashes.append(h)
                near.append("\n".join(t[max(0, a - REACH) : b + REACH] for a, b in (places[i] for i in chosen)))
                marks.append(bool(spans))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(near, pa.string()), pa.array(marks, pa.bool_())], names=["h", "near", "held"])

    marked = candidates.mapInArrow(stretches, "h long, near string, held boolean")
    # copies of one text count once; texts without a match are few, so they come first
    sample = marked.groupBy("h").agg(F.min("near").alias("near"), F.max("held").alias("held")).orderBy("held", "h").limit(texts)
    ids, y = examples([r.near for r in sample.collect()], most)
    if not len(ids) or not y.any():
        return None
    tagger = Tagger(TAGS, _allowed())
    tagger.fit(ids, y, updates)
    return tagger


def _plausible(kind: int, value: str, margin: float) -> bool:
    """What an added span must look like at least; a telephone number in few groups must be sure by the tagger's margin."""
    digits = _digits(value)
    if kind == 0:
        if "@" not in value:
            value = AT.sub("@", DOT.sub(".", value), count=1)
        local, sign, domain = value.partition("@")
        return bool(sign and LOCAL.search(local) and DOMAIN.fullmatch(domain.strip()))
    if kind == 1:
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", value)
    if kind == 2:
        return _card(digits) and not re.search(r"[A-Za-z]", value)
    groups = len(re.findall(r"[0-9]+", value))
    return 9 <= len(digits) <= 15 and (groups >= 3 or margin >= MARGIN) and not re.search(r"[^0-9+().\x20-]", value)


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the tagger finds beside the base spans of each text."""
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    out: list[list[Span]] = [[] for _ in texts]
    for (i, a, _), (path, scores) in zip(places, decode_scored(tagger, [texts[i][a:b] for i, a, b in places]), strict=True):
        begins = np.flatnonzero(path % 2 == 1)
        for s in begins.tolist():
            kind, e = int(path[s]) // 2, s + 1
            while e < len(path) and path[e] == path[s] + 1:
                e += 1
            margin = tagger.margin(scores, path, s, e)
            start, end = a + s, a + e
            while start < end and texts[i][start] in " \n\t,;:":
                start += 1
            while start < end and texts[i][end - 1] in " \n\t,;:.":
                end -= 1
            if start < end and _plausible(kind, texts[i][start:end], margin) and not any(x < end and start < y for x, _, y in base[i]):
                out[i].append((start, kind, end))
    return out


FOUND = "struct<n:array<bigint>,base:string,spans:string>"
_TYPE = pa.struct([("n", pa.list_(pa.int64())), ("base", pa.string()), ("spans", pa.string())])


def find(spark, tagger: Tagger | None, text: Column) -> Column:
    """A struct for each text: counts per kind of all spans, the base spans and all spans, each ``kind:start:end`` (code points, end
    exclusive) by start and then kind, comma-joined.

    A null or empty text has none. Base spans are always kept; an added span never overlaps one. Texts are read
    whole, whatever their length. Without a tagger the base spans are all there is.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast(tagger)  # some ten thousand numbers

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            base = [base_spans(t) if t else [] for t in texts]
            some = [i for i, t in enumerate(texts) if t]
            more: list[list[Span]] = [[] for _ in texts]
            if shared.value is not None and some:
                for i, found in zip(some, added_spans(shared.value, [texts[i] for i in some], [base[i] for i in some]), strict=True):
                    more[i] = found
            out = []
            for b, m in zip(base, more, strict=True):
                spans = sorted(b + m)
                out.append({"n": [sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))], "base": joined(b), "spans": joined(spans)})
            yield pa.array(out, _TYPE)

    return run(F.when(text.rlike(TRIGGERS), text))
