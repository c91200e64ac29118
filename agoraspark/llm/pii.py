"""Operator 3, PII: base patterns, and what a character-level BiLSTM-CRF adds to them.

The tagger is trained in numpy from labelled spans (tagger.py) and sent to the tasks, some 100 kB. Personal data has a
digit, an @, or a spelled-out "at" or "dot"; the stretches of text within REACH characters of one, and on to the next white
space whatever its distance, are read in overlapping windows. The windows' scores are reconciled over the whole stretch: each position takes the mean of the windows that
cover it, weighted by how far it is from their edges, and one Viterbi pass decodes the stretch, so that no seam can break
a span. Runs of one kind are the spans; an email begins where its run of letters, digits and marks does, however long. Those
that overlap a base span go, and those that can't be of their kind: a card must pass Luhn, an address of four numbers stay
under 256, an email have its host, a phone 7 to 15 digits; no number may be a part of a longer one, or a book's.

Edge cases: null and empty texts have no spans; texts of any length are read whole, in batches of windows; repeated rows
are read alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.llm.common import ship, table
from agoraspark.llm.tagger import KINDS, TAGS, WINDOW, Span, Tagger, encoded, luhn, stored

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A whole run of digits fails or fits at its start alone, so no run is tried again from inside.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?(?:at|dot) ?[)\]}]|\b(?:dot|DOT)\b")
NUMBER, SPACE = re.compile(r"[0-9]+"), re.compile(r"\s")
#: A number goes on before or behind a span.
BEFORE, BEHIND = re.compile(r"[0-9][-./]?$"), re.compile(r"[-./]?[0-9]")
#: An email with its host, spelled in any way: in brackets, or with both words bare.
EMAIL = re.compile(
    r"(?i)[a-z0-9._%+-]+(?:(?:\s*@\s*|\s*[(\[{]\s*(?:@|at)\s*[)\]}]\s*)[a-z0-9-]+(?:(?:\.|\s*[(\[{]\s*(?:\.|dot)\s*[)\]}]\s*|\s+dot\s+)[a-z0-9-]+)+"
    r"|\s+at\s+[a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)*\s+dot\s+[a-z]{2,4})"
)
#: What no span ends with.
ENDS = " \t\r\n.,;:!?"
REACH, STEP, BATCH = 40, 32, 2048


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, kind by kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append(("email", begin, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    if not any(c in text for c in "0123456789"):
        return out
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """The stretches within REACH characters of what personal data cannot be without, on to white space, joined up."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() + REACH <= out[-1][1]:
            continue
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        while low and not text[low - 1].isspace() and not (out and low <= out[-1][1]):
            low -= 1
        high = after.start() if (after := SPACE.search(text, high)) else len(text)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def windows(size: int) -> list[int]:
    """Starts of windows over a stretch of so many characters, each half over the last."""
    return list(range(0, max(1, size - WINDOW + STEP), STEP))


#: How much a position of a window counts: the more, the farther it is from the window's edges.
WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)


def reconciled(stretches: list[str], tagger: Tagger) -> list[np.ndarray]:
    """The tags of each stretch: scores of its windows in their weighted mean, then one decoding of all of it."""
    jobs = [(n, start) for n, s in enumerate(stretches) for start in windows(len(s))]
    mean = [np.zeros((len(s), TAGS)) for s in stretches]
    weight = [np.zeros((len(s), 1)) for s in stretches]
    for at in range(0, len(jobs), BATCH):
        part = jobs[at : at + BATCH]
        x = np.stack([encoded(stretches[n][start : start + WINDOW].ljust(WINDOW)) for n, start in part])
        for (n, start), e in zip(part, tagger.emissions(x).transpose(1, 0, 2), strict=True):
            size = min(WINDOW, len(stretches[n]) - start)
            mean[n][start : start + size] += e[:size] * WEIGHT[:size, None]
            weight[n][start : start + size] += WEIGHT[:size, None]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(stretches)
    order = sorted(range(len(stretches)), key=lambda n: len(stretches[n]))
    while order:
        # Of like length, padded with what is surely outside; no more cells than a batch of windows has.
        longest = len(stretches[order[-1]])
        group = order[-max(1, BATCH * WINDOW // max(1, longest)) :]
        del order[-len(group) :]
        e = np.full((longest, len(group), TAGS), -1e4)
        e[:, :, 0] = 0
        for k, n in enumerate(group):
            e[: len(stretches[n]), k] = mean[n] / weight[n]
        for n, tags in zip(group, tagger.best_tags(e), strict=True):
            out[n] = tags[: len(stretches[n])]
    return out


def plausible(kind: str, text: str) -> bool:
    numbers = NUMBER.findall(text)
    digits = "".join(numbers)
    if kind == "email":
        return EMAIL.fullmatch(text) is not None
    if kind == "ip":
        return len(numbers) == 4 and all(int(x) <= 255 for x in numbers)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15 and not book(text, digits)


def book(text: str, digits: str) -> bool:
    """Whether a number with hyphens is a book's: its last digit checks the others."""
    if "-" not in text or len(digits) not in (10, 13):
        return False
    if len(digits) == 13:
        return digits[:3] in ("978", "979") and sum(int(d) * (1 + 2 * (i % 2)) for i, d in enumerate(digits)) % 10 == 0
    return text.count("-") == 3 and sum(int(d) * (10 - i) for i, d in enumerate(digits)) % 11 == 0


def whole(kind: str, text: str, a: int, b: int) -> int | None:
    """Where a span of a kind really begins; None if it is a part of something longer."""
    if kind == "email":
        while a and text[a - 1] in LOCAL_CHARS:
            a -= 1
        return a
    return None if BEFORE.search(text, max(0, a - 2), a) or BEHIND.match(text, b) else a


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """What the tagger finds in each text."""
    where = [(row, low, high) for row, t in enumerate(texts) for low, high in regions(t)]
    out: list[list[Span]] = [[] for _ in texts]
    for (row, low, high), tags in zip(where, reconciled([texts[row][low:high] for row, low, high in where], tagger), strict=True):
        kind = (tags + 1) // 2
        cut = np.flatnonzero((kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(tags)).tolist(), strict=True):
            if kind[a]:
                name, piece = KINDS[kind[a] - 1], texts[row][low + a : low + b]
                a, b = low + a + len(piece) - len(piece.lstrip()), low + b - len(piece) + len(piece.rstrip(ENDS))
                a = whole(name, texts[row], a, b) if b > a else None
                if a is not None and plausible(name, texts[row][a:b]) and not (out[row] and a < out[row][-1][2]):
                    out[row].append((name, a, b))
    return out


def apart(new: list[Span], base: list[Span]) -> list[Span]:
    """Those of new that overlap none of base: one pass over both in order."""
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    begins = [a for a, _ in taken]
    return [s for s in new if not ((at := bisect_left(begins, s[2])) and taken[at - 1][1] > s[1])]


def find_all(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans and all spans, by start, then kind."""
    place = {k: n for n, k in enumerate(KINDS)}
    order = lambda s: (s[1], place[s[0]], s[2])
    out = []
    for text, more in zip(texts, model_spans(texts, tagger), strict=True):
        base = base_spans(text)
        new = apart(more, base)
        out.append((sorted(base, key=order), sorted(base + new, key=order)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, key: str = "doc_id", tagger: Tagger | None = None) -> DataFrame:
    """key, counts by kind of the base spans, their digest, and all spans, of every row of docs."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(tagger or stored(docs.sparkSession))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = find_all(texts, model.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            every = pa.array([written(spans) for _, spans in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("key"), *counts, digest, every], ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    shape = f"key {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, shape).withColumnRenamed("key", key)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
