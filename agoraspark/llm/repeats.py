"""Operator 10, suffix-array dedup by a run-length index: long matches anywhere in the corpus are marked and removed.

1. Anchors. Every window of `length` bytes has one anchor: of the K-byte strings inside, the one with the least hash,
   the leftmost of equals. Equal windows have equal anchors, and consecutive windows mostly share theirs, so a text
   gives about one anchor for every 85 bytes. Anchors are counted with partial sums; those that occur once, and with
   them nearly all of an unrepetitive corpus, are done.
2. Contexts. The windows of one repeated anchor are one piece of text, its context. Each task hands on a context once,
   and a mark if it met it again, so thousands of copies cost one; contexts are dealt to buckets by anchor, so equal
   windows share a bucket. Contexts of an anchor that has more than HOT_BYTES of them go to no bucket: their windows are
   counted one by one, by 128 bits of their bytes, with partial sums.
3. Run-length index. In each bucket the contexts' suffixes are sorted by prefix doubling, the Burrows-Wheeler transform
   is cut into runs, and what is kept is run-compressed: the runs' symbols and lengths, and for the first (last) suffix
   of each run its place in the text and its longest common prefix with the neighbour above (below). At any other suffix
   that prefix is one less than at the text position before. So contexts are streamed against the samples: each position
   takes its longest match elsewhere from the sample before it. Windows whose match is `length` or more, or whose
   context occurs more than once, repeat.
4. Their bytes are marked on the documents by (document, start) and removed.

Edge cases: null and empty texts, and texts shorter than `length`, lose nothing; repeated rows count as occurrences of
each other; a match never crosses documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.llm import bytesets as bs
from agoraspark.llm.common import HOT_ROWS, fingerprint, joined_apart, saved, ship, small, table

LENGTH = 200
K = 64
BUCKET_BYTES = 1_500_000
#: An anchor with more bytes of contexts is not left to one task.
HOT_BYTES = 1_500_000
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor): the runs of windows with one anchor. data: bytes of rows, split at ends."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    sums, n = bs.prefix_sums(data), len(data) - K + 1
    h = bs.mixed((sums[K:] - sums[:-K]) * bs.inverse_powers(n))
    least = bs.sliding_min((h & ~_PLACE) | np.arange(n, dtype=np.uint64), length - K + 1)
    at = (least & _PLACE).astype(np.int64)
    first, after = ends[:-1], np.maximum(ends[1:] - length + 1, ends[:-1])
    cuts = np.unique(np.concatenate([np.flatnonzero(at[1:] != at[:-1]) + 1, first, after]))
    cuts = cuts[cuts < len(at)]
    stops = np.append(cuts[1:], len(at))
    row = np.searchsorted(ends, cuts, "right") - 1
    fits = cuts < after[row]
    cuts, stops, row = cuts[fits], stops[fits], row[fits]
    return row, cuts - ends[row], stops - cuts, h[at[cuts]].view(np.int64)


def _find_anchors(length: int, group_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column("doc").to_numpy(zero_copy_only=False)
            for begin, data, (ends, _) in _pieces(b.column("text"), length, group_bytes):
                row, _, _, anchor = anchors(data, ends, length)
                yield pa.RecordBatch.from_arrays([pa.array(doc[begin + row], pa.binary()), pa.array(anchor)], ["doc", "anchor"])

    return run


def _pieces(column: pa.Array, length: int, group_bytes: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, int]]]:
    """The groups of rows; a row of more bytes than a group comes in parts that overlap by all but one window."""
    for begin, data, ends in bs.text_groups(column, group_bytes):
        if len(data) <= 2 * group_bytes:
            yield begin, data, (ends, 0)
        else:
            for at in range(0, len(data) - length + 1, group_bytes):
                part = data[at : at + group_bytes + length - 1]
                yield begin, part, (np.array([0, len(part)]), at)


def _cut_contexts(length: int, group_bytes: int):
    """(context, anchor, windows, body, news, doc, start) of each run of windows whose anchor is found again; news: the
    first time, with the body, and the second time that this task meets a context."""
    types = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.int32())
    names = ["context", "anchor", "windows", "body", "news", "doc", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            found, doc = b.column("found"), b.column("doc").to_numpy(zero_copy_only=False)
            wanted, cut = found.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))])
            for begin, data, (ends, at) in _pieces(b.column("text"), length, group_bytes):
                row, start, windows, anchor = anchors(data, ends, length)
                keep = np.isin(anchor, wanted[cut[begin] : cut[begin + len(ends) - 1]])
                row, start, windows, anchor = row[keep], start[keep], windows[keep], anchor[keep]
                low, raw = (ends[row] + start).tolist(), data.tobytes()
                digest, body, news = [], [], []
                for i, n in zip(low, windows.tolist(), strict=True):
                    piece = raw[i : i + n + length - 1]
                    name = hashlib.md5(piece).digest()
                    times = seen.get(name, 0)
                    digest.append(name)
                    body.append(None if times else piece)
                    news.append(times < 2)
                    if times < 2:
                        seen[name] = times + 1
                columns = (digest, anchor, windows, body, news, doc[begin + row], start + at)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _ranks(at: np.ndarray, key: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by position (the first place of each run of equal keys), and the places that are shared."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = places[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    rank = np.zeros(n, np.int64)
    rank[at] = first
    alone = new & np.append(new[1:], True)
    return rank, places[~alone]


class RunIndex:
    """The run-compressed index of symbols (0 to 256): runs of the Burrows-Wheeler transform and samples at their ends.

    heads, sizes: the symbol and length of each run. sides: for the neighbour above and below, the sampled text positions
    in order and the longest common prefix of the suffix there with that neighbour. begins: positions at which texts
    begin, which are sampled too, as nothing is carried over from the text before.
    """

    def __init__(self, symbols: np.ndarray, begins: np.ndarray, depth: int) -> None:
        """depth: matches of more symbols need not be told apart."""
        n, width = len(symbols), 7
        padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(width):
            key = (key << 9) | padded[j : j + n]
        order = np.argsort(key)
        rank, open_ = _ranks(order, key[order], np.arange(n), n)
        levels = [(width, rank)]
        while width < depth and len(open_):
            # Only suffixes that still share their place are sorted on, by their rank and that of what follows.
            at = order[open_]
            then = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
            key = rank[at] * np.int64(n + 1) + then
            inner = np.argsort(key)
            order[open_] = at[inner]
            new, still = _ranks(at[inner], key[inner], open_, n)
            rank = rank.copy()
            rank[at[inner]] = new[at[inner]]
            open_ = still
            width *= 2
            levels.append((width, rank))

        def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            size = np.zeros(len(i), np.int64)
            for wide, names in reversed(levels):
                a, b = i + size, j + size
                inside = (a < n) & (b < n)
                same = inside & (names[np.minimum(a, n - 1)] == names[np.minimum(b, n - 1)])
                size += np.where(same, wide, 0)
            for _ in range(levels[0][0] - 1):
                a, b = i + size, j + size
                size += (a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
            return size

        bwt = symbols[order - 1]
        runs = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.heads, self.sizes = bwt[runs], np.diff(np.append(runs, n))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.sides = []
        for ends, step in ((runs, -1), (np.append(runs[1:], n) - 1, 1)):
            ends = np.union1d(ends, place[begins])
            beside = ends + step
            there = (beside >= 0) & (beside < n)
            at = order[ends]
            value = np.zeros(len(ends), np.int64)
            value[there] = common(at[there], order[beside[there]])
            by_text = np.argsort(at)
            self.sides.append((at[by_text], value[by_text]))

    def longest_elsewhere(self, low: int, high: int) -> np.ndarray:
        """Of the positions low to high, exclusive, each one's longest match with any other position, exact up to depth."""
        at = np.arange(low, high)
        best = np.zeros(high - low, np.int64)
        for places, value in self.sides:
            # The samples within low to high, and the one before: each holds up to the next.
            first, after = np.searchsorted(places, low, "right") - 1, np.searchsorted(places, high)
            held = np.diff(np.append(np.maximum(places[first:after], low), high))
            best = np.maximum(best, np.repeat(value[first:after] + places[first:after], held) - at)
        return best


def repeated_windows(bodies: list[bytes], windows: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context, the runs (low, high) of its windows that occur in any of the others or elsewhere in itself."""
    if not bodies:
        return []
    sizes = np.array([len(x) + 1 for x in bodies])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols = np.zeros(int(sizes.sum()), np.int16)
    for at, body in zip(begins, bodies, strict=True):
        symbols[at : at + len(body)] = np.frombuffer(body, np.uint8).astype(np.int16) + 1
    index = RunIndex(symbols, begins, int(sizes.max()))
    out = []
    for at, n in zip(begins.tolist(), windows, strict=True):
        edge = np.diff(np.concatenate([[0], (index.longest_elsewhere(at, at + n) >= length).astype(np.int8), [0]]))
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)))
    return out


def _index(length: int):
    def run(bucket: pa.Table) -> pa.Table:
        times: dict[bytes, int] = {}
        known: dict[bytes, tuple[int, int, bytes]] = {}
        for name, anchor, windows, body in zip(*(bucket.column(c).to_pylist() for c in ("context", "anchor", "windows", "body")), strict=True):
            times[name] = times.get(name, 0) + 1
            if body is not None:
                known[name] = (anchor, windows, body)
        shared: dict[int, int] = {}
        for anchor, _, _ in known.values():
            shared[anchor] = shared.get(anchor, 0) + 1
        out = [(name, 0, known[name][1]) for name, n in times.items() if n > 1]
        alone = {known[name][0] for name, n in times.items() if n == 1}
        chosen = sorted((anchor, name) for name, (anchor, _, _) in known.items() if anchor in alone and shared[anchor] > 1)
        group: list[bytes] = []
        size = 0
        for i, (anchor, name) in enumerate(chosen):
            group.append(name)
            size += len(known[name][2])
            last = i + 1 == len(chosen)
            if last or (chosen[i + 1][0] != anchor and size > BUCKET_BYTES):
                marks = repeated_windows([known[x][2] for x in group], [known[x][1] for x in group], length)
                out += [(x, lo, hi) for x, m in zip(group, marks, strict=True) if times[x] == 1 for lo, hi in m]
                group, size = [], 0
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"context": pa.array(cols[0], pa.binary()), "low": pa.array(cols[1], pa.int32()), "high": pa.array(cols[2], pa.int32())})

    return run


def _windows(length: int):
    """(context, at, window): the name of each window of a context. The anchor lies elsewhere in each, so they all differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                name, at, window = [], [], []
                for context, n, body in zip(*(part.column(c).to_pylist() for c in ("context", "windows", "body")), strict=True):
                    name += [context] * n
                    at += range(n)
                    window += [hashlib.md5(body[i : i + length]).digest() for i in range(n)]
                arrays = [pa.array(name, pa.binary()), pa.array(at, pa.int32()), pa.array(window, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["context", "at", "window"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, low, high): the runs of consecutive places of each context."""
    for b in batches:
        out = []
        for context, places in zip(b.column("context").to_pylist(), b.column("places").to_pylist(), strict=True):
            at = np.unique(places)
            cut = np.flatnonzero(np.diff(at) > 1)
            out += [(context, int(lo), int(hi) + 1) for lo, hi in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)], strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["context", "low", "high"])


def hot_marks(news: DataFrame, length: int) -> DataFrame:
    """(context, low, high) of the repeated windows of news (context, windows, body), whatever the size of an anchor."""
    once = news.groupBy("context").agg(F.count("*").alias("n"), F.max("windows").alias("windows"), F.max("body").alias("body"))
    once = saved(once)
    windows = once.select("context", "windows", "body").mapInArrow(_windows(length), "context binary, at int, window binary")
    again = saved(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"))
    places = windows.join(small(again), "window").groupBy("context").agg(F.collect_list("at").alias("places"))
    whole = once.where("n > 1").select("context", F.lit(0).alias("low"), F.col("windows").alias("high"))
    alone = places.join(once.where("n = 1").select("context"), "context", "left_semi")
    return whole.union(alone.mapInArrow(_runs, "context binary, low int, high int"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that touch or overlap become one."""
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            merged: list[dict] = []
            for x in sorted(spans, key=lambda x: (x["low"], x["high"])):
                if merged and x["low"] <= merged[-1]["high"]:
                    merged[-1]["high"] = max(merged[-1]["high"], x["high"])
                else:
                    merged.append(x)
            out.append(merged)
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(out, b.schema.field("spans").type)], ["doc", "spans"])


def repeated_anchors(found: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of found (doc, anchor) whose anchor occurs more than once."""
    again = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    return joined_apart(found, again, "anchor", hot_rows).select("doc", "anchor")


def starts(docs: DataFrame, length: int = LENGTH, group_bytes: int = bs.GROUP_BYTES) -> DataFrame:
    """(doc, spans): for each row of docs (doc, text) with repeats, the spans (low, high) of window starts that repeat."""
    if length <= K:
        raise ValueError(f"length must be over {K}")
    long = docs.where(F.octet_length("text") >= length)
    found = saved(long.mapInArrow(_find_anchors(length, group_bytes), "doc binary, anchor long"))
    by_doc = repeated_anchors(found).groupBy("doc").agg(F.collect_set("anchor").alias("found"))
    cut = long.join(by_doc, "doc").select("doc", "text", "found")
    uses = saved(cut.mapInArrow(_cut_contexts(length, group_bytes), "context binary, anchor long, windows int, body binary, news boolean, doc binary, start int"))
    bulk = uses.agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(12, int(bulk) // (4 * BUCKET_BYTES))
    news = uses.where("news").select("context", "anchor", "windows", "body")
    hot = saved(news.groupBy("anchor").agg(F.sum(F.length("body")).alias("n")).where(F.col("n") > HOT_BYTES).select("anchor"))
    crowded = not hot.isEmpty()
    marks = (news.join(small(hot), "anchor", "left_anti") if crowded else news).withColumn("bucket", F.pmod("anchor", F.lit(buckets)))
    # As many tasks as buckets, so that a task's share does not grow with the input.
    marks = marks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_index(length), "context binary, low int, high int")
    if crowded:
        marks = marks.union(hot_marks(news.join(small(hot), "anchor", "left_semi"), length))
    spans = uses.select("context", "doc", "start").join(saved(marks), "context")
    span = F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    by_doc = spans.groupBy("doc").agg(F.collect_set(span).alias("spans"))
    return saved(by_doc.mapInArrow(_joined, "doc binary, spans array<struct<low: int, high: int>>"))


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                data = (text.as_py() or "").encode()
                removed = runs = at = 0
                digest = hashlib.sha256()
                for low, high in sorted((x["low"], x["high"] + length - 1) for x in spans.as_py() or []):
                    if low > at or not runs:
                        digest.update(data[at:low])
                        runs, removed, at = runs + 1, removed + high - low, high
                    elif high > at:
                        removed, at = removed + high - at, high
                digest.update(data[at:])
                out.append((len(data), removed, runs, digest.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def keyed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), "text", fingerprint(key, "text").alias("doc"))


def dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", group_bytes: int = bs.GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs. group_bytes: texts are read in groups of about
    so many bytes, longer ones in parts."""
    ship(docs.sparkSession)
    rows = keyed(docs, key)
    spans = starts(rows.select("doc", "text"), length, group_bytes)
    both = rows.join(small(spans), "doc", "left").select("doc_id", "text", "spans")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_remove(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
