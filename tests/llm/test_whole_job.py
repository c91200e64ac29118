"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import collections
import random
from itertools import combinations
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from agoraspark.llm import decontamination, repeats, toxicity, url_filters
from agoraspark.llm.common import fingerprint


def test_op5_table_holds_every_string():
    codes = np.unique(np.random.default_rng(5).integers(0, 1 << 32, 1_500_000, dtype=np.uint64).astype(np.uint32))
    values = np.arange(1, len(codes) + 1)
    rest = np.setdiff1d(np.arange(0, 1 << 32, 40_009, dtype=np.uint64).astype(np.uint32), codes)
    model = toxicity.lookup_table(codes, values)
    data = np.concatenate([codes[::7], rest]).astype(">u4").view(np.uint8)
    data = data[~np.isin(data, np.arange(65, 91))]  # no capitals, which are lower-cased
    got = toxicity.looked_up(toxicity.grams(data), model)
    want = dict(zip(codes.tolist(), values.tolist(), strict=True))
    assert got.tolist() == [want.get(c, 0) for c in toxicity.grams(data).tolist()]
    assert (toxicity.looked_up(codes, model) == values).all() and not toxicity.looked_up(rest, model).any()
    assert not toxicity.looked_up(rest, toxicity.lookup_table(codes[:0], values[:0])).any()


def test_op5_strings_keep_their_own_counts(spark):
    """A toxic and an ordinary string whose hashes agree in 20 bits: each is scored by its own counts."""
    inverse = pow(0x9E3779B1, -1, 1 << 32)
    letters = set(b"abcdefghijklmnopqrstuvwxyz")
    same = ([(((s << 12) | low) * inverse) % (1 << 32) for low in range(4096)] for s in range(1 << 20))
    pair = next(p for x in same if len(p := [c.to_bytes(4, "big") for c in x if set(c.to_bytes(4, "big")) <= letters]) > 1)
    bad, good = pair[0].decode(), pair[1].decode()
    docs = spark.createDataFrame([(i, f"{bad} {good[:3]}#" if i % 2 else f"{good} {bad[:3]}#") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    learned = toxicity.learn(docs, labels)
    value = toxicity.looked_up(np.array([int.from_bytes(x, "big") for x in pair[:2]], np.uint32), learned["model"])
    assert value[0] > 0.5 and value[1] < -0.5


def test_op2_masks_cover_every_pattern():
    """However the places that may differ lie, a mask reads none of them; every mask ignores places between those it reads."""
    for m in decontamination.MASKS:
        assert m.count("1") >= 6 and "0" in m.strip("0") and m.startswith("11") and m.endswith("1")
    for size in range(decontamination.WHOLE, 31):
        wide = min(size, 20)
        laid = [sum(1 << at + i for i, c in enumerate(m) if c == "1") for m in decontamination.MASKS for at in range(wide - len(m) + 1)]
        for differ in combinations(range(wide), wide - -(-wide * 8 // 10)):
            gone = sum(1 << i for i in differ)
            assert any(not m & gone for m in laid), (size, differ)


def test_op2_says_if_the_masks_miss_overlaps(spark):
    bench = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(30)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "t1 t2")], "doc_id long, text string")
    with pytest.raises(ValueError, match="masks"):
        decontamination.overlaps(docs, bench, agree=0.5)


def test_op2_common_short_items_are_one_hit_a_document(spark):
    """An item of one common word is found once in each document, whatever its place and number there."""
    docs = [(i, "the " * (i % 50) + "word the end the") for i in range(200)] + [(300, "then"), (301, "others")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The"), (2, "the end")], "item_id long, text string")
    found = decontamination.overlaps(docs, bench).groupBy("doc", "item").count().collect()
    assert len(found) == 400 and {r["count"] for r in found} == {1}
    assert decontamination.decontaminate(docs, bench).count() == 2 and decontamination.decontaminate(docs, bench, shortest=3).count() == 202


@pytest.mark.parametrize("m", [12, 15, 16])
def test_op2_finds_overlaps_whatever_tokens_differ(spark, m):
    item = [f"item{i}" for i in range(m)]
    rows = []
    for differ in combinations(range(m), m - -(-m * 8 // 10)):
        rows.append((len(rows), "before " + " ".join("other" if i in differ else w for i, w in enumerate(item)) + " after"))
    wrong = (len(rows), " ".join(["other"] * (m - -(-m * 8 // 10) + 1) + item[m - -(-m * 8 // 10) + 1 :]))
    docs = spark.createDataFrame([*rows, wrong], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()] == [wrong[0]]


def test_op2_finds_short_items_whole(spark):
    items = [(m, " ".join(f"w{m}x{i}" for i in range(m))) for m in range(1, 12)]
    docs = [(m, f"Before, {t} after") for m, t in items] + [(20 + m, t) for m, t in items]
    docs += [(40 + m, t.rsplit(" ", 1)[0] + " other") for m, t in items if m > 1] + [(60, None), (61, ""), (62, "w1")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (30, None), (31, " ")], "item_id long, text string")
    found = decontamination.overlaps(docs, bench, shortest=1).join(docs.withColumn("doc", fingerprint("doc_id", "text")), "doc")
    assert sorted(tuple(r) for r in found.select("doc_id", "item").collect()) == [(k + m, m) for k in (0, 20) for m in range(1, 12)]


def test_op10_leaves_no_crowded_anchor_to_one_group(spark, monkeypatch):
    """A passage in many texts, whose surroundings differ: no group holds all contexts of its anchors."""
    bound, length, index = 20_000, 200, repeats._index
    monkeypatch.setattr(repeats, "HOT_BYTES", bound, raising=False)

    def guarded(n):
        run = index(n)

        def check(bucket):
            size = collections.Counter()
            for anchor, body in zip(bucket.column("anchor").to_pylist(), bucket.column("body").to_pylist(), strict=True):
                size[anchor] += len(body or b"")
            assert not size or max(size.values()) <= bound
            return run(bucket)

        return check

    monkeypatch.setattr(repeats, "_index", guarded)
    rnd = random.Random(10)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, near = noise(330), noise(150)
    texts = [noise(rnd.randrange(80, 300)) + passage + noise(rnd.randrange(80, 300)) for _ in range(300)]
    texts += [near + passage + noise(200), near[20:] + passage + noise(90), texts[0], texts[1][:-50], noise(400)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    times = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = {}
    for k, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        want[k] = sum(gone)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.dedup(docs, length).collect()}
    assert got == want and sum(want.values()) > 300 * 330


def test_op7_resolves_links(spark):
    bases = ["http://a.io/b/c?q=1#f", "https://a.io", "http://a.io/b/"]
    targets = ["/en/7", "//x.com/y", "z", "z/w?k=1", "?p=2", "#g", "../u", "./v", "/a/../b/./c", "..", "http://o.net/p", "HTTPS://o.net", "../../../r"]
    pairs = spark.createDataFrame([(b, t) for b in bases for t in targets], "base string, target string")
    for b, t, got in pairs.select("base", "target", url_filters.resolved(F.col("target"), F.col("base"))).collect():
        assert got.rstrip("/").lower() == urljoin(b, t).rstrip("/").lower(), (b, t)
    none = spark.createDataFrame([("",), ("mailto:a@b.c",), ("javascript:x",)], "target string")
    assert {r[0] for r in none.select(url_filters.resolved(F.col("target"), F.lit("http://a.io/b"))).collect()} == {""}


def test_op7_follows_relative_links_and_any_order(spark):
    pages = [
        (1, "http://x.com/q/1", '<link rel=canonical href="/en/7">'), (2, "http://y.io/", "<link href=//x.com/en/8 rel=canonical>"),
        (3, "http://z.io/", '<meta content="0;url=http://x.com/en/9" http-equiv=refresh>'), (4, "http://free.io/", '<link rel=canonical href="/en/7">'),
    ]
    out = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted((r["page_id"], r["verdict"]) for r in out.collect()) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow")]
