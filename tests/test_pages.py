"""Pages written by hand: nested, broken and missing tags, compressed files of every kind, links of sitting days."""

from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import functions as F

from agoraspark.sources import pages

FULL = """<!DOCTYPE html><html><head><meta charset="utf-8"><meta NAME="dc.date" content="1950-05-11"><meta property=og:title content='Food &amp; Drink'>
<meta name="dc.date" content="second"><meta name="nothing"><meta content="no name"><title> FOOD (Hansard,
 11 May 1950)</title><style>.x{}</style></head><body><nav><a href="/x">Up</a></nav>
<h1 class="title page">Food <b>and</b> drink</h1><h1 class="title">Second</h1>
<div class="wide house-of-commons-sitting"><cite class="section">HC Deb 11 May 1950 vol 475 c574</cite>
<div id="section-navigation"><a href="/back">Back <cite class="member">Nobody</cite></a></div>
<p>First line
second line <script>var s = "<p>no</p>";</script><p>Open paragraph <cite class="member">Mr. <b>Smith</b></cite>
<footer>Foot <b>note</b></footer><cite class="member"> Mr. Jones <i>(Leeds)</i></cite><cite class="member">Mr. <b>Smith</b></cite></div>
<cite class="member">Outside</cite><p>After</p><a href="">none</a><a name="z">none</a><a HREF="y?a=1&amp;b=2">y</a></body></html>"""


def test_a_page_is_parsed_once_into_all_its_fields():
    got = dict(zip([f.split()[0] for f in pages.FIELDS.replace("map<string, string>", "map").split(", ")], pages.fields(FULL), strict=True))
    assert got == {
        "title": "Foodanddrink", "page_title": " FOOD (Hansard,\n 11 May 1950)", "chamber": "commons", "section_ref": "HC Deb 11 May 1950 vol 475 c574",
        "date": "11 May 1950", "volume": "475", "meta": {"dc.date": "second", "og:title": "Food & Drink"}, "speakers": ["Mr. Jones(Leeds)", "Mr.Smith"],
        "lines": ["HC Deb 11 May 1950 vol 475 c574", "First line", "second line", "Open paragraph", "Mr.", "Smith", "Mr. Jones", "(Leeds)", "Mr.", "Smith"],
        "links": ["/x", "/back", "y?a=1&b=2"], "error": None,
    }


def test_fallbacks_and_broken_pages(spark):
    cases = [
        ("lords", '<div class="house-of-lords-sitting">x', None), ("lords", "<title>Sitting of the LORDS", "no main content"), ("commons", "<title>Lords and Commons</title>", "no main content"),
        ("commons", '<div class="house-of-lords-sitting"></div><div class="house-of-commons-sitting">', None), (None, "<title>Other</title><div class='house-of-lords'>", "no main content"),
        (None, "", "no main content"), (None, None, "no page"), (None, "</div></title><<>< p", "no main content"), ("commons", "<svg><title>commons</title></svg><title>lords</title>", "no main content"),
    ]
    rows = spark.createDataFrame([(i, html) for i, (_, html, _) in enumerate(cases)], "id int, html string")
    got = {r["id"]: r for r in pages.with_fields(rows).collect()}
    for i, (chamber, html, error) in enumerate(cases):
        assert (got[i]["chamber"], got[i]["error"]) == (chamber, error), html
    assert got[0]["lines"] == ["x"] and got[1]["title"] == "Sitting of the LORDS" and got[6]["meta"] == {} and got[7]["links"] == []
    titles = {"<title> a </title>": "a", '<h1 class="title"></h1><title>b</title>': "", "<h1>no</h1>": None, '<h1 class="title">c<div></h1>d</div>': "c"}
    assert {h: pages.fields(h)[0] for h in titles} == titles
    refs = {"HL Deb 1 June 1901 vol 12": ("1 June 1901", "12"), "HL Deb 1901": (None, None), "vol  7": (None, "7"), "": (None, None)}
    assert {r: pages.fields(f'<cite class="section">{r}</cite>')[4:6] for r in refs} == refs
    long = "n" * 200
    assert pages.fields(f'<div class="house-of-lords-sitting"><cite class="member">{long}</cite><cite class="member">{long[1:]}')[7] == [long[1:]]


def test_compressed_files_are_read_as_they_are(spark, tmp_path):
    texts = {"1864/feb/a.html.gz": "one\r\ntwo\rthree\n\x1e␞\x00é", "1864/mar/b.html.gz": "", "year=1901/month=jan/c.html.gz": "x" * 300_000, "notes/d.html.gz": "no year"}
    bodies = {k: gzip.compress(v.encode()) for k, v in texts.items()}
    bodies["1864/mar/two.html.gz"] = gzip.compress(b"in ") + gzip.compress(b"parts")
    bodies["1864/mar/cut.html.gz"] = bodies["1864/feb/a.html.gz"][:-9]
    bodies["1864/mar/plain.html.gz"], bodies["1864/mar/bytes.html.gz"], bodies["1864/mar/other.txt"] = b"<html>", gzip.compress(b"\xff\xfe"), b"left out"
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["path"].split(f"{tmp_path}/")[1]: r for r in pages.read_pages(spark, str(tmp_path)).collect()}
    assert set(got) == set(bodies) - {"1864/mar/other.txt"}
    for name, text in {**texts, "1864/mar/two.html.gz": "in parts"}.items():
        r = got[name]
        assert (r["html"], r["content_hash"], r["error"]) == (text, hashlib.sha256(text.encode()).hexdigest(), None)
        assert r["size"] == len(bodies[name]) and r["file_name"] == name.rsplit("/", 1)[1]
    assert (got["1864/feb/a.html.gz"]["year"], got["1864/feb/a.html.gz"]["month"]) == (1864, "feb")
    assert (got["year=1901/month=jan/c.html.gz"]["year"], got["year=1901/month=jan/c.html.gz"]["month"]) == (1901, "jan")
    assert got["notes/d.html.gz"]["year"] is None
    for name, error in (("cut", "EOFError"), ("plain", "BadGzipFile"), ("bytes", "UnicodeDecodeError")):
        r = got[f"1864/mar/{name}.html.gz"]
        assert r["html"] is None and r["content_hash"] is None and r["error"].startswith(error)


def test_links_of_a_day(spark):
    links = [
        "/historic/commons/1864/feb/7/corn-laws", "/1864/feb/07/poor", None, "", "#top", "/1864/feb/7/x#y", "/1864/feb/7/Contents", "/LORDS/1864/FEB/07/Peers/index.html",
        "/commons/1864/feb/8/other", "/1864/feb/7/", "/1864/feb/7/poor?q=1", "wales", "Wales", "a", "wales/", "wales/index", "http://h.org/lords/1864/feb/7/deep/er", "/1864/feb/07/commons/1864/feb/7/twice",
    ]
    want = [
        "commons/1864/feb/7/corn-laws", "commons/1864/feb/7/poor", "lords/1864/feb/7/poor", "LORDS/1864/FEB/07/Peers", "commons/1864/feb/7/wales", "lords/1864/feb/7/wales", "lords/1864/feb/7/deep", "commons/1864/feb/7/twice",
    ]
    rows = spark.createDataFrame([(links, "1864", "feb", "7"), (["/1864/feb/17/z", "ab"], "1864", "feb", "17"), ([], "1", "2", "3"), (["/1.4/f/d/x", "/1x4/f/d/x"], "1.4", "f", "d")], "links array<string>, y string, m string, d string")
    got = [r[0] for r in rows.select(pages.debate_links(F.col("links"), F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == [want, ["commons/1864/feb/17/z", "lords/1864/feb/17/z", "commons/1864/feb/17/ab", "lords/1864/feb/17/ab"], [], ["commons/1.4/f/d/x", "lords/1.4/f/d/x"]]
