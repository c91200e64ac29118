"""Stored pages: compressed files as they are, and all that a page's markup says in one parse.

`read_pages` reads a folder of .html.gz files, one file a page, with year and month from the path; a file that can't be
read is a row that says why. `with_fields` parses every page once, by a table function joined laterally, into its title,
house, reference, day, volume, map of meta tags, speakers, lines and links.

Edge cases: a null page has no fields, and says so in error; tags left open are closed by what closes around them, ends
without a beginning are ignored; of repeated meta names the last stands; line ends are kept as they are in the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoraspark.registry import query
from agoraspark.session import new_folder, ship
from agoraspark.sources.html import conversation_pages
from agoraspark.views import table

FIELDS = (
    "title string, page_title string, chamber string, section_ref string, date string, volume string, meta map<string, string>, "
    "speakers array<string>, lines array<string>, links array<string>, error string"
)
#: What the pages call their houses, and what is not part of a page's text.
HOUSES = {"house-of-commons-sitting": "commons", "house-of-lords-sitting": "lords"}
ASIDE = {"nav", "footer", "script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A speaker's name is shorter than this.
NAME = 200


class _Page(HTMLParser):
    """One pass over a page. Every element of interest, while it is open, has a list that gets its text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []  # (tag, what it is)
        self.kept: dict[str, list[str]] = {}  # the first of each kind
        self.members: list[list[tuple[str, list[str]]]] = []
        self.meta: dict[str, str] = {}
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(reversed(attrs))
        kinds = (a.get("class") or "").split()
        if tag == "meta":
            name, content = a.get("name") or a.get("property"), a.get("content")
            if name and content:
                self.meta[name] = content
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in VOID:
            return
        what = ""
        if tag == "title":
            what = "page_title"
        elif tag == "h1" and "title" in kinds:
            what = "title"
        elif tag == "cite" and "section" in kinds:
            what = "section_ref"
        elif tag == "div":
            what = next((h for h in HOUSES if h in kinds), "aside" if a.get("id") == "section-navigation" else "")
        elif tag in ASIDE:
            what = "aside"
        if what and what != "aside":
            if what in self.kept:
                what = ""
            else:
                self.kept[what] = []
        elif tag == "cite" and "member" in kinds:
            what = "member"
            inside = {w for _, w in self.open}
            self.members.append(([h for h in HOUSES if h in inside and "aside" not in inside], []))
        self.open.append((tag, what))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not data.strip():
            return
        inside = [w for _, w in self.open]
        aside = "aside" in inside or any(t in ("script", "style") for t, _ in self.open)
        for i, (_, w) in enumerate(self.open):
            if w == "member":
                nth = sum(x == "member" for x in inside[: i + 1]) - sum(x == "member" for x in inside)
                self.members[nth - 1][1].append(data.strip())
            elif w in HOUSES and not aside:
                self.kept[w].append(data.strip())
            elif w in self.kept and w not in HOUSES:
                self.kept[w].append(data if w == "page_title" else data.strip())


def fields(html: str | None) -> tuple:
    """What FIELDS lists, of one page."""
    if html is None:
        return (None,) * 6 + ({}, [], [], [], "no page")
    p = _Page()
    p.feed(html)
    p.close()
    text = {k: "".join(v) for k, v in p.kept.items()}
    house = next((h for h in HOUSES if h in p.kept), None)
    page_title = text.get("page_title")
    said = (page_title or "").lower()
    chamber = HOUSES[house] if house else next((h for h in HOUSES.values() if h in said), None)
    section = text.get("section_ref")
    day, volume = re.search(r"\d{1,2}\s+\w+\s+\d{4}", section or ""), re.search(r"vol\s+(\d+)", section or "")
    lines = [x for part in p.kept.get(house, []) for x in part.split("\n") if x.strip()]
    speakers = {s for houses, parts in p.members if house in houses and (s := "".join(parts)) and len(s) < NAME}
    return (
        text["title"] if "title" in text else page_title and page_title.strip(), page_title, chamber, section, day and day[0], volume and volume[1], p.meta,
        sorted(speakers), lines, p.links, None if house else "no main content",
    )


class _Fields:
    def eval(self, html: str):  # noqa: ANN201
        yield fields(html)


def with_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the columns of FIELDS, from one parse each; columns of pages with these names must be renamed before."""
    ship(pages.sparkSession)
    parsed = F.udtf(_Fields, returnType=FIELDS)
    return pages.lateralJoin(parsed(F.col(html).outer()))


def _unzipped(batches: Iterator) -> Iterator:
    import gzip
    import hashlib

    import pyarrow as pa

    for b in batches:
        pages, hashes, errors = [], [], []
        for content in b.column("content").to_pylist():
            try:
                raw = gzip.decompress(content)
                pages.append(raw.decode("utf-8"))
                hashes.append(hashlib.sha256(raw).hexdigest())
                errors.append(None)
            except Exception as e:  # noqa: BLE001  whatever is wrong with a file is its own row's error
                pages.append(None)
                hashes.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        cols = [b.column(c) for c in ("path", "size", "modified")] + [pa.array(x, pa.string()) for x in (pages, hashes, errors)]
        yield pa.RecordBatch.from_arrays(cols, ["path", "size", "modified", "html", "content_hash", "error"])


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """path, file_name, size, modified, year, month, html, content_hash (of the unzipped bytes), error of every .html.gz below
    a folder. year and month are the two folders that a file lies in: 1864/feb or year=1864/month=feb."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(folder)
    files = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    schema = StructType([f for f in files.schema.fields if f.name != "content"]).add("html", "string").add("content_hash", "string").add("error", "string")
    read = files.mapInArrow(_unzipped, schema)
    parts = F.split("path", "/")
    named = lambda i: F.regexp_replace(F.try_element_at(parts, F.lit(i)), "^[a-z]+=", "")
    year = F.when(named(-3).rlike(r"^\d+$"), named(-3).try_cast("int"))
    return read.select("path", F.element_at(parts, -1).alias("file_name"), "size", "modified", year.alias("year"), named(-2).alias("month"), "html", "content_hash", "error")


def debate_links(links: Column, year: Column, month: Column, day: Column) -> Column:
    """The paths of debates that a sitting day's page links to, in order, each once: those under a house and the day, those
    under the day alone (for both houses), and bare names. Days count with and without a leading zero."""
    quote = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    padded = F.when(day.rlike(r"^\d+$"), F.lpad(day, 2, "0")).otherwise(day)
    both = lambda topic: F.array(*[F.concat_ws("/", F.lit(h), year, month, day, topic) for h in HOUSES.values()])
    found = lambda text, pattern, i: F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(i)), F.lit(""))

    def paths(link: Column) -> Column:
        norm = F.regexp_replace(F.regexp_replace(link, r"(?i)/(index\.html?|index)/?$", ""), "/+$", "")
        ways = []
        for d in (day, padded):
            at = F.concat(F.lit("/"), quote(year), F.lit("/"), quote(month), F.lit("/"), quote(d), F.lit("/([^/?#]+)"))
            full = found(norm, F.concat(F.lit("(?i)/(commons|lords)"), at), 0)
            topic = found(norm, F.concat(F.lit("(?i)"), at), 1)
            ways += [F.when(full.isNotNull(), F.array(F.ltrim(full, F.lit("/")))), F.when(topic.isNotNull(), both(topic))]
        bare = F.when(norm.rlike(r"^[a-z0-9][a-z0-9\-]{1,80}$"), both(norm))
        skipped = F.lower(link).rlike("#|contents")
        return F.when(skipped, F.array().cast("array<string>")).otherwise(F.coalesce(*ways, bare, F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(F.filter(links, lambda x: F.coalesce(x, F.lit("")) != ""), paths)))


def transcript_pages(spark: SparkSession, sf: str) -> DataFrame:
    """conversation_pages in the ways that pages come: with a heading, a house in the title alone, meta tags, tags left open."""
    k, p = F.col("conv_id"), conversation_pages(spark, sf)
    html = F.when(k % 3 == 1, F.regexp_replace("html", r"house-of-\w+-sitting", "other")).otherwise(F.col("html"))
    title = F.concat(F.lit("<title> Business of the "), F.when(k % 5 == 0, "Lords").otherwise("Commons"), F.lit(" (Hansard, 1 May 1950)</title>"))
    html = F.when(k % 3 == 1, F.regexp_replace(html, "<title>[^<]*</title>", title)).otherwise(html)
    meta = F.concat(F.lit('<head><meta charset="utf-8"><meta name="conv" content="'), k.cast("string"), F.lit('"><meta content="a &amp; b" property="og:title"><meta name="empty" content="">'))
    html = F.regexp_replace(html, "^<html><head>", F.concat(F.lit("<html>"), meta))
    heading = F.concat(F.lit('<h1 class="big title"> Topic <b>'), k.cast("string"), F.lit("</b> <i>end</h1><nav>Back <p>to</nav>"))
    return p.select("conv_id", F.when(k % 2 == 0, F.regexp_replace(html, '<cite class="section">', F.concat(heading, F.lit('<cite class="section">')))).otherwise(html).alias("html"))


@query("SELECT DISTINCT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'lords' ELSE 'commons' END AS chamber, CASE WHEN conv_id % 3 = 1 THEN 'no main content' END AS error FROM conversations")
def html_chamber(spark: SparkSession, sf: str) -> DataFrame:
    """By the sitting's own mark, else by the title."""
    return with_fields(transcript_pages(spark, sf)).select("conv_id", "chamber", "error")


@query("""SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Topic' || conv_id || 'end' WHEN conv_id % 3 = 1 THEN 'Business of the ' || CASE WHEN conv_id % 5 = 0 THEN 'Lords' ELSE 'Commons' END || ' (Hansard, 1 May 1950)'
ELSE 'Sitting (Hansard, 1 May 1950)' END AS title, 'HC Deb 11 May 1950 vol 475 c574' AS section_ref, '11 May 1950' AS date, '475' AS volume FROM conversations""")
def html_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return with_fields(transcript_pages(spark, sf)).select("conv_id", "title", "section_ref", "date", "volume")


@query("""SELECT DISTINCT conv_id, unnest(['conv', 'og:title']) AS name, unnest([conv_id::VARCHAR, 'a & b']) AS content FROM conversations""")
def html_meta_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Every name or property with its content."""
    return with_fields(transcript_pages(spark, sf)).select("conv_id", F.explode("meta").alias("name", "content"))


@query("SELECT page_id, CAST(1800 + page_id % 7 AS INTEGER) AS year, ['jan', 'feb'][page_id % 2 + 1] AS month, sha256(html || chr(10)) AS content_hash, NULL::VARCHAR AS error, md5(html) AS html_md5 FROM pages")
def scan_html_gz(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as compressed files, one each, read as they are. (The text writer ends a file with a line feed.)"""
    folder, k = new_folder(spark, "html"), F.col("page_id")
    pages = table(spark, sf, "pages").select((F.lit(1800) + k % 7).alias("year"), F.element_at(F.array(F.lit("jan"), F.lit("feb")), (k % 2 + 1).cast("int")).alias("month"), "html")
    pages.write.partitionBy("year", "month").option("compression", "gzip").option("maxRecordsPerFile", 1).text(folder)
    read = read_pages(spark, folder)
    known = table(spark, sf, "pages").select("page_id", F.sha2(F.concat("html", F.lit("\n")), 256).alias("content_hash"))
    return read.join(known, "content_hash").select("page_id", "year", "month", "content_hash", "error", F.md5(F.regexp_replace("html", r"\n\z", "")).alias("html_md5"))


@query(rf"""WITH l AS (SELECT page_id, unnest(h) AS topic, generate_subscripts(h, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS h FROM pages)),
p AS (SELECT page_id, i, unnest(CASE WHEN page_id % 4 = 0 THEN ['lords/1864/feb/7/' || regexp_extract(rtrim(topic, '/'), '^[^/?#]+')]
  WHEN page_id % 4 = 1 OR regexp_full_match(topic, '[a-z0-9][a-z0-9-]{{1,80}}') THEN ['commons/1864/feb/7/' || regexp_extract(topic, '^[^/?#]+'), 'lords/1864/feb/7/' || regexp_extract(topic, '^[^/?#]+')] ELSE [] END) AS path
  FROM l WHERE page_id % 4 < 3 AND NOT contains(topic, '#') AND NOT contains(lower(topic), 'contents'))
SELECT page_id, path AS link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i, path) - 1 AS INTEGER) AS nth FROM (SELECT page_id, path, min(i) AS i FROM p GROUP BY 1, 2)""")
def source_link_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The debates that a day's pages link to, in order."""
    begin = F.element_at(F.array(*[F.lit(x) for x in ("/lords/1864/feb/7/", "/historic/1864/FEB/07/", "", "/1864/mar/7/")]), (F.col("page_id") % 4 + 1).cast("int"))
    pages = table(spark, sf, "pages").select("page_id", F.replace("html", F.lit('<a href="/'), F.concat(F.lit('<a href="'), begin)).alias("html"))
    links = debate_links(F.col("links"), F.lit("1864"), F.lit("feb"), F.lit("7"))
    return with_fields(pages).select("page_id", F.posexplode(links).alias("nth", "link"))
