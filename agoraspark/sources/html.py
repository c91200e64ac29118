"""Pages to metadata, text, links and speeches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.functions.names import reference, topic
from agoraspark.registry import query
from agoraspark.session import ship
from agoraspark.views import n_words, table

SPEECH = "array<struct<speaker: string, text: string, contribution_id: string, is_question: boolean, question_number: string>>"
LEAST = 50


class _Speeches(HTMLParser):
    """Collects member contributions: who speaks in the cite, what in the blockquote's paragraphs, the question's number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.now: dict | None = None
        self.depth, self.inside, self.question = 0, "", False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kinds = (dict(attrs).get("class") or "").split()
        if tag == "div":
            if self.now is None and {"hentry", "member_contribution"} <= set(kinds):
                self.now, self.depth = {"id": dict(attrs).get("id"), "speaker": "", "parts": [], "quote": False, "number": ""}, 0
            self.depth += self.now is not None
        elif self.now is not None:
            if tag == "cite" and "member" in kinds:
                self.inside = "speaker"
            elif tag == "blockquote":
                self.now["quote"] = True
            elif tag == "p" and self.now["quote"]:
                self.inside = "" if "procedural" in kinds else "text"
                self.now["parts"].append("")
            elif tag == "span" and "question_no" in kinds:
                self.question = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "div" and self.now is not None:
            self.depth -= 1
            if not self.depth:
                self.close_speech()
        elif tag in ("cite", "p", "blockquote"):
            self.inside = ""
        elif tag == "span":
            self.question = False

    def handle_data(self, data: str) -> None:
        if self.now is None:
            return
        if self.question:
            self.now["number"] += data
        elif self.inside == "speaker":
            self.now["speaker"] += data
        elif self.inside == "text":
            self.now["parts"][-1] += data

    def close_speech(self) -> None:
        s, self.now = self.now, None
        text = " ".join(x for x in (" ".join(p.split()) for p in s["parts"]) if x)
        number = re.search(r"\d+", s["number"])
        if s["speaker"].strip() and len(text) >= LEAST:
            self.found.append({"speaker": s["speaker"].strip(), "text": text, "contribution_id": s["id"], "is_question": bool(number), "question_number": number[0] if number else None})


def speeches_in(html: str | None) -> list[dict]:
    """The speeches of a page in order; none of a page that is null."""
    parser = _Speeches()
    parser.feed(html or "")
    parser.close()
    return parser.found


class _Text(HTMLParser):
    """The text outside nav, footer, script and style."""

    SKIP = {"nav", "footer", "script", "style"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.skipped = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.skipped += tag in self.SKIP

    def handle_endtag(self, tag: str) -> None:
        self.skipped -= tag in self.SKIP and self.skipped > 0

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.lines += [x.strip() for x in data.split("\n") if x.strip()]


def plain_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.lines)


def with_speeches(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with an array `speeches`; Python parses, in Arrow batches."""
    ship(pages.sparkSession)
    return pages.withColumn("speeches", F.udf(speeches_in, SPEECH, useArrow=True)(html))


def unescaped(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def conversation_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page a conversation, marked up as transcripts are."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = F.concat(F.lit('<div class="hentry member_contribution" id="c'), "turn", F.lit('"><cite class="member">'), "role",
                    F.lit('</cite><blockquote class="contribution_text"><p>'), safe, F.lit('</p><p class="procedural">Order</p></blockquote></div>'))
    c = table(spark, sf, "conversations").select("conv_id", F.struct("turn", part.alias("part")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "\n")
    house = F.when(F.col("conv_id") % 5 == 0, "lords").otherwise("commons")
    pages = c.groupBy("conv_id").agg(body.alias("body"))
    head = F.concat(F.lit('<html><head><title>Sitting (Hansard, 1 May 1950)</title></head><body><div class="house-of-'), house, F.lit('-sitting"><cite class="section">HC Deb 11 May 1950 vol 475 c574</cite>'))
    return pages.select("conv_id", F.concat(head, "body", F.lit("</div></body></html>")).alias("html"))


FLAT = "trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"SELECT conv_id, role AS speaker, 'c' || turn AS contribution_id, md5({FLAT}) AS text_md5 FROM conversations WHERE length({FLAT}) >= 50")
def html_extract_speeches(spark: SparkSession, sf: str) -> DataFrame:
    out = with_speeches(conversation_pages(spark, sf)).select("conv_id", F.inline("speeches"))
    return out.select("conv_id", "speaker", "contribution_id", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers FROM conversations GROUP BY conv_id")
def html_extract_speakers(spark: SparkSession, sf: str) -> DataFrame:
    names = F.filter(F.regexp_extract_all("html", F.lit('<cite class="member">([^<]*)</cite>'), 1), lambda n: F.length(n) < 200)
    return conversation_pages(spark, sf).select("conv_id", F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("speakers"))


@query()
def html_strip_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    ship(spark)
    return p.select("page_id", F.udf(plain_text, "string", useArrow=True)("html").alias("text"))


@query(r"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars FROM documents""")
def doc_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines, chars = F.size(F.split("text", "\n", -1)).cast("long"), F.length("text").cast("long")
    return table(spark, sf, "documents").select("doc_id", lines.alias("lines"), n_words(F.col("text")).alias("words"), chars.alias("chars"))


@query("SELECT page_id, sha256(html) AS content_hash, substr(md5(url || '_' || page_id), 1, 16) AS debate_id FROM pages")
def doc_hash(spark: SparkSession, sf: str) -> DataFrame:
    short = F.substring(F.md5(F.concat_ws("_", "url", "page_id")), 1, 16)
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("content_hash"), short.alias("debate_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'HC' END AS house, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 900 + 1 AS INTEGER) END AS volume,
CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey || '-' || (o_orderkey + 3) END AS columns FROM orders""")
def ref_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.when(k % 4 != 0, F.concat(F.lit("HC Deb 11 May 1950 vol "), F.col("o_custkey") % 900 + 1, F.lit(" cc"), k, F.lit("-"), k + 3)).otherwise("no reference")
    r = table(spark, sf, "orders").select("o_orderkey", reference(line).alias("r"))
    return r.select("o_orderkey", "r.house", "r.volume", "r.columns")


@query("SELECT p_partkey, p_name AS topic FROM part")
def topic_parse(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" (Hansard, 1 May 1950)"))).otherwise(F.concat("p_name", F.lit(" — continued")))
    return table(spark, sf, "part").select("p_partkey", topic(title).alias("topic"))


@query("SELECT page_id, string_split(url, '/')[-1] AS leaf, string_split(url, '/')[-2] AS folder FROM pages")
def path_parse(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("url", "/")
    return table(spark, sf, "pages").select("page_id", F.element_at(parts, -1).alias("leaf"), F.element_at(parts, -2).alias("folder"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 <> 0 AS success, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 = 0 THEN 'no value' END AS error FROM events")
def error_to_row(spark: SparkSession, sf: str) -> DataFrame:
    """What fails becomes a row that says so."""
    k = F.from_json("props", "k long")["k"]
    value = F.try_divide(F.lit(1), k % 7)
    return table(spark, sf, "events").select("event_id", value.isNotNull().alias("success"), F.when(value.isNull(), "no value").alias("error"))


@query("SELECT page_id, CAST(length(html) AS BIGINT) AS size, substr(html, 1, 5000) AS preview, contains(html, '<article>') AS has_article FROM pages")
def gzip_preview(spark: SparkSession, sf: str) -> DataFrame:
    size, has = F.length("html").cast("long"), F.contains("html", F.lit("<article>"))
    return table(spark, sf, "pages").select("page_id", size.alias("size"), F.substring("html", 1, 5000).alias("preview"), has.alias("has_article"))
