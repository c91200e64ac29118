"""Scalar functions on speakers' names, references, topics and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.views import n_words, table

#: Fixed values.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "sir", "lord", "lady", "dame", "viscount", "earl", "baroness", "captain", "colonel", "major", "general", "admiral", "professor"]
FEMALE_TITLES = ["mrs", "ms", "miss", "lady", "dame", "baroness", "duchess", "countess"]
MALE_TITLES = ["mr", "sir", "lord", "viscount", "earl", "duke", "baron"]

MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f]+", " "))


def normalize_speaker(name: Column) -> Column:
    """Lower case, a blank after an honorific's dot, no honorifics, punctuation or stage words."""
    n = F.lower(F.coalesce(name, F.lit("")))
    n = F.regexp_replace(n, r"\.([a-z])", ". $1")
    n = F.regexp_replace(n, r"^((" + "|".join(TITLES) + r")[. ]+)+", "")
    n = F.regexp_replace(n, r" (rose|said)$", "")
    return squeezed(F.regexp_replace(n, "[^a-z0-9' -]", " "))


def clean_display(name: Column) -> Column:
    """No marks, no open parenthesis; every run of letters begins with a capital."""
    n = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[*]", ""), r"\([^)]*$", "")
    parts = F.regexp_extract_all(squeezed(n), F.lit("[A-Za-z]+|[^A-Za-z]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000000)))), "")


#: Misread characters and what they stand for, applied in order.
MISREAD = [
    ("bavies", "davies"), ("oavies", "davies"), ("srnith", "smith"), ("vvilliams", "williams"), ("0'brien", "o'brien"), ("b0nar", "bonar"),
    ("mrsmith", "mr smith"), ("mrsthatcher", "mrs thatcher"), ("mrdavies", "mr davies"), ("’", "'"),
]


def clean_match(name: Column) -> Column:
    n = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^[*†§#&0-9. ]+(?=[a-z])", "")
    n = F.regexp_replace(n, r"[.,;: ]+$", "")
    n = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), MISREAD, n)
    n = F.regexp_replace(n, r" *- *", "-")
    n = F.regexp_replace(n, r"\b(" + "|".join(TITLES) + r")\.([a-z])", "$1. $2")
    return squeezed(F.regexp_replace(n, r"\bo' ([a-z])", "o'$1"))


def title_gender(name: Column) -> Column:
    """By the title at the start or inside; female titles come first. Null if there is none."""
    n = F.lower(F.coalesce(name, F.lit("")))
    has = lambda ts: n.rlike(r"(^|[^a-z])(" + "|".join(ts) + r")([^a-z]|$)")
    return F.when(has(FEMALE_TITLES), "F").when(has(MALE_TITLES), "M")


def name_tokens(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z ]", " "), " +")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(TITLES))


def name_key(name: Column) -> Column:
    """The tokens in order of the alphabet: the same for every order of a person's names."""
    return F.array_join(F.array_sort(name_tokens(name)), " ")


def comma_swap(name: Column) -> Column:
    return F.regexp_replace(name, r"^([^,]+),\s*(.+)$", "$2 $1")


def constituency_key(place: Column) -> Column:
    words = F.split(F.regexp_replace(F.replace(F.lower(place), F.lit("&"), F.lit(" and ")), "[^a-z ]", " "), " +")
    return F.array_join(F.array_sort(F.filter(words, lambda w: ~w.isin("", "and", "of", "the", "in", "division", "borough"))), " ")


def partial_date(text: Column) -> Column:
    """A year, or an ISO date at the start; null otherwise."""
    year = F.when(text.rlike(r"^\d{4}$"), F.make_date(F.substring(text, 1, 4).try_cast("int"), F.lit(1), F.lit(1)))
    return F.coalesce(year, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10))))


def reference(line: Column) -> Column:
    """The parts of a column reference like `HC Deb 12 January 1920 vol 123 cc456-78`; nulls where it is none."""
    pattern = r"(HC|HL) Deb (\d{1,2} \w+ \d{4}) vol (\d+) cc?(\d+(?:-\d+)?)"
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    return F.struct(
        part(0).alias("reference"), part(1).alias("house"), part(2).alias("date"), part(3).try_cast("int").alias("volume"), part(4).alias("columns")
    )


def topic(title: Column) -> Column:
    t = F.split_part(F.coalesce(title, F.lit("")), F.lit(" (Hansard,"), F.lit(1))
    return F.trim(F.split_part(t, F.lit("—"), F.lit(1)))


def excerpt(text: Column, term: str, around: int) -> Column:
    """So many characters before and after the first match, with ... where the text goes on; null if there is none."""
    at = F.locate(term.lower(), F.lower(text))
    begin = F.greatest(at - around, F.lit(1))
    size = at - begin + len(term) + around
    body = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(text, begin, size), F.when(begin + size <= F.length(text), "...").otherwise(""))
    return F.when(at > 0, body)


def escaped(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def register(spark: SparkSession) -> list[str]:
    """Makes the word count and the Levenshtein test available to SQL as temporary SQL functions."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION word_count(t STRING) RETURNS INT RETURN size(regexp_extract_all(coalesce(t, ''), '[^\\x20\\x09-\\x0D]+', 0))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION near_name(a STRING, b STRING) RETURNS BOOLEAN RETURN levenshtein(a, b) <= 1")
    return ["word_count", "near_name"]


def speaker_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names as transcripts write them, made from suppliers: titles, marks, sides in parentheses."""
    k = F.col("s_suppkey")
    titles = F.array(*[F.lit(t) for t in ("Mr. ", "Mrs. ", "LORD ", "* Sir ", "Dr.", "Miss ", "")])
    tails = F.array(*[F.lit(t) for t in ("", " said", " (Leeds", " rose", ".", ",")])
    name = F.concat(F.element_at(titles, (k % 7 + 1).cast("int")), F.translate("s_name", "0123456789#", "abcdefghij "), F.element_at(tails, (k % 6 + 1).cast("int")))
    return table(spark, sf, "supplier").select(k.alias("id"), name.alias("name"))


NAMES = """WITH n AS (SELECT s_suppkey AS id, ['Mr. ', 'Mrs. ', 'LORD ', '* Sir ', 'Dr.', 'Miss ', ''][s_suppkey % 7 + 1] || translate(s_name, '0123456789#', 'abcdefghij ')
|| ['', ' said', ' (Leeds', ' rose', '.', ','][s_suppkey % 6 + 1] AS name FROM supplier)
"""
SQUEEZE = "trim(regexp_replace({}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
T = "|".join(TITLES)


@query(NAMES + "SELECT id, " + SQUEEZE.format(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\\.([a-z])', '. \\1', 'g'), '^(({T})[. ]+)+', ''), ' (rose|said)$', ''), '[^a-z0-9'' -]', ' ', 'g')") + " AS speaker FROM n")
def fn_normalize_speaker(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_names(spark, sf).select("id", normalize_speaker(F.col("name")).alias("speaker"))


@query(NAMES + """SELECT id, array_to_string(list_transform(regexp_extract_all(""" + SQUEEZE.format("regexp_replace(regexp_replace(name, '[*]', '', 'g'), '\\([^)]*$', '')") + """,
'[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), '') AS display FROM n""")
def fn_clean_speaker_display(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_names(spark, sf).select("id", clean_display(F.col("name")).alias("display"))


@query(NAMES + "SELECT id, " + SQUEEZE.format(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '^[*†§#&0-9. ]+([a-z])', '\\1'), '[.,;: ]+$', ''), ' *- *', '-', 'g'), '\\b({T})\\.([a-z])', '\\1. \\2', 'g'), '\\bo'' ([a-z])', 'o''\\1', 'g')") + " AS matchable FROM n")
def fn_clean_speaker_match(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_names(spark, sf).select("id", clean_match(F.col("name")).alias("matchable"))


@query(NAMES + r"SELECT id, nullif(regexp_extract(name, '\(([A-Za-z. ]+)\)?$', 1), '') AS inside FROM n")
def fn_titled_name(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_names(spark, sf).select("id", F.nullif(F.regexp_extract("name", r"\(([A-Za-z. ]+)\)?$", 1), F.lit("")).alias("inside"))


@query(NAMES + r"SELECT id, trim(regexp_replace(name, '\([^)]*\)?', '', 'g')) AS plain FROM n")
def fn_strip_parens(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_names(spark, sf).select("id", F.trim(F.regexp_replace("name", r"\([^)]*\)?", "")).alias("plain"))


@query(NAMES + f"""SELECT id, CASE WHEN regexp_matches(lower(name), '(^|[^a-z])({'|'.join(FEMALE_TITLES)})([^a-z]|$)') THEN 'F' WHEN regexp_matches(lower(name), '(^|[^a-z])({'|'.join(MALE_TITLES)})([^a-z]|$)') THEN 'M' END AS gender FROM n""")
def fn_title_gender(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_names(spark, sf).select("id", title_gender(F.col("name")).alias("gender"))


KEY = f"list_filter(string_split_regex(regexp_replace(lower(name), '[^a-z ]', ' ', 'g'), ' +'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(t) for t in TITLES)}))"


@query(NAMES + f"SELECT id, {KEY}[-1] AS surname, substr({KEY}[1], 1, 1) AS initial FROM n")
def fn_surname_initial(spark: SparkSession, sf: str) -> DataFrame:
    words = name_tokens(F.col("name"))
    return speaker_names(spark, sf).select("id", F.try_element_at(words, F.lit(-1)).alias("surname"), F.substring(F.try_element_at(words, F.lit(1)), 1, 1).alias("initial"))


@query(NAMES + "SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z \\t]', '', 'g'), '[ \\t]+', ' ', 'g')) AS plain FROM n")
def fn_normalize_name(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z \t]", ""), "[ \t]+", " "))
    return speaker_names(spark, sf).select("id", plain.alias("plain"))


@query(NAMES + f"SELECT id, array_to_string(list_sort({KEY}), ' ') AS name_key FROM n")
def fn_name_key(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_names(spark, sf).select("id", name_key(F.col("name")).alias("name_key"))


@query(r"SELECT p_partkey, regexp_replace(split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2), '^([^,]+),\s*(.+)$', '\2 \1') AS swapped FROM part")
def fn_comma_swap(spark: SparkSession, sf: str) -> DataFrame:
    name = F.regexp_replace("p_name", "^([^ ]+) ", "$1, ")
    return table(spark, sf, "part").select("p_partkey", comma_swap(name).alias("swapped"))


PLACE = "regexp_replace(replace(lower(p_name || ' & Division of ' || p_brand), '&', ' and '), '[^a-z ]', ' ', 'g')"


@query(f"SELECT p_partkey, trim(regexp_replace({PLACE}, ' +', ' ', 'g')) AS place FROM part")
def fn_constituency_norm(spark: SparkSession, sf: str) -> DataFrame:
    place = F.concat("p_name", F.lit(" & Division of "), "p_brand")
    norm = F.regexp_replace(F.replace(F.lower(place), F.lit("&"), F.lit(" and ")), "[^a-z ]", " ")
    return table(spark, sf, "part").select("p_partkey", F.trim(F.regexp_replace(norm, " +", " ")).alias("place"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_filter(string_split_regex({PLACE}, ' +'), lambda w: w NOT IN ('', 'and', 'of', 'the', 'in', 'division', 'borough'))), ' ') AS place_key FROM part")
def fn_const_key(spark: SparkSession, sf: str) -> DataFrame:
    place = F.concat("p_name", F.lit(" & Division of "), "p_brand")
    return table(spark, sf, "part").select("p_partkey", constituency_key(place).alias("place_key"))


@query(f"SELECT s_suppkey, trim(regexp_replace(s_name || ' created March 1900', '(?i)\\b({MONTHS})\\b.*$', '')) AS title FROM supplier")
def fn_lords_title_clean(spark: SparkSession, sf: str) -> DataFrame:
    named = F.concat("s_name", F.lit(" created March 1900"))
    return table(spark, sf, "supplier").select("s_suppkey", F.trim(F.regexp_replace(named, f"(?i)\\b({MONTHS})\\b.*$", "")).alias("title"))


@query(r"SELECT page_id, regexp_extract_all(url, '[0-9]{4}')[1] AS first_year, regexp_extract_all(url, '[0-9]{4}')[-1] AS last_year FROM pages")
def fn_years_from_text(spark: SparkSession, sf: str) -> DataFrame:
    years = F.regexp_extract_all("url", F.lit("[0-9]{4}"), 0)
    return table(spark, sf, "pages").select("page_id", F.try_element_at(years, F.lit(1)).alias("first_year"), F.try_element_at(years, F.lit(-1)).alias("last_year"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) END::VARCHAR AS day FROM orders""")
def fn_partial_date(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("unknown")
    return table(spark, sf, "orders").select("o_orderkey", partial_date(text).cast("string").alias("day"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 0.5 WHEN c_acctbal >= 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS bonus FROM customer""")
def fn_score_time_bonus(spark: SparkSession, sf: str) -> DataFrame:
    bonus = F.when(F.col("c_acctbal") >= 5000, 0.5).when(F.col("c_acctbal") >= 0, 0.25).otherwise(0.0)
    return table(spark, sf, "customer").select("c_custkey", bonus.alias("bonus"))


@query("""SELECT p_partkey, round(len(list_intersect(string_split(p_name, ' '), ['small', 'ring', 'red'])) / len(list_distinct(list_concat(string_split(p_name, ' '), ['small', 'ring', 'red']))), 6) AS score FROM part""")
def fn_score_constituency(spark: SparkSession, sf: str) -> DataFrame:
    """Shared tokens over all tokens."""
    a, b = F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring"), F.lit("red"))
    return table(spark, sf, "part").select("p_partkey", F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("score"))


@query(NAMES + f"SELECT id, CASE WHEN len({KEY}) > 1 AND length({KEY}[1]) > 2 THEN {KEY}[1] END AS first_name FROM n")
def fn_first_name_extract(spark: SparkSession, sf: str) -> DataFrame:
    words = name_tokens(F.col("name"))
    first = F.try_element_at(words, F.lit(1))
    return speaker_names(spark, sf).select("id", F.when((F.size(words) > 1) & (F.length(first) > 2), first).alias("first_name"))


@query("""WITH a AS (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents), b AS (SELECT *, greatest(p - 40, 1) AS q FROM a WHERE p > 0), c AS (SELECT *, p - q + 7 + 40 AS n FROM b)
SELECT doc_id, CASE WHEN q > 1 THEN '...' ELSE '' END || substr(text, q, n) || CASE WHEN q + n <= length(text) THEN '...' ELSE '' END AS excerpt FROM c""")
def fn_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", excerpt(F.col("text"), "License", 40).alias("excerpt")).where("excerpt is not null")


@query(r"SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[.!?]+\s+'), lambda x: contains(lower(x), 'idiot')), '|') AS sentences FROM documents WHERE contains(lower(text), 'idiot')")
def fn_keyword_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("idiot")))
    hits = F.filter(F.split("text", r"[.!?]+\s+"), lambda x: F.contains(F.lower(x), F.lit("idiot")))
    return d.select("doc_id", F.array_join(hits, "|").alias("sentences"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i).{0,30}idiot.{0,30}'), '|') AS lines FROM documents WHERE contains(lower(text), 'idiot')")
def fn_kwic_regex(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("idiot")))
    return d.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit("(?i).{0,30}idiot.{0,30}"), 0), "|").alias("lines"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM documents")
def fn_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", n_words(F.col("text")).alias("words"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props IS NULL AS failed FROM events")
def fn_json_parse_llm(spark: SparkSession, sf: str) -> DataFrame:
    """JSON between code fences, in whatever state: what cannot be read is null and says so."""
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    bare = F.regexp_replace(F.regexp_replace(fenced, r"^\s*```(json)?\s*", ""), r"\s*```\s*$", "")
    read = F.from_json(bare, "k long")
    return table(spark, sf, "events").select("event_id", read["k"].alias("k"), read.isNull().alias("failed"))


@query("""SELECT conv_id, '{' || string_agg('"' || role || '":' || n, ',' ORDER BY role) || '}' AS roles FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY conv_id""")
def fn_json_map(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("role", "n")))
    return n.groupBy("conv_id").agg(F.to_json(F.map_from_entries(entries)).alias("roles"))


@query("SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'irrelevant' WHEN toxic = 1 THEN 'against' ELSE 'for' END AS label FROM labels")
def fn_label_norm(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("toxic") == 1, "against").when(F.col("quality") == 0, "neutral").otherwise("for")
    return table(spark, sf, "labels").select("doc_id", F.when(raw == "neutral", "irrelevant").otherwise(raw).alias("label"))


@query("""SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'mixed' END AS label FROM (SELECT doc_id,
contains(l, 'the')::INT + contains(l, 'and')::INT AS p, contains(l, 'idiot')::INT + contains(l, 'scum')::INT + contains(l, 'trash')::INT AS n FROM (SELECT doc_id, lower(text) AS l FROM documents))""")
def fn_marker_label(spark: SparkSession, sf: str) -> DataFrame:
    held = lambda ws: reduce(lambda a, b: a + b, [F.contains(F.lower("text"), F.lit(w)).cast("int") for w in ws])
    p, n = held(["the", "and"]), held(["idiot", "scum", "trash"])
    return table(spark, sf, "documents").select("doc_id", F.when(p > n, "positive").when(n > p, "negative").otherwise("mixed").alias("label"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(substr(html, 1, 400), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM pages""")
def fn_highlight_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", escaped(F.substring("html", 1, 400)).alias("safe"))
