"""The linkage cascade: speakers as transcripts write them, led step by step to a person of the register.

A speaker is rewritten as long as that gives something new: the name inside a title ("The Minister of Food (Mr. Smith)"), or
what is left without a side remark ("Mr. Smith (resuming)"). Every form is then tried, the innermost first, at 0.95 of the
confidence for each rewriting, by title and day, by seat and year, by house, surname, initial and year, and by the last
word alone. A form that names an officer or several members ends the chain. What no form settles keeps the outcome of
the speaker as written: ambiguous, of one gender only, or a gender from the title.

Equal (form, day, house) are looked up once. The register is counted by its keys first, so that a common surname is one row
of a house and year and no pairs of people are made.

Edge cases: a null or blank speaker, a null date: no match; a null house is the Commons; stints without a first or last
year are not looked up; people of one name are told apart by the date, else the first of the register stands; mention_id
is unique; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.functions.names import MISREAD
from agoraspark.registry import query
from agoraspark.session import new_folder
from agoraspark.views import table

#: The share of the confidence that a rewriting leaves.
REWRITTEN = 0.95
#: The last year that stints are counted in.
LAST_YEAR = 2005

#: What names no single member, wherever it stands.
OFFICERS = [
    "procedural", "the speaker", "the deputy speaker", "the chairman", "the deputy chairman", "the clerk", "madam speaker", "mr. speaker", "several members", "hon. members", "members",
]
#: Titles that begin a name in parentheses; those that are no part of a name; genders by title at the start, and inside.
NAMED = "Mr|Mrs|Ms|Miss|Sir|Dame|Lord|Lady|Dr|Baroness|Viscount|Earl|Colonel|Captain|Major|Commander|Lieut|Lieutenant"
BARE = ["mr", "mrs", "miss", "ms", "dr", "sir", "lord", "lady"]
PARTICLES = ["o'", "o’", "mac", "mc", "van", "von", "de", "del", "di"]
WOMEN, MEN, MEN_INSIDE = "mrs|miss|ms|lady|dame|baroness", "mr|sir|lord|colonel|major|captain|general|admiral|viscount|earl|baron", "mr|sir|lord"
#: Names that both men and women among the candidates may bear.
MIXED = ["lindsay", "apsley", "leslie wilson"]
#: Who held a title from day to day.
HOLDERS = [
    ("prime minister", "1940-05-10", "1945-07-26", "Winston Churchill", "M"),
    ("prime minister", "1945-07-26", "1951-10-26", "Clement Attlee", "M"),
    ("prime minister", "1951-10-26", "1955-04-05", "Winston Churchill", "M"),
    ("prime minister", "1955-04-05", "1957-01-10", "Anthony Eden", "M"),
    ("prime minister", "1957-01-10", "1963-10-18", "Harold Macmillan", "M"),
    ("prime minister", "1963-10-18", "1964-10-16", "Alec Douglas-Home", "M"),
    ("prime minister", "1964-10-16", "1970-06-19", "Harold Wilson", "M"),
    ("prime minister", "1970-06-19", "1974-03-04", "Edward Heath", "M"),
    ("prime minister", "1974-03-04", "1976-04-05", "Harold Wilson", "M"),
    ("prime minister", "1976-04-05", "1979-05-04", "James Callaghan", "M"),
    ("prime minister", "1979-05-04", "1990-11-28", "Margaret Thatcher", "F"),
    ("prime minister", "1990-11-28", "1997-05-02", "John Major", "M"),
    ("prime minister", "1997-05-02", "2007-06-27", "Tony Blair", "M"),
]
SEATS = [r"(?:the\s+)?member\s+for\s+([\w\-'\s]+)", r"(?:the\s+)?mp\s+for\s+([\w\-'\s]+)", r"representative\s+for\s+([\w\-'\s]+)"]


def tidy(speaker: Column) -> Column:
    """Lower case, without question numbers and marks at the ends, misread letters set right, titles set off."""
    s = F.regexp_replace(F.trim(F.lower(F.coalesce(speaker, F.lit("")))), r"^[*†§#&\d]+\.?\s*", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[.,;:]+$", ""), r"\s*-\s*", "-")
    s = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), MISREAD, s)
    s = F.regexp_replace(F.regexp_replace(s, r"\b(mr|dr|sir)\.([a-z])", "$1. $2"), r"\b(mrs|miss)\.([a-z])", "$1. $2")
    return F.regexp_replace(s, r"\bo'\s*([a-z])", "o'$1")


def is_officer(tidied: Column) -> Column:
    return tidied.rlike("|".join(x.replace(".", r"\.") for x in OFFICERS))


def rewritten(speaker: Column) -> Column:
    """(text, via) of a speaker's next form; null if there is none."""
    named = lambda x: x.rlike(rf"^({NAMED})\.?\s+[A-Z]")
    inside = F.trim(F.regexp_extract(speaker, r"\(([^)]+)\)$", 1))
    remark = F.regexp_extract(speaker, r"\(([^)]+)\)[.,;:]*$", 1)
    rest = F.trim(F.regexp_replace(speaker, r"\s*\([^)]*\)[.,;:]*$", ""))
    form = lambda text, via: F.struct(text.alias("text"), F.lit(via).alias("via"))
    return F.when(named(inside), form(inside, "titled_extraction")).when(
        (remark != "") & ~named(F.trim(remark)) & (rest != "") & (rest != speaker), form(rest, "parenthetical_stripped")
    )


def forms(speaker: Column) -> Column:
    """All forms of a speaker, (text, via), the one as written first. A rewriting takes at least one parenthesis away."""
    first = F.array(F.struct(speaker.alias("text"), F.lit(None).cast("string").alias("via")))
    rounds = F.filter(F.sequence(F.lit(0), F.regexp_count(speaker, F.lit(r"\("))), lambda i: i > 0)

    def more(so_far: Column, _: Column) -> Column:
        new = rewritten(F.element_at(so_far, -1)["text"])
        return F.when(new.isNull(), so_far).otherwise(F.concat(so_far, F.array(new)))

    return F.when(F.contains(speaker, F.lit("(")), F.aggregate(rounds, first, more)).otherwise(first)


def by_title(speaker: Column) -> Column:
    n = F.trim(F.lower(F.coalesce(speaker, F.lit(""))))
    woman = n.rlike(rf"^\s*({WOMEN})[.\s]") | n.rlike(rf"\b({WOMEN})[.\s]+[a-z]")
    man = n.rlike(rf"^\s*({MEN})[.\s]") | n.rlike(rf"\b({MEN_INSIDE})[.\s]+[a-z]")
    return F.when(woman, "F").when(man, "M")


def _holder(tidied: Column, day: Column) -> Column:
    """(name, gender, change) of who held a title that is named on a day; change: the day is the term's first or last."""
    options = [
        F.when(
            F.contains(tidied, F.lit(title)) & day.between(F.lit(a).cast("date"), F.lit(b).cast("date")),
            F.struct(F.lit(name).alias("name"), F.lit(gender).alias("gender"), day.isin(F.lit(a).cast("date"), F.lit(b).cast("date")).alias("change")),
        )
        for title, a, b, name, gender in HOLDERS
    ]
    return F.coalesce(*options)


def counted(register: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The register by year: (place, year, name, gender) of seats that one stint holds; people by house, surname, initial (null:
    all) and year, with how many stints and persons there are, the first of them and their genders; persons by name and year
    (null: all), the first, and the first whose stint does not just end. A row for each key, however many share it."""
    r = register.where("person_name is not null").select("nth", "person_id", "person_name", "gender", "chamber", "start_year", "end_year", "constituencies")
    r = r.withColumn("words", F.filter(F.split("person_name", r"\s+"), lambda w: w != "")).where("size(words) > 0")
    last = F.least(F.col("end_year"), F.lit(LAST_YEAR))
    held = r.where(F.col("end_year").isNotNull() & (F.col("start_year") <= last)).withColumn("year", F.explode(F.sequence("start_year", last)))
    seats = held.select("nth", "person_name", "gender", "year", F.explode("constituencies").alias("place")).where("place <> ''")
    seats = seats.groupBy(F.lower("place").alias("place"), "year").agg(F.count("*").alias("n"), F.min(F.struct("nth", F.col("person_name").alias("name"), "gender")).alias("one"))
    seats = seats.where("n = 1").select("place", "year", F.col("one.name").alias("name"), F.col("one.gender").alias("gender"))
    people = held.select("nth", "person_id", "person_name", F.nullif("gender", F.lit("")).alias("gender"), "chamber", "year", F.lower(F.element_at("words", -1)).alias("surname"), F.lower(F.substring(F.element_at("words", 1), 1, 1)).alias("initial"))
    own = F.nullif("person_id", F.lit(""))
    tell = [
        F.count("*").alias("n"), F.min(own).alias("low"), F.max(own).alias("high"), F.min(F.struct("nth", F.col("person_name").alias("name"), "gender")).alias("first"),
        F.min("gender").alias("gender_low"), F.max("gender").alias("gender_high"),
    ]
    by_initial = people.groupBy("chamber", "surname", "year", "initial").agg(*tell)
    least, most = [F.min(c).alias(c) for c in ("low", "first", "gender_low")], [F.max(c).alias(c) for c in ("high", "gender_high")]
    together = by_initial.groupBy("chamber", "surname", "year").agg(F.sum("n").alias("n"), *least, *most)
    people = by_initial.unionByName(together.withColumn("initial", F.lit(None).cast("string")))
    spans = r.where("start_year <= end_year").select("nth", "person_id", "person_name", F.explode(F.sequence("start_year", "end_year")).alias("year"), "end_year")
    one = F.struct("nth", "person_id")
    ids = spans.groupBy("person_name", "year").agg(F.min(one).alias("any"), F.min(F.when(F.col("year") < F.col("end_year"), one)).alias("within"))
    ids = ids.unionByName(r.groupBy("person_name").agg(F.min(one).alias("any")), allowMissingColumns=True)
    return seats, people, ids


def near_surnames(mentions: DataFrame, register: DataFrame) -> DataFrame:
    """(mention_id, near): for mentions whose last word is one letter away from surnames of their house and year, the first
    such surname's first person, if they have the mention's first letter. Words one edit apart share one of their forms with a
    letter left out. What the cascade leaves open may be looked at with this; it is too unsure to settle anything."""

    def shorter(word: Column) -> Column:
        less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
        return F.array_distinct(F.concat(F.array(word), less))

    people = counted(register)[1].where("initial is null and surname <> ''")
    known = people.select("chamber", "surname", "year", F.col("first.name").alias("near"), F.explode(shorter(F.col("surname"))).alias("short"))
    words = F.filter(F.split(tidy(F.col("speaker")), r"\s+"), lambda w: w != "")
    asked = mentions.select("mention_id", F.coalesce("chamber", F.lit("Commons")).alias("chamber"), F.year("date").alias("year"), words.alias("words")).where("size(words) > 1")
    asked = asked.select("mention_id", "chamber", "year", F.element_at("words", -1).alias("last"), F.substring(F.element_at("words", 1), 1, 1).alias("begins"))
    both = asked.withColumn("short", F.explode(shorter(F.col("last")))).join(known, ["chamber", "year", "short"])
    both = both.where((F.levenshtein("last", "surname") == 1) & F.lower("near").startswith(F.col("begins")))
    return both.groupBy("mention_id").agg(F.min(F.struct("surname", "near")).alias("x")).select("mention_id", F.col("x.near").alias("near"))


def cascade(mentions: DataFrame, register: DataFrame) -> DataFrame:
    """(mention_id, match_type, final_match, person_id, gender, confidence, candidates) of every mention.

    mentions: mention_id, speaker, date, chamber. register: nth (the order that decides who is first), person_id, person_name,
    gender, chamber, start_year, end_year, constituencies."""
    m = mentions.select("mention_id", "speaker", "date", F.coalesce("chamber", F.lit("Commons")).alias("chamber"))
    tried = m.select("mention_id", "date", "chamber", F.posexplode(forms(F.coalesce("speaker", F.lit("")))).alias("depth", "f")).select("mention_id", "date", "chamber", "depth", "f.text", "f.via")
    kinds = tried.select("text", "date", "chamber").distinct()
    kinds = kinds.withColumn("tidied", tidy(F.col("text"))).withColumn("year", F.year("date"))
    officer = is_officer(F.col("tidied"))
    words = F.filter(F.split("tidied", r"\s+"), lambda w: w != "")
    kinds = kinds.withColumn("officer", officer).withColumn("words", words).withColumn("bare", F.filter("words", lambda w: ~F.replace(w, F.lit("."), F.lit("")).isin(BARE)))
    end, before = F.try_element_at("bare", F.lit(-1)), F.try_element_at("bare", F.lit(-2))
    kinds = kinds.select(
        "*", _holder(F.col("tidied"), F.col("date").cast("date")).alias("holder"),
        F.when(before.isin(PARTICLES), F.replace(F.concat_ws(" ", before, end), F.lit("’"), F.lit("'"))).otherwise(end).alias("surname"),
        F.when(F.size("bare") > 1, F.substring(F.element_at("bare", 1), 1, 1)).alias("initial"),
        F.when(F.size("words") > 1, F.element_at("words", -1)).alias("last"), F.substring(F.try_element_at("words", F.lit(1)), 1, 1).alias("begins"),
    )
    seats, people, ids = counted(register)
    place = lambda p: F.regexp_replace(F.trim(F.regexp_extract("tidied", "(?U)" + p, 1)), r"[.,;:]+$", "")
    for i, p in enumerate(SEATS):
        own = seats.select(F.col("place").alias(f"place{i}"), "year", F.struct("name", "gender").alias(f"seat{i}"))
        kinds = kinds.withColumn(f"place{i}", place(p)).join(own, [f"place{i}", "year"], "left")
    who = F.struct("n", "low", "high", "first", "gender_low", "gender_high")
    whole = people.where("initial is null").select("chamber", "surname", "year", who.alias("all"))
    exact = people.where("initial is not null").select("chamber", "surname", "year", "initial", who.alias("own"))
    kinds = kinds.join(exact, ["chamber", "surname", "year", "initial"], "left").join(whole, ["chamber", "surname", "year"], "left")
    kinds = kinds.join(whole.select("chamber", F.col("surname").alias("last"), "year", F.col("all.first").alias("by_last")), ["chamber", "last", "year"], "left")
    kinds = kinds.withColumn("seat", F.coalesce("seat0", "seat1", "seat2")).withColumn("found", F.coalesce("own", "all"))
    mixed = F.lower("tidied").rlike("|".join(MIXED))
    out = lambda kind, name, gender, sure, n=F.lit(0): F.struct(
        F.lit(kind).alias("match_type"), name.cast("string").alias("name"), gender.cast("string").alias("gender"), F.lit(sure).cast("double").alias("confidence"), n.cast("long").alias("candidates"))
    none, f = F.lit(None), F.col("found")
    base = (
        F.when(F.col("officer"), out("procedural", none, none, 0.0))
        .when(F.col("holder.change") & ~mixed, out("ambiguous_consistent_gender", none, F.col("holder.gender"), 0.6, F.lit(2)))
        .when(F.col("holder.change"), out("ambiguous", none, F.col("holder.gender"), 0.7, F.lit(2)))
        .when(F.col("holder").isNotNull(), out("title", F.col("holder.name"), F.col("holder.gender"), 0.95))
        .when(F.col("seat").isNotNull(), out("constituency", F.col("seat.name"), F.col("seat.gender"), 0.95))
        .when(f["n"] == 1, out("temporal_unique", f["first"]["name"], f["first"]["gender"], 0.85))
        .when((f["n"] > 1) & (f["low"] == f["high"]), out("temporal_unique", f["first"]["name"], f["first"]["gender"], 0.9))
        .when((f["n"] > 1) & (f["gender_low"] == f["gender_high"]) & ~mixed, out("ambiguous_consistent_gender", none, f["gender_low"], 0.6, f["n"]))
        .when(f["n"] > 1, out("ambiguous", none, none, 0.0, f["n"]))
        .when(F.col("by_last").isNotNull(), out("fuzzy", F.col("by_last.name"), F.col("by_last.gender"), 0.7))
        .otherwise(out("no_match", none, none, 0.0))
    )
    settled = kinds.withColumn("base", base)
    settled = settled.select("text", "date", "chamber", "officer", "base")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in ("text", "date", "chamber")]
    tried = tried.alias("t").join(settled.alias("s"), same(tried, settled)).select("t.mention_id", "t.depth", "t.via", "s.officer", "s.base")
    # The chain ends at its first officer; of the forms before it the deepest that is settled stands, else the first.
    per = tried.groupBy("mention_id").agg(
        F.min(F.when(F.col("officer"), F.col("depth"))).alias("stop"), F.array_sort(F.collect_list(F.struct("depth", "via", "base"))).alias("chain")
    )
    alive = F.filter("chain", lambda x: x["base"]["name"].isNotNull() & (F.col("stop").isNull() | (x["depth"] < F.col("stop"))))
    per = per.withColumn("hit", F.try_element_at(alive, F.lit(-1))).withColumn("first", F.element_at("chain", 1)).withColumn("way", F.try_element_at("chain", F.lit(2))["via"])
    done = F.when(F.col("hit").isNull(), F.col("first.base")).otherwise(F.col("hit.base"))
    per = per.select("mention_id", done.alias("b"), F.coalesce("hit.depth", F.lit(0)).alias("depth"), "way")
    res = m.join(per, "mention_id").withColumn("depth", F.col("depth").cast("double"))
    guess = F.when(F.col("b.match_type") == "no_match", by_title(F.col("speaker")))
    kind = F.when(F.col("depth") > 0, F.col("way")).when(guess.isNotNull(), "title_gender_inference").otherwise(F.col("b.match_type"))
    sure = F.when(guess.isNotNull(), 0.3).otherwise(F.round(F.col("b.confidence") * F.pow(F.lit(REWRITTEN), "depth"), 9))
    res = res.select("mention_id", "date", kind.alias("match_type"), F.col("b.name").alias("final_match"), F.coalesce(guess, "b.gender").alias("gender"), sure.alias("confidence"), F.col("b.candidates").alias("candidates"))
    dated = ids.where("year is not null").select(F.col("person_name").alias("final_match"), F.col("year").alias("at"), "any", "within")
    named = ids.where("year is null").select(F.col("person_name").alias("final_match"), F.col("any.person_id").alias("some_id"))
    res = res.withColumn("at", F.year("date")).join(dated, ["final_match", "at"], "left").join(named, "final_match", "left")
    new_year = (F.month("date") == 1) & (F.dayofmonth("date") == 1)
    there = F.when(new_year, F.col("any")).otherwise(F.col("within"))
    return res.select("mention_id", "match_type", "final_match", F.when(there.isNotNull(), there["person_id"]).otherwise(F.col("some_id")).alias("person_id"), "gender", "confidence", "candidates")


LETTERS = ("0123456789", "abcdefghij")


def register_of(spark: SparkSession, sf: str) -> DataFrame:
    """A register: parts stand for stints. Seven in a row share a surname, and every ninth is another stint of the one before."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    own = F.when(k % 9 == 8, k - 1).otherwise(k)
    surname = F.initcap(F.translate(F.floor(own / 7).cast("string"), *LETTERS))
    given = F.element_at(F.array(*[F.lit(x) for x in ("Small", "Red", "Ann", "Otto", "Rosa")]), (own % 5 + 1).cast("int"))
    start = F.lit(1930) + (own * 3) % 50
    return p.select(
        k.alias("nth"), F.concat(F.lit("p"), own.cast("string")).alias("person_id"), F.concat_ws(" ", given, surname).alias("person_name"),
        F.when(own % 3 == 0, "F").when(own % 17 > 0, "M").alias("gender"), F.when(own % 5 == 0, "Lords").otherwise("Commons").alias("chamber"),
        start.cast("int").alias("start_year"), F.when(k % 41 > 0, (start + own % 12).cast("int")).alias("end_year"),
        F.array(F.concat_ws(" ", F.replace("p_brand", F.lit("#")), F.translate(F.floor(k / 11).cast("string"), *LETTERS))).alias("constituencies"),
    )


def mentions_of(spark: SparkSession, sf: str) -> DataFrame:
    """A speaker for every part, written in one of sixteen ways, of the time of the part's stint or just after it."""
    r, k = register_of(spark, sf), F.col("nth")
    name, surname = F.col("person_name"), F.split_part("person_name", F.lit(" "), F.lit(2))
    ways = [
        F.concat(F.lit("Mr. "), name), F.concat(F.lit("The Minister of Food (Mr. "), name, F.lit(")")), F.concat(F.lit("Mr. "), name, F.lit(" (by Private Notice).")),
        F.concat(F.upper(name), F.lit(" (resuming) (Leader of the House),")), F.lit("The PRIME MINISTER"), F.concat(F.lit("The Member for "), F.col("constituencies")[0], F.lit(".")),
        F.lit("Mr. Speaker"), F.concat(F.lit("24. "), F.substring(name, 1, 1), F.lit(". "), surname), F.concat(F.lit("Mrs. "), F.translate(surname, "ABC", "QQQ"), F.lit("x")),
        F.concat(F.lit("Sir van "), surname), surname, F.lit(None), F.concat(F.lit("Several Members (Mr. "), name, F.lit(")")),
        F.concat(F.lit("The Prime Minister (Mr. "), name, F.lit(")")), F.concat(F.lit("Captain "), F.substring(name, 1, 1), surname, F.lit("b")), F.concat(F.lit("* "), F.lower(surname), F.lit(":")),
    ]
    speaker = F.element_at(F.array(*[w.cast("string") for w in ways]), (k % 16 + 1).cast("int"))
    date = F.make_date((F.col("start_year") + k % 4).cast("int"), (k % 12 + 1).cast("int"), (k % 10 + 1).cast("int"))
    return r.select(k.alias("mention_id"), speaker.alias("speaker"), date.alias("date"), F.when(k % 6 > 0, F.col("chamber")).alias("chamber"))


_OWN = "CASE WHEN p_partkey % 9 = 8 THEN p_partkey - 1 ELSE p_partkey END"
#: r (the register) and m (mentions), as register_of and mentions_of make them.
TABLES = rf"""WITH RECURSIVE p0 AS (SELECT p_partkey AS k, p_brand, {_OWN} AS own FROM part),
p1 AS (SELECT *, translate((own // 7)::VARCHAR, '0123456789', 'abcdefghij') AS low, ['Small', 'Red', 'Ann', 'Otto', 'Rosa'][own % 5 + 1] AS given, (1930 + (own * 3) % 50)::INT AS start_year FROM p0),
p2 AS (SELECT *, upper(low[1]) || low[2:] AS family FROM p1),
r AS (SELECT k AS nth, 'p' || own AS person_id, given || ' ' || family AS person_name, family, CASE WHEN own % 3 = 0 THEN 'F' WHEN own % 17 > 0 THEN 'M' END AS gender, CASE WHEN own % 5 = 0 THEN 'Lords' ELSE 'Commons' END AS chamber,
  start_year, CASE WHEN k % 41 > 0 THEN (start_year + own % 12)::INT END AS end_year, replace(p_brand, '#', '') || ' ' || translate((k // 11)::VARCHAR, '0123456789', 'abcdefghij') AS seat FROM p2),
m AS (SELECT nth AS mention_id, ['Mr. ' || person_name, 'The Minister of Food (Mr. ' || person_name || ')', 'Mr. ' || person_name || ' (by Private Notice).', upper(person_name) || ' (resuming) (Leader of the House),',
  'The PRIME MINISTER', 'The Member for ' || seat || '.', 'Mr. Speaker', '24. ' || person_name[1] || '. ' || family, 'Mrs. ' || translate(family, 'ABC', 'QQQ') || 'x', 'Sir van ' || family, family, NULL,
  'Several Members (Mr. ' || person_name || ')', 'The Prime Minister (Mr. ' || person_name || ')', 'Captain ' || person_name[1] || family || 'b', '* ' || lower(family) || ':'][nth % 16 + 1] AS speaker,
  make_date((start_year + nth % 4)::INT, (nth % 12 + 1)::INT, (nth % 10 + 1)::INT) AS date, CASE WHEN nth % 6 > 0 THEN chamber END AS chamber FROM r)
"""


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_NAMED = rf"^({NAMED})\.?\s+[A-Z]"
_TIDY = r"regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce(text, ''))), '^[*†§#&\d]+\.?\s*', ''), '[.,;:]+$', ''), '\s*-\s*', '-', 'g')"
for _pair in MISREAD:
    _TIDY = f"replace({_TIDY}, {_quoted(_pair)})"
_TIDY = rf"regexp_replace(regexp_replace(regexp_replace({_TIDY}, '\b(mr|dr|sir)\.([a-z])', '\1. \2', 'g'), '\b(mrs|miss)\.([a-z])', '\1. \2', 'g'), '\bo''\s*([a-z])', 'o''\1', 'g')"
_HELD = ", ".join(f"('{t}', DATE '{a}', DATE '{b}', '{n}', '{g}', {i})" for i, (t, a, b, n, g) in enumerate(HOLDERS))
_PLACES = ", ".join(f"nullif(regexp_replace(trim(regexp_extract(tidied, {_quoted([x])}, 1)), '[.,;:]+$', ''), '') AS place{i}" for i, x in enumerate(SEATS))
_WITHIN = "lower(x.chamber) = lower(q.chamber) AND date_part('year', q.date) BETWEEN x.start_year AND x.end_year AND date_part('year', q.date) <= 2005"
SQL = rf"""
, f AS (SELECT mention_id, date, coalesce(chamber, 'Commons') AS chamber, 0 AS depth, coalesce(speaker, '') AS text, NULL::VARCHAR AS via FROM m
  UNION ALL SELECT mention_id, date, chamber, depth + 1, CASE WHEN named THEN inside ELSE rest END, CASE WHEN named THEN 'titled_extraction' ELSE 'parenthetical_stripped' END
  FROM (SELECT *, regexp_matches(inside, '{_NAMED}') AS named FROM (SELECT *, trim(regexp_extract(text, '\(([^)]+)\)$', 1)) AS inside, regexp_extract(text, '\(([^)]+)\)[.,;:]*$', 1) AS remark,
    trim(regexp_replace(text, '\s*\([^)]*\)[.,;:]*$', '')) AS rest FROM f)) WHERE named OR (remark <> '' AND NOT regexp_matches(trim(remark), '{_NAMED}') AND rest <> '' AND rest <> text)),
t AS (SELECT *, {_TIDY} AS tidied FROM f),
w AS (SELECT *, list_filter(string_split_regex(tidied, '\s+'), lambda x: x <> '') AS words FROM t),
b AS (SELECT *, list_filter(words, lambda x: replace(x, '.', '') NOT IN ({_quoted(BARE)})) AS bare FROM w),
q AS (SELECT *, CASE WHEN bare[-2] IN ({_quoted(PARTICLES)}) THEN replace(bare[-2] || ' ' || bare[-1], '’', '''') ELSE bare[-1] END AS surname, CASE WHEN len(bare) > 1 THEN bare[1][1] END AS initial,
  CASE WHEN len(words) > 1 THEN words[-1] END AS last, regexp_matches(tidied, '{"|".join(x.replace(".", "[.]") for x in OFFICERS)}') AS officer,
  regexp_matches(tidied, '{"|".join(MIXED)}') AS mixed, {_PLACES} FROM b),
x AS (SELECT *, lower(string_split(person_name, ' ')[-1]) AS last_name, lower(person_name[1]) AS letter FROM r),
h AS (SELECT mention_id, depth, arg_min(name, i) AS name, arg_min(g, i) AS gender, arg_min(date = a OR date = z, i) AS change FROM q JOIN (VALUES {_HELD}) v(title, a, z, name, g, i) ON contains(tidied, title) AND date BETWEEN a AND z GROUP BY 1, 2),
s AS (SELECT mention_id, depth, arg_min(name, i) AS name, arg_min(gender, i) AS gender FROM (SELECT mention_id, depth, i, min(person_name) AS name, coalesce(min(x.gender), '') AS gender
  FROM (SELECT *, unnest([place0, place1, place2]) AS place, unnest([0, 1, 2]) AS i FROM q) q JOIN x ON lower(seat) = place AND date_part('year', q.date) BETWEEN x.start_year AND x.end_year AND date_part('year', q.date) <= 2005
  GROUP BY 1, 2, 3 HAVING count(*) = 1) GROUP BY 1, 2),
c AS (SELECT q.mention_id, q.depth, x.*, q.initial IS NOT NULL AND letter = q.initial AS fits FROM q JOIN x ON last_name = q.surname AND {_WITHIN}),
d AS (SELECT mention_id, depth, count(*) AS n, count(DISTINCT person_id) AS persons, arg_min(person_name, nth) AS name, arg_min(coalesce(gender, ''), nth) AS gender, count(DISTINCT gender) AS genders, min(gender) AS a_gender
  FROM (SELECT *, bool_or(fits) OVER (PARTITION BY mention_id, depth) AS any_fits FROM c) WHERE fits OR NOT any_fits GROUP BY 1, 2),
l AS (SELECT mention_id, depth, arg_min(person_name, nth) AS name, arg_min(coalesce(x.gender, ''), nth) AS gender FROM q JOIN x ON last_name = q.last AND {_WITHIN} GROUP BY 1, 2),
e AS (SELECT q.*, CASE WHEN officer THEN 'procedural' WHEN h.change AND NOT mixed THEN 'ambiguous_consistent_gender' WHEN h.change THEN 'ambiguous' WHEN h.name IS NOT NULL THEN 'title' WHEN s.name IS NOT NULL THEN 'constituency'
    WHEN n = 1 OR persons = 1 THEN 'temporal_unique' WHEN n > 1 AND genders = 1 AND NOT mixed THEN 'ambiguous_consistent_gender' WHEN n > 1 THEN 'ambiguous' WHEN l.name IS NOT NULL THEN 'fuzzy' ELSE 'no_match' END AS kind,
  h.name AS h_name, h.gender AS h_gender, h.change, s.name AS s_name, nullif(s.gender, '') AS s_gender, d.name AS d_name, nullif(d.gender, '') AS d_gender, d.a_gender, n, persons, l.name AS l_name, nullif(l.gender, '') AS l_gender
  FROM q LEFT JOIN h USING (mention_id, depth) LEFT JOIN s USING (mention_id, depth) LEFT JOIN d USING (mention_id, depth) LEFT JOIN l USING (mention_id, depth)),
g AS (SELECT mention_id, date, depth, via, officer, kind, CASE kind WHEN 'title' THEN h_name WHEN 'constituency' THEN s_name WHEN 'temporal_unique' THEN d_name WHEN 'fuzzy' THEN l_name END AS name,
  CASE WHEN kind = 'procedural' THEN NULL WHEN change OR kind = 'title' THEN h_gender WHEN kind = 'constituency' THEN s_gender WHEN kind = 'temporal_unique' THEN d_gender WHEN kind = 'ambiguous_consistent_gender' THEN a_gender WHEN kind = 'fuzzy' THEN l_gender END AS gender,
  CASE WHEN kind IN ('title', 'constituency') THEN 0.95 WHEN kind = 'temporal_unique' THEN CASE WHEN n = 1 THEN 0.85 ELSE 0.9 END WHEN kind = 'ambiguous_consistent_gender' THEN 0.6 WHEN kind = 'ambiguous' AND change THEN 0.7 WHEN kind = 'fuzzy' THEN 0.7 ELSE 0 END::DOUBLE AS sure,
  CASE WHEN kind LIKE 'ambiguous%' THEN CASE WHEN change THEN 2 ELSE n END ELSE 0 END AS candidates FROM e),
k AS (SELECT mention_id, coalesce(max(depth) FILTER (name IS NOT NULL AND depth < stop), 0) AS best, min(via) FILTER (depth = 1) AS way
  FROM (SELECT *, coalesce(min(depth) FILTER (officer) OVER (PARTITION BY mention_id), 99) AS stop FROM g) GROUP BY 1),
j AS (SELECT g.mention_id, g.date, speaker, CASE WHEN best > 0 THEN way ELSE kind END AS kind, name AS final_match, g.gender, sure * power(0.95, best) AS sure, candidates
  FROM k JOIN g ON g.mention_id = k.mention_id AND depth = best JOIN m ON m.mention_id = k.mention_id),
u AS (SELECT *, CASE WHEN kind = 'no_match' THEN CASE WHEN regexp_matches(trim(lower(coalesce(speaker, ''))), '^\s*({WOMEN})[.\s]|\b({WOMEN})[.\s]+[a-z]') THEN 'F'
  WHEN regexp_matches(trim(lower(coalesce(speaker, ''))), '^\s*({MEN})[.\s]|\b({MEN_INSIDE})[.\s]+[a-z]') THEN 'M' END END AS guess FROM j),
a AS (SELECT mention_id, arg_min(person_id, nth) FILTER (date >= make_date(start_year, 1, 1) AND date <= make_date(end_year, 1, 1)) AS dated, arg_min(person_id, nth) AS some_id FROM u JOIN x ON person_name = final_match GROUP BY 1),
z AS (SELECT mention_id, CASE WHEN guess IS NOT NULL THEN 'title_gender_inference' ELSE kind END AS match_type, final_match, coalesce(dated, some_id) AS person_id, coalesce(guess, gender) AS gender,
  CASE WHEN guess IS NOT NULL THEN 0.3 ELSE round(sure, 9) END AS confidence, CAST(candidates AS BIGINT) AS candidates FROM u LEFT JOIN a USING (mention_id))
"""


def written(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Mentions and register as stored tables, as a corpus has them."""
    made = []
    for df in (mentions_of(spark, sf), register_of(spark, sf)):
        folder = new_folder(spark, "linkage")
        df.write.parquet(folder)
        made.append(spark.read.schema(df.schema).parquet(folder))
    return made[0], made[1]


@query(TABLES + SQL + "SELECT * FROM z")
def match_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Every mention's person, by the whole cascade."""
    return cascade(*written(spark, sf))
