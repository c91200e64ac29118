"""Both gender waterfalls: of the register's members, and of turns in debates. A row takes the first step that knows one.

Lists of honorifics, of women in either house and of first names are arguments; the defaults are plain English titles.
Lists of names may be long and are joined by equal keys, never held in a condition.

Edge cases: null names, houses and years meet no step that needs them; a step that says neither M nor F says nothing; of
several details of one speaker in a debate the last in order stands; extra columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.plans import cascade
from agoraspark.registry import query
from agoraspark.views import table

MALE = ["mr", "sir", "lord", "viscount", "earl", "duke", "baron", "marquess", "the master of"]
FEMALE = ["mrs", "miss", "ms", "lady", "dame", "baroness", "viscountess", "countess", "duchess", "the hon lady"]
ARMY = ["major", "colonel", "captain", "general", "brigadier", "lieutenant", "sergeant", "field marshal", "wing commander", "squadron leader", "flight lieutenant", "air commodore"]
NAVY = ["admiral", "commander", "commodore"]
DOCTOR = ["dr", "doctor"]
#: Words of offices, which are no first names; and from which year a house, or a calling, is open to women.
ROLES = ["the", "prime", "minister", "speaker", "secretary", "treasurer", "president", "chancellor"]
OPEN = {"commons": 1918, "lords": 1958, "army": 1949, "navy": 1993, "doctor": 1965}


def letters(text: Column) -> Column:
    """Lower case, letters and single blanks alone."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z ]", " "), r"\s+", " "))


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether a text of letters has one of the words as a word, or one of the phrases anywhere in it."""
    plain, phrases = [w for w in words if " " not in w], [w for w in words if " " in w]
    one = F.arrays_overlap(F.split(text, " "), F.array(*[F.lit(w) for w in plain] or [F.lit("")]))
    return F.coalesce(reduce(lambda a, p: a | F.contains(text, F.lit(p)), phrases, one), F.lit(False))


def first_name(speaker: Column) -> Column:
    """The first name in a speaker, if there is one: not of a surname alone, nor of initials and a surname."""
    words = F.filter(F.split(F.regexp_replace(F.lower(speaker), r"[^a-z.\s]", " "), r"\s+"), lambda w: F.trim(w, F.lit(".")) != "")
    words = F.transform(words, lambda w: F.trim(w, F.lit(".")))
    skip = [w for w in MALE + FEMALE + ARMY + NAVY + DOCTOR if " " not in w] + ROLES
    words = F.filter(words, lambda w: ~w.isin(skip))
    initials = F.forall(F.slice(words, 1, F.size(words) - 1), lambda w: F.length(w) == 1)
    found = F.filter(words, lambda w: (F.length(w) > 1) & w.rlike("^[a-z]+$"))
    return F.when((F.size(words) > 1) & ~initials, F.try_element_at(found, F.lit(1)))


def first_of(*steps: tuple[Column, str]) -> Column:
    """(gender, source) of the first step with M or F; nulls if there is none."""
    told = [F.when(g.isin("M", "F"), F.struct(g.alias("gender"), F.lit(s).alias("source"))) for g, s in steps]
    return F.coalesce(*told, F.struct(F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("source")))


def _named(names: DataFrame, of: str, flag: str) -> DataFrame:
    """Distinct plain names of a list, with a flag."""
    return names.select(F.regexp_replace(letters(F.regexp_replace(F.lower(of), r"[^a-z\s]", "")), r"\s+", " ").alias("plain")).where("plain <> ''").distinct().withColumn(flag, F.lit(True))


def of_turns(turns: DataFrame, details: DataFrame, first_names: DataFrame) -> DataFrame:
    """turns (debate_id, speaker, chamber, year, ...) with gender and gender_source: by the debate's speaker details (debate_id,
    nth, original_name, gender), by house and year, by rank or calling and year, by honorific, by first name (first_name,
    gender). UNK where nothing tells."""
    last = F.max_by(F.when(F.col("gender") == "M", "M").otherwise("F"), "nth").alias("_by_details")
    known = details.where("trim(original_name) <> '' and gender <> ''").groupBy("debate_id", F.upper(F.trim("original_name")).alias("_own")).agg(last)
    guesses = first_names.select(F.lower("first_name").alias("_first"), F.col("gender").alias("_by_name")).dropDuplicates(["_first"])
    t = turns.withColumn("_own", F.upper(F.trim("speaker"))).join(known, ["debate_id", "_own"], "left")
    t = t.withColumn("_first", first_name(F.col("speaker"))).join(guesses, "_first", "left")
    plain, house, year = letters(F.col("speaker")), F.lower("chamber"), F.col("year")
    before = lambda what, test: F.when(test & (year < OPEN[what]), "M")
    calling = F.coalesce(before("army", holds_any(plain, ARMY)), before("navy", holds_any(plain, NAVY)), before("doctor", holds_any(plain, DOCTOR)))
    told = first_of(
        (F.col("_by_details"), "speaker_details"), (before("commons", F.contains(house, F.lit("commons"))), "chamber_cutoff"), (before("lords", F.contains(house, F.lit("lords"))), "chamber_cutoff"),
        (calling, "military_doctor"), (F.when(holds_any(plain, MALE), "M"), "honorific_male"), (F.when(holds_any(plain, FEMALE), "F"), "honorific_female"),
        (F.when(F.col("_by_name") == "M", "M"), "guesser_male"), (F.when(F.col("_by_name") == "F", "F"), "guesser_female"),
    )
    t = t.withColumn("_told", told)
    return t.select(*[f"`{c}`" for c in turns.columns], F.coalesce("_told.gender", F.lit("UNK")).alias("gender"), F.coalesce("_told.source", F.lit("UNK")).alias("gender_source"))


def of_members(members: DataFrame, wikidata: DataFrame, women: DataFrame, ladies: DataFrame, first_names: DataFrame) -> DataFrame:
    """members with gender_inferred and gender_source: what the register says, honorifics, those of the main name, the item's
    recorded gender (id_wikidata, gender), house and first year, lists of women (name) of either house by name or alias,
    first name.

    members: row_id, person_name, gender, honorific_prefix, main_prefix, id_wikidata, organization_id, start_year, aliases."""
    said = F.when(F.lower("gender").isin("male", "m"), "M").when(F.lower("gender").isin("female", "f"), "F")
    word = lambda c, ws: F.coalesce(F.arrays_overlap(F.split(F.lower(c), r"\s+"), F.array(*[F.lit(w) for w in ws])), F.lit(False))
    by = lambda c: F.when(word(c, FEMALE), "F").when(word(c, MALE), "M")  # noqa: E731  a row with both kinds is a woman's: the second pass overwrites
    both = F.concat_ws(" ", "honorific_prefix", "main_prefix")
    plain = lambda c: F.array_join(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z\s]", ""), r"\s+"), lambda w: w != ""), " ")
    called = members.select("row_id", F.explode(F.concat(F.array(F.struct(plain("person_name").alias("plain"), F.lit(False).alias("alias"))), F.coalesce(F.transform("aliases", lambda a: F.struct(plain(a).alias("plain"), F.lit(True).alias("alias"))), F.array().cast("array<struct<plain: string, alias: boolean>>")))).alias("x"))
    called = called.select("row_id", "x.plain", "x.alias").where("plain <> ''")
    listed = called.join(_named(women, "name", "woman"), "plain", "left").join(_named(ladies, "name", "lady"), "plain", "left").where("woman or lady")
    some = lambda flag, alias: F.max(F.coalesce(F.col(flag), F.lit(False)) & (F.col("alias") == alias)).alias(f"_{flag}_{'alias' if alias else 'name'}")
    listed = listed.groupBy("row_id").agg(*[some(f, a) for f in ("woman", "lady") for a in (False, True)])
    items = wikidata.groupBy("id_wikidata").agg(F.max("gender").alias("_by_item"))
    guesses = first_names.select(F.lower("first_name").alias("_first"), F.col("gender").alias("_by_name")).dropDuplicates(["_first"])
    m = members.join(items, "id_wikidata", "left").join(listed, "row_id", "left").withColumn("_first", F.lower(F.split_part("person_name", F.lit(" "), F.lit(1)))).join(guesses, "_first", "left")
    lords = F.col("organization_id") == "house-of-lords"
    rule = lambda house, year: F.when((F.col("organization_id") == f"house-of-{house}") & (F.col("start_year") < year), "M")
    told = first_of(
        (said, "everypolitician"), (by("honorific_prefix"), "HH honorific"), (by(both), "PP honorific"), (F.col("_by_item"), "wikidata_P21"),
        (rule("commons", OPEN["commons"]), "rule_pre1918_commons"), (rule("lords", OPEN["lords"]), "rule_pre1958_lords"),
        (F.when(F.col("_woman_alias"), "F"), "wikidata_curated_alias_mp"), (F.when(F.col("_woman_name"), "F"), "wikidata_curated_name_mp"),
        (F.when(lords & F.col("_lady_alias"), "F"), "wikidata_curated_alias_lord"), (F.when(lords & F.col("_lady_name"), "F"), "wikidata_curated_name_lord"),
        (F.col("_by_name"), "fname_inference"),
    )
    return m.withColumn("_told", told).select(*[f"`{c}`" for c in members.columns], F.col("_told.gender").alias("gender_inferred"), F.col("_told.source").alias("gender_source"))


FIRST_NAMES = [("Ann", "F"), ("Rosa", "F"), ("Otto", "M"), ("Captain", "M"), ("Small", None)]
_NAMES = "n(first, by_name) AS (VALUES ('ann', 'F'), ('rosa', 'F'), ('otto', 'M'))"
_HAS = lambda words: " OR ".join([f"len(list_intersect(string_split(plain, ' '), [{', '.join(repr(w) for w in words if ' ' not in w)}])) > 0", *[f"contains(plain, '{w}')" for w in words if " " in w]])


@query(cascade.TABLES + rf""", {_NAMES},
t AS (SELECT mention_id, speaker, coalesce(chamber, 'House of Commons') AS chamber, date_part('year', date) AS year, mention_id // 10 AS debate_id FROM m),
d AS (SELECT nth // 10 AS debate_id, upper('Mr. ' || person_name) AS own, CASE WHEN gender = 'M' THEN 'M' ELSE 'F' END AS by_details FROM r WHERE nth % 3 = 0 AND gender IS NOT NULL),
w AS (SELECT t.*, by_details, trim(regexp_replace(regexp_replace(lower(speaker), '[^a-z ]', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
  list_filter(list_transform(string_split_regex(regexp_replace(lower(speaker), '[^a-z.\s]', ' ', 'g'), '\s+'), lambda w: trim(w, '.')),
    lambda w: w <> '' AND w NOT IN ({', '.join(repr(x) for x in [w for w in MALE + FEMALE + ARMY + NAVY + DOCTOR if ' ' not in w] + ROLES)})) AS ws FROM t LEFT JOIN d ON t.debate_id = d.debate_id AND upper(trim(speaker)) = own),
f AS (SELECT *, CASE WHEN len(ws) > 1 AND len(list_filter(ws[:len(ws) - 1], lambda w: length(w) > 1)) > 0 THEN list_filter(ws, lambda w: length(w) > 1)[1] END AS first FROM w),
g AS (SELECT mention_id, CASE WHEN by_details IS NOT NULL THEN by_details || ',speaker_details' WHEN contains(lower(chamber), 'commons') AND year < 1918 OR contains(lower(chamber), 'lords') AND year < 1958 THEN 'M,chamber_cutoff'
  WHEN ({_HAS(ARMY)}) AND year < 1949 OR ({_HAS(NAVY)}) AND year < 1993 OR ({_HAS(DOCTOR)}) AND year < 1965 THEN 'M,military_doctor' WHEN {_HAS(MALE)} THEN 'M,honorific_male' WHEN {_HAS(FEMALE)} THEN 'F,honorific_female'
  WHEN by_name = 'M' THEN 'M,guesser_male' WHEN by_name = 'F' THEN 'F,guesser_female' ELSE 'UNK,UNK' END AS told FROM f LEFT JOIN n USING (first))
SELECT mention_id, split_part(told, ',', 1) AS gender, split_part(told, ',', 2) AS gender_source FROM g""")
def gender_waterfall_turn(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions as turns; every third person of the register is among the details of the debate of its number."""
    m, r = cascade.written(spark, sf)
    turns = m.select("mention_id", "speaker", F.coalesce("chamber", F.lit("House of Commons")).alias("chamber"), F.year("date").alias("year"), F.floor(F.col("mention_id") / 10).alias("debate_id"))
    details = r.where("nth % 3 = 0").select(F.floor(F.col("nth") / 10).alias("debate_id"), "nth", F.concat(F.lit("Mr. "), "person_name").alias("original_name"), "gender")
    return of_turns(turns, details, spark.createDataFrame(FIRST_NAMES, "first_name string, gender string")).select("mention_id", "gender", "gender_source")


@query(cascade.TABLES + f""", {_NAMES},
k AS (SELECT *, ['Sir', 'Mrs', 'The Rt Hon', NULL][nth % 4 + 1] AS own, CASE WHEN nth % 5 = 0 THEN 'Baroness' END AS main, split_part(lower(person_name), ' ', 1) AS first FROM r),
g AS (SELECT nth, CASE WHEN nth % 11 = 0 AND gender IS NOT NULL THEN gender || ',everypolitician' WHEN own = 'Mrs' THEN 'F,HH honorific' WHEN own = 'Sir' THEN 'M,HH honorific' WHEN main IS NOT NULL THEN 'F,PP honorific'
  WHEN nth % 7 = 0 THEN 'F,wikidata_P21' WHEN chamber = 'Lords' AND start_year < 1958 THEN 'M,rule_pre1958_lords' WHEN nth % 13 = 1 THEN 'F,wikidata_curated_alias_mp'
  WHEN person_name IN (SELECT person_name FROM r WHERE nth % 6 = 0) THEN 'F,wikidata_curated_name_mp' WHEN chamber = 'Lords' AND nth % 2 = 1 THEN 'F,wikidata_curated_alias_lord' WHEN by_name IS NOT NULL THEN by_name || ',fname_inference' END AS told FROM k LEFT JOIN n USING (first))
SELECT nth AS row_id, nullif(split_part(told, ',', 1), '') AS gender_inferred, nullif(split_part(told, ',', 2), '') AS gender_source FROM g""")
def gender_waterfall_member(spark: SparkSession, sf: str) -> DataFrame:
    """The register's rows, with lists made from it."""
    _, r = cascade.written(spark, sf)
    n = F.col("nth")
    one = lambda test, value: F.when(test, F.lit(value))
    alias = F.array(F.concat(F.lit("Peer "), F.col("person_name")), F.when(n % 13 == 1, "Mary, known as Mary!").when((n % 2 == 1), "The Lady of (This) House"))
    members = r.select(
        n.alias("row_id"), "person_name", F.when(n % 11 == 0, F.when(F.col("gender") == "M", "male").when(F.col("gender") == "F", "female")).alias("gender"),
        F.element_at(F.array(F.lit("Sir"), F.lit("Mrs"), F.lit("The Rt Hon"), F.lit(None)), (n % 4 + 1).cast("int")).alias("honorific_prefix"), one(n % 5 == 0, "Baroness").alias("main_prefix"),
        F.when(n % 7 == 0, F.concat(F.lit("Q"), n.cast("string"))).alias("id_wikidata"), F.concat(F.lit("house-of-"), F.lower("chamber")).alias("organization_id"), "start_year", alias.alias("aliases"),
    )
    items = members.where("id_wikidata is not null").select("id_wikidata", F.lit("F").alias("gender"))
    women = r.where("nth % 6 = 0").select(F.col("person_name").alias("name")).union(spark.createDataFrame([("MARY known as   mary",)], "name string"))
    ladies = spark.createDataFrame([("The Lady of This House",)], "name string")
    told = of_members(members, items, women, ladies, spark.createDataFrame(FIRST_NAMES, "first_name string, gender string"))
    return told.select("row_id", "gender_inferred", "gender_source")


def aliases(given: Column, family: Column, added: Column, surname: Column, prefix: Column, lord: Column, of: Column) -> Column:
    """All names that one may go by: given and family name, with initials together, apart and the first alone; other names;
    the peerage's forms. Each once; what a form lacks makes it null, and nulls go."""
    has = lambda c: F.nullif(c, F.lit(""))
    given, family, added, surname, prefix, lord, of = map(has, (given, family, added, surname, prefix, lord, of))
    letters_ = F.transform(F.filter(F.split(given, r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1))
    first = has(F.array_join(letters_, ""))
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    forms = [
        join(given, " ", family), join(first, " ", family), join(has(F.array_join(letters_, " ")), " ", family), join(F.substring(first, 1, 1), " ", family), F.when(family.isNull(), given), F.when(given.isNull(), family), added, surname,
        join(prefix, " ", lord), join(prefix, " ", lord, " of ", of), join(lord, " of ", of), join(prefix, " of ", of), join(prefix, " ", of),
    ]
    return F.array_distinct(F.filter(F.transform(F.array(*forms), lambda f: has(F.trim(f))), lambda f: f.isNotNull()))


@query("""WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) AS f, CASE WHEN p_partkey % 3 = 0 THEN 'Lord' END AS x, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS l, CASE WHEN p_partkey % 5 < 2 THEN p_type END AS o FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([g || ' Ann ' || f, g[1] || 'A ' || f, g[1] || ' A ' || f, g[1] || ' ' || f, x || ' ' || l, x || ' ' || l || ' of ' || o, l || ' of ' || o, x || ' of ' || o, x || ' ' || o], lambda v: v IS NOT NULL))), ',') AS aliases FROM p""")
def fn_alias_generate(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    given, family = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" Ann")), F.split_part("p_name", F.lit(" "), F.lit(2))
    forms = aliases(given, family, none, none, F.when(k % 3 == 0, "Lord"), F.when(k % 2 == 0, F.col("p_brand")), F.when(k % 5 < 2, F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(forms), ",").alias("aliases"))


@query(cascade.TABLES + rf"""SELECT mention_id, coalesce(regexp_matches(lower(speaker), '{"|".join(x.replace(".", "[.]") for x in cascade.OFFICERS)}'), false) AS procedural FROM m""")
def fn_is_procedural(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a speaker is an officer of the house, or several members."""
    m, _ = cascade.written(spark, sf)
    return m.select("mention_id", F.coalesce(cascade.is_officer(F.lower("speaker")), F.lit(False)).alias("procedural"))


@query(cascade.TABLES + rf"""SELECT mention_id, coalesce({_HAS(ARMY + NAVY + DOCTOR + FEMALE)}, false) AS has_honorific FROM (SELECT mention_id, trim(regexp_replace(regexp_replace(lower(speaker), '[^a-z ]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM m)""")
def fn_contains_any_honorific(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = cascade.written(spark, sf)
    return m.select("mention_id", holds_any(letters(F.col("speaker")), ARMY + NAVY + DOCTOR + FEMALE).alias("has_honorific"))
