"""Full-text search over a stored, positional inverted index: phrases, prefixes, NEAR, NOT, columns, ranking and snippets.

The index is three tables in one folder. Postings (term, doc, places) are sorted by term and document and dealt by ranges of
both, so that a term's rows stand together and a common term's are spread; `files` holds the first and last term of every
file, so that a query opens only files that may hold its terms and the reader skips row groups in them. `terms` has the
documents of each term, `lengths` the words of each document.

A query is one scan of its terms' postings and one aggregation by document; phrases, NEAR and the boolean operators are
expressions over that document's places. If a term that every result must hold is rare, by its stored count, the other
terms' postings are cut to its documents before the shuffle.

Edge cases: null texts have no words; a word is a run of letters and digits, compared in lower case without accents; a
phrase without words is left out of its expression; a query without words finds nothing; a malformed query raises
ValueError; documents need an id of their own; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.registry import query
from agoraspark.session import new_folder
from agoraspark.views import table

#: What a word is made of, and a place's room for each column: column * COLUMN + the word's number in it.
WORD, COLUMN = r"[\p{L}\p{N}]+", 1 << 40
#: The documents of a rare term that are broadcast, at most.
RARE = 500_000
#: Latin letters with marks, and the letters without.
_MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
_FOLD = ("".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
#: The letters outside ASCII that stand for a letter, by it.
_WRITTEN = {}
for _c in map(chr, range(0x80, 0x3000)):
    if (_plain := _c.lower()[0].translate(str.maketrans(*_FOLD))).isascii():
        _WRITTEN[_plain] = _WRITTEN.get(_plain, "") + _c


def words_of(text: Column) -> Column:
    """The words of a text, lower case and without accents, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0), lambda w: F.translate(F.lower(w), *_FOLD))


def _words(text: str) -> list[str]:
    """The same in Python, for queries."""
    return [w.lower().translate(str.maketrans(*_FOLD)) for w in re.findall(r"[^\W_]+", text)]


def build(docs: DataFrame, folder: str, key: str = "doc_id", columns: tuple[str, ...] = ("text",), files: int | None = None) -> str:
    """Writes the index of docs. files: into how many, if not as many as the session's shuffles have partitions."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{key}`").alias("doc"), *[words_of(F.col(f"`{c}`")).alias(f"w{i}") for i, c in enumerate(columns)])
    own.select("doc", sum((F.size(f"w{i}") for i in range(len(columns))), F.lit(0)).alias("words")).write.parquet(f"{folder}/lengths")
    each = reduce(DataFrame.unionByName, [own.select("doc", F.posexplode(f"w{i}").alias("n", "term")).withColumn("place", F.col("n") + F.lit(i * COLUMN)) for i in range(len(columns))])
    postings = each.groupBy("term", "doc").agg(F.sort_array(F.collect_list("place")).alias("places"))
    by = ["term", "doc"]
    postings = postings.repartitionByRange(files, *by) if files else postings.repartitionByRange(*by)
    postings.sortWithinPartitions(*by).write.parquet(f"{folder}/postings")
    kept = spark.read.parquet(f"{folder}/postings")
    kept.select(F.input_file_name().alias("file"), "term").groupBy("file").agg(F.min("term").alias("first"), F.max("term").alias("last")).write.parquet(f"{folder}/files")
    kept.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    return folder


@dataclass(frozen=True)
class Phrase:
    """Words in a row; the last may be a prefix; first: at a column's beginning; columns: None is all."""

    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: frozenset[int] | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    within: int


@dataclass(frozen=True)
class Both:
    """kind: AND, OR, NOT."""

    kind: str
    left: object
    right: object


def parse(text: str, columns: tuple[str, ...] = ("text",)) -> object | None:
    """A query as a tree. Words side by side must all be there and bind closest, then NOT, AND, OR; "one two" and one + two are
    phrases, one* a prefix, ^one stands first in its column, NEAR(one two, 5), title : one, {title text} : one, - title : one."""
    marks = re.findall(r'"(?:[^"]|"")*"|[\w\x80-\U0010ffff]+|[(){}:,+*^-]|\S', text)
    at = 0

    def peek(ahead: int = 0) -> str:
        return marks[at + ahead] if at + ahead < len(marks) else ""

    def take(*expected: str) -> str:
        nonlocal at
        found = peek()
        if not found or (expected and found not in expected):
            raise ValueError(f"{' or '.join(expected) or 'more'} expected after {' '.join(marks[:at])!r}")
        at += 1
        return found

    def is_word(mark: str) -> bool:
        return bool(mark) and (mark[0] == '"' and len(mark) > 1 or bool(re.match(r"[\w\x80-\U0010ffff]", mark))) and mark not in ("AND", "OR", "NOT")

    def binary(kinds: tuple[str, ...]) -> object | None:
        if not kinds:
            return unit()
        left = binary(kinds[1:])
        while peek() == kinds[0]:
            take()
            right = binary(kinds[1:])
            left = Both(kinds[0], left, right) if left and right else (left or (right if kinds[0] != "NOT" else None))
        return left

    def column_set() -> frozenset[int] | None:
        nonlocal at
        begin, minus = at, peek() == "-"
        at += minus
        names = []
        if peek() == "{":
            take()
            while peek() != "}":
                names.append(take())
            take()
        elif is_word(peek()):
            names.append(take())
        if not names or peek() != ":":
            at = begin
            return None
        take()
        known = {c.lower(): i for i, c in enumerate(columns)}
        plain = [n.strip('"').lower() for n in names]
        if missing := [n for n in plain if n not in known]:
            raise ValueError(f"no such column: {missing[0]}")
        found = {known[n] for n in plain}
        return frozenset(set(range(len(columns))) - found if minus else found)

    def phrase(only: frozenset[int] | None) -> Phrase | None:
        first, got = peek() == "^" and bool(take()), []
        while True:
            mark = take()
            if not is_word(mark):
                raise ValueError(f"a word expected, not {mark!r}")
            got += _words(mark[1:-1].replace('""', '"') if mark[0] == '"' else mark)
            star = peek() == "*" and bool(take())
            if peek() != "+" or star:
                break
            take()
        return Phrase(tuple(got), bool(star and got), first, only) if got else None

    def near(only: frozenset[int] | None) -> object | None:
        if not (peek() == "NEAR" and peek(1) == "("):
            return phrase(only)
        take(), take()
        parts, within = [], 10
        while peek() not in (",", ")"):
            parts.append(phrase(only))
        if take(",", ")") == ",":
            number = take()
            if not number.isdigit():
                raise ValueError(f"a number expected, not {number!r}")
            within = int(number)
            take(")")
        parts = [p for p in parts if p]
        return Near(tuple(parts), within) if len(parts) > 1 else (parts[0] if parts else None)

    def unit() -> object | None:
        only = column_set()
        if peek() == "(":
            take()
            inner = binary(("OR", "AND", "NOT"))
            take(")")
            return limited(inner, only)
        found = near(only)
        while is_word(peek()) or peek() in ("^", "{", "-"):
            right = near(column_set())
            found = Both("AND", found, right) if found and right else found or right
        return found

    if not marks:
        return None
    tree = binary(("OR", "AND", "NOT"))
    if at < len(marks):
        raise ValueError(f"{marks[at]!r} unexpected after {' '.join(marks[:at])!r}")
    return tree


def limited(node: object, only: frozenset[int] | None) -> object:
    """The tree with its phrases kept to columns."""
    if only is None or node is None:
        return node
    if isinstance(node, Both):
        return Both(node.kind, limited(node.left, only), limited(node.right, only))
    if isinstance(node, Near):
        return Near(tuple(limited(p, only) for p in node.phrases), node.within)
    return Phrase(node.words, node.prefix, node.first, only if node.columns is None else node.columns & only)


def phrases(node: object) -> list[Phrase]:
    if isinstance(node, Both):
        return [*phrases(node.left), *phrases(node.right)]
    return list(node.phrases) if isinstance(node, Near) else [node]


def required(node: object) -> set[str]:
    """Whole words that every result holds."""
    if isinstance(node, Both):
        left, right = required(node.left), required(node.right)
        return left | right if node.kind == "AND" else left if node.kind == "NOT" else left & right
    return {w for p in phrases(node) for w in (p.words[:-1] if p.prefix else p.words)}


def _slots(node: object) -> list[tuple[str, bool]]:
    """(word, is it a prefix) of all phrases, each once."""
    return list(dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in phrases(node) for i, w in enumerate(p.words)))


def _hit(slot: tuple[str, bool]) -> Column:
    """Whether a posting's term is the slot's; a condition on `term` that the reader can skip by."""
    word, prefix = slot
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def _starts(phrase: Phrase, slots: list[tuple[str, bool]]) -> Column:
    """The places where a phrase begins: those that all its words have, each moved back by its place in the phrase."""
    moved = []
    for i, w in enumerate(phrase.words):
        own = F.col(f"s{slots.index((w, phrase.prefix and i == len(phrase.words) - 1))}")
        moved.append(F.transform(own, lambda p: p - i) if i else own)
    found = reduce(F.array_intersect, moved) if len(moved) > 1 else F.array_distinct(moved[0])
    if phrase.first:
        found = F.filter(found, lambda p: p % COLUMN == 0)
    if phrase.columns is not None:
        found = F.filter(found, lambda p: F.floor(p / COLUMN).isin(*phrase.columns)) if phrase.columns else F.filter(found, lambda p: F.lit(False))
    return found


def _holds(node: object, names: dict[Phrase, str]) -> Column:
    if isinstance(node, Both):
        left, right = _holds(node.left, names), _holds(node.right, names)
        return left & right if node.kind == "AND" else left | right if node.kind == "OR" else left & ~right
    if isinstance(node, Near):
        # The phrase that begins last, and every other one no more than so many words before it.
        starts = [F.col(names[p]) for p in node.phrases]
        def close(m: Column) -> Column:
            each = [F.exists(s, lambda x: x.between(m - len(p.words) - node.within, m)) for s, p in zip(starts, node.phrases, strict=True)]
            return reduce(lambda a, b: a & b, each)
        return reduce(lambda a, b: a | b, [F.exists(s, close) for s in starts])
    return F.size(names[node]) > 0


def _counted(node: object, names: dict[Phrase, str], given: Column) -> list[tuple[Phrase, Column]]:
    """The phrases of the tree that count for a document, and when: those in parts that hold there. What must not be there
    never counts; a phrase that stands twice in the query counts twice."""
    if isinstance(node, Both):
        if node.kind == "NOT":
            return _counted(node.left, names, given)
        sides = (node.left, node.right)
        return [x for n in sides for x in _counted(n, names, given & _holds(n, names) if node.kind == "OR" else given)]
    return [(p, given) for p in phrases(node)]


def postings_of(spark: SparkSession, folder: str, slots: list[tuple[str, bool]]) -> DataFrame:
    """The postings of the slots' terms, from the files that may hold them."""
    may = [(F.col("last") >= w) & ((F.col("first") <= w) | (F.col("first").startswith(w) if prefix else F.lit(False))) for w, prefix in slots]
    files = [r["file"] for r in spark.read.parquet(f"{folder}/files").where(reduce(lambda a, b: a | b, may)).select("file").collect()]
    kind = spark.read.parquet(f"{folder}/lengths").schema["doc"].dataType.simpleString()
    schema = f"term string, doc {kind}, places array<bigint>"
    read = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return read.where(reduce(lambda a, b: a | b, [_hit(s) for s in slots]))


def match(spark: SparkSession, folder: str, text: str, columns: tuple[str, ...] = ("text",), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score, places) of the documents that a query finds. score: bm25 over the query's phrases, higher is better; the
    weight of a phrase is ln((n - df + 0.5) / (df + 0.5)), at least 1e-6. places: (start, size, phrase) of occurrences."""
    tree = parse(text, columns)
    lengths = spark.read.parquet(f"{folder}/lengths")
    kind = lengths.schema["doc"].dataType.simpleString()
    if tree is None:
        return spark.createDataFrame([], f"doc {kind}, score double, places array<struct<start: bigint, size: int, phrase: int>>")
    slots, own = _slots(tree), list(dict.fromkeys(phrases(tree)))
    names = {p: f"p{i}" for i, p in enumerate(own)}
    hits = postings_of(spark, folder, slots)
    counts = spark.read.parquet(f"{folder}/terms").where(F.col("term").isin([w for w, _ in slots]))
    df = {r["term"]: r["df"] for r in counts.collect()}  # a row a word of the query

    def by_document(rows: DataFrame) -> DataFrame:
        each = [F.flatten(F.collect_list(F.when(_hit(s), F.col("places")))).alias(f"s{i}") for i, s in enumerate(slots)]
        return rows.groupBy("doc").agg(*each).select("doc", *[_starts(p, slots).alias(names[p]) for p in own])

    must = sorted((df.get(w, 0), w) for w in required(tree))
    rest = hits
    if must and must[0][0] <= RARE and len(slots) > 1:
        rare = postings_of(spark, folder, [(must[0][1], False)]).select("doc")
        rest = hits.join(F.broadcast(rare), "doc", "left_semi")
    # A single whole word's documents are counted in the index; those of other phrases are counted here, over all documents.
    dfs = {p: df.get(p.words[0], 0) for p in own if len(p.words) == 1 and not (p.prefix or p.first or p.columns is not None)}
    if more := [p for p in own if p not in dfs]:
        found = by_document(hits).agg(*[F.sum((F.size(names[p]) > 0).cast("long")).alias(names[p]) for p in more]).first()
        dfs |= {p: found[names[p]] or 0 for p in more}
    n, mean = lengths.agg(F.count("*"), F.avg("words")).first()
    score, spots = F.lit(0.0), []
    for p, given in _counted(tree, names, F.lit(True)):
        weight = F.greatest(F.log((F.lit(float(n)) - dfs[p] + 0.5) / (dfs[p] + 0.5)), F.lit(1e-6))
        tf = F.when(given, F.size(names[p])).otherwise(0)
        score = score + weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("words") / F.lit(mean or 1.0)))
        spot = F.transform(names[p], lambda x: F.struct(x.cast("long").alias("start"), F.lit(len(p.words)).alias("size"), F.lit(own.index(p)).alias("phrase")))
        spots.append(F.when(given, spot).otherwise(F.slice(spot, 1, 0)))
    found = by_document(rest).where(_holds(tree, names)).join(lengths, "doc")
    return found.select("doc", score.alias("score"), F.array_distinct(F.concat(*spots)).alias("places"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row, however often it stands in the functions over arrays."""
    return F.element_at(F.transform(F.array(value), use), 1)


def snippet(text: Column, places: Column, size: int = 30, marks: tuple[str, str, str] = ("<mark>", "</mark>", "...")) -> Column:
    """The `size` words of a text that hold most different phrases, the earliest of equals, each occurrence marked, with dots
    where the text is cut. places: (start, size, phrase) of occurrences in the text.

    A window that is the earliest of equals begins the text or ends with an occurrence's last word, so one pass over the
    occurrences by their ends, with the last start seen of each phrase, finds it."""
    parts = F.regexp_extract_all(text, F.lit(rf"[^\p{{L}}\p{{N}}]*{WORD}"), 0)
    tail = F.regexp_extract(text, r"([^\p{L}\p{N}]*)$", 1)
    n = F.size(parts)
    ends = F.array_sort(F.transform(places, lambda x: F.struct((x["start"] + x["size"]).alias("end"), x["start"].alias("start"), x["phrase"].alias("phrase"))))
    kinds = F.array_sort(F.array_distinct(F.transform(places, lambda x: x["phrase"])))
    zero = F.struct(F.lit(0).alias("most"), F.lit(0).cast("long").alias("begin"), F.transform(kinds, lambda k: F.lit(-1).cast("long")).alias("last"))

    def step(best: Column, x: Column) -> Column:
        last = F.transform(best["last"], lambda v, i: F.when(F.element_at(kinds, i + 1) == x["phrase"], F.greatest(v, x["start"])).otherwise(v))
        begin = F.greatest(x["end"] - size, F.lit(0).cast("long"))
        here = F.size(F.filter(last, lambda v: v >= begin))
        better = here > best["most"]
        return F.struct(F.when(better, here).otherwise(best["most"]).alias("most"), F.when(better, begin).otherwise(best["begin"]).alias("begin"), last.alias("last"))


    def window(begin: Column) -> Column:
        inside = F.filter(places, lambda x: (x["start"] >= begin) & (x["start"] + x["size"] <= begin + size))
        return once(inside, lambda x: written(begin, x))

    def written(begin: Column, inside: Column) -> Column:
        def shown(part: Column, i: Column) -> Column:
            at = begin + i
            word, gap = F.regexp_extract(part, f"({WORD})$", 1), F.regexp_extract(part, r"^([^\p{L}\p{N}]*)", 1)
            covers = lambda a: F.exists(inside, lambda x: (x["start"] < a) & (x["start"] + x["size"] > a))  # noqa: E731  an occurrence goes on over the border before word a
            opens = F.exists(inside, lambda x: x["start"] == at) & ~covers(at)
            closes = F.exists(inside, lambda x: x["start"] + x["size"] == at + 1) & ~covers(at + 1)
            return F.concat(
                F.when((i == 0) & (begin > 0), "").otherwise(gap), F.when(opens, marks[0]).otherwise(""), word, F.when(closes, marks[1]).otherwise("")
            )

        body = F.array_join(F.transform(F.slice(parts, begin + 1, size), shown), "")
        return F.concat(F.when(begin > 0, marks[2]).otherwise(""), body, F.when(begin + size < n, marks[2]).otherwise(tail))

    return once(F.aggregate(ends, zero, step)["begin"].cast("int"), window)


def _may_hold(node: object, texts: list[Column]) -> Column:
    """False only for rows that a query can't find, by the letters of its words. texts: by column."""
    if isinstance(node, Both):
        left, right = _may_hold(node.left, texts), _may_hold(node.right, texts)
        return left & right if node.kind == "AND" else left | right if node.kind == "OR" else left
    if isinstance(node, Near):
        return reduce(lambda a, b: a & b, [_may_hold(p, texts) for p in node.phrases])
    # Other letters than a to z are not asked for: in lower case some depend on the letters beside them.
    plain = [w for w in node.words if w.isascii()]
    held = lambda t: reduce(lambda a, b: a & b, [_letters(t, w) for w in plain], t.isNotNull())
    return reduce(lambda a, b: a | b, [held(t) for i, t in enumerate(texts) if node.columns is None or i in node.columns], F.lit(False))


def _letters(text: Column, word: str) -> Column:
    """Whether a text has a word's letters in a row, whatever their case and accents."""
    marked = "".join(f"[{c}{c.upper()}{_WRITTEN.get(c, '')}]" for c in word)
    return F.when(F.length(text) == F.octet_length(text), F.contains(F.lower(text), F.lit(word))).otherwise(text.rlike(marked))


def scan(docs: DataFrame, text: str, key: str = "doc_id", columns: tuple[str, ...] = ("text",), shown: str = "text") -> DataFrame:
    """(doc, snippet) of what a query finds in docs, without an index: for a single query over texts that are read anyway. One
    pass over the rows; only those with the letters of the query's words are taken apart into words."""
    tree, at = parse(text, columns), columns.index(shown)
    if tree is None:
        return docs.select(F.col(f"`{key}`").alias("doc"), F.lit("").alias("snippet")).where(F.lit(False))
    slots, own = _slots(tree), list(dict.fromkeys(phrases(tree)))
    names = {p: f"p{i}" for i, p in enumerate(own)}
    rows = docs.where(F.col(f"`{key}`").isNotNull() & _may_hold(tree, [F.col(f"`{c}`") for c in columns]))
    rows = rows.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{shown}`"), F.lit("")).alias("text"), *[words_of(F.col(f"`{c}`")).alias(f"w{i}") for i, c in enumerate(columns)])

    def places(slot: tuple[str, bool], i: int) -> Column:
        hit = lambda w: F.startswith(w, F.lit(slot[0])) if slot[1] else w == slot[0]
        at = F.transform(f"w{i}", lambda w, n: F.when(hit(w), n.cast("long") + i * COLUMN))
        return F.array_compact(at)

    rows = rows.select("doc", "text", *[F.concat(*[places(s, i) for i in range(len(columns))]).alias(f"s{k}") for k, s in enumerate(slots)])
    rows = rows.select("doc", "text", *[_starts(p, slots).alias(names[p]) for p in own])
    spots = []
    for p, given in _counted(tree, names, F.lit(True)):
        spot = F.transform(F.filter(names[p], lambda x: F.floor(x / COLUMN) == at), lambda x: F.struct((x % COLUMN).alias("start"), F.lit(len(p.words)).alias("size"), F.lit(own.index(p)).alias("phrase")))
        spots.append(F.when(given, spot).otherwise(F.slice(spot, 1, 0)))
    found = rows.where(_holds(tree, names)).select("doc", "text", F.array_distinct(F.concat(*spots)).alias("here"))
    return found.select("doc", snippet(F.col("text"), F.col("here")).alias("snippet"))


def search(docs: DataFrame, folder: str, text: str, key: str = "doc_id", columns: tuple[str, ...] = ("text",), shown: str = "text", top: int | None = None) -> DataFrame:
    """(doc, score, snippet) of what a query finds in docs, whose index is in folder; top: the best so many alone."""
    found = match(docs.sparkSession, folder, text, columns)
    found = found.orderBy(F.col("score").desc(), "doc").limit(top) if top else found
    at = columns.index(shown)
    texts = docs.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{shown}`"), F.lit("")).alias("text"))
    here = F.filter("places", lambda x: F.floor(x["start"] / COLUMN) == at)
    here = F.transform(here, lambda x: F.struct((x["start"] % COLUMN).alias("start"), x["size"].alias("size"), x["phrase"].alias("phrase")))
    return found.join(texts, "doc").select("doc", "score", snippet(F.col("text"), here).alias("snippet"))


#: One query of every kind, and SQL that says the same over T, L and S (a column's words, each between blanks) and t (the words).
QUERIES = {
    "the stupid en": "contains(A, ' the ') AND contains(A, ' stupid ') AND contains(A, ' en ')",
    '"of the"': "contains(T, ' of the ')",
    "is + that OR idiot*": "contains(T, ' is that ') OR contains(T, ' idiot')",
    "stup* NOT the": "(contains(T, ' stup') AND NOT contains(T, ' the '))",
    "(worthless OR clown) AND en NOT that": "(contains(A, ' worthless ') OR contains(A, ' clown ')) AND contains(A, ' en ') AND NOT contains(A, ' that ')",
    "NEAR(stupid the, 5)": "len(list_filter(range(1, len(t) + 1), lambda i: (t[i] = 'stupid' AND list_contains(t[greatest(i - 6, 1):i], 'the')) OR (t[i] = 'the' AND list_contains(t[greatest(i - 6, 1):i], 'stupid')))) > 0",
    "^the": "starts_with(T, ' the ')",
    "source : src1* NOT text : the": "contains(S, ' src1') AND NOT contains(T, ' the ')",
    "- text : en": "contains(L, ' en ') OR contains(S, ' en ')",
    "{lang source} : (en AND src3)": "(contains(L, ' en ') OR contains(S, ' en ')) AND (contains(L, ' src3 ') OR contains(S, ' src3 '))",
    "ÊTRÉ": "contains(A, ' etre ')",
}
COLUMNS = ("text", "lang", "source")
_WORDS = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
_SPACED = "' ' || array_to_string({}, ' ') || ' '"
_BOOLEAN = f"""WITH w AS (SELECT doc_id, {', '.join(f'{_WORDS.format(c)} AS {c[0]}' for c in COLUMNS)} FROM documents),
x AS (SELECT doc_id, t, {', '.join(f'{_SPACED.format(c[0])} AS {c[0].upper()}{c[0].upper()}' for c in COLUMNS)} FROM w),
y AS (SELECT doc_id, t AS words, TT, LL, SS, TT || LL || SS AS AA FROM x)
""" + " UNION ALL ".join(
    "SELECT '{}' AS query, doc_id FROM y WHERE {}".format(q.replace("'", "''"), re.sub(r"\bt\b(?=[\[)])", "words", re.sub(r"\b([ATLS])\b", r"\1\1", sql))) for q, sql in QUERIES.items()
)


def _indexed(spark: SparkSession, sf: str, columns: tuple[str, ...] = ("text",)) -> tuple[DataFrame, str]:
    docs = table(spark, sf, "documents")
    return docs, build(docs, new_folder(spark, "search"), columns=columns)


@query(_BOOLEAN)
def txt_fts_boolean(spark: SparkSession, sf: str) -> DataFrame:
    """What each query finds, over three columns, by the stored index alone."""
    _, folder = _indexed(spark, sf, COLUMNS)
    found = [match(spark, folder, q, COLUMNS).select(F.lit(q).alias("query"), F.col("doc").alias("doc_id")) for q in QUERIES]
    return reduce(DataFrame.unionByName, found)


@query(f"""WITH l AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents), z AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM l),
p AS (SELECT doc_id, len(list_filter(ws, lambda w: w = 'idiot')) AS t1, len(list_filter(ws, lambda w: w = 'the')) AS t2, len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'of' AND ws[i + 1] = 'the')) AS t3, len(ws) AS dl FROM l),
f AS (SELECT n, a, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2, count(*) FILTER (t3 > 0) AS d3 FROM p, z GROUP BY 1, 2)
SELECT doc_id, round({" + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in (1, 2, 3))}, 6) AS score
FROM p, f WHERE t1 > 0 AND (t2 > 0 OR t3 > 0) ORDER BY score DESC, doc_id LIMIT 20""")
def txt_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The best of a query's results, from the stored index."""
    _, folder = _indexed(spark, sf)
    found = match(spark, folder, 'idiot AND (the OR "of the")').select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))
    return found.orderBy(F.col("score").desc(), "doc_id").limit(20)


@query(rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+') AS parts, {_WORDS.format("text")} AS ws FROM documents),
h AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: ws[i] IN ('idiot', 'stupid', 'clown')) AS hits FROM w WHERE len(list_intersect(ws, ['idiot', 'stupid', 'clown'])) > 0),
c AS (SELECT doc_id, unnest(list_distinct(list_concat([1], list_transform(hits, lambda i: greatest(i - 29, 1))))) AS b, ws FROM h),
m AS (SELECT doc_id, arg_min(b, struct_pack(k := -len(list_intersect(ws[b:b + 29], ['idiot', 'stupid', 'clown'])), b := b)) AS b FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN b > 1 THEN '...' ELSE '' END || array_to_string(list_transform(range(b, least(b + 30, len(ws) + 1)), lambda i:
  CASE WHEN i = b AND b > 1 THEN '' ELSE regexp_extract(parts[i], '^[^\p{{L}}\p{{N}}]*') END
  || CASE WHEN list_contains(hits, i) THEN '<mark>' || regexp_extract(parts[i], '[\p{{L}}\p{{N}}]+$') || '</mark>' ELSE regexp_extract(parts[i], '[\p{{L}}\p{{N}}]+$') END), '')
  || CASE WHEN b + 30 <= len(ws) THEN '...' ELSE regexp_extract(text, '[^\p{{L}}\p{{N}}]*$') END AS snippet FROM h JOIN m USING (doc_id)""")
def fn_snippet_mark(spark: SparkSession, sf: str) -> DataFrame:
    """The best thirty words of every text that a query finds. One query reads the texts once; an index of all words is for many."""
    return scan(table(spark, sf, "documents"), "idiot OR stupid OR clown").select(F.col("doc").alias("doc_id"), "snippet")


@query(f"""SELECT w AS term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS places FROM (SELECT doc_id, unnest({_WORDS.format("text")}) AS w FROM documents) GROUP BY w""")
def sink_sqlite_fts(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index, read back: every term with its documents and places."""
    _, folder = _indexed(spark, sf)
    places = spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("places"))
    return spark.read.parquet(f"{folder}/terms").join(places, "term").select("term", "df", "places")
