"""The operators' results in DuckDB SQL, where SQL can express them. The others are tested against brute force."""

from __future__ import annotations

from agoraspark.llm.url_filters import RULES

#: At depths 1 and 2 (50 words or more), 3, and 4, 8, ...: the positions whose next lines occur earlier, and where first.
OP1 = r"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text <> ''),
n AS (SELECT doc_id, pos, line, md5(line) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, lead(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS more FROM x),
a AS (SELECT doc_id, list(h ORDER BY pos) AS hs, count(*) AS n FROM n GROUP BY doc_id),
e AS (SELECT unnest([1, 2, 3] || list_transform(range(2, 20), lambda k: (2 ** k)::BIGINT)) AS depth),
g AS (SELECT n.doc_id, pos, depth, md5(array_to_string(hs[pos:pos + depth - 1], ' ')) AS name FROM n JOIN a USING (doc_id) JOIN e ON pos + depth - 1 <= n
  WHERE depth >= 3 OR words + CASE WHEN depth = 2 THEN more ELSE 0 END >= 50),
f AS (SELECT *, first(doc_id) OVER w AS d1, first(pos) OVER w AS p1 FROM g WINDOW w AS (PARTITION BY depth, name ORDER BY doc_id, pos)),
b AS (SELECT doc_id, pos, max(depth) AS depth, arg_max(d1, depth) AS d1, arg_max(p1, depth) - pos AS shift FROM f WHERE d1 <> doc_id OR p1 <> pos GROUP BY doc_id, pos),
o AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(depth) OVER w = depth AND lag(d1) OVER w = d1 AND lag(shift) OVER w = shift THEN 0 ELSE 1 END AS opens FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
q AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM o),
u AS (SELECT doc_id, min(pos) AS low, max(pos) + any_value(depth) AS high FROM q GROUP BY doc_id, run),
v AS (SELECT *, max(high) OVER (PARTITION BY doc_id ORDER BY low, high DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
r AS (SELECT doc_id, low, high FROM v WHERE reach IS NULL OR high > reach),
c AS (SELECT doc_id, count(*) AS n_runs FROM r GROUP BY doc_id),
l AS (SELECT n.*, EXISTS (SELECT 1 FROM r WHERE r.doc_id = n.doc_id AND n.pos >= r.low AND n.pos < r.high) AS gone FROM n),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
md5(coalesce(kept, '')) AS kept_md5 FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)"""

OP2 = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
a AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM t), b AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS q FROM i),
m AS (SELECT doc_id, item_id, n, p - q AS d, q FROM a JOIN b USING (w)),
k AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, d ORDER BY q RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS hits FROM m),
c AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS x, list_sort(list(DISTINCT item_id)) AS l FROM k WHERE hits >= CASE WHEN n < 12 THEN n ELSE least(20, n) * 0.8 END GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(array_to_string(l, ','), '') AS items FROM documents LEFT JOIN c USING (doc_id)"""

#: The tree of shards: a row (lo, hi, i) draws source i's part of the left half; once all are drawn, both halves follow.
OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS own, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
v AS (SELECT *, [5, 2, 1][(nth - 1) % 3 + 1]::DOUBLE AS w FROM s),
l AS (SELECT *, (sum(own) OVER () - coalesce(sum(3 * own) OVER (ORDER BY 3 * own / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY 3 * own / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM v),
g AS (SELECT source, nth, own::BIGINT AS own, least(3 * own, w * (SELECT arg_min(lam, 3 * own / w) FROM l WHERE lam * w <= 3 * own)) AS target FROM l),
o AS (SELECT list(ceil(floor(target) / 4096)::DOUBLE ORDER BY nth) AS q FROM g),
t(lo, hi, i, q, got, rest, need) AS (
  SELECT 0, 8, 1, q, []::DOUBLE[], list_sum(q), round(list_sum(q) * 4 / 8) FROM o
  UNION ALL
  SELECT CASE WHEN c = 1 THEN mid ELSE lo END, CASE WHEN i > len(q) AND c = 0 THEN mid ELSE hi END, CASE WHEN i > len(q) THEN 1 ELSE i + 1 END, nq,
    CASE WHEN i > len(q) THEN [] ELSE list_append(got, k) END, CASE WHEN i > len(q) THEN list_sum(nq) ELSE rest - q[i] END,
    CASE WHEN i > len(q) THEN round(list_sum(nq) * ((CASE WHEN c = 1 THEN hi - mid ELSE mid - lo END + 1) // 2) / CASE WHEN c = 1 THEN hi - mid ELSE mid - lo END) ELSE need - k END
  FROM (SELECT *, CASE WHEN i <= len(q) THEN q WHEN c = 0 THEN got ELSE list_transform(range(1, len(q) + 1), lambda j: q[j] - got[j]) END AS nq,
      least(high, low + len(list_filter(range(1, len(ws) + 1), lambda j: list_sum(ws[1:j]) < u * list_sum(ws)))) AS k
    FROM (SELECT *, list_transform(range(low::BIGINT, high::BIGINT + 1), lambda x: coalesce(list_product(list_transform(range(low::BIGINT, x), lambda y: (a - y) * (need - y) / ((y + 1) * (b - need + y + 1)))), 1.0)) AS ws
      FROM (SELECT *, greatest(0.0, need - b, floor(mean - 12 * sd - 12)) AS low, greatest(greatest(0.0, need - b, floor(mean - 12 * sd - 12)), least(a, need, ceil(mean + 12 * sd + 12))) AS high
        FROM (SELECT *, need * a / greatest(a + b, 1.0) AS mean, sqrt(need * a / greatest(a + b, 1.0) * (1 - a / greatest(a + b, 1.0)) + 1) AS sd
          FROM (SELECT t.*, c, lo + (hi - lo + 1) // 2 AS mid, coalesce(q[i], 0.0) AS a, rest - coalesce(q[i], 0.0) AS b,
              (('0x' || substr(md5('17:' || lo || ':' || hi || ':' || (i - 1)), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u
            FROM t, (VALUES (0), (1)) x(c) WHERE hi - lo > 1 AND (c = 0 OR i > len(q)))))))),
e AS (SELECT lo AS shard, unnest(q) AS n, generate_subscripts(q, 1) AS nth FROM t WHERE hi - lo = 1),
f AS (SELECT shard, nth, sum(n) OVER (PARTITION BY nth ORDER BY shard)::BIGINT AS upto, n::BIGINT AS n FROM e),
h AS (SELECT g.*, shard, floor(target)::BIGINT AS goal, (floor(target)::BIGINT // greatest(own, 1)) * own AS whole,
  least(floor(target)::BIGINT, (upto - n) * 4096) AS low, least(floor(target)::BIGINT, upto * 4096) AS high FROM f JOIN g USING (nth)),
m AS (SELECT *, greatest(low, whole) - whole AS here FROM h),
r AS (SELECT source, shard, low, least(high, whole) AS high FROM m WHERE low < least(high, whole)
  UNION ALL SELECT source, shard, whole + here + gap, whole + here + gap + high - greatest(low, whole)
  FROM (SELECT *, least(own - (goal - whole), floor((own - (goal - whole))::DOUBLE * here::DOUBLE / greatest(goal - whole, 1)::DOUBLE)::BIGINT) AS gap FROM m) WHERE high > greatest(low, whole)),
p AS (SELECT d.*, own, target, sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5('17:' || doc_id), 1, 8), doc_id) - size AS begins FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
z AS (SELECT p.doc_id, r.shard, y.n AS pass, least(r.high, begins + y.n * own + size) - greatest(r.low, begins + y.n * own) AS words
  FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source JOIN (VALUES (0), (1), (2)) y(n) ON least(r.high, begins + y.n * own + size) > greatest(r.low, begins + y.n * own)),
k AS (SELECT doc_id, sum(words) AS taken, string_agg(shard || ':' || words::BIGINT, ',' ORDER BY pass, shard) AS shards FROM z GROUP BY doc_id)
SELECT doc_id, size, own AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(shards, '') AS shards FROM p LEFT JOIN k USING (doc_id)"""

_RULES = ", ".join(f"('{a}', '{h}', '{p}', '{h}{p}')" for a, h, p in RULES)
OP7 = rf"""
WITH r(action, host, begins, rule) AS (VALUES {_RULES}),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT page_id, u.host, path, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(path, begins))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM b WHERE k = 1"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5"""

OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS x
  FROM w WHERE len(ws) >= 5 UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM h a JOIN h b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
c(node, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.least FROM c JOIN e ON e.a = c.node),
g AS (SELECT node AS doc_id, min(least) AS component_id FROM c GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM g LEFT JOIN n USING (doc_id)"""

OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, v FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9),
c(node, least) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, c.least FROM c JOIN e ON e.a = c.node),
g AS (SELECT node AS vec_id, min(least) AS component_id FROM c GROUP BY node), n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM g LEFT JOIN n USING (vec_id)"""



def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of a decimal number, a bit at a time.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))"""


def _tree(name: str, nodes: str, levels: int = 5) -> str:
    """Tables name0 to name5 (tree, place, digest): the levels above nodes, up to 16**5 of them; a tree ends with one node."""
    out = [f"{name}0 AS ({nodes})"]
    for k in range(levels):
        many = f"(SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k})"
        out.append(f"{name}{k + 1} AS (SELECT tree, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {many} WHERE n > 1 GROUP BY 1, 2 UNION ALL SELECT tree, place, digest FROM {many} WHERE n = 1)")
        # A tree that has ended has neither siblings nor another hash: its node stands for itself.
        run = "PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
        out.append(f"{name}s{k} AS (SELECT tree, place, n > 1 AS up, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {many})")
    return ",\n".join(out)


def _paths(name: str, levels: int = 5) -> str:
    """name (tree, place, ups, befores, afters): each node's siblings, level by level."""
    cols = ", ".join(f"[{', '.join(f's{k}.{c}' for k in range(levels))}] AS {c}s" for c in ("up", "a", "b"))
    joins = " ".join(f"JOIN {name}s{k} s{k} ON s{k}.tree = s0.tree AND s{k}.place = CASE WHEN s{k}.up OR s{k - 1}.up THEN s{k - 1}.place // 16 ELSE s{k - 1}.place END" for k in range(1, levels))
    return f"{name}p AS (SELECT s0.tree, s0.place, {cols} FROM {name}s0 s0 {joins})"


_STEP = "lambda h, i: CASE WHEN ups[i::BIGINT] THEN sha256(befores[i::BIGINT] || h || afters[i::BIGINT]) ELSE h END"
OP12 = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS own, {_leaf("text")} AS leaf,
  CASE WHEN text IS NOT NULL AND xor({_CRC}, 4294967295) % 5 = 0 THEN {_leaf(_LOWER)} END AS changed FROM documents),
r AS (SELECT *, dense_rank() OVER (ORDER BY own) - 1 AS tree, row_number() OVER (PARTITION BY own ORDER BY doc_id, leaf) - 1 AS place FROM d),
{_tree("l", "SELECT tree, place, leaf AS digest FROM r")},
{_paths("l")},
{_tree("t", "SELECT 0 AS tree, tree AS place, digest FROM l5")},
{_paths("t")},
x AS (SELECT doc_id, leaf, changed, l5.digest AS subroot, t5.digest AS root, list_concat(lp.ups, tp.ups) AS ups, list_concat(lp."as", tp."as") AS befores, list_concat(lp.bs, tp.bs) AS afters
  FROM r JOIN lp USING (tree, place) JOIN l5 USING (tree) JOIN tp ON tp.place = r.tree JOIN t5 ON true),
y AS (SELECT *, array_to_string(list_transform(range(1, 11), lambda i: CASE WHEN ups[i] THEN befores[i] || afters[i] ELSE '' END), '') AS proof,
  list_reduce(list_concat([coalesce(changed, leaf)], list_transform(range(1, 11), lambda i: i::VARCHAR)), {_STEP}) AS folded_root FROM x)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM y"""

OP13 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM w),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY 1, 2),
x(i) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, o, step, n, good, toxic, fails[o[step]] AS hit, len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda v: v)) = 1 AS sole FROM g, o, (SELECT i AS step FROM x)),
t AS (SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step, o[step] AS filter,
  coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (hit AND sole), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM t"""
