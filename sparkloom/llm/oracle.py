"""DuckDB SQL for those of the operators' queries that SQL can express, over the same whole tables."""

from __future__ import annotations

#: Maximal runs of characters other than space and \x09 to \x0D.
WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def components(edges: str) -> str:
    """reach(node, other): every node of the links with all that it reaches."""
    return f"""link AS ({edges}), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
low AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)"""


JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
{components("SELECT a, b FROM p WHERE 100 * o >= 85 * (n + m - o)")}
SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN low ON node = doc_id"""

FOREST = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0),
{components("SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.95")},
n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM v LEFT JOIN low ON node = vec_id LEFT JOIN n ON n.a = vec_id"""

FMINDEX = f"""WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT x, min(doc_id) AS first FROM k GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k JOIN f USING (x) WHERE doc_id > first),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

TOPK = """WITH v AS (SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""

AUDIT = rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER)
+ 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY text) AS INTEGER) AS m FROM (SELECT *, {WORDS.format(text="text")} AS w FROM t)),
l AS (SELECT doc_id, max(coalesce(quality = 1, FALSE)) AS good, max(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
b AS (SELECT unnest(range(0, 5)) AS b),
o AS (SELECT [p.b, q.b, r.b, s.b, t.b] AS o FROM b p, b q, b r, b s, b t WHERE len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
k AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
z AS (SELECT list_aggregate(list_transform(o, lambda x: chr(CAST(65 + x AS INTEGER))), 'string_agg', '') AS filter_order, step, CAST(1 << o[step] AS INTEGER) AS bit, CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0) AS INTEGER) AS before FROM k),
a AS (SELECT part, filter_order, any_value(z.bit) AS bit, CAST(step AS INTEGER) AS step, coalesce(sum(n) FILTER (m & (z.bit | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (m & z.bit <> 0 AND m & before = 0), 0) AS removed,
coalesce(sum(n) FILTER (m & z.bit <> 0 AND m & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (m = z.bit), 0) AS unique_fails,
coalesce(sum(g) FILTER (m & z.bit <> 0 AND m & before = 0), 0) AS good_lost, coalesce(sum(x) FILTER (m & z.bit <> 0 AND m & before = 0), 0) AS toxic_lost FROM c, z GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM a"""

#: CRC-32 of a decimal number, bit by bit over its digits.
CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({n}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT))"

TRIE = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, {CRC.format(n="CAST(c AS VARCHAR)")} % 4 AS h, c - c % 20 AS b FROM t GROUP BY c),
i AS (SELECT a.c, a.h, a.b, least(a.h, coalesce(z.n, 0)) AS m FROM n a LEFT JOIN n z ON a.b = z.c),
u AS (SELECT i.c, t.p AS d, t.r, t.x FROM i JOIN t ON t.c = i.b AND t.p <= i.m UNION ALL SELECT i.c, t.p - i.h + i.m, t.r, t.x FROM i JOIN t ON t.c = i.c AND t.p > i.h),
k AS (SELECT c, d, x, list({{'r': r, 'x': x}}) OVER (PARTITION BY c ORDER BY d) AS path FROM u),
v AS (SELECT c, d, x, min(c) OVER (PARTITION BY d, path) AS v FROM k),
g AS (SELECT v, d, count(*) AS n, any_value(len({WORDS.format(text="x")})) AS w FROM v GROUP BY v, d),
up AS (SELECT g.v, g.d, CASE WHEN g.d = 1 THEN (SELECT min(c) FROM n) ELSE p.v END AS pv FROM g LEFT JOIN v p ON p.c = g.v AND p.d = g.d - 1),
kids AS (SELECT pv AS v, d - 1 AS d, count(*) AS kids FROM up GROUP BY 1, 2),
own AS (SELECT g.v, g.d, (g.n - 1) * g.w AS saved, CASE WHEN kids IS NULL THEN 1 ELSE 0 END AS leaf FROM g LEFT JOIN kids USING (v, d)),
sub AS (SELECT a.v, a.d, sum(own.saved) AS saved, sum(own.leaf) AS leaves FROM own JOIN v a ON a.c = own.v AND a.d <= own.d GROUP BY a.v, a.d),
l AS (SELECT n.c, coalesce(max(d), 0) AS d FROM n LEFT JOIN v USING (c) GROUP BY n.c),
ends AS (SELECT CASE WHEN l.d = 0 THEN (SELECT min(c) FROM n) ELSE v.v END AS v, l.d, string_agg(CAST(l.c AS VARCHAR), ',' ORDER BY l.c) AS ids FROM l LEFT JOIN v ON v.c = l.c AND v.d = l.d GROUP BY 1, 2),
nodes AS (SELECT g.v, g.d, up.pv, g.n, coalesce(kids, 0) AS kids, sub.leaves, sub.saved FROM g JOIN up USING (v, d) LEFT JOIN kids USING (v, d) JOIN sub USING (v, d)
UNION ALL SELECT min(c), 0, NULL, count(*), (SELECT count(*) FROM g WHERE d = 1), greatest(1, (SELECT coalesce(sum(leaf), 0) FROM own)), (SELECT coalesce(sum(saved), 0) FROM own) FROM n HAVING count(*) > 0)
SELECT v AS conv_id, d AS depth, pv AS parent_conv_id, n AS n_convs, CAST(kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM nodes LEFT JOIN ends USING (v, d)"""

SQL = {"op1_jaccard": JACCARD, "op3_forest": FOREST, "op4_fmindex": FMINDEX, "op8_topk": TOPK, "op11_audit": AUDIT, "op13_trie": TRIE}
