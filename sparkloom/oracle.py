"""SQL for the oracle that takes several rounds: one common table expression per step, written out by small builders."""

from __future__ import annotations


def _with(parts: list[tuple[str, str]], last: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts) + "\n" + last


def robust(rounds: int, c: float = 1.345) -> str:
    parts = [
        ("d", "SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part"),
        ("b0", "SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d"),
    ]
    for k in range(1, rounds + 1):
        parts += [
            (f"r{k}", f"SELECT x, y, y - a - b * x AS r FROM d, b{k - 1}"),
            (f"m{k}", f"SELECT list_sort(list(r))[CAST(count(*) // 2 AS INTEGER) + 1] AS m FROM r{k}"),
            (f"s{k}", f"SELECT greatest(1.4826 * list_sort(list(abs(r - m)))[CAST(count(*) // 2 AS INTEGER) + 1], 1e-9) AS s FROM r{k}, m{k}"),
            (f"w{k}", f"SELECT x, y, CASE WHEN abs(r / s) <= {c} THEN 1 ELSE {c} / abs(r / s) END AS w FROM r{k}, s{k}"),
            (f"g{k}", f"SELECT sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w{k}"),
            (f"b{k}", f"SELECT b, my - b * mx AS a FROM (SELECT any_value(mx) AS mx, any_value(my) AS my, sum(w{k}.w * (x - mx) * (y - my)) / sum(w{k}.w * (x - mx) * (x - mx)) AS b FROM w{k}, g{k})"),
        ]
    return _with(parts, f"""SELECT round(any_value(a), 3) AS intercept, round(any_value(b), 3) AS b1,
round(1 - (var_pop(y) - 2 * any_value(b) * covar_pop(x, y) + any_value(b) * any_value(b) * var_pop(x)) / var_pop(y), 6) AS r_squared, count(*) AS n_samples FROM d, b{rounds}""")


#: Standardised length and quality of the labelled documents.
STANDARD = [
    ("j", "SELECT d.n_chars, CAST(l.quality AS DOUBLE) AS y FROM labels l JOIN documents d USING (doc_id)"),
    ("s", "SELECT (n_chars - (SELECT avg(n_chars) FROM j)) / (SELECT stddev_pop(n_chars) FROM j) AS x, y FROM j"),
]


def multilogistic(epochs: int, rate: float = 0.1) -> str:
    """Of two classes, whose weights stay opposite."""
    parts = [*STANDARD, ("g0", "SELECT CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b")]
    for k in range(1, epochs + 1):
        p = "1 / (1 + exp(-2 * (w * x + b))) - CASE WHEN y = 0 THEN 1 ELSE 0 END"
        parts.append((f"g{k}", f"SELECT any_value(w) - {rate} * avg(({p}) * x) AS w, any_value(b) - {rate} * avg({p}) AS b FROM s, g{k - 1}"))
    return _with(parts, f"SELECT CAST(0 AS DOUBLE) AS class, round(w, 6) AS b1, round(b, 6) AS intercept FROM g{epochs} UNION ALL SELECT 1, round(-w, 6), round(-b, 6) FROM g{epochs}")


def ordinal(epochs: int, rate: float = 0.1) -> str:
    """Three classes of sizes of parts by their price."""
    parts = [
        ("d", "SELECT p_retailprice / 1000 AS x, (p_size - 1) // 17 AS y FROM part"),
        ("c", "SELECT count(*) FILTER (y = 0) / count(*) AS a, count(*) FILTER (y <= 1) / count(*) AS b FROM d"),
        ("g0", "SELECT CAST(0 AS DOUBLE) AS w, ln(a / (1 - a)) AS f, ln(greatest(ln(b / (1 - b)) - ln(a / (1 - a)), 1e-3)) AS g FROM c"),
    ]
    for k in range(1, epochs + 1):
        parts += [
            (f"e{k}", f"SELECT x, y, w, f, g, 1 / (1 + exp(-(f - w * x))) AS a, 1 / (1 + exp(-(f + exp(g) - w * x))) AS b FROM d, g{k - 1}"),
            (f"l{k}", f"SELECT *, CASE y WHEN 0 THEN 0 WHEN 1 THEN a ELSE b END AS lo, CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE 1 END AS hi FROM e{k}"),
            (f"p{k}", f"SELECT *, lo * (1 - lo) / greatest(hi - lo, 1e-15) AS sl, hi * (1 - hi) / greatest(hi - lo, 1e-15) AS sh FROM l{k}"),
            (f"h{k}", f"SELECT any_value(w) AS w, any_value(f) AS f, any_value(g) AS g, avg((sh - sl) * x) AS gw, avg(CASE y WHEN 0 THEN -sh WHEN 1 THEN sl ELSE 0 END) AS t0, avg(CASE y WHEN 1 THEN -sh WHEN 2 THEN sl ELSE 0 END) AS t1 FROM p{k}"),
            (f"g{k}", f"SELECT w - {rate} * gw AS w, f - {rate} * (t0 + t1) AS f, g - {rate} * t1 * exp(g) AS g FROM h{k}"),
        ]
    return _with(parts, f"SELECT CAST(0 AS INTEGER) AS place, round(f, 6) AS threshold FROM g{epochs} UNION ALL SELECT 1, round(f + exp(g), 6) FROM g{epochs}")


def _split(rows: str, least: int) -> str:
    """The best split of rows (x, n, s, q: sums of the target and its square per value), by squared error and then by place."""
    return f"""SELECT t FROM (SELECT (x + lead(x) OVER o) / 2 AS t, sum(n) OVER o AS ln, sum(s) OVER o AS ls, sum(q) OVER o AS lq, sum(n) OVER () AS n, sum(s) OVER () AS s, sum(q) OVER () AS q
FROM {rows} WINDOW o AS (ORDER BY x)) WHERE t IS NOT NULL AND ln >= {least} AND n - ln >= {least} ORDER BY round(lq - ls * ls / ln + (q - lq) - (s - ls) * (s - ls) / (n - ln), 9), t LIMIT 1"""


def _tree(k: str, rows: str, least: int) -> list[tuple[str, str]]:
    """v{k}: the value of a tree of two levels for every x of `rows`."""
    return [
        (f"t{k}", _split(rows, least)),
        (f"tl{k}", _split(f"(SELECT * FROM {rows} WHERE x <= (SELECT t FROM t{k}))", least)),
        (f"tr{k}", _split(f"(SELECT * FROM {rows} WHERE x > (SELECT t FROM t{k}))", least)),
        (f"v{k}", f"""SELECT x, sum(s) OVER leaf / sum(n) OVER leaf AS v FROM (SELECT *, CASE WHEN x <= (SELECT t FROM t{k}) THEN CASE WHEN x <= (SELECT t FROM tl{k}) THEN 0 ELSE 1 END
ELSE CASE WHEN x <= (SELECT t FROM tr{k}) THEN 2 ELSE 3 END END AS leaf FROM {rows}) WINDOW leaf AS (PARTITION BY leaf)"""),
    ]


PARTS = ("d", "SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part")
REGRESSION = "count(*) AS n, round(avg((y - f) * (y - f)), 3) AS mse, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse, round(avg(abs(y - f)), 4) AS mae, round(1 - avg((y - f) * (y - f)) / var_pop(y), 6) AS r2"


def gradient_boosting(rounds: int, rate: float = 0.1) -> str:
    parts = [PARTS, ("f0", "SELECT DISTINCT x, (SELECT avg(y) FROM d) AS f FROM d")]
    for k in range(1, rounds + 1):
        parts.append((f"c{k}", f"SELECT x, count(*) AS n, sum(y - f) AS s, sum((y - f) * (y - f)) AS q FROM d JOIN f{k - 1} USING (x) GROUP BY x"))
        parts += _tree(str(k), f"c{k}", 1)
        parts.append((f"f{k}", f"SELECT x, f + {rate} * v AS f FROM f{k - 1} JOIN v{k} USING (x)"))
    return _with(parts, f"SELECT {REGRESSION} FROM d JOIN f{rounds} USING (x)")


def adaboost(rounds: int) -> str:
    parts = [*STANDARD, ("c", "SELECT x, count(*) FILTER (y = 1) AS up, count(*) FILTER (y = 0) AS down FROM s GROUP BY x"), ("m0", "SELECT x, up, down, CAST(0 AS DOUBLE) AS m FROM c")]
    for k in range(1, rounds + 1):
        parts += [
            (f"w{k}", f"SELECT x, up * exp(-m) + down * exp(m) AS w, up * exp(-m) AS u FROM m{k - 1}"),
            (f"l{k}", f"SELECT (x + lead(x) OVER o) / 2 AS t, sum(w) OVER o AS lw, sum(u) OVER o AS lu, sum(w) OVER () AS aw, sum(u) OVER () AS au FROM w{k} WINDOW o AS (ORDER BY x)"),
            (f"e{k}", f"SELECT t, (lu + (aw - au) - (lw - lu)) / aw AS e FROM l{k} WHERE t IS NOT NULL"),
            (f"b{k}", f"SELECT t, e, p, 0.5 * ln((1 - c) / c) AS a FROM (SELECT *, least(greatest(e, 1e-10), 1 - 1e-10) AS c FROM (SELECT t, round(e, 12) AS e, CAST(1 AS DOUBLE) AS p FROM e{k} UNION ALL SELECT t, round(1 - e, 12), -1 FROM e{k})) ORDER BY e, t, p DESC LIMIT 1"),
            (f"m{k}", f"SELECT x, up, down, m + a * p * CASE WHEN x <= t THEN -1 ELSE 1 END AS m FROM m{k - 1}, b{k}"),
        ]
    return _with(parts, " UNION ALL ".join(f"SELECT CAST({k - 1} AS INTEGER) AS round, round(t, 6) AS threshold, p AS polarity, round(a, 6) AS alpha FROM b{k}" for k in range(1, rounds + 1)))


def cox(epochs: int, rate: float = 0.05) -> str:
    parts = [
        ("d", """SELECT CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS DOUBLE) AS t,
CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 1 ELSE 0 END AS e, avg(value) / 100 AS x FROM events GROUP BY user_id"""),
        ("g0", "SELECT CAST(0 AS DOUBLE) AS w"),
    ]
    for k in range(1, epochs + 1):
        parts += [
            (f"a{k}", f"SELECT t, any_value(w) AS w, sum(e) AS e, sum(e * x) AS ex, sum(exp(w * x)) AS r, sum(exp(w * x) * x) AS rx FROM d, g{k - 1} GROUP BY t"),
            (f"r{k}", f"SELECT w, e, ex, sum(r) OVER o AS r, sum(rx) OVER o AS rx FROM a{k} WINDOW o AS (ORDER BY t DESC)"),
            (f"g{k}", f"SELECT any_value(w) + {rate} * sum(ex - e * rx / r) / (SELECT count(*) FROM d) AS w FROM r{k}"),
        ]
    return _with(parts, f"SELECT round(w, 8) AS b1 FROM g{epochs}")


def single_linkage(k: int) -> str:
    return f"""WITH g AS (SELECT v, lead(v) OVER (ORDER BY v) - v AS gap FROM (SELECT DISTINCT s_acctbal AS v FROM supplier)),
e AS (SELECT v FROM g WHERE gap IS NOT NULL ORDER BY gap * gap DESC, v DESC LIMIT {k - 1}),
c AS (SELECT (SELECT count(*) FROM e WHERE e.v < s.s_acctbal) AS g, s_acctbal AS v FROM supplier s)
SELECT CAST(g AS INTEGER) AS cluster, round(avg(v), 6) AS center FROM c GROUP BY g"""


def discriminants(rows: str = "SELECT l_quantity / 10 AS x, l_tax * 100 AS y, l_returnflag AS k FROM lineitem") -> str:
    """Two features x and y, any number of classes k: the eigenvectors of a two by two problem in closed form."""
    parts = [
        ("d", rows),
        ("c", "SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM d GROUP BY k"),
        ("m", "SELECT sum(n * mx) / sum(n) AS ax, sum(n * my) / sum(n) AS ay FROM c"),
        ("w", "SELECT sum(n * vx) AS a, sum(n * vxy) AS b, sum(n * vy) AS c, sum(n * (mx - ax) * (mx - ax)) AS p, sum(n * (mx - ax) * (my - ay)) AS q, sum(n * (my - ay) * (my - ay)) AS r FROM c, m"),
        ("z", "SELECT a * c - b * b AS u, a * r + c * p - 2 * b * q AS v, p * r - q * q AS t, a, b, p, q FROM w"),
        ("e", "SELECT (v + sqrt(v * v - 4 * u * t)) / (2 * u) AS h, 0 AS k, a, b, p, q FROM z UNION ALL SELECT (v - sqrt(v * v - 4 * u * t)) / (2 * u), 1, a, b, p, q FROM z"),
        ("f", "SELECT k, q - h * b AS x, -(p - h * a) AS y FROM e"),
        ("s", "SELECT k, x, y, sqrt(x * x + y * y) * CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS len FROM f"),
    ]
    return _with(parts, "SELECT CAST(k AS INTEGER) AS k, round(x / len, 4) AS x, round(y / len, 4) AS y FROM s")


def comparison() -> str:
    parts = [
        PARTS,
        ("m", "SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS c FROM d"),
        ("b", "SELECT mx, my, c / vx AS b, sign(c) * greatest(abs(c) / sqrt(vx) - 0.1, 0) / sqrt(vx) AS l FROM m"),
        ("c0", "SELECT x, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM d GROUP BY x"),
        *_tree("0", "c0", 2),
        ("p", """SELECT 'linear_regression' AS algorithm, y, my + b * (x - mx) AS f FROM d, b UNION ALL SELECT 'lasso_regression', y, my + l * (x - mx) FROM d, b
UNION ALL SELECT 'decision_tree', y, v FROM d JOIN v0 USING (x)"""),
    ]
    return _with(parts, """SELECT 'experiment_' || algorithm AS model_name, algorithm, round(1 - avg((y - f) * (y - f)) / var_pop(y), 6) AS r_squared, round(avg((y - f) * (y - f)), 3) AS mse,
count(*) AS n_samples, CAST(1 AS INTEGER) AS n_features, CAST(NULL AS VARCHAR) AS error FROM p GROUP BY algorithm""")


def neighbours() -> str:
    """Every vector's other vectors by distance over all components."""
    return """WITH e AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
r AS (SELECT q.vec_id AS qid, t.y, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, t.x), t.vec_id) AS k FROM e q JOIN e t ON q.vec_id <> t.vec_id) """


def dense_vectors(eps: float, min_points: int) -> str:
    """Density clusters of the embeddings by all pairs and their reach."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON list_distance(a.x, b.x) <= {eps}),
core AS (SELECT a FROM p GROUP BY a HAVING count(*) >= {min_points}),
l AS (SELECT p.a, p.b FROM p SEMI JOIN core ON p.a = core.a SEMI JOIN core c ON p.b = c.a),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS cluster FROM reach GROUP BY a),
border AS (SELECT p.a, min(c.cluster) AS cluster FROM p JOIN c ON p.b = c.a GROUP BY p.a)
SELECT vec_id, coalesce(c.cluster, border.cluster) AS cluster, c.a IS NOT NULL AS core FROM e LEFT JOIN c ON c.a = vec_id LEFT JOIN border ON border.a = vec_id"""


def naive_bayes() -> str:
    return """WITH e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY label),
m AS (SELECT label, i, avg(x) AS m, var_pop(x) + 1e-9 AS v FROM e GROUP BY label, i),
s AS (SELECT e.vec_id, m.label, sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) AS ll FROM e JOIN m USING (i) GROUP BY e.vec_id, m.label),
b AS (SELECT vec_id, CAST(arg_max(label, ll + ln(p)) AS DOUBLE) AS prediction FROM s JOIN p USING (label) GROUP BY vec_id)
SELECT prediction, count(*) AS n FROM b GROUP BY prediction"""
