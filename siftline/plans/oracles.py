"""The same queries in SQL, written from the definitions and not from the plans, for an independent engine."""

from __future__ import annotations

from siftline.operators.compare import TARGETS

ORDER_LINES = """
ol AS (
  SELECT o_orderkey AS id, o_custkey, o_orderpriority AS grp, o_orderstatus, o_orderkey % 5 AS fold, o_totalprice AS t, price AS p, qty
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""


def rank(x: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    ties = f"PARTITION BY {by}, {x}" if by else f"PARTITION BY {x}"
    return f"(rank() OVER ({part}ORDER BY {x}) + (count(*) OVER ({ties}) - 1) / 2::DOUBLE)"


def corr(x: str, y: str, least: int = 3) -> str:
    return f"CASE WHEN count(*) >= {least} AND min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END"


def r6(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) AS {name}"


def spearman(source: str, by: str, x: str, y: str) -> str:
    """SELECT of (by, n, spearman); by may be empty."""
    ranks = f"SELECT {by + ', ' if by else ''}{rank('x', by)} AS rx, {rank('y', by)} AS ry FROM (SELECT {by + ', ' if by else ''}{x} AS x, {y} AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL"
    return f"SELECT {by + ', ' if by else ''}count(*) AS n, {corr('rx', 'ry')} AS spearman FROM ({ranks}) {'GROUP BY ' + by if by else ''}"


def competitive(source: str, by: str, t: str, p: str, tie: str) -> str:
    """SELECT of the competitive metrics by group."""
    return f"""
SELECT {by}, count(*) AS n, {corr('rt', 'rp')} AS spearman, {corr('t', 'p')} AS pearson,
  CASE WHEN count(*) >= 3 THEN sqrt(avg((t - p) * (t - p))) END AS rmse,
  CASE WHEN count(*) >= 3 THEN 1 - avg((t - p) * (t - p)) / nullif(var_pop(t), 0) END AS r2,
  CASE WHEN count(*) >= 3 THEN stddev_pop(t) END AS label_sd,
  CASE WHEN count(*) >= 3 THEN sqrt(avg((t - p) * (t - p))) / nullif(stddev_pop(t), 0) END AS rmse_over_sd,
  CASE WHEN count(*) >= 3 THEN count(*) FILTER (bad AND told) / nullif(count(*) FILTER (bad), 0)::DOUBLE END AS worst_recall,
  CASE WHEN count(*) >= 3 THEN (sum(rp) FILTER (bad) - count(*) FILTER (bad) * (count(*) FILTER (bad) + 1) / 2::DOUBLE)
    / nullif(count(*) FILTER (bad) * count(*) FILTER (NOT bad), 0)::DOUBLE END AS worst_auroc
FROM (SELECT {by}, t, p, {rank('t', by)} AS rt, {rank('p', by)} AS rp,
  row_number() OVER (PARTITION BY {by} ORDER BY t DESC, tie) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY {by})) AS bad,
  row_number() OVER (PARTITION BY {by} ORDER BY p DESC, tie) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY {by})) AS told
  FROM (SELECT {by}, {t}::DOUBLE AS t, {p}::DOUBLE AS p, {tie} AS tie FROM {source}) WHERE t IS NOT NULL AND p IS NOT NULL)
GROUP BY {by}"""


METRICS = ("spearman", "pearson", "rmse", "r2", "label_sd", "rmse_over_sd", "worst_recall", "worst_auroc")


def rounded(columns: tuple[str, ...] = METRICS) -> str:
    return ", ".join(r6(c, c) for c in columns)


def official(source: str, by: str, t: str = "t", p: str = "p", tie: str = "id") -> str:
    k = f"greatest(1, floor(0.1::DOUBLE * count(*) OVER (PARTITION BY {by})))"
    flip = f"SELECT {by}, {tie} AS tie, {t} AS t, {p} AS p"
    return f"""
SELECT {by}, count(*) AS n, {corr('rt', 'rp')} AS spearman,
  CASE WHEN count(*) >= 3 THEN count(*) FILTER (a AND b) / count(*) FILTER (a)::DOUBLE END AS top_recall
FROM (SELECT {by}, {rank('t', by)} AS rt, {rank('p', by)} AS rp,
  row_number() OVER (PARTITION BY {by} ORDER BY t DESC, tie) <= {k} AS a, row_number() OVER (PARTITION BY {by} ORDER BY p DESC, tie) <= {k} AS b
  FROM ({flip} FROM {source}) WHERE t IS NOT NULL AND p IS NOT NULL)
GROUP BY {by}"""


def count_of(s: str, members: str) -> str:
    return f"(length({s}) - length(translate({s}, '{members}', '')))::DOUBLE"


def clean(s: str) -> str:
    return f"translate({s}, '-|*', '')"


def composition(s: str, p: str) -> str:
    c = clean(s)
    pos, neg, aro, hyd = (count_of(c, m) for m in ("KRH", "DE", "FWY", "AILMFWYVC"))
    n = f"greatest(length({c})::DOUBLE, 1::DOUBLE)"
    parts = {
        "length": f"length({c})::DOUBLE", "net_charge": f"{pos} - {neg}", "positive_count": pos, "negative_count": neg, "aromatic_count": aro, "hydrophobic_count": hyd,
        "lys_arg_asymmetry": f"{count_of(c, 'K')} - {count_of(c, 'R')}", "acid_base_imbalance": f"abs({pos} - {neg})", "hydrophobic_fraction": f"{hyd} / {n}", "aromatic_fraction": f"{aro} / {n}",
    }
    return ", ".join(r6(v, f"{p}_{k}") for k, v in parts.items())


def verdict(auroc: str, rho: str) -> str:
    return f"CASE WHEN {auroc} IS NULL OR {rho} IS NULL THEN 'NO EXTERNAL SCORE' WHEN {auroc} >= 0.75 AND {rho} >= 0.30 THEN 'EXTERNAL TRIAGE HOLDS' WHEN {auroc} >= 0.65 AND {rho} >= 0.15 THEN 'WEAK EXTERNAL TRIAGE' ELSE 'EXTERNAL TRIAGE FAIL' END"


DOCS = """
df AS (SELECT doc_id, lang, source, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u FROM documents)"""


def _region(s: str, windows: tuple[tuple[int, int], ...]) -> str:
    return "concat(" + ", ".join(f"substring({s}, {a + 1}, {b - a})" for a, b in windows) + ")"


HEAVY, LIGHT = _region("h", ((25, 42), (56, 76), (105, 138))), _region("l", ((24, 42), (56, 72), (104, 130)))


def _charge(s: str) -> str:
    return f"({count_of(clean(s), 'KRH')} - {count_of(clean(s), 'DE')})"


MODEL_SCORES = f"""
{ORDER_LINES}, names AS (SELECT * FROM (VALUES {', '.join(f"('{g}', '{a}')" for g, a in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), TARGETS, strict=True))}) v(grp, assay)),
ms AS (
  SELECT assay, model, n, round(spearman, 6) AS spearman FROM (
    SELECT *, 'by_price' AS model FROM ({spearman('ol', 'grp', 't', 'p')}) UNION ALL SELECT *, 'by_quantity' AS model FROM ({spearman('ol', 'grp', 't', 'qty')})
  ) JOIN names USING (grp)
)"""
TARGET_ROWS = "targets AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {t}::DOUBLE, {b}::DOUBLE, {str(h).lower()})" for a, (t, b, h) in TARGETS.items()) + ") v(assay, top_spearman, first_bar, higher_is_better))"

CUSTOMERS = """
cu AS (
  SELECT c_custkey, round(c_acctbal / 1000 - 4, 6) AS net, (c_nationkey % 7 - 3)::DOUBLE AS cdr, (n % 9)::DOUBLE AS imbalance, round(mean_price / 600000, 6) AS hydro
  FROM customer JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1) ON o_custkey = c_custkey
)"""
ARCHETYPES = f"""
{CUSTOMERS}, bars AS (SELECT greatest(4, quantile_cont(imbalance, 0.75)) AS bi, greatest(0.42, quantile_cont(hydro, 0.75)) AS bh FROM cu),
ar AS (
  SELECT cu.*, concat_ws('|', CASE WHEN net >= 3 THEN 'globally_positive' WHEN net <= -3 THEN 'globally_negative' ELSE 'balanced_charge' END,
    CASE WHEN cdr >= 2 THEN 'cdr_positive' WHEN cdr <= -2 THEN 'cdr_negative' ELSE 'cdr_balanced' END,
    CASE WHEN imbalance >= bi THEN 'high_charge_asymmetry' ELSE 'low_charge_asymmetry' END, CASE WHEN hydro >= bh THEN 'hydrophobic_cdr' ELSE 'ordinary_cdr' END) AS archetype
  FROM cu, bars
)"""
POINTS = """
pt AS (
  SELECT vec_id, label::BIGINT AS sid, round(embedding[1]::DOUBLE * 100, 4) AS x, round(embedding[2]::DOUBLE * 100, 4) AS y, round(embedding[3]::DOUBLE * 100, 4) AS z, embedding[4] > 0 AS is_cdr,
    CASE WHEN embedding[5]::DOUBLE > 0.05 THEN 'pos' WHEN embedding[5]::DOUBLE < -0.05 THEN 'neg' ELSE 'neutral' END AS cls
  FROM embeddings
)"""


def edges(cutoff: float, source: str = "pt", strict: bool = False, same: str = "a.sid = b.sid") -> str:
    d = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
    return f"SELECT a.sid, a.vec_id AS src, b.vec_id AS dst, {d} AS distance FROM {source} a JOIN {source} b ON {same} AND a.vec_id < b.vec_id WHERE {d} {'<' if strict else '<='} {cutoff}"


def reach(nodes: str, links: str) -> str:
    """CTEs comp(v, component) by recursive reachability over undirected links(src, dst)."""
    return f"""
links AS ({links}), both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
walk AS (SELECT vec_id AS v, vec_id AS w FROM {nodes} UNION SELECT walk.v, both_ways.dst FROM walk JOIN both_ways ON both_ways.src = walk.w),
comp AS (SELECT v, min(w) AS component FROM walk GROUP BY v)"""


def draw(seed: str, key: str) -> str:
    return f"md5(concat_ws('|', {seed}, {key}::VARCHAR))"


def deranged(source: str, by: str, key: str, value: str, seed: int, keep: str) -> str:
    w = f"PARTITION BY {by} ORDER BY {draw(f"'{seed}'", key)}, {key}"
    return f"SELECT {keep}, coalesce(lead({value}) OVER ({w}), first_value({value}) OVER ({w})) AS scrambled, count(*) OVER (PARTITION BY {by}) <= 1 AS non_derangeable FROM {source}"


def shuffled(source: str, by: str, key: str, label: str, seed: int, keep: str) -> str:
    return f"""SELECT {keep}, shuffled FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {draw(f"'{seed}'", key)}, {key}) AS i FROM {source}) d
  JOIN (SELECT {by} AS sb, row_number() OVER (PARTITION BY {by} ORDER BY {key}) AS si, {label} AS shuffled FROM {source}) s ON s.sb = d.{by} AND s.si = d.i"""


def _replicates(first: int, last: int) -> str:
    """Rows of ``ol`` with both measures, once for each seed ``r``, with their place in its order."""
    return f"(SELECT *, {draw('r::VARCHAR', 'id')} AS h FROM (SELECT id, grp, t, p, qty FROM ol WHERE p IS NOT NULL), range({first}, {last + 1}) q(r))"


def all_deranged(first: int, last: int, value: str) -> str:
    w = "PARTITION BY grp, r ORDER BY h, id"
    return f"SELECT grp, r, t, p, qty, coalesce(lead({value}) OVER ({w}), first_value({value}) OVER ({w})) AS scrambled FROM {_replicates(first, last)}"


def all_shuffled(first: int, last: int, label: str) -> str:
    return f"""SELECT d.grp AS grp, r, p, qty, shuffled FROM (SELECT *, row_number() OVER (PARTITION BY grp, r ORDER BY h, id) AS i FROM {_replicates(first, last)}) d
  JOIN (SELECT grp AS sb, row_number() OVER (PARTITION BY grp ORDER BY id) AS si, {label} AS shuffled FROM ol WHERE p IS NOT NULL) s ON s.sb = d.grp AND s.si = d.i"""


def blocks() -> str:
    plain = [("'real_topology'", spearman("ol", "grp", "p", "qty")), ("'surface_composition'", spearman("ol", "grp", "t", "p"))]
    nulls = [
        ("'scrambled_topology_' || r", spearman(f"({all_deranged(1, 30, 'p')})", "grp, r", "scrambled", "qty")),
        ("'label_shuffle_' || r", spearman(f"({all_shuffled(1, 30, 'qty')})", "grp, r", "shuffled", "p")),
    ]
    return "bl AS (" + " UNION ALL ".join(f"SELECT grp AS assay, {n} AS feature_block, n, round(spearman, 9) AS spearman FROM ({q})" for n, q in plain + nulls) + ")"


def null_rows() -> str:
    return f"SELECT grp, round(spearman, 9) AS v FROM ({spearman(f'({all_shuffled(0, 99, "t")})', 'grp, r', 'shuffled', 'p')})"


def knn(apart: str, k: int = 8) -> str:
    return f"""
WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS y, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id, a.y AS y_true, b.y AS r, round(list_dot_product(a.e, b.e), 9) AS sim, b.vec_id AS other FROM v a JOIN v b ON {apart}),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS n FROM s)
SELECT vec_id, {r6('any_value(y_true)', 'y_true')}, {r6('avg(r)', 'y_pred')}, {r6('avg(sim)', 'mean_similarity')} FROM t WHERE n <= {k} GROUP BY vec_id"""


GRID = "grid AS (SELECT g, (g % 3) * 0.5::DOUBLE AS a, (g // 3) * 0.5::DOUBLE AS b FROM range(9) r(g))"


def grid_scores(source: str, by: str) -> str:
    keys = f"{by}, g, a, b" if by else "g, a, b"
    return f"SELECT {keys}, n, round(spearman, 6) AS spearman FROM ({spearman(f'(SELECT {by + "," if by else ""} g, a, b, round(a * net + b * cdr, 6) AS s, hydro FROM {source}, grid)', keys, 's', 'hydro')})"


def loo_sums(x: str, y: str) -> str:
    return f"""pr AS (SELECT fold, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM ol WHERE {x} IS NOT NULL AND {y} IS NOT NULL), fo AS (SELECT DISTINCT fold FROM pr)"""


FOLDS = """SELECT 'user_fold' AS fold_column, (user_id % 5)::VARCHAR AS fold, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'order_fold', (o_orderkey % 3)::VARCHAR, count(*) FROM orders GROUP BY ALL"""
MISSING_COLUMNS = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}
LABELS_CTE = f"""
{ORDER_LINES}, bar AS (SELECT quantile_cont(t, 0.8) AS bt, quantile_cont(p, 0.8) AS bp, quantile_cont(qty, 0.2) AS bq FROM ol),
lb AS (SELECT t >= bt AS t, p >= bp AS p, qty <= bq AS qty FROM ol, bar)"""


def _jaccard(a: str, b: str) -> str:
    known = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return f"SELECT '{a}' AS a, '{b}' AS b, round(count(*) FILTER ({known} AND {a} AND {b}) / nullif(count(*) FILTER ({known} AND ({a} OR {b})), 0)::DOUBLE, 6) AS jaccard FROM lb"


NUMBERS = r"list_transform(regexp_extract_all({0}, '[-+]?(?:\d+\.\d+|\d+)(?:[eE][-+]?\d+)?'), lambda v: v::DOUBLE)"
REGIME_POINTS = """
rp0 AS (SELECT i AS point, (i % 5) * 0.8::DOUBLE AS ra, (i // 5 % 4) * 0.4::DOUBLE AS rr, (i // 20 * 2 + 1)::DOUBLE AS rv FROM range(60) r(i)),
rp AS (SELECT *, ra - 0.5::DOUBLE * rr + 0.1::DOUBLE * rv AS o FROM rp0)"""

GATE = """g AS (SELECT assay, max(n) FILTER (feature_block = 'real_topology') AS n, max(spearman) FILTER (feature_block = 'surface_composition') AS surface, max(spearman) FILTER (feature_block = 'real_topology') AS real,
avg(spearman) FILTER (feature_block LIKE 'scrambled%') AS sm, stddev_pop(spearman) FILTER (feature_block LIKE 'scrambled%') AS ss, avg(spearman) FILTER (feature_block LIKE 'label%') AS lm, stddev_pop(spearman) FILTER (feature_block LIKE 'label%') AS ls FROM bl GROUP BY assay)"""
MEASURE_PAIRS = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))

ORACLES = {
    "triage_flagship": f"""WITH {DOCS}, f AS (SELECT doc_id, lang, {composition('u', 't')} FROM df WHERE doc_id IN (SELECT doc_id FROM labels)),
g AS (SELECT doc_id, lang, {count_of(clean('u'), 'AILMFWYVC')} / greatest(length({clean('u')})::DOUBLE, 1) AS h, {count_of(clean('u'), 'FWY')} / greatest(length({clean('u')})::DOUBLE, 1) AS a FROM df JOIN labels USING (doc_id)),
m AS ({competitive('g', 'lang', 'h', 'a', 'doc_id')})
SELECT lang, n, {rounded()}, {verdict('round(worst_auroc, 6)', 'round(spearman, 6)')} AS verdict FROM m""",
    "missingness": "WITH m AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, round(count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE, 6) AS missing_fraction, '{t}' AS dtype FROM m" for c, t in MISSING_COLUMNS.items()),
    "fold_summary": FOLDS,
    "corr_network": "WITH "
    + ", ".join(f"c{i} AS (SELECT '{a}' AS a, '{b}' AS b, spearman AS c FROM ({spearman('lineitem', '', a, b)}))" for i, (a, b) in enumerate(MEASURE_PAIRS))
    + f" SELECT a, b, {r6('c', 'correlation')}, {r6('abs(c)', 'abs_correlation')} FROM (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(MEASURE_PAIRS))) + ") WHERE abs(c) >= 0.003",
    "composition_features": f"WITH {DOCS} SELECT doc_id, lang, {composition('u', 't')} FROM df",
    "region_features": f"""WITH {DOCS}, s AS (SELECT doc_id, u AS h, reverse(u) AS l FROM df), c AS (SELECT *, {HEAVY} AS hc, {LIGHT} AS lc FROM s)
SELECT doc_id, {r6(f"length({clean('substring(h, 106, 33)')})", 'cdr_h3_length')}, {r6(f"{_charge('h')} + {_charge('l')}", 'fv_net_charge')}, {r6(f"abs({_charge('h')} - {_charge('l')})", 'vh_vl_charge_imbalance')},
{r6(f"{_charge('concat(hc, lc)')} / greatest(abs({_charge('h')} + {_charge('l')}), 1)", 'cdr_charge_fraction_of_fv')}, {r6(count_of(clean('hc'), 'KRH'), 'heavy_cdr_positive_count')},
{r6(f"{count_of(clean('lc'), 'AILMFWYVC')} / greatest(length({clean('lc')})::DOUBLE, 1)", 'light_cdr_hydrophobic_fraction')}, {r6(f"{count_of(clean('concat(hc, lc)'), 'FWY')} / greatest(length({clean('concat(hc, lc)')})::DOUBLE, 1)", 'fv_cdr_aromatic_fraction')},
{r6(f"length({clean('concat(hc, lc)')})", 'fv_cdr_length')} FROM c""",
    "pairwise_identity": f"""WITH p AS (SELECT a.item_id AS i, b.item_id AS j, a.text AS x, b.text AS y, unnest(range(1, least(length(a.text), length(b.text)) + 1)) AS k FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id)
SELECT i, j, {r6("count(*) FILTER (x[k] = y[k]) / count(*)::DOUBLE", 'identity')} FROM p WHERE x[k] <> '-' AND y[k] <> '-' GROUP BY i, j""",
    "group_fold_deal": """WITH RECURSIVE g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
o AS (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, md5(concat_ws('|', '7', user_id::VARCHAR)), user_id) AS i FROM g),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS fold, list_transform(range(least(5, (SELECT count(*) FROM g))), lambda x: 0::HUGEINT) AS loads
  UNION ALL SELECT r.i + 1, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda v, k: v + CASE WHEN k = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END)
  FROM r JOIN o ON o.i = r.i + 1)
SELECT user_id, n, fold FROM o JOIN r USING (i)""",
    "fold_preprocess": f"""WITH {ORDER_LINES}, d AS (SELECT id, fold, t, CASE WHEN qty < 180 THEN qty END AS qty, nullif(grp, '5-LOW') AS grp, c_nationkey::VARCHAR AS nation FROM ol LEFT JOIN customer ON c_custkey = o_custkey),
f AS (SELECT DISTINCT fold AS f FROM d), tr AS (SELECT f, d.* FROM d JOIN f ON fold <> f),
med AS (SELECT f, median(t) AS mt, median(qty) AS mq FROM tr GROUP BY f),
mom AS (SELECT f, any_value(mt) AS mt, any_value(mq) AS mq, avg(coalesce(t, mt)) AS avt, stddev_pop(coalesce(t, mt)) AS st, avg(coalesce(qty, mq)) AS avq, stddev_pop(coalesce(qty, mq)) AS sq FROM tr JOIN med USING (f) GROUP BY f),
lev AS (SELECT f, 'g' AS c, grp AS l, count(*) AS n FROM tr WHERE grp IS NOT NULL GROUP BY ALL UNION ALL SELECT f, 'n', nation, count(*) FROM tr WHERE nation IS NOT NULL GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY f, c ORDER BY l) - 1 AS k, first_value(l) OVER (PARTITION BY f, c ORDER BY n DESC, l) AS mode FROM lev), mo AS (SELECT DISTINCT f, c, mode FROM pl)
SELECT id, {r6('(coalesce(t, mt) - avt) / st', 't')}, {r6('(coalesce(qty, mq) - avq) / sq', 'qty')}, coalesce(g.k::VARCHAR, 'none') || '|' || coalesce(n.k::VARCHAR, 'none') AS hot
FROM d JOIN mom ON mom.f = fold JOIN mo a ON a.f = fold AND a.c = 'g' JOIN mo b ON b.f = fold AND b.c = 'n'
LEFT JOIN pl g ON g.f = fold AND g.c = 'g' AND g.l = coalesce(grp, a.mode) LEFT JOIN pl n ON n.f = fold AND n.c = 'n' AND n.l = coalesce(nation, b.mode)""",
    "join_validation": """WITH m AS (SELECT o_totalprice AS v, o_orderkey AS k FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 3 <> 0),
s AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1), o AS (SELECT s.k AS k, v FROM orders LEFT JOIN s ON s.k = o_orderkey)
SELECT 'many_to_one' AS cardinality, round(sum(v), 6) AS total, count(*) AS rows, count(*) FILTER (k IS NULL) AS unmatched, 0::BIGINT AS doubled FROM m
UNION ALL SELECT 'one_to_one', round(sum(v), 6), count(*), count(*) FILTER (k IS NULL), 0::BIGINT FROM o""",
    "stacked_features": """WITH p AS (SELECT c_custkey AS k, c_nationkey::DOUBLE AS n, c_acctbal AS b FROM customer WHERE c_custkey % 4 <> 0),
o AS (SELECT o_custkey AS k, count(*)::DOUBLE AS n, max(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT k, p.n AS own_c_nationkey, round(CASE WHEN p.n % 2 = 1 THEN -b ELSE b END, 6) AS own_c_acctbal, o.n AS orders_n, round(CASE WHEN p.n % 2 = 1 THEN -m ELSE m END, 6) AS orders_most FROM p FULL JOIN o USING (k)""",
    "label_auroc": f"""WITH {DOCS}, g AS (SELECT lang, source, quality = 1 AS good, {count_of(clean('u'), 'AILMFWYVC')} / greatest(length({clean('u')})::DOUBLE, 1) AS h, {count_of(clean('u'), 'FWY')} / greatest(length({clean('u')})::DOUBLE, 1) AS a FROM df JOIN labels USING (doc_id)),
r AS (SELECT *, {rank('h', 'lang')} AS rh, {rank('a', 'lang')} AS ra FROM g)
SELECT lang, {r6("(sum(rh) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2::DOUBLE) / nullif(count(*) FILTER (good) * count(*) FILTER (NOT good), 0)::DOUBLE", 'hydrophobic')},
  {r6("(sum(ra) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2::DOUBLE) / nullif(count(*) FILTER (good) * count(*) FILTER (NOT good), 0)::DOUBLE", 'aromatic')},
  count(DISTINCT source) AS n_sources, count(*) FILTER (good) AS n_good FROM r GROUP BY lang""",
    "rank_among_baselines": """WITH r AS (SELECT s_nationkey::BIGINT AS s_nationkey, s_suppkey, s_acctbal, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS rank, count(*) OVER (PARTITION BY s_nationkey) AS n, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS f FROM supplier)
SELECT s_nationkey, round(s_acctbal, 6) AS s_acctbal, rank, n FROM r WHERE s_suppkey = f""",
    "csv_round_trip": """SELECT 'state_' || o_orderstatus AS source_dir, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 6) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS remarks, max(CASE WHEN o_orderkey % 2 = 0 THEN 'says "a, b"' END) AS remark
FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_orderstatus, o_orderpriority""",
    "pdb_round_trip": """WITH r AS (SELECT label, vec_id, CASE WHEN vec_id % 2 = 0 THEN 'H' ELSE 'L' END AS chain, floor(round(embedding[1]::DOUBLE * 100, 4)) AS x, (floor(embedding[6]::DOUBLE * 1000)::INT % 8 + 8) % 8 AS k FROM embeddings WHERE vec_id < 10000),
p AS (SELECT *, row_number() OVER (PARTITION BY label, chain ORDER BY vec_id) - 1 AS place FROM r)
SELECT chain, substring('KDHFAERG', k + 1, 1) AS aa, count(*) AS n, round(sum(x), 6) AS x, sum(place)::BIGINT AS places FROM p GROUP BY ALL""",
    "literature_conditions": f"""WITH t AS (SELECT event_id AS n, value AS v, user_id,
  lower(concat_ws(' ', coalesce(['electrostatic patch', 'hydrophobic', 'fab-fab', NULL][event_id % 4 + 1], ''), coalesce(event_type, ''))) AS words FROM events),
b AS (SELECT n, words, CASE WHEN n % 7 > 0 THEN round(v / 10, 1) END AS ph, CASE WHEN n % 5 > 0 THEN (user_id % 200)::DOUBLE ELSE 0 END AS salt,
  CASE WHEN n % 2 = 0 THEN greatest(round(v), 10) ELSE round(v) END AS conc, CASE WHEN n % 4 = 3 THEN 37 ELSE 25 END::DOUBLE AS temp, (n % 4 IN (1, 2))::INT::DOUBLE AS arg FROM t),
c AS (SELECT *, sqrt(50 / (50 + salt)) AS sc, least(greatest(conc / 200, 0), 1.5::DOUBLE) AS cs, least(greatest(7.4::DOUBLE - coalesce(ph, 7.4::DOUBLE), 0), 2) / 2 AS boost,
  (salt > 0 AND salt <= 50)::INT::DOUBLE AS low, (salt >= 100)::INT::DOUBLE AS high, (conc >= 100)::INT::DOUBLE AS dense,
  regexp_matches(words, 'charge|electrostatic|fab-fc|fab fc|cation|anion|salt|pi')::INT::DOUBLE AS ch, regexp_matches(words, 'hydrophobic|aromatic|short-range')::INT::DOUBLE AS hy,
  regexp_matches(words, 'fab-fab|fab fab|fab-fc|fab fc|fv|patch|anisotropic')::INT::DOUBLE AS sp FROM b)
SELECT n AS anchor_id, {r6('ph', '"pH_numeric"')}, salt AS "salt_mM_numeric", conc AS protein_concentration_mg_ml_numeric, temp AS "temperature_C_numeric", (salt > 0)::INT::DOUBLE AS has_salt, {r6('sc', 'salt_screening_factor')}, {r6('1 - sc', 'salt_load')},
  low AS low_salt_condition, high AS high_salt_condition, arg AS arginine_or_excipient, {r6('cs', 'concentration_scaled')}, dense AS high_concentration, {r6('boost', '"low_pH_charge_boost"')},
  ch AS charge_mechanism_signal, hy AS hydrophobic_mechanism_signal, sp AS specific_interface_signal,
  {r6('least(greatest(cs + 0.5::DOUBLE * sc + 0.6::DOUBLE * ch + 0.4::DOUBLE * hy + 0.4::DOUBLE * boost - 0.3::DOUBLE * arg, 0), 4)', 'attraction_strength')},
  {r6('least(greatest(0.75::DOUBLE * (1 - sc) + 0.3::DOUBLE * arg + 0.25::DOUBLE * high, 0), 1.5::DOUBLE)', 'repulsion_strength')},
  CASE WHEN dense + low + sp < 0.75 THEN 1 WHEN dense + low + sp < 1.5 THEN 3 ELSE 5 END::BIGINT AS patch_valence FROM c""",
    "periodic_contacts": f"""WITH {POINTS}, d AS (SELECT a.sid, a.vec_id AS src, b.vec_id AS dst, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM pt a JOIN pt b ON a.sid = b.sid AND a.vec_id < b.vec_id),
n AS (SELECT sid, src, dst, sqrt((dx - 40 * round_even(dx / 40, 0)) ** 2 + (dy - 40 * round_even(dy / 40, 0)) ** 2 + (dz - 40 * round_even(dz / 40, 0)) ** 2) AS v FROM d)
SELECT sid, src, dst, {r6('v', 'distance')} FROM n WHERE v <= 9""",
    "identity_links": f"""WITH d AS (SELECT url, min(page_id) AS id FROM pages WHERE url IS NOT NULL GROUP BY url),
p AS (SELECT a.id AS i, b.id AS j, a.url AS x, b.url AS y, unnest(range(1, least(len(a.url), len(b.url)) + 1)) AS k FROM d a JOIN d b ON a.id < b.id),
m AS (SELECT i, j, count(*) FILTER (substring(x, k, 1) = substring(y, k, 1)) / count(*)::DOUBLE AS v FROM p WHERE substring(x, k, 1) <> '-' AND substring(y, k, 1) <> '-' GROUP BY i, j)
SELECT i, j, {r6('v', 'identity')} FROM m WHERE v >= 0.85""",
    "knn_loo": knn("a.vec_id <> b.vec_id"),
    "knn_grouped": knn("a.vec_id <> b.vec_id AND a.label <> b.label"),
    "knn_external": "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS y, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS q, a.y AS y_true, b.y AS r, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.vec_id) AS n FROM v a JOIN v b ON a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0), "
    + "m AS (" + " UNION ALL ".join(f"SELECT {k} AS k, q, any_value(y_true) AS y_true, avg(r) AS y_pred FROM s WHERE n <= {k} GROUP BY q" for k in (5, 8, 10)) + f") SELECT k::BIGINT AS k, n, {r6('spearman', 'spearman')} FROM ({spearman('m', 'k', 'y_true', 'y_pred')})",
    "failure_matrix": f"WITH {LABELS_CTE} " + " UNION ALL ".join(f"SELECT '{c}' AS assay, '{d}' AS direction, (SELECT round({b}, 6) FROM bar) AS threshold, count({c}) AS measured, count(*) FILTER ({c}) AS failures FROM lb" for c, d, b in (("t", "high", "bt"), ("p", "high", "bp"), ("qty", "low", "bq"))),
    "jaccard_labels": f"WITH {LABELS_CTE} " + " UNION ALL ".join(_jaccard(a, b) for a, b in (("t", "p"), ("t", "qty"), ("p", "qty"))),
    "metric_row": f"WITH {ORDER_LINES}, m AS ({competitive('ol', 'grp', 't', 'p', 'id')}) SELECT grp, n, {rounded(('pearson', 'rmse', 'r2', 'label_sd', 'rmse_over_sd', 'spearman'))} FROM m",
    "competitive_metrics": f"WITH {ORDER_LINES}, m AS ({competitive('ol', 'grp', 't', 'p', 'id')}) SELECT grp, n, {rounded()} FROM m",
    "top10_recall": f"WITH {ORDER_LINES}, m AS ({official('ol', 'grp')}) SELECT grp, n, {rounded(('spearman', 'top_recall'))} FROM m",
    "cv_fold_metrics": f"""WITH {ORDER_LINES}, e AS ({official('ol', 'grp, fold')}), w AS ({official('ol', 'grp')})
SELECT grp, fold::VARCHAR AS fold, n, {rounded(('spearman', 'top_recall'))} FROM e UNION ALL SELECT grp, 'aggregated', n, {rounded(('spearman', 'top_recall'))} FROM w
UNION ALL SELECT grp, 'average', sum(n)::BIGINT, round(avg(spearman), 6), round(avg(top_recall), 6) FROM e GROUP BY grp""",
    "select_best": f"WITH {MODEL_SCORES} SELECT assay, model, n, spearman FROM (SELECT *, row_number() OVER (PARTITION BY assay ORDER BY spearman DESC NULLS LAST, model) AS k FROM ms) WHERE k = 1",
    "compare_targets": f"""WITH {MODEL_SCORES}, {TARGET_ROWS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assay ORDER BY spearman DESC NULLS LAST, model) AS k FROM ms) WHERE k = 1)
SELECT assay, model, n, spearman, top_spearman, first_bar, higher_is_better, {r6('spearman - top_spearman', 'delta_top')}, {r6('spearman - first_bar', 'delta_bar')},
CASE WHEN spearman >= top_spearman THEN 'meets_or_beats_top' WHEN spearman >= first_bar THEN 'near_competitive' ELSE 'below_bar' END AS status
FROM b LEFT JOIN targets USING (assay)""",
    "external_status": f"""WITH {MODEL_SCORES}, {TARGET_ROWS} SELECT assay, top_spearman, model, spearman, n, {r6('spearman - top_spearman', 'delta_vs_published_top')},
CASE WHEN top_spearman IS NULL THEN 'exploratory_no_prize_target' WHEN spearman >= top_spearman THEN 'meets_or_beats_top' WHEN spearman >= 0.8 * top_spearman THEN 'approaches_top' ELSE 'below_top' END AS status FROM targets LEFT JOIN ms USING (assay)""",
    "external_compare": f"""WITH {ORDER_LINES}, i AS ({competitive('(SELECT * FROM ol WHERE fold > 0)', 'grp', 't', 'p', 'id')}), e AS ({competitive('(SELECT * FROM ol WHERE fold = 0)', 'grp', 't', 'p', 'id')})
SELECT i.grp, round(i.spearman, 6) AS internal_spearman, round(i.worst_auroc, 6) AS internal_auroc, i.n AS internal_n, round(e.spearman, 6) AS external_spearman, round(e.worst_auroc, 6) AS external_auroc, e.n AS external_n,
round(round(e.spearman, 6) - round(i.spearman, 6), 6) AS delta_spearman, round(round(e.worst_auroc, 6) - round(i.worst_auroc, 6), 6) AS delta_auroc, {verdict('round(e.worst_auroc, 6)', 'round(e.spearman, 6)')} AS verdict FROM i LEFT JOIN e USING (grp)""",
    "key_mapping": "SELECT concat('c', c_custkey) AS legacy_name, concat('EXT-', min(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey)) AS external_id FROM customer",
    "fold_ols_calibration": f"WITH {ORDER_LINES}, {loo_sums('qty', 't')} SELECT fo.fold::BIGINT AS fold, {r6('regr_slope(y, x)', 'slope')}, {r6('regr_intercept(y, x)', 'intercept')} FROM fo JOIN pr ON pr.fold <> fo.fold GROUP BY fo.fold",
    "ridge_1d_oof": f"WITH {ORDER_LINES}, {loo_sums('qty', 'p')} SELECT fo.fold::BIGINT AS fold, {r6('avg(x)', 'mean_x')}, {r6('avg(y)', 'mean_y')}, {r6('stddev_pop(x)', 'scale')}, {r6('covar_pop(x, y) * count(*) / stddev_pop(x) / (count(*) + 10)', 'weight')} FROM fo JOIN pr ON pr.fold <> fo.fold GROUP BY fo.fold",
    "axis_report": f"""WITH f AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice, CASE WHEN sold < 900 THEN sold END AS sold, p_brand FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS sold FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
q AS (SELECT *, cume_dist() OVER (ORDER BY p_size) AS s, cume_dist() OVER (ORDER BY p_retailprice) AS r, CASE WHEN sold IS NOT NULL THEN cume_dist() OVER (PARTITION BY sold IS NULL ORDER BY sold) END AS d FROM f),
w AS (SELECT p_partkey, unnest([
  {{'axis': 'Cost', 'pos': 0, 'k': 0, 'f': 'p_retailprice', 'v': p_retailprice, 'p': r, 'w': 0.6::DOUBLE}}, {{'axis': 'Cost', 'pos': 0, 'k': 1, 'f': 'p_size', 'v': p_size, 'p': s, 'w': 0.4::DOUBLE}},
  {{'axis': 'Demand', 'pos': 1, 'k': 0, 'f': 'sold', 'v': sold, 'p': d, 'w': 0.7::DOUBLE}}, {{'axis': 'Demand', 'pos': 1, 'k': 1, 'f': 'p_size', 'v': p_size, 'p': s, 'w': 0.3::DOUBLE}},
  {{'axis': 'Stock', 'pos': 2, 'k': 0, 'f': 'sold', 'v': sold, 'p': d, 'w': 1::DOUBLE}}], recursive := true) FROM q),
c AS (SELECT p_partkey, axis, any_value(pos) AS axis_pos, sum(w * p) / nullif(sum(w) FILTER (p IS NOT NULL), 0) AS score,
  string_agg(CASE WHEN v IS NULL THEN f || ' high vs reference' ELSE concat(f, '=', printf('%.3g', v), ' (percentile ', printf('%.2f', p), ')') END, '; ' ORDER BY coalesce(p, -1) DESC, k) AS main_features FROM w GROUP BY p_partkey, axis)
SELECT p_partkey, axis, axis_pos::BIGINT AS axis_pos, CASE WHEN axis <> 'Demand' THEN round(score, 6) END AS risk_score,
  CASE WHEN axis = 'Demand' THEN 'not assigned' WHEN score IS NULL THEN 'unknown' WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS risk_label, main_features,
  CASE axis WHEN 'Cost' THEN 'cost' WHEN 'Demand' THEN 'demand' ELSE 'stock' END AS suggested_assay, CASE axis WHEN 'Cost' THEN 'medium' ELSE 'low' END AS confidence FROM c
UNION ALL SELECT p_partkey, 'Bulk network / viscosity', 3, CASE WHEN p_partkey % 2 = 0 THEN round(p_size / 50, 6) END,
  CASE WHEN p_partkey % 2 = 1 THEN 'unknown' WHEN p_size / 50 >= 0.75 THEN 'high' WHEN p_size / 50 >= 0.5 THEN 'medium' ELSE 'low' END,
  CASE WHEN p_partkey % 2 = 0 THEN concat('network_risk_score=', printf('%.3g', p_size / 50), '; mapped_regime=', p_brand, '; mapped_mean_degree=', printf('%.3g', p_retailprice / 7e6::DOUBLE)) ELSE 'network projection not supplied' END,
  'HAC / high-concentration viscosity', CASE WHEN p_partkey % 2 = 0 THEN 'low-medium' ELSE 'low' END FROM f""",
    "feature_families": """WITH f AS (SELECT concat(['vh_', 'vl_', 'heavy_cdr_', 'light_cdr_', 'fv_cdr_', 'cdr_', 'fv_', ''][p_size % 8 + 1],
  ['net_charge', 'hydrophobic_fraction', 'positive_count', 'length', 'aromatic_fraction', 'charge_imbalance', 'hydrophobicity_asymmetry', 'other', 'lys_arg_asymmetry', 'h3_length', 'size_imbalance'][p_partkey % 11 + 1]) AS f FROM part),
g AS (SELECT f, CASE WHEN f LIKE 'vh\\_%' ESCAPE '\\' THEN 'vh' WHEN f LIKE 'vl\\_%' ESCAPE '\\' THEN 'vl' WHEN starts_with(f, 'heavy_cdr_') THEN 'heavy_cdr' WHEN starts_with(f, 'light_cdr_') THEN 'light_cdr' WHEN starts_with(f, 'fv_cdr_') OR starts_with(f, 'cdr_') THEN 'cdr' ELSE 'global' END AS r,
  CASE WHEN contains(f, 'hydrophobic') OR contains(f, 'aromatic') THEN 'hydrophobic_aromatic' WHEN contains(f, 'charge') OR contains(f, 'positive') OR contains(f, 'negative') OR contains(f, 'lys_arg') OR contains(f, 'acid_base') THEN 'charge' WHEN contains(f, 'length') THEN 'length' WHEN contains(f, 'imbalance') OR contains(f, 'asymmetry') THEN 'imbalance' ELSE 'composition_other' END AS c FROM f)
SELECT r AS chain_region, c AS chemistry, r IN ('heavy_cdr', 'light_cdr', 'cdr') AS is_cdr, r IN ('vh', 'vl') AS is_framework_or_full_variable, count(*) AS n, count(DISTINCT f) AS n_features FROM g GROUP BY ALL""",
    "grouped_importance": f"WITH {ORDER_LINES} SELECT grp, 'charge' AS chemistry, {r6('spearman', 'importance')} FROM ({spearman('ol', 'grp', 't', 'p')}) UNION ALL SELECT grp, NULL, round(spearman, 6) FROM ({spearman('ol', 'grp', 't', 'qty')})",
    "residualize": f"WITH {ORDER_LINES}, r AS (SELECT o_orderstatus, t, t - avg(t) OVER (PARTITION BY grp, o_orderstatus) AS res FROM ol) SELECT o_orderstatus, count(*) AS n, round(avg(res), 6) + 0 AS residual_mean, {r6('stddev_pop(res)', 'residual_sd')}, {r6('1 - var_pop(res) / var_pop(t)', 'r2')} FROM r GROUP BY 1",
    "residual_nulls": f"""WITH {ORDER_LINES}, ob AS (SELECT grp, round(spearman, 9) AS o FROM ({spearman('ol', 'grp', 't', 'p')})), nu AS ({null_rows()})
SELECT grp, round(any_value(o), 6) AS observed, count(*) AS n_null, {r6('avg(v)', 'null_mean')}, {r6('quantile_cont(v, 0.95)', 'null_q95')}, {r6('(1 + count(*) FILTER (v >= o)) / (count(*) + 1)::DOUBLE', 'empirical_p')} FROM nu JOIN ob USING (grp) GROUP BY grp""",
    "bootstrap_mean_ci": f"""WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, sqrt(abs(s_acctbal)) AS x, count(*) OVER () AS n FROM supplier WHERE s_acctbal IS NOT NULL),
k AS (SELECT b, ('0x' || substring(md5(concat_ws('|', '7', b, i)), 1, 8))::BIGINT % n AS j FROM r, range(50) q(b)), m AS (SELECT b, avg(x) AS m FROM k JOIN r ON r.i = k.j GROUP BY b)
SELECT {r6('avg(m)', 'mean')}, {r6('stddev_pop(m)', 'sd')}, {r6('quantile_cont(m, 0.025)', 'low')}, {r6('quantile_cont(m, 0.975)', 'high')} FROM m""",
    "archetypes": f"WITH {ARCHETYPES} SELECT archetype, count(*) AS n FROM ar GROUP BY 1",
    "medoids": f"""WITH {ARCHETYPES}, ce AS (SELECT archetype, median(net) AS a, median(cdr) AS b, median(imbalance) AS c, median(hydro) AS d, count(*) AS n FROM ar GROUP BY 1),
g AS (SELECT archetype, n, c_custkey, round(abs(net - a) + abs(cdr - b) + abs(imbalance - c) + abs(hydro - d), 9) AS distance FROM ar JOIN ce USING (archetype))
SELECT archetype, n, c_custkey, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY distance, c_custkey) AS k FROM g) WHERE k = 1""",
    "regime_projection": f"""WITH {CUSTOMERS}, {REGIME_POINTS}, q AS (SELECT c_custkey, least(greatest(cdr + 1, 0), 4) AS a, least(greatest(net / 3.7::DOUBLE, 0), 1.5) AS r, imbalance % 3 * 2 + 1 AS v FROM cu),
d AS (SELECT c_custkey, point, o, round(abs(a - ra) + abs(r - rr) + 0.5::DOUBLE * abs(v - rv), 9) AS gap FROM q, rp)
SELECT c_custkey, point AS mapped_point, round(gap, 6) AS mapping_distance, {r6('round(o / 5, 6) + round(o / 8, 6) + 0.25::DOUBLE * round(o + 1, 6) - 0.25::DOUBLE * round(0.5::DOUBLE - o / 10, 6)', 'network_risk_score')}
FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY gap, point) AS k FROM d) WHERE k = 1""",
    "calibrate_grid": f"WITH {CUSTOMERS}, {GRID}, s AS ({grid_scores('cu', '')}) SELECT g, a, b, n, spearman, abs(spearman) AS abs_spearman, row_number() OVER (ORDER BY abs(spearman) DESC NULLS LAST, g) AS rank FROM s",
    "leave_group_out": f"""WITH {CUSTOMERS}, {GRID}, pa AS (SELECT DISTINCT c_custkey % 4 AS held FROM cu), re AS (SELECT held, net, cdr, hydro FROM cu JOIN pa ON c_custkey % 4 <> held), ow AS (SELECT c_custkey % 4 AS held, net, cdr, hydro FROM cu),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY abs(spearman) DESC NULLS LAST, g) AS k FROM ({grid_scores('re', 'held')})) WHERE k = 1), o AS ({grid_scores('ow', 'held')})
SELECT f.held, f.g, f.spearman AS training_spearman, o.spearman AS heldout_spearman, o.n AS heldout_n FROM f JOIN o ON o.held = f.held AND o.g = f.g""",
    "text_numbers": f"WITH n AS (SELECT page_id, {NUMBERS.format('url')} AS v FROM pages) SELECT page_id, len(v)::BIGINT AS n_numbers, coalesce(v[1], -1) AS first_number, coalesce(list_max(v), -1) AS max_number FROM n",
    "text_condition_flags": f"""WITH n AS (SELECT event_id, event_type, value / 10 AS ph, coalesce(list_max({NUMBERS.format('props')}), 0) AS salt FROM events), m AS (SELECT *, sqrt(50 / (50 + salt)) AS sc, least(greatest(1 + 0.12::DOUBLE * (7.4::DOUBLE - ph), 0.4::DOUBLE), 1.8::DOUBLE) AS pf FROM n)
SELECT event_id, salt, {r6('sc', 'screening')}, (salt > 0 AND salt <= 50)::INT::DOUBLE AS low_salt, (salt >= 90)::INT::DOUBLE AS high_salt, regexp_matches(lower(event_type), 'click|view')::INT::DOUBLE AS contact, {r6('pf', 'ph_factor')}, {r6('sc * pf', 'attraction_factor')}, {r6('sc / pf', 'repulsion_factor')} FROM m""",
    "surface_mask": f"""WITH {POINTS}, e AS ({edges(10, strict=True)}), n AS (SELECT pt.vec_id, pt.sid, (SELECT count(*) FROM e WHERE e.src = pt.vec_id OR e.dst = pt.vec_id) AS n_near FROM pt)
SELECT vec_id, sid, n_near, n_near <= quantile_cont(n_near, 0.45) OVER (PARTITION BY sid) AS is_surface FROM n""",
    "contact_graph": f"WITH {POINTS} SELECT sid, src, dst, round(distance, 6) AS distance FROM ({edges(10)})",
    "patch_components": f"WITH RECURSIVE {POINTS}, ch AS (SELECT * FROM pt WHERE cls = 'pos'), {reach('ch', 'SELECT src, dst FROM (' + edges(12, 'ch') + ')')} SELECT sid, vec_id, component FROM ch JOIN comp ON v = vec_id",
    "patch_summary": f"""WITH RECURSIVE {POINTS}, ch AS (SELECT * FROM pt WHERE cls = 'pos'), {reach('ch', 'SELECT src, dst FROM (' + edges(12, 'ch') + ')')},
s AS (SELECT sid, component, count(*) AS size, avg(is_cdr::INT) AS share FROM ch JOIN comp ON v = vec_id GROUP BY 1, 2)
SELECT sid, count(*) AS n_patches, max(size) AS largest, {r6('avg(size)', 'mean_size')}, round(first(share ORDER BY size DESC, component), 6) AS largest_cdr_fraction FROM s GROUP BY sid""",
    "spread_components": f"WITH RECURSIVE {POINTS}, {reach('pt', 'SELECT src, dst FROM (' + edges(6, same='true') + ')')} SELECT v AS vec_id, component FROM comp",
    "adjacency_summary": f"""WITH {POINTS}, e AS ({edges(12)}), m AS (SELECT e.sid, (a.cls = 'pos' AND b.cls = 'neg') OR (a.cls = 'neg' AND b.cls = 'pos') AS unlike FROM e JOIN pt a ON a.vec_id = src JOIN pt b ON b.vec_id = dst)
SELECT sid, count(*) FILTER (unlike) AS n_edges, {r6('count(*) FILTER (unlike) / count(*)::DOUBLE', 'edge_fraction')} FROM m GROUP BY sid""",
    "centroid_distance": f"WITH {POINTS} SELECT sid, {r6('sqrt(' + ' + '.join(f"(avg({c}) FILTER (cls = 'pos') - avg({c}) FILTER (cls = 'neg')) ** 2" for c in 'xyz') + ')', 'centroid_distance')} FROM pt GROUP BY sid",
    "dipole": f"WITH {POINTS}, q AS (SELECT *, CASE cls WHEN 'pos' THEN 1.0::DOUBLE WHEN 'neg' THEN -1 ELSE 0 END AS q FROM pt) SELECT sid, sum(q) AS net_charge, {r6('sqrt(' + ' + '.join(f'(sum(q * {c}) - sum(q) * avg({c})) ** 2' for c in 'xyz') + ')', 'dipole')} FROM q GROUP BY sid",
    "scramble_derange": f"WITH {POINTS} {deranged('pt', 'sid', 'vec_id', 'cls', 7, 'sid, vec_id, cls')}",
    "label_shuffle": f"WITH {POINTS} {shuffled('pt', 'sid', 'vec_id', 'cls', 7, 'd.sid AS sid, d.vec_id AS vec_id, d.cls AS cls')}",
    "scramble_diagnostics": f"WITH {POINTS} " + " UNION ALL ".join(f"SELECT sid, {s}::BIGINT AS replicate, count(*) AS n, {r6('avg((cls <> scrambled)::INT)', 'moved_fraction')}, bool_or(non_derangeable) AS non_derangeable FROM ({deranged('pt', 'sid', 'vec_id', 'cls', s, 'sid, cls')}) GROUP BY sid" for s in (1, 2, 3)),
    "gate_verdict": f"""WITH {ORDER_LINES}, {blocks()}, {GATE}
SELECT assay, n, NULL::DOUBLE AS "global", round(surface, 6) AS surface, round(real, 6) AS real, round(sm, 6) AS scrambled_mean, round(ss, 6) AS scrambled_sd, round(lm, 6) AS shuffle_mean, round(ls, 6) AS shuffle_sd, round(real - surface, 6) AS delta_surface, round(real - sm, 6) AS delta_scrambled,
CASE WHEN abs(lm) >= 0.15 THEN 'NEGATIVE CONTROL FAIL' ELSE concat(CASE WHEN real - sm > 0.05 AND real > sm + ss AND real - surface > 0.05 THEN 'PASS' WHEN real - sm > 0.05 AND real > sm + ss THEN 'WEAK PASS' ELSE 'FAIL' END, CASE WHEN n > 0 AND n < 100 THEN '; LOW-N CAUTION' ELSE '' END) END AS verdict FROM g""",
    "positive_controls": f"""WITH {ORDER_LINES}, {blocks()}, {GATE}, k AS (SELECT *, CASE left(assay, 1) WHEN '1' THEN 'composition' WHEN '4' THEN 'composition' WHEN '3' THEN 'shuffled' ELSE 'topology' END AS kind FROM g),
d AS (SELECT *, CASE kind WHEN 'composition' THEN real - surface WHEN 'topology' THEN real - sm ELSE real END AS dd FROM k)
SELECT concat('positive_control_', kind, ':', assay) AS assay, round(surface, 6) AS surface, round(real, 6) AS real, round(sm, 6) AS scrambled_mean, round(ss, 6) AS scrambled_sd, round(dd, 6) AS diagnostic_delta,
CASE WHEN CASE kind WHEN 'composition' THEN abs(dd) <= 0.10 WHEN 'topology' THEN dd > 0.15 AND real > sm + ss ELSE abs(dd) <= 0.15 END THEN 'PASS' ELSE 'FAIL' END AS verdict FROM d""",
    "zscore_signal": f"WITH z AS (SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS b, (s_suppkey - avg(s_suppkey) OVER ()) / stddev_samp(s_suppkey) OVER () AS k FROM supplier) SELECT s_suppkey, {r6('b', 'z_balance')}, {r6('b - k', 'excess')} FROM z",
    "vector_pair_blocks": f"""WITH p AS (SELECT a.vec_id // 2 AS pair, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
SELECT pair, {r6('sum(x)', 'vh')}, {r6('sum(y)', 'vl')}, {r6('sum((x + y) / 2)', 'mean')}, {r6('sum(x - y)', 'diff')}, {r6('sum(abs(x - y))', 'absdiff')}, {r6('sum(x * y)', 'prod')} FROM p GROUP BY pair""",
    "mean_pool": f"""WITH p AS (SELECT label, (vec_id % 3 <> 0)::INT AS m, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT label::BIGINT AS label, i::BIGINT AS i, {r6('sum(x * m) / greatest(sum(m), 1)', 'x')} FROM p GROUP BY label, i""",
    "edge_turnover": """WITH e AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE) AS day, user_id, event_type FROM events), d AS (SELECT DISTINCT day FROM e),
s AS (SELECT d.day, (SELECT count(*) FROM e WHERE e.day = d.day) AS n, (SELECT count(*) FROM e WHERE e.day = d.day - 1) AS b, (SELECT count(*) FROM e x JOIN e y ON y.day = x.day - 1 AND y.user_id = x.user_id AND y.event_type = x.event_type WHERE x.day = d.day) AS k FROM d)
SELECT day::BIGINT AS day, n AS n_edges, round(1 - k / (n + b - k)::DOUBLE, 6) AS edge_turnover FROM s""",
    "contact_lifetimes": """WITH e AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE) AS day, user_id, event_type FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id, event_type ORDER BY day) AS k FROM e),
r AS (SELECT event_type, count(*) AS l FROM i GROUP BY user_id, event_type, k) SELECT event_type, count(*) AS n_runs, round(avg(l), 6) AS lifetime_mean, round(quantile_cont(l, 0.9), 6) AS lifetime_p90, max(l) AS lifetime_max FROM r GROUP BY 1""",
    "set_ops": """WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k FROM orders)
SELECT 'union_all' AS op, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS total FROM (SELECT k FROM a UNION ALL SELECT k FROM b) UNION ALL SELECT 'union', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'intersect', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'common', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT DISTINCT k FROM a WHERE k IN (SELECT k FROM b))""",
    "surface_composition": f"""WITH r AS (SELECT concat('ab', label) AS structure_id, embedding[4] > 0 AS is_cdr, (((floor(embedding[6]::DOUBLE * 1000)::INT % 8) + 8) % 8) + 1 AS k FROM embeddings),
n AS (SELECT structure_id, is_cdr, (['LYS', 'ASP', 'HIS', 'PHE', 'ALA', 'GLU', 'ARG', 'GLY'])[k] AS res FROM r)
SELECT structure_id, count(*)::DOUBLE AS surface_residue_count, {r6('avg(is_cdr::INT)', 'surface_cdr_fraction')}, (count(*) FILTER (is_cdr AND res IN ('LYS', 'ARG', 'HIS')))::DOUBLE AS surface_cdr_positive_count,
{r6("count(*) FILTER (NOT is_cdr AND res IN ('ASP', 'GLU')) / count(*) FILTER (NOT is_cdr)::DOUBLE", 'surface_framework_negative_fraction')}, (count(*) FILTER (res = 'PHE'))::DOUBLE AS surface_all_aromatic_count,
{r6("count(*) FILTER (res IN ('PHE', 'ALA')) / count(*)::DOUBLE", 'surface_all_hydrophobic_fraction')} FROM n GROUP BY 1""",
    "region_positions": """WITH c AS (SELECT item_id, i, text[i + 1] AS ch FROM (SELECT item_id, text, unnest(range(length(text))) AS i FROM benchmark)),
p AS (SELECT item_id, i, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS pos, (i >= 25 AND i < 42) OR (i >= 56 AND i < 76) OR (i >= 105 AND i < 138) AS inside FROM c WHERE ch NOT IN (' ', '-'))
SELECT item_id, count(*) AS n, count(*) FILTER (inside) AS n_region, min(pos) FILTER (inside) AS first_region FROM p GROUP BY 1""",
    "average_ranks": f"SELECT p_partkey, p_brand, {rank('p_size', 'p_brand')} AS rank FROM part",
    "region_totals": f"WITH {POINTS} SELECT sid, coalesce(region, 'all') AS region, count(*) AS n, count(*) FILTER (cls = 'pos') AS n_pos, {r6("avg((cls = 'neg')::INT)", 'neg_fraction')} FROM (SELECT *, CASE WHEN is_cdr THEN 'cdr' ELSE 'framework' END AS region FROM pt) GROUP BY GROUPING SETS ((sid, region), (sid))",
    "particle_parameters": f"""WITH {CUSTOMERS}, d AS (SELECT c_custkey, net * 3.0917::DOUBLE AS q, least((abs(cdr) + 0.5::DOUBLE * imbalance) / 14, 1) AS di, least(greatest((hydro * 1.0137::DOUBLE - 0.28::DOUBLE) / 0.28::DOUBLE, 0), 1) AS st FROM cu)
SELECT c_custkey, {r6('0.2::DOUBLE + 1.4::DOUBLE * di', 'fab_charge_strength')}, {r6('0.15::DOUBLE + 0.8::DOUBLE * least(abs(q) / 18, 1)', 'core_charge_strength')}, {r6('0.1::DOUBLE + 1.2::DOUBLE * least(abs(q) / 24, 1)', 'same_charge_repulsion')},
{r6('0.05::DOUBLE + 1.1::DOUBLE * st', 'hydrophobic_attraction')}, least(greatest(ceil(1 + di + st), 1), 4)::BIGINT AS patch_valence FROM d""",
}
