"""DuckDB twins of the registered queries, as one chain of common table expressions.

Parameters are those of registry.PARAMS: 48 lags, 12 steps, period and store stride 24,
query stride 6, 5 neighbours, ratios 0.3/0.35/0.15/0.2.
"""

from __future__ import annotations

CHAIN = """
ev AS (SELECT event_type AS series_name, date_trunc('hour', ts) AS bin, ts, event_id, value FROM events),
span AS (SELECT min(bin) AS lo, max(bin) AS hi FROM ev),
spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
names AS (SELECT series_name, (row_number() OVER (ORDER BY series_name) - 1)::BIGINT AS series_id FROM (SELECT DISTINCT series_name FROM ev)),
bins AS (SELECT series_name, bin AS ts, sum(value) AS total, avg(value) AS mean, arg_min(value, (ts, event_id)) AS head, arg_max(value, (ts, event_id)) AS tail
         FROM ev GROUP BY ALL),
whole AS (SELECT ts FROM bins GROUP BY ts HAVING count(*) = (SELECT count(*) FROM names)),
series AS (
  SELECT (row_number() OVER (PARTITION BY n.series_id ORDER BY s.ts) - 1)::BIGINT AS t, s.ts, n.series_id, n.series_name, coalesce(b.total, 0) AS value
  FROM spine s CROSS JOIN names n LEFT JOIN bins b ON b.series_name = n.series_name AND b.ts = s.ts
),
n AS (SELECT (max(t) + 1)::BIGINT AS n FROM series),
bounds AS (
  SELECT round_even(n * 0.3::DOUBLE, 0)::BIGINT AS t0_end, round_even(n * (0.3::DOUBLE + 0.35::DOUBLE), 0)::BIGINT AS t1_end,
         round_even(n * (0.3::DOUBLE + 0.35::DOUBLE + 0.15::DOUBLE), 0)::BIGINT AS t2_end, n AS t3_end FROM n
),
cut AS (SELECT series_id, t, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) AS v FROM series),
windows AS (
  SELECT series_id, t, v[1:48] AS x, v[49:60] AS y, list_avg(v[1:48]) AS mu, list_stddev_pop(v[1:48]) AS sd FROM cut WHERE len(v) = 60
),
feats AS (SELECT *, list_transform(x, lambda e: (e - mu) / (sd + 1e-8)) AS feat FROM windows),
periods AS (
  SELECT 'train' AS split, t0_end AS lo, t1_end - 60 AS hi FROM bounds UNION ALL SELECT 'oracle', t1_end, t2_end - 60 FROM bounds
  UNION ALL SELECT 'eval', t2_end, t3_end - 60 FROM bounds
),
q AS (SELECT p.split, f.* FROM feats f JOIN periods p ON f.t >= p.lo AND f.t <= p.hi AND (f.t - p.lo) % 6 = 0),
store AS (
  SELECT q.*, q.t % 24 AS lo, q.t % 24 + (q.t - 60 - q.t % 24) // 24 * 24 AS hi, (q.t - 60 - q.t % 24) // 24 + 1 AS keep_n FROM q WHERE q.t >= 60 AND q.t - 60 >= q.t % 24
),
near AS (
  SELECT a.split, a.t AS qt, a.series_id AS qu, s.t AS nt, s.series_id AS nu, list_distance(a.feat, s.feat) AS distance
  FROM store a JOIN feats s ON a.t % 24 = s.t % 24 AND s.t BETWEEN a.lo AND a.hi
),
knn AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY split, qt, qu ORDER BY distance, nu, nt))::BIGINT AS rank FROM near) WHERE rank <= 5),
found AS (
  SELECT k.*, w.x AS xc, w.y AS yc, w.mu AS mu_c, w.sd AS sd_c, a.mu, a.sd
  FROM knn k JOIN windows w ON w.t = k.nt AND w.series_id = k.nu JOIN q a ON a.split = k.split AND a.t = k.qt AND a.series_id = k.qu
),
scaled AS (
  SELECT *, list_transform(yc, lambda e: (e - mu_c) / greatest(sd_c, 1e-8) * greatest(sd, 1e-8) + mu) AS ys,
         list_transform(yc, lambda e: (e - xc[48]) / greatest(sd_c, 1e-8) * greatest(sd, 1e-8)) AS es FROM found
),
weighed AS (
  SELECT *, exp(-(distance - min(distance) OVER g) / greatest(stddev_pop(distance) OVER g, 1e-8)) AS e0 FROM scaled WINDOW g AS (PARTITION BY split, qt, qu)
),
weights AS (SELECT *, e0 / sum(e0) OVER (PARTITION BY split, qt, qu) AS w FROM weighed),
steps AS (
  SELECT w.split, w.qt, w.qu, h.h, sum(w.w * w.ys[h.h]) AS yw, sum(w.w * w.es[h.h]) AS ew, avg(w.ys[h.h]) AS ym
  FROM weights w, (SELECT unnest(range(1, 13)) AS h) h GROUP BY ALL
),
p AS (
  SELECT s.*, q.x[48] AS pred, 0.5 * q.x[24 + s.h] + 0.5 * s.ym AS pred_ctx, q.y[s.h] AS y, q.mu, q.sd, greatest(q.sd, 1e-8) AS scale
  FROM steps s JOIN q ON q.split = s.split AND q.t = s.qt AND q.series_id = s.qu
),
losses AS (
  SELECT split, qt, qu, any_value(sd) AS sd, avg((pred - y) ** 2) AS mse, avg(abs(pred - y)) AS mae, avg(((pred - y) / scale) ** 2) AS nmse,
         avg((pred_ctx - y) ** 2) AS mse_ctx, avg(((pred_ctx - y) / scale) ** 2) AS nmse_ctx, avg((pred - y) ** 2 - (pred_ctx - y) ** 2) AS target,
         avg(pred_ctx - pred) AS shift_mean, stddev_pop(pred_ctx - pred) AS shift_std, avg(yw - pred) AS yw_shift, avg(ew) AS ew_mean
  FROM p GROUP BY split, qt, qu
),
nstats AS (
  SELECT split, qt, qu, avg(distance) AS d_mean, stddev_pop(distance) AS d_std, count(*) AS k, avg((nu = qu)::INT::DOUBLE) AS same, avg((qt - nt)::DOUBLE) AS age,
         stddev_pop((qt - nt)::DOUBLE) AS age_std, avg(mu_c) AS mu_mean, stddev_pop(mu_c) AS mu_std, avg(sd_c) AS sd_mean, stddev_pop(sd_c) AS sd_std,
         stddev_pop(w) AS w_std, max(w) AS w_max
  FROM weights GROUP BY split, qt, qu
),
lam AS (
  SELECT greatest(0, least(1, sum((yw - pred) * (y - pred)) / (1.001 * sum((yw - pred) ** 2)))) AS lh,
         greatest(0, least(1, sum(ew * (y - pred)) / (1.001 * sum(ew ** 2)))) AS lr FROM p WHERE split = 'train'
),
methods AS (
  SELECT split, qt, qu, h, y, scale, unnest([
    {'m': 'vanilla', 'v': pred}, {'m': 'context_forecast', 'v': pred_ctx}, {'m': 'horizon_knn_weighted', 'v': yw}, {'m': 'horizon_knn_mean', 'v': ym},
    {'m': 'residual_knn_weighted', 'v': pred + ew}, {'m': 'horizon_mix_scalar', 'v': pred + (yw - pred) * lh}, {'m': 'residual_mix_scalar', 'v': pred + ew * lr}
  ]) AS z FROM p, lam
),
scores AS (
  SELECT split, z.m AS method, avg((z.v - y) ** 2) AS mse, avg(abs(z.v - y)) AS mae, avg(((z.v - y) / scale) ** 2) AS nmse FROM methods GROUP BY ALL
),
bayes AS (SELECT h, avg((pred - y) ** 2 - (pred_ctx - y) ** 2) AS g FROM p WHERE split = 'oracle' GROUP BY h),
gated AS (
  SELECT p.*, CASE WHEN (SELECT avg((pred - y) ** 2 - (pred_ctx - y) ** 2) FROM p WHERE split = 'oracle') > 0 THEN p.pred_ctx ELSE p.pred END AS bayes_scalar,
         CASE WHEN b.g > 0 THEN p.pred_ctx ELSE p.pred END AS bayes_step,
         CASE WHEN l.mse_ctx < l.mse THEN p.pred_ctx ELSE p.pred END AS oracle_scalar,
         CASE WHEN (p.pred_ctx - p.y) ** 2 < (p.pred - p.y) ** 2 THEN p.pred_ctx ELSE p.pred END AS oracle_step
  FROM p JOIN bayes b USING (h) JOIN losses l USING (split, qt, qu)
),
gate AS (SELECT split, qt, qu, round(-shift_mean, 6) AS score, round(target, 6) AS target FROM losses WHERE split = 'eval'),
peers AS (SELECT score, count(*) FILTER (target > 0) AS pos, count(*) FILTER (target <= 0) AS neg FROM gate GROUP BY score),
curve AS (
  SELECT score, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER d / (SELECT sum(pos) FROM peers)::DOUBLE AS tpr,
         sum(neg) OVER d / (SELECT sum(neg) FROM peers)::DOUBLE AS fpr FROM peers WINDOW d AS (ORDER BY score DESC)
),
records AS (
  SELECT m.split, z.m AS method, n.series_name AS dataset, '48_' || g.g AS setting, avg(((z.v - y) / scale) ** 2) AS nmse
  FROM methods m JOIN names n ON n.series_id = m.qu, (VALUES (6), (12)) g(g) WHERE m.h <= g.g GROUP BY ALL
),
means AS (SELECT dataset, setting, method, avg(nmse) AS value FROM records WHERE lower(split) = 'eval' GROUP BY ALL),
levels AS (
  SELECT CASE WHEN grouping(dataset) = 0 THEN 'dataset' WHEN grouping(setting) = 0 THEN 'setting' ELSE 'overall' END AS level, dataset, setting, method, avg(value) AS value
  FROM means GROUP BY GROUPING SETS ((dataset, method), (setting, method), (method))
)
"""


def twin(final: str) -> str:
    return f"WITH {CHAIN.strip()}\n{final}"




def flat(keys: str, arrays: list[str], n: int, rows: str) -> str:
    """One row a place in the arrays."""
    columns = ", ".join(f"round({c}[i], 6) AS {c}" for c in arrays)
    return f"SELECT {keys}, i::BIGINT AS i, {columns} FROM ({rows}), (SELECT unnest(range(1, {n} + 1)) AS i)"


SERIES = "SELECT t, ts, series_id, series_name, round(value, 6) AS value FROM series"
DAILY = """
WITH d AS (SELECT o_orderpriority AS series_name, date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS value FROM orders GROUP BY ALL),
c AS (SELECT ts FROM d GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT o_orderpriority) FROM orders))
SELECT series_name, ts, round(value, 6) AS value FROM d SEMI JOIN c USING (ts)"""
WIDE = """
w AS (SELECT date_trunc('month', l_shipdate) AS ts, sum(l_quantity) FILTER (l_returnflag || l_linestatus = 'AF') AS af, sum(l_quantity) FILTER (l_returnflag || l_linestatus = 'NF') AS nf,
        sum(l_quantity) FILTER (l_returnflag || l_linestatus = 'NO') AS no, sum(l_quantity) FILTER (l_returnflag || l_linestatus = 'RF') AS rf FROM lineitem GROUP BY ALL)"""

#: The views of five methods' errors by some keys.
VIEWS = """
, viewed AS (
  SELECT {keys}, z.m AS method, avg(z.v - y) AS difference, avg((z.v - y) ** 2) AS mse, avg(((z.v - y) / scale) ** 2) AS nmse
  FROM methods WHERE z.m NOT LIKE '%mix%' GROUP BY ALL
),
shown AS (
  SELECT * EXCLUDE (r), max(r) OVER (PARTITION BY {keys}, metric) AS ref
  FROM (SELECT *, CASE WHEN method = 'vanilla' THEN direct END AS r FROM (UNPIVOT viewed ON difference, mse, nmse INTO NAME metric VALUE direct))
)"""
#: Ridge fits of the six trainable adapters by recursive elimination: own is the fit's group besides the step, match that of a row it predicts.
RIDGE = """
, fr AS (
  SELECT w.split, w.qt, w.qu, h.h, list(w.es[h.h] ORDER BY w.rank) AS es, list(w.ys[h.h] ORDER BY w.rank) AS ys FROM weights w, (SELECT unnest(range(1, 13)) AS h) h GROUP BY ALL
),
fp AS (SELECT p.*, f.es, f.ys FROM p JOIN fr f USING (split, qt, qu, h)),
fm AS (
  SELECT split, qt, qu, h, y, pred, scale, ew, yw, unnest([
    {'m': 'horizon_mix_scalar', 'g': -1, 'f': [yw - pred], 'z': y - pred}, {'m': 'residual_mix_scalar', 'g': -1, 'f': [ew], 'z': y - pred},
    {'m': 'residual_ridge_shared', 'g': -1, 'f': es, 'z': y - pred}, {'m': 'horizon_ridge_shared', 'g': -1, 'f': list_concat([pred], ys), 'z': y},
    {'m': 'residual_ridge_horizon', 'g': h, 'f': es, 'z': y - pred}, {'m': 'full_ridge_horizon', 'g': h, 'f': list_concat(list_concat([pred], ys), [pred_ctx]), 'z': y}
  ]) AS d FROM fp
),
fits AS (SELECT split AS fit, {own} AS own, d.m AS m, d.g AS g, d.f AS f, d.z AS z FROM fm WHERE split IN ({on})),
cells AS (
  SELECT fit, own, m, g, i.i, j.i AS j, count(*) AS n, sum(f[i.i] * CASE WHEN j.i > len(f) THEN z ELSE f[j.i] END) AS v
  FROM fits, (SELECT unnest(range(1, 8)) AS i) i, (SELECT unnest(range(1, 9)) AS i) j WHERE i.i <= len(f) AND j.i <= len(f) + 1 GROUP BY ALL
),
roots AS (SELECT fit, own, m, g, i, greatest(sqrt(v / n), 1e-12) AS s FROM cells WHERE i = j),
normal AS (
  SELECT c.fit, c.own, c.m, c.g, c.i, a.s, list(c.v / c.n / a.s / coalesce(b.s, 1) + CASE WHEN c.i = c.j THEN 0.001 ELSE 0 END ORDER BY c.j) AS line
  FROM cells c JOIN roots a ON (a.fit, a.own, a.m, a.g, a.i) = (c.fit, c.own, c.m, c.g, c.i) LEFT JOIN roots b ON (b.fit, b.own, b.m, b.g, b.i) = (c.fit, c.own, c.m, c.g, c.j) GROUP BY ALL
),
systems AS (SELECT fit, own, m, g, count(*) AS p, list(line ORDER BY i) AS a, list(s ORDER BY i) AS s FROM normal GROUP BY ALL),
elim AS (
  SELECT fit, own, m, g, p, s, 0 AS k, a FROM systems
  UNION ALL SELECT fit, own, m, g, p, s, k + 1, list_transform(range(1, p + 1), lambda i: CASE WHEN i = k + 1 THEN list_transform(a[i], lambda v: v / a[i][i])
    ELSE list_transform(range(1, p + 2), lambda j: a[i][j] - a[i][k + 1] / a[k + 1][k + 1] * a[k + 1][j]) END) FROM elim WHERE k < p
),
betas AS (
  SELECT fit, own, m, g, list_transform(range(1, p + 1), lambda i: CASE WHEN m LIKE '%mix_scalar' THEN greatest(0, least(1, a[i][p + 1] / s[i])) ELSE a[i][p + 1] / s[i] END) AS b FROM elim WHERE k = p
),
told AS (
  SELECT x.split, x.qt, x.qu, x.h, x.y, x.scale, x.d.m AS m, b.fit,
    CASE WHEN x.d.m LIKE '%ridge_shared' AND x.d.m LIKE 'horizon%' OR x.d.m LIKE 'full%' THEN list_dot_product(x.d.f, b.b) ELSE x.pred + list_dot_product(x.d.f, b.b) END AS v
  FROM fm x JOIN betas b ON b.m = x.d.m AND b.g = x.d.g AND b.own = {match}
)"""


def ridge(final: str, own: str = "0", match: str = "0", on: str = "'train'") -> str:
    """A query over the ridge fits; the whole chain is recursive then."""
    text = RIDGE.replace("{own}", own).replace("{match}", match).replace("{on}", on)
    return f"WITH RECURSIVE {CHAIN.strip()}\n{text.strip()}\n{final}"


SQL: dict[str, str] = {
    "resample_sum": twin(SERIES),
    "resample_mean_complete": DAILY.strip(),
    "resample_first": twin("SELECT series_name, ts, round(head, 6) AS value FROM bins SEMI JOIN whole USING (ts)"),
    "resample_last": twin("SELECT series_name, ts, round(tail, 6) AS value FROM bins SEMI JOIN whole USING (ts)"),
    "asfreq_grid": """
WITH d AS (SELECT o_orderpriority AS series_name, o_orderdate AS ts, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY)) AS ts FROM d),
k AS (SELECT d.* FROM d SEMI JOIN g USING (ts)),
c AS (SELECT ts FROM k GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT series_name) FROM d))
SELECT series_name, ts, round(value, 6) AS value FROM k SEMI JOIN c USING (ts)""",
    "complete_rows": f"WITH {WIDE.strip()} SELECT ts, round(af, 6) AS af, round(nf, 6) AS nf, round(rf, 6) AS rf, round(no, 6) AS no FROM w WHERE af IS NOT NULL AND nf IS NOT NULL AND rf IS NOT NULL",
    "drop_series": twin("SELECT t, series_name, round(value, 6) AS value FROM series WHERE series_id NOT IN (1) AND series_name <> (SELECT max(series_name) FROM names)"),
    "rename_series": twin("SELECT t, series_id, 'user_' || series_id AS series_name, round(value, 6) AS value FROM series"),
    "dense_position": twin("""SELECT (row_number() OVER (PARTITION BY series_name ORDER BY ts) - 1)::BIGINT AS t, ts, n.series_id, series_name, round(b.mean, 6) AS value
FROM bins b SEMI JOIN whole USING (ts) JOIN names n USING (series_name)"""),
    "split_bounds": twin("SELECT * FROM bounds"),
    "query_starts": twin("SELECT split, t, series_id FROM q"),
    "window_extract": twin(flat("series_id, t", ["x", "y"], 48, "SELECT * FROM windows")),
    "instance_norm": twin(flat("series_id, t", ["feat"], 48, "SELECT * FROM feats")),
    "window_stats": twin("SELECT series_id, t, round(mu, 6) AS mu, round(sd, 6) AS sd FROM windows"),
    "patch_unfold": twin(flat("series_id, t, patch", ["v"], 16, """
SELECT series_id, t, (k - 1)::BIGINT AS patch, list_slice(list_concat(x, [x[48], x[48], x[48], x[48], x[48], x[48], x[48], x[48]]), (k - 1) * 8 + 1, (k - 1) * 8 + 16) AS v
FROM windows, (SELECT unnest(range(1, 7)) AS k)""")),
    "moving_average": twin("""
, z AS (SELECT series_id, t, x, list_concat(list_concat([x[1], x[1]], x), [x[48], x[48]]) AS xp FROM windows),
m AS (SELECT series_id, t, x, list_transform(range(1, 49), lambda i: list_sum(xp[i:i + 4]) / 5) AS trend FROM z)
SELECT series_id, t, i::BIGINT AS i, round(trend[i], 6) AS trend, round(x[i] - trend[i], 6) AS residual FROM m, (SELECT unnest(range(1, 49)) AS i)"""),
    "store_online": twin("SELECT split, t, series_id, lo::BIGINT AS lo, hi::BIGINT AS hi, keep_n::BIGINT AS keep_n FROM store"),
    "store_fixed": twin("""
, f AS (SELECT split, t, series_id, t % 24 AS lo0, (SELECT t0_end FROM bounds) - 60 AS last FROM q)
SELECT split, t, series_id, lo0::BIGINT AS lo, (lo0 + (last - lo0) // 24 * 24)::BIGINT AS hi, ((last - lo0) // 24 + 1)::BIGINT AS keep_n FROM f WHERE last >= lo0"""),
    "store_capped": twin("""
, f AS (SELECT *, least(keep_n, 5, 40 // 5) AS kept FROM store WHERE keep_n >= 5)
SELECT split, t, series_id, (lo + (keep_n - kept) * 24)::BIGINT AS lo, hi::BIGINT AS hi, kept::BIGINT AS keep_n FROM f"""),
    "eligible_queries": twin("SELECT split, t, series_id FROM store WHERE keep_n >= 12"),
    "knn_euclidean": twin("SELECT split, qt, qu, rank, nt, nu, round(distance, 6) AS distance FROM knn"),
    "knn_cosine": twin("""
, d AS (SELECT a.split, a.t AS qt, a.series_id AS qu, s.t AS nt, s.series_id AS nu, 1 - list_dot_product(a.x, s.x) / greatest(sqrt(list_dot_product(a.x, a.x)), 1e-8) / greatest(sqrt(list_dot_product(s.x, s.x)), 1e-8) AS distance
 FROM store a JOIN feats s ON a.t % 24 = s.t % 24 AND s.t BETWEEN a.lo AND a.hi),
r AS (SELECT *, (row_number() OVER (PARTITION BY qt, qu ORDER BY distance, nu, nt))::BIGINT AS rank FROM d)
SELECT split, qt, qu, rank, nt, nu, round(distance, 6) AS distance FROM r WHERE rank <= 5"""),
    "knn_pearson": twin("""
, c AS (SELECT *, list_transform(x, lambda e: e - mu) AS z FROM feats),
u AS (SELECT *, list_transform(z, lambda e: e / greatest(sqrt(list_dot_product(z, z)), 1e-8)) AS v FROM c),
d AS (SELECT a.split, a.t AS qt, a.series_id AS qu, s.t AS nt, s.series_id AS nu, 1 - list_dot_product(b.v, s.v) AS distance
 FROM store a JOIN u b ON b.t = a.t AND b.series_id = a.series_id JOIN u s ON a.t % 24 = s.t % 24 AND s.t BETWEEN a.lo AND a.hi),
r AS (SELECT *, (row_number() OVER (PARTITION BY qt, qu ORDER BY distance, nu, nt))::BIGINT AS rank FROM d)
SELECT split, qt, qu, rank, nt, nu, round(distance, 6) AS distance FROM r WHERE rank <= 5"""),
    "neighbor_lookup": twin(flat("qt, qu, rank", ["xc", "yc"], 48, "SELECT * FROM found")),
    "leave_one_out_context": twin(flat("qt, qu, rank, other", ["y"], 12, """
SELECT a.qt, a.qu, a.rank, b.rank AS other, list_transform(b.yc, lambda e: (e - b.mu_c) / greatest(b.sd_c, 1e-8) * greatest(a.sd_c, 1e-8) + a.mu_c) AS y
FROM found a JOIN found b ON a.split = b.split AND a.qt = b.qt AND a.qu = b.qu AND a.rank <> b.rank""")),
    "same_series": twin("SELECT split, qt, qu, same AS same_user_fraction FROM nstats"),
    "persistence_forecast": twin("SELECT split, qt, qu, h - 1 AS h, round(pred, 6) AS pred FROM p"),
    "context_forecast": twin("SELECT split, qt, qu, h - 1 AS h, round(pred_ctx, 6) AS pred FROM p"),
    "linear_forecast": twin("""
SELECT split, t AS qt, series_id AS qu, h::BIGINT AS h, round(list_sum(list_transform(range(1, 49), lambda i: x[i] * ((h + 1) * i / 2311.0::DOUBLE))) + h, 4) AS pred
FROM q, (SELECT unnest(range(0, 12)) AS h)"""),
    "scale_transfer": twin(flat("split, qt, qu, rank", ["ys"], 12, "SELECT * FROM scaled")),
    "residual_transfer": twin(flat("split, qt, qu, rank", ["es"], 12, "SELECT * FROM scaled")),
    "payload": twin("""
SELECT split, qt, qu, rank, nt, nu, round(distance, 6) AS distance, round(mu_c, 6) AS mu, round(sd_c, 6) AS sd, i::BIGINT AS i, round(ys[i], 6) AS ys, round(es[i], 6) AS es
FROM scaled, (SELECT unnest(range(1, 13)) AS i)"""),
    "payload_shapes": twin("SELECT split, count(*)::BIGINT AS n, 48::BIGINT AS lags, 12::BIGINT AS horizon, min(k)::BIGINT AS k FROM nstats GROUP BY split"),
    "missing_splits": twin("SELECT split FROM (VALUES ('train'), ('oracle'), ('eval')) v(split) EXCEPT SELECT split FROM nstats WHERE split IN ('train', 'eval')"),
    "payload_alignment": twin("""
SELECT q.split, count(*)::BIGINT AS n, count(n.qt)::BIGINT AS other_n, count(n.qt)::BIGINT AS "both" FROM q LEFT JOIN nstats n ON n.split = q.split AND n.qt = q.t AND n.qu = q.series_id GROUP BY q.split"""),
    "merged_predictions": twin("SELECT split, qt, qu, h - 1 AS h, round(CASE WHEN split = 'eval' THEN pred_ctx ELSE pred END, 6) AS yhat FROM p"),
    "head_samples": twin("SELECT split, qt, qu FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY qt, qu) AS r FROM nstats) WHERE r <= 40"),
    "random_samples": twin("SELECT split, qt, qu FROM nstats ORDER BY md5('7|' || split || '|' || qt || '|' || qu), split, qt, qu LIMIT 60"),
    "single_precision": twin("SELECT t, series_id, round(value::FLOAT::DOUBLE, 6) AS value FROM series"),
    "plot_weights": twin("SELECT split, qt, qu, rank, round(exp(-distance) / sum(exp(-distance)) OVER (PARTITION BY split, qt, qu), 6) AS w FROM found"),
    "dashboard_features": twin("""
, z AS (SELECT *, exp(-distance) / sum(exp(-distance)) OVER (PARTITION BY split, qt, qu) AS pw FROM scaled),
zs AS (SELECT split, qt, qu, stddev_pop(pw) AS w_std, max(pw) AS w_max FROM z GROUP BY ALL),
zh AS (SELECT z.split, z.qt, z.qu, h.h, sum(pw * ys[h.h]) AS yw, sum(pw * es[h.h]) AS ew FROM z, (SELECT unnest(range(1, 13)) AS h) h GROUP BY ALL),
zm AS (SELECT zh.split, zh.qt, zh.qu, avg(zh.yw - p.pred) AS yw_shift, avg(zh.ew) AS ew_mean FROM zh JOIN p USING (split, qt, qu, h) GROUP BY ALL)
SELECT l.split, l.qt, l.qu, round(shift_mean, 6) AS context_shift_mean, round(shift_std, 6) AS context_shift_std, round(zm.yw_shift, 6) AS weighted_minus_pred_mean,
  round(zm.ew_mean, 6) AS weighted_residual_mean, round(a.mu, 6) AS query_mean, round(a.sd, 6) AS query_std, round(mu_mean, 6) AS neighbour_mean_mean, round(mu_std, 6) AS neighbour_mean_std,
  round(sd_mean, 6) AS neighbour_std_mean, round(sd_std, 6) AS neighbour_std_std, round(same, 6) AS same_user_ratio, round(age, 6) AS age_mean, round(zs.w_std, 6) AS weight_std,
  round(zs.w_max, 6) AS weight_max, round(d_mean, 6) AS distance_mean
FROM losses l JOIN nstats n USING (split, qt, qu) JOIN zs USING (split, qt, qu) JOIN zm USING (split, qt, qu) JOIN q a ON a.split = l.split AND a.t = l.qt AND a.series_id = l.qu"""),
    "optional_columns": twin("SELECT split, qt, qu, round(avg((pred_ctx - pred) ** 2), 6) AS disagreement, round(any_value(sd), 6) AS scale FROM p GROUP BY split, qt, qu"),
    "method_labels": twin("""
SELECT DISTINCT method, CASE method WHEN 'vanilla' THEN 'plain' WHEN 'context_forecast' THEN 'context' ELSE regexp_replace(method, '^horizon_(.*)$', 'H \\1') END AS label FROM means"""),
    "ridge_pair": twin("""
, g AS (SELECT split, h, count(*) AS n, sum(pred * pred) AS aa, sum(pred * pred_ctx) AS ab, sum(pred_ctx * pred_ctx) AS bb, sum(pred * y) AS ay, sum(pred_ctx * y) AS bys FROM p GROUP BY split, h),
u AS (SELECT *, greatest(sqrt(aa / n), 1e-12) AS sa, greatest(sqrt(bb / n), 1e-12) AS sb FROM g),
m AS (SELECT *, aa / n / sa / sa + 0.001 AS p11, ab / n / sa / sb AS p12, bb / n / sb / sb + 0.001 AS p22, ay / n / sa AS r1, bys / n / sb AS r2 FROM u)
SELECT split, h - 1 AS h, round((p22 * r1 - p12 * r2) / (p11 * p22 - p12 * p12) / sa, 5) AS b0, round((p11 * r2 - p12 * r1) / (p11 * p22 - p12 * p12) / sb, 5) AS b1 FROM m"""),
    "ridge_coefficients": ridge("SELECT m AS method, greatest(g - 1, 0)::BIGINT AS h, (i - 1)::BIGINT AS i, round(b[i], 5) AS value FROM betas, (SELECT unnest(range(1, 8)) AS i) WHERE i <= len(b)"),
    "ridge_scores": ridge("""
, both_ AS (
  SELECT split, m AS method, v, y, scale FROM told WHERE fit = 'train' UNION ALL SELECT split, m || '_eval_fit', v, y, scale FROM told WHERE fit = 'eval' AND split = 'eval'
  UNION ALL SELECT split, z.m, z.v, y, scale FROM methods WHERE z.m NOT LIKE '%mix_scalar'
),
sc AS (SELECT split, method, avg((v - y) ** 2) AS mse, avg(abs(v - y)) AS mae, avg(((v - y) / scale) ** 2) AS nmse FROM both_ GROUP BY ALL)
SELECT s.split, s.method, round(s.mse, 6) AS mse, round(s.mae, 5) AS mae, round(s.nmse, 6) AS nmse, round((r.nmse - s.nmse) / greatest(r.nmse, 1e-12) * 100, 5) AS relative_nmse_improvement_pct
FROM sc s JOIN sc r ON r.split = s.split AND r.method = 'vanilla'""", on="'train', 'eval'"),
    "ridge_by_series": ridge("""
SELECT split, m AS method, round(avg(((v - y) / scale) ** 2), 5) AS nmse FROM told WHERE m IN ('residual_ridge_shared', 'horizon_ridge_shared', 'horizon_mix_scalar') GROUP BY ALL""", own="qu", match="x.qu"),
    "random_draws": twin("""
, o AS (SELECT split, qt, qu, row_number() OVER (ORDER BY split, qt, qu) - 1 AS place FROM nstats),
d AS (SELECT draw, ('0x' || substr(md5('11|' || draw), 1, 13))::BIGINT % (SELECT count(*) FROM o) AS place FROM (SELECT unnest(range(0, 500)) AS draw))
SELECT draw::BIGINT AS draw, split, qt, qu FROM d JOIN o USING (place)"""),
    "merged_scores": twin("""
SELECT s.split, s.method, round(s.mse, 6) AS mse, round(s.mae, 5) AS mae, round(s.nmse, 6) AS nmse, round((r.nmse - s.nmse) / greatest(r.nmse, 1e-12) * 100, 5) AS relative_nmse_improvement_pct
FROM scores s JOIN scores r ON r.split = s.split AND r.method = 'vanilla' WHERE s.method NOT LIKE '%mix_scalar'"""),
    "fourier_features": twin("""
, fz AS (
  SELECT series_id, t, f.f, list_sum(list_transform(range(0, 48), lambda i: feat[i + 1] * cos(2 * pi() / 48 * f.f * i))) AS re, list_sum(list_transform(range(0, 48), lambda i: feat[i + 1] * sin(2 * pi() / 48 * f.f * i))) AS im
  FROM feats, (SELECT unnest(range(0, 48)) AS f) f
)
SELECT series_id, t, (f + 1)::BIGINT AS i, round(sqrt(re * re + im * im), 6) AS feat FROM fz"""),
    "attention_identity": twin("""
SELECT split, qt, qu, h - 1 AS h, round(1 / (1 + 3 * exp(-6.0::DOUBLE)) * pred + exp(-6.0::DOUBLE) / (1 + 3 * exp(-6.0::DOUBLE)) * (pred_ctx + 2 * pred), 6) AS yhat FROM p"""),
    "knn_blocked": twin("SELECT split, qt, qu, rank, nt, nu, round(distance, 6) AS distance FROM knn"),
    "window_losses": twin("SELECT split, qt, qu, round(mse, 6) AS mse, round(mae, 6) AS mae, round(nmse, 6) AS nmse FROM losses"),
    "loss_summary": twin("""
, l AS (SELECT split, qu, 'mse' AS metric, mse AS v FROM losses UNION ALL SELECT split, qu, 'mae', mae FROM losses UNION ALL SELECT split, qu, 'nmse', nmse FROM losses),
u AS (SELECT split, metric, qu, avg(v) AS v FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY split, metric ORDER BY v DESC, qu) AS r, count(*) OVER (PARTITION BY split, metric) AS n FROM u),
w AS (SELECT split, metric, avg(v) AS w FROM r WHERE r <= greatest(1, ceil(n * 0.1)) GROUP BY ALL)
SELECT l.split, l.metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(any_value(w.w), 6) AS w10_user_mean FROM l JOIN w USING (split, metric) GROUP BY l.split, l.metric"""),
    "user_losses": twin("SELECT split, qu, round(avg(nmse), 6) AS nmse_mean, round(stddev_samp(nmse), 6) AS nmse_std FROM losses GROUP BY split, qu"),
    "horizon_profile": twin("SELECT split, h - 1 AS h, round(avg((pred - y) ** 2), 6) AS mse FROM p GROUP BY split, h"),
    "distance_weights": twin("SELECT split, qt, qu, rank, round(w, 6) AS w FROM weights"),
    "knn_weighted": twin("SELECT split, qt, qu, h - 1 AS h, round(yw, 6) AS yw FROM p"),
    "knn_mean": twin("SELECT split, qt, qu, h - 1 AS h, round(ym, 6) AS ym FROM p"),
    "residual_knn": twin("SELECT split, qt, qu, h - 1 AS h, round(ew, 6) AS ew FROM p"),
    "mix_scalars": twin("SELECT round(lh, 6) AS horizon_mix, round(lr, 6) AS residual_mix FROM lam"),
    "method_scores": twin("""
SELECT s.split, s.method, round(s.mse, 6) AS mse, round(s.mae, 5) AS mae, round(s.nmse, 6) AS nmse, round((r.nmse - s.nmse) / greatest(r.nmse, 1e-12) * 100, 5) AS relative_nmse_improvement_pct
FROM scores s JOIN scores r ON r.split = s.split AND r.method = 'vanilla'"""),
    "feature_table": twin("""
SELECT l.split, l.qt, l.qu, round(l.mse, 6) AS base_loss, round(l.mse_ctx, 6) AS context_loss, round(least(l.mse, l.mse_ctx), 6) AS oracle_loss, l.mse_ctx < l.mse AS context_better,
  round((l.mse - l.mse_ctx) / greatest(l.mse, 1e-8) * 100, 5) AS improvement_pct, round(n.d_mean, 6) AS distance_mean, round(n.d_std, 6) AS distance_std, n.k::BIGINT AS neighbours,
  round(n.same, 6) AS same_user_fraction, round(n.age, 6) AS age_mean, round(n.age_std, 6) AS age_std, round(n.mu_mean, 6) AS neighbour_mean_mean, round(n.sd_std, 6) AS neighbour_std_std
FROM losses l JOIN nstats n USING (split, qt, qu)"""),
    "scale_quantiles": twin("""
SELECT split, round(min(sd), 6) AS q0, round(quantile_cont(sd, 0.001), 6) AS q0_1, round(quantile_cont(sd, 0.01), 6) AS q1, round(quantile_cont(sd, 0.05), 6) AS q5,
  round(quantile_cont(sd, 0.1), 6) AS q10, round(quantile_cont(sd, 0.5), 6) AS q50, count(*) FILTER (sd < 1e-8) AS below_1e8, count(*) FILTER (sd < 1e-6) AS below_1e6,
  count(*) FILTER (sd < 1e-3) AS below_1e3 FROM q GROUP BY split"""),
    "bayes_gates": twin("""
SELECT split, 'bayes_context_scalar' AS method, round(avg(((bayes_scalar - y) / scale) ** 2), 6) AS nmse FROM gated GROUP BY split
UNION ALL SELECT split, 'bayes_context_horizon', round(avg(((bayes_step - y) / scale) ** 2), 6) FROM gated GROUP BY split"""),
    "oracle_gates": twin("""
SELECT split, 'oracle_context_scalar' AS method, round(avg(((oracle_scalar - y) / scale) ** 2), 6) AS nmse FROM gated GROUP BY split
UNION ALL SELECT split, 'oracle_context_horizon', round(avg(((oracle_step - y) / scale) ** 2), 6) FROM gated GROUP BY split"""),
    "gate_features": twin("""
SELECT l.split, l.qt, l.qu, round(shift_mean, 6) AS context_shift_mean, round(shift_std, 6) AS context_shift_std, round(yw_shift, 6) AS weighted_minus_pred_mean, round(ew_mean, 6) AS weighted_residual_mean,
  round(a.mu, 6) AS query_mean, round(a.sd, 6) AS query_std, round(mu_mean, 6) AS neighbour_mean_mean, round(sd_mean, 6) AS neighbour_std_mean, round(sd_std, 6) AS neighbour_std_std,
  round(mu_std, 6) AS neighbour_mean_std, round(same, 6) AS same_user_ratio, round(age, 6) AS age_mean, round(w_std, 6) AS weight_std, round(w_max, 6) AS weight_max,
  round(d_mean, 6) AS distance_mean, round(target, 6) AS target
FROM losses l JOIN nstats n USING (split, qt, qu) JOIN q a ON a.split = l.split AND a.t = l.qt AND a.series_id = l.qu"""),
    "roc_curve": twin("SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM curve"),
    "roc_auc": twin("""
, a AS (SELECT (fpr - coalesce(lag(fpr) OVER (ORDER BY score DESC), 0)) * (tpr + coalesce(lag(tpr) OVER (ORDER BY score DESC), 0)) / 2 AS a FROM curve)
SELECT round((SELECT sum(a) FROM a), 6) AS auc, round(avg(((score > 0) = (target > 0))::INT::DOUBLE), 6) AS accuracy, count(*)::BIGINT AS n FROM gate"""),
    "threshold_sweep": twin("""
, s AS (SELECT min(score) AS lo, max(score) AS hi FROM gate), i AS (SELECT unnest(range(0, 101)) AS i),
g AS (SELECT gate.score, l.nmse, l.nmse_ctx, l.mse_ctx < l.mse AS better FROM gate JOIN losses l USING (split, qt, qu))
SELECT i.i::BIGINT AS i, round(any_value(lo + i.i * ((hi - lo) / 100)), 6) AS threshold, round(avg(((score > lo + i.i * ((hi - lo) / 100)) = better)::INT::DOUBLE) * 100, 6) AS right_pct,
  round(avg(CASE WHEN score > lo + i.i * ((hi - lo) / 100) THEN nmse_ctx ELSE nmse END), 6) AS nmse FROM g, s, i GROUP BY i.i"""),
    "gate_summary": twin("""
, d AS (SELECT g.split, g.qt, g.qu, sum((g.oracle_scalar - g.pred_ctx) ** 2) < sum((g.oracle_scalar - g.pred) ** 2) AS took, avg(((g.oracle_scalar - g.y) / scale) ** 2) AS nmse FROM gated g GROUP BY ALL)
SELECT d.split, 'oracle_context_scalar' AS method, round(avg(CASE WHEN abs(l.mse_ctx - l.mse) > 1e-12 THEN ((l.mse_ctx < l.mse) = took)::INT::DOUBLE END) * 100, 6) AS right_pct, round(avg(d.nmse), 6) AS nmse
FROM d JOIN losses l USING (split, qt, qu) GROUP BY d.split"""),
    "metric_views": twin("""
SELECT split, h - 1 AS h, round((avg(((pred - y) / scale) ** 2) - avg(((ym - y) / scale) ** 2)) / avg(((pred - y) / scale) ** 2), 6) AS value FROM p GROUP BY split, h"""),
    "step_views": twin(f"""{VIEWS.format(keys="split, h")}
SELECT split, method, h - 1 AS h, metric, round(direct, 5) AS direct, round(direct - ref, 5) AS improvement, CASE WHEN metric <> 'difference' AND abs(ref) > 1e-12 THEN round((direct - ref) / ref, 4) END AS relative
FROM shown"""),
    "window_views": twin(f"""{VIEWS.format(keys="split, qt, qu")}
SELECT split, method, qt, qu, metric, round(direct, 6) AS direct, round(direct - ref, 6) AS improvement, CASE WHEN metric <> 'difference' AND abs(ref) > 1e-12 THEN round((direct - ref) / ref, 4) END AS relative
FROM shown"""),
    "view_averages": twin(f"""{VIEWS.format(keys="split, h")}
{VIEWS.format(keys="split, qt, qu").replace("shown AS", "shown_w AS").replace("viewed", "viewed_w")}
, w AS (SELECT split, method, metric, avg(CASE WHEN abs(ref) > 1e-12 THEN (direct - ref) / ref END) AS window_relative FROM shown_w GROUP BY ALL)
SELECT split, method, metric, round(avg(direct), 4) AS direct, round(avg(direct - ref), 4) AS improvement, round(avg(CASE WHEN abs(ref) > 1e-12 THEN (direct - ref) / ref END), 4) AS relative,
  round(any_value(window_relative), 4) AS window_relative FROM shown JOIN w USING (split, method, metric) WHERE metric <> 'difference' GROUP BY split, method, metric"""),
    "batch_neighbours": twin(flat("split, qt, qu, rank", ["ys", "es"], 12, """
  SELECT split, qt, qu, rank, list_transform(ys, lambda e: (e - mu) / greatest(sd, 1e-8)) AS ys, list_transform(es, lambda e: e / greatest(sd, 1e-8)) AS es FROM scaled""")),
    "batch_restored": twin("SELECT split, qt, qu, h - 1 AS h, round((pred + pred_ctx) / 2, 6) AS yhat FROM p"),
    "batch_losses": twin("""
SELECT split, unnest(['instance', 'none']) AS how, round(avg(((pred_ctx - y) / scale) ** 2), 6) AS loss FROM p GROUP BY split"""),
    "run_scores": twin("""
, f AS (
  SELECT split, z.m AS method, z.v AS v, y, scale FROM methods WHERE z.m IN ('vanilla', 'context_forecast', 'horizon_knn_mean', 'residual_knn_weighted')
  UNION ALL SELECT split, 'bayes_context_scalar', CASE WHEN split = 'eval' THEN bayes_scalar ELSE pred_ctx END, y, scale FROM gated
  UNION ALL SELECT split, 'bayes_context_horizon', bayes_step, y, scale FROM gated WHERE split = 'eval'
)
SELECT split, method, round(avg(((v - y) / scale) ** 2), 6) AS nmse FROM f GROUP BY split, method"""),
    "run_gates": twin("""
, f AS (
  SELECT *, 'target' AS gate, target AS score FROM losses UNION ALL SELECT *, 'shift', CASE WHEN split = 'train' THEN target ELSE -shift_mean END FROM losses
)
SELECT split, gate, count(*)::BIGINT AS n, round(avg((score > 0)::INT::DOUBLE) * 100, 6) AS taken_pct,
  round(avg(CASE WHEN abs(mse_ctx - mse) > 1e-12 THEN ((mse_ctx < mse) = (score > 0))::INT::DOUBLE END) * 100, 6) AS right_pct FROM f GROUP BY split, gate"""),
    "feature_file": twin("""
, d AS (SELECT split, qt, qu, avg((pred_ctx - pred) ** 2) AS dis, any_value(mu) AS mu FROM p GROUP BY split, qt, qu)
SELECT l.split, l.qt, l.qu, l.mse_ctx < l.mse AS context_better, n.k::BIGINT AS neighbours, round(l.mse, 6) AS base_loss, round(l.mse_ctx, 6) AS context_loss, round(least(l.mse, l.mse_ctx), 6) AS oracle_loss,
  round(d.dis, 6) AS forecast_disagreement, round(d.mu, 6) AS query_mean, round(l.sd, 6) AS query_std, round(n.mu_mean, 6) AS neighbour_mean_mean, round(n.mu_std, 6) AS neighbour_mean_std,
  round(n.sd_mean, 6) AS neighbour_std_mean, round(n.sd_std, 6) AS neighbour_std_std
FROM losses l JOIN nstats n USING (split, qt, qu) JOIN d USING (split, qt, qu)"""),
    "feature_correlation": twin("SELECT count(*)::BIGINT AS n, round(corr(d_mean, (l.mse - l.mse_ctx) / greatest(l.mse, 1e-8) * 100), 6) AS r FROM losses l JOIN nstats USING (split, qt, qu)"),
    "loss_histogram": twin("""
, v AS (SELECT sign(target) * ln(1 + abs(target)) AS x FROM losses), s AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT least(floor((x - lo) / (hi - lo) * 60), 59)::BIGINT AS bin, count(*)::BIGINT AS count FROM v, s GROUP BY 1"""),
    "results_pivot": twin("""
SELECT dataset, setting, round(avg(value) FILTER (method = 'vanilla'), 6) AS vanilla, round(avg(value) FILTER (method = 'horizon_knn_mean'), 6) AS horizon_knn_mean,
  round(avg(value) FILTER (method = 'context_forecast'), 6) AS context_forecast FROM means GROUP BY dataset, setting"""),
    "results_table": twin("""
, g AS (
  SELECT CASE grouping(dataset, setting) WHEN 0 THEN 'cell' WHEN 1 THEN 'dataset' WHEN 2 THEN 'setting' ELSE 'overall' END AS level, dataset, setting,
    avg(value) FILTER (method = 'vanilla') AS v, avg(value) FILTER (method = 'horizon_knn_mean') AS a, avg(value) FILTER (method = 'context_forecast') AS b, avg(value) FILTER (method = 'horizon_mix_scalar') AS c
  FROM means GROUP BY GROUPING SETS ((dataset, setting), (dataset), (setting), ())
)
SELECT level, dataset, setting, round(a, 6) AS horizon_knn_mean, round(b, 6) AS context_forecast, round(c, 6) AS horizon_mix_scalar, round((v - a) / abs(v) * 100, 5) AS horizon_knn_mean_pct,
  round((v - b) / abs(v) * 100, 5) AS context_forecast_pct, round((v - c) / abs(v) * 100, 5) AS horizon_mix_scalar_pct FROM g"""),
    "csv_series": twin("""
, d AS (SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS value FROM series WHERE series_id <> 1 GROUP BY ALL),
k AS (SELECT *, (dense_rank() OVER (ORDER BY ts) - 1)::BIGINT AS t, (dense_rank() OVER (ORDER BY series_id) - 1)::BIGINT AS s FROM d)
SELECT t, ts, s AS series_id, 'user_' || s AS series_name, round(value, 6) AS value FROM k"""),
    "improvement_of_averages": twin("""
SELECT l.level, l.dataset, l.setting, l.method, round(l.value, 6) AS value, round((r.value - l.value) / abs(r.value) * 100, 5) AS improvement_pct
FROM levels l JOIN levels r ON r.method = 'vanilla' AND r.level = l.level AND r.dataset IS NOT DISTINCT FROM l.dataset AND r.setting IS NOT DISTINCT FROM l.setting"""),
    "positive_only": twin("""
SELECT dataset, setting, method, round(value, 6) AS value FROM means WHERE method = 'vanilla' OR method IN (
  SELECT l.method FROM levels l, levels r WHERE l.level = 'overall' AND r.level = 'overall' AND r.method = 'vanilla' AND (r.value - l.value) / abs(r.value) > 0)"""),
    "best_flag": twin("SELECT dataset, setting, method, value = min(value) OVER (PARTITION BY dataset, setting) AS best FROM means"),
    "scale_exponents": twin("SELECT dataset, setting, floor(log10(abs(value)))::BIGINT AS exponent FROM means WHERE method = 'vanilla'"),
    "sweep_matrix": twin("""
, c AS (SELECT v.v AS variant, r.r AS run FROM (VALUES ('vanilla'), ('horizon_knn_mean'), ('missing')) v(v), (VALUES ('48_6'), ('48_12')) r(r)),
m AS (SELECT method, setting, avg(value) AS value FROM means GROUP BY ALL)
SELECT c.variant, c.run, round(m.value, 6) AS value, round((2 - m.value) / 2 * 100, 5) AS improvement_pct FROM c LEFT JOIN m ON m.method = c.variant AND m.setting = c.run"""),
    "adapter_identity_init": twin("""
SELECT split, qt, qu, h - 1 AS h, round(1 / (1 + 3 * exp(-6.0::DOUBLE)) * pred + exp(-6.0::DOUBLE) / (1 + 3 * exp(-6.0::DOUBLE)) * (pred_ctx + 2 * pred), 6) AS yhat FROM p"""),
    "adapter_loss": twin("""
SELECT split, round(avg(((pred_ctx - y) / scale) ** 2) + 0.01 * avg(((pred_ctx - pred) / scale) ** 2) + 0.01 * (avg(((ew - (y - pred)) / scale) ** 2) + avg(((yw - y) / scale) ** 2)), 6) AS loss FROM p GROUP BY split"""),
    "knn_embeddings": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
d AS (SELECT a.vec_id AS qid, b.vec_id AS nid, sqrt(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) ** 2))) AS distance
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY distance, nid))::BIGINT AS rank FROM d)
SELECT qid, rank, nid, round(distance, 6) AS distance FROM r WHERE rank <= 5""",
}


def _merge_ctes(text: str) -> str:
    """A final part that begins with a comma adds CTEs to the chain."""
    return text.replace(")\n\n, ", "),\n").replace(")\n, ", "),\n")


SQL["reloaded_scores"] = SQL["method_scores"]
SQL |= {f"{name}_all": SQL[name] for name in ("window_extract", "instance_norm", "patch_unfold", "moving_average")}
SQL = {name: _merge_ctes(text) for name, text in SQL.items()}
