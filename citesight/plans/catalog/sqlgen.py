"""DuckDB SQL builders for the metric oracles (independent of the Spark code path)."""

from __future__ import annotations


def _gl(g):
    return ", ".join(g)


def _pre(g):
    return (_gl(g) + ", ") if g else ""


def _part(g):
    return f"PARTITION BY {_gl(g)} " if g else ""


def _grp(g):
    return f" GROUP BY {_gl(g)}" if g else ""


def points_sql(name: str, src: str, g, y="y", score="prob") -> str:
    """CTE ``{name}``: distinct scores with pos/neg, inclusive running sums, totals and tp/fp at >= score."""
    return f"""{name}_p AS (
  SELECT {_pre(g)}{score} AS score, CAST(sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
         CAST(sum(CASE WHEN {y} = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg
  FROM {src} WHERE {score} IS NOT NULL AND NOT isnan({score}) GROUP BY {_pre(g)}{score}),
{name} AS (
  SELECT *, P - pos_cum + pos AS tp, N - neg_cum + neg AS fp FROM (
    SELECT *, sum(pos) OVER ({_part(g)}ORDER BY score ROWS UNBOUNDED PRECEDING) AS pos_cum,
              sum(neg) OVER ({_part(g)}ORDER BY score ROWS UNBOUNDED PRECEDING) AS neg_cum,
              sum(pos) OVER ({_part(g)}) AS P, sum(neg) OVER ({_part(g)}) AS N FROM {name}_p))"""


def auc_select(name: str, g) -> str:
    return f"""SELECT {_pre(g)}CASE WHEN max(P) > 0 AND max(N) > 0
  THEN sum(pos * (neg_cum - neg + neg / 2.0)) / (max(P) * max(N)) END AS roc_auc FROM {name}{_grp(g)}"""


def ap_select(name: str, g, alias="average_precision") -> str:
    return f"""SELECT {_pre(g)}CASE WHEN max(P) > 0 THEN sum(pos * tp / (tp + fp)) / max(P) END AS {alias}
FROM {name}{_grp(g)}"""


def counts_sql(src: str, g, theta: str = "0.5", y="y", score="prob") -> str:
    return f"""SELECT {_pre(g)}CAST(count_if({score} > {theta} AND {y} = 1) AS BIGINT) AS tp,
  CAST(count_if({score} > {theta} AND {y} <> 1) AS BIGINT) AS fp,
  CAST(count_if(NOT ({score} > {theta}) AND {y} <> 1) AS BIGINT) AS tn,
  CAST(count_if(NOT ({score} > {theta}) AND {y} = 1) AS BIGINT) AS fn
FROM {src}{_grp(g)}"""


def scores_cols(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    d = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"
    bacc = (f"(coalesce(CASE WHEN {tp} + {fn} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fn}) END, 0.0) + "
            f"coalesce(CASE WHEN {tn} + {fp} > 0 THEN CAST({tn} AS DOUBLE) / ({tn} + {fp}) END, 0.0)) / "
            f"(CAST({tp} + {fn} > 0 AS INTEGER) + CAST({tn} + {fp} > 0 AS INTEGER))")
    return (f"{bacc} AS balanced_accuracy, {d(tp, f'{tp} + {fp}')} AS precision, "
            f"{d(tp, f'{tp} + {fn}')} AS recall, {d(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1")


THETAS_SQL = "(SELECT i, CAST(i AS DOUBLE) * CAST(0.025 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS theta FROM range(20) t(i))"


def best_sql(name: str, src: str, g, y="y", score="prob") -> str:
    """CTE ``{name}``: best balanced accuracy over the 20 thresholds."""
    return f"""{name}_c AS (
  SELECT {_pre(['s.' + c for c in g])}th.i, th.theta,
    count_if(s.{score} > th.theta AND s.{y} = 1) AS tp, count_if(s.{score} > th.theta AND s.{y} <> 1) AS fp,
    count_if(NOT (s.{score} > th.theta) AND s.{y} <> 1) AS tn, count_if(NOT (s.{score} > th.theta) AND s.{y} = 1) AS fn
  FROM {src} s CROSS JOIN {THETAS_SQL} th GROUP BY {_pre(['s.' + c for c in g])}th.i, th.theta),
{name}_s AS (SELECT {_pre(g)}i, theta, {scores_cols()} FROM {name}_c),
{name} AS (SELECT {_pre(g)}balanced_accuracy AS best_accuracy, theta AS best_accuracy_theta, precision, recall FROM (
  SELECT *, row_number() OVER ({_part(g)}ORDER BY balanced_accuracy DESC, i) AS r FROM {name}_s) WHERE r = 1)"""


def binary_wide_sql(src: str, g) -> str:
    """CTEs ending in ``wide``: all binary metrics and examples per group."""
    on = " AND ".join(f"a.{c} = {{t}}.{c}" for c in g)
    parts = [points_sql("bp", src, g),
             f"auc AS ({auc_select('bp', g)})",
             f"ap AS ({ap_select('bp', g, 'PR_AUC')})",
             f"c50 AS (SELECT {_pre(g)}{scores_cols()} FROM ({counts_sql(src, g)}))",
             best_sql("bt", src, g),
             f"ex AS (SELECT {_pre(g)}CAST(count(*) AS DOUBLE) AS examples, avg(abs(y - prob)) AS MAE FROM {src}{_grp(g)})"]

    def j(t):
        return f"LEFT JOIN {t} ON {on.format(t=t)}" if g else f"CROSS JOIN {t}"
    sel = (f"SELECT {_pre(['a.' + c for c in g])}a.examples, a.MAE, auc.roc_auc, ap.PR_AUC, "
           "c50.balanced_accuracy AS \"balanced_accuracy:50\", c50.f1 AS \"F1:50\", c50.recall AS \"recall:50\", "
           "c50.precision AS \"precision:50\", bt.best_accuracy, bt.best_accuracy_theta, "
           "bt.precision AS \"precision:best_acc\", bt.recall AS \"recall:best_acc\" "
           f"FROM ex a {j('auc')} {j('ap')} {j('c50')} {j('bt')}")
    return ",\n".join(parts) + f",\nwide AS ({sel})"


BINARY_METRICS = ["MAE", "roc_auc", "PR_AUC", "balanced_accuracy:50", "F1:50", "recall:50", "precision:50",
                  "best_accuracy", "best_accuracy_theta", "precision:best_acc", "recall:best_acc"]


def metric_rows_sql(g) -> str:
    """CTE ``mrows`` from ``wide``: (group, metric, score, weight)."""
    unions = " UNION ALL ".join(
        f"SELECT {_pre(g)}'{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS score, examples AS weight FROM wide"
        for m in BINARY_METRICS)
    return f"mrows AS ({unions})"


def newton_sql(src: str, steps: int, reg: float) -> str:
    """CTEs (for WITH RECURSIVE) ending in ``fitted``, one list ``b`` of intercept and weights: ``steps`` Newton steps of
    the penalised weighted logistic regression on ``src`` (f: list, y, w), each system solved by elimination."""
    parts = [f"nf AS MATERIALIZED (SELECT list_concat([CAST(1.0 AS DOUBLE)], f) AS f, y, w FROM {src})",
             "nw AS (SELECT sum(w) AS tot, max(len(f)) AS d FROM nf)",
             "ni AS (SELECT unnest(range(1, d + 1)) AS i FROM nw)",
             "b0 AS (SELECT list_transform(range(0, d), lambda i: CAST(0.0 AS DOUBLE)) AS b FROM nw)"]
    for t in range(steps):
        parts.append(f"""p{t} AS MATERIALIZED (SELECT f, w, y, 1 / (1 + exp(-list_dot_product(f, b))) AS p FROM nf, b{t}),
h{t} AS MATERIALIZED (SELECT x.i, z.i AS j, sum(w * p * (1 - p) * f[x.i] * f[z.i]) AS v FROM p{t}, ni x, ni z WHERE x.i <= z.i GROUP BY x.i, z.i),
g{t} AS (SELECT i, sum(w * (y - p) * f[i]) AS v FROM p{t}, ni GROUP BY i),
r{t} AS (SELECT i, list(v / tot + CASE WHEN i = j AND i > 1 THEN {reg} ELSE 0 END ORDER BY j) AS r
  FROM (SELECT i, j, v FROM h{t} UNION ALL SELECT j, i, v FROM h{t} WHERE i <> j), nw GROUP BY i),
m{t} AS (SELECT list(list_append(r, g{t}.v / tot - CASE WHEN r{t}.i > 1 THEN {reg} * b[r{t}.i] ELSE 0 END) ORDER BY r{t}.i) AS m
  FROM r{t} JOIN g{t} ON g{t}.i = r{t}.i, nw, b{t}),
e{t} AS (SELECT CAST(1 AS BIGINT) AS k, m, list_transform(m[1], lambda v: v / m[1][1]) AS top FROM m{t}
  UNION ALL SELECT k + 1, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) FROM (
    SELECT k, list_transform(m, lambda r, i: CASE WHEN i = k THEN top ELSE list_transform(r, lambda v, j: v - r[k] * top[j]) END) AS m
    FROM e{t} WHERE k <= len(m))),
b{t + 1} AS (SELECT list_transform(b, lambda v, i: v + m[i][len(m) + 1]) AS b FROM e{t}, b{t} WHERE k = len(m) + 1)""")
    parts.append(f"fitted AS (SELECT b FROM b{steps})")
    return ",\n".join(parts)
