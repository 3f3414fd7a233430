"""Building blocks of the plain-SQL twins (one dialect: DuckDB on the same tables)."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

CLASSES = ["high", "low", "moderate", "non-burnable", "very_high", "very_low", "water"]
LABEL = "(list_position(['de','en','es','fr'], lang) - 1)"


def ctes(**parts: str) -> str:
    """Named subqueries in order, ready for a final SELECT."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts.items()) + "\n"


def logits(m: int = 0) -> str:
    return (
        "SELECT vec_id AS idx, label % 7 AS label, "
        f"list_transform(embedding[{7 * m + 1}:{7 * m + 7}], lambda x: x::DOUBLE * 10) AS logits "
        "FROM embeddings"
    )


def softmax(source: str, temperature: str = "1.0", keep: str = "idx, label, logits") -> str:
    return (
        f"SELECT {keep}, list_transform(e, lambda v: v / list_sum(e)) AS probs FROM (SELECT *, "
        f"list_transform(logits, lambda x: exp((x - list_max(logits)) / {temperature})) AS e "
        f"FROM ({source}))"
    )


def pred(m: int = 0) -> str:
    return softmax(logits(m))


def agreeing() -> str:
    return (
        "SELECT idx, CASE WHEN idx % 3 = 0 THEN label ELSE list_position(logits, list_max(logits)) - 1 "
        f"END AS label, logits FROM ({logits(0)})"
    )


def pred_wide() -> str:
    return (
        "SELECT label, list_transform(s, lambda v: v / (s[1] + s[2] + s[3])) AS probs FROM (SELECT "
        "list_position(['A','N','R'], l_returnflag) - 1 AS label, [l_quantity / 50 + 0.01, "
        "l_discount * 10 + 0.01, l_tax * 12.5 + 0.01] AS s FROM lineitem)"
    )


def members() -> str:
    return " UNION ALL ".join(
        f"SELECT 'm{m}' AS run, CASE WHEN idx % 2 = 0 THEN 'validation' ELSE 'test' END AS split, "
        f"idx, label, logits, probs FROM ({pred(m)})"
        for m in range(3)
    )


def frame(source: str, group: str = "'all'", keep: str = "") -> str:
    return f"""SELECT {group} AS grp, {keep} label, list_position(probs, list_max(probs)) - 1 AS pred,
      list_max(probs) AS conf, least(trunc(list_max(probs) * 15)::INT, 14) AS bin,
      -ln(least(greatest(probs[label + 1], 1e-15), 1.0)) AS nll,
      list_sum(list_transform(probs, lambda v: v * v)) - 2 * probs[label + 1] + 1 AS brier
      FROM ({source})"""


def per_class(f: str = "f", k: int = 7) -> str:
    return f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE
      2 * precision * recall / (precision + recall) END AS f1 FROM (
      SELECT grp, class_id, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM (
        SELECT grp, c AS class_id, count(*) FILTER (label = c) AS support,
          count(*) FILTER (pred = c) AS predicted, count(*) FILTER (pred = c AND label = c) AS tp
        FROM {f}, range({k}) AS r(c) GROUP BY grp, c))"""


def scalars(f: str = "f", k: int = 7) -> str:
    """grp, n_examples and the seven scalars of a frame named ``f``."""
    return f"""SELECT a.grp, n_examples, accuracy, balanced_accuracy, macro_f1, weighted_f1, nll, brier, ece
      FROM (SELECT grp, sum(support) AS s,
          avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, sum(f1) / {k} AS macro_f1,
          sum(f1 * support) / sum(support) AS weighted_f1 FROM ({per_class(f, k)}) GROUP BY grp) a
      JOIN (SELECT grp, count(*) AS n_examples, avg((label = pred)::INT) AS accuracy, avg(nll) AS nll,
          avg(brier) AS brier FROM {f} GROUP BY grp) b ON a.grp = b.grp
      JOIN (SELECT grp, sum(gap) / sum(n) AS ece FROM (SELECT grp, bin, count(*) AS n,
          abs(avg((label = pred)::INT) - avg(conf)) * count(*) AS gap FROM {f} GROUP BY grp, bin)
          GROUP BY grp) c ON a.grp = c.grp"""


def auroc(scored: str, group: str) -> str:
    """(group, auroc) from rows (group, score, positive); ties count one half."""
    return f"""SELECT {group}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
      sum(pos * (below - neg + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) END AS auroc FROM (
      SELECT *, sum(neg) OVER (PARTITION BY {group} ORDER BY score) AS below FROM (
        SELECT {group}, score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg
        FROM ({scored}) GROUP BY {group}, score)) GROUP BY {group}"""


def class_scores(source: str, keep: str = "", k: int = 7) -> str:
    return (
        f"SELECT {keep} c AS class_id, probs[c + 1] AS score, label = c AS positive "
        f"FROM ({source}), range({k}) AS r(c)"
    )


RANKS = "[3, 1, 2, NULL, 4, 0, NULL]"
WIDE_RANKS = "[1, 2, 3]"


def ordinal(f: str = "f", ranks: str = RANKS) -> str:
    return f"""SELECT grp, count(*) FILTER (t IS NOT NULL) AS n_risk_targets,
      count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS n_ordered_pairs,
      count(*) FILTER (t IS NOT NULL AND p IS NULL) AS risk_predictions_outside_order,
      count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) / count(*) FILTER (t IS NOT NULL) AS coverage,
      avg(abs(p - t)) AS mae, avg((abs(p - t) <= 1)::INT) AS within_one_level_accuracy,
      avg((p - t <= -2)::INT) AS severe_underestimation_rate
      FROM (SELECT *, ({ranks})[label + 1] AS t, ({ranks})[pred + 1] AS p FROM {f}) GROUP BY grp"""


def kappa(f: str = "f", ranks: str = RANKS) -> str:
    """Weighted kappa from the 5 x 5 table of counts and its marginals."""
    return f"""SELECT grp, 1 - sum(w * o) / sum(w * e) AS quadratic_weighted_kappa FROM (
      SELECT r.grp, (i - j) * (i - j) AS w, coalesce(o, 0) AS o, r.n * c.n / t.n::DOUBLE AS e
      FROM (SELECT grp, t AS i, count(*) AS n FROM pairs GROUP BY grp, t) r
      JOIN (SELECT grp, p AS j, count(*) AS n FROM pairs GROUP BY grp, p) c ON r.grp = c.grp
      JOIN (SELECT grp, count(*) AS n FROM pairs GROUP BY grp) t ON r.grp = t.grp
      LEFT JOIN (SELECT grp, t, p, count(*) AS o FROM pairs GROUP BY grp, t, p) x
        ON x.grp = r.grp AND x.t = i AND x.p = j) GROUP BY grp"""


def pairs(f: str = "f", ranks: str = RANKS) -> str:
    return (
        f"SELECT * FROM (SELECT grp, ({ranks})[label + 1] AS t, ({ranks})[pred + 1] AS p FROM {f}) "
        "WHERE t IS NOT NULL AND p IS NOT NULL"
    )


def high_risk(f: str = "f", ids: str = "(0, 4)") -> str:
    return f"""SELECT grp, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
      CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM (
      SELECT grp, count(*) FILTER (label IN {ids} AND pred IN {ids}) AS tp,
        count(*) FILTER (label NOT IN {ids} AND pred IN {ids}) AS fp,
        count(*) FILTER (label IN {ids} AND pred NOT IN {ids}) AS fn FROM {f} GROUP BY grp)"""


def examples() -> str:
    return f"SELECT doc_id AS idx, {LABEL} AS label, sha256(text) AS fp FROM documents"


def leaky() -> str:
    return f"SELECT *, ['train', 'validation', 'test'][idx % 3 + 1] AS split FROM ({examples()})"


def split_rows(seed: int = 42) -> str:
    """Hash-ordered stratified split of first copies.

    Class quotas by largest remainder, which equals the largest-deficit rule when every
    target is at least one.
    """
    return f"""SELECT idx, label, fp, CASE WHEN rn <= qt THEN 'train' WHEN rn <= qt + qv THEN 'validation'
        ELSE 'test' END AS split FROM (
      SELECT g.*, row_number() OVER (PARTITION BY g.label ORDER BY sha256('{seed}:' || fp)) AS rn, qt, qv
      FROM (SELECT fp, min(idx) AS idx, min(label) AS label FROM ({examples()}) GROUP BY fp) g
      JOIN (SELECT label, max(q) FILTER (i = 1) AS qt, max(q) FILTER (i = 2) AS qv FROM (
          SELECT label, i, base + (row_number() OVER (PARTITION BY label ORDER BY rest DESC, i)
              <= n - sum(base) OVER (PARTITION BY label))::INT AS q FROM (
            SELECT label, n, i, floor(n * f + 1e-9) AS base,
              round(n * f - floor(n * f + 1e-9), 9) AS rest
            FROM (SELECT label, count(DISTINCT fp) AS n FROM ({examples()}) GROUP BY label),
              (VALUES (1, 0.7), (2, 0.15), (3, 0.15)) AS v(i, f))) GROUP BY label) q
        ON g.label = q.label)"""


def history() -> str:
    return (
        "SELECT user_id AS run, value AS score, event_type, ts, event_id, row_number() OVER "
        "(PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events"
    )


def run_table() -> str:
    return """SELECT o_orderpriority AS model, o_orderstatus AS mode, o_orderkey AS seed,
      o_totalprice AS score, o_orderkey % 10 = 0 AS smoke_test,
      CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'running'
        ELSE 'complete' END AS status,
      CASE WHEN o_orderkey % 13 <> 0 THEN 'p' || (o_custkey % 3) END AS protocol_hash,
      's1' AS split_hash, o_custkey AS owner FROM orders"""


def recipe_text(smoke: str = ',"smoke_test":\' || smoke || \'') -> str:
    return (
        "'{\"effective_batch_size\":null,\"model\":{\"image_size\":224,\"mode\":\"' || mode || "
        "'\",\"name\":\"' || model || '\"}" + smoke + ",\"training\":{\"batch_size\":16},\"world_size\":1}'"
    )


def documents() -> str:
    """Fields of the run documents, with their recipe hash."""
    return f"""SELECT *, sha256({recipe_text()}) AS recipe_hash FROM (
      SELECT o_orderpriority AS model, o_orderstatus AS mode, 224 AS image_size, o_orderkey AS seed,
        CASE WHEN o_orderkey % 10 = 0 THEN 'true' ELSE 'false' END AS smoke,
        o_orderkey % 10 = 0 AS smoke_test, 'protocol-0001-abcdef' AS protocol_hash,
        'split-0001' AS split_hash, o_totalprice / 530001 AS accuracy, o_totalprice / 630001 AS macro_f1,
        o_totalprice / 730001 AS balanced_accuracy, o_totalprice / 830001 AS ece,
        o_totalprice / 930001 AS high_risk_recall, o_totalprice / 1030001 AS weighted_f1,
        o_totalprice / 1130001 AS macro_auroc, o_totalprice / 1230001 AS nll, o_totalprice / 1330001 AS brier,
        o_totalprice / 1430001 AS accuracy_example_ci_lower, o_totalprice / 1530001 AS accuracy_example_ci_upper,
        o_totalprice / 1630001 AS macro_f1_example_ci_lower, o_totalprice / 1730001 AS macro_f1_example_ci_upper,
        o_orderkey + 100 AS n_test_examples FROM orders)"""


def _t_975(df: int) -> float:
    """Two-sided 95 % t quantile: closed forms for 1 and 2, else bisection over Gauss-Legendre
    sums of cos(a)**(df - 1), the density in the angle a = atan(t / sqrt(df))."""
    if df == 1:
        return math.tan(0.475 * math.pi)
    if df == 2:
        return 0.95 * math.sqrt(2 / (1 - 0.95**2))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    nodes, weights = np.polynomial.legendre.leggauss(120)

    def inside(angle: float) -> float:
        return scale * angle / 2 * float(weights @ np.cos(angle * (nodes + 1) / 2) ** (df - 1))

    low, high = 0.0, math.pi / 2
    for _ in range(70):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < 0.475 else (low, middle)
    return math.sqrt(df) * math.tan(low)


@cache
def t_quantile(df: str) -> str:
    """Listed t quantiles up to 200, the expansion around the normal quantile (numbers of its
    four terms at 1.959964) beyond. It shares nothing with the library's own table."""
    listed = ", ".join(repr(_t_975(n)) for n in range(1, 201))
    terms = (2.372271230299, 2.822498615740, 2.555849679508, 1.589534053394)
    far = " + ".join(["1.959963984540054"] + [f"{c} / power({df}, {i})" for i, c in enumerate(terms, 1)])
    return f"CASE WHEN {df} <= 200 THEN ([{listed}])[({df})::INT] ELSE {far} END"


def seed_stats(source: str, keys: str, metric: str) -> str:
    """n, mean, std and interval of one metric by group."""
    return f"""SELECT {keys}, n_seeds, '{metric}' AS metric, n, mean, std,
      mean - half AS ci_lower, mean + half AS ci_upper FROM (
      SELECT *, CASE WHEN n > 1 THEN {t_quantile('(n - 1)')} * std / sqrt(n) END AS half FROM (
        SELECT {keys}, count(*) AS n_seeds, count({metric}) AS n, avg({metric}) AS mean,
          stddev_samp({metric}) AS std FROM ({source}) GROUP BY {keys}))"""
