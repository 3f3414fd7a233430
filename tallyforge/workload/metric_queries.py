"""Queries over predictions: checks, metrics, calibration, bootstrap, ensembles, probes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SCALARS
from ..functions import scalars as scalar_fn
from ..functions.vectors import argmax, confidence_bin, log_clip, with_softmax
from ..operators import bootstrap, calibration, checks, ensemble, fitting, metrics, probe, ranking, runs, verify
from ..operators.classes import attach_class, class_table
from ..plans import ensemble as ensemble_plan
from ..plans import evaluate as evaluate_plan
from ..plans import search
from ..session import literal_table, new_path
from ..sources import predictions as prediction_io
from ..streaming import metrics as streaming
from . import sql, views
from .registry import query, r, rounded
from .views import CLASSES, WIDE_CLASSES, K, table

PRED = {"p": sql.pred(), "f": sql.frame("SELECT * FROM p")}
WIDE = {"p": sql.pred_wide(), "f": sql.frame("SELECT * FROM p")}
SCALAR_LIST = "n_examples, " + r(*SCALARS)


def _cells(spark, sf):
    return metrics.cells(metrics.score_frame(views.pred(spark, sf), K))


def _wide_cells(spark, sf):
    return metrics.cells(metrics.score_frame(views.pred_wide(spark, sf), 3))


def _scalars(predictions, k=K, by=()):
    cells = metrics.cells(metrics.score_frame(predictions, k, by), by)
    return metrics.scalars(metrics.tallies(cells, by), k, by)


def wide_list(column: str, k: int = K) -> str:
    return ", ".join(f"round({column}[{i + 1}], 6) AS c{i}" for i in range(k))


def spread(column: str, k: int = K):
    return [F.get(column, F.lit(i)).alias(f"c{i}") for i in range(k)]


# --- checks --------------------------------------------------------------------------------


@query(
    "check_labels",
    "SELECT 'empty' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'not_whole', count(*) FILTER "
    "(l_quantity / 10 <> floor(l_quantity / 10)) FROM lineitem UNION ALL SELECT 'out_of_range', "
    "count(*) FILTER (l_quantity / 10 < 0 OR l_quantity / 10 >= 4) FROM lineitem",
)
def check_labels(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") / 10).alias("label"))
    return checks.check_labels(rows, 4)


@query(
    "check_probs",
    "WITH p AS (SELECT CASE WHEN l_linenumber = 7 THEN [l_discount] WHEN l_linenumber = 6 THEN "
    "[l_discount, 'nan'::DOUBLE, l_tax] ELSE [l_discount * 10, l_tax, 1 - l_tax - l_discount * 10] END AS q "
    "FROM lineitem), g AS (SELECT q FROM p WHERE len(q) = 3 AND len(list_filter(q, lambda v: isnan(v))) = 0) "
    "SELECT 'shape' AS rule, count(*) FILTER (len(q) <> 3) AS violations FROM p UNION ALL SELECT 'not_finite', "
    "count(*) FILTER (len(q) = 3 AND len(list_filter(q, lambda v: isnan(v))) > 0) FROM p UNION ALL "
    "SELECT 'outside_unit', count(*) FILTER (list_min(q) < 0 OR list_max(q) > 1) FROM g UNION ALL "
    "SELECT 'sum_not_one', count(*) FILTER (abs(q[1] + q[2] + q[3] - 1) > 2e-6) FROM g",
)
def check_probs(spark, sf):
    line, d, t = F.col("l_linenumber"), F.col("l_discount"), F.col("l_tax")
    probs = (
        F.when(line == 7, F.array(d))
        .when(line == 6, F.array(d, F.lit(float("nan")), t))
        .otherwise(F.array(d * 10, t, 1 - t - d * 10))
    )
    return checks.check_probs(table(spark, sf, "lineitem").select(probs.alias("probs")), 3)


@query(
    "check_artifact",
    sql.ctes(
        p=sql.logits(),
        q="SELECT idx // 2 - 5 AS idx, CASE WHEN idx % 50 = 0 THEN 6 ELSE 7 END AS n FROM p",
    )
    + "SELECT 'bad_index' AS rule, count(*) FILTER (idx < 0) AS violations FROM q UNION ALL "
    "SELECT 'repeated_index', count(*) - count(DISTINCT idx) FROM q UNION ALL "
    "SELECT 'shape_differs', count(*) FILTER (n <> 7) FROM q UNION ALL "
    "SELECT 'bad_logits', count(*) FILTER (n <> 7) FROM q",
)
def check_artifact(spark, sf):
    rows = views.pred(spark, sf).select(
        F.expr("idx div 2 - 5").alias("idx"), "probs",
        F.when(F.col("idx") % 50 == 0, F.slice("logits", 1, 6)).otherwise(F.col("logits")).alias("logits"),
    )
    return checks.check_artifact(rows, K)


# --- scalar functions ----------------------------------------------------------------------


@query("softmax_t", sql.ctes(p=sql.softmax(sql.logits(), "2.5")) + f"SELECT idx, {wide_list('probs')} FROM p")
def softmax_t(spark, sf):
    return rounded(
        with_softmax(views.logits(spark, sf), K, 2.5).select("idx", *spread("probs"))
    )


@query("argmax", sql.ctes(**PRED) + "SELECT label::BIGINT AS label, pred::BIGINT AS pred, count(*) AS n "
       "FROM f GROUP BY 1, 2")
def argmax_(spark, sf):
    rows = views.pred(spark, sf).select("label", argmax(F.col("probs")).alias("pred"))
    return rounded(rows.groupBy("label", "pred").agg(F.count("*").alias("n")))


@query("confidence_bin", sql.ctes(**WIDE) + "SELECT bin::BIGINT AS bin, count(*) AS n FROM f GROUP BY 1")
def confidence_bin_(spark, sf):
    rows = views.pred_wide(spark, sf).select(
        confidence_bin(F.array_max("probs"), 15).alias("bin")
    )
    return rounded(rows.groupBy("bin").agg(F.count("*").alias("n")))


@query(
    "log_clip",
    "SELECT event_id, round(ln(least(greatest(value / 500 - 0.01, 1e-15), 1.0)), 6) AS log_p FROM events",
)
def log_clip_(spark, sf):
    return rounded(
        table(spark, sf, "events").select("event_id", log_clip(F.col("value") / 500 - 0.01).alias("log_p"))
    )


@query(
    "safe_div",
    "SELECT l_returnflag, round(sum(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END), 6) AS total, "
    "count(*) FILTER (l_tax = 0) AS zero FROM lineitem GROUP BY 1",
)
def safe_div(spark, sf):
    ratio = scalar_fn.safe_div(F.col("l_discount"), F.col("l_tax"))
    return rounded(
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.sum(ratio).alias("total"), F.count_if(F.col("l_tax") == 0).alias("zero"))
    )


# --- metrics -------------------------------------------------------------------------------


def _confusion_sql(k: int) -> str:
    return (
        f"SELECT i::BIGINT AS label, j::BIGINT AS pred, count(f.label) AS n FROM range({k}) a(i), range({k}) c(j) "
        "LEFT JOIN f ON f.label = i AND f.pred = j GROUP BY 1, 2"
    )


@query("confusion", sql.ctes(**PRED) + _confusion_sql(7))
def confusion(spark, sf):
    return rounded(metrics.confusion(_cells(spark, sf), K))


@query("confusion_lineitem", sql.ctes(**WIDE) + _confusion_sql(3))
def confusion_lineitem(spark, sf):
    return rounded(metrics.confusion(_wide_cells(spark, sf), 3))


@query(
    "confusion_normalized",
    sql.ctes(**PRED, m=_confusion_sql(7))
    + "SELECT label, pred, round(CASE WHEN sum(n) OVER (PARTITION BY label) = 0 THEN 0 ELSE "
    "n / sum(n) OVER (PARTITION BY label) END, 6) AS fraction FROM m",
)
def confusion_normalized(spark, sf):
    return rounded(metrics.confusion_normalized(metrics.confusion(_cells(spark, sf), K)))


@query(
    "per_class",
    sql.ctes(**PRED) + f"SELECT class_id, support, {r('precision', 'recall', 'f1')} FROM ({sql.per_class()})",
)
def per_class(spark, sf):
    return rounded(metrics.per_class(metrics.tallies(_cells(spark, sf)), K))


@query("scalar_scores", sql.ctes(**PRED) + f"SELECT {SCALAR_LIST} FROM ({sql.scalars()})")
def scalar_scores(spark, sf):
    return rounded(_scalars(views.pred(spark, sf)))


@query("scalar_scores_lineitem", sql.ctes(**WIDE) + f"SELECT {SCALAR_LIST} FROM ({sql.scalars(k=3)})")
def scalar_scores_lineitem(spark, sf):
    return rounded(_scalars(views.pred_wide(spark, sf), 3))


@query("nll", sql.ctes(**WIDE) + "SELECT round(avg(nll), 6) AS nll FROM f")
def nll(spark, sf):
    return rounded(metrics.mean_nll(views.pred_wide(spark, sf)))


@query("brier", sql.ctes(**WIDE) + "SELECT round(avg(brier), 6) AS brier FROM f")
def brier(spark, sf):
    return rounded(metrics.mean_brier(views.pred_wide(spark, sf), 3))


BINS = (
    "SELECT i AS bin, round(i / 15, 6) AS lower, round((i + 1) / 15, 6) AS upper, count(f.bin) AS count, "
    "round(avg((label = pred)::INT), 6) AS accuracy, round(avg(conf), 6) AS confidence "
    "FROM range(15) a(i) LEFT JOIN f ON f.bin = i GROUP BY i"
)


@query("reliability_bins", sql.ctes(**WIDE) + BINS)
def reliability_bins(spark, sf):
    return rounded(metrics.reliability_bins(metrics.tallies(_wide_cells(spark, sf))))


@query(
    "ece",
    sql.ctes(**WIDE)
    + "SELECT round(sum(abs(a - c) * n) / sum(n), 6) AS ece FROM (SELECT bin, count(*) AS n, "
    "avg((label = pred)::INT) AS a, avg(conf) AS c FROM f GROUP BY bin)",
)
def ece(spark, sf):
    bins = metrics.reliability_bins(metrics.tallies(_wide_cells(spark, sf)))
    return rounded(metrics.expected_calibration_error(bins))


@query(
    "auroc_per_class",
    sql.ctes(p=sql.pred(), s=sql.class_scores("SELECT * FROM p"), a=sql.auroc("SELECT * FROM s", "class_id"))
    + "SELECT class_id, round(auroc, 6) AS auroc FROM a",
)
def auroc_per_class(spark, sf):
    return rounded(ranking.auroc_per_class(views.pred(spark, sf)))


@query(
    "auroc_lineitem",
    sql.ctes(
        p=sql.pred_wide(), s=sql.class_scores("SELECT * FROM p", k=3),
        a=sql.auroc("SELECT * FROM s", "class_id"),
    )
    + "SELECT class_id, round(auroc, 6) AS auroc FROM a",
)
def auroc_lineitem(spark, sf):
    """Few distinct scores: most rows tie."""
    return rounded(ranking.auroc_per_class(views.pred_wide(spark, sf)))


@query(
    "macro_auroc",
    sql.ctes(p=sql.pred(), s=sql.class_scores("SELECT * FROM p"), a=sql.auroc("SELECT * FROM s", "class_id"))
    + "SELECT round(avg(auroc), 6) AS macro_auroc, list_sort(list(class_id) FILTER (auroc IS NOT NULL))::VARCHAR "
    "AS classes FROM a",
)
def macro_auroc(spark, sf):
    row = ranking.macro_auroc(ranking.auroc_per_class(views.pred(spark, sf)))
    return rounded(
        row.select("macro_auroc", F.col("macro_auroc_classes").cast("string").alias("classes"))
    )


def _high_risk_sql(source: str, ids: str, score: str) -> str:
    scored = f"SELECT 'all' AS grp, {score} AS score, label IN {ids} AS positive FROM p"
    return (
        sql.ctes(p=source, f=sql.frame("SELECT * FROM p"), a=sql.auroc(scored, "grp"))
        + f"SELECT support, {r('precision', 'recall', 'f1')}, round(auroc, 6) AS auroc "
        f"FROM ({sql.high_risk(ids=ids)}) JOIN a USING (grp)"
    )


@query("high_risk", _high_risk_sql(sql.pred(), "(0, 4)", "probs[1] + probs[5]"))
def high_risk(spark, sf):
    return rounded(ranking.high_risk(_cells(spark, sf), views.pred(spark, sf), CLASSES))


@query("high_risk_lineitem", _high_risk_sql(sql.pred_wide(), "(2)", "probs[3]"))
def high_risk_lineitem(spark, sf):
    return rounded(
        ranking.high_risk(_wide_cells(spark, sf), views.pred_wide(spark, sf), WIDE_CLASSES)
    )


ORDINAL_LIST = "n_risk_targets, n_ordered_pairs, risk_predictions_outside_order, " + r(
    "coverage", "mae", "within_one_level_accuracy", "severe_underestimation_rate"
)


@query("ordinal", sql.ctes(**PRED) + f"SELECT {ORDINAL_LIST} FROM ({sql.ordinal()})")
def ordinal(spark, sf):
    return rounded(metrics.ordinal(_cells(spark, sf), CLASSES).drop("quadratic_weighted_kappa"))


@query(
    "qwk",
    sql.ctes(**PRED, pairs=sql.pairs())
    + f"SELECT {r('quadratic_weighted_kappa')} FROM ({sql.kappa()})",
)
def qwk(spark, sf):
    return rounded(
        metrics.ordinal(_cells(spark, sf), CLASSES).select("quadratic_weighted_kappa")
    )


@query(
    "qwk_lineitem",
    sql.ctes(**WIDE, pairs=sql.pairs(ranks=sql.WIDE_RANKS))
    + f"SELECT {r('quadratic_weighted_kappa')} FROM ({sql.kappa()})",
)
def qwk_lineitem(spark, sf):
    return rounded(
        metrics.ordinal(_wide_cells(spark, sf), WIDE_CLASSES).select("quadratic_weighted_kappa")
    )


@query(
    "risk_error_groups",
    sql.ctes(**PRED, x=f"SELECT *, ({sql.RANKS})[label + 1] AS t, ({sql.RANKS})[pred + 1] AS p FROM f",
             g="SELECT count(t) AS risk_targets, count(*) FILTER (t = p) AS exact, "
             "count(*) FILTER (t IS NOT NULL AND p IS NULL) AS outside, count(*) FILTER (t > p) AS under, "
             "count(*) FILTER (t - p >= 2) AS under_two, count(*) FILTER (abs(t - p) <= 1) AS within_one, "
             "count(*) FILTER (t IS NULL) AS unranked_targets, "
             "count(*) FILTER (t IS NULL AND label = pred) AS unranked_exact FROM x")
    + "SELECT *, round(exact / risk_targets, 6) AS exact_rate, round(outside / risk_targets, 6) AS outside_rate, "
    "round(within_one / risk_targets, 6) AS within_one_rate, "
    "round(unranked_exact / unranked_targets, 6) AS unranked_rate FROM g",
)
def risk_error_groups(spark, sf):
    return rounded(metrics.risk_error_groups(_cells(spark, sf), CLASSES))


@query(
    "top_confusions",
    sql.ctes(**PRED, m=_confusion_sql(7))
    + "SELECT label, pred, n, round(n / support, 6) AS fraction FROM (SELECT *, sum(n) OVER (PARTITION BY label) "
    "AS support FROM m) ORDER BY CASE WHEN label = pred THEN 0 ELSE n END DESC, label * 7 + pred DESC LIMIT 10",
)
def top_confusions(spark, sf):
    return rounded(metrics.top_confusions(metrics.confusion(_cells(spark, sf), K), K))


SMOOTH_WEIGHTS = [0.5, 1.0, 1.5, 2.0, 1.0, 0.25, 3.0]


@query(
    "cross_entropy",
    sql.ctes(
        l=sql.logits(),
        z="SELECT label, list_transform(logits, lambda x: x - list_max(logits) - ln(list_sum(list_transform("
        "logits, lambda y: exp(y - list_max(logits)))))) AS lp FROM l",
        w=f"SELECT {SMOOTH_WEIGHTS} AS w",
    )
    + "SELECT round(avg(-(0.9 * w[label + 1] * lp[label + 1] + 0.1 / 7 * list_sum(list_transform(range(1, 8), "
    "lambda i: w[i] * lp[i])))), 6) AS cross_entropy FROM z, w",
)
def cross_entropy(spark, sf):
    return rounded(metrics.cross_entropy(views.logits(spark, sf), K, 0.1, SMOOTH_WEIGHTS))


@query(
    "class_weights",
    "SELECT c AS class_id, count(x) AS n, round(CASE WHEN count(x) = 0 THEN 0 ELSE (SELECT count(*) FROM lineitem) "
    "/ (4.0 * count(x)) END, 6) AS loss_weight, round(CASE WHEN count(x) = 0 THEN 0 ELSE 1.0::DOUBLE / count(x) "
    "END, 9) AS sampler_weight FROM range(4) a(c) LEFT JOIN (SELECT list_position(['A','N','R'], l_returnflag) "
    "- 1 AS x FROM lineitem) ON x = c GROUP BY c",
)
def class_weights(spark, sf):
    """Four declared classes, of which one never occurs."""
    counted = views.pred_wide(spark, sf).groupBy(F.col("label").alias("class_id")).agg(
        F.count("*").alias("n")
    )
    dense = spark.range(4, numPartitions=1).select(F.col("id").cast("int").alias("class_id"))
    counts = dense.join(counted, "class_id", "left").select("class_id", F.coalesce("n", F.lit(0)).alias("n"))
    weights = metrics.class_weights(counts, 4)
    return weights.select(
        F.col("class_id").cast("bigint").alias("class_id"), "n",
        F.round("loss_weight", 6).alias("loss_weight"), F.round("sampler_weight", 9).alias("sampler_weight"),
    )


# --- ensembles -----------------------------------------------------------------------------

MEMBERS = {"m": sql.members()}


def _aligned(spark, sf):
    return ensemble.align_members(views.members(spark, sf), K)


@query(
    "align_members",
    sql.ctes(**MEMBERS) + "SELECT split, idx, count(*) AS n_rows, min(label)::BIGINT AS label FROM m GROUP BY 1, 2",
)
def align_members(spark, sf):
    return rounded(_aligned(spark, sf).select("split", "idx", "n_rows", "label"))


@query(
    "same_observations",
    sql.ctes(**MEMBERS)
    + "SELECT split, idx, count(*) AS n_rows FROM m WHERE NOT (run = 'm2' AND label = 3) GROUP BY 1, 2 "
    "HAVING count(*) <> 3",
)
def same_observations(spark, sf):
    """The third member lost one class."""
    kept = views.members(spark, sf).filter(~((F.col("run") == "m2") & (F.col("label") == 3)))
    return ensemble.same_observations(ensemble.align_members(kept, K), 3)


@query(
    "same_labels",
    sql.ctes(**MEMBERS, n="SELECT *, CASE WHEN run = 'm1' AND idx % 40 = 0 THEN label + 1 ELSE label END AS l FROM m")
    + "SELECT split, idx, min(l)::BIGINT AS label, max(l)::BIGINT AS max_label FROM n GROUP BY 1, 2 "
    "HAVING min(l) <> max(l)",
)
def same_labels(spark, sf):
    """The second member carries some other labels."""
    moved = (F.col("run") == "m1") & (F.col("idx") % 40 == 0)
    rows = views.members(spark, sf).withColumn(
        "label", F.when(moved, F.col("label") + 1).otherwise(F.col("label"))
    )
    return rounded(ensemble.same_labels(ensemble.align_members(rows, K)))


MEAN = "SELECT split, idx, min(label) AS label, [" + ", ".join(
    f"avg(probs[{i + 1}])" for i in range(7)
) + "] AS probs FROM m GROUP BY split, idx"


@query(
    "ensemble_mean",
    sql.ctes(**MEMBERS, e=MEAN)
    + f"SELECT split, idx, label::BIGINT AS label, {wide_list('probs')}, "
    "round(ln(greatest(probs[1], 1e-15)), 6) AS first_logit FROM e",
)
def ensemble_mean(spark, sf):
    mean = ensemble.ensemble_mean(_aligned(spark, sf), K, 3)
    return rounded(
        mean.select(
            "split", "idx", "label", *spread("probs"), F.get("logits", F.lit(0)).alias("first_logit")
        )
    )


@query(
    "mean_member_score",
    sql.ctes(**MEMBERS, f=sql.frame("SELECT * FROM m WHERE split = 'validation'", "run"))
    + f"SELECT round(avg(macro_f1), 6) AS mean_member_score FROM ({sql.scalars()})",
)
def mean_member_score(spark, sf):
    validation = views.members(spark, sf).filter("split = 'validation'")
    return rounded(runs.mean_member_score(_scalars(validation, K, ["run"])))


@query(
    "attach_class",
    sql.ctes(**PRED)
    + f"SELECT label::BIGINT AS label, ({sql.CLASSES})[label + 1] AS name, ({sql.RANKS})[label + 1]::BIGINT "
    "AS risk_rank, label IN (0, 4) AS is_high, count(*) AS n FROM f GROUP BY ALL",
)
def attach_class_(spark, sf):
    named = attach_class(views.logits(spark, sf), class_table(spark, CLASSES))
    return rounded(
        named.groupBy("label", "name", "risk_rank", "is_high").agg(F.count("*").alias("n"))
    )


def _metric_rows(source: str, extra: str = "0") -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, ({m})::DOUBLE + CASE WHEN '{m}' = 'macro_f1' THEN {extra} ELSE 0 END AS value "
        f"FROM {source}"
        for m in SCALARS
    )


@query(
    "verify_summary",
    sql.ctes(**PRED, s=sql.scalars())
    + "SELECT 'macro_f1' AS metric, round(macro_f1, 6) AS recomputed, round(macro_f1 + 0.125, 6) AS stored FROM s",
)
def verify_summary(spark, sf):
    """The stored macro F1 is off; the six other metrics agree."""
    found = verify.tall(_scalars(views.pred(spark, sf)), SCALARS)
    off = F.when(F.col("metric") == "macro_f1", 0.125).otherwise(0.0)
    stored = found.withColumn("value", F.col("value") + off)
    return rounded(verify.verify_summary(found, stored, []))


@query(
    "paired_runs",
    sql.ctes(
        p=sql.pred(0), q=sql.pred(1), f=sql.frame("SELECT * FROM p"), g=sql.frame("SELECT * FROM q"),
        s=sql.scalars("f"), t=sql.scalars("g"), a=_metric_rows("s"), c=_metric_rows("t"),
    )
    + "SELECT metric, round(a.value, 6) AS left_value, round(c.value, 6) AS right_value, "
    "round(c.value - a.value, 6) AS difference FROM a JOIN c USING (metric)",
)
def paired_runs(spark, sf):
    left, right = views.pred(spark, sf, 0), views.pred(spark, sf, 1)
    differing = verify.comparable_observations(left, right)
    rule = differing.agg(F.lit("observations").alias("rule"), F.count("*").alias("violations"))
    checks.enforce(rule, "runs do not hold the same observations")
    return rounded(
        verify.paired_runs(
            verify.tall(_scalars(left), SCALARS), verify.tall(_scalars(right), SCALARS)
        )
    )


@query(
    "sort_predictions",
    sql.ctes(p=sql.pred()) + "SELECT idx, label::BIGINT AS label, round(probs[1], 6) AS first FROM p ORDER BY idx",
)
def sort_predictions(spark, sf):
    ordered = prediction_io.sorted_predictions(views.pred(spark, sf))
    return rounded(ordered.select("idx", "label", F.get("probs", F.lit(0)).alias("first")))


# --- calibration ---------------------------------------------------------------------------

GRID = [0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0]


@query(
    "temperature_grid",
    sql.ctes(p=sql.agreeing(), t=f"SELECT unnest({GRID})::DOUBLE AS temperature")
    + "SELECT temperature, round(avg(ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / "
    "temperature)))) + (list_max(logits) - logits[label + 1]) / temperature), 6) AS nll FROM p, t "
    "GROUP BY temperature",
)
def temperature_grid(spark, sf):
    return rounded(calibration.temperature_grid(views.agreeing(spark, sf), K, GRID))


def fitted_sql(source: str) -> str:
    """Temperature by bisection on the slope of the convex loss in s = 1/T, as (t)."""
    slope = (
        "avg(list_sum(list_transform(logits, lambda x: x * exp(m * (x - list_max(logits))))) / "
        "list_sum(list_transform(logits, lambda x: exp(m * (x - list_max(logits))))) - logits[label + 1])"
    )
    return f"""SELECT 2 / (lo + hi) AS t FROM (
      WITH RECURSIVE cal AS MATERIALIZED ({source}), it(i, lo, hi) AS (
        SELECT 0, 0.05::DOUBLE, 20.0::DOUBLE UNION ALL
        SELECT i + 1, CASE WHEN g < 0 THEN m ELSE lo END, CASE WHEN g < 0 THEN hi ELSE m END FROM (
          SELECT i, lo, hi, m, {slope} AS g FROM (SELECT *, (lo + hi) / 2 AS m FROM it WHERE i < 45), cal
          GROUP BY i, lo, hi, m))
      SELECT lo, hi FROM it ORDER BY i DESC LIMIT 1)"""


@query(
    "fit_temperature",
    sql.ctes(p=sql.agreeing(), t=fitted_sql("SELECT * FROM p")) + "SELECT round(t, 6) AS temperature FROM t",
)
def fit_temperature(spark, sf):
    found = calibration.fit_temperature(views.agreeing(spark, sf).select("label", "logits"), K)
    return rounded(literal_table(spark, [(found,)], "temperature double"))


# --- bootstrap -----------------------------------------------------------------------------

REPLICATES = 1000


def _mixed(source: str, x: str, name: str) -> str:
    """Mixer as four nested projections over ``source``; 128-bit products are cut to 64 bits."""
    mask, m1, m2 = (f"{v}::UHUGEINT" for v in (bootstrap.MASK, bootstrap.MIX_1, bootstrap.MIX_2))
    q = f"SELECT *, ({x}) & {mask} AS v0 FROM ({source})"
    q = f"SELECT *, (xor(v0, v0 >> 30) * {m1}) & {mask} AS v1 FROM ({q})"
    q = f"SELECT *, (xor(v1, v1 >> 27) * {m2}) & {mask} AS v2 FROM ({q})"
    return f"SELECT * EXCLUDE (v0, v1, v2), xor(v2, v2 >> 31) AS {name} FROM ({q})"


def _bootstrap_ctes(source: str, n: int, seed: int) -> dict[str, str]:
    """Counter-based draws per (replicate, class) of the frame ``source``, the scalars of every
    resample (``bs``) and their percentiles (``bq``). Classes here are one leaf each."""
    step = f"{bootstrap.STEP}::UHUGEINT"
    keyed = f"SELECT b, label, n FROM range({n}) r(b), (SELECT label, count(*) AS n FROM {source} GROUP BY label)"
    for key, start in zip(("k1", "k2"), bootstrap.STARTS):
        keyed = f"SELECT *, {start}::UHUGEINT AS {key} FROM ({keyed})"
        for part in (f"{seed}::UHUGEINT", "b::UHUGEINT", "label::UHUGEINT", "0::UHUGEINT", "0::UHUGEINT"):
            keyed = _mixed(keyed, f"{key} + {part} + {step}", "mixed")
            keyed = f"SELECT * EXCLUDE ({key}, mixed), mixed AS {key} FROM ({keyed})"
    drawn = f"SELECT b, label, n, k1, k2, unnest(range(n)) AS j FROM ({keyed})"
    drawn = _mixed(drawn, f"k1 + ((j::UHUGEINT * {step}) & {bootstrap.MASK}::UHUGEINT)", "h1")
    drawn = _mixed(drawn, "xor(h1, k2)", "h2")
    limits = ", ".join(
        f"quantile_cont({m}, 0.025) AS {m}_lower, quantile_cont({m}, 0.975) AS {m}_upper" for m in SCALARS
    )
    return {
        "ranked": f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS pos FROM {source}",
        "bd": f"SELECT b, label, (((h2 >> 32) * n::UHUGEINT) >> 32)::BIGINT AS pos FROM ({drawn})",
        "bz": "SELECT b AS grp, r.label, pred, bin, conf, nll, brier FROM bd JOIN ranked r "
        "ON r.label = bd.label AND r.pos = bd.pos",
        "bs": sql.scalars("bz"),
        "bq": f"SELECT {limits} FROM bs",
    }


def _bootstrap_sql(n: int, seed: int) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(e.{m}, 6) AS estimate, round({m}_lower, 6) AS lower, "
        f"round({m}_upper, 6) AS upper FROM e, bq"
        for m in SCALARS
    )
    return (
        sql.ctes(
            p=sql.pred(),
            f=sql.frame("SELECT * FROM p", keep="idx,"),
            **_bootstrap_ctes("f", n, seed),
            e=sql.scalars("f"),
        )
        + rows
    )


@query("bootstrap_ci", _bootstrap_sql(REPLICATES, 42))
def bootstrap_ci(spark, sf):
    return rounded(bootstrap.bootstrap_ci(views.pred(spark, sf), K, REPLICATES, 42))


# --- probes --------------------------------------------------------------------------------

HEAD = {
    "x": "SELECT vec_id AS idx, label % 7 AS label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings",
    "c": "SELECT idx, label, list_transform(e, lambda v: v - list_avg(e)) AS d FROM x",
    "n": "SELECT idx, label, list_transform(d, lambda v: v / sqrt(list_sum(list_transform(d, lambda u: u * u)) / len(d) "
    "+ 1e-5)) AS v FROM c",
    "h": "SELECT label AS k, list(m ORDER BY i) AS w FROM (SELECT label, i, avg(v[i]) AS m FROM n, range(1, 65) g(i) "
    "GROUP BY label, i) GROUP BY label",
    "g": "SELECT idx, n.label, list(list_dot_product(w, v) ORDER BY k) AS logits FROM n, h GROUP BY idx, n.label",
}


def _probe_rows(spark, sf):
    return views.features(spark, sf).select("idx", "label", "features")


@query("score_linear", sql.ctes(**HEAD) + f"SELECT idx, {wide_list('logits')} FROM g")
def score_linear(spark, sf):
    rows = _probe_rows(spark, sf)
    head = probe.centroid_head(rows, K)
    return rounded(probe.score_linear(rows, head).select("idx", *spread("logits")))


@query("score_batches", sql.ctes(**HEAD) + f"SELECT idx, {wide_list('logits')} FROM g")
def score_batches(spark, sf):
    rows = _probe_rows(spark, sf)
    head = probe.centroid_head(rows, K)
    scored = probe.score_batches(rows, probe.head_scorer(head), "features")
    return rounded(scored.select("idx", *spread("logits")))


@query(
    "predict",
    sql.ctes(**HEAD, s=sql.softmax("SELECT * FROM g", "1.5"))
    + f"SELECT idx, ({sql.CLASSES})[list_position(probs, list_max(probs))] AS prediction, 1.5::DOUBLE AS temperature, "
    "round(probs[1], 6) AS p_high, round(probs[7], 6) AS p_water FROM s",
)
def predict(spark, sf):
    rows = _probe_rows(spark, sf)
    scored = probe.score_linear(rows, probe.centroid_head(rows, K))
    found = probe.predict(scored, CLASSES, 1.5)
    return rounded(
        found.select(
            "idx", "prediction", "temperature",
            F.element_at("probabilities", "high").alias("p_high"),
            F.element_at("probabilities", "water").alias("p_water"),
        )
    )


@query("train_probe")
def train_probe(spark, sf):
    rows = views.features(spark, sf)
    head = probe.train_probe(rows.filter("split = 'train'"), K, balanced=True)
    held_out = with_softmax(probe.score_linear(rows.filter("split <> 'train'"), head), K)
    return rounded(_scalars(held_out, K, ["split"]))


@query(
    "probe_shares",
    "SELECT (label % 7)::BIGINT AS label, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM embeddings "
    "WHERE vec_id % 5 NOT IN (0, 1) GROUP BY label % 7",
)
def probe_shares(spark, sf):
    """At the optimum of a fit with free intercepts, the mean probability of a class over the
    training rows is its share of them, whatever the optimizer and the penalty on the weights."""
    rows = views.features(spark, sf).filter("split = 'train'")
    head = probe.train_probe(rows, K, l2=0.05, max_iter=200)
    scored = with_softmax(probe.score_linear(rows, head), K)
    means = scored.agg(*[F.avg(F.get("probs", F.lit(c))).alias(f"c{c}") for c in range(K)])
    pairs = [F.struct(F.lit(c).cast("bigint").alias("label"), F.col(f"c{c}").alias("share")) for c in range(K)]
    return rounded(means.select(F.explode(F.array(*pairs)).alias("p")).select("p.*"), 3)


@query(
    "probe_certificate",
    "SELECT row_number() OVER (ORDER BY l2, balanced) - 1 AS candidate, l2, balanced, n AS n_train, true AS converged, "
    "true AS below_null_model FROM (VALUES (0.01::DOUBLE), (0.5::DOUBLE)) a(l2), (VALUES (false), (true)) b(balanced), "
    "(SELECT count(*) AS n FROM embeddings WHERE vec_id % 5 NOT IN (0, 1)) c",
)
def probe_certificate(spark, sf):
    """Every recipe of a grid ends where its penalised gradient vanishes, below the loss of a head
    that knows only the classes' shares."""
    rows = views.features(spark, sf).filter("split = 'train'")
    grid = [fitting.Recipe(l2, balanced, 300) for l2 in (0.01, 0.5) for balanced in (False, True)]
    shares = [r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()]
    n = sum(shares)
    flat = {False: -sum(s / n * math.log(s / n) for s in shares), True: math.log(len(shares))}
    results = [
        (i, g.l2, g.balanced, n, f.converged, f.loss < flat[g.balanced])
        for i, (g, f) in enumerate(zip(grid, fitting.fit_grid(rows, K, grid)))
    ]
    schema = "candidate bigint, l2 double, balanced boolean, n_train bigint, converged boolean, below_null_model boolean"
    return literal_table(spark, results, schema)


@query("tune_probe")
def tune_probe(spark, sf):
    return search.tune_probe(views.features(spark, sf), K, l2=[0.01, 0.5], balanced=[False, True], max_iter=[50])


# --- whole evaluations ---------------------------------------------------------------------


def _evaluation_sql(k: int = 7) -> dict[str, str]:
    """Long metric rows by (split, variant) from (split, variant, idx, label, probs) rows ``v``."""
    group = "split || '/' || variant"
    names = ["n_examples", *SCALARS]
    listed = " UNION ALL ".join(f"SELECT grp, '{m}' AS metric, {m}::DOUBLE AS value FROM s" for m in names)
    ordinal_names = [
        "n_risk_targets", "n_ordered_pairs", "risk_predictions_outside_order", "coverage", "mae", "within_one_level_accuracy", "severe_underestimation_rate"
    ]
    ranked = " UNION ALL ".join(
        f"SELECT grp, 'ordinal.{m}' AS metric, {m}::DOUBLE AS value FROM o" for m in ordinal_names
    )
    screened = " UNION ALL ".join(
        f"SELECT grp, 'high_risk.{m}' AS metric, {m}::DOUBLE AS value FROM hr"
        for m in ("support", "precision", "recall", "f1")
    )
    scored = (
        f"SELECT {group} || '#' || c AS g, probs[c + 1] AS score, label = c AS positive FROM v, range({k}) r(c)"
    )
    grouped = f"SELECT {group} AS grp, probs[1] + probs[5] AS score, label IN (0, 4) AS positive FROM v"
    classes = " UNION ALL ".join(
        f"SELECT grp, 'class.' || class_id || '.{m}' AS metric, {m}::DOUBLE AS value FROM pc"
        for m in ("support", "precision", "recall", "f1")
    )
    bins = " UNION ALL ".join(
        f"SELECT grp, 'bin.' || bin || '.{m}' AS metric, {m}::DOUBLE AS value FROM rb"
        for m in ("count", "accuracy", "confidence")
    )
    limits = " UNION ALL ".join(
        f"SELECT 'test/raw' AS grp, 'bootstrap.{m}.{side}' AS metric, {m}_{side} AS value FROM bq"
        for m in SCALARS
        for side in ("lower", "upper")
    )
    return {
        "f": sql.frame("SELECT * FROM v", group, keep="idx,"),
        "ft": "SELECT * FROM f WHERE grp = 'test/raw'",
        **_bootstrap_ctes("ft", REPLICATES, 42),
        "pc": sql.per_class("f", k),
        "rb": "SELECT grp, bin, count(*) AS count, avg((label = pred)::INT) AS accuracy, avg(conf) AS confidence "
        "FROM f GROUP BY grp, bin",
        "cm": "SELECT grp, label, pred, count(*) AS n FROM f GROUP BY ALL",
        "s": sql.scalars("f", k),
        "o": sql.ordinal(),
        "pairs": sql.pairs(),
        "kp": sql.kappa(),
        "hr": sql.high_risk(),
        "au": f"SELECT split_part(g, '#', 1) AS grp, avg(auroc) AS value FROM ({sql.auroc(scored, 'g')}) GROUP BY 1",
        "hu": sql.auroc(grouped, "grp"),
        "long": f"{listed} UNION ALL {ranked} UNION ALL {screened} UNION ALL "
        "SELECT grp, 'ordinal.quadratic_weighted_kappa', quadratic_weighted_kappa FROM kp UNION ALL "
        "SELECT grp, 'macro_auroc', value FROM au UNION ALL SELECT grp, 'high_risk.auroc', auroc FROM hu UNION ALL "
        f"{classes} UNION ALL {bins} UNION ALL {limits} UNION ALL "
        "SELECT grp, 'confusion.' || label || '.' || pred, n::DOUBLE FROM cm",
    }


LONG = (
    "SELECT split_part(grp, '/', 1) AS split, split_part(grp, '/', 2) AS variant, metric, "
    "round(value, 6) AS value FROM long"
)
AGREEING_SPLIT = (
    "SELECT CASE WHEN idx % 2 = 0 THEN 'validation' ELSE 'test' END AS split, idx, label, logits FROM ("
    + sql.agreeing() + ")"
)


def every_output(found) -> DataFrame:
    """Metrics, class table, confusion, reliability and intervals of an evaluation as long rows."""
    by = ["split", "variant"]

    def long(rows: DataFrame, name, columns) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("value")) for c in columns]
        rows = rows.select(*by, name.alias("name"), F.explode(F.array(*pairs)).alias("p"))
        return rows.select(*by, F.concat_ws(".", "name", "p.c").alias("metric"), "p.value")

    def named(kind: str, *columns) -> F.Column:
        return F.concat_ws(".", F.lit(kind), *[F.col(c).cast("string") for c in columns])

    matrix = found.confusion.filter("n > 0")
    intervals = found.bootstrap.withColumns({"split": F.lit("test"), "variant": F.lit("raw")})
    parts = [
        found.metrics.select(*by, "metric", F.col("value").cast("double").alias("value")),
        long(found.per_class, named("class", "class_id"), ["support", "precision", "recall", "f1"]),
        long(found.reliability.filter("count > 0"), named("bin", "bin"), ["count", "accuracy", "confidence"]),
        matrix.select(*by, named("confusion", "label", "pred").alias("metric"), F.col("n").cast("double").alias("value")),
        long(intervals, named("bootstrap", "metric"), ["lower", "upper"]),
    ]
    table_ = parts[0]
    for part in parts[1:]:
        table_ = table_.unionByName(part)
    return rounded(table_)


@query(
    "evaluate",
    sql.ctes(
        a=AGREEING_SPLIT,
        t=fitted_sql("SELECT * FROM a WHERE split = 'validation'"),
        v="SELECT split, 'raw' AS variant, idx, label, probs FROM ("
        + sql.softmax("SELECT * FROM a", "1.0", "split, idx, label")
        + ") UNION ALL SELECT split, 'calibrated', idx, label, probs FROM ("
        + sql.softmax("SELECT * FROM a, t", "t", "split, idx, label")
        + ")",
        **_evaluation_sql(),
    )
    + LONG,
)
def evaluate(spark, sf):
    split = F.when(F.col("idx") % 2 == 0, "validation").otherwise("test")
    rows = views.agreeing(spark, sf).withColumn("split", split)
    return every_output(evaluate_plan.evaluate(rows, CLASSES, n_bootstrap=REPLICATES))


@query(
    "ensemble",
    sql.ctes(
        **MEMBERS,
        e=MEAN,
        a="SELECT split, idx, label, probs AS mean, list_transform(probs, lambda p: ln(greatest(p, 1e-15))) AS logits FROM e",
        t=fitted_sql("SELECT * FROM a WHERE split = 'validation'"),
        v="SELECT split, 'raw' AS variant, idx, label, probs FROM e UNION ALL "
        "SELECT split, 'calibrated', idx, label, probs FROM ("
        + sql.softmax("SELECT * FROM a, t", "t", "split, idx, label")
        + ")",
        **_evaluation_sql(),
    )
    + LONG,
)
def ensemble_(spark, sf):
    done = ensemble_plan.ensemble_runs(views.members(spark, sf), CLASSES, 3, n_bootstrap=REPLICATES)
    return every_output(done.evaluation)


@query("stream_metrics", sql.ctes(**MEMBERS, f=sql.frame("SELECT * FROM m")) + f"SELECT {SCALAR_LIST} FROM ({sql.scalars()})")
def stream_metrics(spark, sf):
    """Member files arrive one at a time; the sums end up as over all rows at once."""
    path, state = new_path(spark, "arriving"), new_path(spark, "stream")
    prediction_io.write_predictions(views.members(spark, sf).repartition("run", "split"), path)
    running = streaming.stream_metrics(spark, path, state, K, max_files=2)
    running.awaitTermination()
    return rounded(streaming.current_metrics(spark, state, K))
