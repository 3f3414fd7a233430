"""Queries over run tables and run documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import REPORT_METRICS
from ..functions import hashing, scalars
from ..operators import checks, runs
from ..plans import compare as compare_plan
from ..session import new_path
from ..sources import runs as run_source
from . import sql, views
from .registry import query, r, rounded
from .views import table

EXAMPLE_LIMITS = tuple(f"{m}_example_ci_{side}" for m in ("accuracy", "macro_f1") for side in ("lower", "upper"))

GROUP = "protocol_hash, split_hash, model, mode, image_size, recipe_hash"


@query(
    "scan_runs",
    sql.ctes(d=sql.documents())
    + "SELECT model, mode, smoke_test, count(*) AS n, sum(seed)::BIGINT AS seeds, round(sum(accuracy), 6) AS accuracy "
    "FROM d GROUP BY 1, 2, 3",
)
def scan_runs(spark, sf):
    record = runs.run_record(views.run_document_files(spark, sf))
    return rounded(
        record.groupBy("model", "mode", "smoke_test").agg(
            F.count("*").alias("n"), F.sum("seed").alias("seeds"), F.sum("accuracy").alias("accuracy")
        )
    )


@query(
    "scan_history",
    sql.ctes(h=sql.history())
    + "SELECT 'run=' || run % 16 AS run, count(*) AS n, max(epoch) AS last_epoch, round(sum(score), 6) AS total "
    "FROM h GROUP BY 1",
)
def scan_history(spark, sf):
    def write(path):
        (
            views.history(spark, sf)
            .select(
                "epoch", F.col("score").alias("val_macro_f1"), (F.col("score") / 2).alias("val_accuracy"),
                F.array(F.lit(0.1)).alias("lr"), (F.col("run") % 16).alias("run"),
            )
            .repartition("run")
            .write.partitionBy("run")
            .json(path)
        )

    path = views.fixture(spark, sf, "history", write)
    rows = run_source.scan_history(spark, path, "*.json", lines=True)
    return rounded(
        rows.groupBy("run").agg(
            F.count("*").alias("n"), F.max("epoch").alias("last_epoch"),
            F.sum("val_macro_f1").alias("total"),
        )
    )


@query(
    "run_record",
    sql.ctes(d=sql.documents())
    + f"SELECT seed, model, mode, image_size::BIGINT AS image_size, smoke_test, recipe_hash, n_test_examples, "
    f"{r(*REPORT_METRICS, *EXAMPLE_LIMITS)} FROM d",
)
def run_record(spark, sf):
    record = runs.run_record(views.run_documents(spark, sf))
    return rounded(
        record.select(
            "seed", "model", "mode", "image_size", "smoke_test", "recipe_hash", "n_test_examples",
            *REPORT_METRICS, *EXAMPLE_LIMITS,
        )
    )


@query("recipe_hash", sql.ctes(d=sql.documents()) + "SELECT seed, recipe_hash FROM d")
def recipe_hash(spark, sf):
    """Runs that differ in their worker count share a recipe."""
    summary = F.col("summary")
    return views.run_documents(spark, sf).select(
        F.variant_get("summary", "$.seed", "bigint").alias("seed"),
        hashing.recipe_hash(summary).alias("recipe_hash"),
    )


@query(
    "replication_id",
    sql.ctes(
        d="SELECT o_orderpriority AS model, o_orderstatus AS mode, o_orderkey AS seed, o_custkey AS owner FROM orders",
        e="SELECT owner, seed, '{\"recipe\":' || " + sql.recipe_text("")
        + " || ',\"training_seed\":' || seed || '}' AS entry FROM d",
        h="SELECT *, sha256('=' || entry) AS h FROM e",
        g="SELECT owner, count(*) AS n_members, min(seed) AS low, max(seed) AS high, sha256(count(*) || "
        + " || ".join(f"',' || sum(('0x' || h[{6 * i + 1}:{6 * i + 6}])::BIGINT) % 16777216" for i in range(hashing.LANES))
        + ") AS replication_id FROM h GROUP BY owner",
    )
    + "SELECT owner, n_members, replication_id, CASE WHEN low = high THEN low ELSE "
    "('0x' || replication_id[1:15])::BIGINT END AS report_seed FROM g",
)
def replication_id(spark, sf):
    """The runs of each owner as one ensemble."""
    recipes = runs.member_recipes(views.run_documents(spark, sf))
    owners = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seed"), F.col("o_custkey").alias("owner")
    )
    return rounded(runs.replication_id(recipes.join(owners, "seed"), ["owner"]))


@query(
    "filter_smoke",
    sql.ctes(t=sql.run_table()) + "SELECT model, mode, count(*) AS n FROM t WHERE NOT smoke_test GROUP BY 1, 2",
)
def filter_smoke(spark, sf):
    kept = runs.filter_smoke(views.run_table(spark, sf))
    return kept.groupBy("model", "mode").agg(F.count("*").alias("n"))


@query(
    "smoke_flag",
    "SELECT o_orderkey, (o_custkey % 5 = 1 OR o_orderkey % 9 = 4 OR o_orderstatus <> 'O') AS smoke FROM orders",
)
def smoke_flag(spark, sf):
    shards = F.when(F.col("o_custkey") % 5 == 1, 3)
    batches = F.when(F.col("o_orderkey") % 9 == 4, 7).otherwise(0)
    pretrained = F.when(F.col("o_orderstatus") == "O", True)
    flag = scalars.smoke_flag(shards, batches, F.lit(None).cast("int"), pretrained)
    return table(spark, sf, "orders").select("o_orderkey", flag.alias("smoke"))


@query(
    "check_complete",
    sql.ctes(t=sql.run_table())
    + "SELECT mode, count(*) FILTER (coalesce(status, 'complete') = 'complete') AS reported, "
    "count(*) FILTER (status = 'complete') AS members FROM t GROUP BY mode",
)
def check_complete(spark, sf):
    status = F.col("status")
    return (
        views.run_table(spark, sf)
        .groupBy("mode")
        .agg(
            F.count_if(checks.check_complete_reported(status)).alias("reported"),
            F.count_if(checks.check_complete_member(status)).alias("members"),
        )
    )


@query(
    "check_compatible",
    sql.ctes(t=sql.run_table())
    + "SELECT 'missing_hash' AS rule, count(*) FILTER (protocol_hash IS NULL) AS violations FROM t UNION ALL "
    "SELECT 'mixed_protocol', (count(DISTINCT (protocol_hash, split_hash)) > 1)::BIGINT FROM t",
)
def check_compatible(spark, sf):
    return checks.check_compatible(views.run_table(spark, sf))


@query(
    "distinct_protocols",
    sql.ctes(t=sql.run_table()) + "SELECT DISTINCT protocol_hash, split_hash FROM t",
)
def distinct_protocols(spark, sf):
    return runs.distinct_protocols(views.run_table(spark, sf))


@query(
    "duplicate_seeds",
    sql.ctes(t=sql.run_table())
    + "SELECT model, mode, seed % 500 AS seed, count(*) AS n FROM t GROUP BY 1, 2, 3 HAVING count(*) > 1",
)
def duplicate_seeds(spark, sf):
    rows = views.run_table(spark, sf).withColumn("seed", F.col("seed") % 500)
    return runs.duplicate_seeds(rows, ["model", "mode"])


STATS = "n_seeds, metric, n, " + r("mean", "std", "ci_lower", "ci_upper")


@query(
    "seed_statistics",
    sql.ctes(t="SELECT o_custkey AS owner, o_totalprice / 530001 AS score FROM orders",
             s=sql.seed_stats("SELECT * FROM t", "owner", "score"))
    + f"SELECT owner, {STATS} FROM s",
)
def seed_statistics(spark, sf):
    """Small groups, where the t quantile is far from the normal one; scores near one, so
    that six digits are within what two ways to the quantile agree on."""
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("owner"), (F.col("o_totalprice") / 530001).alias("score")
    )
    return rounded(runs.seed_statistics(rows, ["owner"], ["score"]))


@query(
    "seed_statistics_large",
    sql.ctes(t=sql.run_table(), s=sql.seed_stats("SELECT * FROM t", "model, mode", "score"))
    + f"SELECT model, mode, {STATS} FROM s",
)
def seed_statistics_large(spark, sf):
    return rounded(runs.seed_statistics(views.run_table(spark, sf), ["model", "mode"], ["score"]))


def _compare_sql() -> str:
    metrics = REPORT_METRICS
    parts = {f"s_{m}": sql.seed_stats("SELECT * FROM d WHERE NOT smoke_test", GROUP, m) for m in metrics}
    fields = ", ".join(
        f"round(s_{m}.{f}, 6) AS {m}_{f}" for m in metrics for f in ("mean", "std", "ci_lower", "ci_upper")
    )
    joins = " ".join(f"JOIN s_{m} USING (model, mode, recipe_hash)" for m in metrics[1:])
    return (
        sql.ctes(d=sql.documents(), **parts)
        + f"SELECT model, mode, recipe_hash, s_accuracy.n_seeds, {fields} FROM s_accuracy {joins}"
    )


@query("compare_runs", _compare_sql())
def compare_runs(spark, sf):
    record = runs.filter_smoke(runs.run_record(views.run_documents(spark, sf)))
    compared = runs.compare_runs(record)
    metrics = REPORT_METRICS
    fields = ("mean", "std", "ci_lower", "ci_upper")
    return rounded(
        compared.select(
            "model", "mode", "recipe_hash", "n_seeds", *[f"{m}_{f}" for m in metrics for f in fields]
        )
    )


@query("compare", _compare_sql())
def compare(spark, sf):
    """The checked comparison, written as a report and read back from its CSV file."""
    result = compare_plan.compare_documents(views.run_documents(spark, sf))
    path = new_path(spark, "report")
    compare_plan.write_report(result, path)
    schema = result.groups.schema
    written = spark.read.option("header", True).schema(schema).csv(f"{path}/comparison.csv")
    metrics = REPORT_METRICS
    fields = ("mean", "std", "ci_lower", "ci_upper")
    return rounded(
        written.select(
            "model", "mode", "recipe_hash", "n_seeds", *[f"{m}_{f}" for m in metrics for f in fields]
        )
    )


def _lines_sql() -> str:
    metrics = ("accuracy", "macro_f1", "balanced_accuracy", "ece")
    parts = {f"s_{m}": sql.seed_stats("SELECT * FROM d WHERE NOT smoke_test", GROUP, m) for m in metrics}
    joins = " ".join(f"JOIN s_{m} USING (model, mode, recipe_hash)" for m in metrics[1:])

    def shown(m: str) -> str:
        return f"printf('%.4f ± %.4f', s_{m}.mean, s_{m}.std)"

    line = " || ' | ' || ".join(
        ["model", "mode", "'224'", "s_accuracy.n_seeds", *[shown(m) for m in metrics],
         "printf('[%.4f, %.4f]', s_macro_f1.ci_lower, s_macro_f1.ci_upper)", "'protocol-000'",
         "recipe_hash[1:12]", "'no'"]
    )
    heads = " UNION ALL ".join(f"SELECT '{h}'" for h in (compare_plan.HEADER, compare_plan.RULE))
    return (
        sql.ctes(d=sql.documents(), **parts)
        + f"SELECT '| ' || {line} || ' |' AS line FROM s_accuracy {joins} UNION ALL {heads}"
    )


@query("report_sink", _lines_sql())
def report_sink(spark, sf):
    result = compare_plan.compare_documents(views.run_documents(spark, sf))
    path = new_path(spark, "report")
    compare_plan.write_report(result, path)
    lines = spark.read.text(f"{path}/comparison.md").withColumnRenamed("value", "line")
    if lines.first()["line"] != compare_plan.HEADER:
        raise ValueError("the report does not begin with its header")
    return lines


@query(
    "format_metric",
    "SELECT o_custkey AS owner, CASE WHEN count(*) = 1 THEN printf('%.4f', avg(o_totalprice / 530001)) ELSE "
    "printf('%.4f ± %.4f', avg(o_totalprice / 530001), stddev_samp(o_totalprice / 530001)) END AS shown "
    "FROM orders GROUP BY o_custkey",
)
def format_metric(spark, sf):
    score = F.col("o_totalprice") / 530001
    stats = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("std")
    )
    return stats.select("owner", scalars.format_metric(F.col("mean"), F.col("std")).alias("shown"))


@query(
    "select_recipe",
    sql.ctes(t=sql.run_table())
    + "SELECT model, mode, seed AS candidate, round(floor(score / 10000), 6) AS score FROM t "
    "ORDER BY floor(score / 10000) DESC, seed LIMIT 1",
)
def select_recipe(spark, sf):
    """Coarse scores, so that many candidates tie."""
    rows = views.run_table(spark, sf).select(
        "model", "mode", F.col("seed").alias("candidate"),
        F.floor(F.col("score") / 10000).cast("double").alias("score"),
    )
    return rounded(runs.select_recipe(rows))


@query(
    "run_matrix",
    "SELECT recipe, s AS seed FROM (SELECT DISTINCT o_custkey AS recipe FROM orders), "
    "(VALUES (42), (100), (2026)) v(s) WHERE (recipe, s) NOT IN (SELECT (o_custkey, o_orderkey % 3 * 58 + 42) "
    "FROM orders WHERE o_orderstatus = 'F')",
)
def run_matrix(spark, sf):
    """Customers as recipes; their finished orders as completed runs."""
    orders = table(spark, sf, "orders")
    recipes = orders.select(F.col("o_custkey").alias("recipe")).distinct()
    done = orders.filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("recipe"),
        (F.col("o_orderkey") % 3 * 58 + 42).cast("int").alias("seed"),
    )
    return rounded(runs.run_matrix(recipes, [42, 100, 2026], done))


