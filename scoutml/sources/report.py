"""Report content (S10) as rows; layout and fonts are not built.

Each experiment gives rows (id, line_no, section, label, value) in four sections:
the run, its models or algorithms by rank, their best parameters, the insight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutml.functions.scalar import fmt_fixed, latin1_safe

_MODEL = "name:string,best_params:map<string,string>,error:string"
RESULTS = f"struct<models:array<struct<{_MODEL},score:double,n_trials:int>>,clustering:array<struct<{_MODEL},silhouette:double,n_clusters_found:int>>,n_trials_per_algo:int>"


def _ranked(items: Column, score: str, sign: Column) -> Column:
    """The items by score (failed ones last, earlier ones first on ties)."""
    keyed = F.transform(items, lambda m, i: F.struct(m[score].isNull().alias("failed"), (sign * m[score]).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: F.get(items, x["i"]))


def _row(section: str, label: Column, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), label.alias("label"), value.alias("value"))


def _results(items: Column, metric: Column, score: str, more: str, word: str) -> Column:
    def value(m: Column) -> Column:
        known = F.concat(metric, F.lit(" "), fmt_fixed(m[score]))
        return F.when(m[score].isNull(), F.lit("failed")).otherwise(
            F.concat(known, F.when(m[more].isNull(), F.lit("")).otherwise(F.concat(F.lit(f", {word} "), m[more].cast("string")))))

    return F.transform(items, lambda m, i: _row("ranking", F.concat((i + 1).cast("string"), F.lit(". "), m["name"]), value(m)))


def _parameters(items: Column) -> Column:
    each = F.transform(items, lambda m: F.transform(
        F.array_sort(F.map_entries(F.coalesce(m["best_params"], F.create_map().cast("map<string,string>")))),
        lambda e: _row("parameters", F.concat(m["name"], F.lit("."), e["key"]), F.coalesce(e["value"], F.lit("none")))))
    return F.flatten(each)


def report_lines(history: DataFrame) -> DataFrame:
    """(id, line_no, section, label, value) of every experiment, all text made Latin-1 safe."""
    r = F.from_json("results", RESULTS)
    clusters = F.col("mode") == "unsupervised"
    accuracy = F.col("task") == "classification"
    models = _ranked(r["models"], "score", F.when(accuracy, F.lit(-1.0)).otherwise(F.lit(1.0)))
    algos = _ranked(r["clustering"], "silhouette", F.lit(-1.0))
    metric = F.when(accuracy, F.lit("accuracy")).otherwise(F.lit("RMSE"))
    run = F.array(
        _row("run", F.lit("prompt"), F.col("user_prompt")),
        _row("run", F.lit("mode"), F.col("mode")),
        _row("run", F.lit("shape"), F.coalesce("dataset_shape", F.lit("unknown"))),
        _row("run", F.lit("recorded"), F.col("timestamp")),
    )
    ranking = F.when(clusters, _results(algos, F.lit("silhouette"), "silhouette", "n_clusters_found", "clusters")).otherwise(
        _results(models, metric, "score", "n_trials", "trials"))
    parameters = F.when(clusters, _parameters(algos)).otherwise(_parameters(models))
    insight = F.when(F.coalesce("insight", F.lit("")) != "", F.array(_row("insight", F.lit("text"), F.col("insight"))))
    parts = [F.coalesce(part, F.array().cast("array<struct<section:string,label:string,value:string>>")) for part in (run, ranking, parameters, insight)]
    rows = history.select("id", F.posexplode(F.concat(*parts)).alias("line_no", "row"))
    return rows.select("id", "line_no", "row.section", latin1_safe("row.label").alias("label"), latin1_safe("row.value").alias("value"))
