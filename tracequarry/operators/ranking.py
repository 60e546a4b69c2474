"""Scores, orders and labels of repositories, files and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the eight dimensions; they sum to 1.1.
DIMENSIONS = {"experimental_results": 0.2, "algorithm_match": 0.2, "domain_applicability": 0.15, "data_processing": 0.15, "model_quality": 0.15, "readability": 0.1, "structure": 0.1, "scalability": 0.05}


def repo_score(dimensions: dict[str, Column], overall: Column) -> Column:
    total = F.lit(0.0)
    for name, weight in DIMENSIONS.items():
        total = total + dimensions[name].cast("double") * weight
    return total * 0.6 + overall / 10.0 * 0.4


def top_per_group(rows: DataFrame, group: str, score: str, k: int, tie: str) -> DataFrame:
    """The k best rows of each group; ranks are cut in every task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def root_boost(score: Column, path: Column) -> Column:
    return F.when(~path.contains("/"), score * 5).otherwise(score)


def file_priority(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.when(end.isin("png", "jpg", "jpeg", "gif", "bmp", "webp", "svg"), 0).when(end == "pdf", 1).when(end.isin("csv", "xlsx", "json"), 2).otherwise(3)


def trace_labels(events: DataFrame, runtime_ms: int = 45_000, spans: int = 8) -> DataFrame:
    """Per trace (trace_id, ts, event_type): runtime, spans, and labels of what went wrong."""
    # Whole microseconds: doubles of seconds lose a millisecond now and then. Times without a zone keep clear of the session's.
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        runtime = F.expr("CAST(CAST(CAST(max(ts) - min(ts) AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000 AS BIGINT)")
    else:
        runtime = F.expr("(unix_micros(CAST(max(ts) AS TIMESTAMP)) - unix_micros(CAST(min(ts) AS TIMESTAMP))) div 1000")
    per = events.groupBy("trace_id").agg(
        runtime.alias("runtime_ms"),
        F.count(F.lit(1)).alias("span_count"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("hits"),
    )
    labels = F.array_compact(F.array(F.when((F.col("runtime_ms") > runtime_ms) | (F.col("span_count") >= spans), "latency"), F.when((F.col("views") > 0) & (F.col("hits") == 0), "retrieval"), F.when(F.col("errors") > 0, "failure")))
    return per.select("trace_id", "runtime_ms", "span_count", F.array_join(labels, ",").alias("labels"))


def cluster_severity(traces: Column, negative: Column, mean: Column) -> Column:
    score = 2 * traces + negative + F.when(mean < 0.4, 2).otherwise(0)
    return F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def pattern_level(evidence: Column, overlap: Column) -> Column:
    score = 3 * evidence + overlap
    return F.when(score >= 4.4, "high").when(score >= 3.2, "medium").otherwise("low")


def dedupe_commands(commands: DataFrame, group: str = "task", order: str = "pos") -> DataFrame:
    """Each command once: by its "# filename:", else by its collapsed text; a script also stands for running it later."""
    name = F.regexp_extract("command", r"#\s*filename:\s*([\w.-]+)", 1)
    text = F.trim(F.regexp_replace("command", r"\s+", " "))
    keyed = commands.withColumns({"file": F.when(name != "", name), "key": F.when(name != "", F.concat(F.lit("f "), name)).otherwise(F.concat(F.lit("c "), text)), "text": text})
    first = keyed.withColumn("r", F.row_number().over(Window.partitionBy(group, "key").orderBy(order))).where("r = 1")
    ran = first.where("file IS NOT NULL").select(group, F.concat_ws(" ", "language", "file").alias("text"), F.col(order).alias("since"))
    kept = first.join(ran, [group, "text"], "left").where(F.col("file").isNotNull() | F.col("since").isNull() | (F.col("since") > F.col(order)))
    return kept.select(group, order, "language", "command")


def fallback_score(is_key: Column, n_classes: Column, n_functions: Column, documented: Column, n_lines: Column) -> Column:
    """A module's importance without a graph: key components, classes, functions, documentation, size."""
    return is_key * 1.0 + n_classes * 0.3 + n_functions * 0.2 + F.when(documented, 0.2).otherwise(0.0) + F.least(F.coalesce(n_lines, F.lit(0)) / 1000, F.lit(1.0)) * 0.3


def fallback_packages(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent, depth, score: null for packages) with a package's score half the sum of its children's, level by level from the deepest."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done = nodes.where("score IS NOT NULL").select("id", "parent", "depth", "score")
    for depth in range(deepest, -1, -1):
        below = done.where(F.col("depth") == depth + 1).groupBy(F.col("parent").alias("id")).agg((F.sum("score") * 0.5).alias("half"))
        level = nodes.where(F.col("score").isNull() & (F.col("depth") == depth)).join(below, "id", "left")
        done = done.unionByName(level.select("id", "parent", "depth", F.coalesce("half", F.lit(0.0)).alias("score")))
    return done


def node_score(kind: Column, module: Column, package: Column) -> Column:
    """The score of a node by its kind; 0 for any other."""
    return F.when(kind == "module", module).when(kind == "package", package).otherwise(0.0)


def key_component_score(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """nodes (id) with score: 1.0 if a component (pos, id, module) has the id, 0.8 if one lies in it, by the first that fits."""
    hits = components.select(F.col("id").alias("node"), "pos", F.lit(1.0).alias("s")).unionByName(components.where("module <> id").select(F.col("module").alias("node"), "pos", F.lit(0.8).alias("s")))
    first = hits.groupBy("node").agg(F.min_by("s", "pos").alias("score"))
    return nodes.join(first, F.col("id") == F.col("node"), "left").select(*nodes.columns, F.coalesce("score", F.lit(0.0)).alias("score"))


def data_first(path: Column) -> Column:
    """Sort key of a listing: documents, pictures and tables before all others."""
    return ~F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin("png", "jpg", "jpeg", "gif", "bmp", "webp", "svg", "pdf", "csv", "xlsx", "json")


def inefficient(score: Column) -> Column:
    """Whether an evaluation's score marks a run that works but wastes."""
    return score.between(0.6, 0.75)


def spec_violations(non_goals: Column, must_have: Column, metrics: Column) -> Column:
    """What is wrong with a problem specification: no non-goals, a vague must-have, a metric without a number."""
    vague = F.exists(must_have, lambda m: F.lower(m).rlike(r"\b(better|good|nice|improve|fast|easy)\b") & ~m.rlike("[0-9]"))
    return F.array_compact(F.array(F.when(F.size(non_goals) < 1, "nonGoals"), F.when(vague, "mustHave"), F.when(F.exists(metrics, lambda m: ~m.rlike("[0-9]")), "metrics")))
