"""Reports on benchmark samples, and statistics of gaps and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["scale", "tool", "scenario", "concurrency", "target"]


def ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with _rank from 0 and _n within by. Sorting in the shuffle spills, unlike collecting a group in one row."""
    rows = Window.partitionBy(*by)
    return df.withColumns({"_rank": F.row_number().over(rows.orderBy(value)) - 1, "_n": F.count(value).over(rows)})


def linear(value: str, share: float) -> Column:
    """The linear percentile of ranked rows: between the values at the ranks around share * (n - 1)."""
    at = (F.col("_n") - 1) * F.lit(share)
    low, high = (F.max(F.when(F.col("_rank") == r(at).cast("int"), F.col(value))) for r in (F.floor, F.ceil))
    return low + (high - low) * F.max(at - F.floor(at))


def measured(samples: DataFrame) -> DataFrame:
    """Samples that count: not of a warm-up and ended well."""
    return samples.where(~F.col("is_warmup") & (F.col("status") == "ok"))


def latency(samples: DataFrame) -> DataFrame:
    """n, p50 (median) and p95 (floor rank) of each group."""
    r = ranked(measured(samples), GROUP, "duration_ms")
    p95 = F.max(F.when(F.col("_rank") == F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(0.95)) - 1)), F.col("duration_ms")))
    return r.groupBy(*GROUP).agg(F.count("*").alias("n"), linear("duration_ms", 0.5).alias("p50"), p95.alias("p95"))


def throughput(samples: DataFrame) -> DataFrame:
    """Operations a second of each group: concurrency by mean seconds."""
    mean = F.avg("duration_ms")
    return measured(samples).groupBy(*GROUP).agg(F.count("*").alias("n"), F.when(mean > 0, F.col("concurrency") * 1000.0 / mean).otherwise(0.0).alias("ops"))


#: The scenario of a sample of a concurrent round: the round's key, with the number of the query. Fixed values.
ROUND, ROUND_SAMPLE = r"^(.+_r\d+_round\d+)$", r"^(.+_r\d+_round\d+)_q\d+$"


def round_key(scenario: Column) -> Column:
    """The key of the round that a sample is of; null if it is of none."""
    return F.nullif(F.regexp_extract(scenario, ROUND_SAMPLE, 1), F.lit(""))


def split_rounds(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measured samples that are grouped one by one, and those of concurrent rounds with their round_key."""
    m = measured(samples).withColumn("round_key", round_key(F.col("scenario")))
    of_round = F.col("round_key").isNotNull() & (F.col("concurrency") > 1)
    return m.where(~of_round).drop("round_key"), m.where(of_round)


def rounds(samples: DataFrame) -> DataFrame:
    """Of each round: its first sample's duration, samples that went well, and all."""
    return samples.groupBy("scale", "round_key", "target").agg(F.min_by("duration_ms", "iteration").alias("wall_ms"), F.count_if("success").alias("ok"), F.count("*").alias("total"))


def resources(samples: DataFrame) -> DataFrame:
    """Largest working set in MiB and mean CPU milliseconds of each group; samples without figures are left out."""
    s = measured(samples).where("resource_delta IS NOT NULL")
    return s.groupBy("scale", "tool", "scenario", "target").agg(
        (F.max("resource_delta.peak_working_set_bytes") / (1024 * 1024)).alias("peak_mib"), F.avg("resource_delta.delta_cpu_ms").alias("cpu_ms")
    )


def skipped(samples: DataFrame) -> DataFrame:
    """Unsupported and skipped samples, each target, tool, scenario and status once, with how many. All rounds of a storm are one row, its scenario their name without run and round."""
    scenario = F.col("scenario")
    storm = F.when(scenario.rlike(ROUND_SAMPLE) | scenario.rlike(ROUND), F.regexp_replace(scenario, r"_r\d+_round\d+(_q\d+)?$", "")).otherwise(scenario)
    s = samples.where(F.col("status").isin("unsupported", "skipped") & ~F.col("is_warmup"))
    return s.groupBy("target", "tool", storm.alias("scenario"), "status").agg(F.count("*").alias("n"))


def resource_delta(ticks: DataFrame, by: list[str], at: str, gauge: str, counter: str) -> DataFrame:
    """Peak of a gauge and growth of a counter from the first to the last tick, not below 0."""
    return ticks.groupBy(*by).agg(F.max(gauge).alias("peak"), F.greatest(F.max_by(counter, at) - F.min_by(counter, at), F.lit(0)).alias("delta"))


def gap_statistics(gaps: DataFrame, by: list[str], gap: str = "gap") -> DataFrame:
    """Count, extremes, mean, population deviation and linear percentiles of gaps; no group where there are none."""
    r = ranked(gaps.where(F.col(gap).isNotNull()).select(*by, gap), by, gap)
    percentiles = [linear(gap, p).alias(name) for name, p in (("p10", 0.10), ("p25", 0.25), ("median", 0.50), ("p75", 0.75), ("p90", 0.90))]
    g = r.groupBy(*by).agg(F.count(gap).alias("n"), F.min(gap).alias("least"), F.max(gap).alias("most"), F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("deviation"), *percentiles)
    return g.withColumns({"iqr": F.col("p75") - F.col("p25"), "range": F.col("most") - F.col("least"), "cv": F.when(F.col("mean") != 0, F.col("deviation") / F.col("mean")).otherwise(0.0)})


def adaptive_threshold(stats: DataFrame, multiplier: float = 1.5, least: float = 0.05, most: float = 1.0, samples: int = 10, default: float = 0.1, use_iqr: bool = False) -> DataFrame:
    """threshold of each group: a multiple of the median (or the quartiles' distance) within bounds, the default for few gaps."""
    base = F.col("iqr" if use_iqr else "median") * F.lit(multiplier)
    return stats.withColumn("threshold", F.when(F.col("n") < samples, F.lit(default)).otherwise(F.least(F.greatest(base, F.lit(least)), F.lit(most))))


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The value with the largest sum of weights in each group; of several the smallest value."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(*by).agg(F.max_by(F.struct(value, "weight"), F.struct("weight", (-F.col(value)).alias("neg"))).alias("m")).select(*by, f"m.{value}", "m.weight")


def markdown(report: DataFrame, rows: list[str], column: str, cell: str) -> str:
    """A report as a Markdown table, one column for each value of column. Reports are small: groups, not samples."""
    wide = report.groupBy(*rows).pivot(column).agg(F.first(cell)).orderBy(*rows)
    head = wide.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in wide.collect():
        lines.append("| " + " | ".join("-" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x) for x in r) + " |")
    return "\n".join(lines) + "\n"


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only: those of a as missing, those of b as unexpected. Empty: both are the same set."""
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def run_plan(scenarios: DataFrame, targets: DataFrame, unsupported: DataFrame, iterations: int) -> DataFrame:
    """Work items: each scenario with each target and iteration, but for (target, tool) pairs that aren't supported; targets take turns to go first. All three tables are configuration."""
    items = scenarios.crossJoin(targets).join(unsupported, ["target", "tool"], "left_anti")
    items = items.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    turn = F.row_number().over(Window.partitionBy("scenario", "iteration").orderBy("target")) - 1
    n = F.count("*").over(Window.partitionBy("scenario", "iteration"))
    return items.withColumn("turn", F.pmod(turn + F.col("iteration"), n).cast("int"))


def tree_sum(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """processes(tick, pid, ppid, gauge), roots(pid) -> tick, root, processes, total over a root and all its descendants at that tick."""
    return processes.sparkSession.sql(
        """WITH RECURSIVE tree(tick, root, pid) AS (
             SELECT tick, pid, pid FROM {processes} WHERE pid IN (SELECT pid FROM {roots})
             UNION ALL SELECT p.tick, t.root, p.pid FROM tree t JOIN {processes} p ON p.tick = t.tick AND p.ppid = t.pid)
           SELECT tick, root, count(*) AS processes, sum(gauge) AS total FROM tree JOIN {processes} USING (tick, pid) GROUP BY tick, root""",
        processes=processes, roots=roots,
    )


def gates(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found(scenario, value), expected(scenario, wanted): each expected scenario with passed; one without a result fails."""
    return expected.join(found, "scenario", "left").select("scenario", "wanted", "value", F.coalesce(F.col("value") == F.col("wanted"), F.lit(False)).alias("passed"))


def stage_profile(records: DataFrame, stage: str, nanoseconds: str) -> DataFrame:
    """Of each stage: calls, total and mean milliseconds, and its share of all time."""
    g = records.groupBy(stage).agg(F.count("*").alias("calls"), F.sum(nanoseconds).alias("_ns"))
    all_ = F.sum("_ns").over(Window.partitionBy())  # over one row for each stage
    return g.select(stage, "calls", (F.col("_ns") / 1e6).alias("total_ms"), (F.col("_ns") / F.col("calls") / 1e6).alias("mean_ms"), F.when(all_ > 0, F.col("_ns") / all_).otherwise(0.0).alias("share"))


def traversal_counters(entries: DataFrame, path: str, content: str) -> DataFrame:
    """One row: entries, those that can't be read, whose path leads out of the root, and whose path isn't text."""
    from textmill.functions.paths import normalized

    escaped, broken = normalized(F.col(path)).isNull(), F.col(path).contains("\ufffd")
    return entries.agg(F.count("*").alias("entries"), F.count_if(F.col(content).isNull()).alias("io_errors"), F.count_if(escaped).alias("escaped"), F.count_if(broken).alias("non_unicode"))


def ground_truth(files: DataFrame) -> DataFrame:
    """What a generated corpus holds by its flags: files, sparse_files, dense_files, dense_hits."""
    return files.agg(F.count("*").alias("files"), F.count_if("has_sparse").alias("sparse_files"), F.count_if("has_dense").alias("dense_files"), (4 * F.count_if("has_dense")).alias("dense_hits"))


def targets_of(scenarios: DataFrame, manifest: DataFrame) -> DataFrame:
    """Scenarios with the path that the manifest(target_key, path) has for their target_key, null if none."""
    return scenarios.join(manifest, "target_key", "left")
