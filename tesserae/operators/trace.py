"""Analytics of traces: flat spans (trace_id, span_id, parent_span_id, name, start_ms, duration_ms, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.sources.tables import stored

# Pipeline stages with their time limits in ms, and the states that count as errors.
STAGE_LIMITS = {"guard_input": 25, "query_transform": 25, "embed": 30, "retrieve": 110, "rerank": 45, "generate": 90, "guard_output": 40, "stt": 15000}
ERRORS = ("error", "timeout")


#: Cells that a round cuts the values of each key into, and rounds; the bound of a sketch's error leaves a cell at most twice its share of the distinct values.
CELLS, ROUNDS = 256, 2


def _same(keys: list[str]) -> Column:
    return F.expr(" and ".join(f"a.`{k}` <=> b.`{k}`" for k in keys))


def _wanted(places: list[Column], size: str) -> Column:
    """Whether one of the places lies in the stretch of this size that begins at _before."""
    return reduce(lambda a, b: a | b, [(i >= F.col("_before")) & (i < F.col("_before") + F.col(size)) for i in places])


def narrowed(counted: DataFrame, keys: list[str], places: list[Column]) -> DataFrame:
    """Of counted (keys, n, _before, _v, _c) the cells in which a place lies, with _before anew.

    _v are distinct values, _c their counts, and _before says how many values
    precede the group of rows (keys, _before).  The cuts are quantiles of a
    sketch of the distinct values, so however values are spread, outliers
    included, cells are of nearly equal size; counts are exact, so that cuts
    that are off cost time and change nothing.
    """
    group = [*keys, "_before"]
    cuts = counted.groupBy(*group).agg(F.percentile_approx("_v", [k / CELLS for k in range(1, CELLS)], 8 * CELLS).alias("_cuts"))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range((CELLS - 1).bit_length()))))
    cell = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(F.col("_cuts"), lo + step - 1) < F.col("_v"), lo + step).otherwise(lo))
    own = [F.col(f"a.{k}").alias(k) for k in group]
    placed = counted.alias("a").join(cuts.alias("b"), _same(group)).select(*own, "_v", "_c", "n", cell.alias("_cell"))
    sums = placed.groupBy(*group, "n", "_cell").agg(F.sum("_c").alias("_k"))
    earlier = F.coalesce(F.sum("_k").over(W.partitionBy(*group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = sums.withColumn("_of", F.col("_before")).withColumn("_before", F.col("_before") + earlier).filter(_wanted(places, "_k"))
    found = found.select(*keys, F.col("_of").alias("_before"), "_cell", F.col("_before").alias("_start"))
    return placed.alias("a").join(found.alias("b"), _same([*group, "_cell"])).select(*own[:-1], F.col("a.n").alias("n"), F.col("_start").alias("_before"), "_v", "_c")


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, ps: tuple[int, ...] = (50, 90, 95)) -> DataFrame:
    """keys with n, one column p<p> for each percentile (the value at p/100 of the last index, half to even), max and mean.

    Values are counted first and stored, then narrowed to the cells in which a
    wanted place lies, ROUNDS times whatever their number; only what is left is
    sorted, each cell on its own, so that a key of most rows is no task's alone.
    """
    counted = stored(rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "values")
    ends = counted.groupBy(*keys).agg(F.sum("_c").alias("n"), F.max("_v").alias("max"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"))
    own = [F.col(f"a.{k}").alias(k) for k in keys]
    at = {p: F.bround(F.lit(p / 100) * (F.col("n") - 1), 0) for p in ps}
    inside = counted.alias("a").join(ends.alias("b"), _same(keys)).select(*own, "n", F.lit(0).cast("long").alias("_before"), "_v", "_c")
    for _ in range(ROUNDS):
        inside = stored(narrowed(inside, keys, list(at.values())), "cells")  # or each round's plan would hold the one before four times
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_before").orderBy("_v")))
    found = inside.groupBy(*keys).agg(*(F.max(F.when((i < F.col("_upto")) & (i >= F.col("_upto") - F.col("_c")), F.col("_v"))).alias(f"p{p}") for p, i in at.items()))
    return ends.alias("a").join(found.alias("b"), _same(keys)).select(*own, "n", *(f"p{p}" for p in ps), "max", "mean")


#: Percentiles of a benchmark and how many first queries are left out.
BENCH_PERCENTILES, WARM_UP = (50, 70, 90, 95, 99, 100), 30


def bench_percentiles(runs: DataFrame, keys: list[str], value: str, order: str, warm_up: int = WARM_UP) -> DataFrame:
    """exact_percentiles at BENCH_PERCENTILES of runs without the first warm_up of each key by order (distinct within a key)."""
    first = runs.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter(F.col("_n") <= warm_up).select(*keys, order)
    return exact_percentiles(runs.join(F.broadcast(first), [*keys, order], "left_anti"), keys, value, BENCH_PERCENTILES)


def stage_stats(spans: DataFrame) -> DataFrame:
    """(name, n, mean_ms, errors) of each span name."""
    return spans.groupBy("name").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.sum(F.col("status").isin(*ERRORS).cast("long")).alias("errors"))


def stage_map(spans: DataFrame) -> DataFrame:
    """(trace_id, stages): name to ms, of equal names the one that starts last."""
    last = spans.withColumn("_n", F.row_number().over(W.partitionBy("trace_id", "name").orderBy(F.desc("start_ms"), F.desc("span_id")))).filter("_n = 1")
    return last.groupBy("trace_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "duration_ms")))).alias("stages"))


def latency_rollup(spans: DataFrame, totals: DataFrame, stages: tuple[str, ...] = tuple(STAGE_LIMITS)) -> DataFrame:
    """(trace_id, <stage>_ms ..., pipeline_ms, overhead_ms): top-level spans summed by stage.

    pipeline is the trace's total (trace_id, total_ms) without speech to text,
    overhead what no stage accounts for; neither is below 0.
    """
    top = spans.filter("parent_span_id is null")
    sums = top.groupBy("trace_id").agg(*(F.sum(F.when(F.col("name") == s, F.col("duration_ms")).otherwise(0.0)).alias(f"{s}_ms") for s in stages))
    out = totals.join(sums, "trace_id", "left").na.fill(0.0, [f"{s}_ms" for s in stages])
    known = sum((F.col(f"{s}_ms") for s in stages), F.lit(0.0))
    return out.withColumns({"pipeline_ms": F.greatest(F.col("total_ms") - (F.col("stt_ms") if "stt" in stages else F.lit(0.0)), F.lit(0.0)), "overhead_ms": F.greatest(F.col("total_ms") - known, F.lit(0.0))})


def recent(rows: DataFrame, n: int, by: str = "started_at", key: str = "trace_id") -> DataFrame:
    """The newest n rows; ties by key."""
    return rows.orderBy(F.desc(by), F.desc(key)).limit(n)


def status_of(error_class: Column) -> Column:
    """Span status from the class name of an error, null for none."""
    return F.when(error_class.isNull(), "ok").when(error_class.rlike("(?i)timeout|budget"), "timeout").otherwise("error")


def over_limit(spans: DataFrame) -> DataFrame:
    """spans that took longer than their stage's limit, with limit_ms."""
    table = F.create_map(*(F.lit(x) for kv in STAGE_LIMITS.items() for x in kv))
    return spans.withColumn("limit_ms", F.element_at(table, F.col("name"))).filter("duration_ms > limit_ms")


def flattened(spans: DataFrame) -> DataFrame:
    """spans with path (places among their siblings from the root down), whose order is the pre-order of each trace's tree.

    Each round doubles the distance to the ancestor whose path is put before a
    span's own, so a tree of any depth takes as many rounds as the logarithm of
    its depth.  A span whose parent is not there is a root; spans that are their
    own ancestors stop the job.
    """
    columns = spans.columns
    place = F.lpad(F.row_number().over(W.partitionBy("trace_id", "parent_span_id").orderBy("start_ms", "span_id")).cast("string"), 12, "0")
    boxed = spans.select(F.struct(*columns).alias("_box"), "trace_id", "span_id", F.col("parent_span_id").alias("_anc"), place.alias("_path"))
    known = boxed.select("trace_id", F.col("span_id").alias("_anc"), F.lit(True).alias("_there"))
    rows = boxed.join(known.distinct(), ["trace_id", "_anc"], "left").withColumn("_anc", F.when(F.col("_there"), F.col("_anc"))).drop("_there")
    most = spans.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(most.bit_length() + 1):  # no tree is deeper than it has spans
        rows = stored(rows, "spans")  # or each round's plan would hold the one before twice
        if rows.filter("_anc is not null").isEmpty():
            return rows.select(*(F.col("_box")[c].alias(c) for c in columns if c != "path"), F.col("_path").alias("path"))
        up = rows.select("trace_id", F.col("span_id").alias("_anc"), F.col("_anc").alias("_next"), F.col("_path").alias("_up"))
        rows = rows.join(up, ["trace_id", "_anc"], "left").select("_box", "trace_id", "span_id", F.col("_next").alias("_anc"), F.concat_ws(".", "_up", "_path").alias("_path"))
    raise ValueError("some spans are their own ancestors")


def by_id(rows: DataFrame, wanted: DataFrame, key: str = "trace_id") -> DataFrame:
    """The rows of the wanted keys: point lookups for a batch of them."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def tool_stats(calls: DataFrame) -> DataFrame:
    """(tool, calls, errors, mean_ms) of a log (tool, duration_ms, error)."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.sum(F.col("error").isNotNull().cast("long")).alias("errors"), F.avg("duration_ms").alias("mean_ms"))
