"""Measurement analytics over an event log (event, time, value) and over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut
from sparkloom.functions.ordered import OrderedGroups

#: Start and end events that are paired by position.
PAIRS = (("view", "click"), ("click", "purchase"), ("signup", "error"))


def numbered(log: DataFrame, events: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of these events with their position in the event's order of time, within the groups `by`."""
    rows = log.where(F.col("event").isin(events))
    if by:
        return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by, "event").orderBy("time", "event_id")))
    # an event of a few names can hold any share of the log
    return OrderedGroups(rows, ["event"], ["time", "event_id"]).positions("rn").withColumn("rn", F.col("rn") + 1)


def pair_durations(log: DataFrame, pairs=PAIRS, by: list[str] | None = None) -> DataFrame:
    """(by, pair, rn, duration): i-th start with i-th end, as far as both go; negative durations are 0."""
    by = by or []
    rows = numbered(log, sorted({e for p in pairs for e in p}), by)
    out = None
    for start, end in pairs:
        a = rows.where(F.col("event") == start).select(*by, "rn", F.col("time").alias("t0"))
        b = rows.where(F.col("event") == end).select(*by, "rn", F.col("time").alias("t1"))
        one = a.join(b, [*by, "rn"]).select(*by, F.lit(f"{start}_{end}").alias("pair"), F.col("rn").cast("long").alias("rn"), F.greatest(F.col("t1") - F.col("t0"), F.lit(0.0)).alias("duration"))
        out = one if out is None else out.unionByName(one)
    return out


def _matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, nulls equal too; the right side's keys are dropped."""
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(right.withColumnsRenamed({c: f"__r_{c}" for c in on}), same, how).drop(*[f"__r_{c}" for c in on])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles with linear interpolation, null values left out.

    The values are numbered in order by ranges, so that no task holds a group; the
    two values around each rank are then picked by their numbers.
    """
    placed = OrderedGroups(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")), by, ["__v"]).positions("__at")
    sizes = placed.groupBy(*by).agg((F.max("__at") + 1).alias("__n"))
    ranks = sizes.select(*by, "__n", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("__i", "__share"))
    ranks = ranks.withColumn("__rank", F.col("__share") * (F.col("__n") - 1)).withColumn("__low", F.floor("__rank"))
    ends = ranks.withColumn("__at", F.explode(F.array_distinct(F.array("__low", F.ceil("__rank")))))
    above = F.col("__rank") - F.col("__low")
    ends = ends.select(*by, "__i", "__at", F.when(F.col("__at") == F.col("__low"), 1 - above).otherwise(above).alias("__weight"))
    found = _matched(ends, placed, [*by, "__at"]).select(*by, "__i", (F.col("__weight") * F.col("__v")).alias("__part"))
    return found.groupBy(*by).agg(*[F.sum(F.when(F.col("__i") == i, F.col("__part"))).alias(f"q{i}") for i in range(len(shares))])


def stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, total, mean, p50, p90, p99 (linear interpolation), least and largest."""
    v, rows = F.col(value), cut(rows.select(*by, value))  # sums and quantiles both read it
    plain = rows.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("largest"))
    q = quantiles(rows, by, value, [0.5, 0.9, 0.99]).select(*by, F.col("q0").alias("p50"), F.col("q1").alias("p90"), F.col("q2").alias("p99"))
    return _matched(plain, q, by, "left").select(*by, "n", "total", "mean", "p50", "p90", "p99", "least", "largest")


def best_values(log: DataFrame, by: list[str], largest: bool = True) -> DataFrame:
    """First and last time, last and best value, and the first time the best was reached. The best is the largest, or the least."""
    last = F.max_by("value", F.struct("time", "event_id"))
    first_best = F.min_by("time", F.struct(-F.col("value") if largest else F.col("value"), F.col("time")))
    best = F.max("value") if largest else F.min("value")
    return log.groupBy(*by).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), last.alias("last_value"), best.alias("best_value"), first_best.alias("best_time"))


def throughput(log: DataFrame, by: list[str], epochs: int = 1) -> DataFrame:
    """Rows times epochs per second between the first and the last event."""
    return log.groupBy(*by).agg(F.count("*").alias("n"), (F.max("time") - F.min("time")).alias("runtime")).withColumn("throughput", F.when(F.col("runtime") > 0, F.col("n") * F.lit(float(epochs)) / F.col("runtime")))


def hit_rates(log: DataFrame, hit: str, miss: str) -> DataFrame:
    """Hit rate by rows and by the logged values."""
    h, m = F.col("event") == hit, F.col("event") == miss
    rows = F.count(F.when(h, 1)) / F.count(F.when(h | m, 1))
    values = F.sum(F.when(h, F.col("value"))) / F.sum(F.when(h | m, F.col("value")))
    return log.agg(rows.alias("row_rate"), values.alias("value_rate"))


def position_ratio(log: DataFrame, above: str, below: str) -> DataFrame:
    """Mean of i-th value over i-th value."""
    rows = numbered(log, [above, below])
    a = rows.where(F.col("event") == above).select("rn", F.col("value").alias("x"))
    b = rows.where(F.col("event") == below).select("rn", F.col("value").alias("y"))
    return a.join(b, "rn").where("y <> 0").agg(F.avg(F.col("x") / F.col("y")).alias("ratio"))


def confidence(rows: DataFrame, by: list[str], value: str, population: bool = False) -> DataFrame:
    """mean, standard deviation and 1.96 s / sqrt(n); 0 for one row."""
    s = F.stddev_pop(value) if population else F.stddev_samp(value)
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), s.alias("s"))
    std = F.when(F.col("n") > 1, F.col("s")).otherwise(F.lit(0.0))
    return out.select(*by, "n", "mean", std.alias("std"), (F.lit(1.96) * std / F.sqrt("n")).alias("ci95"))


def samples_in_spans(samples: DataFrame, spans: DataFrame, key: str, bin_seconds: float) -> DataFrame:
    """Samples (key, time, ...) inside spans (key, span, t0, t1), ends included.

    A range join as an equi-join: spans go to every bin of time they touch, a
    sample to its own; the bounds are then checked. Pick bins of about the
    median span.
    """
    width = F.lit(float(bin_seconds))
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))))
    return samples.withColumn("bin", F.floor(F.col("time") / width)).join(binned, [key, "bin"]).where("time BETWEEN t0 AND t1").drop("bin")


def phase_rates(samples: DataFrame, spans: DataFrame, key: str, bin_seconds: float) -> DataFrame:
    """(key, span, n, rate): change of value over change of time between consecutive samples of a span, averaged."""
    rows = samples_in_spans(samples, spans, key, bin_seconds)
    own = Window.partitionBy(key, "span").orderBy("time", "event_id")
    rows = rows.withColumn("dv", F.col("value") - F.lag("value").over(own)).withColumn("dt", F.col("time") - F.lag("time").over(own))
    return rows.groupBy(key, "span").agg(F.count("*").alias("n"), F.avg(F.when(F.col("dt") > 0, F.col("dv") / F.col("dt"))).alias("rate"))


def boxcar(rows: DataFrame, by: list[str], width: float) -> DataFrame:
    """Mean of value within width / 2 of each row's time, as the difference of two running sums.

    Each row marks its time and the two ends around it; one scan in order of the marks
    gives the sums at the ends, whatever a group holds. Values are summed in steps of
    10^-9, so that differences of long sums lose nothing.
    """
    half = int(width / 2 * 1_000_000)
    base = cut(rows.withColumn("__us", F.round(F.col("time") * 1_000_000).cast("long")).withColumn("__row", F.monotonically_increasing_id()))
    mark = lambda shift, kind: F.struct((F.col("__us") + shift).alias("at"), F.lit(kind).alias("kind"))
    marks = base.select(*by, "__row", F.col("value").cast("decimal(28,9)").alias("v"), F.explode(F.array(mark(-half, 0), mark(0, 1), mark(half, 2))).alias("m")).select(*by, "__row", "v", "m.at", "m.kind")
    own = F.col("kind") == 1
    sums = OrderedGroups(marks, by, ["at", "kind", "__row"]).running(total=F.when(own, F.col("v")), n=F.when(own & F.col("v").isNotNull(), F.lit(1)))
    signed = lambda c: F.sum(F.when(F.col("kind") == 2, F.col(c)).otherwise(-F.col(c)))
    ends = sums.where(~own).groupBy("__row").agg(signed("total").alias("__total"), signed("n").alias("__n"))
    smooth = F.when(F.col("__n") > 0, F.col("__total").cast("double") / F.col("__n"))
    return base.join(ends, "__row").withColumn("smooth", smooth).drop("__us", "__row", "__total", "__n")


def on_grid(rows: DataFrame, by: str, points: int, bins: int = 64) -> DataFrame:
    """(by, i, t, value): linear interpolation at `points` even times between each series' ends; null where undefined.

    The grid joins the series in time order: for each grid point the last sample
    before and the first after it are carried by running windows (an as-of join
    both ways). A series is cut into `bins` spans of time, so that no task holds a
    whole one; each span's first and last samples, one row a span, are carried to
    the spans after and before.
    """
    ends = rows.groupBy(by).agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    grid = ends.select(by, "t0", "t1", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select(by, "i", (F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("i") / F.lit(float(points - 1))).alias("time"))
    sample = rows.groupBy(by, "time").agg(F.avg("value").alias("value"))
    every = sample.select(by, "time", "value", F.lit(None).cast("int").alias("i"), F.lit(0).alias("kind")).unionByName(grid.select(by, "time", F.lit(None).cast("double").alias("value"), "i", F.lit(1).alias("kind")))
    span = F.when(F.col("t1") > F.col("t0"), F.floor((F.col("time") - F.col("t0")) / (F.col("t1") - F.col("t0")) * bins)).otherwise(F.lit(0))
    every = every.join(ends, by).withColumn("bin", span.cast("long")).drop("t0", "t1")
    point = F.when(F.col("kind") == 0, F.struct("time", "value"))
    spans = every.where("kind = 0").groupBy(by, "bin").agg(F.min(F.struct("time", "value")).alias("head"), F.max(F.struct("time", "value")).alias("tail"))
    near = every.select(by, "bin").distinct().join(spans, [by, "bin"], "left")
    earlier = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(by).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = near.select(by, "bin", F.last("tail", ignorenulls=True).over(earlier).alias("b0"), F.last("head", ignorenulls=True).over(later).alias("a0"))
    before = Window.partitionBy(by, "bin").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by, "bin").orderBy(F.col("time").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = every.withColumn("b", F.last(point, ignorenulls=True).over(before)).withColumn("a", F.last(point, ignorenulls=True).over(after)).where("kind = 1").join(near, [by, "bin"])
    out = out.withColumn("b", F.coalesce("b", "b0")).withColumn("a", F.coalesce("a", "a0"))
    slope = F.when(F.col("a.time") > F.col("b.time"), F.col("b.value") + (F.col("a.value") - F.col("b.value")) * (F.col("time") - F.col("b.time")) / (F.col("a.time") - F.col("b.time"))).otherwise(F.col("b.value"))
    return out.select(by, F.col("i").cast("long").alias("i"), F.col("time").alias("t"), slope.alias("value"))


def trimmed_series(rows: DataFrame, run: str, position: str) -> DataFrame:
    """Rows up to the length of the shortest run."""
    shortest = rows.groupBy(run).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return rows.join(F.broadcast(shortest), F.col(position) <= F.col("least")).drop("least")


def top_operators(rows: DataFrame, by: str, value: str, k: int = 5) -> DataFrame:
    """Mean of value by operator, the k largest."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).orderBy(F.col("mean").desc(), by).limit(k)


def flatten_profile(profile: DataFrame) -> DataFrame:
    """(query, path, operator, time, hits) of nested operator trees (operator, time, hits, children), one level of the schema a step, to its end."""
    now = profile.select("query", F.col("plan").alias("p"), F.lit("0").alias("path"))
    out = None
    while True:
        one = now.select("query", "path", F.col("p.operator").alias("operator"), F.col("p.time").alias("time"), F.col("p.hits").alias("hits"))
        out = one if out is None else out.unionByName(one)
        if "children" not in now.schema["p"].dataType.fieldNames():
            break
        now = now.select("query", "path", F.posexplode("p.children").alias("i", "p")).select("query", "p", F.concat_ws(".", "path", "i").alias("path"))
    return out


def latency_parts(rows: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """What no part explains, at least 0."""
    return rows.withColumn("other", F.greatest(F.col(total) - sum((F.col(p) for p in parts), F.lit(0.0)), F.lit(0.0)))


def ratio_to_baseline(rows: DataFrame, by: list[str], variant: str, baseline: str, value: str) -> DataFrame:
    """Each variant's value over the baseline's, by group."""
    base = rows.where(F.col(variant) == baseline).select(*by, F.col(value).alias("base"))
    return rows.where(F.col(variant) != baseline).join(base, by).select(*by, variant, (F.col(value) / F.col("base")).alias("ratio"))


def after_warmup(rows: DataFrame, by: list[str], order: str, drop: int) -> DataFrame:
    """Rows without the first `drop` of each group."""
    return OrderedGroups(rows, by, [order]).positions("__at").where(F.col("__at") >= drop).drop("__at")


def early_stop(rows: DataFrame, by: str, order: str, value: str, patience: int, min_delta: float) -> DataFrame:
    """(by, stopped_at, best): position after which `patience` values in a row failed to beat the best by more than min_delta; null if never.

    A fold over each run's ordered values; a run is a series of epochs.
    """
    series = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("s"))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("stop"))

    def step(acc, x):
        better = x[value] > acc["best"] + F.lit(min_delta)
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        over = acc["stop"].isNotNull()
        return F.struct(
            F.when(~over & better, x[value]).otherwise(acc["best"]).alias("best"),
            F.when(over, acc["bad"]).otherwise(bad).alias("bad"),
            (acc["i"] + 1).alias("i"),
            F.when(over, acc["stop"]).when(bad >= patience, acc["i"] + 1).alias("stop"),
        )

    out = series.select(by, F.aggregate("s", start, step).alias("r"))
    return out.select(by, F.col("r.stop").cast("long").alias("stopped_at"), F.col("r.best").alias("best"))


def latency_summary(rows: DataFrame, by: list[str], ms: str = "ms", nodes: str = "nodes") -> DataFrame:
    """p50 and p95 of batch latencies, milliseconds a node and nodes a second."""
    t, n = F.sum(ms), F.sum(nodes)
    return rows.groupBy(*by).agg(F.percentile(ms, 0.5).alias("p50"), F.percentile(ms, 0.95).alias("p95"), (t / F.when(n > 0, n)).alias("ms_per_node"), (n * 1000 / F.when(t > 0, t)).alias("throughput"))


def midpoints(log: DataFrame, by: list[str]) -> DataFrame:
    """(by, event_id, middle, value): each sample at the middle between its time and the one before; the first of a series has none and is left out."""
    order = Window.partitionBy(*by).orderBy("time", "event_id")
    rows = log.withColumn("__before", F.lag("time").over(order)).where(F.col("__before").isNotNull())
    return rows.select(*by, "event_id", ((F.col("time") + F.col("__before")) / 2).alias("middle"), "value")


def convergence(log: DataFrame, by: list[str], near: float = 0.99) -> DataFrame:
    """(by, best, converged_after): seconds from the first event to the first value of at least `near` times the best one."""
    best = log.groupBy(*by).agg(F.max("value").alias("best"), F.min("time").alias("__start"))
    rows = log.select(*by, "time", "value").join(best, by).where(F.col("value") >= F.col("best") * near)
    return rows.groupBy(*by, "best", "__start").agg(F.min("time").alias("t")).select(*by, "best", (F.col("t") - F.col("__start")).alias("converged_after"))


def outcomes(rows: DataFrame, by: list[str], status: str = "status", message: str = "message") -> DataFrame:
    """(by, ok, out_of_memory, failed, runs): a failure whose message speaks of memory counts as out_of_memory."""
    ok, oom = F.col(status) == "ok", F.lower(F.coalesce(message, F.lit(""))).rlike("out of memory|oom")
    count = lambda c: F.count(F.when(c, 1))
    bad = ~F.coalesce(ok, F.lit(False))
    return rows.groupBy(*by).agg(count(ok).alias("ok"), count(bad & oom).alias("out_of_memory"), count(bad & ~oom).alias("failed"), F.count("*").alias("runs"))


def server_time(rows: DataFrame, first_record: str, round_trip: str) -> DataFrame:
    """The rows with `server_ms`, the time to the first record without the round trip, 0 at least."""
    return rows.withColumn("server_ms", F.greatest(F.col(first_record) - F.col(round_trip), F.lit(0.0)))
