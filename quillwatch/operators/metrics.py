"""Request counters, health, rates over time, hold-time rules and exposition text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwatch.functions.text import escape_label, strip
from quillwatch.operators.blocks import time_block

DEFAULT_PREFIX = "quillwatch"

# The dynamic routes whose identifier is replaced.
_ALERT_ROUTE = r"^/api/v1/alerts/[^/]+(/ack|/resolve)?$"
_INCIDENT_ROUTE = r"^/api/v1/incidents/[^/]+(/assessment)?$"


def route_template(path: Column) -> Column:
    """Path with the alert or incident identifier replaced by its name."""
    clean = F.coalesce(F.nullif(strip(path), F.lit("")), F.lit("/"))
    alert = F.regexp_replace(clean, _ALERT_ROUTE, "/api/v1/alerts/{alert_id}$1")
    return F.regexp_replace(alert, _INCIDENT_ROUTE, "/api/v1/incidents/{incident_id}$1")


def _routed(access_log: DataFrame) -> DataFrame:
    method = F.coalesce(F.nullif(strip(F.upper("method")), F.lit("")), F.lit("UNKNOWN"))
    return access_log.withColumns(
        {"method": method, "route": route_template(F.col("path"))}
    )


def request_counts(access_log: DataFrame) -> DataFrame:
    """Requests per method, route and status."""
    return (
        _routed(access_log)
        .groupBy("method", "route", "status_code")
        .agg(F.count("*").alias("requests"))
    )


def request_durations(access_log: DataFrame) -> DataFrame:
    """Total and number of durations per method and route; negatives count as zero.

    Durations are added as decimals so that the total does not depend on task order.
    """
    seconds = F.greatest(F.col("duration_seconds"), F.lit(0.0)).cast("decimal(28,12)")
    return (
        _routed(access_log)
        .groupBy("method", "route")
        .agg(
            F.sum(seconds).cast("double").alias("duration_sum"),
            F.count("*").alias("duration_count"),
        )
    )


def latest_probes(probes: DataFrame) -> DataFrame:
    """Last result per component."""
    others = [c for c in probes.columns if c not in ("name", "checked_at_epoch")]
    latest = F.max(F.struct("checked_at_epoch", *others))
    return probes.groupBy("name").agg(latest.alias("p")).select("name", "p.*")


def health_summary(probes: DataFrame) -> DataFrame:
    """One row: status, counts, and the names of failed required / optional components.

    ``probes`` holds one row per configured component.
    """
    down = ~F.col("healthy")

    def failed(kind: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(kind & down, F.col("name"))))

    required = F.col("required")
    return probes.agg(
        F.when(F.count_if(required & down) > 0, "degraded").otherwise("healthy").alias("status"),
        F.count("*").alias("component_count"),
        F.count_if("healthy").alias("healthy_count"),
        failed(required).alias("required_failures"),
        failed(~required).alias("optional_failures"),
    )


def required_down(up: DataFrame, required: DataFrame) -> DataFrame:
    """Components that are down and marked as required; series are (component, value)."""
    must = required.where(F.col("value") == 1).select("component")
    return up.where(F.col("value") == 0).join(must, "component", "left_semi")


def request_rates(access_log: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Requests, requests per second, mean duration and 5xx count per window and status."""
    seconds = F.greatest(F.col("duration_seconds"), F.lit(0.0)).cast("decimal(28,12)")
    span = F.window("ts", window)
    return (
        access_log.groupBy(span.alias("w"), "status_code")
        .agg(
            F.count("*").alias("requests"),
            F.sum(seconds).cast("double").alias("duration_sum"),
            F.count_if(F.col("status_code").between(500, 599)).alias("server_errors"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "status_code",
            "requests",
            (
                F.col("requests")
                / ((F.unix_micros("w.end") - F.unix_micros("w.start")) / F.lit(1_000_000.0))
            ).alias("requests_per_second"),
            (F.col("duration_sum") / F.col("requests")).alias("mean_duration"),
            "server_errors",
        )
    )


def hold_rule(
    samples: DataFrame,
    condition: Column,
    *,
    hold_seconds: int | Column,
    series: str = "series",
    ts: str = "ts",
    block_seconds: int = 3_600,
) -> DataFrame:
    """Spells in which a condition holds at every sample, and whether they last long enough.

    Result: series, started, ended, samples, fires, fires_at (first sample at which the
    condition has held for ``hold_seconds``, one value for a series). Of samples at one time those that
    do not hold come first.

    A series is cut into blocks of time. Spells inside a block are done there; of those that
    touch its borders a block keeps one summary at either end, and only these are put in order
    and joined. The samples are read and shuffled once.
    """
    flagged = samples.select(
        F.col(series).alias("series"),
        F.col(ts).alias("ts"),
        F.coalesce(condition, F.lit(False)).alias("holds"),
        (hold_seconds if isinstance(hold_seconds, Column) else F.lit(hold_seconds)).alias("hold"),
    ).withColumn("block", time_block(F.col("ts"), block_seconds))
    inside = Window.partitionBy("series", "block").orderBy("ts", "holds")
    numbered = flagged.withColumns(
        {
            "place": F.row_number().over(inside),
            "run": F.count_if(~F.col("holds")).over(
                inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        }
    )
    runs = (
        numbered.groupBy("series", "block", "run")
        .agg(
            F.min(F.when(F.col("holds"), F.col("ts"))).alias("started"),
            F.max(F.when(F.col("holds"), F.col("ts"))).alias("ended"),
            F.count_if("holds").alias("samples"),
            F.min("place").alias("first_place"),
            F.max("place").alias("last_place"),
            F.max("hold").alias("hold"),
            F.array_sort(F.collect_list(F.when(F.col("holds"), F.col("ts")))).alias("times"),
        )
        .withColumns(
            {
                # run 0 has no sample before it; the others begin with one that does not hold
                "leads": (F.col("run") == 0) & (F.col("samples") > 0),
                "trails": F.col("last_place")
                == F.max("last_place").over(Window.partitionBy("series", "block")),
            }
        )
    )
    hold = F.make_dt_interval(secs=F.col("hold"))
    due = F.col("started") + hold
    fired = F.get(F.filter("times", lambda t: t >= due), F.lit(0))
    done = runs.where("samples > 0 and not leads and not trails").select(
        "series", "started", "ended", "samples", fired.alias("fires_at")
    )
    ends = runs.where("leads or trails").select(
        "series", "block", "run", "leads", "trails", "started", "ended", "samples", "times", "hold",
    )
    in_order = Window.partitionBy("series").orderBy("block", "run")
    # the run before a leading one is the one that ends the block before
    joins = F.col("leads") & (F.coalesce(F.lag("samples").over(in_order), F.lit(0)) > 0)
    spells = (
        ends.withColumn("opens", (~joins).cast("int"))
        .withColumn(
            "spell",
            F.sum("opens").over(
                in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .where("samples > 0")
    )
    opened = F.min("started").over(Window.partitionBy("series", "spell"))
    joined = (
        spells.withColumn("due", opened + hold)
        .groupBy("series", "spell")
        .agg(
            F.min("started").alias("started"),
            F.max("ended").alias("ended"),
            F.sum("samples").alias("samples"),
            F.min(F.get(F.filter("times", lambda t: t >= F.col("due")), F.lit(0))).alias("fires_at"),
        )
        .drop("spell")
    )
    return done.unionByName(joined).select(
        "series",
        "started",
        "ended",
        "samples",
        F.col("fires_at").isNotNull().alias("fires"),
        "fires_at",
    )


def counter_increase(
    samples: DataFrame,
    at: DataFrame,
    *,
    range_seconds: int,
    keys: Sequence[str] = ("series",),
) -> DataFrame:
    """``at`` with ``increase``: growth of cumulative counters in the range before each time.

    ``samples``: keys, ts, value; ``at``: keys, at. A value below the one before it is a reset,
    after which the counter began at zero. Of the samples in (at - range, at] the growth from
    the first to the last is carried on to the borders of the range: by the distance to a border
    if that is below 1.1 times the mean distance of samples, else by half that mean; before the
    first sample never further than to where the counter would have been zero. Fewer than two
    samples give no increase (null).

    Times and samples meet in cells of ``range_seconds``, so a time reads two cells of its
    series and no range join walks the whole series. Growth within the range is a difference
    of running totals that are summed block by block.
    """
    keys = list(keys)
    span = range_seconds * 1_000_000
    cell = F.floor(F.col("t") / F.lit(span)).cast("bigint")
    placed = samples.select(*keys, F.unix_micros("ts").alias("t"), "value").withColumn("cell", cell)
    # the value before, across cells: only the last sample of each cell is put in order
    inside = Window.partitionBy(*keys, "cell").orderBy("t")
    lasts = placed.groupBy(*keys, "cell").agg(F.max(F.struct("t", "value")).alias("last"))
    entering = lasts.select(
        *keys, "cell",
        F.lag("last.value").over(Window.partitionBy(*keys).orderBy("cell")).alias("entering"),
    )
    grown = placed.join(entering, [*keys, "cell"]).withColumn(
        "before", F.coalesce(F.lag("value").over(inside), "entering")
    )
    step = F.when(F.col("value") < F.col("before"), F.col("value")).otherwise(
        F.col("value") - F.col("before")
    )
    grown = grown.select(*keys, "cell", "t", "value", F.coalesce(step, F.lit(0.0)).alias("step"))
    # a sample of a cell is in range for times of this cell and of the next one
    seen = grown.withColumn(
        "cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1))
    ).withColumnsRenamed({"t": "s"})
    asked = at.select(*keys, "at").distinct().select(*keys, "at", F.unix_micros("at").alias("t"))
    asked = asked.withColumn("cell", cell)
    inner = (F.col("s") > F.col("t") - span) & (F.col("s") <= F.col("t"))
    found = (
        asked.join(seen, [*keys, "cell"])
        .where(inner)
        .groupBy(*keys, "at", "t")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("s", "value", "step")).alias("first"),
            F.max("s").alias("last"),
            F.sum("step").alias("grown"),
        )
    )
    # the first sample's own growth came from before the range
    growth = F.col("grown") - F.col("first.step")
    covered = (F.col("last") - F.col("first.s")).cast("double")
    mean = covered / (F.col("n") - 1)
    lead = (F.col("first.s") - (F.col("t") - span)).cast("double")
    trail = (F.col("t") - F.col("last")).cast("double")
    lead = F.when(lead < mean * 1.1, lead).otherwise(mean / 2)
    trail = F.when(trail < mean * 1.1, trail).otherwise(mean / 2)
    to_zero = F.when(growth > 0, covered * F.col("first.value") / growth)
    lead = F.least(lead, F.coalesce(to_zero, lead))
    increase = F.when(
        (F.col("n") > 1) & (covered > 0), growth * ((covered + lead + trail) / covered)
    )
    return at.join(found.select(*keys, "at", increase.alias("increase")), [*keys, "at"], "left")


# Metric families in their order, each with kind and help text.
FAMILIES = (
    ("info", "gauge", "Package information."),
    ("http_requests_total", "counter", "Total API HTTP requests."),
    ("http_request_duration_seconds_sum", "counter", "Sum of API request durations."),
    ("http_request_duration_seconds_count", "counter", "Count of measured API requests."),
    ("alerts_total", "gauge", "Current deduplicated alerts by lifecycle status."),
    ("alerts_by_severity", "gauge", "Current deduplicated alerts by severity."),
    ("alert_store_up", "gauge", "Whether the configured alert store is readable."),
    ("incidents_total", "gauge", "Current correlated incidents by status and severity."),
    ("incident_recurrence_max", "gauge", "Maximum occurrences in an active incident."),
    ("component_up", "gauge", "Last distributed component probe result."),
    ("component_probe_duration_seconds", "gauge", "Last component probe duration."),
    ("component_required", "gauge", "Whether the component is required for readiness."),
)
_POSITION = {name: place for place, (name, _, _) in enumerate(FAMILIES)}

SERIES = "place int, part int, key array<string>, value string"


def _sample(prefix: str, family: str, labels: dict[str, Column], value: Column) -> Column:
    """A line of a family as (place, part, key, value); values of the labels are its order."""
    texts = {name: F.coalesce(text.cast("string"), F.lit("unknown")) for name, text in labels.items()}
    parts: list[Column] = [F.lit(f"{prefix}_{family}")]
    for n, (name, text) in enumerate(texts.items()):
        parts += [F.lit(f'{"," if n else "{"}{name}="'), escape_label(text), F.lit('"')]
    parts.append(F.lit("} " if texts else " "))
    return F.struct(
        F.lit(_POSITION[family]).alias("place"),
        F.lit(2).alias("part"),
        F.array(*texts.values()).cast("array<string>").alias("key"),
        F.concat(*parts, value.cast("string")).alias("value"),
    )


def _lines(frame: DataFrame, prefix: str, families: Sequence[str], samples: Column) -> DataFrame:
    """Help and type lines of families, and the lines that each row of the frame gives."""
    heads = [
        (place, part, [], f"# {word} {prefix}_{name} {text}")
        for place, (name, kind, about) in enumerate(FAMILIES)
        if name in families
        for part, word, text in ((0, "HELP", about), (1, "TYPE", kind))
    ]
    constant = frame.sparkSession.createDataFrame(heads, SERIES)
    lines = frame.select(F.explode(F.array_compact(samples)).alias("line")).select("line.*")
    return constant.unionByName(lines)


def nine_digits(value: Column) -> Column:
    return F.format_string("%.9f", value)


def info_series(spark: SparkSession, version: str, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    line = _sample(prefix, "info", {"version": F.lit(version)}, F.lit(1))
    return _lines(spark.range(1), prefix, ["info"], F.array(line))


def request_series(access_log: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Counters of requests by route and status, and of durations by route, from one grouping."""
    seconds = F.greatest(F.col("duration_seconds"), F.lit(0.0)).cast("decimal(28,12)")
    names = ("method", "route", "status_code")
    grouped = (
        _routed(access_log)
        .select(*names, seconds.alias("seconds"))
        .groupingSets([list(names), list(names[:2])], *names)
        .agg(
            F.count("*").alias("n"),
            F.sum("seconds").cast("double").alias("total"),
            F.grouping("status_code").alias("whole_route"),
        )
    )
    route = {"method": F.col("method"), "path": F.col("route")}
    whole = F.col("whole_route") == 1
    duration = "http_request_duration_seconds"
    samples = F.array(
        F.when(
            ~whole,
            _sample(prefix, "http_requests_total", {**route, "status": F.col("status_code")}, F.col("n")),
        ),
        F.when(whole, _sample(prefix, f"{duration}_sum", route, nine_digits(F.col("total")))),
        F.when(whole, _sample(prefix, f"{duration}_count", route, F.col("n"))),
    )
    families = ["http_requests_total", f"{duration}_sum", f"{duration}_count"]
    return _lines(grouped, prefix, families, samples)


def alert_series(
    alerts: DataFrame, prefix: str = DEFAULT_PREFIX, *, backend: str = "parquet"
) -> DataFrame:
    """Gauges of alerts by status and by severity from one grouping, and that the store is up."""
    names = ("status", "severity")
    # a row of its own for the store, so that it is told of an empty one too
    store = alerts.sparkSession.range(1).select(
        F.lit("").alias("status"), F.lit("").alias("severity"), F.lit(True).alias("store")
    )
    rows = alerts.select(
        *(F.coalesce(c, F.lit("unknown")).alias(c) for c in names), F.lit(False).alias("store")
    ).unionByName(store)
    grouped = rows.groupingSets([["store", "status"], ["store", "severity"]], "store", *names).agg(
        F.count("*").alias("n"), F.grouping("severity").alias("by_status")
    )
    by_status, store = F.col("by_status") == 1, F.col("store")
    samples = F.array(
        F.when(
            ~store & by_status,
            _sample(prefix, "alerts_total", {"status": F.col("status")}, F.col("n")),
        ),
        F.when(
            ~store & ~by_status,
            _sample(prefix, "alerts_by_severity", {"severity": F.col("severity")}, F.col("n")),
        ),
        F.when(
            store & by_status,
            _sample(prefix, "alert_store_up", {"backend": F.lit(backend)}, F.lit(1)),
        ),
    )
    return _lines(grouped, prefix, ["alerts_total", "alerts_by_severity", "alert_store_up"], samples)


def store_down_series(spark: SparkSession, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """In place of alert and incident series while the store cannot be read."""
    line = _sample(prefix, "alert_store_up", {"backend": F.lit("unknown")}, F.lit(0))
    return _lines(spark.range(1), prefix, ["alert_store_up"], F.array(line))


def incident_series(incidents: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Gauges of incidents by status and severity and the greatest recurrence, from one grouping."""
    names = ("status", "severity")
    active = F.when(F.col("status") != "resolved", F.col("occurrence_count"))
    # a row without status or severity, so that the total is told of no incidents too
    nobody = incidents.sparkSession.range(1).select(
        *(F.lit(None).cast("string").alias(c) for c in names), F.lit(0).cast("bigint").alias("active")
    )
    rows = incidents.select(*names, active.cast("bigint").alias("active")).unionByName(nobody)
    grouped = rows.groupingSets([list(names), []], *names).agg(
        F.count("*").alias("n"), F.max("active").alias("most"), F.grouping("status").alias("all")
    )
    total = F.col("all") == 1
    labels = {c: F.col(c) for c in names}
    samples = F.array(
        F.when(
            ~total & F.col("status").isNotNull(),
            _sample(prefix, "incidents_total", labels, F.col("n")),
        ),
        F.when(total, _sample(prefix, "incident_recurrence_max", {}, F.col("most"))),
    )
    return _lines(grouped, prefix, ["incidents_total", "incident_recurrence_max"], samples)


def component_series(probes: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Three gauges of each component, from one pass."""
    label = {"component": F.col("name")}
    up = F.when(F.col("healthy"), F.lit(1)).otherwise(F.lit(0))
    need = F.when(F.col("required"), F.lit(1)).otherwise(F.lit(0))
    families = ["component_up", "component_probe_duration_seconds", "component_required"]
    values = (up, nine_digits(F.col("duration_seconds")), need)
    samples = F.array(
        *(_sample(prefix, f, label, v) for f, v in zip(families, values, strict=True))
    )
    return _lines(probes, prefix, families, samples)


def exposition_lines(series: DataFrame) -> DataFrame:
    """Ordered text lines of series: families in their order, help and type before the samples."""
    return series.orderBy("place", "part", "key").select("value")
