"""The seven operational alert rules over metric samples.

``samples``: metric, labels (map of text), ts, value. All rules are selected in one pass over the
samples and their hold times followed in one pass over the selected values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.operators.metrics import DEFAULT_PREFIX, counter_increase, hold_rule

RANGE_SECONDS = 300


@dataclass(frozen=True)
class AlertRule:
    name: str
    hold_seconds: int
    severity: str
    summary: str


# Names, hold times, severities and texts of the rules.
RULES = (
    AlertRule("ServiceDown", 120, "critical", "Metrics endpoint is unavailable"),
    AlertRule("AlertStoreUnavailable", 60, "critical", "Alert store is unavailable"),
    AlertRule("CriticalAlertsPresent", 60, "warning",
              "Critical database-security alerts require review"),
    AlertRule("CriticalIncidentOpen", 60, "critical", "Critical correlated incident is active"),
    AlertRule("RecurringIncidentActivity", 120, "warning",
              "Recurrent activity detected in an incident"),
    AlertRule("RequiredComponentDown", 120, "critical", "Required component is unhealthy"),
    AlertRule("ServerErrors", 60, "warning", "API returned server errors"),
)
RECURRENCES = 3


def series_key(labels: Column) -> Column:
    """The labels as text, in the order of their names."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def server_error_growth(
    samples: DataFrame, *, prefix: str = DEFAULT_PREFIX, range_seconds: int = RANGE_SECONDS
) -> DataFrame:
    """``ts, increase``: growth of all 5xx request counters, at every time that has a sample of one.

    Each counter is asked at the times that lie less than a range behind one of its samples.
    """
    status = F.col("labels")["status"]
    counters = samples.where(
        (F.col("metric") == f"{prefix}_http_requests_total") & status.rlike("^5..$")
    ).select(series_key(F.col("labels")).alias("series"), "ts", F.col("value").cast("double"))
    cell = F.floor(F.unix_micros("ts") / F.lit(range_seconds * 1_000_000)).cast("bigint")
    times = counters.select("ts").distinct().withColumn("cell", cell)
    near = counters.select(
        "series", F.explode(F.array(cell, cell + 1)).alias("cell")
    ).distinct()
    asked = near.join(times, "cell").select("series", F.col("ts").alias("at"))
    grown = counter_increase(counters, asked, range_seconds=range_seconds)
    return (
        grown.where(F.col("increase").isNotNull())
        .groupBy(F.col("at").alias("ts"))
        .agg(F.sum("increase").alias("increase"))
    )


def rule_values(samples: DataFrame, *, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """``rule, series, ts, holds`` of the rules over values at one time, from one pass."""
    metric, labels = F.col("metric"), F.col("labels")
    named = {name: metric == f"{prefix}_{name}" for name in (
        "alert_store_up", "alerts_by_severity", "incidents_total", "incident_recurrence_max",
        "component_up", "component_required",
    )}
    critical = labels["severity"] == "critical"
    rule = (
        F.when((metric == "up") & (labels["job"] == prefix), "ServiceDown")
        .when(named["alert_store_up"], "AlertStoreUnavailable")
        .when(named["alerts_by_severity"] & critical, "CriticalAlertsPresent")
        .when(
            named["incidents_total"]
            & critical
            & ~F.coalesce(labels["status"], F.lit("")).eqNullSafe("resolved"),
            "CriticalIncidentOpen",
        )
        .when(named["incident_recurrence_max"], "RecurringIncidentActivity")
        .when(named["component_up"] | named["component_required"], "RequiredComponentDown")
    )
    series = (
        F.when(rule == "CriticalIncidentOpen", "")
        .when(rule == "RequiredComponentDown", F.concat(F.lit("component="), labels["component"]))
        .otherwise(series_key(labels))
    )
    up, need = (F.max(F.when(named[f"component_{k}"], F.col("value"))) for k in ("up", "required"))
    total = F.sum("value")
    found = (
        samples.select(rule.alias("rule"), series.alias("series"), "metric", "ts", "value")
        .where(F.col("rule").isNotNull())
        .groupBy("rule", "series", "ts")
        .agg(total.alias("total"), up.alias("up"), need.alias("need"))
    )
    holds = (
        F.when(F.col("rule").isin("ServiceDown", "AlertStoreUnavailable"), F.col("total") == 0)
        .when(F.col("rule") == "RecurringIncidentActivity", F.col("total") >= RECURRENCES)
        .when(F.col("rule") == "RequiredComponentDown", (F.col("up") == 0) & (F.col("need") == 1))
        .otherwise(F.col("total") > 0)
    )
    return found.select("rule", "series", "ts", F.coalesce(holds, F.lit(False)).alias("holds"))


def fired_rules(
    samples: DataFrame, *, prefix: str = DEFAULT_PREFIX, block_seconds: int = 3_600
) -> DataFrame:
    """Spells of every rule: rule, severity, summary, series, started, ended, samples, fires, fires_at.

    ``series`` has the labels of the series that the rule holds for, or is empty for a sum. A
    rule is judged at the times its values are sampled.
    """
    growth = server_error_growth(samples, prefix=prefix).select(
        F.lit("ServerErrors").alias("rule"), F.lit("").alias("series"), "ts",
        (F.col("increase") > 0).alias("holds"),
    )
    values = rule_values(samples, prefix=prefix).unionByName(growth)
    hold = F.create_map(*(F.lit(x) for r in RULES for x in (r.name, r.hold_seconds)))
    about = F.create_map(
        *(x for r in RULES for x in (F.lit(r.name), F.struct(F.lit(r.severity), F.lit(r.summary))))
    )
    spells = hold_rule(
        values.withColumn("key", F.struct("rule", "series")),
        F.col("holds"),
        hold_seconds=hold[F.col("rule")],
        series="key",
        block_seconds=block_seconds,
    )
    rule = F.col("series.rule")
    return spells.select(
        rule.alias("rule"),
        about[rule]["col1"].alias("severity"),
        about[rule]["col2"].alias("summary"),
        F.col("series.series").alias("series"),
        "started",
        "ended",
        "samples",
        "fires",
        "fires_at",
    )
