"""Weighted statement rules, their combined score and the decision texts.

The rules of a statement are bit masks of up to 62 rules each, and score, severity,
indicators and texts are expressions of the masks: no shuffle, no join, no Python, and one
plan for any number of rules. Columns that a query does not use are pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.domains import parse_severity, severity_rank
from quillwatch.functions.numeric import fixed_text, round_unit
from quillwatch.functions.text import WHITESPACE_CLASS, is_ascii
from quillwatch.operators.once import computed_once

_WORD = r"[\p{L}\p{N}_]"
_SPACE = f"[{WHITESPACE_CLASS}]"
_START = f"(?<!{_WORD})"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

DETECTOR_NAME = "rule-detector"
DETECTOR_VERSION = "0.1.0"


@dataclass(frozen=True)
class Rule:
    """A named, weighted, case-insensitive search over the statement text.

    ``pattern`` is Java regex text in which ``\\w``, ``\\s`` and ``\\b`` keep their full
    Unicode meaning. ``hints`` are lower-case literals of which one must appear in every
    ASCII statement the pattern can match; they let a cheap byte search skip the regex.
    ``dotall`` lets ``.`` cross line ends.
    """

    name: str
    pattern: str
    weight: float
    description: str
    hints: tuple[str, ...] = ()
    dotall: bool = False

    def java_pattern(self) -> str:
        text = self.pattern.replace(r"[\w", f"[{_WORD[1:-1]}")
        text = text.replace(r"\s", _SPACE).replace(r"\w", _WORD)
        return ("(?ius)" if self.dotall else "(?iu)") + text

    def hit(self, statement: Column, lowered: Column, ascii_only: Column) -> Column:
        """Boolean column: does the rule fire on the statement."""
        search = _bounded(self.java_pattern())
        matched = statement.rlike(search)
        if not self.hints:
            return matched
        hinted = F.contains(lowered, F.lit(self.hints[0]))
        for literal in self.hints[1:]:
            hinted = hinted | F.contains(lowered, F.lit(literal))
        return (hinted | ~ascii_only) & matched


def _bounded(pattern: str) -> str:
    r"""Write ``\b`` as lookarounds over the Unicode word class.

    The meaning of ``\b`` depends on the JDK version. Next to a plain word character only one
    side is open; everywhere else both sides are tested. An escaped backslash before a ``b``
    and a ``\b`` inside a character class stay as they are.
    """
    out: list[str] = []
    in_class, at = False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\b" and not in_class:
            rest = pattern[at + 2 :]
            plain = rest[:1].isalnum() or rest[:1] == "_"
            optional = rest[1:2] in {"?", "*", "|", "{"}
            out.append(_START if plain and not optional else _EDGE)
            at += 2
        elif two[:1] == "\\" and len(two) == 2:
            out.append(two)
            at += 2
        else:
            in_class = two[:1] == "[" or (in_class and two[:1] != "]")
            out.append(two[:1])
            at += 1
    return "".join(out)


# Rule names, patterns, weights and descriptions, in scoring order.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "drop-database",
        r"\bDROP\s+DATABASE\b",
        0.95,
        "Database deletion statement detected.",
        ("drop",),
    ),
    Rule(
        "drop-table",
        r"\bDROP\s+TABLE\b",
        0.80,
        "Table deletion statement detected.",
        ("drop",),
    ),
    Rule(
        "truncate-table",
        r"\bTRUNCATE\s+(?:TABLE\s+)?",
        0.75,
        "Table truncation statement detected.",
        ("truncate",),
    ),
    Rule(
        "delete-without-where",
        r"^\s*DELETE\s+FROM\s+[\w.\"`\[\]]+\s*;?\s*$",
        0.85,
        "DELETE statement without a WHERE clause detected.",
        ("delete",),
    ),
    Rule(
        "grant-privileges",
        r"\bGRANT\s+.+\s+TO\b",
        0.65,
        "Database privilege grant operation detected.",
        ("grant",),
        dotall=True,
    ),
    Rule(
        "revoke-privileges",
        r"\bREVOKE\s+.+\s+FROM\b",
        0.55,
        "Database privilege revocation operation detected.",
        ("revoke",),
        dotall=True,
    ),
    Rule(
        "union-select",
        r"\bUNION\s+(?:ALL\s+)?SELECT\b",
        0.55,
        "Potential UNION-based SQL injection pattern detected.",
        ("union",),
    ),
    Rule(
        "always-true-condition",
        r"\bOR\s+(['\"]?)(\w+)\1\s*=\s*(['\"]?)\2\3",
        0.60,
        "Potential always-true SQL condition detected.",
        ("or",),
    ),
    Rule(
        "sql-comment",
        r"(--|/\*)",
        0.20,
        "SQL comment syntax detected.",
        ("--", "/*"),
    ),
    Rule(
        "xp-cmdshell",
        r"\bxp_cmdshell\b",
        0.95,
        "Operating-system command execution detected.",
        ("xp_cmdshell",),
    ),
    Rule(
        "load-file",
        r"\bLOAD_FILE\s*\(",
        0.75,
        "Database file-reading function detected.",
        ("load_file",),
    ),
    Rule(
        "sleep-function",
        r"\b(?:SLEEP|PG_SLEEP|WAITFOR)\b",
        0.55,
        "Potential time-based SQL injection function detected.",
        ("sleep", "waitfor"),
    ),
)

# Advice per severity.
ACTIONS = {
    "info": "No immediate action is required. Continue normal monitoring.",
    "low": "Record the event and continue enhanced monitoring.",
    "medium": "Create a security alert and request analyst review.",
    "high": (
        "Create a high-priority alert, preserve the available "
        "evidence and request immediate analyst review."
    ),
    "critical": (
        "Create a critical alert, preserve the available evidence "
        "and initiate the human-controlled incident-response procedure."
    ),
}


def severity_of(score: Column) -> Column:
    """Severity bucket of a score."""
    return (
        F.when(score >= 0.90, "critical")
        .when(score >= 0.75, "high")
        .when(score >= 0.50, "medium")
        .when(score > 0.0, "low")
        .otherwise("info")
    )


def is_anomalous(score: Column) -> Column:
    return score >= 0.50


def recommended_action(severity: Column) -> Column:
    ladder = None
    for name, text in ACTIONS.items():
        ladder = F.when(severity == name, text) if ladder is None else ladder.when(
            severity == name, text
        )
    return ladder


def explanation(indicators: Column, score: Column, detector_name: Column) -> Column:
    found = F.concat(
        F.lit("The event received a risk score of "),
        fixed_text(score, 2),
        F.lit(". "),
        F.array_join(indicators, " "),
    )
    return F.when(F.size(indicators) > 0, found).otherwise(
        F.concat(
            F.lit("No suspicious SQL pattern was identified by the "),
            detector_name,
            F.lit(" detector."),
        )
    )


def noisy_or(hits: Sequence[Column], weights: Sequence[float]) -> Column:
    """``1 - prod(1 - w)`` over the rules that fire, not yet rounded.

    Rules that do not fire multiply by exactly 1.0, so the doubles are those of a
    left-to-right product over the firing rules only.
    """
    safety = F.lit(1.0)
    for hit, weight in zip(hits, weights, strict=True):
        keep = 1.0 - min(max(weight, 0.0), 1.0)
        safety = safety * F.when(hit, F.lit(keep)).otherwise(F.lit(1.0))
    return F.lit(1.0) - safety


RULES_PER_MASK = 62


def mask_names(rules: Sequence[Rule]) -> list[str]:
    """Names of the mask columns: ``rule_mask`` for the first 62 rules, then ``rule_mask_1`` ..."""
    words = -(-len(rules) // RULES_PER_MASK)
    return ["rule_mask", *(f"rule_mask_{i}" for i in range(1, words))]


def match_rules(
    events: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, statement: str = "query"
) -> DataFrame:
    """Add the mask columns: bit ``i % 62`` of mask ``i // 62`` is set when rule ``i`` fires.

    The lower-cased text is computed once, in its own projection.
    """
    if not rules:
        raise ValueError("at least one rule is needed")
    prepared = events.withColumns(
        {"_lowered": F.lower(F.col(statement)), "_ascii": is_ascii(F.col(statement))}
    )
    masks = [F.lit(0).cast("bigint") for _ in mask_names(rules)]
    for position, rule in enumerate(rules):
        word, bit = divmod(position, RULES_PER_MASK)
        hit = rule.hit(F.col(statement), F.col("_lowered"), F.col("_ascii"))
        masks[word] = masks[word] + F.when(hit, F.lit(1 << bit).cast("bigint")).otherwise(
            F.lit(0).cast("bigint")
        )
    return prepared.withColumns(dict(zip(mask_names(rules), masks, strict=True))).drop(
        "_lowered", "_ascii"
    )


def mask_hits(rules: Sequence[Rule]) -> list[Column]:
    names = mask_names(rules)
    return [
        F.col(names[i // RULES_PER_MASK]).bitwiseAND(
            F.lit(1 << i % RULES_PER_MASK).cast("bigint")
        )
        != 0
        for i in range(len(rules))
    ]


def mask_decisions(
    masks: DataFrame, rules: Sequence[Rule], detector_name: str, detector_version: str
) -> DataFrame:
    """Every decision column as a function of the masks."""
    hits = mask_hits(rules)
    raw = computed_once(masks, _raw_score=noisy_or(hits, [rule.weight for rule in rules]))
    rated = computed_once(raw, risk_score=round_unit(F.col("_raw_score"), 4))
    scored = rated.withColumns(
        {
            "indicators": F.array_compact(
                F.array(
                    *[F.when(hit, rule.description) for hit, rule in zip(hits, rules, strict=True)]
                )
            ),
            "detector_name": F.lit(detector_name),
            "detector_version": F.lit(detector_version),
            "severity": severity_of(F.col("risk_score")),
        }
    )
    # told from the masks, so that a query without the indicators does not list them
    found = reduce(or_, [F.col(name) != 0 for name in mask_names(rules)])
    classed = scored.withColumn(
        "classification",
        F.when(found, "suspicious_sql_activity").otherwise("normal_sql_activity"),
    ).drop("_raw_score")
    return _with_advice(classed)


ADVICE = ("is_anomalous", "explanation", "recommended_action")


def _with_advice(detected: DataFrame) -> DataFrame:
    return detected.withColumns(
        {
            "is_anomalous": is_anomalous(F.col("risk_score")),
            "explanation": explanation(
                F.col("indicators"), F.col("risk_score"), F.col("detector_name")
            ),
            "recommended_action": recommended_action(F.col("severity")),
        }
    )


def detect(
    events: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    *,
    detector_name: str = DETECTOR_NAME,
    detector_version: str = DETECTOR_VERSION,
    statement: str = "query",
) -> DataFrame:
    """Append risk_score, severity, classification, indicators and detector columns."""
    return _decide(events, rules, detector_name, detector_version, statement).drop(*ADVICE)


def _decide(
    events: DataFrame,
    rules: Sequence[Rule],
    detector_name: str,
    detector_version: str,
    statement: str,
) -> DataFrame:
    """Events with every decision column; unused ones are pruned."""
    fixed = _fixed_masks(match_rules(events, rules, statement), rules)
    return mask_decisions(fixed, rules, detector_name, detector_version).drop(*mask_names(rules))


def _fixed_masks(matched: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Keep later filters on the masks from running the regexes again below."""
    names = mask_names(rules)
    once = computed_once(matched, **{f"_{name}": F.col(name) for name in names})
    fixed = once.withColumns({name: F.col(f"_{name}") for name in names})
    return fixed.drop(*[f"_{name}" for name in names])


Detector = Callable[[DataFrame], DataFrame]


def analyze(
    events: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    *,
    detector: Detector | None = None,
    detector_name: str = DETECTOR_NAME,
) -> DataFrame:
    """Events plus the full decision.

    ``detector`` replaces the rules: a function from events to events with
    ``risk_score``, ``severity``, ``classification``, ``indicators`` and
    ``detector_name``. A score outside [0, 1] stops the job.
    """
    if detector is None:
        full = _decide(events, rules, detector_name, DETECTOR_VERSION, "query")
    else:
        full = _with_advice(
            detector(events).withColumn(
                "risk_score",
                F.when(F.col("risk_score").between(0.0, 1.0), F.col("risk_score")).otherwise(
                    F.raise_error(F.lit("risk_score must be between 0.0 and 1.0")).cast("double")
                ),
            )
        )
    return full.withColumn("automatic_action", F.lit(None).cast("string"))


def decisions(analyzed: DataFrame) -> DataFrame:
    """The eight decision columns."""
    return analyzed.select(
        "event_id",
        "risk_score",
        "severity",
        "classification",
        "indicators",
        "explanation",
        "recommended_action",
        "automatic_action",
    )


def threshold(
    analyzed: DataFrame, min_risk: float = 0.0, min_severity: str | None = None
) -> DataFrame:
    """Keep rows at or above both thresholds."""
    if not 0.0 <= min_risk <= 1.0:
        raise ValueError("min_risk must be between 0.0 and 1.0")
    name = parse_severity(min_severity)
    kept = analyzed.where(F.col("risk_score") >= min_risk)
    if name is None:
        return kept
    floor = severity_rank(F.lit(name))
    return kept.where(severity_rank(F.col("severity"), unknown=-1) >= floor)


def rule_report(events: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Hits, distinct actors and mean score per rule.

    Events are counted per user and mask first; only those few rows are spread over rules.
    """
    per_mask = (
        match_rules(events, rules)
        .groupBy(*mask_names(rules), "username")
        .agg(F.count("*").alias("n"))
    )
    # the scores of the masks that occur, worked out after grouping
    fixed = _fixed_masks(per_mask, rules)
    rated = mask_decisions(fixed, rules, DETECTOR_NAME, DETECTOR_VERSION).select(
        "username",
        "n",
        F.round(F.col("risk_score") * 10_000).cast("bigint").alias("units"),
        F.explode("indicators").alias("description"),
    )
    names = F.create_map(*[F.lit(x) for r in rules for x in (r.description, r.name)])
    per_user = rated.groupBy("description", "username").agg(
        F.sum("n").alias("hits"), F.sum(F.col("n") * F.col("units")).alias("units")
    )
    return (
        per_user.groupBy("description")
        .agg(
            F.sum("hits").alias("hits"),
            F.count("*").alias("actors"),
            (F.sum("units") / F.lit(10_000.0) / F.sum("hits")).alias("mean_score"),
        )
        .select(F.element_at(names, F.col("description")).alias("rule"), "*")
    )


def sql_functions(spark, rules: Sequence[Rule] = DEFAULT_RULES) -> None:
    """Register ``risk_score(sql)`` and ``risk_severity(sql)`` for use in SQL text.

    They are temporary SQL functions over built-in expressions, so they are inlined
    into the plan instead of calling Python.
    """
    terms = []
    for rule in rules:
        pattern = _bounded(rule.java_pattern()).replace("\\", "\\\\").replace("'", "\\'")
        keep = 1.0 - min(max(rule.weight, 0.0), 1.0)
        terms.append(f"if(q rlike '{pattern}', {keep!r}D, 1.0D)")
    raw = "1.0D - " + "(1.0D * " + " * ".join(terms) + ")"
    # doubled units in steps of 2**-60: half-even division by 2**61 of an exact integer
    spark.sql(
        "create or replace temporary function unit_half_even(t decimal(38,0)) returns double "
        "return (t div cast(2305843009213693952 as decimal(20,0)) - if("
        "t % cast(2305843009213693952 as decimal(20,0)) = 0 and "
        "t div cast(2305843009213693952 as decimal(20,0)) % 2 = 1, 1, 0)) / 10000.0D"
    )
    m = "cast(cast(x * 1152921504606846976D as bigint) as decimal(20,0))"
    spark.sql(
        "create or replace temporary function unit_round4(x double) returns double return "
        f"unit_half_even({m} * 20000 + cast(1152921504606846976 as decimal(20,0)))"
    )
    spark.sql(
        "create or replace temporary function risk_score(q string) returns double "
        f"return unit_round4({raw})"
    )
    spark.sql(
        "create or replace temporary function risk_severity(q string) returns string return "
        "case when risk_score(q) >= 0.90 then 'critical' when risk_score(q) >= 0.75 then 'high' "
        "when risk_score(q) >= 0.50 then 'medium' when risk_score(q) > 0.0 then 'low' "
        "else 'info' end"
    )
