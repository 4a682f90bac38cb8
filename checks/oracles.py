"""Common table expressions of the checking SQL, and a helper that picks the needed ones."""

from __future__ import annotations

import re

from checks import views as v
from quillwatch.operators.detection import ACTIONS, DEFAULT_RULES

TIE = "CAST(x * 1152921504606846976e0 AS HUGEINT) * 20000 + 1152921504606846976"
# half-even: an exact tie above an even step was rounded up and goes back
ROUND4 = (
    f"CAST(({TIE}) // 2305843009213693952 - CASE WHEN ({TIE}) % 2305843009213693952 = 0 AND "
    f"(({TIE}) // 2305843009213693952) % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) / 10000e0"
)

# RE2 has no backreferences; the eighth rule compares two extracted words instead.
_OR_WORDS = r"""(?i)\bOR\s+[''"]?(\w+)[''"]?\s*=\s*[''"]?(\w+)"""
_RULE_SQL = [
    r"regexp_matches(query, '(?i)\bDROP\s+DATABASE\b')",
    r"regexp_matches(query, '(?i)\bDROP\s+TABLE\b')",
    r"regexp_matches(query, '(?i)\bTRUNCATE\s+(?:TABLE\s+)?')",
    r"""regexp_matches(query, '(?i)^\s*DELETE\s+FROM\s+[\w."`\[\]]+\s*;?\s*$')""",
    r"regexp_matches(query, '(?is)\bGRANT\s+.+\s+TO\b')",
    r"regexp_matches(query, '(?is)\bREVOKE\s+.+\s+FROM\b')",
    r"regexp_matches(query, '(?i)\bUNION\s+(?:ALL\s+)?SELECT\b')",
    f"(regexp_extract(query, '{_OR_WORDS}', 1) <> '' AND "
    f"starts_with(regexp_extract(query, '{_OR_WORDS}', 2), "
    f"regexp_extract(query, '{_OR_WORDS}', 1)))",
    "(contains(query, '--') OR contains(query, '/*'))",
    r"regexp_matches(query, '(?i)\bxp_cmdshell\b')",
    r"regexp_matches(query, '(?i)\bLOAD_FILE\s*\(')",
    r"regexp_matches(query, '(?i)\b(?:SLEEP|PG_SLEEP|WAITFOR)\b')",
]


def iso(ts: str) -> str:
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({ts}, '%f') = '000000' "
        f"THEN '' ELSE '.' || strftime({ts}, '%f') END || '+00:00')"
    )


def rank(c: str) -> str:
    return (
        f"(CASE {c} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 "
        "WHEN 'critical' THEN 4 ELSE 0 END)"
    )


def _product() -> str:
    terms = " * ".join(
        f"(CASE WHEN r{i} THEN {1.0 - r.weight!r}e0 ELSE 1e0 END)"
        for i, r in enumerate(DEFAULT_RULES, start=1)
    )
    return f"1e0 - (1e0 * {terms})"


def _indicators() -> str:
    items = ", ".join(
        f"CASE WHEN r{i} THEN '{r.description}' END" for i, r in enumerate(DEFAULT_RULES, start=1)
    )
    return f"list_filter([{items}], lambda z: z IS NOT NULL)"


def action_case() -> str:
    return "CASE severity " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in ACTIONS.items()) + " END"


GENERATED = "TIMESTAMP '2024-02-01 00:00:00'"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "audit": ((), v.AUDIT_SQL.format(events="events")),
    "bad": (("audit",), v.BAD_SQL.format(audit="audit")),
    "ev": (
        ("audit",),
        "SELECT event_id, trim(query_text) AS query, username, database_name AS database, "
        "'postgresql' AS source_system, client_ip, duration_ms, rows_affected, event_time AS ts "
        "FROM audit",
    ),
    "hits": (
        ("ev",),
        "SELECT *, " + ", ".join(f"{s} AS r{i}" for i, s in enumerate(_RULE_SQL, start=1))
        + " FROM ev",
    ),
    "raw": (("hits",), f"SELECT *, {_product()} AS x, {_indicators()} AS indicators FROM hits"),
    "rated": (("raw",), f"SELECT *, {ROUND4} AS risk_score FROM raw"),
    "scored": (
        ("rated",),
        "SELECT *, CASE WHEN risk_score >= 0.9e0 THEN 'critical' WHEN risk_score >= 0.75e0 THEN "
        "'high' WHEN risk_score >= 0.5e0 THEN 'medium' WHEN risk_score > 0 THEN 'low' ELSE 'info' "
        "END AS severity, CASE WHEN len(indicators) > 0 THEN 'suspicious_sql_activity' ELSE "
        "'normal_sql_activity' END AS classification FROM rated",
    ),
    "occ": (
        ("scored",),
        """SELECT *, 'alrt_' || substr(fingerprint, 1, 24) AS alert_id FROM (
        SELECT *, sha256('{"classification":"' || classification || '","client_ip":"' ||
          coalesce(client_ip, '') || '","database":"' || lower(database) || '","query":"' ||
          lower(regexp_replace(query, '\\s+', ' ', 'g')) || '","source_system":"' || source_system
          || '","username":"' || lower(username) || '"}') AS fingerprint
        FROM scored WHERE risk_score >= 0.5e0)""",
    ),
    "al": (
        ("occ",),
        """SELECT s.alert_id, s.fingerprint, s.occurrence_count, s.first_seen, s.last_seen,
          p.severity, p.risk_score, p.database, p.username, p.client_ip, p.classification,
          p.source_system, p.query
        FROM (SELECT alert_id, min(fingerprint) AS fingerprint, count(*) AS occurrence_count,
                min(ts) AS first_seen, max(ts) AS last_seen FROM occ GROUP BY alert_id) s
        JOIN (SELECT * FROM occ QUALIFY row_number() OVER (
                PARTITION BY alert_id ORDER BY ts DESC, event_id DESC) = 1) p USING (alert_id)""",
    ),
    "digits": (
        ("al",),
        "SELECT *, strpos('0123456789abcdef', substr(alert_id, 6, 1)) - 1 AS d FROM al",
    ),
    "act": (
        ("digits",),
        """SELECT alert_id, alert_id || '/' || action || '/' || hours AS action_key, action,
          first_seen + hours * INTERVAL '1' HOUR AS moment, 'analyst_' || substr(alert_id, 6, 1) AS
          actor, CASE WHEN hours = 2 THEN 'handled' END AS note FROM (
          SELECT alert_id, first_seen, 'acknowledged' AS action, 1 AS hours FROM digits WHERE d <= 5
          UNION ALL SELECT alert_id, first_seen, 'resolved', 2 FROM digits WHERE d BETWEEN 4 AND 9
          UNION ALL SELECT alert_id, first_seen, 'acknowledged', 3 FROM digits
            WHERE d BETWEEN 4 AND 5)""",
    ),
    "steps": (
        ("occ", "act"),
        """SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY moment, side, step_key) AS n
        FROM (SELECT alert_id, event_id AS step_key, ts AS moment, 0 AS side, 'occurrence' AS kind,
                CAST(NULL AS VARCHAR) AS actor, CAST(NULL AS VARCHAR) AS note FROM occ
              UNION ALL SELECT alert_id, action_key, moment, 1, action, actor, note FROM act)""",
    ),
    # the state machine itself, one step of every alert per round
    "fsm": (
        ("steps",),
        """SELECT alert_id, n, step_key, moment, kind, actor, note,
          CASE WHEN kind = 'occurrence' THEN 'created' ELSE 'rejected' END AS effect,
          CASE WHEN kind = 'occurrence' THEN 'new' ELSE 'absent' END AS status
        FROM steps WHERE n = 1
        UNION ALL
        SELECT s.alert_id, s.n, s.step_key, s.moment, s.kind, s.actor, s.note,
          CASE WHEN s.kind = 'occurrence' THEN
                 CASE f.status WHEN 'absent' THEN 'created' WHEN 'resolved' THEN 'reopened'
                      ELSE 'occurrence' END
               WHEN s.kind = 'acknowledged' AND f.status = 'new' THEN 'acknowledged'
               WHEN s.kind = 'resolved' AND f.status IN ('new', 'acknowledged') THEN 'resolved'
               ELSE 'rejected' END,
          CASE WHEN s.kind = 'occurrence' THEN
                 CASE WHEN f.status IN ('absent', 'resolved') THEN 'new' ELSE f.status END
               WHEN s.kind = 'acknowledged' AND f.status = 'new' THEN 'acknowledged'
               WHEN s.kind = 'resolved' AND f.status IN ('new', 'acknowledged') THEN 'resolved'
               ELSE f.status END
        FROM fsm f JOIN steps s ON s.alert_id = f.alert_id AND s.n = f.n + 1""",
    ),
    "changes": (
        ("fsm",),
        """SELECT alert_id, effect, moment,
          CASE WHEN effect = 'reopened' THEN 'system' ELSE actor END AS updated_by,
          CASE WHEN effect = 'reopened' THEN
            'A new matching database event reopened the resolved alert.' ELSE note END AS status_note
        FROM fsm WHERE effect IN ('reopened', 'acknowledged', 'resolved')
        QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY n DESC) = 1""",
    ),
    "states": (
        ("al", "changes"),
        """SELECT al.*, CASE WHEN c.effect IS NULL OR c.effect = 'reopened' THEN 'new'
          ELSE c.effect END AS status, c.updated_by, c.status_note, c.moment AS status_updated_at,
          c.effect AS last_action FROM al LEFT JOIN changes c USING (alert_id)""",
    ),
    "iv": ((), v.INTERVALS_SQL.format(orders="orders")),
    "access": ((), v.ACCESS_SQL.format(events="events")),
    "metric": ((), v.METRIC_SQL.format(events="events")),
    "errors": (
        ("metric",),
        """SELECT 'job=quillwatch,status=' || status AS series, epoch_us(ts) AS t, value,
          CASE WHEN value < before THEN value ELSE coalesce(value - before, 0) END AS step
        FROM (SELECT *, lag(value) OVER (PARTITION BY status ORDER BY ts) AS before FROM metric
              WHERE kind = 7 AND status LIKE '5__')""",
    ),
    # growth within the last 300 seconds of every time that has a sample, carried to the borders
    "growth": (
        ("errors",),
        """SELECT series, t, CASE WHEN n > 1 THEN grown * ((covered + least(
            CASE WHEN lead < mean * 1.1e0 THEN lead ELSE mean / 2 END,
            CASE WHEN grown > 0 THEN covered * first_value / grown ELSE 1e18 END)
          + CASE WHEN trail < mean * 1.1e0 THEN trail ELSE mean / 2 END) / covered) END AS increase
        FROM (SELECT *, covered / (n - 1) AS mean FROM (
          SELECT series, t, count(*) AS n, sum(step) - arg_min(step, s) AS grown,
            arg_min(value, s) AS first_value, CAST(max(s) - min(s) AS DOUBLE) AS covered,
            CAST(min(s) - (t - 300000000) AS DOUBLE) AS lead, CAST(t - max(s) AS DOUBLE) AS trail
          FROM (SELECT DISTINCT t FROM errors) a JOIN (SELECT series, t AS s, value, step
            FROM errors) b ON s > t - 300000000 AND s <= t GROUP BY series, t))""",
    ),
    "rule_values": (
        ("metric", "growth"),
        """SELECT 'ServiceDown' AS rule, 120 AS hold, 'instance=' || instance || ',job=quillwatch' AS
            series, ts, value = 0 AS holds FROM metric WHERE kind = 0
        UNION ALL SELECT 'AlertStoreUnavailable', 60, 'job=quillwatch', ts, value = 0 FROM metric
          WHERE kind = 1
        UNION ALL SELECT 'CriticalAlertsPresent', 60, 'job=quillwatch,severity=critical', ts,
          value > 0 FROM metric WHERE kind = 2 AND severity = 'critical'
        UNION ALL SELECT 'CriticalIncidentOpen', 60, '', ts, sum(value) > 0 FROM metric
          WHERE kind = 3 AND severity = 'critical' AND status <> 'resolved' GROUP BY ts
        UNION ALL SELECT 'RecurringIncidentActivity', 120, 'job=quillwatch', ts, value >= 3
          FROM metric WHERE kind = 4
        UNION ALL SELECT 'RequiredComponentDown', 120, 'component=' || component, ts,
          max(CASE WHEN kind = 5 THEN value END) = 0 AND max(CASE WHEN kind = 6 THEN value END) = 1
          FROM metric WHERE kind IN (5, 6) GROUP BY component, ts
        UNION ALL SELECT 'ServerErrors', 60, '', make_timestamp(t), sum(increase) > 0 FROM growth
          WHERE increase IS NOT NULL GROUP BY t""",
    ),
    "rule_spells": (
        ("rule_values",),
        """SELECT rule, series, min(ts) AS started, max(ts) AS ended, count(*) AS samples,
          bool_or(due) AS fires, min(ts) FILTER (due) AS fires_at
        FROM (SELECT *, ts >= min(ts) OVER (PARTITION BY rule, series, g) + hold *
                INTERVAL '1' SECOND AS due
              FROM (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY rule, series
                      ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM rule_values) WHERE holds)
        GROUP BY rule, series, g""",
    ),
    "probes": ((), v.PROBES_SQL.format(nation="nation")),
}


def _incident_ctes(prefix: str, source: str, minutes: int) -> None:
    window = f"INTERVAL '{minutes}' MINUTE"
    CTES[f"{prefix}_k"] = (
        (source,),
        f"""SELECT *, lower(trim(source_system)) AS k_source, lower(trim(database)) AS k_db,
          coalesce(nullif(lower(trim(client_ip)), ''), lower(trim(username))) AS k_actor
        FROM {source}""",
    )
    CTES[f"{prefix}_r"] = (
        (f"{prefix}_k",),
        f"""SELECT *, max(last_seen) OVER (PARTITION BY k_source, k_db, k_actor
          ORDER BY first_seen, last_seen DESC, alert_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {prefix}_k""",
    )
    CTES[f"{prefix}_c"] = (
        (f"{prefix}_r",),
        f"""SELECT *, sum(CASE WHEN reach IS NULL OR first_seen > reach + {window} THEN 1 ELSE 0
          END) OVER (PARTITION BY k_source, k_db, k_actor ORDER BY first_seen, last_seen DESC,
          alert_id ROWS UNBOUNDED PRECEDING) AS cluster FROM {prefix}_r""",
    )
    CTES[f"{prefix}_g"] = (
        (f"{prefix}_c",),
        f"""SELECT k_source AS source_system, k_db AS database, k_actor AS actor, cluster,
          min(first_seen) AS first_seen, max(last_seen) AS last_seen, max({rank('severity')}) AS sr,
          max(risk_score) AS risk_score, count(*) AS alert_count,
          CAST(sum(CASE WHEN occurrence_count > 0 THEN occurrence_count ELSE 1 END) AS BIGINT)
            AS occurrence_count,
          CASE WHEN bool_or(status = 'new') THEN 'open' WHEN bool_or(status = 'acknowledged') THEN
            'investigating' ELSE 'resolved' END AS status,
          coalesce(list_sort(list(DISTINCT username)), []) AS usernames,
          coalesce(list_sort(list(DISTINCT client_ip) FILTER (client_ip IS NOT NULL)), [])
            AS client_ips,
          list_sort(list(DISTINCT CASE WHEN trim(classification) = '' THEN 'unclassified' ELSE
            trim(classification) END)) AS classifications
        FROM {prefix}_c GROUP BY k_source, k_db, k_actor, cluster""",
    )
    CTES[f"{prefix}_inc"] = (
        (f"{prefix}_g",),
        f"""SELECT 'inc_' || substr(sha256('{{"actor":"' || actor || '","cluster_start":"' ||
          {iso('first_seen')} || '","database":"' || database || '","source_system":"' ||
          source_system || '"}}'), 1, 24) AS incident_id, *,
          ['info', 'low', 'medium', 'high', 'critical'][sr + 1] AS severity,
          upper(['i', 'l', 'm', 'h', 'c'][sr + 1]) || ['nfo', 'ow', 'edium', 'igh', 'ritical'][sr + 1]
            || ' database-security activity on ' || database AS title,
          CASE WHEN sr = 4 THEN
            'Preserve evidence and initiate the human-controlled incident-response procedure.'
          WHEN sr = 3 THEN
            'Escalate for immediate analyst review and validate containment options.'
          WHEN occurrence_count >= 3 THEN
            'Review recurrence, tune controls and maintain enhanced monitoring.'
          ELSE 'Continue analyst review and monitor for correlated activity.' END
            AS recommended_action
        FROM {prefix}_g""",
    )


_incident_ctes("e", "states", 30)
_incident_ctes("o", "iv", 4320)

CTES["ass_raw"] = (
    ("o_inc",),
    """SELECT *, least(1e0, 0.45e0 * risk_score + 0.3e0 * (CASE severity WHEN 'low' THEN 0.15e0
      WHEN 'medium' THEN 0.35e0 WHEN 'high' THEN 0.65e0 WHEN 'critical' THEN 0.9e0 ELSE 0.05e0 END)
      + 0.15e0 * least(1e0, occurrence_count / 10e0) + 0.1e0 * least(1e0, len(classifications) / 4e0))
      AS x,
      CASE WHEN severity = 'critical' OR occurrence_count >= 5 THEN 'policy_and_control_review'
        WHEN severity = 'high' OR occurrence_count >= 3 THEN 'control_effectiveness_review'
        ELSE 'retain_current_policy' END AS governance_action FROM o_inc""",
)
CTES["ass"] = (("ass_raw",), f"SELECT *, {ROUND4} AS learning_score FROM ass_raw")
CTES["recs"] = (
    ("ass",),
    f"""SELECT 'prec_' || substr(sha256('{{"incident_id":"' || incident_id ||
      '","learning_score":' || CAST(learning_score AS VARCHAR) ||
      ',"previous_recommendation_id":null,"proposed_action":"' || governance_action || '"}}'),
      1, 24) AS recommendation_id, incident_id, governance_action AS proposed_action,
      'Review ' || governance_action || ' for ' || severity || ' incident ' || incident_id ||
      '; observed occurrences=' || occurrence_count || ', learning score=' ||
      format('{{:.4f}}', learning_score) || '.' AS rationale, learning_score,
      'proposed' AS status, TRUE AS requires_human_approval, FALSE AS auto_apply,
      {GENERATED} AS created_at, CAST(NULL AS VARCHAR) AS previous_recommendation_id FROM ass""",
)
CTES["entries"] = (
    ("recs",),
    f"""SELECT CASE WHEN c_custkey % 13 = 0 THEN 'prec_missing' ELSE recommendation_id END AS
      recommendation_id, CASE WHEN c_custkey % 17 = 0 THEN 'inc_other' ELSE incident_id END AS
      incident_id, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_name END AS analyst,
      ['accept', 'reject', 'revision_required'][CAST(c_custkey % 3 AS INT) + 1] AS decision,
      CASE WHEN c_custkey % 7 = 0 THEN 'short' ELSE 'Reviewed for ' || c_mktsegment END AS
      rationale, {GENERATED} + c_custkey * INTERVAL '1' SECOND AS created_at
    FROM (SELECT *, unnest([0, 4096, 8192]) AS turn FROM recs) JOIN customer ON c_custkey =
      ((strpos('0123456789abcdef', substr(incident_id, 5, 1)) - 1) * 256 +
      (strpos('0123456789abcdef', substr(incident_id, 6, 1)) - 1) * 16 +
      (strpos('0123456789abcdef', substr(incident_id, 7, 1)) - 1) + turn)
      % (SELECT count(*) FROM customer) + 1""",
)
CTES["fb_all"] = (
    ("entries",),
    f"""SELECT *, CASE WHEN analyst = '' THEN 'analyst cannot be empty' WHEN length(rationale) < 8
      THEN 'rationale must contain at least 8 characters' END AS problem,
      'fdbk_' || substr(sha256('{{"analyst":"' || analyst || '","created_at":"' ||
        {iso('created_at')} || '","decision":"' || decision || '","rationale":"' || rationale ||
        '","recommendation_id":"' || recommendation_id || '"}}'), 1, 24) AS fid FROM entries""",
)
CTES["fb"] = (
    ("fb_all",),
    "SELECT DISTINCT fid AS feedback_id, recommendation_id, incident_id, analyst, decision, "
    "rationale, created_at FROM fb_all WHERE problem IS NULL",
)
CTES["judged"] = (
    ("fb", "recs"),
    """SELECT f.*, CASE WHEN c.feedback_id IS NOT NULL THEN 'conflicting identifier'
      WHEN r.recommendation_id IS NULL THEN 'recommendation not found'
      WHEN f.incident_id <> r.incident_id THEN 'incident does not match'
      WHEN row_number() OVER (PARTITION BY f.recommendation_id,
        c.feedback_id IS NULL AND r.incident_id IS NOT DISTINCT FROM f.incident_id
        ORDER BY f.created_at, f.feedback_id) = 1 THEN 'accepted'
      ELSE 'already decided' END AS verdict
    FROM fb f LEFT JOIN recs r USING (recommendation_id)
      LEFT JOIN (SELECT feedback_id FROM fb GROUP BY 1 HAVING count(*) > 1) c USING (feedback_id)""",
)
CTES["routed"] = (
    ("access",),
    r"""SELECT *, CASE WHEN trim(upper(method)) = '' THEN 'UNKNOWN' ELSE trim(upper(method)) END AS m,
      regexp_replace(regexp_replace(path, '^/api/v1/alerts/[^/]+(/ack|/resolve)?$',
        '/api/v1/alerts/{alert_id}\1'), '^/api/v1/incidents/[^/]+(/assessment)?$',
        '/api/v1/incidents/{incident_id}\1') AS route,
      CAST(greatest(duration_seconds, 0) AS DECIMAL(28, 12)) AS secs FROM access""",
)

_RECURSIVE = {"fsm", "walk"}


def sql(final: str, *needs: str) -> str:
    """``final`` behind the expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dependency in CTES[name][0]:
            visit(dependency)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return final
    head = "WITH RECURSIVE " if _RECURSIVE & set(order) else "WITH "
    body = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    return re.sub(r"[ \t]+\n", "\n", f"{head}{body}\n{final}")
