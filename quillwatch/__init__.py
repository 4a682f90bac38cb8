"""Database-security analytics on Spark: audit events in, alerts, incidents and reports out.

Every operator takes DataFrames and returns DataFrames, builds one lazy plan and
never looks at the data on the driver.
"""

from quillwatch.operators.alerts import collapse_occurrences, enrich_detections
from quillwatch.operators.detection import DEFAULT_RULES, Rule, analyze, detect
from quillwatch.operators.feedback import apply_feedback, recommend
from quillwatch.operators.incidents import correlate, incident_members
from quillwatch.operators.learning import assess
from quillwatch.operators.lifecycle import lifecycle_states
from quillwatch.session import build_session, pin_utc

__version__ = "0.1.0"

__all__ = [
    "DEFAULT_RULES",
    "Rule",
    "analyze",
    "apply_feedback",
    "assess",
    "build_session",
    "collapse_occurrences",
    "correlate",
    "detect",
    "enrich_detections",
    "incident_members",
    "lifecycle_states",
    "pin_utc",
    "recommend",
]
