"""Queries over rules that are rows of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.plans import rules as R
from suite.fleet import EV, span, telemetry
from suite.flights import ANOMALIES
from suite.registry import query


@query("rule_anomalies", f"""WITH {ANOMALIES} SELECT h.log_id, h.t, h.t - s.t_first AS t_rel, h.severity, h.category, h.message FROM hits h JOIN span s ON s.log_id = h.log_id""")
def rule_anomalies(spark, folder):
    """The standard rules, given as rows; texts with rounded readings are compared by their leading words."""
    found = R.rule_hits(telemetry(spark, folder, "XKF4", "GPS", "VIBE", "BAT", "ERR"), R.standard_rules(spark), span(spark, folder))
    short = (F.when(F.col("category") == "VIBE", F.regexp_extract("message", "Vibe[XYZ]", 0))
             .when(F.col("category") == "POWER", F.lit("Low battery")).otherwise(F.col("message")))
    return found.select("log_id", "t", "t_rel", "severity", "category", short.alias("message"))


@query("added_rules", f"""WITH {EV}, cl AS (SELECT * FROM ev WHERE event_type = 'click'), er AS (SELECT * FROM ev WHERE event_type = 'error')
SELECT log_id, min(t) AS t, 'INFO' AS severity, 'GPS' AS category, 'Many GPS sats=' || max(k % 20) || '!' AS message, 10 AS rule, 0::BIGINT AS rule_seq FROM cl WHERE k % 20 >= 18 GROUP BY log_id
UNION ALL SELECT log_id, t, 'INFO', 'ERR', 'Code ' || (k % 4) || ' of ' || (k % 20), 11, seq FROM er WHERE k % 4 >= 3""")
def added_rules(spark, folder):
    """Rules that are no part of the library: two rows more."""
    rows = [(10, 0, "GPS", ["NSats"], "first", "ge", 18.0, False, None, "max", "INFO", "GPS", "Many GPS sats=", None, "!", []),
            (11, 0, "ERR", ["ECode"], "plain", "ge", 3.0, False, None, "every", "INFO", "ERR", "Code ", None, "", [(" of ", ["Subsys"])])]
    found = R.rule_hits(telemetry(spark, folder, "GPS", "ERR"), spark.createDataFrame(rows, R.RULES))
    return found.select("log_id", "t", "severity", "category", "message", "rule", "rule_seq")
