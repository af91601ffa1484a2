"""Telemetry of a fleet derived from the ``events`` table: a user is a log, its events are records.

One unit of log time is 10,000 seconds of event time, so that a user's month becomes a flight
log of a few minutes. ``EV`` states the same derivation for SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.operators.setops import union_all
from aerolake.session import cut
from suite.registry import table

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"

EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS log_id, event_id AS seq,
         (epoch_us(ts) - 1704067200000000) / 1e10 AS t, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, user_id
  FROM events)"""

PARAMETER_NAMES = ("RCMAP_ROLL", "RC1_MIN", "RC1_MAX", "RC1_TRIM", "RC1_DZ", "MOT_PWM_MIN", "RC1_REVERSED", "MOT_PWM_MAX")
PARAMETERS = ("1 + k % 4", "1000 + k", "1900 + k", "1450 + k", "k % 30", "1000 + k", "k % 2", "1900 + k")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table with the names the operators use."""
    return named(table(spark, folder, "events"))


def named(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("user_id").cast("string").alias("log_id"), F.col("event_id").alias("seq"),
        (F.expr(MICROS) / F.lit(1e10)).alias("t"), "event_type", "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"), "user_id")


def of_type(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("event_type").isin(*kinds))


# message -> (event types, instance, integer fields, real fields, text fields) as SQL expressions.
MESSAGES = (
    ("ARM", "event_type IN ('signup', 'purchase') AND user_id % 7 <> 0", None,
     {"ArmState": "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END", "Method": "k % 3"}, {}, {}),
    ("PARM", "event_type = 'signup'", None, {},
     {"Value": "CASE k % 8 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PARAMETERS)) + " END"},
     {"Name": "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PARAMETER_NAMES)) + " END"}),
    ("ATT", "event_type = 'view'", None, {},
     {"DesRoll": "0.6D * k - 30D", "Roll": "0.6D * k - 30D + value % 16D - 8D",
      "DesPitch": "10D - 0.2D * k", "Pitch": "10D - 0.2D * k + value % 10D - 5D",
      "DesYaw": "3.6D * k", "Yaw": "3.6D * k + value % 24D - 12D"}, {}),
    ("MODE", "event_type = 'view'", None, {"Mode": "k % 22"}, {}, {}),
    ("CTUN", "event_type = 'view'", None, {}, {"ThO": "k / 100D"}, {}),
    ("RCIN", "event_type = 'click'", None,
     {"C1": "1000 + 10 * k", "C2": "1000 + 10 * ((k * 7) % 100)", "C3": "1000 + 10 * ((k * 13) % 100)",
      "C4": "1000 + 10 * ((k * 29) % 100)"}, {}, {}),
    ("RCOU", "event_type = 'click'", None,
     {"C1": "1000 + 10 * ((k * 3) % 100)", "C2": "1000 + 10 * ((k * 11) % 100)",
      "C3": "1000 + 10 * ((k * 17) % 100)", "C4": "1000 + 10 * ((k * 23) % 100)"}, {}, {}),
    ("POS", "event_type = 'click'", None, {},
     {"Lat": "-35D + k * 0.0001D", "Lng": "149D + (value % 10D) * 0.0001D", "RelHomeAlt": "value % 30D",
      "Alt": "500D + value % 30D"}, {}),
    ("GPS", "event_type = 'click'", 0, {"Status": "k % 7", "NSats": "k % 20"},
     {"HDop": "value % 4D", "Spd": "value % 15D", "Lat": "-35D + k * 0.0001D",
      "Lng": "149D + (value % 10D) * 0.0001D", "Alt": "600D + value % 30D"}, {}),
    ("BARO", "event_type = 'click'", 0, {}, {"Alt": "value % 30D", "CRt": "value % 6D - 3D"}, {}),
    ("ERR", "event_type = 'error'", None, {"Subsys": "k % 20", "ECode": "k % 4"}, {}, {}),
    ("EV", "event_type = 'error'", None, {"Id": "k % 30"}, {}, {}),
    ("XKF4", "event_type = 'error'", 0, {"FS": "CASE WHEN k % 4 = 0 THEN k % 3 ELSE 0 END"},
     {"SV": "value % 1.5D", "SP": "k / 80D", "SH": "0.3D", "SM": "value % 0.9D"}, {}),
    ("XKF3", "event_type = 'error'", 0, {}, {"IPN": "value % 3D - 1.5D", "IPE": "k / 50D - 1D", "IPD": "0.1D"}, {}),
    ("VIBE", "event_type = 'error'", None, {}, {"VibeX": "value % 45D", "VibeY": "k / 2.5D", "VibeZ": "value % 20D"}, {}),
    ("BAT", "event_type = 'error'", None, {}, {"Volt": "10D + k / 30D", "Curr": "value % 40D"}, {}),
    ("RATE", "event_type = 'error'", None, {}, {"ROut": "k / 100D", "POut": "value % 1D", "YOut": "0D - k / 100D"}, {}),
    ("MSG", "event_type = 'error'", None, {}, {},
     {"Message": "CASE k % 5 WHEN 0 THEN 'PreArm: GPS fail' "
                 "WHEN 1 THEN concat('ArduCopter V4.5.', CAST(k % 7 AS STRING), ' (abc', CAST(k AS STRING), ')') "
                 "WHEN 2 THEN 'Frame: QUAD/X' WHEN 3 THEN 'Crash: Disarming' ELSE 'EKF3 IMU0 is using GPS' END"}),
)


#: So many branches read the events as fast as these are written by type.
FEW_BRANCHES = 4


def _map(fields: dict, kind: str) -> str:
    if not fields:
        return f"CAST(map() AS map<string,{kind}>)"
    return "map(" + ", ".join(f"'{n}', CAST({e} AS {kind})" for n, e in fields.items()) + ")"


def telemetry(spark: SparkSession, folder: str, *only: str) -> DataFrame:
    """Telemetry rows, one branch per message.

    The message name is a constant of its branch, so a filter on ``msg`` removes all other
    branches and the branch's own condition reaches the scan, as on a table partitioned by
    ``msg``. ``only`` names the messages wanted.
    """
    return records_of(events(spark, folder), *only)


def records_of(rows: DataFrame, *only: str) -> DataFrame:
    """The same of any rows with the columns of ``events()``, streamed ones too."""
    branches = []
    for msg, condition, instance, ints, reals, texts in MESSAGES:
        if only and msg not in only:
            continue
        inst = "CAST(NULL AS INT)" if instance is None else f"CAST({instance} AS INT)"
        branches.append(rows.where(condition).selectExpr(
            "log_id", f"'{msg}' AS msg", f"{inst} AS instance", "seq", "t",
            f"{_map(ints, 'bigint')} AS ints", f"{_map(reals, 'double')} AS reals", f"{_map(texts, 'string')} AS texts"))
    return union_all(*branches)


def span(spark: SparkSession, folder: str) -> DataFrame:
    """First and last record time per log; purchases of unarmed logs leave no record."""
    rows = events(spark, folder).where("NOT (event_type = 'purchase' AND user_id % 7 = 0)")
    return rows.groupBy("log_id").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))


SPAN = """span AS (SELECT log_id, min(t) AS t_first, max(t) AS t_last FROM ev
  WHERE NOT (event_type = 'purchase' AND user_id % 7 = 0) GROUP BY log_id)"""


def regions_sql(name: str, source: str, on: str, order: str) -> str:
    """SQL of state regions over a CTE ``source`` with boolean expression ``on``."""
    return f"""{name}_a AS (SELECT log_id, seq, t, ({on}) AS is_on FROM {source}),
{name}_b AS (SELECT *, lag(is_on) OVER (PARTITION BY log_id ORDER BY {order}) AS was FROM {name}_a),
{name}_c AS (SELECT *, lead(t) OVER (PARTITION BY log_id ORDER BY {order}) AS nt
  FROM {name}_b WHERE is_on <> coalesce(was, FALSE)),
{name} AS (SELECT c.log_id, row_number() OVER (PARTITION BY c.log_id ORDER BY {order.replace('seq', 'c.seq').replace('t,', 'c.t,')}) - 1 AS idx,
  c.t AS t_start, coalesce(c.nt, s.t_last) AS t_end FROM {name}_c c JOIN span s ON s.log_id = c.log_id WHERE c.is_on)"""


# Armed regions of the derived fleet: ARM records, else arming events.
REGIONS = f"""{EV},
{SPAN},
armrows AS (SELECT * FROM ev WHERE event_type IN ('signup', 'purchase') AND user_id % 7 <> 0),
{regions_sql('r_arm', 'armrows', "event_type = 'signup'", 'seq')},
evrows AS (SELECT * FROM ev WHERE event_type = 'error' AND k % 30 IN (10, 15, 11)),
{regions_sql('r_ev', 'evrows', 'k % 30 IN (10, 15)', 't, seq')},
regions AS (SELECT *, 'ARM' AS source FROM r_arm UNION ALL
  SELECT *, 'EV' AS source FROM r_ev WHERE log_id NOT IN (SELECT log_id FROM r_arm))"""

# Flight mode segments.
MODE_CASE = ("CASE m WHEN 0 THEN 'STABILIZE' WHEN 1 THEN 'ACRO' WHEN 2 THEN 'ALT_HOLD' WHEN 3 THEN 'AUTO' "
             "WHEN 4 THEN 'GUIDED' WHEN 5 THEN 'LOITER' WHEN 6 THEN 'RTL' WHEN 9 THEN 'LAND' WHEN 16 THEN 'POSHOLD' "
             "WHEN 17 THEN 'BRAKE' WHEN 18 THEN 'THROW' WHEN 19 THEN 'AVOID_ADSB' WHEN 20 THEN 'GUIDED_NOGPS' "
             "WHEN 21 THEN 'SMART_RTL' ELSE 'MODE_' || m END")
MODES = f"""m_a AS (SELECT log_id, seq, t, k % 22 AS m, lag(k % 22) OVER (PARTITION BY log_id ORDER BY t, seq) AS pm
  FROM ev WHERE event_type = 'view'),
m_b AS (SELECT *, lead(t) OVER (PARTITION BY log_id ORDER BY t, seq) AS nt,
  row_number() OVER (PARTITION BY log_id ORDER BY t, seq) - 1 AS idx FROM m_a WHERE pm IS NULL OR pm <> m),
modes AS (SELECT b.log_id, b.idx, b.m AS mode_num, {MODE_CASE.replace('CASE m', 'CASE b.m').replace("|| m", "|| b.m")} AS mode,
  b.t AS t_start, coalesce(b.nt, s.t_last) AS t_end FROM m_b b JOIN span s ON s.log_id = b.log_id)"""

# Unified events.
EVENTS = """events_all AS (
  SELECT log_id, seq, t, CASE WHEN k % 5 IN (0, 3) THEN 'CRITICAL' ELSE 'INFO' END AS severity, 'MSG' AS type,
    CASE k % 5 WHEN 0 THEN 'PreArm: GPS fail' WHEN 1 THEN 'ArduCopter V4.5.' || (k % 7) || ' (abc' || k || ')'
      WHEN 2 THEN 'Frame: QUAD/X' WHEN 3 THEN 'Crash: Disarming' ELSE 'EKF3 IMU0 is using GPS' END AS message, 0 AS source_rank
  FROM ev WHERE event_type = 'error'
  UNION ALL SELECT log_id, seq, t, 'INFO', 'EV', CASE k % 30 WHEN 10 THEN 'Armed' WHEN 11 THEN 'Disarmed' WHEN 15 THEN 'Auto_Armed'
      WHEN 16 THEN 'Land_Complete' WHEN 18 THEN 'Not_Landed' WHEN 25 THEN 'Set_Home' WHEN 26 THEN 'Wrote_EEPROM'
      WHEN 27 THEN 'Load_Default_Params' WHEN 28 THEN 'Pilot_YawSet' ELSE 'EV_' || (k % 30) END, 1 FROM ev WHERE event_type = 'error'
  UNION ALL SELECT log_id, seq, t, 'ERROR', 'ERR', 'ERR: ' || CASE k % 20 WHEN 1 THEN 'Main' WHEN 2 THEN 'Radio' WHEN 3 THEN 'Compass'
      WHEN 5 THEN 'FailSafe_Radio' WHEN 6 THEN 'FailSafe_Batt' WHEN 7 THEN 'FailSafe_GPS' WHEN 10 THEN 'FlightMode' WHEN 11 THEN 'GPS'
      WHEN 16 THEN 'EKF_Check' WHEN 17 THEN 'FailSafe_EKF' WHEN 18 THEN 'Barometer' ELSE 'Subsys_' || (k % 20) END || ' code=' || (k % 4), 2
      FROM ev WHERE event_type = 'error'
  UNION ALL SELECT log_id, seq, t, CASE WHEN event_type = 'signup' THEN 'INFO' ELSE 'WARNING' END, 'ARM',
      CASE WHEN event_type = 'signup' THEN 'Armed' ELSE 'Disarmed (method=' || (k % 3) || ')' END, 3
      FROM ev WHERE event_type IN ('signup', 'purchase') AND user_id % 7 <> 0
  UNION ALL SELECT log_id, seq, t, 'INFO', 'MODE', 'Mode: ' || """ + MODE_CASE.replace("CASE m", "CASE k % 22").replace("|| m", "|| (k % 22)") + """, 4
      FROM ev WHERE event_type = 'view')"""


def lake(spark: SparkSession, folder: str, *messages: str) -> DataFrame:
    """The derived telemetry written once, as a fleet's telemetry is, for plans that read it often.

    Every message is a branch that reads the events. For more than a few, they are read once and written in a folder for each
    type, so that a branch reads its own types only.
    """
    if messages and len(messages) <= FEW_BRANCHES:
        return cut(telemetry(spark, folder, *messages))
    return cut(records_of(cut(events(spark, folder), "event_type"), *messages))
