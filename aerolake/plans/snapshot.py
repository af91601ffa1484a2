"""Everything known at a moment: cursor values with provenance, diagnostics, control, context.

A cursor is a row (log_id, cursor, t). The samples of a message share their times, so all signals of
all cursors are resolved by one as-of join keyed by (log_id, message), folded into one map per cursor,
and read from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import columns as C
from aerolake.functions import fixed
from aerolake.functions.rc import default_config, rc_config, stick_position
from aerolake.operators.asof import bracket, clamped_value, nearest_event, sample_struct
from aerolake.operators.intervals import interval_lookup
from aerolake.operators.ordered import needs_split, null_safe_join
from aerolake.plans.events import flight_events, with_event_position
from aerolake.plans.health import parameters
from aerolake.plans.timeline import arm_regions, log_span, mode_segments, phases
from aerolake.plans.trajectory import best_trajectory
from aerolake.session import cut
from aerolake.schema import KEY, has_number, number, records

# (message, instance, columns) read as continuous signals.
CONTINUOUS = (
    ("ATT", None, ("Roll", "Pitch", "Yaw", "DesRoll", "DesPitch", "DesYaw")), ("CTUN", None, ("ThO", "CRt")),
    ("POS", None, ("RelHomeAlt", "Alt", "Lat", "Lng")), ("BARO", 0, ("Alt", "CRt")), ("BARO", None, ("Alt", "CRt")),
    ("GPS", 0, ("Spd", "VZ", "Lat", "Lng")), ("GPS", None, ("Spd", "VZ", "Lat", "Lng")),
    *[(m, i, ("SV", "SP", "SH", "SM", "FS")) for m in ("XKF4", "NKF4") for i in (0, None)],
    *[(m, i, ("IPN", "IPE", "IPD")) for m in ("XKF3", "NKF3") for i in (0, None)],
)
HELD = (("GPS", 0, ("Status", "NSats")), ("GPS", None, ("Status", "NSats")))
STICKS = (("RCIN", "pilot"), ("RCOU", "servo"))
ALTITUDES = (("POS", "RelHomeAlt"), ("BARO[0]", "Alt"), ("BARO", "Alt"), ("POS", "Alt"))
CLIMB_SOURCES = (("BARO[0].CRt", 1.0), ("BARO.CRt", 1.0), ("CTUN.CRt", 1.0), ("GPS[0].VZ", -1.0), ("GPS.VZ", -1.0))
EKF_KEYS = ("XKF4[0]", "XKF4", "NKF4[0]", "NKF4")
INNOVATION_KEYS = ("XKF3[0]", "XKF3", "NKF3[0]", "NKF3")
SLOPE_S = 0.5


def _name(msg: str, instance: int | None) -> str:
    return msg if instance is None else f"{msg}[{instance}]"


def labelled_samples(telemetry: DataFrame, wanted) -> DataFrame:
    """(log_id, signal, seq, t, v): the wanted columns of the telemetry, one row per reading."""
    options = []
    for msg, instance, names in wanted:
        same = F.col("instance").isNull() if instance is None else F.coalesce(F.col("instance") == instance, F.lit(False))
        for name in names:
            hit = (F.col("msg") == msg) & same & has_number(name)
            options.append(F.when(hit, F.struct(F.lit(f"{_name(msg, instance)}.{name}").alias("signal"), number(name).alias("v"))))
    rows = records(telemetry, *{m for m, _, _ in wanted}).where(F.col("t").isNotNull())
    rows = rows.select(*KEY, "seq", "t", F.explode(F.array_compact(F.array(*options))).alias("_s"))
    return rows.select(*KEY, "_s.signal", "seq", "t", "_s.v")


def axis_config(telemetry: DataFrame) -> DataFrame:
    """RC settings of every log and axis, defaults where a log has no parameters."""
    config = rc_config(parameters(telemetry), KEY)
    logs = telemetry.select(*KEY).distinct()
    bare = null_safe_join(logs, config.select(*KEY).distinct(), KEY, "left_anti")
    return config.unionByName(default_config(bare, KEY))


def _cell(present: Column, value: Column) -> Column:
    """A reading that may be missing (NULL cell) or empty (NULL value)."""
    return F.when(present, F.struct(value.cast("double").alias("v")))


def message_samples(telemetry: DataFrame, wanted) -> DataFrame:
    """(log_id, message, seq, t, cells): one row per record, its wanted columns as an array."""
    name, cells = F.lit(None).cast("string"), F.lit(None).cast("array<struct<v:double>>")
    for msg, instance, names in wanted:
        same = F.col("instance").isNull() if instance is None else F.coalesce(F.col("instance") == instance, F.lit(False))
        hit = (F.col("msg") == msg) & same
        name = F.when(hit, F.lit(_name(msg, instance))).otherwise(name)
        cells = F.when(hit, F.array(*[_cell(has_number(n), number(n)) for n in names])).otherwise(cells)
    rows = records(telemetry, *{m for m, _, _ in wanted}).where(F.col("t").isNotNull())
    return rows.select(*KEY, name.alias("message"), "seq", "t", cells.alias("cells")).where(F.col("message").isNotNull())


def stick_messages(telemetry: DataFrame, axes: DataFrame) -> DataFrame:
    """The same of pulse widths, one cell per axis through each log's channel map."""
    rows = records(telemetry, "RCIN", "RCOU").where(F.col("instance").isNull() & F.col("t").isNotNull())
    rows = null_safe_join(rows, axes, KEY, "inner")
    cells = []
    for axis in fixed.RC_AXES:
        name = F.concat(F.lit("C"), F.col("axes")[axis]["channel"].cast("string"))
        present = F.coalesce(F.map_contains_key("ints", name) | F.map_contains_key("reals", name), F.lit(False))
        cells.append(_cell(present, F.coalesce(F.col("reals")[name], F.col("ints")[name].cast("double"))))
    return rows.select(*KEY, F.col("msg").alias("message"), "seq", "t", F.array(*cells).alias("cells"))


def cursor_values(cursors: DataFrame, samples: DataFrame, signals: list[str], held: bool = False,
                  split: bool | None = None) -> DataFrame:
    """Cursors plus ``values``: map signal -> sample struct, for the listed signals."""
    names = F.explode(F.array(*[F.lit(s) for s in signals]))
    marks = cursors.select(*KEY, "cursor", F.col("t").cast("double").alias("t"), names.alias("signal"))
    keys = [*KEY, "signal"]
    if held:
        found = bracket(marks, samples, keys, "t", "seq", ["v"], exact="lower", sides=["lower"], split=split)
        sample = F.struct(
            F.col("lower.v").alias("value"), F.col("t"), F.lit(False).alias("interpolated"),
            F.col("lower.t").alias("sample_t"), F.lit(None).cast("array<double>").alias("bracket"))
    else:
        found = bracket(marks, samples, keys, "t", "seq", ["v"], split=split)
        sample = sample_struct(F.col("t"), F.col("lower"), F.col("upper"))
    packed = found.groupBy(*KEY, "cursor").agg(
        F.map_from_entries(F.collect_list(F.struct("signal", sample.alias("sample")))).alias("values"))
    return null_safe_join(cursors, packed, [*KEY, "cursor"], "left")


def _all_labels(wanted) -> list[str]:
    return [f"{_name(m, i)}.{c}" for m, i, names in wanted for c in names]


def present_messages(telemetry: DataFrame) -> DataFrame:
    """(log_id, present): the message keys of a log, at most a few hundred by the format."""
    keys = telemetry.select(*KEY, C.signal_key(F.col("msg"), F.col("instance")).alias("key")).distinct()
    return keys.groupBy(*KEY).agg(F.collect_set("key").alias("present"))


def value_of(label) -> Column:
    return F.col("values")[label if isinstance(label, Column) else F.lit(label)]["value"]


def first_present(keys) -> Column:
    result = None
    for key in keys:
        hit = F.array_contains("present", key)
        result = F.when(hit, F.lit(key)) if result is None else result.when(hit, F.lit(key))
    return result


def climb_rate() -> Column:
    """Struct (value, source) from the first source with a value, else the height's slope."""
    options = [F.when(value_of(label).isNotNull(), F.struct(
        (value_of(label) * sign).alias("value"), F.lit(label).alias("source"))) for label, sign in CLIMB_SOURCES]
    early, late = F.col("slope_values")[0], F.col("slope_values")[1]
    slope = F.when(early.isNotNull() & late.isNotNull(), F.struct(
        ((late - early) / (2 * SLOPE_S)).alias("value"), F.lit("POS.RelHomeAlt d/dt").alias("source")))
    none = F.struct(F.lit(None).cast("double").alias("value"), F.lit("none").alias("source"))
    return F.coalesce(*options, slope, none)


def estimator_status() -> Column:
    key = first_present(EKF_KEYS)
    ratios = F.array_compact(F.array(*[
        F.when(value_of(F.concat(key, F.lit(f".{c}"))).isNotNull(), F.struct(
            value_of(F.concat(key, F.lit(f".{c}"))).alias("ratio"), F.lit(-i).alias("_first"), F.lit(c).alias("worst")))
        for i, c in enumerate(("SV", "SP", "SH", "SM"))]))
    worst = F.array_max(ratios)
    faults = value_of(F.concat(key, F.lit(".FS"))).cast("bigint")
    ratio = worst["ratio"]
    state = F.when(ratio.isNotNull() & (faults != 0), F.lit("CRITICAL")).otherwise(C.threshold_state(ratio, *fixed.EKF_LIMITS))
    return F.struct(ratio.alias("ratio"), worst["worst"].alias("worst"), faults.alias("faults"), state.alias("state"),
                    F.coalesce(key, F.lit("none")).alias("source"))


def position_divergence() -> Column:
    key = first_present(INNOVATION_KEYS)
    north, east, down = (value_of(F.concat(key, F.lit(f".{c}"))) for c in ("IPN", "IPE", "IPD"))
    size = F.hypot(north, east)
    return F.struct(size.alias("value"), down.alias("vertical"), C.threshold_state(size, *fixed.POSITION_LIMITS).alias("state"),
                    F.coalesce(key, F.lit("none")).alias("source"))


def stick_state(side: str) -> Column:
    """Struct of the four normalised axes, from ``axes`` (map axis -> settings) and the values."""
    fields = []
    for axis in fixed.RC_AXES:
        c = F.col("axes")[axis]
        pwm = value_of(f"{side}_{axis}")
        fields.append(stick_position(F.lit(axis), pwm, c["pmin"], c["pmax"], c["ptrim"], c["dz"], c["reversed"]).alias(axis))
    return F.struct(*fields)


def packed_config(config: DataFrame) -> DataFrame:
    entry = F.struct("axis", F.struct("channel", "pmin", "pmax", "ptrim", "dz", "reversed").alias("c"))
    return config.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(entry)).alias("axes"))


def instrument_panel(telemetry: DataFrame, cursors: DataFrame, split: bool | None = None) -> DataFrame:
    """Cursors plus their value map, RC settings, present messages and the height's slope readings."""
    split = needs_split(telemetry, ["log_id", "msg"]) if split is None else split
    config = cut(axis_config(telemetry))
    axes = cut(packed_config(config))
    samples = message_samples(telemetry, CONTINUOUS).unionByName(stick_messages(telemetry, axes))
    labels = {**{_name(m, i): [f"{_name(m, i)}.{c}" for c in names] for m, i, names in CONTINUOUS},
              **{m: [f"{side}_{axis}" for axis in fixed.RC_AXES] for m, side in STICKS}}
    # A cursor asks every message once; the two slope readings are further cursors of the height's
    # message, half a second to each side.
    asked = [(m, 0) for m in labels] + [("POS", -1), ("POS", 1)]
    spread = F.explode(F.array(*[F.struct(F.lit(m).alias("message"), F.lit(k).alias("shift")) for m, k in asked])).alias("_a")
    marks = cursors.select(*KEY, F.col("cursor").alias("_id"), "t", spread)
    keyed = marks.select(*KEY, F.struct("_id", F.col("_a.shift").alias("shift")).alias("cursor"), (F.col("t") + F.col("_a.shift") * SLOPE_S).alias("t"), "_a.message")
    found = bracket(keyed, samples, [*KEY, "message"], "t", "seq", ["cells"], split=split)
    names = C.pick(F.col("message"), {m: i for i, m in enumerate(labels)})
    listed = F.get(F.array(*[F.array(*[F.lit(x) for x in group]) for group in labels.values()]), names)

    def reading(side: str, i: Column) -> Column:
        cell = F.get(F.col(side)["cells"], i)
        return F.when(cell.isNotNull(), F.struct(F.col(side)["t"].alias("t"), F.col(side)["seq"].alias("seq"), cell["v"].alias("v")))

    entries = F.transform(listed, lambda label, i: F.struct(label.alias("signal"), sample_struct(F.col("t"), reading("lower", i), reading("upper", i)).alias("s")))
    height = labels["POS"].index("POS.RelHomeAlt")
    slope = sample_struct(F.col("t"), reading("lower", F.lit(height)), reading("upper", F.lit(height)))["value"]
    shift = F.col("cursor.shift")
    packed = found.groupBy(*KEY, F.col("cursor._id").alias("cursor")).agg(
        F.map_from_entries(F.flatten(F.collect_list(F.when(shift == 0, entries)))).alias("_values"),
        F.array(F.max(F.when(shift == -1, slope)), F.max(F.when(shift == 1, slope))).alias("slope_values"))
    rows = null_safe_join(cursors, packed, [*KEY, "cursor"], "left")
    rows = cursor_values(rows, labelled_samples(telemetry, HELD), _all_labels(HELD), held=True, split=split)
    rows = rows.withColumn("values", F.map_concat("_values", "values")).drop("_values")
    rows = null_safe_join(rows, axes, KEY, "left")
    return null_safe_join(rows, present_messages(telemetry), KEY, "left")


def control_columns() -> dict[str, Column]:
    pilot, servo = stick_state("pilot"), stick_state("servo")
    demand = F.struct(*[value_of(f"ATT.{d}").alias(a) for a, (_, d) in fixed.ATTITUDE_COLUMNS.items()], value_of("CTUN.ThO").alias("throttle"))
    response = F.struct(*[value_of(f"ATT.{r}").alias(a) for a, (r, _) in fixed.ATTITUDE_COLUMNS.items()], servo["throttle"].alias("throttle"))
    gap = F.struct(*[F.abs(C.angle_diff(value_of(f"ATT.{r}"), value_of(f"ATT.{d}"))).alias(a)
                     for a, (r, d) in fixed.ATTITUDE_COLUMNS.items()])
    return {"pilot": pilot, "servo": servo, "demand": demand, "response": response, "divergence": gap}


def control_matrix(panel: DataFrame) -> DataFrame:
    """(log_id, cursor, axis, pilot, demand, actual, delta, band): four rows per cursor."""
    parts = panel.select(*KEY, "cursor", *[c.alias(n) for n, c in control_columns().items()])
    entries = []
    for axis in fixed.RC_AXES:
        angle = axis != "throttle"
        d, r = F.col(f"demand.{axis}"), F.col(f"response.{axis}")
        delta = F.col(f"divergence.{axis}") if angle else F.abs(d - r)
        limits = fixed.ANGLE_DELTA_LIMITS if angle else fixed.THROTTLE_DELTA_LIMITS
        entries.append(F.struct(F.lit(axis).alias("axis"), F.col(f"pilot.{axis}").alias("pilot"), d.alias("demand"), r.alias("actual"),
                                delta.alias("delta"), C.delta_band(delta, *limits).alias("band")))
    return parts.select(*KEY, "cursor", F.explode(F.array(*entries)).alias("_m")).select(*KEY, "cursor", "_m.*")


def _provenance() -> Column:
    """Map of every value used: where it was read, when, and whether it was interpolated."""
    def entry(key: str, label: Column, when_: Column | None = None) -> Column:
        s = F.col("values")[label]
        cell = F.struct(
            F.substring_index(label, ".", 1).alias("msg"), F.substring_index(label, ".", -1).alias("col"), s["value"].alias("value"),
            s["sample_t"].alias("sample_t"), F.coalesce(s["interpolated"], F.lit(False)).alias("interpolated"), s["bracket"].alias("bracket"))
        return F.when(when_ if when_ is not None else F.lit(True), F.struct(F.lit(key).alias("k"), cell.alias("v")))

    entries = []
    for msg, side in STICKS:
        for axis in fixed.RC_AXES:
            label = F.lit(f"{side}_{axis}")
            s = F.col("values")[label]
            cell = F.struct(F.lit(msg).alias("msg"), F.concat(F.lit("C"), F.col("axes")[axis]["channel"].cast("string")).alias("col"), s["value"].alias("value"),
                            s["sample_t"].alias("sample_t"), F.coalesce(s["interpolated"], F.lit(False)).alias("interpolated"), s["bracket"].alias("bracket"))
            entries.append(F.struct(label.alias("k"), cell.alias("v")))
    for axis, (act, des) in fixed.ATTITUDE_COLUMNS.items():
        entries += [entry(f"demand_{axis}", F.lit(f"ATT.{des}")), entry(f"response_{axis}", F.lit(f"ATT.{act}"))]
    entries.append(entry("demand_throttle", F.lit("CTUN.ThO")))
    gps = F.col("_gps")
    some = gps.isNotNull()
    entries += [
        entry("altitude_agl", F.col("altitude_source"), F.col("altitude_source").isNotNull()),
        entry("vertical_speed", F.col("vertical_speed_source"), F.col("vertical_speed").isNotNull() & ~F.col("vertical_speed_source").contains(" ")),
        entry("ground_speed", F.concat(gps, F.lit(".Spd")), some), entry("gps_status", F.concat(gps, F.lit(".Status")), some),
        entry("gps_sats", F.concat(gps, F.lit(".NSats")), some),
        entry("position_lat", F.concat(F.col("_fix"), F.lit(".Lat")), F.col("_fix").isNotNull()),
        entry("position_lng", F.concat(F.col("_fix"), F.lit(".Lng")), F.col("_fix").isNotNull()),
        entry("ekf_worst", F.concat_ws(".", "ekf.source", "ekf.worst"), F.col("ekf.ratio").isNotNull()),
        entry("posdiv_ipn", F.concat(F.col("position_divergence.source"), F.lit(".IPN")), F.col("position_divergence.value").isNotNull()),
        entry("posdiv_ipe", F.concat(F.col("position_divergence.source"), F.lit(".IPE")), F.col("position_divergence.value").isNotNull()),
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def snapshots(telemetry: DataFrame, cursors: DataFrame, verification: DataFrame | None = None,
              split: bool | None = None) -> DataFrame:
    """One investigation snapshot per cursor (log_id, cursor, t)."""
    split = needs_split(telemetry, ["log_id", "msg"]) if split is None else split
    span = cut(log_span(telemetry))
    regions = cut(arm_regions(telemetry, span, split))
    modes = cut(mode_segments(telemetry, span, split))
    stages = cut(phases(telemetry, regions, modes, span, split))
    cursors = cursors.select(*KEY, "cursor", F.col("t").cast("double").alias("t"))
    events = with_event_position(flight_events(telemetry))
    rows = nearest_event(cursors, events, KEY, "t", "ord", ["severity", "type", "message"], out="event", within=5.0, ties="last", split=split)
    rows = rows.withColumn("event", F.col("event").dropFields("seq"))
    rows = interval_lookup(rows, regions, KEY, "t", ["idx"], "idx", out="_flight", split=split)
    rows = interval_lookup(rows, modes, KEY, "t", ["mode"], "idx", out="_mode", split=split)
    rows = interval_lookup(rows, stages, KEY, "t", ["kind"], "idx", out="_phase", split=split)
    totals = regions.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_total"))
    rows = null_safe_join(rows, totals, KEY, "left")
    rows = rows.select(*KEY, "cursor", "t", "event", F.col("_flight.idx").alias("flight_index"),
                       F.coalesce("_total", F.lit(0)).alias("flight_total"), F.col("_phase.kind").alias("phase"), F.col("_mode.mode").alias("mode"))
    rows = cut(instrument_panel(telemetry, cut(rows), split))
    rows = rows.withColumns({
        **control_columns(), "ekf": estimator_status(), "position_divergence": position_divergence(), "_climb": climb_rate(),
        "_gps": first_present(("GPS[0]", "GPS")), "altitude_source": _altitude_label()})
    gps = F.col("_gps")
    by_gps = value_of(F.concat(gps, F.lit(".Lat"))).isNotNull() & value_of(F.concat(gps, F.lit(".Lng"))).isNotNull()
    by_pos = value_of("POS.Lat").isNotNull() & value_of("POS.Lng").isNotNull()
    rows = rows.withColumn("_fix", F.when(by_gps, gps).when(by_pos, F.lit("POS")))
    rows = rows.withColumns({
        "position": F.when(F.col("_fix").isNotNull(), F.struct(
            value_of(F.concat(F.col("_fix"), F.lit(".Lat"))).alias("lat"), value_of(F.concat(F.col("_fix"), F.lit(".Lng"))).alias("lng"))),
        "altitude_agl": value_of(F.col("altitude_source")), "vertical_speed": F.col("_climb.value"), "vertical_speed_source": F.col("_climb.source"),
        "ground_speed": value_of(F.concat(gps, F.lit(".Spd"))), "gps_fix": C.gps_fix_name(value_of(F.concat(gps, F.lit(".Status")))),
        "gps_sats": value_of(F.concat(gps, F.lit(".NSats"))).cast("bigint")})
    rows = rows.withColumn("provenance", _provenance())
    if verification is None:
        rows = rows.withColumn("verification_state", F.lit("UNKNOWN"))
    else:
        rows = null_safe_join(rows, verification.select(*KEY, F.col("state").alias("verification_state")), KEY, "left")
    return rows.drop("values", "slope_values", "axes", "present", "servo", "_climb", "_gps", "_fix")


def _altitude_label() -> Column:
    result = None
    for msg, col in ALTITUDES:
        hit = F.array_contains("present", msg)
        result = F.when(hit, F.lit(f"{msg}.{col}")) if result is None else result.when(hit, F.lit(f"{msg}.{col}"))
    return result


def latest_snapshots(store: DataFrame) -> DataFrame:
    """Current state of an append-only snapshot table (log_id, cursor, at, deleted, status, notes, ...)."""
    others = [c for c in store.columns if c not in (*KEY, "cursor", "at")]
    newest = store.groupBy(*KEY, "cursor").agg(F.max_by(F.struct(*others), "at").alias("_s"))
    return newest.select(*KEY, "cursor", "_s.*").where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def watchlist_values(telemetry: DataFrame, cursors: DataFrame, watchlist=fixed.WATCHLIST, split: bool | None = None) -> DataFrame:
    """(log_id, cursor, label, value) for a list of (label, message, instance, column)."""
    samples = labelled_samples(telemetry, [(m, i, (c,)) for _, m, i, c in watchlist])
    signals = [f"{_name(m, i)}.{c}" for _, m, i, c in watchlist]
    rows = cursor_values(cursors.select(*KEY, "cursor", "t"), samples, signals, split=split)
    cells = F.array(*[F.struct(F.lit(w[0]).alias("label"), value_of(s).alias("value")) for w, s in zip(watchlist, signals)])
    return rows.select(*KEY, "cursor", F.explode(cells).alias("_c")).select(*KEY, "cursor", "_c.*")


def motor_mean(telemetry: DataFrame, cursors: DataFrame, split: bool | None = None) -> DataFrame:
    """Mean motor output over all instances at each cursor, held at the edges."""
    rows = records(telemetry, "ESCX").where(F.col("instance").isNotNull())
    rows = rows.select(*KEY, "instance", "seq", "t", number("outpct", "Outpct", "OutPct").alias("v")).where(F.col("v").isNotNull())
    motors = rows.select(*KEY, "instance").distinct()
    marks = null_safe_join(cursors.select(*KEY, "cursor", "t"), motors, KEY, "inner")
    found = bracket(marks, rows, [*KEY, "instance"], "t", "seq", ["v"], exact="lower", split=split)
    value = clamped_value(F.col("t"), F.col("lower"), F.col("upper"))
    return found.groupBy(*KEY, "cursor").agg(F.avg(value).alias("esc_avg"))


def telemetry_rows(telemetry: DataFrame, cursors: DataFrame, split: bool | None = None) -> DataFrame:
    """Replay readout per cursor: height, speed, attitude, mode, mean motor output."""
    split = needs_split(telemetry, ["log_id", "msg"]) if split is None else split
    wanted = (("ATT", None, ("Roll", "Pitch", "Yaw")), ("SIM2", None, ("VN", "VE", "VD")))
    up = best_trajectory(telemetry, split).select(*KEY, F.lit("up").alias("signal"), "seq", "t", F.col("up").alias("v"))
    samples = labelled_samples(telemetry, wanted).unionByName(up).where(F.col("v").isNotNull())
    signals = [*_all_labels(wanted), "up"]
    marks = cursors.select(*KEY, "cursor", "t", F.explode(F.array(*[F.lit(s) for s in signals])).alias("signal"))
    found = bracket(marks, samples, [*KEY, "signal"], "t", "seq", ["v"], exact="lower", split=split)
    value = clamped_value(F.col("t"), F.col("lower"), F.col("upper"))
    read = {s: F.coalesce(F.max(F.when(F.col("signal") == s, value)), F.lit(0.0)) for s in signals}
    wide = found.groupBy(*KEY, "cursor").agg(*[e.alias(s.replace(".", "_")) for s, e in read.items()])
    modes = records(telemetry, "MODE").where(F.col("instance").isNull()).select(*KEY, "seq", "t", number(*fixed.MODE_NUMBER).alias("m"))
    held = bracket(cursors.select(*KEY, "cursor", "t"), modes, KEY, "t", "seq", ["m"], split=split)
    rows = null_safe_join(held, wide, [*KEY, "cursor"], "left")
    rows = null_safe_join(rows, motor_mean(telemetry, cursors, split), [*KEY, "cursor"], "left")
    mode = C.mode_name(F.coalesce("lower.m", "upper.m"))
    return rows.select(
        *KEY, "cursor", "t", F.col("up").alias("alt"), C.speed_3d(F.col("SIM2_VN"), F.col("SIM2_VE"), F.col("SIM2_VD")).alias("speed"),
        F.col("ATT_Roll").alias("roll"), F.col("ATT_Pitch").alias("pitch"), F.col("ATT_Yaw").alias("yaw"),
        F.coalesce(mode, F.lit("—")).alias("mode"), F.coalesce("esc_avg", F.lit(0.0)).alias("esc_avg"))
