"""Column expressions: angles, scores, codes and text. All stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake.functions import fixed


def pick(code: Column, table: Mapping, default: Column | None = None) -> Column:
    """Lookup in a small fixed table: a constant map, so no join and little generated code."""
    entries = []
    for key, value in table.items():
        entries += [F.lit(key).cast("bigint") if isinstance(key, int) else F.lit(key), F.lit(value)]
    whole = all(isinstance(key, int) for key in table)
    found = F.create_map(*entries)[code.cast("bigint") if whole else code]
    return F.coalesce(found, default) if default is not None else found


def code_name(code: Column, table: Mapping[int, str], prefix: str) -> Column:
    whole = code.cast("bigint")
    return F.when(whole.isNotNull(),
                  pick(whole, table, F.concat(F.lit(prefix), whole.cast("string"))))


def mode_name(code: Column) -> Column:
    return code_name(code, fixed.MODE_NAMES, "MODE_")


def event_name(code: Column) -> Column:
    return code_name(code, fixed.EVENT_NAMES, "EV_")


def subsystem_name(code: Column) -> Column:
    return code_name(code, fixed.ERROR_SUBSYSTEMS, "Subsys_")


def gps_fix_name(code: Column) -> Column:
    return code_name(code, fixed.GPS_FIX_NAMES, "FIX_")


def severity_rank(severity: Column) -> Column:
    return pick(severity, fixed.SEVERITY_RANK, F.lit(0))


def keyword_severity(text: Column) -> Column:
    lowered = F.lower(text)
    hit = reduce(lambda a, b: a | b, [lowered.contains(w) for w in fixed.CRITICAL_WORDS])
    return F.when(hit, F.lit("CRITICAL")).otherwise(F.lit("INFO"))


# -- angles and scores -------------------------------------------------------------------------

def angle_diff(a: Column, b: Column) -> Column:
    """Signed smallest difference a - b in degrees, in [-180, 180)."""
    return F.pmod(a - b + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def threshold_state(value: Column, warn: float, crit: float) -> Column:
    return (F.when(value.isNull(), F.lit("OK")).when(value >= crit, F.lit("CRITICAL"))
            .when(value >= warn, F.lit("CAUTION")).otherwise(F.lit("OK")))


def delta_band(delta: Column, warn: float, crit: float) -> Column:
    return (F.when(delta.isNull(), F.lit("NONE")).when(delta >= crit, F.lit("CRITICAL"))
            .when(delta >= warn, F.lit("CAUTION")).otherwise(F.lit("NOMINAL")))


def clip(value: Column, low, high) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def linear_score(value: Column, limit: float) -> Column:
    """100 at zero, 0 at ``limit`` and beyond."""
    return clip(F.lit(100.0) * (F.lit(1.0) - value / F.lit(limit)), 0.0, 100.0)


def bands(value: Column, floors: Sequence[tuple], worst) -> Column:
    result = None
    for floor, name, *_ in floors:
        hit = value >= floor
        result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
    return F.when(value.isNotNull(), result.otherwise(F.lit(worst)))


def letter_grade(score: Column) -> Column:
    return bands(score, fixed.GRADE_FLOORS, "F")


def landing_class(rate: Column) -> Column:
    result = F.when(rate.isNull(), F.lit("UNKNOWN"))
    for limit, name, _ in fixed.LANDING_BANDS:
        result = result.when(rate < limit, F.lit(name))
    return result.otherwise(F.lit(fixed.LANDING_WORST[0]))


def landing_score(rate: Column) -> Column:
    result = F.when(rate.isNull(), F.lit(None).cast("double"))
    for limit, _, score in fixed.LANDING_BANDS:
        result = result.when(rate < limit, F.lit(score))
    return result.otherwise(F.lit(fixed.LANDING_WORST[1]))


def mean_of(*values: Column) -> Column:
    """Mean of the values that are present, NULL when none is."""
    n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(n > 0, total / n)


def speed_3d(vn: Column, ve: Column, vd: Column) -> Column:
    return F.sqrt(vn * vn + ve * ve + vd * vd)


# -- text --------------------------------------------------------------------------------------

def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it names several times: the value's expression stands in the plan once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed_text(value: Column, digits: int, plus: bool = False) -> Column:
    """Decimal text of the exact binary value, half-even where that lies between two texts: 0.35 is a little less than
    its digits say and gives 0.3, 0.25 lies between and gives 0.2.

    The fraction is counted in units of 2^-60, so that rounding is arithmetic of whole numbers; a fraction too small for
    that is nowhere near a tie. Numbers too large to have such fractions are given as they are.
    """
    unit, shift = F.lit(Decimal(2**60)), 10**digits

    def rounded(size: Column, scaled: Column) -> Column:
        rest = scaled % unit
        low = F.floor(size) * shift + ((scaled - rest) / unit).cast("bigint")
        return low + ((rest * 2 > unit) | ((rest * 2 == unit) & (low % 2 == 1))).cast("bigint")

    def written(total: Column) -> Column:
        whole = F.floor((total - total % shift) / shift).cast("string")
        return F.concat(whole, F.lit("."), F.lpad((total % shift).cast("string"), digits, "0")) if digits else whole

    def text(v: Column) -> Column:
        exact = F.abs(v) < float(2**53 // shift)
        size = F.abs(F.when(exact, v).otherwise(0.0))
        scaled = ((size - F.floor(size)) * 2.0**60).cast("bigint").cast("decimal(19,0)") * F.lit(Decimal(shift))
        digits_text = bound(bound(scaled, lambda s: rounded(size, s)), written)
        sign = F.when(v < 0, "-").otherwise("+" if plus else "")
        return F.when(exact, F.concat(sign, digits_text)).otherwise(F.format_string(f"%{'+' if plus else ''}.{digits}f", v))

    return bound(value.cast("double"), text)


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"),
                    F.lpad(F.pmod(whole, F.lit(60)).cast("string"), 2, "0"))


def altitude_text(metres: Column) -> Column:
    suspect = F.abs(metres) > fixed.PLAUSIBLE_ALTITUDE_M
    return (F.when(metres.isNull(), F.lit("—"))
            .when(suspect, F.concat(F.lit("⚠ "), fixed_text(metres, 0), F.lit(" m (suspect)")))
            .otherwise(F.concat(fixed_text(metres, 1), F.lit(" m"))))


def distance_text(metres: Column) -> Column:
    return (F.when(metres.isNull(), F.lit("—"))
            .when(metres >= 1000, F.concat(fixed_text(metres / 1000, 2), F.lit(" km")))
            .otherwise(F.concat(fixed_text(metres, 0), F.lit(" m"))))


def speed_text(mps: Column) -> Column:
    return F.when(mps.isNull(), F.lit("—")).otherwise(F.concat(fixed_text(mps, 1), F.lit(" m/s")))


def measure_text(value: Column, digits: int, unit: str = "", plus: bool = False) -> Column:
    gap = "" if unit in ("", "°", "%") else " "
    return F.when(value.isNull(), F.lit("—")).otherwise(
        F.concat(fixed_text(value, digits, plus), F.lit(f"{gap}{unit}")))


def firmware_name(text: Column) -> Column:
    closed = text.contains("(") & text.contains(")")
    return F.when(closed, F.trim(F.substring_index(text, "(", 1))).otherwise(text)


def firmware_build(text: Column) -> Column:
    closed = text.contains("(") & text.contains(")")
    opening, closing = F.instr(text, "("), F.instr(text, ")")
    inside = F.when(closing > opening, text.substr(opening + 1, closing - opening - 1))
    return F.when(closed, F.coalesce(inside, F.lit(""))).otherwise(F.lit(""))


def signal_base(key: Column) -> Column:
    return F.when(key.rlike(r"^(.+)\[(\d+)\]$"),
                  F.regexp_extract(key, r"^(.+)\[(\d+)\]$", 1)).otherwise(key)


def signal_instance(key: Column) -> Column:
    digits = F.regexp_extract(key, r"^(.+)\[(\d+)\]$", 2)
    return F.when(digits != "", digits.cast("int"))


def signal_key(msg: Column, instance: Column) -> Column:
    return F.when(instance.isNull(), msg).otherwise(
        F.concat(msg, F.lit("["), instance.cast("string"), F.lit("]")))


def unit_of(field: Column) -> Column:
    result = None
    for words, unit in fixed.UNIT_HINTS:
        hit = reduce(lambda a, b: a | b, [field.contains(w) for w in words])
        result = F.when(hit, F.lit(unit)) if result is None else result.when(hit, F.lit(unit))
    return result.otherwise(F.lit(""))


def message_group(msg: Column) -> Column:
    result = None
    for group, members in fixed.MESSAGE_GROUPS.items():
        hit = msg.isin(*members)
        result = F.when(hit, F.lit(group)) if result is None else result.when(hit, F.lit(group))
    return result.otherwise(F.lit("OTHER"))


# -- verification states -----------------------------------------------------------------------

def normal_state(state: Column) -> Column:
    known = state.isin(*fixed.VERIFICATION_STATES)
    return F.when(known, state).otherwise(pick(state, fixed.LEGACY_STATES, F.lit("UNKNOWN")))


def state_fact(state: Column, fact: str) -> Column:
    index = {"label": 0, "tone": 1, "summary": 2, "meaning": 3, "guidance": 4}[fact]
    return pick(normal_state(state), {k: v[index] for k, v in fixed.VERIFICATION_STATES.items()})


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def verification_basis(state: Column, chunks: Column, chain_valid: Column, closed: Column,
                       algorithm: Column) -> Column:
    """Sentences saying what was checked, as an array."""
    state = normal_state(state)
    family = F.trim(F.substring_index(F.coalesce(algorithm, F.lit("")), "+", 1))
    family = F.when(family == "", F.lit("hash-chain")).otherwise(family)
    counted = F.format_string(fixed.BASIS_CHUNKS, thousands(chunks), family, pick(F.coalesce(chain_valid, F.lit(False)), fixed.BASIS_CHAIN))
    chain = F.when(F.coalesce(chunks, F.lit(0)) > 0, counted).otherwise(pick(state, fixed.BASIS_NO_CHUNKS))
    closure = pick(closed, fixed.BASIS_END)
    signature = pick(state, fixed.BASIS_SIGNATURE)
    return F.array_compact(F.array(chain, closure, signature))
