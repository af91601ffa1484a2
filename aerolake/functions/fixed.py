"""Names, codes, limits and thresholds that results depend on.

They are facts of the log format, of the autopilot's parameters and of the documented scoring
rules, so they are stated here once, as plain tables.
"""

# Flight mode number -> name.
MODE_NAMES = {
    0: "STABILIZE", 1: "ACRO", 2: "ALT_HOLD", 3: "AUTO", 4: "GUIDED", 5: "LOITER", 6: "RTL",
    9: "LAND", 16: "POSHOLD", 17: "BRAKE", 18: "THROW", 19: "AVOID_ADSB", 20: "GUIDED_NOGPS",
    21: "SMART_RTL",
}

# Event id -> name.
EVENT_NAMES = {
    10: "Armed", 11: "Disarmed", 15: "Auto_Armed", 16: "Land_Complete", 18: "Not_Landed",
    25: "Set_Home", 26: "Wrote_EEPROM", 27: "Load_Default_Params", 28: "Pilot_YawSet",
}
ARMING_EVENT_IDS = (10, 15)
DISARMING_EVENT_ID = 11

# Error subsystem number -> name.
ERROR_SUBSYSTEMS = {
    1: "Main", 2: "Radio", 3: "Compass", 5: "FailSafe_Radio", 6: "FailSafe_Batt",
    7: "FailSafe_GPS", 10: "FlightMode", 11: "GPS", 16: "EKF_Check", 17: "FailSafe_EKF",
    18: "Barometer",
}

# GPS fix type -> name.
GPS_FIX_NAMES = {
    0: "NO_GPS", 1: "NO_FIX", 2: "2D_FIX", 3: "3D_FIX", 4: "DGPS", 5: "RTK_FLOAT", 6: "RTK_FIXED",
}

# Severities in rising order, and the words that make a message critical.
SEVERITY_RANK = {"INFO": 0, "WARNING": 1, "ERROR": 2, "CRITICAL": 3}
CRITICAL_WORDS = ("fail", "error", "crash", "critical")

# Column spellings in order of preference.
MESSAGE_TEXT = ("Message", "Msg")
EVENT_ID = ("Id", "ID", "id")
ERROR_SUBSYSTEM = ("Subsys", "SubSys", "subsys")
ERROR_CODE = ("ECode", "Ecode", "ecode")
ARM_STATE = ("ArmState", "Armed", "State")
ARM_METHOD = ("Method", "method")
MODE_NUMBER = ("Mode", "ModeNum")

# RC axes, their default channels and pulse widths (microseconds).
RC_AXES = ("roll", "pitch", "yaw", "throttle")
RC_DEFAULT_CHANNEL = {"roll": 1, "pitch": 2, "throttle": 3, "yaw": 4}
RC_DEFAULT_MIN, RC_DEFAULT_TRIM, RC_DEFAULT_MAX = 1000.0, 1500.0, 2000.0

# Earth radius (metres) and the latitude limit of Web-Mercator tiles (degrees).
EARTH_RADIUS_M = 6378137.0
MERCATOR_MAX_LAT = 85.05112878

# Attitude columns (actual, demanded) per axis and tolerances in degrees.
ATTITUDE_COLUMNS = {
    "roll": ("Roll", "DesRoll"), "pitch": ("Pitch", "DesPitch"), "yaw": ("Yaw", "DesYaw"),
}
TRACK_TOLERANCE_DEG = {"roll": 5.0, "pitch": 5.0, "yaw": 8.0}

# Oscillation band (Hz), amplitudes (degrees) and spectral concentration.
OSC_MIN_HZ, OSC_MAX_HZ = 0.4, 20.0
OSC_AMP_WARN, OSC_AMP_CRIT = 2.0, 5.0
OSC_CONCENTRATION = 0.12
OSC_RATE_HZ = 50.0

# Saturation limits.
SATURATED_FRACTION_WARN, SATURATED_FRACTION_CRIT = 0.05, 0.20
OUTPUT_SATURATED = 0.95
PWM_MARGIN = 0.03

# Touchdown rate bands (m/s) with class and score, and grade floors.
LANDING_BANDS = ((1.0, "SMOOTH", 100.0), (2.0, "FIRM", 80.0), (3.0, "HARD", 50.0))
LANDING_WORST = ("SEVERE", 20.0)
GRADE_FLOORS = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
QUALITY_BANDS = (
    (85, "GOOD", "Good flight — clean tracking and stable control."),
    (70, "ACCEPTABLE", "Acceptable flight with minor issues."),
    (50, "MARGINAL", "Marginal flight — review the findings."),
)
QUALITY_WORST = ("POOR", "Poor flight — significant issues detected.")
QUALITY_NO_DATA = ("NO DATA", "Insufficient data for a flight-quality assessment.")
QUALITY_WEIGHTS = {"tracking": 0.30, "stability": 0.25, "saturation": 0.15, "pilot": 0.30}
CRITICAL_CAP = 55.0

# Phase rules (metres, m/s, seconds) and overriding modes.
GROUND_AGL_M, CLIMB_RATE, PHASE_STEP_S, MIN_PHASE_S = 1.0, 0.3, 0.5, 0.05
RTL_MODES = ("RTL", "SMART_RTL", "AUTO_RTL")
LAND_MODES = ("LAND",)

# Cursor diagnostics thresholds (warning, critical).
EKF_LIMITS = (0.5, 1.0)
POSITION_LIMITS = (0.5, 2.0)
ANGLE_DELTA_LIMITS = (8.0, 20.0)
THROTTLE_DELTA_LIMITS = (0.10, 0.25)

# Altitude above which a maximum is reported as suspect (metres).
PLAUSIBLE_ALTITUDE_M = 60000.0

# Field limits; a reading outside is missing.
FIELD_BOUNDS = {
    "AccX": (-200, 200), "AccY": (-200, 200), "AccZ": (-200, 200),
    "GyrX": (-35, 35), "GyrY": (-35, 35), "GyrZ": (-35, 35),
    "Roll": (-180, 180), "Pitch": (-90, 90), "Yaw": (-360, 360),
    "DesRoll": (-180, 180), "DesPitch": (-90, 90), "DesYaw": (-360, 360),
    "Volt": (0, 60), "Curr": (-5, 500),
    "RPM": (0, 100000), "outpct": (0, 100), "inpct": (0, 100),
}
SANE_LIMIT = 1e9
MAX_TIME_US = 3e11

# Instance columns and the instance numbers each message may carry.
INSTANCE_COLUMNS = ("I", "Instance", "C", "IMU")
INSTANCE_BOUNDS = {
    "ESC": (0, 11), "ESCX": (0, 11), "IMU": (0, 3), "VIBE": (0, 3), "BARO": (0, 3),
    "MAG": (0, 3), "GPS": (0, 3), "GPA": (0, 3), "SURF": (0, 3),
}
DEFAULT_INSTANCE_BOUNDS = (0, 15)

# Signal groups, plot presets and units.
MESSAGE_GROUPS = {
    "ATTITUDE": ("ATT", "ANG", "RATE", "PIDR", "PIDP", "PIDY", "PIDA"),
    "EKF": ("XKF1", "XKF2", "XKF3", "XKF4", "XKF5", "XKFS", "XKQ", "XKT", "XKY0", "XKY1"),
    "GPS/NAV": ("GPS", "GPA", "AHR2", "CTUN", "PSCN", "PSCE", "PSCD"),
    "IMU": ("IMU", "ACC", "GYR", "VIBE"),
    "MOTORS": ("ESCX", "ESC", "SURF", "MOTB", "RCIN", "RCOU"),
    "POWER": ("BAT", "BCL", "POWR", "MCU"),
    "BARO": ("BARO", "ARSP"),
    "MAG": ("MAG",),
    "SIMULATION": ("SIM", "SIM2"),
}
PLOT_PRESETS = {
    "Roll": (("ATT", "Roll"), ("ATT", "DesRoll")),
    "Pitch": (("ATT", "Pitch"), ("ATT", "DesPitch")),
    "Yaw": (("ATT", "Yaw"), ("ATT", "DesYaw")),
    "Attitude": (("ATT", "Roll"), ("ATT", "DesRoll"), ("ATT", "Pitch"), ("ATT", "DesPitch")),
    "GPS": (("GPS", "Status"), ("GPS", "NSats"), ("GPS", "HDop")),
    "EKF": (("XKF4", "SV"), ("XKF4", "SP"), ("XKF4", "SH"), ("XKF4", "SM")),
    "Vibe": (("VIBE", "VibeX"), ("VIBE", "VibeY"), ("VIBE", "VibeZ")),
    "Motors": (("RCOU", "C1"), ("RCOU", "C2"), ("RCOU", "C3"), ("RCOU", "C4")),
    "Power": (("BAT", "Volt"), ("BAT", "Curr")),
}
CATEGORY_PRESET = {
    "OSCILLATION": "Attitude", "TRACKING": "Attitude", "YAW": "Yaw", "EKF": "EKF", "GPS": "GPS",
    "VIBE": "Vibe", "POWER": "Power", "SATURATION": "Motors", "LANDING": "Attitude",
}
CATEGORY_SIGNALS = {
    "OSCILLATION": (("ATT", "Roll"), ("ATT", "DesRoll"), ("ATT", "Pitch"), ("ATT", "DesPitch")),
    "TRACKING": (("ATT", "Roll"), ("ATT", "DesRoll"), ("ATT", "Pitch"), ("ATT", "DesPitch")),
    "YAW": (("ATT", "Yaw"), ("ATT", "DesYaw")),
    "SATURATION": (("RCOU", "C1"), ("RCOU", "C2"), ("RCOU", "C3"), ("RCOU", "C4")),
    "LANDING": (("BARO", "CRt"), ("POS", "RelHomeAlt")),
    "VIBE": (("VIBE", "VibeX"), ("VIBE", "VibeY"), ("VIBE", "VibeZ")),
    "EKF": (("XKF4", "SV"), ("XKF4", "SP"), ("XKF4", "SH"), ("XKF4", "SM")),
    "GPS": (("GPS", "NSats"), ("GPS", "HDop")),
    "POWER": (("BAT", "Volt"), ("BAT", "Curr")),
}
UNIT_HINTS = (
    (("alt", "Alt"), "m"),
    (("RPM", "Rpm"), "RPM"),
    (("Roll", "Pitch", "Yaw", "roll", "pitch", "yaw"), "deg"),
    (("Volt", "volt"), "V"),
    (("Curr", "curr"), "A"),
    (("VN", "VE", "VD", "spd", "Spd"), "m/s"),
    (("pct", "Pct"), "%"),
)
WATCHLIST = (
    ("BAT Volt", "BAT", None, "Volt"), ("BAT Curr", "BAT", None, "Curr"),
    ("Motor 1", "RCOU", None, "C1"), ("Motor 2", "RCOU", None, "C2"),
    ("Motor 3", "RCOU", None, "C3"), ("Motor 4", "RCOU", None, "C4"),
    ("IMU AccZ", "IMU", 0, "AccZ"), ("Vibe Z", "VIBE", None, "VibeZ"),
)
AERODROME_KINDS = ("small_airport", "medium_airport", "large_airport")

# Verification states with label, tone, summary, meaning and guidance.
VERIFICATION_STATES = {
    "VERIFIED": (
        "VERIFIED", "good", "Complete signed log — integrity confirmed.",
        "Hash chain and Ed25519 signature both validated over a complete signed log.",
        "Log is complete and cryptographically intact. No integrity concerns."),
    "PARTIAL": (
        "PARTIAL", "warn", "Signed log interrupted before closure.",
        "Signed log interrupted before closure (no END record / trailer). Hash-chain integrity "
        "is confirmed for all written chunks; the final Ed25519 signature is unavailable because "
        "log closure was not completed.",
        "Common cause is battery disconnect or power loss. Telemetry remains available and "
        "usable. Integrity is confirmed for all written chunks; absence of closure is expected "
        "for an in-flight power loss and is not, by itself, evidence of tampering."),
    "UNSIGNED": (
        "UNSIGNED", "neutral", "Standard unsigned DataFlash log.",
        "No signature structures are present. This is a standard unsigned DataFlash log.",
        "Not an error. Cryptographic verification does not apply to unsigned logs."),
    "INVALID": (
        "INVALID", "bad", "Signature validation failed — treat data as untrusted.",
        "Signature structures are present and verification was attempted, but a hash-chain "
        "mismatch, signature failure, or post-signing modification was detected.",
        "Possible tampering or corruption. Treat the data as untrusted and preserve the original "
        "file for forensic review."),
    "CORRUPTED": (
        "CORRUPTED", "bad", "Verification records malformed — integrity undeterminable.",
        "Verification structures are malformed or unreadable; integrity cannot be determined.",
        "The log may be physically damaged. Recover a clean copy if possible — integrity cannot "
        "be asserted from this file."),
    "UNKNOWN": (
        "UNKNOWN", "muted", "Verification not performed — no public key loaded.",
        "Verification has not been attempted because no public key is loaded. The keyless hash "
        "chain may still be evaluated.",
        "User action required: load the unit's public key to confirm the signature."),
    "WRONG_KEY": (
        "WRONG KEY", "warn", "Public key does not match this aircraft.",
        "A public key is loaded but it does not match this log's unit (key fingerprint mismatch).",
        "User action required: load the correct public key for this aircraft, then re-verify. "
        "Distinct from UNKNOWN (no key loaded)."),
}
LEGACY_STATES = {
    "NOT_LOADED": "UNKNOWN", "NOT_SIGNED": "UNSIGNED", "UNVERIFIED": "UNKNOWN",
    "STRUCTURE_ERROR": "CORRUPTED", "TAMPERED": "INVALID", "KEY_MISMATCH": "WRONG_KEY",
    "TRUNCATED": "PARTIAL", "ERROR": "CORRUPTED", "": "UNKNOWN",
}

# The sentences that say what was checked of a log.
BASIS_CHUNKS = "%s %s hash-chain chunks %s."
BASIS_CHAIN = {True: "validated", False: "present — chain mismatch detected"}
BASIS_NO_CHUNKS = {
    "UNSIGNED": "No signature structures present.",
    "CORRUPTED": "Verification records could not be parsed.",
}
BASIS_END = {True: "END record present.", False: "END record not present."}
BASIS_SIGNATURE = {
    "VERIFIED": "Ed25519 signature valid.",
    "PARTIAL": "Final Ed25519 signature unavailable (log not closed).",
    "INVALID": "Signature / hash-chain validation failed.",
    "WRONG_KEY": "Key fingerprint does not match this log.",
    "UNKNOWN": "Signature not checked — no public key loaded.",
}
