"""Writers, report assembly, presets and table equality."""

import tempfile

from pyspark.sql import functions as F

from aerolake.functions import fixed
from aerolake.operators import setops
from aerolake.plans import catalog, evidence


def test_report_blocks_are_written_in_order(spark):
    meta = spark.createDataFrame([("a", "7", "fw 1", None), ("b", None, None, None)], "log_id string, serial_number string, firmware string, frame_type string")
    report = spark.createDataFrame(
        [("a", "GOOD", "fine", 91.0, 88.0, "B", [("Tracking", 90.0, "A", "x")], ["tracking 90"], 2, 70.0, 1), ("b", "NO DATA", "none", None, None, None, [], [], 0, 0.0, 0)],
        "log_id string, verdict string, headline string, quality_score double, pilot_score double, pilot_grade string, categories array<struct<name:string,score:double,grade:string,detail:string>>, "
        "factors array<string>, flight_count long, armed_s double, finding_count long")
    findings = spark.createDataFrame([("a", 1, "WARNING", "TRACKING", "Poor roll tracking", "detail", None, [])],
                                     "log_id string, finding_no long, severity string, category string, title string, detail string, t_start double, evidence array<string>")
    verified = spark.createDataFrame([("a", "VERIFIED", ["Ed25519 signature valid."])], "log_id string, state string, basis array<string>")
    geo = spark.createDataFrame([("a", 1.0, 2.0, "YSSY", "Sydney", 1500.0, "YSSY", "07/25", 900.0)],
                                "log_id string, lat double, lon double, ident string, name string, airport_m double, airport_ident string, designator string, runway_m double")
    blocks = evidence.report_markdown(meta, report, findings, verified=verified, geo=geo)
    whole = "\n".join(r.text for r in blocks.where("log_id = 'a'").orderBy("section", "item").collect())
    marks = ["# Investigation Evidence", "**Aircraft:** 7 · fw 1 · —", "**Assessment:** GOOD (91/100)", "## Verification", "- Ed25519 signature valid.", "## Geographic Context",
             "(1.5 km)", "## Conclusion", "| Tracking | 90 | A |", "## Findings (1)", "### 1. [WARNING]"]
    assert [whole.find(m) for m in marks] == sorted(whole.find(m) for m in marks) and whole.find(marks[0]) == 0
    assert "**Verification:** UNKNOWN" in blocks.where("log_id = 'b' AND section = -1").first().text
    folder = tempfile.mkdtemp(prefix="run-")
    evidence.write_markdown(blocks, f"{folder}/md")
    back = spark.read.json(f"{folder}/md")
    assert back.select(*blocks.columns).exceptAll(blocks.select(*[F.col(c).cast(back.schema[c].dataType) for c in blocks.columns])).count() == 0 and back.count() == blocks.count()
    documents = evidence.report_json(meta, report, findings, verified=verified)
    evidence.write_json(documents, f"{folder}/json")
    assert {(r.log_id, r.json) for r in spark.read.json(f"{folder}/json").collect()} == {(r.log_id, r.json) for r in documents.collect()}
    row = documents.where("log_id = 'a'").select(F.get_json_object("json", "$.flight.verification_state"), F.get_json_object("json", "$.snapshot_count")).first()
    assert tuple(row) == ("VERIFIED", "0")


def test_registered_reports_hold_all_parts(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.001"
    taken = {str(r.user_id): r["count"] for r in spark.read.parquet(f"{folder}/events.parquet").where("event_type = 'error'").groupBy("user_id").count().collect()}
    read = lambda path: F.get_json_object("json", path)
    documents = contract.queries()["report_documents"](spark, folder).select(
        "log_id", "part", read("$.snapshot_count").cast("long").alias("n"), F.size(F.from_json(read("$.snapshots"), "array<struct<cursor:bigint>>")).alias("held"),
        read("$.flight.verification_state").alias("state"), read("$.geographic_context.ident").alias("ident"), read("$.flight_assessment.verdict").alias("verdict")).collect()
    heads = {r.log_id: r for r in documents if r.part == 0}
    assert {d: r.n for d, r in heads.items() if r.n} == taken and set(taken) <= set(heads)
    assert {d: sum(r.held for r in documents if r.log_id == d and r.held > 0) for d in taken} == taken
    assert {r.state for r in heads.values()} == {"UNSIGNED", "UNKNOWN", "PARTIAL", "INVALID", "CORRUPTED"} and any(r.ident for r in heads.values()) and all(r.verdict for r in heads.values())
    blocks = contract.queries()["report_blocks"](spark, folder).groupBy("section").agg(F.count("text").alias("n"), F.countDistinct("log_id").alias("logs")).collect()
    assert {r.section: r.logs for r in blocks if r.section in (-1, 0, 2)} == dict.fromkeys((-1, 0, 2), len(heads))
    assert {r.section: r.n for r in blocks}[4] == sum(taken.values()) and {r.section for r in blocks} == {-1, 0, 1, 2, 3, 4}


def test_pilot_column_is_kept(spark):
    import __spark_entry__ as contract

    whole, given = (contract.queries()[n](spark, "/root/testdata/sf0.001") for n in ("control_matrix_pilot", "control_matrix"))
    assert whole.where("pilot IS NOT NULL").count() > 0 and whole.drop("pilot").exceptAll(given).count() == 0


def test_signals_are_written_as_csv(spark):
    table = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("b", 1, 2.5)], "log_id string, row long, v double")
    folder = tempfile.mkdtemp(prefix="run-")
    catalog.write_signals_csv(table, f"{folder}/csv", buckets=4)
    back = spark.read.option("header", True).schema("log_id string, row long, v double").csv(f"{folder}/csv")
    assert sorted(map(tuple, back.select("log_id", "row", "v").collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)


def test_presets_cover_their_categories(spark):
    presets = {r.preset for r in catalog.preset_table(spark).collect()}
    found = spark.createDataFrame([(c,) for c in (*fixed.CATEGORY_PRESET, "other")], "c string").select("c", catalog.finding_preset(F.col("c")).alias("p")).collect()
    assert all(r.p in presets for r in found if r.c != "other") and [r.p for r in found if r.c == "other"] == [None]


def test_table_equality_counts_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "k long, v string")
    assert setops.tables_equal(a, a.orderBy("v")) and not setops.tables_equal(a, a.distinct())


def test_a_null_under_the_first_spelling_stays_null(spark):
    from aerolake.schema import number, text

    row = spark.sql("SELECT map('HDop', CAST(NULL AS DOUBLE)) AS reals, map('Hdop', 4L) AS ints, map('a', CAST(NULL AS STRING), 'b', 'x') AS texts")
    assert tuple(row.select(number("HDop", "Hdop"), number("None", "Hdop"), text("a", "b"), text("c", "b")).first()) == (None, 4.0, None, "x")
