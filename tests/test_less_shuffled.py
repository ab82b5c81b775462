"""Work that is done once, in all tasks, on rows no wider than needed."""

import glob
import time

from pyspark.sql import functions as F

from clearcharge.operators import lines, positions, verdicts
from clearcharge.plans import audit, export, prices
from clearcharge.registry import views
from clearcharge.session import materialise

_LINE = "k int, setting_expected string, code_type string, code string, other_codes array<string>, description string, setting string, billing_class string, modifiers string, " \
        "gross decimal(18,6), discounted_cash decimal(18,6), minimum decimal(18,6), maximum decimal(18,6), source_ref string, off_template_note string, class_from_review boolean"


def test_few_rows_are_numbered_by_one_task_but_made_by_all(spark):
    made = spark.range(0, 800, 1, 8).withColumn("made_by", F.spark_partition_id())
    placed = positions.numbered(made, [], [F.col("id").desc()], "place").collect()
    assert {r["place"]: r["id"] for r in placed} == {800 - i: i for i in range(800)}
    assert len({r["made_by"] for r in placed}) == 8


def test_a_summary_sends_one_line_a_group(spark):
    row = lambda cash, setting, ref, other: (1, "outpatient", "CPT", "7", other, "d", setting, "facility", None, None, cash, None, None, ref, None, False)
    given = spark.createDataFrame([row(3, "inpatient", "row 1", ["a"]), row(5, "outpatient", "row 3", ["c"]), row(5, "outpatient", "row 2", ["b"]), row(5, None, "row 0", None)],
                                  _LINE.replace("decimal(18,6)", "int"))
    found = verdicts.summarise(given, ["k"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count(" min(") == 1
    told = found.first()
    # The line that does not fit is cheaper and earlier, but no headline.
    assert (told["verdict"], told["headline"]["source_ref"], told["headline"]["other_codes"], told["line_count"]) == ("comparable", "row 2", ["b"], 4)


def test_codes_of_items_are_read_once(spark):
    codes = spark.createDataFrame([("x", "i", "CPT", "7"), ("x", "i", "CDM", "9"), ("x", "i", "RC", "7"), ("x", "j", "CPT", "8"), (None, "i", "CPT", "7"), ("x", None, "CPT", "7"), ("x", "k", None, "7"), ("x", "l", "CPT", None)],
                                  "extraction_id string, item_id string, code_type string, code string")
    wanted = spark.createDataFrame([("s", "7", "outpatient")], "service_id string, code string, setting_expected string")
    found = lines.matched_items(codes, wanted)
    assert [(r["item_id"], r["code_type"], r["other_codes"]) for r in found.collect()] == [("i", "CPT", ["CDM 9", "RC 7"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("item_id#" in line and ("LogicalRDD" in line or "LocalRelation" in line) for line in plan.splitlines()) == 1


def test_a_copy_is_cut_by_lists_written_once(spark):
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    whole = {name: table([(1,)], "x int") for name in export.WHOLE}
    of = {name: table([("e1", 1), ("e1", 1), ("e2", 2), (None, 3)], "extraction_id string, n int") for name in ("items", "item_codes", "charges")}
    given = {**whole, **of, "hospital_files": table([("h1", "u1"), ("h1", "u1"), ("h2", "u2"), (None, "u3"), ("h1", None)], "ccn string, mrf_url string"),
             "fetches": table([("u1", "c1"), ("u1", None), ("u2", "c2"), (None, "c3")], "url string, checksum string"),
             "files": table([("c1",), ("c2",), (None,)], "checksum string"), "extractions": table([("c1", "e1"), ("c2", "e2"), (None, "e3")], "checksum string, extraction_id string")}
    out = export.subset(given, table([("h1",), ("h1",), (None,)], "ccn string"))
    rows = {name: df.count() for name, df in out.items() if name not in whole}
    assert rows == {"hospital_files": 3, "fetches": 2, "files": 1, "extractions": 1, "items": 2, "item_codes": 2, "charges": 2}
    assert "mrf_url" not in out["charges"]._jdf.queryExecution().optimizedPlan().toString()


def test_code_lists_do_not_look_through_the_rows_first(spark):
    rows = spark.createDataFrame([("x", "i"), ("x", "i"), ("x", "j"), (None, "i")], "extraction_id string, item_id string")
    codes = spark.createDataFrame([("x", "i", "9"), ("x", "i", "10"), ("y", "i", "3"), (None, "i", "4")], "extraction_id string, item_id string, code string")
    found = audit.with_code_list(rows, codes)
    assert sorted((r["item_id"], r["code_values"]) for r in found.collect() if r["code_values"]) == [("i", ["10", "9"])] * 2 and found.count() == 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("LogicalRDD" in line or "LocalRelation" in line for line in plan.splitlines()) == 2


def test_lines_are_dealt_without_their_text(spark, monkeypatch):
    given = spark.createDataFrame([(1, "outpatient", "CPT", "7", ["a"], "d", None, "facility", None, None, None, None, None, f"row {n}", None, False) for n in range(30)], _LINE)
    dealt, kept = positions.dealt, []
    monkeypatch.setattr(positions, "dealt", lambda *args: kept.append(dealt(*args)) or kept[0])
    pages = prices.line_pages(given, ["k"], page_bytes=900).orderBy("page").collect()
    assert sum(p["n"] for p in pages) == 30 and len(pages) > 3 and all('"explained"' in p["lines"] for p in pages)
    widest = max(sum(len(str(v)) for v in r) for r in kept[0].collect())
    assert widest < min(len(p["lines"]) // p["n"] for p in pages) / 2


def test_shuffle_files_go_with_their_job(spark, tmp_path):
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}
    spark.range(1_000).write.parquet(str(tmp_path / "events.parquet"))
    (events,) = views.load(spark, str(tmp_path), "events")
    before = files()
    materialise(events.repartition(4, "id"), "test-tidy")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
