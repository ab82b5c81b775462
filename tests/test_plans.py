import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clearcharge import schemas
from clearcharge.plans import audit, discovery, export, reference_build
from clearcharge.session import work_folder
from clearcharge.sources import charge_csv, pages, reference_data, store
from tests.conftest import rows

COLUMNS = "description,code|1,code|1|type,setting,billing_class,standard_charge|gross,standard_charge|discounted_cash\n"
HEAD = "hospital_name,version\nH,3\n"


def hospital(ccn, name, address="1 MAIN", city="DUNMERE", zip_code="40988"):
    return (ccn, name, address, city, "TX", zip_code)


def test_discovery_chain(spark):
    hospitals = spark.createDataFrame([
        hospital("1", "FAIRLEA HOSPITAL EAST"), hospital("2", "BRACKWATER MEMORIAL HOSPITAL"), hospital("3", "NOWHERE HOSPITAL"), hospital("4", "SIBLING HOSPITAL"),
        hospital("5", "CORVANE ABBEY", "640 QUAYSIDE BLVD", "MARLOW", "40871"), hospital("6", "LOST HOSPITAL"), hospital("7", "LINDEN VALLEY")],
        "ccn string, name string, address string, city string, state string, zip string")
    index = "location-name: Fairlea Hospital East\nmrf-url: https://f.org/n_standardcharges.csv\n"
    seton = "".join(f"location-name: Corvane Abbey {n} (Corvane Abbey)\nmrf-url: https://f.org/120045518-{npi}_a_standardcharges.csv\n" for n, npi in (("Upland", "1506318272"), ("Lowland", "1927483069")))
    harris = "".join(f"location-name: Linden Valley {n} Hospital\nmrf-url: https://f.org/{n}.csv\n" for n in ("Oakmere", "Petrel"))
    fetch = lambda domain, no, status, body=None, error=None: (domain, no, ("www." if no else "") + domain, status, error, body, "text/html", f"https://{domain}/cms-hpt.txt")
    fetches = spark.createDataFrame([
        fetch("fairleaeast.com", 0, None, error="ConnectError"), fetch("fairleaeast.com", 1, 200, index), fetch("brackwatermemorial.com", 0, 404), fetch("sibling.com", 0, 404),
        fetch("care.sibling.com", 0, 200, "location-name: Sibling Hospital\nmrf-url: https://f.org/s.json\n"), fetch("corvaneabbey.org", 0, 200, seton), fetch("nowhere.com", 0, 403),
        fetch("lindenvalley.org", 0, 200, harris), fetch("lost.org", 0, 200, "location-name: Lost Hospital\nmrf-url: https://f.org/gone.csv\n")],
        "domain string, try_no int, host string, status int, error string, body string, content_type string, final_url string")
    landed = spark.createDataFrame([
        (1, "https://brackwatermemorial.com/pricing", '<a href="/f/2031_Shoppable-standardcharges.csv">s</a><a HREF=\'/f/220719033_B_StandardCharges.csv\'>m</a>'),
        (2, "https://www.sibling.com/", '<a href="https://care.sibling.com/price-transparency">p</a>')], "page_id bigint, url string, html string")
    probe = lambda url, status: (url, status, None, "text/csv", None, "a,b", 10, None, None)
    probes = spark.createDataFrame([probe(u, 200) for u in (
        "https://f.org/n_standardcharges.csv", "https://brackwatermemorial.com/f/220719033_B_StandardCharges.csv", "https://f.org/s.json", "https://f.org/120045518-1506318272_a_standardcharges.csv", "https://f.org/Oakmere.csv")]
        + [probe("https://f.org/gone.csv", 404)], "url string, status int, error string, content_type string, disposition string, head string, size_bytes bigint, last_modified string, etag string")
    registry = spark.createDataFrame([("1506318272", "640 QUAYSIDE", "MARLOW", "40871"), ("1927483069", "17 GRANITE", "MARLOW", "40872")], "npi string, address string, city string, zip string")
    answers = spark.createDataFrame([("7", 1)], "ccn string, entry_no bigint")
    got = {r["ccn"]: r for r in discovery.locate(hospitals, fetches, pages.extract_links(landed), registry, probes, entry_answers=answers).collect()}
    assert {c: (r["ok"], r["method"]) for c, r in got.items()} == {
        "1": (True, "cms-hpt"), "2": (True, "site-page"), "3": (False, "failed"), "4": (True, "site-link+cms-hpt"), "5": (True, "cms-hpt+npi"), "6": (False, "cms-hpt"), "7": (True, "cms-hpt+tie-break")}
    assert got["2"]["mrf_url"].endswith("220719033_B_StandardCharges.csv") and got["3"]["reason"].startswith("no cms-hpt.txt or linked file located") and "403 blocked" in got["3"]["reason"]
    assert got["6"]["reason"] == "file URL failed: HTTP 404" and got["4"]["shape"] == "json" and got["5"]["location_name"].startswith("Corvane Abbey Upland")


def test_discovery_follows_siblings_of_siblings_and_says_its_steps(spark):
    hospitals = spark.createDataFrame([hospital("1", "ORSELL BAY HOSPITAL"), hospital("2", "TARN GATE HOSPITAL"), hospital("3", "WINDLE HOSPITAL"), hospital("4", "PELLOW HOSPITAL")], "ccn string, name string, address string, city string, state string, zip string")
    index = "location-name: Orsell Bay Hospital\nsource-page-url: https://x.org/p\nmrf-url: https://f.org/o.csv\n"
    fetch = lambda domain, status, body=None, error=None: (domain, 0, domain, status, error, body, "text/html", f"https://{domain}/cms-hpt.txt")
    fetches = spark.createDataFrame([
        fetch("orsellbay.com", 404), fetch("care.orsellbay.com", 404), fetch("prices.orsellbay.com", 200, index), fetch("tarngate.com", None, error="ConnectError"),
        fetch("www.corvid.org", 404), fetch("care.corvid.org", 200, index.replace("Orsell Bay", "Tarn Gate")), fetch("windle.com", 404), fetch("pellow.com", 404), fetch("care.pellow.com", 404)],
        "domain string, try_no int, host string, status int, error string, body string, content_type string, final_url string")
    link = lambda url: f'<a href="{url}">price transparency</a>'
    landed = spark.createDataFrame([
        (1, "https://orsellbay.com/", link("https://care.orsellbay.com/price-transparency")), (2, "https://care.orsellbay.com/", link("https://orsellbay.com/price-transparency") + link("https://prices.orsellbay.com/price-transparency")),
        (3, "https://www.corvid.org/", link("https://care.corvid.org/price-transparency")), (4, "https://windle.com/pricing", "".join(link(f"/f/{n}_standardcharges.csv") for n in ("North", "South"))),
        (5, "https://pellow.com/", link("https://care.pellow.com/price-transparency")), (6, "https://care.pellow.com/", link("https://pellow.com/price-transparency"))], "page_id bigint, url string, html string")
    probes = spark.createDataFrame([(u, 200, None, "text/csv", None, "a,b", 2_500_000, "Mon", None) for u in ("https://f.org/o.csv", "https://windle.com/f/South_standardcharges.csv")],
                                   "url string, status int, error string, content_type string, disposition string, head string, size_bytes bigint, last_modified string, etag string")
    registry = spark.createDataFrame([], "npi string, address string, city string, zip string")
    web_answers = spark.createDataFrame([("2", "www.corvid.org", "sure")], "ccn string, host string, why string")
    site_answers = spark.createDataFrame([("3", "windle.com", 2, "the only one in town")], "ccn string, index_id string, entry_no bigint, why string")
    got = {r["ccn"]: r for r in discovery.locate(hospitals, fetches, pages.extract_links(landed), registry, probes, web_answers, None, site_answers).collect()}
    assert {c: (r["ok"], r["method"], r["domain"]) for c, r in got.items()} == {
        "1": (True, "site-link+cms-hpt", "prices.orsellbay.com"), "2": (True, "web-search+site-link+cms-hpt", "care.corvid.org"), "3": (True, "site-page", "windle.com"), "4": (False, "failed", None)}
    assert got["1"]["steps"] == [
        "a pricing link points at care.orsellbay.com, trying there", "a pricing link points at prices.orsellbay.com, trying there", "cms-hpt.txt found at https://prices.orsellbay.com/cms-hpt.txt",
        "1 entries, matched Orsell Bay Hospital (100)", "price file csv, 2 MB, modified Mon"]
    assert got["1"]["source_page_url"] == "https://x.org/p" and got["3"]["source_page_url"] == got["3"]["index_url"] == "https://windle.com/pricing"
    assert got["2"]["steps"][:4] == ["cms-hpt.txt missing on guessed domains, searching the web for the site", "web search says www.corvid.org (sure)", "a pricing link points at care.corvid.org, trying there", "cms-hpt.txt found at https://care.corvid.org/cms-hpt.txt"]
    assert got["3"]["mrf_url"].endswith("South_standardcharges.csv") and got["3"]["steps"] == [
        "no cms-hpt.txt at windle.com, but 2 standard-charges link(s) on https://windle.com/pricing", "2 files linked, ambiguous: North_standardcharges.csv; South_standardcharges.csv",
        "tie-break picked South_standardcharges.csv (the only one in town)", "price file csv, 2 MB, modified Mon"]
    assert got["4"]["steps"] == ["a pricing link points at care.pellow.com, trying there", "no machine-readable index located — skipped"] and got["4"]["reason"].endswith("care.pellow.com: 404")


def test_stored_answers_outside_the_candidates_are_refused(spark):
    asked = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["x"])], "key string, candidates array<string>")
    told = spark.createDataFrame([("a", "y"), ("b", "z")], "key string, choice string")
    got = rows(discovery.stored_answer(asked, told, F.col("candidates")), "key", "known")
    assert got == [("a", True), ("b", False), ("c", False)]


def test_extractions_are_replaced_whole_and_reasons_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good, bad, root = tmp_path / "in" / "a.csv", tmp_path / "in" / "b.csv", str(tmp_path / "store")
    bad.write_text("x\n")

    def run(text):
        good.write_text(HEAD + COLUMNS + text)
        headers, charges = charge_csv.read_mrf_csv(spark, str(tmp_path / "in"))
        sums = headers.select("file", F.when(F.col("ok"), "c" * 64).otherwise("d" * 64).alias("checksum"), F.lit(5).cast("bigint").alias("size_bytes"))
        store.write_extractions(spark, root, headers, charges, sums, dt.datetime(2026, 1, 1))
        return {r["ok"]: r for r in store.read_table(spark, root, "extractions").collect()}

    first = run("Hearing test,92557,CPT,outpatient,,10,5\nhearing TEST ,92557,CPT,inpatient,,11,\nCast,1,RC,,,1,\n")
    assert (first[True]["charges"], first[True]["items"]) == (3, 2) and first[False]["reason"] == "off-template: fewer than 3 rows"
    assert rows(store.read_table(spark, root, "items"), "description") == [("Cast",), ("Hearing test",)]
    second = run("Hearing test,92557,CPT,outpatient,,10,5\n")
    assert second[True]["charges"] == 1 and store.read_table(spark, root, "charges").count() == 1 and store.read_table(spark, root, "extractions").count() == 2


def test_a_write_leaves_no_work_table_of_its_charges(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + COLUMNS + "Hearing test,92557,CPT,outpatient,,10,5\n")
    headers, charges = charge_csv.read_mrf_csv(spark, str(tmp_path / "a.csv"))
    work = Path(work_folder(spark).removeprefix("file:"), "clearcharge")
    before = set(work.iterdir())
    store.write_extractions(spark, str(tmp_path / "store"), headers, charges, headers.select("file", F.lit("c" * 64).alias("checksum"), F.lit(5).cast("bigint").alias("size_bytes")), dt.datetime(2026, 1, 1))
    assert not [p for p in set(work.iterdir()) - before if p.name.startswith(("extractions-charges", "items-first"))]
    assert store.read_table(spark, str(tmp_path / "store"), "charges").count() == store.read_table(spark, str(tmp_path / "store"), "items").count() == 1


@pytest.mark.parametrize("broken", ["item_codes", "charges", "files", "extractions", "commit"])
def test_a_write_that_fails_on_the_way_leaves_the_old_extraction_whole(spark, tmp_path, monkeypatch, broken):
    path, root = tmp_path / "a.csv", str(tmp_path / "store")

    def run(text):
        path.write_text(HEAD + COLUMNS + text)
        headers, charges = charge_csv.read_mrf_csv(spark, str(path))
        store.write_extractions(spark, root, headers, charges, headers.select("file", F.lit("c" * 64).alias("checksum"), F.lit(5).cast("bigint").alias("size_bytes")), dt.datetime(2026, 1, 1))

    def seen():
        return {name: sorted(map(str, store.read_table(spark, root, name).drop("first_seen").collect())) for name in ("items", "item_codes", "charges", "files", "extractions")}

    run("Hearing test,92557,CPT,outpatient,,10,5\nCast,1,RC,,,1,\n")
    old, part, commit = seen(), store._write_part, store._commit

    def failing(frame, root, name, write):
        if name == broken:
            raise OSError("lost")
        part(frame, root, name, write)

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(store, "_write_part", failing)
    if broken == "commit":
        monkeypatch.setattr(store, "_commit", lost)
    with pytest.raises(OSError, match="lost"):
        run("Cast,2,RC,,,7,\n")
    assert seen() == old
    monkeypatch.setattr(store, "_write_part", part)
    monkeypatch.setattr(store, "_commit", commit)
    run("Cast,2,RC,,,7,\n")
    new = seen()
    assert len(new["charges"]) == len(new["items"]) == len(new["extractions"]) == 1 and "7.0" in new["charges"][0]
    left = [p for p in (tmp_path / "store" / "charges.writes").glob("write=*/extraction_id=*")]
    assert len(left) <= 2  # the current one, and what the write that failed has left


def reference(spark, tmp_path):
    folder = tmp_path / "ref"
    folder.mkdir()
    (folder / "h.csv").write_text("Facility ID,Facility Name,Address,City/Town,State,ZIP Code,Phone,Hospital Type,Hospital Ownership\n"
                                  '40512F,FEDERAL CENTER,1 A,DUNMERE,TX,40988,x,Acute Care - Veterans Administration,V\n1,"BRINDLE, LP",2 B,DUNMERE,TX,40977,x,Acute Care Hospitals,P\n2,TOLLAND,3 C,DUNMERE,TX,40988,x,Acute Care Hospitals,P\n3,BOX,PO,X,TX,501,x,Childrens,P\n')
    (folder / "z.txt").write_text("GEOID\tALAND\tINTPTLAT\tINTPTLONG     \n40988\t5100200\t44.300000\t7.100000   \n40977\t8200400\t44.350000\t7.250000\n")
    (folder / "c.csv").write_text("ccn,lat,lon,match\n40512F,44.3010,7.1020,Exact\n1,44.350000,7.750000,Non_Exact\n2,44.302000,7.104000,Non_Exact\n")
    return (reference_data.read_hospitals(spark, str(folder / "h.csv")), reference_data.read_zcta(spark, str(folder / "z.txt")), reference_data.read_coords(spark, str(folder / "c.csv")))


def test_build_publishes_only_when_sound_and_carries_rows_over(spark, tmp_path):
    raw, zcta, coords = reference(spark, tmp_path)
    root = str(tmp_path / "db")
    sources = spark.createDataFrame([("CMS Hospital General Information", None), ("other", 7)], "name string, rows bigint")
    limits = dict(min_zips=1, min_hospitals=1, max_unresolved_share=0.5)
    out = reference_build.build(spark, root, "v1", raw, zcta, coords, sources, True, dt.datetime(2026, 1, 1), **limits)
    assert (out["address"], out["zip"], out["unresolved"], out["rejected_geocodes"]) == (2, 1, 1, 1)
    brindle = store.read_table(spark, f"{root}/v1", "hospitals").filter("ccn = '1'").first()
    assert brindle["location_note"] == "Non_Exact geocode rejected: 40 km from the 40977 centroid" and brindle["geocode_match"] is None
    store.append(spark.createDataFrame([("9", True)], "ccn string, ok boolean"), f"{root}/v1", "hospital_files")
    with pytest.raises(reference_build.BuildFailed, match="implausible"):
        reference_build.build(spark, root, "v2", raw, zcta, coords, sources, True, dt.datetime(2026, 1, 2), min_zips=9)
    assert reference_build.current(spark, root) == "v1"
    out = reference_build.build(spark, root, "v3", raw, zcta, coords, sources, True, dt.datetime(2026, 1, 3), previous="v1", **limits)
    assert reference_build.current(spark, root) == "v3" and store.read_table(spark, f"{root}/v3", "hospital_files").count() == 1
    assert set(out["carried_tables"]) == {"sources", "hospital_files"} and store.read_table(spark, f"{root}/v3", "sources").count() == 4
    kept = export.export_subset(spark, f"{root}/v3", str(tmp_path / "out"), spark.createDataFrame([("40988",)], "zip string"), 1)
    assert kept["hospitals"] == 4 and kept["hospitals_kept"] == 1 and export.verify(spark, str(tmp_path / "out"))["hospitals"] == 4


def test_recorded_run_joined_by_name_with_defaults(spark, tmp_path):
    line = {"code_type": "CPT", "code": "1", "cash": 5.0}
    doc = {"recorded_on": "2026-01-01", "zips": {"40988": [{"ccn": "1", "name": "A", "distance_km": 1.5, "approximate": False, "mrf_url": "u"}, {"ccn": "2", "name": "B", "distance_km": 2.5}]},
           "services": {"hearing": {"service": "Hearing test", "codes": "CPT 1", "hospitals": [{"name": "A", "verdict": "comparable", "line_count": 3, "headline": line, "lines": [line]}]}}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    zips, services = reference_data.read_run_recording(spark, str(tmp_path / "r.json"))
    got = rows(reference_data.recorded_results(zips, services).withColumn("url", F.coalesce("url", F.lit("-"))), "ccn", "verdict", "line_count", "url")
    assert got == [("1", "comparable", 3, "u"), ("2", "not scanned", 0, "-")]


def test_old_tables_read_in_the_current_shape(spark):
    got = store.columns_present(spark.createDataFrame([("x",)], "name string"), schemas.SOURCES)
    assert got.columns == schemas.SOURCES.names and got.first()["sha256"] is None


def test_a_report_computes_what_it_is_given_once(spark, tmp_path):
    seen = {name: spark.sparkContext.accumulator(0) for name in ("discoveries", "results")}

    def counted(df, name, column):
        def look(value):
            seen[name].add(1)
            return value

        return df.withColumn(column, F.udf(look, "string")(column))

    looked = spark.createDataFrame([("1", "A", True, "cms-hpt", ""), ("2", "B", False, None, "timeout"), ("3", "C", None, None, None)], "ccn string, name string, ok boolean, method string, reason string")
    results = spark.createDataFrame([("comparable",), ("comparable",), ("not found",), (None,)], "verdict string")
    per_file = spark.createDataFrame([("X1", 2, 2, 2, 0)], "extraction_id string, sampled bigint, checked bigint, matched bigint, missing bigint")
    path = str(tmp_path / "report")
    audit.report(counted(looked, "discoveries", "name"), per_file, counted(results, "results", "verdict"), looked.select("ccn").limit(0), path)
    said = audit.read_report(spark, path)
    assert sorted((r["verdict"] or "", r["n"]) for r in said["comparison"].collect()) == [("", 1), ("comparable", 2), ("not found", 1)]
    assert rows(said["discovery"], "method", "n", "of") == [("cms-hpt", 1, 3)] and said["share"].first()["pairs"] == 4 and said["unresolved"].count() == 3
    assert {name: a.value for name, a in seen.items()} == {"discoveries": 3, "results": 4}


def test_hosts_that_serve_one_text_share_its_entries(spark):
    """Every host's own copy was parsed, written and matched before."""
    index = "".join(f"location-name: Orsell {n} Bay Hospital\nmrf-url: https://f.org/{n}.csv\n" for n in range(6))
    given = [(f"orsell{n}bay.com", 0, f"orsell{n}bay.com", 200, None, index if n else "<html>", "text/html", f"https://orsell{n}bay.com/cms-hpt.txt") for n in range(6)]
    fetches = spark.createDataFrame(given, "domain string, try_no int, host string, status int, error string, body string, content_type string, final_url string")
    links = pages.extract_links(spark.createDataFrame([], "page_id bigint, url string, html string"))
    hosts = discovery._Hosts(fetches, links)
    assert "body" not in hosts.status.columns and hosts.lines.count() == 13 and hosts.status.select("text_id").distinct().count() == 2
    # The same where the texts are kept apart already.
    apart = fetches.withColumn("text_id", F.md5("body"))
    kept = discovery._Hosts(apart.drop("body"), links, apart.select("text_id", "body"))
    shown = lambda h: rows(h.status, "domain", "state", "final_url", "reason")
    assert shown(kept) == shown(hosts) and [r[1] for r in shown(kept)] == ["html"] + ["ok"] * 5
    assert rows(kept.lines, "line_no", "line") == rows(hosts.lines, "line_no", "line")
