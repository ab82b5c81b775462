"""Audits, exports, reviews and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.operators.running import running_sum
from clearcharge.plans import audit, export, review
from clearcharge.registry import duck, views
from clearcharge.registry.core import register
from clearcharge.registry.reg_charges import summaries
from clearcharge.registry.reg_catalog import services
from clearcharge.session import materialise, new_work_path
from clearcharge.sources import store
from clearcharge.streaming import runs

SAMPLE = 25


# Which rows are drawn depends on the hash; how many, and that each belongs to its extraction, does not.
@register("T5_sample_charges", f"{views.with_views('d_charges')} SELECT extraction_id, least(count(*), {SAMPLE}) AS sampled FROM (SELECT DISTINCT * FROM d_charges) GROUP BY extraction_id")
def sampled(spark, folder):
    (charges,) = views.load(spark, folder, "d_charges")
    drawn = audit.sample_charges(charges.distinct(), SAMPLE, 7)
    again = audit.sample_charges(charges.distinct(), SAMPLE, 7).select("extraction_id", "charge_id")
    return drawn.join(again.distinct(), ["extraction_id", "charge_id"], "left_semi").groupBy("extraction_id").agg(F.count("*").alias("sampled"))


# The driver's line items repeat line numbers: each repeat gets a reference of its own.
_UNIQUE = """one AS (SELECT extraction_id, source_ref || CASE WHEN nth = 1 THEN '' ELSE '.' || CAST(nth AS STRING) END AS source_ref, charge_id, item_id, setting, billing_class, modifiers, gross, discounted_cash, minimum, maximum
    FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id, source_ref ORDER BY charge_id, item_id, gross, minimum, maximum, discounted_cash) AS nth FROM d_charges) AS n)"""
_REREAD = """SELECT c.extraction_id, c.source_ref || CASE WHEN c.item_id LIKE '%7' THEN 'x' ELSE '' END AS source_ref, c.item_id, CASE WHEN c.item_id LIKE '%5' THEN c.gross + 1 ELSE c.gross END AS gross, c.discounted_cash, c.minimum, c.maximum, c.setting, c.modifiers
    FROM one c"""


@register("J14_Q2_A12_fidelity", f"""{views.with_views('d_charges')}, {_UNIQUE}
    SELECT extraction_id, count(*) AS sampled, count(*) FILTER (WHERE NOT item_id LIKE '%7') AS checked, count(*) FILTER (WHERE NOT item_id LIKE '%7' AND (NOT item_id LIKE '%5' OR gross IS NULL)) AS matched, count(*) FILTER (WHERE item_id LIKE '%7') AS missing FROM one GROUP BY extraction_id""")
def fidelity(spark, folder):
    charges, codes = views.load(spark, folder, "d_charges", "d_item_codes")
    charges.createOrReplaceTempView("charges_given")
    stored = materialise(spark.sql("WITH " + _UNIQUE.replace("FROM d_charges", "FROM charges_given") + " SELECT * FROM one").drop("charge_id", "billing_class"), "charges-unique")  # read twice
    stored.createOrReplaceTempView("one")
    reread = spark.sql(_REREAD)
    verified = audit.verify_sample(audit.with_code_list(stored, codes), audit.with_code_list(reread, codes))
    return audit.fidelity_per_file(verified)


@register("A12_fidelity_totals", f"""{views.with_views('d_charges')}, {_UNIQUE} SELECT count(DISTINCT extraction_id) AS files, count(*) AS sampled,
    count(*) FILTER (WHERE NOT item_id LIKE '%7' AND (NOT item_id LIKE '%5' OR gross IS NULL)) AS matched, count(*) FILTER (WHERE item_id LIKE '%7') AS missing FROM one""")
def totals(spark, folder):
    return audit.fidelity_totals(fidelity(spark, folder))


@register("A10_spend_per_day", f"{views.with_views('d_spend')} SELECT CAST(day AS VARCHAR) AS day, usd, calls, CAST(sum(usd) OVER (ORDER BY day) AS BIGINT) AS so_far FROM (SELECT CAST(called_at AS DATE) AS day, CAST(sum(cents) AS BIGINT) AS usd, count(*) AS calls FROM d_spend GROUP BY 1)")
def spend(spark, folder):
    (given,) = views.load(spark, folder, "d_spend")
    return audit.spend_per_day(given.withColumnRenamed("cents", "usd")).withColumn("day", F.col("day").cast("string"))


@register("R10_spend_guard", f"{views.with_views('d_spend')} SELECT call_id, CAST(spent AS BIGINT) AS spent, spent < 100000 AS allowed FROM (SELECT call_id, coalesce(sum(cents) OVER (PARTITION BY CAST(called_at AS DATE) ORDER BY called_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM d_spend)")
def guard(spark, folder):
    (given,) = views.load(spark, folder, "d_spend")
    return runs.spend_guard(given.withColumnRenamed("cents", "usd"), 100000).select("call_id", F.col("spent").cast("bigint").alias("spent"), "allowed")


@register("W7_running_count", f"{views.with_views('d_index_lines')} SELECT index_id, line_no, CAST(sum(CASE WHEN line ILIKE '%location-name%' THEN 1 ELSE 0 END) OVER (PARTITION BY index_id ORDER BY line_no) AS BIGINT) AS entry_no FROM d_index_lines")
def running(spark, folder):
    (given,) = views.load(spark, folder, "d_index_lines")
    flag = F.when(F.lower("line").contains("location-name"), 1).otherwise(0)
    return running_sum(given, "index_id", "line_no", flag, "entry_no", chunk=97).select("index_id", "line_no", "entry_no")


def tables(spark, folder):
    names = {"hospital_files": "d_hospital_files", "fetches": "d_fetches", "files": "d_files", "extractions": "d_extractions", "items": "d_items", "item_codes": "d_item_codes", "charges": "d_charges", "zcta": "d_zcta", "hospitals": "d_raw_hospitals"}
    found = dict(zip(names, views.load(spark, folder, *names.values())))
    region, spend = views.load(spark, folder, "region", "d_spend")
    return {**found, "sources": region, "stored_answers": spend}


_KEPT = f"""{views.with_views('d_hospital_files', 'd_fetches', 'd_files', 'd_extractions', 'd_items', 'd_item_codes', 'd_charges', 'd_zcta', 'd_raw_hospitals', 'd_spend')},
kept AS (SELECT 'H' || s_suppkey AS ccn FROM supplier WHERE s_nationkey % 3 = 0), hf AS (SELECT * FROM d_hospital_files WHERE ccn IN (SELECT ccn FROM kept)), fe AS (SELECT * FROM d_fetches WHERE url IN (SELECT mrf_url FROM hf)),
fi AS (SELECT * FROM d_files WHERE checksum IN (SELECT checksum FROM fe WHERE checksum IS NOT NULL)), ex AS (SELECT * FROM d_extractions WHERE checksum IN (SELECT checksum FROM fe WHERE checksum IS NOT NULL))"""


def kept(spark, folder):
    (supplier,) = views.load(spark, folder, "supplier")
    return supplier.filter("s_nationkey % 3 = 0").select(F.concat(F.lit("H"), F.col("s_suppkey").cast("string")).alias("ccn"))


@register("K5_J11_A11_export_subset", _KEPT + "".join(f"{' UNION ALL' if i else ''} SELECT '{name}' AS \"table\", count(*) AS rows FROM {source}" for i, (name, source) in enumerate([
    ("hospital_files", "hf"), ("fetches", "fe"), ("files", "fi"), ("extractions", "ex"), ("items", "d_items WHERE extraction_id IN (SELECT extraction_id FROM ex)"), ("item_codes", "d_item_codes WHERE extraction_id IN (SELECT extraction_id FROM ex)"),
    ("charges", "d_charges WHERE extraction_id IN (SELECT extraction_id FROM ex)"), ("zcta", "d_zcta"), ("hospitals", "d_raw_hospitals"), ("sources", "region"), ("stored_answers", "d_spend")])))
def export_counts(spark, folder):
    return export.counts(export.subset(tables(spark, folder), kept(spark, folder)))


@register("K6_verify_export", _KEPT + " SELECT (SELECT count(*) FROM d_raw_hospitals) AS hospitals, (SELECT count(*) FROM hf WHERE ok) AS located, (SELECT count(*) FROM ex WHERE ok) AS extractions, (SELECT count(*) FROM d_charges WHERE extraction_id IN (SELECT extraction_id FROM ex)) AS charges")
def verified(spark, folder):
    out = new_work_path(spark, "export")
    subset = export.subset(tables(spark, folder), kept(spark, folder))
    for name in ("hospitals", "hospital_files", "extractions", "charges"):
        store.overwrite(subset[name], out, name)
    found = {name: store.read_table(spark, out, name) for name in ("hospitals", "hospital_files", "extractions", "charges")}
    counted = export.counts({"hospitals": found["hospitals"], "located": found["hospital_files"].filter("ok"), "extractions": found["extractions"].filter("ok"), "charges": found["charges"]})
    return counted.groupBy().pivot("table", ["hospitals", "located", "extractions", "charges"]).agg(F.first("rows"))


# --- review sheets ----------------------------------------------------------------------
_SHEET = """SELECT 'svc-' || CAST(l_partkey % 200 AS STRING) AS service_id, 'X' || CAST(l_suppkey AS STRING) AS hospital, l_orderkey * 8 + l_linenumber AS row_no, 'row ' || CAST(l_orderkey * 8 + l_linenumber AS STRING) AS ref,
    CASE l_partkey % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'needs qualifier' ELSE '' END AS alias_means_this_service, CASE WHEN l_suppkey % 2 = 0 THEN 'YES' ELSE '' END AS headline_is_this_service,
    CASE WHEN l_linenumber = 1 THEN 'facility' ELSE '' END AS billing_class_if_known, CASE WHEN l_partkey % 7 = 3 THEN 'note ' || CAST(l_orderkey AS STRING) ELSE '' END AS note,
    CASE WHEN l_orderkey % 3 = 0 OR l_partkey % 200 % 11 = 3 THEN '' ELSE 'R' || CAST(l_suppkey % 5 AS STRING) END AS reviewer, '2026-01-0' || CAST(l_linenumber AS STRING) AS date, 'Item' AS headline_description
    FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem) AS l WHERE nth = 1"""
_DECIDED = f"""sheet AS ({_SHEET}), answered AS (SELECT * FROM sheet WHERE trim(alias_means_this_service) <> '' OR trim(headline_is_this_service) <> '' OR trim(note) <> ''),
decided AS (SELECT service_id, bool_or(lower(trim(alias_means_this_service)) = 'yes') AS confirmed, coalesce(min_by(reviewer, row_no) FILTER (WHERE reviewer <> ''), '') AS reviewer, min_by(date, row_no) AS date, count(*) AS rows,
    string_agg(hospital || ': ' || CASE WHEN alias_means_this_service <> '' THEN alias_means_this_service ELSE note END, '; ' ORDER BY row_no) AS reasons FROM answered GROUP BY service_id)"""


def decisions(spark, folder):
    views.load(spark, folder, "d_charges")
    return review.review_decisions(spark.sql(_SHEET))


@register("K12_D17_S17_review_decisions", f"WITH {_DECIDED} SELECT service_id, confirmed, reviewer, date, rows, md5(reasons) AS reasons FROM decided")
def decided(spark, folder):
    return decisions(spark, folder).select("service_id", "confirmed", "reviewer", "date", F.size("hospitals").cast("bigint").alias("rows"), F.md5("reasons").alias("reasons"))


@register("D17_apply_decisions", f"{views.with_views('d_services')}, {_DECIDED} SELECT s.id, coalesce(confirmed, reviewed) AS reviewed, md5(CASE WHEN confirmed = false THEN 'Review: alias not confirmed: ' || reasons ELSE '' END) AS notes, coalesce(confirmed, false) AS has_evidence FROM d_services s LEFT JOIN decided d ON d.service_id = s.id")
def applied(spark, folder):
    out = review.apply_decisions(services(spark, folder).withColumn("notes", F.lit("")), decisions(spark, folder))
    return out.select("id", "reviewed", F.md5(F.regexp_replace("notes", "^ ", "")).alias("notes"), F.col("evidence").isNotNull().alias("has_evidence"))


@register("Q4_unfounded_reviews", f"{views.with_views('d_services')}, {_DECIDED} SELECT s.id FROM d_services s LEFT JOIN decided d ON d.service_id = s.id AND d.confirmed WHERE s.reviewed AND (d.service_id IS NULL OR d.reviewer = '' OR d.date = '')")
def unfounded(spark, folder):
    return review.unfounded_reviews(services(spark, folder), review.review_rows(decisions(spark, folder))).select("id")


@register("K11_J18_review_sheet", f"""{views.with_views('d_services')}, sheet AS ({_SHEET}), old AS (SELECT service_id, hospital, min(note) AS note FROM sheet GROUP BY ALL)
    SELECT 'svc-' || l_partkey % 200 AS service_id, 'X' || l_suppkey AS hospital, any_value(coalesce(o.note, '')) AS note, '' AS reviewer FROM lineitem LEFT JOIN old o ON o.service_id = 'svc-' || l_partkey % 200 AND o.hospital = 'X' || l_suppkey GROUP BY 1, 2""")
def sheet(spark, folder):
    found = summaries_all(spark, folder)
    spark.sql(_SHEET).createOrReplaceTempView("sheet_given")
    blank = ", ".join(f"'' AS {c}" for c in ("alias_means_this_service", "headline_is_this_service", "billing_class_if_known", "reviewer", "date"))
    previous = spark.sql(f"SELECT service_id AS query, hospital, min(note) AS note, {blank} FROM sheet_given GROUP BY service_id, hospital")
    return review.review_sheet(found, previous).select("service_id", "hospital", "note", "reviewer")


def summaries_all(spark, folder):
    """One result per (service, hospital) that shares an item, with or without a verdict."""
    (lineitem,) = views.load(spark, folder, "lineitem")
    pairs = lineitem.select(F.concat(F.lit("svc-"), (F.col("l_partkey") % 200).cast("string")).alias("service_id"), F.concat(F.lit("X"), F.col("l_suppkey").cast("string")).alias("extraction_id")).distinct()
    joined = pairs.join(summaries(spark, folder), ["service_id", "extraction_id"], "left")
    return joined.select(F.col("service_id").alias("query"), "service_id", F.lit("s").alias("service"), F.lit("c").alias("codes"), F.col("extraction_id").alias("hospital"), F.col("extraction_id").alias("ccn"), "verdict", "line_count", "headline",
                         F.lit("").alias("file_date"), F.lit("").alias("url"))


@register("T6_results_ok_first", f"{views.with_views('d_raw_hospitals', 'd_hospital_files')}, one AS (SELECT h.ccn, h.name, coalesce(bool_or(f.ok), false) AS ok FROM d_raw_hospitals h LEFT JOIN d_hospital_files f ON f.ccn = h.ccn GROUP BY ALL)\n    SELECT ccn, ok, row_number() OVER (ORDER BY NOT ok, name, ccn) AS place FROM one")
def listed(spark, folder):
    hospitals, files = views.load(spark, folder, "d_raw_hospitals", "d_hospital_files")
    found = hospitals.select("ccn", "name").join(files.groupBy("ccn").agg(F.bool_or("ok").alias("ok")), "ccn", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return audit.listed_results(found).select("ccn", "ok", "place")
