"""Discoveries, fetches and what has to be fetched again."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge import schemas
from clearcharge.operators import freshness, latest
from clearcharge.plans import audit
from clearcharge.registry import duck, views
from clearcharge.registry.core import register
from clearcharge.sources import store

NOW = f"TIMESTAMP '{views.AS_OF}'"
_AGE = lambda ts: f"(epoch_us({NOW}) - epoch_us({ts})) / 86400000000.0"

_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY discovered_at DESC) AS nth FROM d_hospital_files) WHERE nth = 1"
DISCOVERED = f"""{views.with_views('d_hospital_files')}, found AS (SELECT *, {_AGE('discovered_at')} > CASE WHEN ok THEN 30 ELSE 7 END AS stale FROM ({_LAST}) WHERE ok OR discovery_version = '2')"""


@register("W2_newest_per_key", f"{views.with_views('d_hospital_files')} SELECT ccn, CAST(discovered_at AS VARCHAR) AS discovered_at, ok, mrf_url FROM ({_LAST})")
def newest(spark, folder):
    (found,) = views.load(spark, folder, "d_hospital_files")
    return latest.newest(found, ["ccn"], F.col("discovered_at").desc()).select("ccn", F.date_format("discovered_at", "yyyy-MM-dd HH:mm:ss").alias("discovered_at"), "ok", "mrf_url")


@register("D12_F12_cached_discovery", f"{DISCOVERED} SELECT ccn, ok, stale, mrf_url FROM found")
def discovery(spark, folder):
    (found,) = views.load(spark, folder, "d_hospital_files")
    return latest.cached_discovery(found, F.expr(NOW), within_ttl=False).select("ccn", "ok", "stale", "mrf_url")


@register("F12_within_ttl", f"{DISCOVERED} SELECT ccn, ok FROM found WHERE NOT stale")
def within_ttl(spark, folder):
    (found,) = views.load(spark, folder, "d_hospital_files")
    return latest.cached_discovery(found, F.expr(NOW), within_ttl=True).select("ccn", "ok")


CURRENT = f"""current AS (SELECT * FROM (SELECT f.url, f.checksum, f.etag, f.last_modified, f.fetched_at, e.extraction_id, f.size_bytes, row_number() OVER (PARTITION BY f.url ORDER BY f.fetched_at DESC, e.extraction_id) AS nth
    FROM d_fetches f JOIN d_extractions e ON e.checksum = f.checksum AND e.ok AND e.parser_version = '3') WHERE nth = 1)"""


@register("J4_W3_latest_extraction", f"{views.with_views('d_fetches', 'd_extractions', 'd_files')}, {CURRENT} SELECT url, c.checksum, extraction_id, size_bytes, last_updated_on FROM current c LEFT JOIN d_files f ON f.checksum = c.checksum")
def latest_extraction(spark, folder):
    fetches, extractions, files = views.load(spark, folder, "d_fetches", "d_extractions", "d_files")
    return latest.latest_extraction(fetches, extractions, files).select("url", "checksum", "extraction_id", "size_bytes", "last_updated_on")


def matched(p: str) -> str:
    """(same, why) of a previous copy `p` against `h`."""
    return (f"CASE WHEN h.url IS NULL OR h.error IS NOT NULL THEN false WHEN h.etag <> '' AND {p}.etag <> '' THEN h.etag = {p}.etag ELSE coalesce(h.last_modified = {p}.last_modified, false) END AS same, "
            f"CASE WHEN h.url IS NULL THEN 'HEAD failed (?)' WHEN h.error IS NOT NULL THEN 'HEAD failed (' || h.error || ')' WHEN h.etag <> '' AND {p}.etag <> '' THEN CASE WHEN h.etag = {p}.etag THEN 'same ETag' ELSE 'ETag changed' END "
            f"WHEN h.last_modified = {p}.last_modified THEN 'same Last-Modified (' || h.last_modified || ')' WHEN h.etag IS NULL AND h.last_modified IS NULL THEN 'server sends no validators' ELSE 'validators changed' END AS why")


_FRESH = f"""{CURRENT}, said AS (SELECT c.url, c.fetched_at, c.extraction_id, {matched('c')} FROM current c LEFT JOIN d_heads h ON h.url = c.url),
fresh AS (SELECT url, fetched_at, extraction_id, CASE WHEN {_AGE('fetched_at')} > 30 THEN false ELSE same END AS fresh,
          CASE WHEN {_AGE('fetched_at')} > 30 THEN 'cached copy older than 30 days' WHEN same THEN why || ', fetched ' || strftime(fetched_at, '%Y-%m-%d') ELSE why END AS why FROM said)"""


@register("D9_no_change_detected", f"{views.with_views('d_fetches', 'd_extractions', 'd_heads')}, {_FRESH} SELECT url, fresh, why FROM fresh")
def no_change(spark, folder):
    fetches, extractions, files, heads = views.load(spark, folder, "d_fetches", "d_extractions", "d_files", "d_heads")
    return freshness.with_freshness(latest.latest_extraction(fetches, extractions, files), heads, F.expr(NOW)).select("url", "fresh", "why")


@register("D9_validators_match", f"{views.with_views('d_fetches', 'd_heads')} SELECT p.url, CAST(p.fetched_at AS VARCHAR) AS fetched_at, {matched('p')} FROM d_fetches p LEFT JOIN d_heads h ON h.url = p.url")
def validators(spark, folder):
    fetches, heads = views.load(spark, folder, "d_fetches", "d_heads")
    joined = fetches.join(heads.select("url", F.struct("error", "etag", "last_modified").alias("h")), "url", "left")
    said = freshness.validators_match(F.col("etag"), F.col("last_modified"), F.col("h.error"), F.col("h.etag"), F.col("h.last_modified"), F.col("h").isNotNull())
    return joined.select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), said["same"].alias("same"), said["why"].alias("why"))


_REUSE = f"""real AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, checksum) AS nth FROM d_fetches WHERE checksum IS NOT NULL AND reason <> 'reused download') WHERE nth = 1),
reusable AS (SELECT url, checksum FROM (SELECT p.url, p.checksum, {matched('p')} FROM real p LEFT JOIN d_heads h ON h.url = p.url WHERE {_AGE('p.fetched_at')} <= 30 AND p.checksum IN (SELECT checksum FROM d_on_disk)) WHERE same)"""


@register("D10_reusable_download", f"{views.with_views('d_fetches', 'd_heads', 'd_on_disk')}, {_REUSE} SELECT url, checksum FROM reusable")
def reusable(spark, folder):
    fetches, heads, on_disk = views.load(spark, folder, "d_fetches", "d_heads", "d_on_disk")
    return freshness.reusable_downloads(fetches, heads, on_disk, F.expr(NOW)).select("url", "checksum")


@register("D11_W8_scan_plan", f"""{views.with_views('d_fetches', 'd_extractions', 'd_heads', 'd_on_disk', 'd_requests')}, {_FRESH}, {_REUSE},
asked AS (SELECT run_id, url, min(arrival) AS arrival, bool_or(force) AS force FROM d_requests GROUP BY ALL),
staged AS (SELECT a.*, f.extraction_id AS prev, CASE WHEN NOT force AND coalesce(fresh, false) THEN 'cached' WHEN NOT force AND r.checksum IS NOT NULL THEN 'reuse' END AS action FROM asked a LEFT JOIN fresh f ON f.url = a.url LEFT JOIN reusable r ON r.url = a.url),
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, action IS NULL ORDER BY arrival) AS place FROM staged)
SELECT run_id, url, coalesce(action, CASE WHEN place <= 40 THEN 'fetch' WHEN prev IS NOT NULL THEN 'capped-older' ELSE 'capped' END) AS action FROM placed""")
def scan_plan(spark, folder):
    requests, fetches, extractions, files, heads, on_disk = views.load(spark, folder, "d_requests", "d_fetches", "d_extractions", "d_files", "d_heads", "d_on_disk")
    return freshness.scan_plan(requests, fetches, extractions, files, heads, on_disk, F.expr(NOW), 40).select("run_id", "url", "action")


@register("D11_not_yet_extracted", f"{views.with_views('d_fetches', 'd_extractions')} SELECT DISTINCT checksum FROM d_fetches WHERE checksum IS NOT NULL AND checksum NOT IN (SELECT checksum FROM d_extractions WHERE ok AND parser_version = '3')")
def not_extracted(spark, folder):
    fetches, extractions = views.load(spark, folder, "d_fetches", "d_extractions")
    return freshness.not_yet_extracted(fetches.filter("checksum is not null").select("checksum"), extractions)


@register("J5_located_hospitals", f"""{DISCOVERED.replace("WITH ", "WITH h AS (SELECT 'H' || c_custkey AS ccn FROM customer), ", 1)} SELECT h.ccn, f.ok, f.mrf_url, f.ccn IS NULL AS never_looked FROM h LEFT JOIN found f ON f.ccn = h.ccn""")
def located(spark, folder):
    customer, found = views.load(spark, folder, "customer", "d_hospital_files")
    hospitals = customer.select(F.concat(F.lit("H"), F.col("c_custkey").cast("string")).alias("ccn"))
    last = latest.cached_discovery(found, F.expr(NOW), within_ttl=False)
    return hospitals.join(last, "ccn", "left").select("ccn", "ok", "mrf_url", F.col("discovered_at").isNull().alias("never_looked"))


@register("A3_located_by_method", f"{DISCOVERED} SELECT method, count(*) AS n, (SELECT count(*) FROM found WHERE ok) AS located, (SELECT count(*) FROM found) AS \"of\" FROM found WHERE ok GROUP BY method")
def by_method(spark, folder):
    (found,) = views.load(spark, folder, "d_hospital_files")
    return audit.located_by_method(latest.cached_discovery(found, F.expr(NOW), within_ttl=False))


@register("A20_unresolved", f"""{DISCOVERED} SELECT ccn, 'Hospital ' || substr(ccn, 2) AS hospital, CASE WHEN ok THEN 'extraction' ELSE 'discovery' END AS stage,
    CASE WHEN ok THEN 'not extracted (off-template or not scanned)' ELSE coalesce(nullif(reason, ''), 'no discovery run') END AS reason FROM found WHERE ccn NOT IN (SELECT 'H' || l_suppkey FROM lineitem)""")
def unresolved(spark, folder):
    found, lineitem = views.load(spark, folder, "d_hospital_files", "lineitem")
    extracted = lineitem.select(F.concat(F.lit("H"), F.col("l_suppkey").cast("string")).alias("ccn"))
    return audit.unresolved(latest.cached_discovery(found, F.expr(NOW), within_ttl=False), extracted)


# --- keyed and versioned tables ---------------------------------------------------------


@register("K3_keyed_union", f"""{views.with_views('d_extractions')}, a AS (SELECT * FROM d_extractions WHERE checksum LIKE '%0'), b AS (SELECT extraction_id, 'other' AS checksum FROM d_extractions)
    SELECT extraction_id, checksum, reason FROM a UNION ALL SELECT extraction_id, checksum, NULL FROM b WHERE extraction_id NOT IN (SELECT extraction_id FROM a)""")
def keyed(spark, folder):
    (extractions,) = views.load(spark, folder, "d_extractions")
    old = extractions.filter("checksum LIKE '%0'")
    new = extractions.select("extraction_id", F.lit("other").alias("checksum"))
    return store.keyed_union(old, new, "extractions").select("extraction_id", "checksum", "reason")


@register("K4_K8_rekeyed_carry_over", f"{views.with_views('d_fetches')} SELECT DISTINCT checksum, CAST(NULL AS VARCHAR) AS shape FROM d_fetches WHERE checksum IS NOT NULL")
def rekeyed(spark, folder):
    (fetches,) = views.load(spark, folder, "d_fetches")
    return store.carry_over(fetches.filter("checksum is not null").select("checksum"), "files").select("checksum", "shape")


@register("S21_S22_U5_columns_present", "SELECT s_name AS name, CAST(s_suppkey AS BIGINT) AS rows, CAST(NULL AS VARCHAR) AS sha256 FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer")
def columns_present(spark, folder):
    supplier, customer = views.load(spark, folder, "supplier", "customer")
    old = supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("rows"))
    new = customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sha256"))
    return store.columns_present(old, schemas.SOURCES).unionByName(store.columns_present(new, schemas.SOURCES)).select("name", "rows", "sha256")


@register("W2_newest_sources", "SELECT o_orderpriority AS name, CAST(max(o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND) AS VARCHAR) AS fetched_at FROM orders GROUP BY 1")
def newest_sources(spark, folder):
    (orders,) = views.load(spark, folder, "orders")
    given = orders.select(F.col("o_orderpriority").alias("name"), F.expr("CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 86400) * INTERVAL '1' SECOND").alias("fetched_at"))
    return latest.newest_sources(given).select("name", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))
