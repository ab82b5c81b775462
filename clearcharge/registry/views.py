"""Domain tables as fixed projections of the driver's tables.

Each view is one SQL text that Spark and the checking engine read alike; it only renames and
computes input columns. The operators run on them in Spark, their expected results are
written separately in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearcharge.session import TIDY

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

AS_OF = "2001-06-15 00:00:00"

_S = "CAST({} AS STRING)".format
_LAT = "25 + CAST(({k} * 7919) % 24000 AS DOUBLE) / 1000".format
_LON = "-124 + CAST(({k} * 104729) % 57000 AS DOUBLE) / 1000".format
_PLACE = ("CASE s_suppkey % 8 WHEN 0 THEN 'NORTHEAST' WHEN 1 THEN 'NORTHWEST' WHEN 2 THEN 'KINGWOOD' WHEN 3 THEN 'SUGAR LAND' WHEN 4 THEN 'THE WOODLANDS' "
          "WHEN 5 THEN 'ST. MARY''S' WHEN 6 THEN 'CHILDREN''S' ELSE 'EMERGENCY CENTER' END")
_KIND = "CASE s_suppkey % 3 WHEN 0 THEN 'HOSPITAL' WHEN 1 THEN 'MED CTR' ELSE 'HEALTH SYSTEM-HCA' END"

# name: (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # ZIP centroids: one per customer.
    "d_zcta": ((), f"""
        SELECT {_S('10000 + c_custkey')} AS zip, {_LAT(k='c_custkey')} AS lat, {_LON(k='c_custkey')} AS lon,
               CAST(1000000 + (c_custkey % 50) * 2000000 AS DOUBLE) AS area_m2,
               sqrt(CAST(1000000 + (c_custkey % 50) * 2000000 AS DOUBLE) / pi()) / 1000 AS radius_km
        FROM customer"""),
    # Hospitals: one per supplier. Two neighbours share a ZIP; every eleventh has an unknown one.
    "d_raw_hospitals": ((), f"""
        SELECT 'H' || {_S('s_suppkey')} AS ccn,
               'NATION ' || {_S('s_nationkey')} || ' ' || {_PLACE} || CASE WHEN s_suppkey >= 200 THEN ' ' || {_S('CAST(floor(s_suppkey / 200) AS BIGINT)')} ELSE '' END
                   || ' ' || {_KIND} AS name,
               {_S('100 + s_suppkey % 900')} || ' MAIN ST & 5TH' AS address, 'City of N' || {_S('s_nationkey')} AS city, 'TX' AS state,
               CASE WHEN s_suppkey % 11 = 0 THEN '9' ELSE {_S('10000 + (s_suppkey - s_suppkey % 2) * 13')} END AS zip,
               CASE s_nationkey % 5 WHEN 0 THEN 'Acute Care - Veterans Administration' WHEN 1 THEN 'Childrens' ELSE 'Acute Care Hospitals' END AS hospital_type,
               'Proprietary' AS ownership, s_suppkey, s_nationkey
        FROM supplier"""),
    # Geocodes for most of them; every fifth lies a degree off.
    "d_coords": ((), f"""
        SELECT 'H' || {_S('s_suppkey')} AS ccn,
               {_LAT(k='((s_suppkey - s_suppkey % 2) * 13)')} + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE CAST(s_suppkey % 10 AS DOUBLE) / 1000 END AS lat,
               {_LON(k='((s_suppkey - s_suppkey % 2) * 13)')} + CAST(s_suppkey % 9 AS DOUBLE) / 1000 AS lon,
               CASE WHEN s_suppkey % 4 = 0 THEN 'Non_Exact' ELSE 'Exact' END AS match
        FROM supplier WHERE s_suppkey % 7 <> 0"""),
    # Entries of one index file per nation.
    "d_entries": (("d_raw_hospitals",), f"""
        SELECT 'N' || {_S('s_nationkey')} AS index_id, CAST(s_suppkey AS BIGINT) AS entry_no,
               CASE s_suppkey % 10
                   WHEN 0 THEN 'Legal ' || {_S('s_suppkey')} || ', LLC d/b/a ' || lower(name)
                   WHEN 1 THEN name || ' (Nation Care)'
                   WHEN 2 THEN replace(lower(name), 'e', '')
                   WHEN 3 THEN name || ' (Campus ' || {_S('s_suppkey')} || ')'
                   WHEN 4 THEN replace(name, 'NATION', 'NATN')
                   ELSE lower(name) END AS location_name,
               'https://files.example/' || CASE WHEN s_suppkey % 3 = 0 THEN '120045518-1506318272_x' WHEN s_suppkey % 3 = 1 THEN {_S('1234567890 + s_suppkey')} ELSE '12-3456789_x' END
                   || '_' || {_S('s_suppkey')} || '_standardcharges.csv' AS mrf_url
        FROM d_raw_hospitals"""),
    # The same entries as lines of text, with banners, odd spacing and repeated keys between them.
    "d_index_lines": (("d_entries",), """
        SELECT index_id, entry_no * 6 + i AS line_no,
               CASE i WHEN 0 THEN '# prices for everyone ' || location_name
                      WHEN 1 THEN CASE WHEN entry_no % 4 = 0 THEN 'Location-Name:' || location_name ELSE '  location-name : ' || location_name || '  ' END
                      WHEN 2 THEN 'mrf-url: ' || mrf_url
                      WHEN 3 THEN CASE WHEN entry_no % 3 = 0 THEN 'contact-email:' ELSE 'contact-email: a' || CAST(entry_no AS STRING) || '@x.org' END
                      WHEN 4 THEN CASE WHEN entry_no % 5 = 0 THEN 'MRF-URL:' || mrf_url || '?v=2' ELSE 'note: none' END
                      ELSE CASE WHEN entry_no % 6 = 0 THEN 'location-name:' ELSE '' END END AS line
        FROM d_entries CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(i)"""),
    # Two hundred services over the parts.
    "d_services": ((), f"""
        SELECT p_partkey % 200 AS pos, 'svc-' || {_S('p_partkey % 200')} AS id, min(p_name) || ' ' || {_S('p_partkey % 200')} AS name,
               min(p_name) AS alias_1, max(p_name) || ' x-' || lower(min(p_type)) AS alias_2,
               CASE (p_partkey % 200) % 4 WHEN 1 THEN 'without' WHEN 2 THEN 'with' WHEN 3 THEN 'with and without' END AS contrast,
               CASE (p_partkey % 200) % 6 WHEN 0 THEN 'without' WHEN 1 THEN 'with' END AS biopsy,
               {_S('70000 + p_partkey % 200')} AS code_1, CASE WHEN (p_partkey % 200) % 20 = 0 THEN {_S('400 + p_partkey % 200')} END AS code_2,
               (p_partkey % 200) % 3 = 0 AS reviewed
        FROM part GROUP BY p_partkey % 200"""),
    "d_queries": ((), f"""
        SELECT p_partkey, CASE p_partkey % 12
            WHEN 0 THEN {_S('70000 + p_partkey % 200')} WHEN 1 THEN p_name WHEN 2 THEN p_name || ' with contrast' WHEN 3 THEN p_name || ' w/o biopsy'
            WHEN 4 THEN p_name || ' with contrast no contrast' WHEN 5 THEN 'The ' || p_name || ' scan ' || {_S('p_partkey % 200')}
            WHEN 6 THEN replace(replace(p_name, 'a', 'aa'), 'i', 'ii') WHEN 7 THEN p_name || ' with biopsies'
            WHEN 8 THEN 'qqzx ' || {_S('p_partkey % 300')} || 'zz' WHEN 9 THEN p_name || ' ' || {_S('p_partkey % 200')}
            WHEN 10 THEN split_part(p_name, ' ', 1) ELSE 'chest ' || p_name || ' with contrast' END AS query
        FROM part"""),
    # Charges: an extraction per supplier, an item per part.
    "d_charges": ((), f"""
        SELECT 'X' || {_S('l_suppkey')} AS extraction_id, 'I' || {_S('l_partkey')} AS item_id,
               CASE l_linenumber % 5 WHEN 0 THEN 'inpatient' WHEN 3 THEN 'both' WHEN 4 THEN CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE 'inpatient' END ELSE 'outpatient' END AS setting,
               CASE l_orderkey % 6 WHEN 0 THEN 'professional' WHEN 1 THEN NULL WHEN 2 THEN 'both' ELSE 'facility' END AS billing_class,
               CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'RT' WHEN l_returnflag = 'A' AND l_linenumber % 3 = 0 THEN '26' END AS modifiers,
               CASE WHEN l_quantity < 42 THEN CAST(100 + (l_partkey % 200) * 10 + CASE WHEN l_orderkey % 9 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,6)) END AS gross,
               CASE WHEN l_linenumber % 3 <> 0 AND l_quantity < 46 THEN CAST(50 + (l_partkey % 200) * 5 + CASE WHEN l_orderkey % 25 = 0 THEN 3 ELSE 0 END AS DECIMAL(18,6)) END AS discounted_cash,
               CAST(round(l_extendedprice / 10, 2) AS DECIMAL(18,6)) AS minimum, CAST(round(l_extendedprice, 2) AS DECIMAL(18,6)) AS maximum,
               CAST(NULL AS STRING) AS notes, 'row ' || {_S('l_orderkey * 8 + l_linenumber')} AS source_ref, CAST(NULL AS STRING) AS off_template_note,
               'C' || {_S('l_orderkey')} || '-' || {_S('l_linenumber')} || '-' || {_S('l_partkey')} || '-' || {_S('l_suppkey')} AS charge_id
        FROM lineitem"""),
    "d_items": ((), f"""
        SELECT DISTINCT 'X' || {_S('l_suppkey')} AS extraction_id, 'I' || {_S('l_partkey')} AS item_id, 'Item  ' || {_S('l_partkey')} AS description,
               CAST(NULL AS STRING) AS drug_unit, CAST(NULL AS STRING) AS drug_type
        FROM lineitem"""),
    "d_item_codes": (("d_items",), f"""
        SELECT extraction_id, item_id, code_type, code FROM (
            SELECT extraction_id, item_id, CAST(substr(item_id, 2) AS BIGINT) AS k FROM d_items) CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(i)
            CROSS JOIN LATERAL (SELECT
                CASE i WHEN 0 THEN CASE WHEN k % 20 = 0 AND k % 40 = 0 THEN 'MS-DRG' ELSE 'CPT' END WHEN 1 THEN 'RC' WHEN 2 THEN 'HCPCS' ELSE 'CDM' END AS code_type,
                CASE i WHEN 0 THEN CASE WHEN k % 20 = 0 AND k % 40 = 0 THEN {_S('400 + k % 200')} ELSE {_S('70000 + k % 200')} END
                       WHEN 1 THEN {_S('300 + k % 70 * 10')} WHEN 2 THEN {_S('70000 + k % 200')} ELSE {_S('k')} END AS code) AS c
        WHERE i < 2 OR (i = 2 AND k % 9 = 0) OR (i = 3 AND k % 2 = 0)"""),
    # What was looked for, fetched and extracted.
    "d_hospital_files": ((), f"""
        SELECT 'H' || {_S('o_custkey')} AS ccn, 'HOSPITAL ' || {_S('o_custkey')} AS name,
               CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 86400) * INTERVAL '1' SECOND AS discovered_at,
               o_orderpriority <> '1-URGENT' AS ok, CASE WHEN o_orderkey % 2 = 0 THEN 'cms-hpt' ELSE 'site-page' END AS method,
               'https://files.example/' || {_S('o_custkey')} || '_standardcharges.csv' AS mrf_url,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN '' WHEN o_orderkey % 2 = 0 THEN 'no cms-hpt.txt or linked file located: x' ELSE 'file URL failed: timeout' END AS reason,
               CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE '2' END AS discovery_version
        FROM orders"""),
    "d_fetches": ((), f"""
        SELECT 'https://files.example/' || {_S('o_custkey')} || '_standardcharges.csv' AS url,
               CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 86400) * INTERVAL '1' SECOND AS fetched_at, CAST(200 AS INT) AS status,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '"e' || {_S('o_custkey % 7')} || '"' END AS etag,
               CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'day ' || {_S('o_custkey % 5')} END AS last_modified, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'c' || {_S('o_custkey')} || '-' || {_S('o_orderkey % 3')} END AS checksum,
               CASE WHEN o_orderkey % 11 = 0 THEN 'reused download' ELSE '' END AS reason
        FROM orders"""),
    "d_extractions": ((), f"""
        SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'X' || {_S('o_custkey')} ELSE 'X' || {_S('o_custkey')} || '-' || {_S('o_orderkey % 3')} END AS extraction_id,
               'c' || {_S('o_custkey')} || '-' || {_S('o_orderkey % 3')} AS checksum, CASE WHEN o_custkey % 13 = 0 THEN '2' ELSE '3' END AS parser_version,
               o_custkey % 100 AS charges, o_custkey % 50 AS items, o_orderkey % 3 <> 2 AS ok, '' AS reason
        FROM orders"""),
    "d_files": ((), f"""
        SELECT DISTINCT 'c' || {_S('o_custkey')} || '-' || {_S('o_orderkey % 3')} AS checksum, '1/' || {_S('o_custkey % 28 + 1')} || '/2026' AS last_updated_on
        FROM orders WHERE o_custkey % 17 <> 0"""),
    # One HEAD per file address.
    "d_heads": ((), f"""
        SELECT 'https://files.example/' || {_S('c_custkey')} || '_standardcharges.csv' AS url, CASE WHEN c_custkey % 10 = 0 THEN 'HTTP 503' END AS error,
               CASE WHEN c_custkey % 10 = 0 OR c_custkey % 6 = 1 THEN NULL ELSE '"e' || {_S('c_custkey % 7 + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END')} || '"' END AS etag,
               CASE WHEN c_custkey % 10 = 0 OR c_custkey % 12 = 1 THEN NULL ELSE 'day ' || {_S('c_custkey % 5')} END AS last_modified
        FROM customer WHERE c_custkey % 19 <> 3"""),
    "d_on_disk": ((), f"SELECT DISTINCT 'c' || {_S('o_custkey')} || '-' || {_S('o_orderkey % 3')} AS checksum FROM orders WHERE o_orderkey % 2 = 1"),
    "d_requests": ((), f"""
        SELECT c_mktsegment AS run_id, c_custkey AS arrival, 'https://files.example/' || {_S('c_custkey - c_custkey % 3')} || '_standardcharges.csv' AS url, c_custkey % 23 = 0 AS force
        FROM customer"""),
    # Review answers for some headlines.
    "d_reviews": ((), f"""
        SELECT DISTINCT 'svc-' || {_S('l_partkey % 200')} AS service_id, l_suppkey AS s_suppkey, 'row ' || {_S('l_orderkey * 8 + l_linenumber')} AS ref,
               CASE WHEN l_partkey % 5 = 0 THEN 'no' WHEN l_partkey % 5 = 1 THEN '' ELSE 'yes' END AS headline_is_this_service,
               CASE WHEN l_linenumber % 6 = 0 THEN '' ELSE 'facility' END AS billing_class,
               CASE WHEN l_partkey % 4 = 0 THEN 'item ' || {_S('l_partkey')} WHEN l_partkey % 4 = 1 THEN 'something else' ELSE '' END AS description
        FROM lineitem"""),
    # Events of runs.
    "d_events": ((), f"""
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, {_S('user_id')} || '/' || {_S('CAST(floor(event_id / 500) AS BIGINT)')} AS run_id, event_id AS seq,
               CASE event_type WHEN 'click' THEN 'progress' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'hospital' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'trace' END ELSE CASE WHEN event_id % 2 = 0 THEN 'end' ELSE 'trace' END END AS kind,
               'H' || {_S('event_id % 4')} AS ccn, CASE WHEN event_id % 2 = 0 THEN 'download' ELSE 'extract' END AS phase,
               CAST(round(value * 100) AS BIGINT) AS done, CAST(NULL AS BIGINT) AS total, event_type || {_S('event_id')} AS result
        FROM events"""),
    # The same, each run up to its first end or error: nothing follows that.
    "d_runs": (("d_events",), """
        SELECT e.* FROM d_events AS e LEFT JOIN (SELECT run_id, min(seq) AS stop FROM d_events WHERE kind IN ('end', 'error') GROUP BY run_id) AS s ON s.run_id = e.run_id
        WHERE s.stop IS NULL OR e.seq <= s.stop"""),
    "d_spend": ((), """
        SELECT event_id AS call_id, CAST(ts AS TIMESTAMP) AS called_at,
               CASE event_type WHEN 'click' THEN 'small-model' WHEN 'view' THEN 'small-model-2024' WHEN 'purchase' THEN 'large-model' ELSE 'other' END AS model,
               event_id % 9000 AS input_tokens, event_id % 700 AS output_tokens, event_id % 50 AS cache_read_tokens, event_id % 30 AS cache_write_tokens,
               CAST(round(value * 100) AS BIGINT) AS cents
        FROM events"""),
    # Pages with pricing links in place of some plain ones.
    "d_pages": ((), """
        SELECT page_id, url, replace(replace(replace(replace(html, 'href="/d', 'href="/price-transparency/d'), 'href="/a', 'href="/files/12-3456789_a_standardcharges.csv?'),
               'href="/t', 'href="https://care.example.com/standard-charges/t'), 'href="/E', 'HREF = ''https://www.elsewhere.org/transparency/E') AS html
        FROM pages"""),
}


# The same rows as Spark reads them: what a view's texts are made of is told apart before they are written out, so a
# shuffle carries numbers, and views over it share that shuffle.
SPARK_VIEWS: dict[str, str] = {
    "d_items": VIEWS["d_items"][1].replace("SELECT DISTINCT", "SELECT").replace("FROM lineitem", "FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) AS pairs"),
}


def closure(names: tuple[str, ...]) -> list[str]:
    """The views and what they read, inputs first."""
    out: list[str] = []
    for name in names:
        for needed in closure(VIEWS[name][0]):
            if needed not in out:
                out.append(needed)
        if name not in out:
            out.append(name)
    return out


def with_views(*names: str, instead: dict[str, str] | None = None) -> str:
    """`WITH ...` text defining the views, for the oracle SQL; `instead`: other texts of some of them."""
    return "WITH " + ",\n".join(f"{name} AS ({(instead or {}).get(name, VIEWS[name][1])})" for name in closure(names))


def load(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """The views, or plain driver tables, as DataFrames."""
    spark.conf.set(TIDY, "true")
    for table in TABLES:
        if any(table in VIEWS[v][1] for n in names if n in VIEWS for v in closure((n,))):
            spark.read.parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(table)
    return [spark.sql(f"{with_views(n, instead=SPARK_VIEWS)} SELECT * FROM {n}") if n in VIEWS else spark.read.parquet(f"{folder}/{n}.parquet") for n in names]
