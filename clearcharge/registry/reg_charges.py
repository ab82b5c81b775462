"""Charge lines, verdicts, pairs and whole price answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import billing_codes, text
from clearcharge.operators import lines, verdicts
from clearcharge.plans import audit, prices, review
from clearcharge.registry import duck, views
from clearcharge.registry.core import register
from clearcharge.registry.reg_catalog import RESOLVED, services
from clearcharge.registry.reg_places import K, NEAREST, located_hospitals
from clearcharge.session import materialise

AS_OF = f"TIMESTAMP '{views.AS_OF}'"


def charge_lines(spark, folder):
    charges, items, codes = views.load(spark, folder, "d_charges", "d_items", "d_item_codes")
    return lines.charge_lines(charges, items, codes, lines.service_codes(services(spark, folder)))


# --- expected lines and verdicts --------------------------------------------------------
_TYPES = "('CPT', 'HCPCS', 'MS-DRG', 'DRG')"
LINES_ONLY = f"""wanted AS (SELECT id AS service_id, unnest(list_filter([code_1, code_2], lambda v: v IS NOT NULL)) AS code, CASE WHEN code_2 IS NULL THEN 'outpatient' ELSE 'inpatient' END AS want FROM d_services),
coded AS (SELECT ic.*, w.service_id, w.want, (SELECT string_agg(o.code_type || ' ' || o.code, ', ' ORDER BY o.code_type, o.code) FROM d_item_codes o WHERE o.extraction_id = ic.extraction_id AND o.item_id = ic.item_id
          AND NOT (o.code_type = ic.code_type AND o.code = ic.code)) AS other_codes FROM d_item_codes ic JOIN wanted w ON w.code = ic.code WHERE ic.code_type IN {_TYPES}),
lines AS (SELECT c.extraction_id, k.service_id, k.want, k.code_type, k.code, k.other_codes, i.description, c.setting, c.billing_class, c.modifiers, c.gross, c.discounted_cash, c.minimum, c.maximum, c.source_ref
          FROM d_charges c JOIN coded k ON k.extraction_id = c.extraction_id AND k.item_id = c.item_id JOIN d_items i ON i.extraction_id = c.extraction_id AND i.item_id = c.item_id)"""
LINES = f"{views.with_views('d_charges', 'd_items', 'd_item_codes', 'd_services')}, {LINES_ONLY}"
LINE_ORDER = "code, modifiers NULLS FIRST, setting NULLS LAST, billing_class NULLS LAST, source_ref, code_type, description"


def summarised(source: str, keys: str, prefix: str = "") -> str:
    """CTEs deciding verdict, detail and headline ref per key over a lines CTE."""
    p = prefix
    listed = lambda v: f"array_to_string(list_transform(list_sort({v}), lambda v: '$' || format('{{:,.2f}}', CAST(v AS DOUBLE))), ', ')"
    return f"""
{p}flags AS (SELECT *, modifiers IS NULL AND (billing_class IS NULL OR billing_class IN ('facility', 'both')) AND (discounted_cash IS NOT NULL OR gross IS NOT NULL) AS plain,
    modifiers IS NOT NULL AND (discounted_cash IS NOT NULL OR gross IS NOT NULL) AS modded, coalesce(billing_class = 'professional', false) AND (discounted_cash IS NOT NULL OR gross IS NOT NULL) AS prof,
    setting IS NULL OR setting = 'both' OR setting = want AS fits FROM {source}),
{p}groups AS (SELECT {keys}, any_value(want) AS want, count(*) AS n, count(*) FILTER (WHERE plain) AS n_plain, count(*) FILTER (WHERE plain AND fits) AS n_fit, count(*) FILTER (WHERE modded) AS n_mod, count(*) FILTER (WHERE prof) AS n_prof,
    string_agg(DISTINCT modifiers, ', ' ORDER BY modifiers) FILTER (WHERE modded) AS mods FROM {p}flags GROUP BY {keys}),
{p}pool AS (SELECT f.* FROM {p}flags f JOIN {p}groups g USING ({keys}) WHERE f.plain AND (f.fits OR g.n_fit = 0)),
{p}prices AS (SELECT {keys}, count(*) AS pool_n, list(DISTINCT discounted_cash) FILTER (WHERE discounted_cash IS NOT NULL) AS cash, list(DISTINCT gross) FILTER (WHERE gross IS NOT NULL) AS gross FROM {p}pool GROUP BY {keys}),
{p}heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY discounted_cash IS NULL, {LINE_ORDER}) AS nth FROM {p}pool) WHERE nth = 1),
{p}judged AS (SELECT g.*, p.pool_n, coalesce(len(p.cash), 0) AS n_cash, coalesce(len(p.gross), 0) AS n_gross, p.cash, p.gross AS grosses, h.billing_class AS h_class, h.setting AS h_setting, h.source_ref AS h_ref, h.code_type AS h_type, h.code AS h_code,
    h.modifiers AS h_mod, h.discounted_cash AS h_cash, h.gross AS h_gross FROM {p}groups g LEFT JOIN {p}prices p USING ({keys}) LEFT JOIN {p}heads h USING ({keys})),
{p}verdicts AS (SELECT {keys}, n AS line_count, n_plain > 0 AND NOT (n_cash > 1 OR (n_cash = 0 AND n_gross > 1)) AS has_head, h_ref, h_class, h_setting, h_type, h_code, h_mod, h_cash, h_gross,
    CASE WHEN n_plain = 0 AND n_mod = 0 AND n_prof > 0 THEN '{fv.PROFESSIONAL_ONLY}' WHEN n_plain = 0 AND n_mod = 0 THEN '{fv.NEGOTIATED_ONLY}' WHEN n_plain = 0 THEN '{fv.MODIFIERS_ONLY}'
         WHEN n_cash > 1 OR (n_cash = 0 AND n_gross > 1) THEN '{fv.CONFLICTING}' WHEN n_fit = 0 THEN CASE WHEN want = 'outpatient' THEN '{fv.INPATIENT_ONLY}' ELSE '{fv.OUTPATIENT_ONLY}' END
         WHEN h_class IS NULL THEN '{fv.UNKNOWN_CLASS}' WHEN h_setting IS NULL THEN '{fv.UNKNOWN_SETTING}' ELSE '{fv.COMPARABLE}' END AS verdict,
    CASE WHEN n_plain = 0 AND n_mod = 0 AND n_prof > 0 THEN n_prof || ' priced line' || CASE n_prof WHEN 1 THEN ' carries' ELSE 's carry' END || ' the professional charge only'
         WHEN n_plain = 0 AND n_mod = 0 THEN n || ' line' || CASE n WHEN 1 THEN '' ELSE 's' END || ', each with negotiated min/max only'
         WHEN n_plain = 0 THEN 'priced lines carry modifiers ' || mods || '; no unmodified line to compare'
         WHEN n_cash > 1 THEN pool_n || ' unmodified lines disagree (cash ' || {listed('cash')} || ')'
         WHEN n_cash = 0 AND n_gross > 1 THEN pool_n || ' unmodified lines disagree (gross ' || {listed('grosses')} || ')'
         ELSE concat_ws('; ', CASE WHEN n_fit = 0 THEN 'only an ' || CASE want WHEN 'outpatient' THEN 'inpatient' ELSE 'outpatient' END || ' line is priced; this service is priced as ' || want || ', so no comparison'
                                   WHEN n_gross > 1 THEN 'cash agrees; gross charges differ (' || {listed('grosses')} || ')' WHEN h_class IS NULL THEN 'the file does not say whether this is a facility or professional charge'
                                   WHEN h_setting IS NULL THEN 'the file does not say whether this is an inpatient or outpatient charge' END,
              CASE WHEN n > 1 THEN (n - 1) || ' other line' || CASE n WHEN 2 THEN '' ELSE 's' END || ' for this code (modifiers, revenue centers or payer-only rates)' END) END AS detail
    FROM {p}judged)"""


_NUM = lambda c: F.col(c).cast("double").alias(c)


@register("J2_J3_F4_charge_lines", f"{LINES} SELECT extraction_id, service_id, code_type, code, other_codes, description, source_ref, CAST(gross AS DOUBLE) AS gross, CAST(discounted_cash AS DOUBLE) AS discounted_cash FROM lines")
def all_lines(spark, folder):
    found = charge_lines(spark, folder)
    return found.select("extraction_id", "service_id", "code_type", "code", F.nullif(F.array_join("other_codes", ", "), F.lit("")).alias("other_codes"), "description", "source_ref", _NUM("gross"), _NUM("discounted_cash"))


@register("A15_code_lists", f"{views.with_views('d_item_codes')} SELECT extraction_id, item_id, string_agg(code, ' ' ORDER BY code) AS codes FROM d_item_codes GROUP BY ALL")
def code_lists(spark, folder):
    charges, codes = views.load(spark, folder, "d_charges", "d_item_codes")
    items = charges.select("extraction_id", "item_id").distinct()
    return audit.with_code_list(items, codes).select("extraction_id", "item_id", F.array_join("code_values", " ").alias("codes"))


def summaries(spark, folder):
    return verdicts.summarise(charge_lines(spark, folder), ["extraction_id", "service_id"])


_SUMMARY = "extraction_id, service_id"


@register("D1_summarise", f"{LINES}, {summarised('lines', _SUMMARY)} SELECT extraction_id, service_id, verdict, detail, CASE WHEN has_head THEN h_ref END AS headline_ref, CASE WHEN has_head THEN CAST(h_cash AS DOUBLE) END AS cash, line_count FROM verdicts")
def summarise(spark, folder):
    return summaries(spark, folder).select("extraction_id", "service_id", "verdict", "detail", F.col("headline.source_ref").alias("headline_ref"), F.col("headline.discounted_cash").cast("double").alias("cash"), "line_count")


@register("F5_F6_plain_priced_lines", f"""{views.with_views('d_charges')} SELECT charge_id, modifiers IS NULL AND (billing_class IS NULL OR billing_class IN ('facility', 'both')) AS plain, discounted_cash IS NOT NULL OR gross IS NOT NULL AS priced FROM d_charges""")
def flags(spark, folder):
    (charges,) = views.load(spark, folder, "d_charges")
    return charges.select("charge_id", verdicts.plain().alias("plain"), verdicts.has_price().alias("priced"))


@register("A5_A6_F7_price_sets", f"""{LINES}, {summarised('lines', _SUMMARY)} SELECT verdict, count(*) AS n, count(*) FILTER (WHERE has_head) AS with_headline FROM verdicts GROUP BY verdict""")
def price_sets(spark, folder):
    return summaries(spark, folder).groupBy("verdict").agg(F.count("*").alias("n"), F.count("headline").alias("with_headline"))


@register("A2_verdict_counts", f"{LINES}, {summarised('lines', _SUMMARY)} SELECT count(*) AS pairs, round(avg(CASE WHEN verdict = 'comparable' THEN 1.0 ELSE 0.0 END), 3) AS comparable_share FROM verdicts")
def share(spark, folder):
    return audit.comparable_share(summaries(spark, folder))


_KINDS = [fv.COMPARABLE, fv.UNKNOWN_CLASS, fv.UNKNOWN_SETTING, fv.MODIFIERS_ONLY, fv.NEGOTIATED_ONLY, fv.PROFESSIONAL_ONLY, fv.CONFLICTING, fv.INPATIENT_ONLY, fv.OUTPATIENT_ONLY, fv.NOT_FOUND]
_KIND_COLUMNS = ", ".join(f"count(*) FILTER (WHERE verdict = '{k}') AS \"{k}\"" for k in _KINDS)


@register("A17_verdicts_per_service", f"{LINES}, {summarised('lines', _SUMMARY)} SELECT service_id, {_KIND_COLUMNS} FROM verdicts GROUP BY service_id")
def per_service(spark, folder):
    return review.verdicts_per_service(summaries(spark, folder))


@register("A19_price_spread", f"{LINES}, {summarised('lines', _SUMMARY)} SELECT service_id, count(h_cash) FILTER (WHERE has_head) AS hospitals, min(CAST(h_cash AS DOUBLE)) FILTER (WHERE has_head) AS low, max(CAST(h_cash AS DOUBLE)) FILTER (WHERE has_head) AS high, "
          "round(max(CAST(h_cash AS DOUBLE)) FILTER (WHERE has_head) / min(CAST(h_cash AS DOUBLE)) FILTER (WHERE has_head), 6) AS ratio FROM verdicts GROUP BY service_id")
def spread(spark, folder):
    return audit.price_spread(summaries(spark, folder)).withColumn("ratio", F.round("ratio", 6))


@register("T1_T2_shown_lines", f"{LINES} SELECT extraction_id, service_id, source_ref, code_type, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY extraction_id, service_id ORDER BY {LINE_ORDER}) AS INT) AS place FROM lines) WHERE place <= 8")
def shown(spark, folder):
    return verdicts.shown_lines(charge_lines(spark, folder), ["extraction_id", "service_id"]).select("extraction_id", "service_id", "source_ref", "code_type", "place")


REVIEWED_ONLY = f"""answers AS (SELECT service_id, 'X' || s_suppkey AS extraction_id, ref, max(struct_pack(b := billing_class, d := description)) AS a
    FROM d_reviews WHERE billing_class <> '' AND headline_is_this_service <> 'no' GROUP BY ALL),
reviewed AS (SELECT l.* REPLACE (coalesce(l.billing_class, CASE WHEN a.a.d = '' OR lower({duck.squeeze('a.a.d')}) = lower({duck.squeeze('l.description')}) THEN a.a.b END) AS billing_class), l.billing_class AS file_class
    FROM lines l LEFT JOIN answers a ON a.service_id = l.service_id AND a.extraction_id = l.extraction_id AND a.ref = l.source_ref)"""
REVIEWED = f"{views.with_views('d_charges', 'd_items', 'd_item_codes', 'd_services', 'd_reviews')}, {LINES_ONLY}, {REVIEWED_ONLY}"


def answers(spark, folder):
    (reviews,) = views.load(spark, folder, "d_reviews")
    return reviews.select("service_id", F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("hospital"), "headline_is_this_service", "billing_class", F.lit(None).cast("string").alias("note"), "ref", "description")


@register("J9_F17_apply_review", f"{REVIEWED} SELECT extraction_id, service_id, source_ref, code_type, billing_class, file_class IS NULL AND billing_class IS NOT NULL AS class_from_review FROM reviewed")
def apply_review(spark, folder):
    given = charge_lines(spark, folder).withColumn("hospital", F.col("extraction_id"))
    return lines.apply_review(given, answers(spark, folder)).select("extraction_id", "service_id", "source_ref", "code_type", "billing_class", "class_from_review")


# --- pairs ------------------------------------------------------------------------------
def pair_sql(a: str, b: str) -> str:
    """(verdict, detail) of two headline rows with columns name, has_head, h_*."""
    silent = "concat_ws('; ', " + ", ".join(f"CASE WHEN {r}.h_{f} IS NULL THEN {r}.name || '''s row has no {t}' END" for r in (a, b) for f, t in (("setting", "setting"), ("class", "billing class"))) + ")"
    family = lambda r: f"CASE WHEN {r}.h_type IN ('CPT', 'HCPCS') THEN 'HCPCS' ELSE {r}.h_type END"
    differs = (f"concat_ws('; ', CASE WHEN {a}.h_code <> {b}.h_code OR {family(a)} <> {family(b)} THEN 'different codes (' || {a}.h_type || ' ' || {a}.h_code || ' vs ' || {b}.h_type || ' ' || {b}.h_code || ')' END, "
               f"CASE WHEN {a}.h_setting <> {b}.h_setting AND 'both' NOT IN ({a}.h_setting, {b}.h_setting) THEN {a}.h_setting || ' vs ' || {b}.h_setting END, "
               f"CASE WHEN {a}.h_class <> {b}.h_class THEN {a}.h_class || ' vs ' || {b}.h_class || ' charge' END, "
               f"CASE WHEN coalesce({a}.h_mod, '') <> coalesce({b}.h_mod, '') THEN 'modifiers ' || coalesce({a}.h_mod, 'none') || ' vs ' || coalesce({b}.h_mod, 'none') END)")
    return (f"CASE WHEN NOT {a}.has_head OR NOT {b}.has_head THEN 'unknown' WHEN {silent} <> '' THEN 'unknown' WHEN {differs} <> '' THEN 'not comparable' ELSE 'comparable' END AS verdict, "
            f"CASE WHEN NOT {a}.has_head THEN {a}.name || ' has no priced line for this service' WHEN NOT {b}.has_head THEN {b}.name || ' has no priced line for this service' WHEN {silent} <> '' THEN {silent} WHEN {differs} <> '' THEN {differs} "
            f"ELSE concat_ws(', ', {a}.h_setting, {a}.h_class, coalesce('mod ' || {a}.h_mod, 'no modifiers')) END AS detail")


# Searches: suppliers in blocks of six stand for a nearest list.
_BLOCKS = "SELECT *, extraction_id AS name, CAST(substr(extraction_id, 2) AS BIGINT) % 6 + 1 AS rank, CAST(substr(extraction_id, 2) AS BIGINT) // 6 AS block FROM verdicts"


def blocks(spark, folder):
    number = F.substring("extraction_id", 2, 18).cast("bigint")
    return summaries(spark, folder).select("service_id", F.floor(number / 6).alias("block"), (number % 6 + 1).alias("rank"), F.col("extraction_id").alias("ccn"), F.col("extraction_id").alias("name"), "headline")


@register("D2_J6_pairs", f"{LINES}, {summarised('lines', _SUMMARY)}, listed AS ({_BLOCKS}) SELECT a.service_id, a.block, a.name AS a, b.name AS b, {pair_sql('a', 'b')} FROM listed a JOIN listed b ON b.service_id = a.service_id AND b.block = a.block AND b.rank > a.rank")
def pairs(spark, folder):
    return verdicts.pairs(blocks(spark, folder), ["service_id", "block"])


@register("D3_U4_priced_pairs", f"""{LINES}, {summarised('lines', _SUMMARY)}, listed AS ({_BLOCKS}), said AS (SELECT a.service_id, a.block, a.rank AS ra, b.rank AS rb, a.name AS a, b.name AS b, {pair_sql('a', 'b')}
        FROM listed a JOIN listed b ON b.service_id = a.service_id AND b.block = a.block AND b.rank > a.rank WHERE a.has_head AND b.has_head),
    told AS (SELECT service_id, block, string_agg('compare: ' || a || ' vs ' || b || ': ' || verdict || CASE WHEN detail <> '' THEN ' (' || detail || ')' ELSE '' END, chr(10) ORDER BY ra, rb) AS said FROM said GROUP BY ALL),
    sums AS (SELECT service_id, block, string_agg(name, ', ' ORDER BY rank) FILTER (WHERE NOT has_head) AS unpriced, count(*) FILTER (WHERE has_head) AS n FROM listed GROUP BY ALL)
    SELECT service_id, block, concat_ws(chr(10), 'no priced line for this service at ' || unpriced || '; no pair with them can be compared', CASE WHEN n = 1 THEN 'only one hospital has a price for this service; nothing to put side by side' END, said) AS lines
    FROM sums LEFT JOIN told USING (service_id, block)""")
def closing(spark, folder):
    summary = verdicts.priced_pairs(blocks(spark, folder), ["service_id", "block"])
    return verdicts.closing_lines(summary, ["service_id", "block"]).withColumn("lines", F.array_join("lines", "\n"))


# --- data quality -----------------------------------------------------------------------
@register("A16_summary_conflicts", f"""{views.with_views('d_charges')} SELECT extraction_id, item_id, setting, billing_class, modifiers, count(DISTINCT struct_pack(a := gross, b := discounted_cash, c := minimum, d := maximum)) AS price_sets
    FROM d_charges GROUP BY ALL HAVING price_sets > 1""")
def conflicts(spark, folder):
    (charges,) = views.load(spark, folder, "d_charges")
    return audit.summary_conflicts(charges)


@register("A18_price_relations", f"""{views.with_views('d_charges')} SELECT extraction_id, count(*) FILTER (WHERE discounted_cash IS NOT NULL AND gross <> 0) AS priced, count(*) FILTER (WHERE discounted_cash = gross AND gross <> 0) AS cash_is_gross,
    count(*) FILTER (WHERE discounted_cash * 2 = gross AND gross <> 0) AS cash_is_half, round(avg(CASE WHEN gross <> 0 THEN CAST(discounted_cash AS DOUBLE) / CAST(gross AS DOUBLE) END), 6) AS mean_ratio FROM d_charges GROUP BY ALL""")
def relations(spark, folder):
    (charges,) = views.load(spark, folder, "d_charges")
    return audit.price_relations(charges).withColumn("mean_ratio", F.round("mean_ratio", 6))


@register("A4_extraction_counts", f"{views.with_views('d_charges')} SELECT extraction_id, count(*) AS charges, count(DISTINCT item_id) AS items FROM d_charges GROUP BY ALL")
def counts(spark, folder):
    from clearcharge.sources import store

    (charges,) = views.load(spark, folder, "d_charges")
    return store.extraction_counts(charges)


@register("P52_line_struct", f"{LINES} SELECT extraction_id, service_id, source_ref, code_type || ' ' || code AS token, coalesce(nullif(concat_ws(', ', setting, billing_class, 'mod ' || modifiers), ''), 'no context stated') AS context, CAST(discounted_cash AS DOUBLE) AS cash FROM lines")
def line_structs(spark, folder):
    found = charge_lines(spark, folder).withColumn("line", prices.line_for_reader(verdicts.line_struct()))
    return found.select("extraction_id", "service_id", "source_ref", F.concat_ws(" ", "line.code_type", "line.code").alias("token"), "line.context", "line.cash")


# --- whole answers ----------------------------------------------------------------------
def stored(spark, folder):
    hospitals, zcta = located_hospitals(spark, folder)
    found, fetches, files, extractions, items, codes, charges, reviews = views.load(
        spark, folder, "d_hospital_files", "d_fetches", "d_files", "d_extractions", "d_items", "d_item_codes", "d_charges", "d_reviews")
    names = hospitals.select("ccn", text.short_name(F.col("name")).alias("hospital"))
    told = reviews.withColumn("ccn", F.concat(F.lit("H"), F.col("s_suppkey").cast("string"))).join(names, "ccn").drop("s_suppkey", "ccn")
    return prices.Store(hospitals, zcta, found, fetches, files, extractions, items, codes, charges, services(spark, folder), told)


def searches(spark, folder):
    customer, queries = views.load(spark, folder, "customer", "d_queries")
    asked = customer.select("c_custkey", (F.col("c_custkey") + 10000).cast("string").alias("zip"))
    return asked.join(queries.withColumnRenamed("p_partkey", "c_custkey"), "c_custkey").select("query", "zip")


_ALL_VIEWS = ("d_raw_hospitals", "d_coords", "d_zcta", "d_services", "d_queries", "d_charges", "d_items", "d_item_codes", "d_hospital_files", "d_fetches", "d_extractions", "d_files", "d_reviews")




def _ctes(sql: str, *given: str) -> str:
    prefix = views.with_views(*given)
    assert sql.startswith(prefix), "oracle text does not start with its views"
    return sql[len(prefix):]


PRICED = f"""{views.with_views(*_ALL_VIEWS)}{_ctes(NEAREST, 'd_raw_hospitals', 'd_coords', 'd_zcta')}{_ctes(RESOLVED, 'd_services', 'd_queries')}, {LINES_ONLY},
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY discovered_at DESC) AS nth FROM d_hospital_files) WHERE nth = 1 AND (ok OR discovery_version = '2')),
current AS (SELECT url, extraction_id, checksum FROM (SELECT f.url, e.extraction_id, f.checksum, row_number() OVER (PARTITION BY f.url ORDER BY f.fetched_at DESC, e.extraction_id) AS nth FROM d_fetches f
            JOIN d_extractions e ON e.checksum = f.checksum AND e.ok AND e.parser_version = '3') WHERE nth = 1),
searches AS (SELECT q.query, CAST(10000 + c_custkey AS STRING) AS zip FROM customer JOIN d_queries q ON q.p_partkey = c_custkey),
asked AS (SELECT DISTINCT s.zip AS query_zip, r.service_id FROM searches s JOIN resolved r ON r.query = s.query WHERE r.service_id IS NOT NULL),
placed AS (SELECT a.query_zip, a.service_id, n.rank, n.ccn, n.name, n.hospital_type, n.distance_km, n.location_source = 'zip' AS approximate FROM asked a JOIN nearest n ON n.query_zip = a.query_zip),
want AS (SELECT DISTINCT p.ccn, p.service_id, p.name AS cms_name, f.ok AS located, f.reason, f.mrf_url, c.extraction_id, fi.last_updated_on FROM placed p LEFT JOIN found f ON f.ccn = p.ccn LEFT JOIN current c ON c.url = f.mrf_url
         LEFT JOIN d_files fi ON fi.checksum = c.checksum),
answers AS (SELECT r.service_id, 'H' || r.s_suppkey AS ccn, r.ref, max(struct_pack(b := r.billing_class, d := r.description)) AS a FROM d_reviews r WHERE r.billing_class <> '' AND r.headline_is_this_service <> 'no' GROUP BY ALL),
answer_lines AS (SELECT w.ccn, l.* REPLACE (coalesce(l.billing_class, CASE WHEN a.a.d = '' OR lower({duck.squeeze('a.a.d')}) = lower({duck.squeeze('l.description')}) THEN a.a.b END) AS billing_class)
    FROM want w JOIN lines l ON l.extraction_id = w.extraction_id AND l.service_id = w.service_id AND w.located LEFT JOIN answers a ON a.service_id = l.service_id AND a.ccn = w.ccn AND a.ref = l.source_ref),
{summarised('answer_lines', 'ccn, service_id', 'z_')},
results AS (SELECT p.query_zip, p.service_id, CAST(p.rank AS INT) AS rank, p.ccn, round(p.distance_km, 1) AS distance_km, p.approximate, w.mrf_url AS url, w.last_updated_on AS file_date,
    CASE WHEN w.located IS NULL THEN '{fv.NOT_LOOKED}' WHEN NOT w.located THEN '{fv.NO_FILE}' WHEN w.extraction_id IS NULL THEN '{fv.NOT_SCANNED}' ELSE coalesce(v.verdict, '{fv.NOT_FOUND}') END AS verdict,
    CASE WHEN w.located IS NULL THEN 'locate the file first' WHEN NOT w.located THEN CASE WHEN starts_with(w.reason, 'no cms-hpt.txt or linked file located') THEN 'no index file or standard-charges link on any guessed domain (the trace lists them)' ELSE w.reason END
         WHEN w.extraction_id IS NULL THEN '' ELSE coalesce(v.detail, '') END AS detail,
    coalesce(v.line_count, 0) AS line_count, CASE WHEN v.has_head THEN v.h_ref END AS headline_ref
    FROM placed p JOIN want w ON w.ccn = p.ccn AND w.service_id = p.service_id LEFT JOIN z_verdicts v ON v.ccn = p.ccn AND v.service_id = p.service_id)"""


@register("D14_D13_D15_prices", f"{PRICED} SELECT * FROM results")
def price_batch(spark, folder):
    _, results = prices.prices(stored(spark, folder), searches(spark, folder), K, F.expr(AS_OF))
    return results.select("query_zip", "service_id", "rank", "ccn", "distance_km", "approximate", "url", "file_date", "verdict", "detail", F.col("line_count").cast("bigint").alias("line_count"), F.col("headline.source_ref").alias("headline_ref"))


# Every fiftieth search is asked once more for a ZIP that is not listed.
@register("K14_payloads", f"""{PRICED}, heads AS (SELECT x.query_zip, x.service_id, x.rank, x.ccn AS name, v.* EXCLUDE (ccn, service_id) FROM results x JOIN z_verdicts v ON v.ccn = x.ccn AND v.service_id = x.service_id WHERE v.has_head),
    said AS (SELECT a.query_zip, a.service_id, a.rank AS ra, b.rank AS rb, {pair_sql('a', 'b')} FROM heads a JOIN heads b ON b.query_zip = a.query_zip AND b.service_id = a.service_id AND b.rank > a.rank),
    told AS (SELECT query_zip, service_id, string_agg(verdict, ',' ORDER BY ra, rb) AS compared FROM said GROUP BY ALL),
    asked_for AS (SELECT DISTINCT query, zip FROM searches UNION SELECT DISTINCT query, '00000' FROM searches WHERE CAST(zip AS BIGINT) % 50 = 0)
    SELECT s.query, s.zip, CASE WHEN r.service_id IS NULL THEN 'needs_clarification' WHEN s.zip = '00000' THEN 'error' ELSE 'ok' END AS status, CASE WHEN s.zip = '00000' THEN s.zip || ' is not a residential ZIP code in the census ZCTA list' END AS error,
    CASE WHEN r.service_id IS NULL THEN 0 ELSE (SELECT count(*) FROM results x WHERE x.query_zip = s.zip AND x.service_id = r.service_id) END AS hospitals,
    CASE WHEN r.service_id IS NOT NULL AND s.zip <> '00000' THEN (SELECT coalesce(string_agg(x.ccn || ' ' || x.verdict || ' ' || x.detail || ' ' || x.line_count || ' ' || coalesce(x.headline_ref, '-'), '; ' ORDER BY x.rank), '') FROM results x WHERE x.query_zip = s.zip AND x.service_id = r.service_id) END AS listed,
    CASE WHEN r.service_id IS NOT NULL AND s.zip <> '00000' THEN coalesce(t.compared, '') END AS compared
    FROM asked_for s JOIN resolved r ON r.query = s.query LEFT JOIN told t ON t.query_zip = s.zip AND t.service_id = r.service_id""")
def payloads(spark, folder):
    given = searches(spark, folder)
    more = given.filter(F.col("zip").cast("bigint") % 50 == 0).select("query", F.lit("00000").alias("zip"))
    out = prices.payloads(stored(spark, folder), given.unionByName(more), K, F.expr(AS_OF))
    parsed = F.from_json("payload", "status string, error string, hospitals array<struct<ccn:string,verdict:string,detail:string,line_count:bigint,headline:struct<ref:string>>>, comparisons array<struct<verdict:string>>")
    shown = F.transform("p.hospitals", lambda h: F.concat_ws(" ", h["ccn"], h["verdict"], h["detail"], h["line_count"].cast("string"), F.coalesce(h["headline"]["ref"], F.lit("-"))))
    return out.select("query", "zip", parsed.alias("p")).select(
        "query", "zip", "p.status", "p.error", F.coalesce(F.size("p.hospitals"), F.lit(0)).cast("bigint").alias("hospitals"), F.array_join(shown, "; ").alias("listed"), F.array_join(F.transform("p.comparisons", lambda c: c["verdict"]), ",").alias("compared"))


# Small pages, so that groups have several; every line of every page is compared.
@register("J21_with_all_lines", f"""{LINES}, {summarised('lines', _SUMMARY)}, placed AS (SELECT *, row_number() OVER (PARTITION BY extraction_id, service_id ORDER BY {LINE_ORDER}, gross, discounted_cash, minimum, maximum) AS place FROM lines)
    SELECT p.extraction_id, p.service_id, v.verdict, v.line_count, p.place, p.source_ref AS ref, p.code, CAST(p.discounted_cash AS DOUBLE) AS cash, CAST(p.gross AS DOUBLE) AS gross, true AS fits
    FROM placed p JOIN verdicts v USING (extraction_id, service_id)""")
def merged_lines(spark, folder):
    found = materialise(charge_lines(spark, folder), "lines", "zstd")  # read three times
    key, page_bytes = ["extraction_id", "service_id"], 2_000
    short = verdicts.summarise(found, key).join(verdicts.collected_lines(found, key, 2), key)
    merged = prices.with_all_lines(short, prices.line_pages(found, key, page_bytes), key)
    listed = F.from_json("lines", "array<struct<ref:string,code:string,cash:double,gross:double>>")
    opened = merged.select(*key, "verdict", "line_count", "first", (F.octet_length("lines") < page_bytes + 1_000).alias("fits"), F.posexplode(listed).alias("no", "line"))
    return opened.select(*key, "verdict", "line_count", (F.col("first") + F.col("no")).alias("place"), "line.*", "fits")


_BY_ID = "SELECT DISTINCT CAST(floor(s_suppkey / 6) AS BIGINT) AS search, 'H' || CAST(s_suppkey * (1 + s_suppkey % 2) AS VARCHAR) AS ccn, 'svc-' || CAST(200 - CAST(floor(s_suppkey / 6) AS BIGINT) % 230 AS VARCHAR) AS service_id FROM supplier"


# Hospitals and services asked for by id, some of which nobody has.
@register("F18_J20_prices_by_id", f"""{PRICED}, by_id AS ({_BY_ID}), named AS (SELECT b.*, h.ccn IS NOT NULL AS there, f.ok AS located, f.reason, f.mrf_url, c.extraction_id FROM by_id b LEFT JOIN d_raw_hospitals h ON h.ccn = b.ccn
    LEFT JOIN found f ON f.ccn = b.ccn LEFT JOIN current c ON c.url = f.mrf_url), id_lines AS (SELECT n.ccn, l.* REPLACE (coalesce(l.billing_class, CASE WHEN a.a.d = '' OR lower({duck.squeeze('a.a.d')}) = lower({duck.squeeze('l.description')}) THEN a.a.b END) AS billing_class)
    FROM named n JOIN lines l ON l.extraction_id = n.extraction_id AND l.service_id = n.service_id AND n.located LEFT JOIN answers a ON a.service_id = l.service_id AND a.ccn = n.ccn AND a.ref = l.source_ref), {summarised('id_lines', 'ccn, service_id', 'i_')},
    told AS (SELECT n.search, n.service_id, string_agg(n.ccn || ' ' || CASE WHEN NOT n.there OR n.located IS NULL THEN '{fv.NOT_LOOKED}' WHEN NOT n.located THEN '{fv.NO_FILE}' WHEN n.extraction_id IS NULL THEN '{fv.NOT_SCANNED}' ELSE coalesce(v.verdict, '{fv.NOT_FOUND}') END
        || ' ' || coalesce(v.line_count, 0) || ' ' || coalesce(CASE WHEN v.has_head THEN v.h_ref END, '-'), '; ' ORDER BY n.ccn) AS listed, min(CASE WHEN NOT n.there THEN 'no hospital with CCN ' || n.ccn END) AS unknown
        FROM named n LEFT JOIN i_verdicts v ON v.ccn = n.ccn AND v.service_id = n.service_id GROUP BY n.search, n.service_id)
    SELECT t.search, t.service_id, CASE WHEN s.id IS NULL OR t.unknown IS NOT NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN s.id IS NULL THEN 'no catalog entry with id ' || t.service_id ELSE t.unknown END AS error,
        CASE WHEN s.id IS NOT NULL AND t.unknown IS NULL THEN t.listed END AS listed FROM told t LEFT JOIN d_services s ON s.id = t.service_id""")
def by_id(spark, folder):
    views.load(spark, folder, "supplier")
    spark.read.parquet(f"{folder}/supplier.parquet").createOrReplaceTempView("supplier")
    out = prices.payloads_at(stored(spark, folder), spark.sql(_BY_ID.replace("VARCHAR", "STRING")), F.expr(AS_OF))
    parsed = F.from_json("payload", "status string, error string, hospitals array<struct<ccn:string,verdict:string,line_count:bigint,headline:struct<ref:string>>>")
    shown = F.transform("p.hospitals", lambda h: F.concat_ws(" ", h["ccn"], h["verdict"], h["line_count"].cast("string"), F.coalesce(h["headline"]["ref"], F.lit("-"))))
    return out.select("search", "service_id", parsed.alias("p")).select("search", "service_id", "p.status", "p.error", F.array_join(shown, "; ").alias("listed"))


@register("K14_answer_pages", f"""{PRICED}, sized AS (SELECT s.query, s.zip, r.service_id FROM (SELECT DISTINCT query, zip FROM searches) s JOIN resolved r ON r.query = s.query WHERE r.service_id IS NOT NULL)
    SELECT z.query, z.zip, x.ccn, count(*) AS lines, string_agg(l.source_ref, ',' ORDER BY l.code, l.modifiers NULLS FIRST, l.setting NULLS LAST, l.billing_class NULLS LAST, l.source_ref, l.code_type, l.description, l.gross, l.discounted_cash, l.minimum, l.maximum) AS refs
    FROM sized z JOIN results x ON x.query_zip = z.zip AND x.service_id = z.service_id JOIN answer_lines l ON l.ccn = x.ccn AND l.service_id = x.service_id GROUP BY ALL""")
def answer_pages(spark, folder):
    """Lines of every search, put together again from their pages."""
    pages = prices.answer_pages(stored(spark, folder), searches(spark, folder), K, F.expr(AS_OF), 1_500).filter("part > 0")
    lines_of = F.from_json("payload", "array<struct<ref:string>>")
    opened = pages.select("query", "zip", "ccn", "part", F.posexplode(lines_of).alias("no", "line"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "no", "line.ref"))), lambda x: x["ref"])
    return opened.groupBy("query", "zip", "ccn").agg(F.count("*").alias("lines"), F.array_join(in_order, ",").alias("refs"))
