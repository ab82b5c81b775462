"""What the hospitals nearest a ZIP charge for a service, for whole batches of ZIPs and queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import billing_codes, text, web
from clearcharge.operators import latest, lines, places, positions, resolve, verdicts
from clearcharge.session import BROADCAST_KEYS, broadcast_if_small, materialise


@dataclass(frozen=True)
class Store:
    """The stored tables a price question reads."""

    hospitals: DataFrame
    zcta: DataFrame
    hospital_files: DataFrame
    fetches: DataFrame
    files: DataFrame
    extractions: DataFrame
    items: DataFrame
    item_codes: DataFrame
    charges: DataFrame
    services: DataFrame
    reviews: DataFrame


def line_for_reader(line: Column) -> Column:
    """A line as it travels in a result: prices as doubles only here, codes explained."""
    tokens = F.concat(F.array(F.concat_ws(" ", line["code_type"], line["code"])), F.coalesce(line["other_codes"], F.array().cast("array<string>")))
    return F.when(line.isNotNull(), F.struct(
        line["code_type"].alias("code_type"), line["code"].alias("code"), line["other_codes"].alias("other_codes"), line["description"].alias("description"),
        text.context_text(line["setting"], line["billing_class"], line["modifiers"], line["class_from_review"]).alias("context"),
        line["discounted_cash"].cast("double").alias("cash"), line["gross"].cast("double").alias("gross"), line["minimum"].cast("double").alias("min"),
        line["maximum"].cast("double").alias("max"), line["setting"].alias("setting"), line["billing_class"].alias("billing_class"),
        line["modifiers"].alias("modifiers"), line["source_ref"].alias("ref"), line["off_template_note"].alias("note"),
        billing_codes.explain_all(tokens).alias("explained")))


def service_for_reader(service: DataFrame) -> DataFrame:
    codes = billing_codes.code_list(F.col("codes"))
    tokens = F.transform("codes", lambda c: F.concat_ws(" ", c["type"], c["code"]))
    return service.select("id", F.struct("id", "name", codes.alias("codes"), "reviewed", "notes", billing_codes.explain_all(tokens).alias("explained")).alias("service"))


def located_files(store: Store, hospitals: DataFrame, as_of: Column) -> DataFrame:
    """Hospitals with their latest discovery and the extraction behind it, left-joined; read
    path, so an old discovery still counts."""
    found = latest.cached_discovery(store.hospital_files, as_of, within_ttl=False).select(
        "ccn", F.col("ok").alias("located"), F.col("reason").alias("why_not"), "mrf_url", "stale")
    current = latest.latest_extraction(store.fetches, store.extractions, store.files).select(
        F.col("url").alias("mrf_url"), "extraction_id", "last_updated_on")
    return hospitals.join(found, "ccn", "left").join(current, "mrf_url", "left")


def _asked(store: Store, wanted: DataFrame, hospitals: DataFrame, as_of: Column) -> DataFrame:
    """The (ccn, service_id) pairs with the hospital's file and its extraction."""
    with_files = located_files(store, hospitals, as_of).withColumn("shown_name", text.short_name(F.col("name")))
    return materialise(wanted.select("ccn", "service_id").distinct().join(with_files, "ccn"), "asked")


def _reviewed_lines(store: Store, asked: DataFrame) -> DataFrame:
    """Charge lines of the asked pairs with review answers applied, written once."""
    needed = materialise(asked.filter(F.col("extraction_id").isNotNull() & F.col("located")).select("extraction_id").distinct(), "extractions-needed")
    needed = broadcast_if_small(needed, BROADCAST_KEYS)  # else three whole tables are shuffled to be cut
    services = store.services.join(asked.select(F.col("service_id").alias("id")).distinct(), "id", "left_semi")
    found = lines.charge_lines(
        store.charges.join(needed, "extraction_id", "left_semi"), store.items.join(needed, "extraction_id", "left_semi"),
        store.item_codes.join(needed, "extraction_id", "left_semi"), lines.service_codes(services))
    per_hospital = asked.filter("located").select("ccn", "service_id", "extraction_id", F.col("shown_name").alias("hospital")).join(found, ["extraction_id", "service_id"])
    return materialise(lines.apply_review(per_hospital, store.reviews), "lines")


def hospital_prices(store: Store, wanted: DataFrame, hospitals: DataFrame, as_of: Column, shown: int = fv.SHOWN_LINES,
                    failed: DataFrame | None = None) -> DataFrame:
    """One row per (hospital, service): a status that says why there is nothing, or the verdict.

    `wanted`: (ccn, service_id) pairs to answer. `failed`: ccn, status, detail of files that
    could not be read or were past a cap. Lines are found once per extraction and service,
    however many ZIPs or hospitals share the file."""
    asked = _asked(store, wanted, hospitals, as_of)
    return _hospital_prices(asked, _reviewed_lines(store, asked), shown, failed)


def _hospital_prices(asked: DataFrame, reviewed: DataFrame, shown: int, failed: DataFrame | None) -> DataFrame:
    """`reviewed` is read twice: verdicts and shown lines."""
    summary = verdicts.summarise(reviewed, ["ccn", "service_id"])
    # A few lines travel with each result; all of them are pages (`line_pages`).
    collected = verdicts.collected_lines(reviewed, ["ccn", "service_id"], shown)
    rows = asked.join(summary, ["ccn", "service_id"], "left").join(collected, ["ccn", "service_id"], "left")
    if failed is not None:
        rows = rows.join(failed.select("ccn", F.col("status").alias("failed_status"), F.col("detail").alias("failed_detail")), "ccn", "left")
    else:
        rows = rows.withColumn("failed_status", F.lit(None).cast("string")).withColumn("failed_detail", F.lit(None).cast("string"))
    status = text.first_matching([
        (F.col("failed_status").isNotNull(), F.col("failed_status")), (F.col("located").isNull(), F.lit(fv.NOT_LOOKED)), (~F.col("located"), F.lit(fv.NO_FILE)),
        (F.col("extraction_id").isNull(), F.lit(fv.NOT_SCANNED))], F.coalesce("verdict", F.lit(fv.NOT_FOUND)))
    detail = text.first_matching([
        (F.col("failed_status").isNotNull(), F.coalesce("failed_detail", F.lit(""))), (F.col("located").isNull(), F.lit("locate the file first")),
        (~F.col("located"), web.short_reason(F.col("why_not"))), (F.col("extraction_id").isNull(), F.lit(""))], F.coalesce("detail", F.lit("")))
    silent = F.col("failed_status").isNotNull()
    return rows.select(
        "ccn", "service_id", F.col("shown_name").alias("name"), "hospital_type", F.col("mrf_url").alias("url"),
        F.when(~silent, F.col("last_updated_on")).alias("file_date"), status.alias("verdict"), detail.alias("detail"),
        F.when(silent, F.lit(0)).otherwise(F.coalesce("line_count", F.lit(0))).alias("line_count"), F.when(~silent, F.col("headline")).alias("headline"),
        F.when(silent | F.col("lines").isNull(), F.array()).otherwise(F.col("lines")).alias("lines"))


def all_lines(store: Store, wanted: DataFrame, as_of: Column) -> DataFrame:
    """Every matching line of the (ccn, service_id) pairs that asked for them, as rows."""
    return _reviewed_lines(store, _asked(store, wanted, store.hospitals, as_of))


PAGE_BYTES = 1_000_000


def line_pages(found: DataFrame, keys: list[str], page_bytes: int = PAGE_BYTES, part_rows: int | None = None) -> DataFrame:
    """keys, page (from 0), first (place of its first line), n, lines: every line of each key in order, as JSON arrays
    of about `page_bytes` each. A page begins once the lines before it fill the ones before, so however many lines a
    key has, no row is longer than a page and one line; places and sizes are added up over ranges of the lines."""
    # A line's text is several times its fields: lines are dealt as fields, with the size their text will have.
    text_of = lambda line: F.to_json(line_for_reader(line), {"ignoreNullFields": "false"})
    order = [*verdicts.line_order(), *[F.col(c).asc_nulls_last() for c in ("gross", "discounted_cash", "minimum", "maximum")]]
    size = F.octet_length(text_of(verdicts.line_struct())) + 1
    placed = positions.numbered(found.select(*keys, *verdicts.LINE_FIELDS), keys, order, "place", part_rows, size, "ahead")
    paged = placed.select(*keys, "place", verdicts.line_struct().alias("line"), F.floor(F.col("ahead") / page_bytes).alias("filled"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: text_of(s["line"]))
    pages = paged.groupBy(*keys, "filled").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.concat(F.lit("["), F.array_join(in_order, ","), F.lit("]")).alias("lines"))
    return pages.withColumn("page", F.row_number().over(Window.partitionBy(*keys).orderBy("filled")) - 1).drop("filled")


def with_all_lines(results: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """A row per result and page of its lines, in place of the few lines shown; verdict, headline and count stay as
    they were. A result without lines has one row without a page."""
    return results.drop("lines").join(pages, keys, "left")


def answer_pages(store: Store, searches: DataFrame, limit: int, as_of: Column, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(query, zip, part, ccn, payload): part 0 is the search's payload, the others are all lines of its hospitals,
    nearest first, page by page."""
    resolutions, results, reviewed = _prices(store, searches, limit, as_of, None, fv.SHOWN_LINES)
    results = materialise(results, "results")  # read by payloads and pages, as the lines are by answers and pages
    told = materialise(_payloads(store, searches, resolutions, results), "payloads")
    placed = materialise(results.select("query_zip", "service_id", "rank", "ccn").distinct(), "places-answered")
    pages = materialise(line_pages(reviewed, ["ccn", "service_id"], page_bytes), "line-pages")
    asked = searches.select("query", "zip").distinct().join(resolutions.filter("service_id IS NOT NULL").select("query", "service_id"), "query")
    listed = asked.join(placed, (F.col("zip") == F.col("query_zip")) & (asked["service_id"] == placed["service_id"])).select("query", "zip", placed["service_id"], "rank", "ccn").join(pages, ["ccn", "service_id"])
    part = F.row_number().over(Window.partitionBy("query", "zip").orderBy("rank", "page"))
    more = listed.select("query", "zip", part.alias("part"), "ccn", "lines")
    return told.select("query", "zip", F.lit(0).alias("part"), F.lit(None).cast("string").alias("ccn"), "payload").unionByName(more.withColumnRenamed("lines", "payload"))


def prices(store: Store, searches: DataFrame, limit: int, as_of: Column, failed: DataFrame | None = None, shown: int = fv.SHOWN_LINES) -> tuple[DataFrame, DataFrame]:
    """(resolutions, results) of a batch of searches (query, zip). ZIPs the gazetteer does not list have no results
    (`places.unknown_zips` names them; `payloads` answers them with an error).

    Distinct queries are resolved once, distinct ZIPs located once, each (hospital, service)
    is answered once, and the answers are joined back to the searches."""
    return _prices(store, searches, limit, as_of, failed, shown)[:2]


def _prices(store: Store, searches: DataFrame, limit: int, as_of: Column, failed: DataFrame | None, shown: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same, and the lines behind the answers."""
    resolutions = materialise(resolve.resolve(searches.select("query"), store.services), "resolutions")
    ranked = places.nearest_hospitals(store.hospitals, store.zcta, searches.select("zip"), limit)
    chosen = resolutions.filter(F.col("service_id").isNotNull()).select("query", "service_id")
    asked = searches.select("query", "zip").distinct().join(chosen, "query").select("service_id", F.col("zip").alias("query_zip")).distinct()
    near = ranked.select("query_zip", "rank", "ccn", "distance_km", "approximate")
    places_asked = materialise(asked.join(near, "query_zip"), "places-asked")
    with_files = _asked(store, places_asked, store.hospitals, as_of)
    reviewed = _reviewed_lines(store, with_files)
    answers = _hospital_prices(with_files, reviewed, shown, failed)
    results = places_asked.join(answers, ["ccn", "service_id"]).withColumn("distance_km", F.round("distance_km", 1))
    return resolutions, results, reviewed


def prices_at(store: Store, asked: DataFrame, as_of: Column, failed: DataFrame | None = None, shown: int = fv.SHOWN_LINES) -> DataFrame:
    """Results for hospitals and services given by id: `asked` has ccn and service_id. No distance is known."""
    pairs = materialise(asked.select("ccn", "service_id").distinct(), "asked-by-id")
    named = places.hospitals_by_id(store.hospitals, pairs).select("ccn", "approximate", F.col("reason").alias("unknown"))
    answers = hospital_prices(store, pairs, store.hospitals, as_of, shown, failed=failed)
    return pairs.join(named, "ccn", "left").join(answers, ["ccn", "service_id"], "left").withColumn("distance_km", F.lit(None).cast("double"))


def payloads_at(store: Store, asked: DataFrame, as_of: Column, shown: int = fv.SHOWN_LINES) -> DataFrame:
    """(search, service_id, payload) for hospitals and services given by id (`asked`: search, ccn, service_id); the
    hospitals of a search stand in order of their id, without a distance. A hospital or a service nobody has makes the
    answer an error that names it."""
    key = ["search", "service_id"]
    results = asked.select(*key, "ccn").distinct().join(prices_at(store, asked, as_of, shown=shown), ["ccn", "service_id"])
    ranked = materialise(results.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("ccn"))), "results-by-id")
    listed = ranked.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", _result_for_reader().alias("row"))), lambda x, y: x["rank"] - y["rank"]), lambda r: r["row"]).alias("hospitals"),
        F.min("unknown").alias("unknown"))
    pairs = verdicts.priced_pairs(ranked, key).select(*key, F.col("pairs").alias("comparisons"), "unpriced")
    joined = listed.join(pairs, key, "left").join(service_for_reader(store.services).withColumnRenamed("id", "service_id"), "service_id", "left")
    error = F.coalesce(F.when(F.col("service").isNull(), F.concat(F.lit("no catalog entry with id "), F.col("service_id"))), F.col("unknown"))
    ok = error.isNull()
    return joined.select(*key, F.to_json(F.struct(
        F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"), error.alias("error"), "service",
        *[F.when(ok, F.coalesce(c, F.array())).alias(c) for c in ("hospitals", "comparisons", "unpriced")]), {"ignoreNullFields": "false"}).alias("payload"))


def _result_for_reader() -> Column:
    return F.struct(
        "ccn", "name", "distance_km", "approximate", "hospital_type", "url", "file_date", "verdict", "detail", "line_count",
        line_for_reader(F.col("headline")).alias("headline"), F.transform("lines", line_for_reader).alias("lines"))


def payloads(store: Store, searches: DataFrame, limit: int, as_of: Column, shown: int = fv.SHOWN_LINES) -> DataFrame:
    """One JSON payload per search: ok with results and pairs, the candidates to choose from, or an error for a ZIP
    that is not listed. Absent values are written as null."""
    resolutions, results = prices(store, searches, limit, as_of, shown=shown)
    return _payloads(store, searches, resolutions, materialise(results, "results"))


def _payloads(store: Store, searches: DataFrame, resolutions: DataFrame, results: DataFrame) -> DataFrame:
    unknown = places.unknown_zips(searches.select("zip"), store.zcta).select("zip", F.col("reason").alias("error"))
    pairs = verdicts.priced_pairs(results, ["query_zip", "service_id"]).select("query_zip", "service_id", F.col("pairs").alias("comparisons"), "unpriced")
    hospitals = results.groupBy("query_zip", "service_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", _result_for_reader().alias("row"))), lambda x, y: x["rank"] - y["rank"]), lambda r: r["row"]).alias("hospitals"))
    said = searches.select("query", "zip").distinct().join(resolutions, "query")
    joined = (
        said.join(service_for_reader(store.services).withColumnRenamed("id", "service_id"), "service_id", "left")
        .withColumn("query_zip", F.col("zip")).join(hospitals, ["query_zip", "service_id"], "left").join(pairs, ["query_zip", "service_id"], "left").join(unknown, "zip", "left"))
    selected = F.col("service_id").isNotNull()
    resolver = F.when(F.col("verdict") != fv.SELECTED, F.struct("verdict", "reason"))
    listed = F.col("error").isNull()
    ok = selected & listed
    nothing = lambda c: F.when(ok, F.coalesce(F.col(c), F.array()))
    return joined.select("query", "zip", F.to_json(F.struct(
        F.when(selected & ~listed, F.lit("error")).when(selected, F.lit("ok")).otherwise(F.lit("needs_clarification")).alias("status"), "error", resolver.alias("resolver"), "corrections",
        F.when(selected, F.col("service")).alias("service"), F.when(~selected, F.col("candidates")).alias("candidates"),
        nothing("hospitals").alias("hospitals"), nothing("comparisons").alias("comparisons"), nothing("unpriced").alias("unpriced")),
        {"ignoreNullFields": "false"}).alias("payload"))
