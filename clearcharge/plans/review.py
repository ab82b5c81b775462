"""Review sheets: export with old answers kept, and answers read back into the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import text
from clearcharge.sources.reference_data import ANSWER_COLUMNS, answered


def review_sheet(results: DataFrame, previous: DataFrame) -> DataFrame:
    """One row per service and hospital with the headline, and the answers already given.
    `results`: query, service_id, service, codes, hospital, ccn, verdict, line_count, headline, file_date, url."""
    h = lambda name: F.coalesce(F.col(f"headline.{name}"), F.lit(""))
    context = F.when(F.col("headline").isNotNull(), text.context_text(F.col("headline.setting"), F.col("headline.billing_class"), F.col("headline.modifiers"), F.col("headline.class_from_review")))
    sheet = results.select(
        "query", "service_id", "service", "codes", "hospital", "ccn", "verdict", F.col("line_count").alias("lines"),
        h("description").alias("headline_description"), F.coalesce(context, F.lit("")).alias("headline_context"),
        text.cents_text(F.col("headline.discounted_cash")).alias("cash"), text.cents_text(F.col("headline.gross")).alias("gross"),
        text.cents_text(F.col("headline.minimum")).alias("min"), text.cents_text(F.col("headline.maximum")).alias("max"), h("source_ref").alias("ref"),
        F.coalesce("file_date", F.lit("")).alias("file_date"), "url")
    old = previous.select("query", "hospital", *ANSWER_COLUMNS).dropDuplicates(["query", "hospital"])
    joined = sheet.join(old, ["query", "hospital"], "left")
    return joined.select(*sheet.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in ANSWER_COLUMNS])


def _said(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def review_decisions(sheet: DataFrame) -> DataFrame:
    """Per service: confirmed when any row says the alias means it, with the evidence; the
    reasons otherwise. `sheet` carries row_no, the row's place in the file."""
    rows = answered(sheet)
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("row_no", value.alias("v")))), lambda r: r["v"])
    blank_null = lambda c: F.nullif(c, F.lit(""))
    evidence = F.struct(
        "hospital", blank_null(F.lower(_said("headline_is_this_service"))).alias("headline_is_this_service"),
        blank_null(_said("billing_class_if_known")).alias("billing_class"), blank_null(_said("note")).alias("note"), "ref",
        blank_null(_said("headline_description")).alias("description"))
    reason = F.concat(F.col("hospital"), F.lit(": "), F.coalesce(blank_null(F.col("alias_means_this_service")), F.col("note"), F.lit("")))
    first = lambda c: F.coalesce(F.min_by(blank_null(F.col(c)), F.when(blank_null(F.col(c)).isNotNull(), F.col("row_no"))), F.lit("")).alias(c)
    return rows.groupBy("service_id").agg(
        F.max(F.lower(_said("alias_means_this_service")) == "yes").alias("confirmed"), first("reviewer"), first("date"),
        ordered(evidence).alias("hospitals"), F.array_join(ordered(reason), "; ").alias("reasons"))


def apply_decisions(services: DataFrame, decisions: DataFrame) -> DataFrame:
    """Catalog with `reviewed`, `evidence` (JSON) and `notes` as the review left them."""
    d = decisions.select(F.col("service_id").alias("id"), "confirmed", F.to_json(F.struct(
        "reviewer", "date", F.col("confirmed").alias("alias_confirmed"), "hospitals")).alias("review"), "reasons")
    joined = services.join(d, "id", "left")
    note = F.concat(F.coalesce("notes", F.lit("")), F.when(F.coalesce("notes", F.lit("")) != "", F.lit(" ")).otherwise(F.lit("")), F.lit("Review: alias not confirmed: "), F.col("reasons"))
    had = F.col("evidence") if "evidence" in services.columns else F.lit(None).cast("string")
    return joined.select(
        *[c for c in services.columns if c not in ("reviewed", "notes", "evidence")],
        F.coalesce("confirmed", "reviewed").alias("reviewed"), F.when(F.col("confirmed").isNull(), had).when(F.col("confirmed"), F.col("review")).alias("evidence"),
        F.when(F.col("confirmed") == F.lit(False), note).otherwise(F.col("notes")).alias("notes"))


def review_rows(decisions: DataFrame) -> DataFrame:
    """Confirmed services' answers as rows to apply to lines."""
    opened = decisions.filter("confirmed").select("service_id", "reviewer", "date", F.posexplode("hospitals").alias("seq", "h"))
    return opened.select("service_id", "seq", "h.*", "reviewer", "date")


def unfounded_reviews(services: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed services without reviewer, date or a ref behind a billing class. Empty when all is well."""
    flawed = reviews.groupBy(F.col("service_id").alias("id")).agg(F.max(
        (F.coalesce("reviewer", F.lit("")) == "") | (F.coalesce("date", F.lit("")) == "")
        | ((F.coalesce("billing_class", F.lit("")) != "") & (F.coalesce("ref", F.lit("")) == ""))).alias("flawed"))
    return services.filter("reviewed").join(flawed, "id", "left").filter(F.coalesce("flawed", F.lit(True))).select("id", "name")


def verdicts_per_service(results: DataFrame) -> DataFrame:
    """Services against verdicts, counted."""
    kinds = [fv.COMPARABLE, fv.UNKNOWN_CLASS, fv.UNKNOWN_SETTING, fv.MODIFIERS_ONLY, fv.NEGOTIATED_ONLY, fv.PROFESSIONAL_ONLY, fv.CONFLICTING,
             fv.INPATIENT_ONLY, fv.OUTPATIENT_ONLY, fv.NOT_FOUND]
    return results.groupBy("service_id").pivot("verdict", kinds).count().na.fill(0)
