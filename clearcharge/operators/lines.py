"""Charge lines for services: charges joined to items and matched codes, review answers applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import billing_codes, text
from clearcharge.session import broadcast_if_small


def service_codes(services: DataFrame) -> DataFrame:
    """(service_id, code, setting_expected): one row per distinct code of a service. A
    catalog code's own type is not compared, only the file's."""
    return services.select(
        F.col("id").alias("service_id"), billing_codes.expected_setting(F.col("codes")).alias("setting_expected"),
        F.explode(F.array_distinct(F.transform("codes", lambda c: c["code"]))).alias("code"))


def matched_items(item_codes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items that carry a wanted code, with the matched code and the item's other codes.

    Codes come together once per item, those of a task before the shuffle; the wanted ones are marked on the map side
    where their list is small."""
    asked = broadcast_if_small(wanted.select("code").distinct().withColumn("asked", F.lit(True)))
    typed = F.col("code_type").isin(*fv.SERVICE_CODE_TYPES)
    of_items = item_codes.filter("extraction_id IS NOT NULL AND item_id IS NOT NULL")
    known = of_items.join(asked, "code", "left").withColumn("asked", F.coalesce("asked", F.lit(False)) & typed)
    per_item = known.groupBy("extraction_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("code_type", "code", "asked"))).alias("all_codes"))
    hits = per_item.select("extraction_id", "item_id", "all_codes", F.inline(F.filter("all_codes", lambda c: c["asked"]))).drop("asked")
    rest = F.filter("all_codes", lambda c: ~((c["code_type"] == F.col("code_type")) & (c["code"] == F.col("code"))))
    listed = F.transform(rest, lambda c: F.concat_ws(" ", c["code_type"], c["code"]))
    return hits.withColumn("other_codes", listed).drop("all_codes").join(wanted, "code")


def charge_lines(charges: DataFrame, items: DataFrame, item_codes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per (charge, matched code). `wanted` has code, service_id and setting_expected;
    an item with two matching codes yields two lines."""
    found = matched_items(item_codes, wanted)
    described = found.join(items.select("extraction_id", "item_id", "description"), ["extraction_id", "item_id"])
    return (
        charges.join(described, ["extraction_id", "item_id"])
        .select("extraction_id", "service_id", "setting_expected", "code_type", "code", "other_codes", "description", "setting",
                "billing_class", "modifiers", "gross", "discounted_cash", "minimum", "maximum", "source_ref", "off_template_note",
                F.lit(False).alias("class_from_review")))


def apply_review(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """Fill in a billing class a reviewer confirmed for this hospital's line. The file's own
    value wins, and the answer must still fit the line's description.

    `lines` has service_id and hospital; `answers` has REVIEWS columns."""
    usable = answers.filter(
        (F.coalesce("billing_class", F.lit("")) != "") & (F.coalesce("ref", F.lit("")) != "")
        & (F.coalesce(F.nullif("headline_is_this_service", F.lit("")), F.lit("yes")) == "yes"))
    # A later answer for the same line replaces an earlier one.
    order = F.col("seq") if "seq" in answers.columns else F.struct("billing_class", "description")
    latest = usable.groupBy("service_id", "hospital", F.col("ref").alias("source_ref")).agg(
        F.max_by(F.struct(F.col("billing_class"), text.squeeze_lower(F.col("description")).alias("described")), order).alias("answer"))
    fits = (F.col("answer.described") == "") | (F.col("answer.described") == text.squeeze_lower(F.col("description")))
    confirmed = F.when(F.col("billing_class").isNull() & fits, F.col("answer.billing_class"))
    joined = lines.join(latest, ["service_id", "hospital", "source_ref"], "left").withColumn("confirmed", confirmed)
    return (
        joined.withColumn("class_from_review", F.col("confirmed").isNotNull())
        .withColumn("billing_class", F.coalesce("billing_class", "confirmed")).drop("answer", "confirmed"))
