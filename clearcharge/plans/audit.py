"""The accuracy numbers, kept apart: files located, stored rows true to their source,
comparisons possible, hospitals unresolved; and data-quality figures per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import cells, text, web
from clearcharge.operators import positions
from clearcharge.session import materialise


def located_by_method(discoveries: DataFrame) -> DataFrame:
    """(method, n) of located hospitals, with the totals on every row."""
    flagged = discoveries.withColumn("got", F.coalesce("ok", F.lit(False)))
    totals = flagged.agg(F.count_if("got").alias("located"), F.count("*").alias("of")).withColumn("_one", F.lit(1))
    return flagged.filter("got").groupBy("method").agg(F.count("*").alias("n")).withColumn("_one", F.lit(1)).join(totals, "_one").drop("_one")


def external_agreement(matched: DataFrame) -> DataFrame:
    """Overlap, agree and differ of our file hosts and an external index's. `matched`: mrf_url, url."""
    mine, theirs = web.host_of(F.col("mrf_url")), web.host_of(F.col("url"))
    same = F.coalesce(F.col("mrf_url").isNotNull() & web.same_domain(mine, theirs), F.lit(False))
    return matched.agg(F.count("*").alias("overlap"), F.count_if(same).alias("agree"), F.count_if(~same).alias("differ"))


def sample_charges(charges: DataFrame, n: int, seed: int) -> DataFrame:
    """The same `n` charges per extraction on every run: lowest hashes of seed and id."""
    drawn = F.row_number().over(Window.partitionBy("extraction_id").orderBy(F.xxhash64(F.lit(seed), F.col("charge_id")), F.col("charge_id")))
    return charges.withColumn("_draw", drawn).filter(F.col("_draw") <= n).drop("_draw")


def with_code_list(rows: DataFrame, item_codes: DataFrame) -> DataFrame:
    """Adds `code_values`: the item's codes in order. Codes come together in their tasks before the shuffle, and one list
    serves all rows that ask for it; rows are not looked through for their items first."""
    listed = item_codes.filter("extraction_id IS NOT NULL AND item_id IS NOT NULL").groupBy("extraction_id", "item_id").agg(F.array_sort(F.collect_list("code")).alias("code_values"))
    return rows.join(listed, ["extraction_id", "item_id"], "left")


def verify_sample(sampled: DataFrame, reread: DataFrame) -> DataFrame:
    """Sampled rows against the file read again, joined by (extraction, source_ref): found,
    matched. A row whose ref is gone is a failure, not a skip. Both sides carry code_values."""
    prices = ("gross", "discounted_cash", "minimum", "maximum")
    again = reread.select("extraction_id", "source_ref", F.struct(*prices, "setting", "modifiers", "code_values").alias("again"))
    joined = sampled.join(again, ["extraction_id", "source_ref"], "left")
    nothing = F.array().cast("array<string>")
    text_eq = lambda c: F.nullif(F.col(c), F.lit("")).eqNullSafe(F.nullif(F.col(f"again.{c}"), F.lit("")))
    codes_eq = F.array_sort(F.coalesce("code_values", nothing)) == F.array_sort(F.coalesce("again.code_values", nothing))
    same = text_eq("setting") & text_eq("modifiers") & codes_eq
    for c in prices:
        same = same & cells.price_eq(F.col(c), F.col(f"again.{c}"))
    found = F.col("again").isNotNull()
    return joined.withColumn("found", found).withColumn("matched", found & same)


def fidelity_per_file(verified: DataFrame) -> DataFrame:
    return verified.groupBy("extraction_id").agg(
        F.count("*").alias("sampled"), F.count_if("found").alias("checked"), F.count_if("matched").alias("matched"), F.count_if(~F.col("found")).alias("missing"))


def fidelity_totals(per_file: DataFrame) -> DataFrame:
    return per_file.agg(F.count("*").alias("files"), F.sum("sampled").alias("sampled"), F.sum("matched").alias("matched"), F.sum("missing").alias("missing"))


def verdict_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("verdict").agg(F.count("*").alias("n"))


def comparable_share(results: DataFrame) -> DataFrame:
    """Pairs of service and hospital, and the share comparable; no share without pairs."""
    return results.agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("verdict") == fv.COMPARABLE).cast("double")), 3).alias("comparable_share"))


def unresolved(discoveries: DataFrame, extracted: DataFrame) -> DataFrame:
    """Hospitals without usable rows: the stage that failed and why."""
    left = discoveries.join(extracted.select("ccn").distinct(), "ccn", "left_anti")
    found = F.coalesce("ok", F.lit(False))
    reason = F.when(found, F.lit("not extracted (off-template or not scanned)")).otherwise(F.coalesce(F.nullif("reason", F.lit("")), F.lit("no discovery run")))
    return left.select("ccn", text.short_name(F.col("name")).alias("hospital"), F.when(found, F.lit("extraction")).otherwise(F.lit("discovery")).alias("stage"), reason.alias("reason"))


def report(discoveries: DataFrame, per_file: DataFrame, results: DataFrame, extracted: DataFrame, path: str) -> None:
    """Sections under `path`: discovery, fidelity, comparison and share are small JSON files of totals; unresolved is
    a table in as many parts as it needs, a row per hospital. What several sections read is computed once."""
    discoveries = materialise(discoveries.select("ccn", "name", "ok", "method", "reason"), "report-discoveries")
    results = materialise(results.select("verdict"), "report-verdicts")
    sections = {
        "discovery": located_by_method(discoveries), "fidelity": fidelity_totals(per_file),
        "comparison": verdict_counts(results), "share": comparable_share(results)}
    for name, totals in sections.items():
        totals.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
    unresolved(discoveries, extracted).write.mode("overwrite").json(f"{path}/unresolved")


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    ddl = {
        "discovery": "method string, n bigint, located bigint, of bigint", "fidelity": "files bigint, sampled bigint, matched bigint, missing bigint",
        "comparison": "verdict string, n bigint", "share": "pairs bigint, comparable_share double", "unresolved": "ccn string, hospital string, stage string, reason string"}
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in ddl.items()}


# --- data quality per file --------------------------------------------------------------

def summary_conflicts(charges: DataFrame) -> DataFrame:
    """Contexts of one item that carry more than one set of prices."""
    context = ["extraction_id", "item_id", "setting", "billing_class", "modifiers"]
    prices = F.struct("gross", "discounted_cash", "minimum", "maximum")
    return charges.groupBy(*context).agg(F.count_distinct(prices).alias("price_sets")).filter("price_sets > 1")


def price_relations(charges: DataFrame) -> DataFrame:
    """Per extraction: how many charges have cash equal to gross, or half of it, and the mean ratio."""
    cash, gross = F.col("discounted_cash"), F.col("gross")
    both = cash.isNotNull() & gross.isNotNull() & (gross != 0)
    return charges.groupBy("extraction_id").agg(
        F.count_if(both).alias("priced"), F.count_if(both & (cash == gross)).alias("cash_is_gross"), F.count_if(both & (cash * 2 == gross)).alias("cash_is_half"),
        F.avg(F.when(both, cash.cast("double") / gross.cast("double"))).alias("mean_ratio"))


def price_spread(headlines: DataFrame) -> DataFrame:
    """Per service: lowest and highest cash headline and their ratio."""
    cash = F.col("headline.discounted_cash").cast("double")
    spread = headlines.groupBy("service_id").agg(F.count(cash).alias("hospitals"), F.min(cash).alias("low"), F.max(cash).alias("high"))
    return spread.withColumn("ratio", F.try_divide("high", "low"))


def spend_per_day(spend: DataFrame) -> DataFrame:
    """Recorded model cost per day with its running total. Days are few, calls are not: the
    window runs over the daily sums."""
    daily = spend.groupBy(F.to_date("called_at").alias("day")).agg(F.sum("usd").alias("usd"), F.count("*").alias("calls"))
    return daily.withColumn("so_far", F.sum("usd").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def listed_results(discoveries: DataFrame) -> DataFrame:
    """Discoveries with their place in a listing: located ones first, then by name, then by id."""
    late = ~F.coalesce("ok", F.lit(False))
    return positions.numbered(discoveries, [], [late, F.col("name"), F.col("ccn")], "place")


def reviewed_services(services: DataFrame) -> DataFrame:
    return services.agg(F.count_if("reviewed").alias("reviewed"), F.count("*").alias("services"))
