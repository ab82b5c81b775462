"""From charge lines to one headline and a verdict per (hospital, service), and from two
headlines to a verdict on the pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import billing_codes, text

LINE_FIELDS = ("code_type", "code", "other_codes", "description", "setting", "billing_class", "modifiers", "gross",
               "discounted_cash", "minimum", "maximum", "source_ref", "off_template_note", "class_from_review")


def line_struct() -> Column:
    return F.struct(*[F.col(c) for c in LINE_FIELDS])


def line_order() -> list[Column]:
    """Code, plain before modified, then setting and class with unstated last, then the ref as text."""
    return [F.col("code").asc_nulls_last(), F.col("modifiers").asc_nulls_first(), F.col("setting").asc_nulls_last(),
            F.col("billing_class").asc_nulls_last(), F.col("source_ref").asc_nulls_last(), F.col("code_type").asc_nulls_last(),
            F.col("description").asc_nulls_last()]


# Fields of the order; the others follow them in a line that is picked, so none travels twice.
_ORDERED = ("code", "modifiers", "setting", "billing_class", "source_ref", "code_type", "description")


def _in_line_order(*first: Column) -> Column:
    """A line as a struct that compares by `first`, then in the same order, then by its other fields (a NULL field
    sorts first inside a struct, so those that sort last have a flag before them)."""
    last = lambda name: [F.col(name).isNull().alias(f"{name}_last"), F.col(name)]
    ordered = [c for name in _ORDERED for c in ([F.col(name)] if name == "modifiers" else last(name))]
    return F.struct(*first, *ordered, *[F.col(name) for name in LINE_FIELDS if name not in _ORDERED])


def _line_of(picked: Column) -> Column:
    return F.when(picked.isNotNull(), F.struct(*[picked[name].alias(name) for name in LINE_FIELDS]))


def plain() -> Column:
    return F.col("modifiers").isNull() & (F.col("billing_class").isNull() | F.col("billing_class").isin("facility", "both"))


def has_price() -> Column:
    return F.col("discounted_cash").isNotNull() | F.col("gross").isNotNull()


def summarise(lines: DataFrame, keys: Sequence[str], setting: str = "setting_expected") -> DataFrame:
    """One row per key: verdict, detail, headline, line_count.

    One hash-partial aggregation: counts and distinct prices for the fitting lines and for
    all plain lines side by side, the verdict decided from them. A group of any size is
    reduced map-side; only its distinct prices and one headline candidate travel."""
    fits = F.col("setting").isNull() | (F.col("setting") == F.col(setting)) | (F.col("setting") == "both")
    flagged = lines.select(
        *keys, F.col(setting).alias("_want"), *LINE_FIELDS,
        (plain() & has_price()).alias("_plain"), (plain() & has_price() & fits).alias("_fit"),
        (F.col("modifiers").isNotNull() & has_price()).alias("_mod"),
        (has_price() & F.coalesce(F.col("billing_class") == "professional", F.lit(False))).alias("_prof"))

    fitting = F.coalesce("_fit", F.lit(False))

    def distinct(price: str) -> Column:
        """Its different values, each with whether a fitting line has it."""
        return F.collect_set(F.when(F.col("_plain") & F.col(price).isNotNull(), F.struct(fitting.alias("fit"), F.col(price).alias("v")))).alias(f"_{price}")

    # Fitting lines come first, so the first of them, or of all plain ones if none fits, is the least.
    first = F.min(F.when(F.col("_plain"), _in_line_order((~fitting).alias("misfit"), F.col("discounted_cash").isNull().alias("no_cash")))).alias("_first")
    grouped = flagged.groupBy(*keys).agg(
        F.count("*").alias("line_count"), F.first("_want").alias("_want"), F.count_if(F.col("_mod")).alias("mod_n"),
        F.count_if(F.col("_prof")).alias("prof_n"), F.count_if(F.col("_fit")).alias("_fit_n"), F.count_if(F.col("_plain")).alias("plain_n"),
        F.array_sort(F.collect_set(F.when(F.col("_mod"), F.col("modifiers")))).alias("mods"),
        distinct("discounted_cash"), distinct("gross"), first)
    use_fit = F.col("_fit_n") > 0
    among = lambda price: F.array_sort(F.array_distinct(F.transform(F.filter(price, lambda x: x["fit"] | ~use_fit), lambda x: x["v"])))
    chosen = grouped.select(
        *keys, "line_count", "_want", "mod_n", "prof_n", "mods", use_fit.alias("fitting"), "plain_n",
        F.when(use_fit, F.col("_fit_n")).otherwise(F.col("plain_n")).alias("n"), among("_discounted_cash").alias("cash"),
        among("_gross").alias("gross"), _line_of(F.col("_first")).alias("first"))
    return _decide(chosen, keys)


def _money_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit("$"), text.grouped(v, 2))), ", ")


def _decide(g: DataFrame, keys: Sequence[str]) -> DataFrame:
    cash_n, gross_n, n = F.size("cash"), F.size("gross"), F.col("line_count")
    no_plain = F.col("plain_n") == 0
    professional = no_plain & (F.col("mod_n") == 0) & (F.col("prof_n") > 0)
    negotiated = no_plain & (F.col("mod_n") == 0)
    conflicting = (cash_n > 1) | ((cash_n == 0) & (gross_n > 1))
    headline = F.when(~no_plain & ~conflicting, F.col("first"))
    unclassed, unset = headline["billing_class"].isNull(), headline["setting"].isNull()
    other = F.when(F.col("_want") == "outpatient", F.lit("inpatient")).otherwise(F.lit("outpatient"))

    verdict = text.first_matching([
        (professional, F.lit(fv.PROFESSIONAL_ONLY)), (negotiated, F.lit(fv.NEGOTIATED_ONLY)), (no_plain, F.lit(fv.MODIFIERS_ONLY)),
        (conflicting, F.lit(fv.CONFLICTING)),
        (~F.col("fitting") & (other == "inpatient"), F.lit(fv.INPATIENT_ONLY)), (~F.col("fitting"), F.lit(fv.OUTPATIENT_ONLY)),
        (unclassed, F.lit(fv.UNKNOWN_CLASS)), (unset, F.lit(fv.UNKNOWN_SETTING)),
    ], F.lit(fv.COMPARABLE))

    stop = text.first_matching([
        (professional, F.concat(text.plural(F.col("prof_n"), "priced line"), F.when(F.col("prof_n") == 1, F.lit(" carries")).otherwise(F.lit(" carry")),
                                F.lit(" the professional charge only"))),
        (negotiated, F.concat(text.plural(n, "line"), F.lit(", each with negotiated min/max only"))),
        (no_plain, F.concat(F.lit("priced lines carry modifiers "), F.array_join("mods", ", "), F.lit("; no unmodified line to compare"))),
        (conflicting, F.concat(
            F.col("n").cast("string"), F.lit(" unmodified lines disagree ("), F.when(cash_n > 1, F.lit("cash ")).otherwise(F.lit("gross ")),
            _money_list(F.when(cash_n > 1, F.col("cash")).otherwise(F.col("gross"))), F.lit(")"))),
    ], F.lit(None).cast("string"))
    said = text.first_matching([
        (~F.col("fitting"), F.concat(F.lit("only an "), other, F.lit(" line is priced; this service is priced as "), F.col("_want"),
                                     F.lit(", so no comparison"))),
        (gross_n > 1, F.concat(F.lit("cash agrees; gross charges differ ("), _money_list(F.col("gross")), F.lit(")"))),
        (unclassed, F.lit("the file does not say whether this is a facility or professional charge")),
        (unset, F.lit("the file does not say whether this is an inpatient or outpatient charge")),
    ], F.lit(None).cast("string"))
    others = F.when(n > 1, F.concat(text.plural(n - 1, "other line"), F.lit(" for this code (modifiers, revenue centers or payer-only rates)")))
    return g.select(*keys, verdict.alias("verdict"), F.coalesce(stop, F.concat_ws("; ", said, others)).alias("detail"),
                    headline.alias("headline"), F.col("line_count"))


def shown_lines(lines: DataFrame, keys: Sequence[str], limit: int = fv.SHOWN_LINES) -> DataFrame:
    """The first `limit` lines per key with their place."""
    ranked = lines.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*line_order())))
    return ranked.filter(F.col("place") <= limit)


def collected_lines(lines: DataFrame, keys: Sequence[str], limit: int = fv.SHOWN_LINES) -> DataFrame:
    """The first `limit` lines per key as an array."""
    top = shown_lines(lines, keys, limit)
    listed = F.array_sort(F.collect_list(F.struct("place", line_struct().alias("line"))))
    return top.groupBy(*keys).agg(F.transform(listed, lambda s: s["line"]).alias("lines"))


# --- pairs ------------------------------------------------------------------------------

def pair_verdict(name_a: Column, a: Column, name_b: Column, b: Column) -> Column:
    """struct(verdict, detail) of putting two headlines side by side. A context either side
    does not state is never a match."""
    missing = lambda name: F.concat(name, F.lit(" has no priced line for this service"))
    def unstated(name: Column, line: Column) -> list[Column]:
        return [F.when(line[field].isNull(), F.concat(name, F.lit(f"'s row has no {shown}")))
                for field, shown in (("setting", "setting"), ("billing_class", "billing class"))]

    silent = F.concat_ws("; ", *unstated(name_a, a), *unstated(name_b, b))
    coded = lambda line: F.coalesce(line["code_type"] != "", F.lit(False)) & F.coalesce(line["code"] != "", F.lit(False))
    same_code = (a["code"] == b["code"]) & (billing_codes.code_family(a["code_type"]) == billing_codes.code_family(b["code_type"]))
    mod = lambda line: F.nullif(line["modifiers"], F.lit(""))
    differences = F.concat_ws(
        "; ",
        F.when(coded(a) & coded(b) & ~same_code, F.concat(
            F.lit("different codes ("), a["code_type"], F.lit(" "), a["code"], F.lit(" vs "), b["code_type"], F.lit(" "), b["code"], F.lit(")"))),
        F.when((a["setting"] != b["setting"]) & (a["setting"] != "both") & (b["setting"] != "both"),
               F.concat(a["setting"], F.lit(" vs "), b["setting"])),
        F.when(a["billing_class"] != b["billing_class"], F.concat(a["billing_class"], F.lit(" vs "), b["billing_class"], F.lit(" charge"))),
        F.when(~mod(a).eqNullSafe(mod(b)), F.concat(
            F.lit("modifiers "), F.coalesce(mod(a), F.lit("none")), F.lit(" vs "), F.coalesce(mod(b), F.lit("none")))))
    shared = F.concat_ws(", ", F.nullif(a["setting"], F.lit("")), F.nullif(a["billing_class"], F.lit("")),
                         F.coalesce(F.concat(F.lit("mod "), mod(a)), F.lit("no modifiers")))
    verdict = lambda v, d: F.struct(F.lit(v).alias("verdict"), d.alias("detail"))
    return text.first_matching([
        (a.isNull(), verdict(fv.UNKNOWN_PAIR, missing(name_a))), (b.isNull(), verdict(fv.UNKNOWN_PAIR, missing(name_b))),
        (silent != "", verdict(fv.UNKNOWN_PAIR, silent)), (differences != "", verdict(fv.NOT_COMPARABLE, differences)),
    ], verdict(fv.COMPARABLE, shared))


def pair_list(results: Column) -> Column:
    """Every pair of an array of results once, in the array's order. The array is one
    search's nearest-k list, so its length is the search limit."""
    def with_later(first: Column, i: Column) -> Column:
        later = F.slice(results, i + 2, F.greatest(F.size(results), F.lit(1)))
        return F.transform(later, lambda second: F.struct(
            first["name"].alias("a"), second["name"].alias("b"),
            pair_verdict(first["name"], first["headline"], second["name"], second["headline"]).alias("said")))

    flat = F.flatten(F.transform(results, with_later))
    return F.transform(flat, lambda p: F.struct(p["a"], p["b"], p["said"]["verdict"].alias("verdict"), p["said"]["detail"].alias("detail")))


def _in_order(results: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Per key, its hospitals in rank order. A key is one search, so its list is as long as
    the search's own limit of nearest hospitals."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("at"), F.struct("ccn", "name", "headline").alias("hospital"))))
    return results.groupBy(*keys).agg(F.transform(listed, lambda s: s["hospital"]).alias("hospitals"))


def priced_pairs(results: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """Per key: `hospitals` in rank order, `pairs` between the priced ones, `unpriced` names."""
    grouped = _in_order(results, keys, rank)
    priced = F.filter("hospitals", lambda h: h["headline"].isNotNull())
    unpriced = F.transform(F.filter("hospitals", lambda h: h["headline"].isNull()), lambda h: h["name"])
    return grouped.select(*keys, "hospitals", pair_list(priced).alias("pairs"), unpriced.alias("unpriced"))


def pairs(results: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """One row per pair, priced or not, nearest first."""
    return _in_order(results, keys, rank).select(*keys, F.inline(pair_list(F.col("hospitals"))))


def closing_lines(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a search says at its end: who has no price, then each pair's verdict."""
    n_priced = F.size("hospitals") - F.size("unpriced")
    nobody = F.when(F.size("unpriced") > 0, F.concat(
        F.lit("no priced line for this service at "), F.array_join("unpriced", ", "), F.lit("; no pair with them can be compared")))
    alone = F.when(n_priced == 1, F.lit("only one hospital has a price for this service; nothing to put side by side"))
    said = F.transform("pairs", lambda p: F.concat(
        F.lit("compare: "), p["a"], F.lit(" vs "), p["b"], F.lit(": "), p["verdict"],
        F.when(p["detail"] != "", F.concat(F.lit(" ("), p["detail"], F.lit(")"))).otherwise(F.lit(""))))
    return summary.select(*keys, F.concat(F.array_compact(F.array(nobody, alone)), said).alias("lines"))
