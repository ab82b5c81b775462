"""Numbers, sizes and names as readers see them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv

DASH = "—"


def grouped(value: Column, digits: int) -> Column:
    """Thousands separators, ties to even."""
    return F.format_number(value.cast("double"), digits)


def fixed(value: Column, digits: int) -> Column:
    return F.regexp_replace(grouped(value, digits), ",", "")


def money_text(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), grouped(value, 2)), F.lit(DASH))


def range_text(low: Column, high: Column) -> Column:
    return F.when(low.isNull() & high.isNull(), F.lit(DASH)).otherwise(F.concat(money_text(low), F.lit("–"), money_text(high)))


def size_text(size: Column) -> Column:
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("size unknown"))
        .when(size < 1_000_000, F.concat(grouped(size / 1e3, 0), F.lit(" KB")))
        .otherwise(F.concat(grouped(size / 1e6, 0), F.lit(" MB")))
    )


def cents_text(value: Column) -> Column:
    """Two decimals with trailing zeros cut; empty when missing."""
    shown = F.regexp_replace(F.regexp_replace(fixed(value, 2), "0+$", ""), r"\.$", "")
    return F.coalesce(shown, F.lit(""))


def plural(count: Column, word: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {word}"), F.when(count == 1, F.lit("")).otherwise(F.lit("s")))


def squeeze_lower(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))


def words(value: Column) -> Column:
    """Non-empty words between blanks."""
    return F.filter(F.split(value, r"\s+"), lambda w: w != "")


def short_name(name: Column) -> Column:
    def capital(part: Column) -> Column:
        return F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substr(part, F.lit(2))))

    def shown(word: Column) -> Column:
        hyphened = F.array_join(F.transform(F.split(word, "-"), capital), "-")
        return F.when(word.isin(*fv.KEPT_UPPERCASE), word).otherwise(hyphened)

    return F.array_join(F.transform(words(name), shown), " ")


def context_text(setting: Column, billing_class: Column, modifiers: Column, from_review: Column) -> Column:
    stated = F.when(F.coalesce(from_review, F.lit(False)), F.concat(billing_class, F.lit(" (per review)"))).otherwise(billing_class)
    joined = F.concat_ws(", ", F.nullif(setting, F.lit("")), F.nullif(stated, F.lit("")),
                         F.when(F.nullif(modifiers, F.lit("")).isNotNull(), F.concat(F.lit("mod "), modifiers)))
    return F.when(joined != "", joined).otherwise(F.lit("no context stated"))


def first_matching(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), default)
