"""What a code on a price line is, in a sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A fixed table of at most a few hundred published entries, as a literal map."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def revenue_code(code: Column) -> Column:
    digits = F.regexp_replace(code, "[^0-9]", "")
    padded = F.when(F.length(digits) == 3, F.concat(F.lit("0"), digits)).otherwise(digits)
    series = _lookup(fv.REVENUE_SERIES, F.substring(padded, 1, 3))
    last = F.substring(padded, 4, 1)
    suffix = F.when(last == "0", F.lit(" (general)")).when(last == "9", F.lit(" (other)")).otherwise(F.lit(""))
    named = F.coalesce(_lookup(fv.REVENUE_SPECIFIC, padded), F.concat(series, suffix))
    text = F.concat_ws(": ", F.concat(F.lit("Revenue code "), padded), named)
    return F.when(F.length(padded) == 4, text)


def explain(token: Column) -> Column:
    """One sentence for a token such as `RC 360`; NULL for a type nobody published."""
    kind = F.element_at(F.split(token, " "), 1)
    code = F.regexp_extract(token, "^[^ ]* (.*)$", 1)
    return F.when((kind == "RC") & (code != ""), revenue_code(code)).otherwise(_lookup(fv.CODE_TYPES, kind))


def explain_all(code_tokens: Column) -> Column:
    """Map of the tokens that have an explanation."""
    pairs = F.transform(F.array_distinct(code_tokens), lambda t: F.struct(t.alias("key"), explain(t).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def code_list(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.concat_ws(" ", c["type"], c["code"])), ", ")


def expected_setting(codes: Column) -> Column:
    """A service with any stay code is priced as a stay."""
    stay = F.exists(codes, lambda c: c["type"] == "MS-DRG")
    return F.when(stay, F.lit("inpatient")).otherwise(F.lit("outpatient"))


def code_family(code_type: Column) -> Column:
    return F.when(code_type.isin("CPT", "HCPCS"), F.lit("HCPCS")).otherwise(code_type)
