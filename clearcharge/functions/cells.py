"""Cells of charge files: headers, blanks, enumerations, prices, codes, modifiers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv

# Text a price cell may hold after "$" and thousands commas are gone. Stricter than a
# general float parser: nan, inf, underscores and type suffixes become notes.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


# Every character a text trim removes.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def blank_to_null(value: Column) -> Column:
    return F.nullif(stripped(value), F.lit(""))


def enum_text(value: Column) -> Column:
    return F.lower(blank_to_null(value))


def norm_header(header: Column) -> Column:
    bare = F.regexp_replace(stripped(header), "^﻿+", "")
    return F.array_join(F.transform(F.split(bare, r"\|"), lambda part: F.lower(stripped(part))), "|")


def _price_text(value: Column) -> Column:
    text = stripped(value)
    bare = F.when(text.startswith("$"), F.substr(text, F.lit(2))).otherwise(text)
    return stripped(F.replace(bare, F.lit(","), F.lit("")))


def money(value: Column) -> Column:
    text = _price_text(value)
    return F.when(text.rlike(NUMBER), text).try_cast(fv.PRICE_TYPE)


def quoted(text: Column) -> Column:
    """The text in quotes, the way a note shows it: double quotes only around an apostrophe."""
    escaped = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    plain = F.concat(F.lit("'"), escaped, F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    both = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    has_single, has_double = text.contains("'"), text.contains('"')
    return F.when(has_single & ~has_double, double).when(has_single, both).otherwise(plain)


def price_note(cells: list[tuple[str, Column]], parsed: list[Column] | None = None) -> Column:
    """`column='text'` for each price cell that holds text instead of a number. `parsed` are
    the cells' prices where they are columns already."""
    prices = parsed if parsed is not None else [money(cell) for _, cell in cells]
    # Few rows have one, so all texts are put down once, in one expression over the cells without a price.
    texts = F.filter(
        F.array(*[F.when(price.isNull(), F.struct(F.lit(f"{name}=").alias("name"), stripped(cell).alias("text"))) for (name, cell), price in zip(cells, prices)]),
        lambda n: n["text"] != "")
    shown = F.transform(texts, lambda n: F.concat(n["name"], quoted(F.substring(n["text"], 1, fv.NOTE_TEXT_LIMIT))))
    some = [price.isNull() & cell.isNotNull() for (_, cell), price in zip(cells, prices)]
    joined = F.array_join(F.when(reduce(or_, some), shown), "; ")
    return F.when(joined != "", joined)


def code_struct(code_type: Column, code: Column) -> Column:
    return F.struct(
        F.upper(stripped(F.coalesce(code_type, F.lit("")))).alias("type"),
        stripped(F.coalesce(code, F.lit(""))).alias("code"),
    )


def codes_from_columns(numbered: list[tuple[Column, Column]]) -> Column:
    """(type, code) pairs in column-number order, without empty codes."""
    pairs = F.array(*[code_struct(code_type, code) for code_type, code in numbered])
    return F.filter(pairs, lambda pair: pair["code"] != "")


def codes_from_array(entries: Column) -> Column:
    pairs = F.transform(F.coalesce(entries, F.array()), lambda e: code_struct(e["type"], e["code"]))
    return F.filter(pairs, lambda pair: pair["code"] != "")


def modifiers(code_cell: Column, plain_cell: Column) -> Column:
    """A JSON array is joined by ", "; otherwise its text; otherwise the plain string."""
    listed = F.from_json(code_cell, "array<string>")
    joined = F.array_join(listed, ", ")
    is_list = stripped(code_cell).startswith("[")
    return F.coalesce(
        F.when(is_list & (F.size(listed) > 0), joined),
        F.when(~is_list, blank_to_null(code_cell)),
        blank_to_null(plain_cell),
    )


def row_ref(ordinal: Column) -> Column:
    return F.concat(F.lit("row "), ordinal.cast("string"))


def item_ref(item: Column, charge: Column) -> Column:
    return F.concat(F.lit("item "), item.cast("string"), F.lit("/charge "), charge.cast("string"))


def ref_key(source_ref: Column) -> Column:
    """(kind, n, k) of `row N` or `item N/charge K`."""
    row = F.regexp_extract(source_ref, r"^row (\d+)$", 1)
    item = F.regexp_extract(source_ref, r"^item (\d+)/charge (\d+)$", 1)
    charge = F.regexp_extract(source_ref, r"^item (\d+)/charge (\d+)$", 2)
    return F.struct(
        F.when(row != "", F.lit("row")).when(item != "", F.lit("item")).alias("kind"),
        F.coalesce(row.try_cast("bigint"), item.try_cast("bigint")).alias("n"),
        F.when(row != "", F.lit(0).cast("bigint")).otherwise(charge.try_cast("bigint")).alias("k"),
    )


def price_eq(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.abs(a.cast("double") - b.cast("double")) < 0.005).otherwise(a.isNull() & b.isNull())
