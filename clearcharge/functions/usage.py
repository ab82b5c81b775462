"""Cost of a recorded model call from a rate table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions.text import first_matching


def rates_for(model: Column, rates: list[tuple[str, float, float]]) -> Column:
    """struct(input, output) in USD per million tokens: exact id, else prefix, else the dearest."""
    def pair(entry):
        return F.struct(F.lit(float(entry[1])).alias("input"), F.lit(float(entry[2])).alias("output"))

    cases = [(model == r[0], pair(r)) for r in rates] + [(model.startswith(r[0]), pair(r)) for r in rates]
    return first_matching(cases, pair(max(rates, key=lambda r: (r[1], r[2]))))


def call_cost(rate: Column, input_tokens: Column, cache_read: Column, cache_write: Column, output_tokens: Column) -> Column:
    def n(c: Column) -> Column:
        return F.coalesce(c, F.lit(0)).cast("double")

    units = (n(input_tokens) + n(cache_read) * fv.CACHE_READ_SHARE + n(cache_write) * fv.CACHE_WRITE_SHARE) * rate["input"]
    return (units + n(output_tokens) * rate["output"]) / 1_000_000
