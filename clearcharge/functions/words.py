"""Queries and service names as word sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv


def tokens(text: Column) -> Column:
    """Distinct lower-case words, hyphenated words joined, stopwords gone."""
    joined = F.regexp_replace(F.lower(text), r"(?U)(?<=\w)-(?=\w)", "")
    found = F.regexp_extract_all(joined, F.lit("([a-z0-9]+)"), 1)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in fv.STOPWORDS]))


def parse_query(query: Column) -> Column:
    """struct(phrase, tokens, asked): `asked` maps a qualifier to every value asked for."""
    text = F.lower(query)
    hits: dict[str, list[Column]] = {}
    for pattern, key, value in fv.QUALIFIER_PATTERNS:
        hits.setdefault(key, []).append(F.when(text.rlike(pattern), F.lit(value)))
        text = F.regexp_replace(text, pattern, " ")
    phrase = F.trim(F.regexp_replace(text, r"\s+", " "))
    asked = F.map_filter(
        F.create_map(*[x for key, values in hits.items() for x in (F.lit(key), F.array_compact(F.array(*values)))]),
        lambda _, values: F.size(values) > 0,
    )
    return F.struct(phrase.alias("phrase"), tokens(phrase).alias("tokens"), asked.alias("asked"))
