"""Pieces of oracle SQL for the checking engine, written from the rules, not from the operators."""

from __future__ import annotations

from clearcharge import fixed_values as fv


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clean_name(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(replace(upper({x}), '&', ' AND '), '[''’]', '', 'g'), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def match_tokens(x: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fv.NAME_ABBREVIATIONS.items())
    return (f"list_filter(list_transform(list_filter(string_split({clean_name(x)}, ' '), lambda w: w <> ''), lambda w: CASE w {cases} ELSE w END), "
            f"lambda w: NOT list_contains({text_list(fv.NAME_NOISE)}, w))")


def sorted_text(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ' ')"


def lcs(a: str, b: str) -> str:
    """Row-by-row table; `a` and `b` are column names of non-empty text."""
    return (f"list_last(list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT), "
            f"list_transform(range(1, length({a}) + 1), lambda i: [i])), "
            f"lambda p, ca: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j])), "
            f"lambda c, j: list_append(c, CASE WHEN substr({a}, ca[1], 1) = substr({b}, j[1], 1) THEN p[j[1]] + 1 ELSE greatest(c[j[1]], p[j[1] + 1]) END))))")


def ratio(a: str, b: str) -> str:
    return (f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE "
            f"ELSE 200.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})) END")


def tokens(x: str) -> str:
    joined = f"regexp_replace(regexp_replace(lower({x}), '([\\pL\\pN_])-([\\pL\\pN_])', '\\1\\2', 'g'), '([\\pL\\pN_])-([\\pL\\pN_])', '\\1\\2', 'g')"
    return f"list_filter(list_distinct(regexp_extract_all({joined}, '[a-z0-9]+')), lambda w: NOT list_contains({text_list(fv.STOPWORDS)}, w))"


def money(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
            f"pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


def coalesce_text(x: str) -> str:
    return f"coalesce({x}, '')"
