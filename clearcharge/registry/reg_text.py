"""Scalar functions over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import billing_codes, cells, geo, keys, similarity, text, usage, web, words
from clearcharge.registry import duck, views
from clearcharge.registry.core import register


def project(name: str, source: str, inputs: dict[str, str], outputs: dict[str, tuple[Callable[[], Column], str]], key: str) -> None:
    """A query of computed columns over every row of a table or view. `inputs` are expressions
    both engines read alike; each output has a column builder and its own SQL."""
    listed = ", ".join(f"{sql} AS {alias}" for alias, sql in inputs.items())
    prefix = views.with_views(source) if source in views.VIEWS else ""
    expected = ", ".join(f"{sql} AS {alias}" for alias, (_, sql) in outputs.items())

    @register(name, f"{prefix} SELECT {key}, {expected} FROM (SELECT {key}, {listed} FROM {source})")
    def run(spark, folder):
        (df,) = views.load(spark, folder, source)
        given = df.selectExpr(key, *[f"{sql} AS {alias}" for alias, sql in inputs.items()])
        return given.select(key, *[build().alias(alias) for alias, (build, _) in outputs.items()])


c = F.col
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_PRICE = ("CASE doc_id % 9 WHEN 0 THEN ' $1,' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || '.25 ' WHEN 1 THEN '1_000' WHEN 2 THEN 'nan' WHEN 3 THEN '' WHEN 4 THEN '60% of it''s' "
          "WHEN 5 THEN CAST(n_chars AS STRING) || '.5' WHEN 6 THEN '.5' WHEN 7 THEN NULL ELSE '-' || CAST(doc_id AS STRING) || 'e1' END")


def _bare(x: str) -> str:
    return f"trim(replace(regexp_replace(trim({x}), '^\\$', ''), ',', ''))"


def _money(x: str) -> str:
    return f"CASE WHEN regexp_full_match({_bare(x)}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST({_bare(x)} AS DOUBLE) END"


def _note(name: str, x: str) -> str:
    shown = f"substr(trim({x}), 1, 80)"
    quoted = f"CASE WHEN contains({shown}, '''') THEN '\"' || {shown} || '\"' ELSE '''' || {shown} || '''' END"
    return f"CASE WHEN trim({x}) <> '' AND {_money(x)} IS NULL THEN '{name}=' || {quoted} END"


project("P1_norm_header", "documents", {"h": "' ' || upper(lang) || ' | ' || source || '|Code '"},
        {"header": (lambda: cells.norm_header(c("h")), "array_to_string(list_transform(string_split(h, '|'), lambda p: lower(trim(p))), '|')")}, "doc_id")
project("P2_blank_to_null", "documents", {"v": "CASE doc_id % 3 WHEN 0 THEN '   ' WHEN 1 THEN '  ' || source || ' ' ELSE lang END"},
        {"value": (lambda: cells.blank_to_null(c("v")), "nullif(trim(v), '')")}, "doc_id")
project("P3_enum", "customer", {"v": "CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' ' || c_mktsegment || ' ' ELSE c_mktsegment END"},
        {"value": (lambda: cells.enum_text(c("v")), "lower(nullif(trim(v), ''))")}, "c_custkey")
project("P4_money", "documents", {"v": _PRICE}, {"price": (lambda: cells.money(c("v")).cast("double"), _money("v"))}, "doc_id")
_W = "regexp_replace(w, '[^A-Za-z0-9 ]', 'x', 'g')"
project("P5_off_template_note", "documents", {"v": _PRICE, "w": "CASE doc_id % 2 WHEN 0 THEN substr(text, 1, 90) ELSE '12' END"},
        {"note": (lambda: cells.price_note([("gross", c("v")), ("discounted_cash", F.regexp_replace(c("w"), r"[^A-Za-z0-9 ]", "x"))]),
                  f"nullif(concat_ws('; ', {_note('gross', 'v')}, {_note('discounted_cash', _W)}), '')")}, "doc_id")
project("P6_codes_from_columns", "part", {"t1": "lower(substr(p_type, 1, 3))", "k1": "' ' || CAST(p_partkey AS STRING)", "t2": "'rc'", "k2": "CASE WHEN p_size % 3 = 0 THEN ' ' ELSE CAST(p_size AS STRING) END"},
        {"codes": (lambda: billing_codes.code_list(cells.codes_from_columns([(c("t1"), c("k1")), (c("t2"), c("k2")), (F.lit(None).cast("string"), F.lit(""))])),
                   "concat_ws(', ', upper(trim(t1)) || ' ' || trim(k1), CASE WHEN trim(k2) <> '' THEN 'RC ' || trim(k2) END)")}, "p_partkey")
project("P7_codes_from_json", "part", {"j": "'[{\"code\":\"' || CAST(p_partkey AS STRING) || ' \",\"type\":\" cpt\"},{\"code\":\"' || CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size AS STRING) END || '\",\"type\":\"rc\"}]'"},
        {"codes": (lambda: billing_codes.code_list(cells.codes_from_array(F.from_json(c("j"), "array<struct<code:string,type:string>>"))),
                   "array_to_string(list_transform(list_filter(from_json(j, '[{\"code\":\"VARCHAR\",\"type\":\"VARCHAR\"}]'), lambda e: e.code <> ''), lambda e: upper(trim(e.type)) || ' ' || trim(e.code)), ', ')")}, "p_partkey")
_ITEM = {"d": "'  ' || upper(p_name) || ' '", "e": "p_name", "k": "CAST(p_partkey % 50 AS STRING)", "u": "CASE WHEN p_size % 2 = 0 THEN '' END"}


def _two_codes(first: str, second: str) -> Column:
    return F.array(cells.code_struct(F.lit(first), c("k")), cells.code_struct(F.lit(second), c("k")))


# Equal identities must hash alike and different ones differ, whatever the bytes: compare through a rank of first members.
@register("P8_item_id", """SELECT lower(trim(p_name)) AS description, p_partkey % 50 AS code, count(*) AS items, CAST(1 AS BIGINT) AS ids FROM part GROUP BY 1, 2""")
def item_ids(spark, folder):
    (part,) = views.load(spark, folder, "part")
    given = part.selectExpr("p_partkey", "lower(trim(p_name)) AS description", "p_partkey % 50 AS code", *[f"{s} AS {a}" for a, s in _ITEM.items()])
    one = keys.item_id(c("d"), _two_codes("CPT", "RC"), c("u"), F.lit(None).cast("string"))
    two = keys.item_id(c("e"), _two_codes("rc", "cpt"), F.lit(None).cast("string"), F.lit(""))
    hashed = given.select("description", "code", F.explode(F.array(one, two)).alias("id"), F.lit(1).alias("n"))
    return hashed.groupBy("description", "code").agg((F.count("*") / 2).cast("bigint").alias("items"), F.count_distinct("id").alias("ids"))


project("P9_charge_id", "lineitem", {"i": "CAST(l_partkey AS STRING)", "r": "'row ' || CAST(l_orderkey AS STRING)"},
        {"l_linenumber": (lambda: F.lit(0).cast("int"), "CAST(0 AS INT)"), "charge_id": (lambda: keys.charge_id(c("i"), c("r")), "substr(sha1(i || '|' || r), 1, 16)")}, "l_orderkey")
project("P10_extraction_id", "supplier", {"s": "s_name || '0123456789abcdef'"},
        {"extraction_id": (lambda: keys.extraction_id(c("s")), "substr(s, 1, 16) || '-p3'")}, "s_suppkey")
project("P11_modifiers", "lineitem", {"a": "CASE l_linenumber % 4 WHEN 0 THEN '[\"26\",\"' || l_returnflag || '\"]' WHEN 1 THEN '[]' WHEN 2 THEN ' ' ELSE l_linestatus END", "b": "CASE WHEN l_quantity > 25 THEN ' RT ' END"},
        {"modifiers": (lambda: cells.modifiers(c("a"), c("b")),
                       "coalesce(CASE WHEN a LIKE '[\"%' THEN array_to_string(from_json(a, '[\"VARCHAR\"]'), ', ') WHEN a = '[]' THEN NULL ELSE nullif(trim(a), '') END, nullif(trim(b), ''))")}, "l_orderkey")
project("P12_source_ref", "lineitem", {"n": "l_orderkey", "k": "l_linenumber"},
        {"row_ref": (lambda: cells.row_ref(c("n")), "'row ' || n"), "item_ref": (lambda: cells.item_ref(c("n"), c("k")), "'item ' || n || '/charge ' || k")}, "l_partkey")
project("P13_zip5", "customer", {"z": "CAST(c_custkey * 7 AS STRING)"}, {"zip": (lambda: geo.zip5(c("z")), "lpad(z, 5, '0')")}, "c_custkey")
project("P14_radius_km", "customer", {"a": "c_acctbal * 1000000 + 100000000000"}, {"radius_km": (lambda: F.round(geo.radius_km(c("a")), 6), "round(sqrt(a / pi()) / 1000, 6)")}, "c_custkey")
project("P15_haversine_km", "d_zcta", {"a": "lat", "b": "lon"},
        {"km": (lambda: F.round(geo.haversine_km(c("a"), c("b"), F.lit(32.788309), F.lit(-96.799572)), 6), f"round({duck.haversine('a', 'b', '32.788309::DOUBLE', '(-96.799572)::DOUBLE')}, 6)")}, "zip")
project("P16_miles_text", "customer", {"km": "c_acctbal", "near": "c_custkey % 2 = 0"},
        {"miles": (lambda: geo.miles_text(c("km"), c("near")), "CASE WHEN near THEN '~' ELSE '' END || format('{:.1f}', km / 1.609344::DOUBLE) || ' mi'")}, "c_custkey")
project("P17_money_text", "lineitem", {"lo": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice END", "hi": "CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_extendedprice + 1 END"},
        {"shown": (lambda: text.money_text(c("lo")), f"coalesce({duck.money('lo')}, '—')"),
         "span": (lambda: text.range_text(c("lo"), c("hi")), f"CASE WHEN lo IS NULL AND hi IS NULL THEN '—' ELSE coalesce({duck.money('lo')}, '—') || '–' || coalesce({duck.money('hi')}, '—') END")}, "l_orderkey")
project("P18_size_text", "orders", {"n": "CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 50) END"},
        {"size": (lambda: text.size_text(c("n")), "CASE WHEN n = 0 THEN 'size unknown' WHEN n < 1000000 THEN format('{:,.0f}', n / 1e3) || ' KB' ELSE format('{:,.0f}', n / 1e6) || ' MB' END")}, "o_orderkey")
project("P19_short_name", "d_raw_hospitals", {"n": "name"},
        {"short_name": (lambda: text.short_name(c("n")),
                        f"array_to_string(list_transform(list_filter(string_split(n, ' '), lambda w: w <> ''), lambda w: CASE WHEN list_contains({duck.text_list(fv.KEPT_UPPERCASE)}, w) THEN w "
                        "ELSE array_to_string(list_transform(string_split(w, '-'), lambda p: upper(p[1:1]) || lower(p[2:])), '-') END), ' ')")}, "ccn")
project("P28_content_range_total", "orders", {"v": "CASE o_orderkey % 4 WHEN 0 THEN 'bytes 0-63/' || CAST(o_custkey AS STRING) WHEN 1 THEN 'bytes 0-63/*' WHEN 2 THEN NULL ELSE CAST(o_custkey AS STRING) END"},
        {"total": (lambda: web.content_range_total(c("v")), "try_cast(nullif(regexp_extract(v, '/([0-9]+)$', 1), '') AS BIGINT)"),
         "plain": (lambda: web.int_or_null(c("v")), "CASE WHEN regexp_full_match(v, '[0-9]+') THEN CAST(v AS BIGINT) END")}, "o_orderkey")
_HTTP = {"st": "CASE o_orderkey % 7 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN NULL ELSE 200 END",
         "er": "CASE WHEN o_orderkey % 7 = 4 THEN CASE o_custkey % 4 WHEN 0 THEN 'ReadTimeout' WHEN 1 THEN 'ConnectError' WHEN 2 THEN 'RemoteProtocolError' ELSE 'OddError' END END",
         "body": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || chr(10) || ' MRF-url : x' ELSE '<HTML>' END", "ct": "CASE WHEN o_custkey % 3 = 0 THEN 'text/html; charset' WHEN o_custkey % 3 = 1 THEN 'text/csv' END"}
_STATE = ("CASE WHEN er LIKE '%Timeout' THEN 'timeout' WHEN er IS NOT NULL THEN 'error' WHEN st = 200 AND contains(lower(body), 'mrf-url') THEN 'ok' WHEN st = 200 THEN 'html' "
          "WHEN st = 403 THEN 'blocked' WHEN st = 404 THEN '404' ELSE 'error' END")
project("P29_index_status", "orders", _HTTP,
        {"state": (lambda: web.index_status(c("st"), c("er"), c("body")), _STATE),
         "reason": (lambda: web.index_reason(F.lit("h"), c("st"), c("er"), c("body"), c("ct")),
                    f"CASE {_STATE} WHEN 'ok' THEN '' WHEN 'timeout' THEN 'h: timeout' WHEN 'html' THEN 'h: 200 but not an index file (' || coalesce(ct, '?') || ')' WHEN 'blocked' THEN 'h: 403 blocked' "
                    "WHEN '404' THEN 'h: 404' ELSE 'h: ' || coalesce(er, 'HTTP ' || st) END")}, "o_orderkey")
project("P30_probe_outcome", "orders", _HTTP,
        {"reason": (lambda: web.probe_outcome(c("st"), c("er"), c("ct"), c("body"))["reason"],
                    "CASE WHEN er LIKE '%Timeout' THEN 'timeout' WHEN er IS NOT NULL THEN er WHEN st >= 400 THEN 'HTTP ' || st WHEN contains(coalesce(ct, ''), 'text/html') OR starts_with(lower(body), '<html') "
                    "THEN 'HTML page, not a data file (login wall or moved?)' ELSE '' END")}, "o_orderkey")
project("P31_failure_text", "orders", _HTTP,
        {"said": (lambda: web.failure_text(c("st"), c("er")),
                  "CASE WHEN st IS NOT NULL THEN 'HTTP ' || st WHEN er = 'ReadTimeout' THEN 'the server stopped sending (ReadTimeout)' WHEN er = 'ConnectError' THEN 'could not connect (ConnectError)' "
                  "WHEN er = 'RemoteProtocolError' THEN 'the server closed the connection before the file finished (RemoteProtocolError)' ELSE er END")}, "o_orderkey")
project("P32_short_reason", "d_hospital_files", {"r": "reason"},
        {"said": (lambda: web.short_reason(c("r")), "CASE WHEN starts_with(r, 'no cms-hpt.txt or linked file located') THEN 'no index file or standard-charges link on any guessed domain (the trace lists them)' ELSE r END")}, "discovered_at")


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '" + v.replace("'", "''") + "'" for k, v in table.items()) + "}"


_DIGITS = "CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) = 3 THEN '0' ELSE '' END || regexp_replace(x, '[^0-9]', '', 'g')"


def _revenue(x: str) -> str:
    digits = _DIGITS.replace("x,", f"{x},")
    return (f"CASE WHEN length({digits}) <> 4 THEN NULL ELSE 'Revenue code ' || ({digits}) || coalesce(': ' || coalesce({_map(fv.REVENUE_SPECIFIC)}[{digits}], "
            f"{_map(fv.REVENUE_SERIES)}[substr({digits}, 1, 3)] || CASE substr({digits}, 4, 1) WHEN '0' THEN ' (general)' WHEN '9' THEN ' (other)' ELSE '' END), '') END")


project("P33_revenue_code", "part", {"x": "CASE p_partkey % 5 WHEN 0 THEN 'R-' ELSE '' END || CAST(p_partkey % 1200 AS STRING)"},
        {"said": (lambda: billing_codes.revenue_code(c("x")), _revenue("x"))}, "p_partkey")
project("P34_explain", "part", {"x": "CASE p_partkey % 4 WHEN 0 THEN 'RC ' WHEN 1 THEN 'CPT ' WHEN 2 THEN 'MADEUP ' ELSE 'MS-DRG ' END || CAST(p_partkey % 1000 AS STRING)", "y": "CAST(p_partkey % 1000 AS STRING)"},
        {"said": (lambda: billing_codes.explain(c("x")), f"CASE WHEN starts_with(x, 'RC ') THEN {_revenue('y')} ELSE {_map(fv.CODE_TYPES)}[split_part(x, ' ', 1)] END"),
         "explained": (lambda: F.size(billing_codes.explain_all(F.array(c("x"), F.lit("NDC 1"), F.lit("Z 1")))).cast("bigint"),
                       f"CAST(1 + CASE WHEN starts_with(x, 'RC ') THEN CASE WHEN {_revenue('y')} IS NULL THEN 0 ELSE 1 END WHEN starts_with(x, 'MADEUP') THEN 0 ELSE 1 END AS BIGINT)")}, "p_partkey")
project("P35_code_list", "d_services", {"a": "code_1", "b": "code_2"},
        {"codes": (lambda: billing_codes.code_list(cells.codes_from_columns([(F.lit("CPT"), c("a")), (F.lit("MS-DRG"), c("b"))])), "concat_ws(', ', 'CPT ' || a, 'MS-DRG ' || b)")}, "id")
project("P36_context", "d_charges", {"s": "setting", "b": "billing_class", "m": "modifiers", "r": "item_id LIKE '%1'"},
        {"said": (lambda: text.context_text(c("s"), c("b"), c("m"), c("r")), "coalesce(nullif(concat_ws(', ', s, CASE WHEN r THEN b || ' (per review)' ELSE b END, 'mod ' || m), ''), 'no context stated')")}, "charge_id")
project("P37_expected_setting", "d_services", {"a": "code_1", "b": "code_2"},
        {"setting": (lambda: billing_codes.expected_setting(cells.codes_from_columns([(F.lit("CPT"), c("a")), (F.lit("MS-DRG"), c("b"))])), "CASE WHEN b IS NULL THEN 'outpatient' ELSE 'inpatient' END")}, "id")
project("P38_squeeze_lower", "documents", {"t": "text"}, {"said": (lambda: F.md5(text.squeeze_lower(c("t"))), f"md5(lower({duck.squeeze('t')}))")}, "doc_id")
project("P39_tokens", "documents", {"t": "text"}, {"words": (lambda: F.array_join(F.array_sort(words.tokens(c("t"))), " "), duck.sorted_text(duck.tokens("t")))}, "doc_id")


def _after(patterns: int) -> str:
    """The query after the first patterns were cut out."""
    out = "lower(q)"
    for pattern, _, _ in fv.QUALIFIER_PATTERNS[:patterns]:
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return out


def _asked(key: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({_after(i)}, '{p}') THEN '{v}' END" for i, (p, k, v) in enumerate(fv.QUALIFIER_PATTERNS) if k == key)
    return f"concat_ws('|', {cases})"


def _asked_column(key: str) -> Column:
    return F.coalesce(F.array_join(F.try_element_at(words.parse_query(c("q"))["asked"], F.lit(key)), "|"), F.lit(""))


project("P40_parse_query", "d_queries", {"q": "query"},
        {"phrase": (lambda: words.parse_query(c("q"))["phrase"], duck.squeeze(_after(5))),
         "contrast": (lambda: _asked_column("contrast"), _asked("contrast")), "biopsy": (lambda: _asked_column("biopsy"), _asked("biopsy"))}, "p_partkey")
project("P41_indel_ratio", "part", {"a": "p_name", "b": "p_brand || ' ' || p_type"},
        {"ratio": (lambda: F.round(similarity.indel_ratio(c("a"), F.lower(c("b"))), 6), f"round({duck.ratio('a', 'lower(b)')}, 6)")}, "p_partkey")
project("P42_token_sort_ratio", "part", {"a": "p_name || ' of ' || lower(p_type)", "b": "lower(p_type) || ' ' || lower(p_brand) || ' ' || p_name"},
        {"ratio": (lambda: F.round(similarity.token_sort_ratio(c("a"), c("b")), 6),
                   "round((SELECT " + duck.ratio("u", "v") + f" FROM (SELECT {duck.sorted_text('string_split(a, chr(32))')} AS u, {duck.sorted_text('string_split(b, chr(32))')} AS v)), 6)")}, "p_partkey")
project("P43_ref_key", "lineitem", {"r": "CASE WHEN l_linenumber % 2 = 0 THEN 'row ' || CAST(l_orderkey AS STRING) ELSE 'item ' || CAST(l_orderkey AS STRING) || '/charge ' || CAST(l_linenumber AS STRING) END"},
        {"kind": (lambda: cells.ref_key(c("r"))["kind"], "split_part(r, ' ', 1)"), "n": (lambda: cells.ref_key(c("r"))["n"], "CAST(regexp_extract(r, '([0-9]+)', 1) AS BIGINT)"),
         "k": (lambda: cells.ref_key(c("r"))["k"], "coalesce(try_cast(nullif(regexp_extract(r, '/charge ([0-9]+)$', 1), '') AS BIGINT), 0)")}, "l_partkey")
project("P44_price_eq", "d_charges", {"a": "gross", "b": "CASE WHEN item_id LIKE '%3' THEN NULL WHEN item_id LIKE '%4' THEN gross + CAST(0.004 AS DECIMAL(18,6)) ELSE discounted_cash * 2 END"},
        {"same": (lambda: cells.price_eq(c("a"), c("b")), "CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE abs(a - b) < 0.005 END")}, "charge_id")
project("P45_same_domain", "pages", {"u": "url"},
        {"host": (lambda: web.host_of(c("u")), "regexp_replace(lower(regexp_extract(u, '//([^/?#]*)', 1)), '^www\\.', '')"),
         "same": (lambda: web.same_domain(web.host_of(c("u")), F.lit("example.com")), "regexp_matches(regexp_extract(u, '//([^/?#]*)', 1), '(^|\\.)example\\.com$')")}, "page_id")
project("P46_preferred_host", "pages", {"u": "url", "d": "CASE page_id % 3 WHEN 0 THEN 'https://example.com/x' WHEN 1 THEN ' www.Example.org/ ' ELSE '' END"},
        {"host": (lambda: web.preferred_host(c("d"), c("u")),
                  "CASE page_id % 3 WHEN 0 THEN CASE WHEN regexp_matches(regexp_extract(u, '//([^/?#]*)', 1), '\\.example\\.com$') THEN regexp_extract(u, '//([^/?#]*)', 1) ELSE 'example.com' END "
                  "WHEN 1 THEN CASE WHEN regexp_matches(regexp_extract(u, '//([^/?#]*)', 1), '\\.example\\.org$') THEN regexp_extract(u, '//([^/?#]*)', 1) ELSE 'www.example.org' END END")}, "page_id")
_RATES = [("small-model", 1.0, 4.0), ("large-model", 5.0, 25.0)]
project("P47_call_cost", "d_spend", {"m": "model", "i": "input_tokens", "o": "output_tokens", "r": "cache_read_tokens", "w": "cache_write_tokens"},
        {"usd": (lambda: F.round(usage.call_cost(usage.rates_for(c("m"), _RATES), c("i"), c("r"), c("w"), c("o")), 9),
                 "round(CAST((i + r * 0.1 + w * 1.25) * CASE WHEN starts_with(m, 'small-model') THEN 1 ELSE 5 END + o * CASE WHEN starts_with(m, 'small-model') THEN 4 ELSE 25 END AS DOUBLE) / 1000000, 9)")}, "call_id")
project("P48_answer_key", "conversations", {"t": "CAST(conv_id AS STRING)"},
        {"turn_key": (lambda: keys.answer_key(F.lit("m"), F.lit("1"), F.lit("pick"), c("t")), "sha256('[\"m\",\"1\",\"pick\",\"' || t || '\"]')")}, "conv_id")
project("P49_location_note", "customer", {"m": "'Exact'", "k": "c_acctbal", "z": "CAST(c_custkey AS STRING)"},
        {"note": (lambda: geo.rejected_note(c("m"), c("k"), c("z")), "m || ' geocode rejected: ' || format('{:.0f}', k) || ' km from the ' || z || ' centroid'")}, "c_custkey")
project("P51_cents_text", "lineitem", {"v": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / l_linenumber END"},
        {"shown": (lambda: text.cents_text(c("v")), "coalesce(regexp_replace(regexp_replace(format('{:.2f}', v), '0+$', ''), '\\.$', ''), '')")}, "l_orderkey")
project("S5_sniff_shape", "documents", {"h": "CASE doc_id % 5 WHEN 0 THEN 'PK' WHEN 1 THEN '  {' WHEN 2 THEN chr(10) || '{\"' ELSE '' END || text"},
        {"shape": (lambda: web.sniff_shape(c("h")), "CASE WHEN h LIKE 'PK%' THEN 'zip' WHEN regexp_matches(h, '^[ \\r\\n\\t]*\\{') THEN 'json' ELSE 'csv' END")}, "doc_id")
_PROBE = {"u": "'https://x.org/f' || CASE page_id % 4 WHEN 0 THEN '.JSON?x=1' WHEN 1 THEN '.ashx' WHEN 2 THEN '' ELSE '.zip' END",
          "dis": "CASE WHEN page_id % 8 = 1 THEN 'attachment; filename=\"a.CSV\"' END", "ct": "CASE WHEN page_id % 8 = 2 THEN 'application/JSON' END",
          "hd": "CASE page_id % 3 WHEN 0 THEN '[1' WHEN 1 THEN 'a,b' ELSE substr(html, 1, 64) END"}
project("S6_classify_shape", "pages", _PROBE,
        {"shape": (lambda: web.classify_shape(c("u"), c("ct"), c("dis"), c("hd")),
                   "CASE WHEN page_id % 4 = 0 THEN 'json' WHEN page_id % 4 = 3 THEN 'zip' WHEN dis IS NOT NULL THEN 'csv' WHEN ct IS NOT NULL THEN 'json' WHEN page_id % 3 = 0 THEN 'json' WHEN page_id % 3 = 1 THEN 'csv' "
                   "WHEN contains(hd, ',') AND regexp_full_match(hd, '[\\x20-\\x7e\\t\\r\\n]+') THEN 'csv' ELSE 'unknown' END")}, "page_id")
project("S11_looks_like_index", "conversations", {"t": "CASE turn % 3 WHEN 0 THEN text || chr(10) || '  Location-Name : x' WHEN 1 THEN text || ' mrf-url: x' ELSE text END"},
        {"turn_no": (lambda: c("t").isNotNull().cast("int"), "CAST(t IS NOT NULL AS INT)"), "fits": (lambda: web.looks_like_index(c("t")), "regexp_matches(t, '(?im)^\\s*(location-name|mrf-url)\\s*:')")}, "conv_id")
