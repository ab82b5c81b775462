"""Queries against the service catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import cells
from clearcharge.operators import close_words, resolve
from clearcharge.plans import audit
from clearcharge.registry import duck, views
from clearcharge.registry.core import register
from clearcharge.registry.reg_text import _after, _asked


def services(spark, folder):
    (raw,) = views.load(spark, folder, "d_services")
    codes = cells.codes_from_columns([(F.lit("CPT"), F.col("code_1")), (F.lit("MS-DRG"), F.col("code_2"))])
    qualifiers = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("contrast").alias("key"), F.col("contrast").alias("value")), F.struct(F.lit("biopsy").alias("key"), F.col("biopsy").alias("value"))), lambda e: e["value"].isNotNull()))
    return raw.select("pos", "id", F.lit("").alias("category"), "name", codes.alias("codes"), F.array("alias_1", "alias_2").alias("aliases"), qualifiers.alias("qualifiers"), "reviewed", F.lit("").alias("notes"))


CATALOG = f"""{views.with_views('d_services', 'd_queries')},
catalog AS (SELECT *, list_distinct({duck.tokens('name')} || {duck.tokens("(alias_1 || ' ' || alias_2)")}) AS haystack, concat_ws(', ', contrast || ' contrast', biopsy || ' biopsy') AS variant,
            name || ' (' || concat_ws(', ', 'CPT ' || code_1, 'MS-DRG ' || code_2) || ')' AS shown FROM d_services),
texts AS (SELECT DISTINCT query AS q FROM d_queries)"""


def once(prefix: str, source: str) -> str:
    """CTEs that resolve the distinct `q` of `source` into `{prefix}out`."""
    p = prefix
    return f"""
{p}parsed AS (SELECT q, phrase, {duck.tokens('phrase')} AS toks, string_split_regex(contrast, '\\|') AS contrasts, contrast, biopsy,
    CASE WHEN contrast <> '' THEN split_part(contrast, '|', 1) END AS want_c, CASE WHEN biopsy <> '' THEN split_part(biopsy, '|', 1) END AS want_b
    FROM (SELECT q, {duck.squeeze(_after(5))} AS phrase, {_asked('contrast')} AS contrast, {_asked('biopsy')} AS biopsy FROM (SELECT q AS q FROM {source}))),
{p}rows AS (SELECT p.*, s.pos, s.id, s.name, s.shown, s.variant, s.haystack, len(list_intersect(p.toks, s.haystack)) AS hits,
    len(list_intersect(p.toks, s.haystack)) / len(p.toks) + CASE WHEN phrase IN (lower(s.name), lower(alias_1), lower(alias_2)) THEN 0.5 ELSE 0 END
        + CASE WHEN s.contrast = want_c THEN 0.25 ELSE 0 END + CASE WHEN s.biopsy = want_b THEN 0.25 ELSE 0 END AS score,
    (s.contrast IS NOT NULL AND want_c IS NOT NULL AND s.contrast <> want_c) OR (s.biopsy IS NOT NULL AND want_b IS NOT NULL AND s.biopsy <> want_b) AS clash,
    CASE WHEN want_b IS NOT NULL AND s.biopsy IS NULL THEN 'biopsy' WHEN want_c IS NOT NULL AND s.contrast IS NULL THEN 'contrast' END AS open_key
    FROM {p}parsed p JOIN catalog s ON list_has_any(p.toks, s.haystack)),
{p}kinds AS (SELECT *, CASE WHEN hits < len(toks) THEN 'partial' WHEN clash THEN 'conflict' WHEN open_key IS NOT NULL THEN 'open' ELSE 'full' END AS kind FROM {p}rows),
{p}placed AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY CASE WHEN kind IN ('full', 'partial') THEN -score ELSE 0 END, CASE WHEN kind IN ('full', 'partial') THEN name ELSE '' END, pos) AS nth,
    max(score) OVER (PARTITION BY q, kind) AS top FROM {p}kinds),
{p}agg AS (SELECT q, count(*) FILTER (WHERE kind = 'full') AS n_full, count(*) FILTER (WHERE kind = 'full' AND score = top) AS n_top,
    string_agg(name, '; ' ORDER BY nth) FILTER (WHERE kind = 'full' AND score = top) AS tied,
    count(*) FILTER (WHERE kind = 'open') AS n_open, count(*) FILTER (WHERE kind = 'conflict') AS n_conflict, count(*) FILTER (WHERE kind = 'partial' AND nth <= 5) AS n_partial,
    any_value(id) FILTER (WHERE kind = 'full' AND nth = 1) AS best_id, string_agg(id, ' ' ORDER BY nth) FILTER (WHERE kind = 'full') AS full_ids, string_agg(id, ' ' ORDER BY nth) FILTER (WHERE kind = 'open') AS open_ids,
    string_agg(id, ' ' ORDER BY nth) FILTER (WHERE kind = 'conflict') AS conflict_ids, string_agg(id, ' ' ORDER BY nth) FILTER (WHERE kind = 'partial' AND nth <= 5) AS partial_ids,
    any_value(shown) FILTER (WHERE kind = 'open' AND nth = 1) AS open_shown, any_value(open_key) FILTER (WHERE kind = 'open' AND nth = 1) AS open_key,
    any_value(shown) FILTER (WHERE kind = 'conflict' AND nth = 1) AS conflict_shown, any_value(variant) FILTER (WHERE kind = 'conflict' AND nth = 1) AS conflict_has,
    any_value(name) FILTER (WHERE kind = 'partial' AND nth = 1) AS closest, any_value(haystack) FILTER (WHERE kind = 'partial' AND nth = 1) AS closest_words FROM {p}placed GROUP BY q),
{p}exact AS (SELECT p.q, min_by(s.id, s.pos) AS id FROM {p}parsed p JOIN catalog s ON trim(p.q) IN (s.code_1, s.code_2) GROUP BY p.q),
{p}out AS (SELECT p.q, p.toks,
    CASE WHEN x.id IS NOT NULL THEN 'selected' WHEN len(toks) = 0 THEN 'not in catalog' WHEN contains(contrast, '|') OR contains(biopsy, '|') THEN 'needs clarification' WHEN n_full > 0 AND n_top = 1 THEN 'selected'
         WHEN n_full > 0 THEN 'ambiguous' WHEN n_open > 0 THEN 'needs clarification' WHEN n_conflict > 0 THEN 'unsupported variant' ELSE 'not in catalog' END AS verdict,
    CASE WHEN x.id IS NOT NULL THEN x.id WHEN len(toks) = 0 OR contains(contrast, '|') OR contains(biopsy, '|') THEN NULL WHEN n_full > 0 AND n_top = 1 THEN best_id END AS service_id,
    coalesce(CASE WHEN x.id IS NOT NULL THEN x.id WHEN len(toks) = 0 OR contains(contrast, '|') OR contains(biopsy, '|') THEN '' WHEN n_full > 0 THEN full_ids WHEN n_open > 0 THEN open_ids WHEN n_conflict > 0 THEN conflict_ids ELSE partial_ids END, '') AS candidates,
    CASE WHEN x.id IS NOT NULL THEN 'code ' || trim(p.q) || ' matched exactly' WHEN len(toks) = 0 THEN 'no searchable words in the query'
         WHEN contains(contrast, '|') THEN 'the query asks for both ' || array_to_string(list_sort(string_split(contrast, '|')), ' and ') || ' contrast; which one?'
         WHEN contains(biopsy, '|') THEN 'the query asks for both ' || array_to_string(list_sort(string_split(biopsy, '|')), ' and ') || ' biopsy; which one?'
         WHEN n_full > 0 AND n_top = 1 THEN '' WHEN n_full > 0 THEN n_top || ' entries fit equally: ' || tied
         WHEN n_open > 0 THEN 'the catalog doesn''t say whether ' || open_shown || ' is ' || CASE open_key WHEN 'biopsy' THEN want_b ELSE want_c END || ' ' || open_key || '; ask before scanning'
         WHEN n_conflict > 0 THEN 'the CMS list has ' || conflict_shown || ' only ' || conflict_has || '; ' || concat_ws(', ', want_c || ' contrast', want_b || ' biopsy') || ' is not on it'
         ELSE 'nothing in the catalog matches ' || coalesce(nullif(array_to_string(list_sort(list_filter(toks, lambda w: NOT list_contains(coalesce(closest_words, []), w))), ' '), ''), '''' || trim(p.q) || '''')
              || CASE WHEN closest IS NOT NULL THEN '; closest is ' || closest ELSE '' END END AS reason
    FROM {p}parsed p LEFT JOIN {p}agg a ON a.q = p.q LEFT JOIN {p}exact x ON x.q = p.q)"""


_CLOSE = f"""words AS (SELECT DISTINCT unnest(haystack) AS known FROM catalog),
strange AS (SELECT DISTINCT word FROM missed_words WHERE length(word) >= 5 AND word NOT IN (SELECT known FROM words)),
close AS (SELECT word, known, {duck.ratio('word', 'known')} AS ratio FROM strange CROSS JOIN words WHERE 200 * least(length(word), length(known)) >= 87 * (length(word) + length(known))),
fixes AS (SELECT word, known, ratio FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY ratio DESC, known) AS n FROM close WHERE ratio >= 87) WHERE n = 1)"""
_LOST = "verdict = 'not in catalog' AND candidates = ''"
RESOLVED = f"""{CATALOG}, {once('a_', 'texts')},
missed_words AS (SELECT q, unnest(toks) AS word FROM a_out WHERE {_LOST}), {_CLOSE},
edits AS (SELECT m.q, list(f.word ORDER BY f.word) AS typed, list(f.known ORDER BY f.word) AS known FROM missed_words m JOIN fixes f ON f.word = m.word GROUP BY m.q),
rereads AS (SELECT q AS original, typed, known, CASE len(typed) WHEN 1 THEN regexp_replace(lower(q), '\\b' || typed[1] || '\\b', known[1], 'g')
            ELSE regexp_replace(regexp_replace(lower(q), '\\b' || typed[1] || '\\b', known[1], 'g'), '\\b' || typed[2] || '\\b', known[2], 'g') END AS q FROM edits),
{once('b_', '(SELECT DISTINCT q FROM rereads)')},
resolved AS (SELECT a.q AS query, coalesce(b.verdict, a.verdict) AS verdict, CASE WHEN b.q IS NOT NULL THEN b.service_id ELSE a.service_id END AS service_id, coalesce(b.candidates, a.candidates) AS candidates,
    coalesce(b.reason, a.reason) AS reason, CASE WHEN b.q IS NOT NULL THEN array_to_string(list_transform(range(1, len(r.typed) + 1), lambda i: r.typed[i] || '>' || r.known[i]), ' ') ELSE '' END AS corrections
    FROM a_out a LEFT JOIN rereads r ON r.original = a.q LEFT JOIN b_out b ON b.q = r.q AND NOT (b.verdict = 'not in catalog' AND b.candidates = ''))"""


def resolved(spark, folder):
    (queries,) = views.load(spark, folder, "d_queries")
    return resolve.resolve(queries, services(spark, folder))


@register("D4_D5_resolve", f"{RESOLVED} SELECT * FROM resolved")
def resolve_all(spark, folder):
    pairs = F.transform("corrections", lambda f: F.concat_ws(">", f["typed"], f["known"]))
    return resolved(spark, folder).select("query", "verdict", "service_id", F.array_join(F.transform("candidates", lambda e: e["id"]), " ").alias("candidates"), "reason", F.array_join(pairs, " ").alias("corrections"))


@register("T3_T4_first_reading", f"{CATALOG}, {once('a_', 'texts')} SELECT q AS query, verdict, candidates FROM a_out")
def first_reading(spark, folder):
    (queries,) = views.load(spark, folder, "d_queries")
    return resolve.resolve_once(queries, services(spark, folder)).select("query", "verdict", F.array_join(F.transform("candidates", lambda e: e["id"]), " ").alias("candidates"))


@register("J13_U3_token_hits", f"{CATALOG}, {once('a_', 'texts')} SELECT q AS query, pos, CAST(hits AS BIGINT) AS hits FROM a_rows")
def hits(spark, folder):
    (queries,) = views.load(spark, folder, "d_queries")
    parsed = resolve.parsed_queries(queries.select("query").distinct())
    return resolve.token_hits(parsed, resolve.catalog_words(services(spark, folder)))


@register("A9_vocabulary", f"{CATALOG} SELECT DISTINCT unnest(haystack) AS word FROM catalog")
def vocabulary(spark, folder):
    return resolve.vocabulary(services(spark, folder))


@register("J15_best_known_word", f"{CATALOG}, missed_words AS (SELECT unnest({duck.tokens('q')}) AS word FROM texts), {_CLOSE} SELECT word, known FROM fixes")
def best_known(spark, folder):
    (queries,) = views.load(spark, folder, "d_queries")
    parsed = resolve.parsed_queries(queries.select("query").distinct())
    return resolve.correct_tokens(parsed.select(F.explode("tokens").alias("word")), services(spark, folder))


# Whole texts: every word of the conversations that the benchmark texts do not use, against their words. Two words of so
# many letters are that far apart at most, whatever is counted as a change; what is left is scored.
_FAR = f"floor((length(word) + length(known)) * (100 - {fv.TYPO_SCORE}) / 100)"


@register("J15_close_words_in_texts", f"""WITH vocabulary AS (SELECT DISTINCT unnest({duck.tokens('text')}) AS known FROM benchmark), typed AS (SELECT DISTINCT unnest({duck.tokens('text')}) AS word FROM conversations),
    near AS (SELECT word, known FROM typed JOIN vocabulary ON abs(length(word) - length(known)) <= {_FAR} WHERE length(word) >= {fv.TYPO_MIN_LENGTH} AND word NOT IN (SELECT known FROM vocabulary) AND levenshtein(word, known) <= {_FAR}),
    scored AS (SELECT word, known, {duck.ratio('word', 'known')} AS ratio FROM near) SELECT word, known, round(ratio, 6) AS ratio FROM scored WHERE ratio >= {fv.TYPO_SCORE}""")
def close_in_texts(spark, folder):
    from clearcharge.functions import words

    benchmark, conversations = views.load(spark, folder, "benchmark", "conversations")
    known = benchmark.select(F.explode(words.tokens(F.col("text"))).alias("word")).distinct()
    typed = conversations.select(F.explode(words.tokens(F.col("text"))).alias("word")).distinct().filter(F.length("word") >= fv.TYPO_MIN_LENGTH)
    return close_words.close_pairs(typed.join(known, "word", "left_anti"), known, fv.TYPO_SCORE).withColumn("ratio", F.round("ratio", 6))


@register("J20_service_by_id", f"{CATALOG} SELECT a.id, s.name, CASE WHEN s.id IS NULL THEN 'no catalog entry with id ' || a.id END AS reason FROM (SELECT DISTINCT 'svc-' || p_partkey % 230 AS id FROM part) a LEFT JOIN catalog s ON s.id = a.id")
def by_id(spark, folder):
    (part,) = views.load(spark, folder, "part")
    asked = part.select(F.concat(F.lit("svc-"), (F.col("p_partkey") % 230).cast("string")).alias("id"))
    return resolve.by_id(asked, services(spark, folder)).select("id", "name", "reason")


@register("A21_reviewed_services", f"{views.with_views('d_services')} SELECT count(*) FILTER (WHERE reviewed) AS reviewed, count(*) AS services FROM d_services")
def reviewed(spark, folder):
    return audit.reviewed_services(services(spark, folder))
