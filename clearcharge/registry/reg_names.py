"""Facility names and the entries of index files."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import names, similarity, web
from clearcharge.operators import matching
from clearcharge.plans import audit
from clearcharge.registry import duck, views
from clearcharge.registry.core import register
from clearcharge.registry.reg_text import project
from clearcharge.session import materialise

c = F.col
project("P20_clean_name", "d_entries", {"n": "location_name || ' & Sons-' || index_id"}, {"cleaned": (lambda: names.clean_name(c("n")), duck.clean_name("n"))}, "entry_no")
project("P21_match_tokens", "d_entries", {"n": "location_name"}, {"words": (lambda: names.match_text(c("n")), f"array_to_string({duck.match_tokens('n')}, ' ')")}, "entry_no")
_HOST = "CASE page_id % 3 WHEN 0 THEN 'WWW.' ELSE '' END || regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '')"
_APEX = "array_to_string(string_split(regexp_replace(lower(h), '^www\\.', ''), '.')[-2:], '.')"
project("P23_hosts_to_try", "pages", {"h": f"lower({_HOST})"},
        {"apex": (lambda: web.registrable(c("h")), _APEX),
         "hosts": (lambda: F.array_join(web.hosts_to_try(c("h")), " "), f"h || CASE WHEN {_APEX} = regexp_replace(h, '^www\\.', '') THEN '' ELSE ' ' || {_APEX} END")}, "page_id")

_SEED_NAME = ("CASE s_suppkey % 6 WHEN 0 THEN 'HCA HOUSTON ' WHEN 1 THEN 'St. Luke''s ' WHEN 2 THEN 'Baylor Scott & White ' ELSE 'The ' END || name")


def _domains(x: str) -> str:
    cleaned = duck.clean_name(x)
    seeds = ", ".join(f"CASE WHEN regexp_matches({cleaned}, '{p}') THEN {duck.text_list(d)} ELSE []::VARCHAR[] END" for p, d in fv.SYSTEM_DOMAINS)
    toks = f"list_filter(string_split({cleaned}, ' '), lambda w: NOT list_contains({duck.text_list(('',) + fv.COMPANY_SUFFIXES)}, w))"
    bare = f"list_filter({toks}, lambda w: NOT list_contains({duck.text_list(fv.HOSPITAL_WORDS)}, w))"
    stem = lambda t: f"lower(array_to_string({t}, ''))"
    guesses = f"[{stem(bare)} || '.com', {stem(bare)} || '.org'] || CASE WHEN {stem(toks)} <> {stem(bare)} THEN [{stem(toks)} || '.com', {stem(toks)} || '.org'] ELSE []::VARCHAR[] END"
    return f"array_to_string(flatten([{seeds}]) || {guesses}, ' ')"


project("P24_J19_domain_candidates", "d_raw_hospitals", {"n": _SEED_NAME}, {"domains": (lambda: F.array_join(names.domain_candidates(c("n")), " "), _domains("n"))}, "ccn")
_LUHN = ("(SELECT sum(CASE WHEN i % 2 = 0 THEN d WHEN d > 4 THEN d * 2 - 9 ELSE d * 2 END) FROM (SELECT i, try_cast(substr(reverse('80840' || x), i + 1, 1) AS INT) AS d FROM range(15) r(i))) % 10 = 0")
project("P25_npi_valid", "orders", {"x": "CAST(1000000000 + o_orderkey * 7 AS STRING)"}, {"valid": (lambda: web.npi_valid(c("x")), _LUHN)}, "o_orderkey")
project("P26_npi_in_file_name", "orders", {"x": "CAST(1000000000 + o_orderkey * 7 AS STRING)", "u": "'https://x.org/1506318272/120045518-' || CAST(1000000000 + o_orderkey * 7 AS STRING) || '_a_standardcharges.csv?z=1506318272'"},
        {"npi": (lambda: web.npi_in(c("u")), f"CASE WHEN {_LUHN} THEN x END")}, "o_orderkey")
project("P27_same_place", "d_raw_hospitals", {"a": "address", "ci": "city", "z": "CASE WHEN length(zip) = 5 THEN zip ELSE '' END", "b": "CAST(100 + s_suppkey % 2 * (s_suppkey % 900) AS STRING) || ' Elsewhere'", "cj": "CASE WHEN s_nationkey % 2 = 0 THEN upper(city) ELSE 'x' END", "y": "CAST(10000 + s_suppkey * 13 AS STRING)"},
        {"number": (lambda: names.street_number(c("a")), "regexp_extract(a, '^[0-9]+')"),
         "same": (lambda: names.same_place(c("a"), c("ci"), c("z"), c("b"), c("cj"), c("y")), f"regexp_extract(a, '^[0-9]+') = regexp_extract(b, '^[0-9]+') AND ({duck.clean_name('ci')} = {duck.clean_name('cj')} OR z = y)")}, "ccn")

# --- aliases, shared words, matching ------------------------------------------------------
_SUFFIX = "regexp_extract({x}, '\\(([^)]*)\\)\\s*$', 1)"
_HAS_SUFFIX = "regexp_matches({x}, '\\([^)]*\\)\\s*$')"
_SUF = lambda x: duck.clean_name(_SUFFIX.format(x=x))
ALIASED = f"""{views.with_views('d_raw_hospitals', 'd_entries')},
suffixes AS (SELECT index_id, {_SUF('location_name')} AS suffix, count(*) AS n FROM d_entries WHERE {_HAS_SUFFIX.format(x='location_name')} GROUP BY ALL),
named AS (SELECT index_id, entry_no, location_name AS alias FROM d_entries UNION
          SELECT index_id, entry_no, trim(regexp_replace(location_name, '^.* d/b/a ', '')) FROM d_entries WHERE contains(location_name, ' d/b/a ')),
aliases AS (SELECT * FROM named UNION SELECT n.index_id, n.entry_no, trim(regexp_replace(n.alias, '\\s*\\([^)]*\\)\\s*$', '')) FROM named n JOIN suffixes s ON s.index_id = n.index_id AND s.n >= 2
            AND {_HAS_SUFFIX.format(x='n.alias')} AND s.suffix = {_SUF('n.alias')}),
alias_words AS (SELECT index_id, entry_no, alias, {duck.match_tokens('alias')} AS words FROM aliases),
common AS (SELECT w.index_id, w.token FROM (SELECT index_id, entry_no, alias, unnest(list_distinct(words)) AS token FROM alias_words) w
           GROUP BY w.index_id, w.token HAVING count(*) * 2 >= (SELECT count(*) FROM d_entries e WHERE e.index_id = w.index_id))"""
MATCHED = f"""{ALIASED},
targets AS (SELECT ccn, 'N' || s_nationkey AS index_id, {duck.match_tokens('name')} AS words FROM d_raw_hospitals),
target_rare AS (SELECT t.ccn, t.index_id, token FROM (SELECT ccn, index_id, unnest(words) AS token FROM targets) t WHERE NOT EXISTS (SELECT 1 FROM common k WHERE k.index_id = t.index_id AND k.token = t.token)),
rare_lists AS (SELECT ccn, list(DISTINCT token) AS rare FROM target_rare GROUP BY ccn),
pairs AS (SELECT t.ccn, a.entry_no, a.alias, {duck.sorted_text('t.words')} AS u, {duck.sorted_text('a.words')} AS v, coalesce(list_has_any(r.rare, a.words), false) AS shares, r.rare IS NOT NULL AS has_rare,
          list_sort(list_distinct(t.words)) = list_sort(list_distinct(a.words)) AND len(t.words) > 0 AS same, regexp_matches(a.alias, '(?i)\\bER 24/7\\b|\\bEMERGENCY CENTER\\b|\\bFREESTANDING\\b') AS er
          FROM targets t JOIN alias_words a ON a.index_id = t.index_id LEFT JOIN rare_lists r ON r.ccn = t.ccn),
per_entry AS (SELECT ccn, entry_no, max({duck.ratio('u', 'v')}) AS best, bool_or(shares) AS shares, any_value(has_rare) AS has_rare, bool_or(same) AS same, bool_and(er) AS er FROM pairs GROUP BY ccn, entry_no),
exact AS (SELECT ccn, min(entry_no) AS exact_no FROM per_entry WHERE same GROUP BY ccn HAVING count(*) = 1),
scored AS (SELECT p.ccn, p.entry_no, CASE WHEN x.exact_no = p.entry_no THEN 100.0 WHEN p.has_rare AND NOT p.shares THEN least(p.best, 30) ELSE p.best END AS score, coalesce(x.exact_no = p.entry_no, false) AS is_exact
           FROM per_entry p LEFT JOIN exact x ON x.ccn = p.ccn WHERE NOT p.er),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY score DESC, entry_no) AS place, max(score) OVER (PARTITION BY ccn) AS top FROM scored),
candidates AS (SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY place) AS nth FROM ranked WHERE place <= 5 AND score >= 40 AND score >= top - 25),
decided AS (SELECT h.ccn, CASE WHEN a.ccn IS NULL THEN 'none' WHEN a.is_exact OR (a.score >= 90 AND a.score - coalesce(b.score, 0) >= 10) THEN 'matched' ELSE 'ambiguous' END AS verdict, a.entry_no AS first_no, a.score,
            (SELECT count(*) FROM candidates k WHERE k.ccn = h.ccn) AS n_candidates
            FROM d_raw_hospitals h LEFT JOIN candidates a ON a.ccn = h.ccn AND a.nth = 1 LEFT JOIN candidates b ON b.ccn = h.ccn AND b.nth = 2)"""


@register("P22_entry_aliases", f"{ALIASED} SELECT index_id, entry_no, string_agg(alias, '|' ORDER BY alias) AS aliases FROM aliases GROUP BY ALL")
def aliases(spark, folder):
    (entries,) = views.load(spark, folder, "d_entries")
    return matching.entry_aliases(entries).select("index_id", "entry_no", F.array_join(F.array_sort("aliases"), "|").alias("aliases"))


@register("A7_shared_suffixes", f"{ALIASED} SELECT index_id, suffix FROM suffixes WHERE n >= 2")
def suffixes(spark, folder):
    (entries,) = views.load(spark, folder, "d_entries")
    return matching.shared_suffixes(entries)


@register("A8_common_tokens", f"{ALIASED} SELECT index_id, token FROM common")
def common(spark, folder):
    (entries,) = views.load(spark, folder, "d_entries")
    return matching.common_tokens(matching.entry_aliases(entries))


def matched(spark, folder):
    hospitals, entries = views.load(spark, folder, "d_raw_hospitals", "d_entries")
    asked = hospitals.withColumn("index_id", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    return matching.match_entries(asked, entries)


@register("D6_J8_W6_match_entry", f"{MATCHED} SELECT ccn, verdict, CASE WHEN verdict = 'matched' THEN first_no END AS entry_no, round(score, 6) AS score, n_candidates FROM decided")
def match(spark, folder):
    return matched(spark, folder).select("ccn", "verdict", "entry_no", F.round("score", 6).alias("score"), F.size("candidates").cast("bigint").alias("n_candidates"))


@register("F10_F11_candidates", f"{MATCHED} SELECT ccn, entry_no, round(score, 6) AS score FROM candidates")
def candidates(spark, folder):
    return matched(spark, folder).select("ccn", F.inline("candidates")).select("ccn", "entry_no", F.round("score", 6).alias("score"))


_REGISTRY = """SELECT DISTINCT npi, address, city, zip FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN '1506318272' ELSE CAST(1234567890 + s_suppkey AS STRING) END AS npi,
    CASE WHEN s_suppkey % 3 = 0 THEN '100 QUAYSIDE' ELSE CAST(100 + s_suppkey % 900 AS STRING) || ' Main Street' END AS address, 'CITY OF N' || CAST(s_nationkey * (s_suppkey % 3) AS STRING) AS city, '00000' AS zip FROM supplier WHERE s_suppkey % 9 <> 4)"""
_FIRST_REGISTRY = f"SELECT npi, min(address) AS address, min(city) AS city, min(zip) AS zip FROM ({_REGISTRY}) AS r GROUP BY npi"


@register("D7_J10_npi_tie_break", f"""{MATCHED}, registry AS ({_FIRST_REGISTRY}),
found AS (SELECT k.ccn, k.entry_no, regexp_extract(e.mrf_url, '([0-9]{{10}})_', 1) AS x
           FROM candidates k JOIN decided d ON d.ccn = k.ccn AND d.verdict = 'ambiguous' JOIN d_entries e ON e.entry_no = k.entry_no),
looked AS (SELECT ccn, entry_no, CASE WHEN length(x) = 10 AND {_LUHN} THEN x END AS npi FROM found),
hits AS (SELECT l.*, r.npi IS NOT NULL AS answered, coalesce(regexp_extract(h.address, '^[0-9]+') = regexp_extract(r.address, '^[0-9]+') AND ({duck.clean_name('h.city')} = {duck.clean_name('r.city')} OR r.zip = h.zip), false) AS hit
         FROM looked l JOIN d_raw_hospitals h ON h.ccn = l.ccn LEFT JOIN registry r ON r.npi = l.npi)
SELECT ccn, CASE WHEN count(*) FILTER (WHERE hit) = 1 THEN max(entry_no) FILTER (WHERE hit) END AS entry_no,
    CASE WHEN count(npi) = 0 THEN 'no NPI in the filenames' WHEN count(*) FILTER (WHERE hit) = 1 THEN 'settled' WHEN count(*) FILTER (WHERE hit) > 1 THEN count(*) FILTER (WHERE hit) || ' candidates'' NPIs are registered at the hospital''s address'
         WHEN count(*) FILTER (WHERE answered) = 0 THEN 'the NPI registry did not answer' ELSE 'no candidate''s NPI is registered at the hospital''s address' END AS why FROM hits GROUP BY ccn""")
def tie_break(spark, folder):
    ambiguous = matched(spark, folder).filter("verdict = 'ambiguous'")
    registry = spark.sql(_FIRST_REGISTRY)
    said = matching.npi_tie_break(ambiguous, registry)
    return said.select("ccn", "entry_no", F.when(F.col("why").startswith("NPI "), "settled").otherwise(F.col("why")).alias("why"))


_SITE = """SELECT index_id, CAST(row_number() OVER (PARTITION BY index_id ORDER BY entry_no) AS BIGINT) AS entry_no,
    'https://site.example/' || CASE WHEN entry_no % 3 = 0 THEN 'shoppable-' ELSE '' END || replace(lower(location_name), ' ', '-') || '.csv?x=' || CAST(entry_no AS STRING) AS url, 'https://site.example/' AS page
    FROM d_entries"""


@register("D8_F9_entry_from_site", f"""{views.with_views('d_raw_hospitals', 'd_entries')}, files AS ({_SITE}), kept AS (SELECT *, count(*) OVER (PARTITION BY index_id) AS n FROM files WHERE NOT contains(url, 'shoppable'))
    SELECT h.ccn, CASE WHEN k.n IS NULL THEN 'none' WHEN k.n = 1 THEN 'one' ELSE k.n || ' files linked' END AS files, CASE WHEN k.n = 1 THEN k.url END AS mrf_url,
      CASE WHEN k.n > 1 THEN k.names END AS names FROM d_raw_hospitals h JOIN (SELECT DISTINCT index_id FROM files) f ON f.index_id = 'N' || h.s_nationkey
    LEFT JOIN (SELECT index_id, max(n) AS n, max(url) AS url, array_to_string(list_slice(list(regexp_extract(url, '([^/?]*)(\\?|$)', 1) ORDER BY entry_no), 1, 5), '; ') AS names FROM kept GROUP BY index_id) k ON k.index_id = f.index_id""")
def from_site(spark, folder):
    hospitals, entries = views.load(spark, folder, "d_raw_hospitals", "d_entries")
    entries.createOrReplaceTempView("d_entries_given")
    files = spark.sql(_SITE.replace("FROM d_entries", "FROM d_entries_given"))
    asked = hospitals.select("ccn", "name", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("index_id"))
    said = matching.entry_from_site(asked, files)
    several = F.regexp_extract("step", "^([0-9]+ files linked)", 1)
    # A file matched by name among several is checked by D6; here, what the step says of all files when none is.
    named = matching.entry_from_site(asked.withColumn("name", F.lit("nobody")), files).select("ccn", F.regexp_extract("step", "ambiguous: (.*)$", 1).alias("names"))
    return said.join(named, "ccn").select("ccn", F.when(several != "", several).when((F.col("verdict") == "none"), "none").otherwise("one").alias("files"),
                                          F.when(several == "", F.col("mrf_url")).alias("mrf_url"), F.when(several != "", F.col("names")).alias("names"))


@register("J16_best_external", f"""{views.with_views('d_raw_hospitals', 'd_entries')},
ours AS (SELECT ccn, {duck.sorted_text(duck.match_tokens('name'))} AS u FROM d_raw_hospitals), theirs AS (SELECT entry_no, mrf_url, {duck.sorted_text(duck.match_tokens('location_name'))} AS v FROM d_entries),
scored AS (SELECT ccn, entry_no, {duck.ratio('u', 'v')} AS score FROM ours CROSS JOIN theirs WHERE 200 * least(length(u), length(v)) >= 85 * (length(u) + length(v)))
SELECT ccn, round(score, 6) AS score, entry_no AS row_no FROM (SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY score DESC, entry_no) AS n FROM scored WHERE score >= 85) WHERE n = 1""")
def external(spark, folder):
    hospitals, entries = views.load(spark, folder, "d_raw_hospitals", "d_entries")
    listed = entries.select(F.col("entry_no").alias("row_no"), F.col("location_name").alias("name"), F.col("mrf_url").alias("url"))
    return matching.best_external(hospitals, listed).select("ccn", F.round("score", 6).alias("score"), "row_no")


@register("A13_external_agreement", """SELECT count(*) AS overlap, count(*) FILTER (WHERE page_id % 3 = 0 OR regexp_matches(url, '//([^/]*\\.)?example\\.com')) AS agree,
    count(*) FILTER (WHERE NOT (page_id % 3 = 0 OR regexp_matches(url, '//([^/]*\\.)?example\\.com'))) AS differ FROM pages""")
def agreement(spark, folder):
    (pages,) = views.load(spark, folder, "pages")
    return audit.external_agreement(pages.select("url", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.lit("https://www.example.com/x")).alias("mrf_url")))


# --- the discovery chain over landed logs -----------------------------------------------
@register("D18_stored_answers", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'HOUSEHOLD' ELSE c_mktsegment END = c_mktsegment AND c_custkey % 4 <> 0 AS known FROM customer""")
def stored_answers(spark, folder):
    from clearcharge.plans import discovery

    (customer,) = views.load(spark, folder, "customer")
    asked = customer.select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("key"), F.array("c_mktsegment").alias("candidates"))
    told = asked.filter("c_custkey % 4 <> 0").select("key", F.when(F.col("c_custkey") % 3 == 0, F.lit("HOUSEHOLD")).otherwise(F.element_at("candidates", 1)).alias("choice"))
    return discovery.stored_answer(asked, told, F.col("candidates")).select("c_custkey", "known")


def _kind(host: str, n: int) -> str:
    """A number from 0 to n - 1 out of a host's name, in SQL that both engines read."""
    return f"(instr('0123456789abcdef', substr(md5({host}), 1, 1)) - 1) % {n}"


# What guessed domains answer: 0 has a page with a charges file, 1 blocks but links to its care host, 2 is dead, 3 has the
# index of the nation in its name, 4 links to a shoppable list and its care host, 5 has nothing. Care hosts: 0 index, 1 a
# link to the prices host, 2 a charges file, 3 dead. Prices hosts: 0 index, 1 a link back, 2 a charges file. The hosts a web
# search knows: one for each nation, with an index, a file, or a link to a care host with the index.
_HOSTS = f"""SELECT host, nation, CASE WHEN kind IN (0, 4, 5) THEN '404' WHEN kind = 1 THEN '403' WHEN kind = 2 THEN 'dead' ELSE 'index' END AS says, kind = 0 AS has_file, kind = 4 AS has_list, CASE WHEN kind IN (1, 4) THEN concat('care.', host) END AS points_at
    FROM (SELECT host, nation, {_kind('host', 6)} AS kind FROM guessed_hosts) AS g
UNION ALL SELECT host, nation, CASE kind WHEN 0 THEN 'index' WHEN 3 THEN 'dead' ELSE '404' END, kind = 2, false, CASE WHEN kind = 1 THEN concat('prices.', apex) END
    FROM (SELECT concat('care.', host) AS host, host AS apex, nation, {_kind("concat('care.', host)", 4)} AS kind FROM guessed_hosts) AS c
UNION ALL SELECT host, nation, CASE kind WHEN 0 THEN 'index' ELSE '404' END, kind = 2, false, CASE WHEN kind = 1 THEN concat('care.', apex) END
    FROM (SELECT concat('prices.', host) AS host, host AS apex, nation, {_kind("concat('prices.', host)", 3)} AS kind FROM guessed_hosts) AS p
UNION ALL SELECT concat('www.group', CAST(n_nationkey AS STRING), '.org'), CAST(n_nationkey AS STRING), CASE n_nationkey % 3 WHEN 0 THEN 'index' ELSE '404' END, n_nationkey % 3 = 1, false, CASE WHEN n_nationkey % 3 = 2 THEN concat('care.group', CAST(n_nationkey AS STRING), '.org') END FROM nation
UNION ALL SELECT concat('care.group', CAST(n_nationkey AS STRING), '.org'), CAST(n_nationkey AS STRING), 'index', false, false, NULL FROM nation"""
_CHAIN = f"""{MATCHED}, guesses AS (SELECT ccn, CAST(s_nationkey AS VARCHAR) AS nation, s_suppkey, unnest(string_split(d, ' ')) AS host, generate_subscripts(string_split(d, ' '), 1) AS no FROM (SELECT *, {_domains('name')} AS d FROM d_raw_hospitals)),
guessed_hosts AS (SELECT host, min(nation) AS nation FROM guesses GROUP BY host), hosts AS ({_HOSTS}),
asked AS (SELECT g.*, h.says, h.has_file, h.points_at, min(g.no) FILTER (WHERE h.says = 'index') OVER (PARTITION BY g.ccn) AS ok_no FROM guesses g JOIN hosts h USING (host)),
r0 AS (SELECT ccn, no, host, 'cms-hpt' AS method, 0 AS level FROM asked WHERE no = ok_no),
alive AS (SELECT * FROM asked WHERE ok_no IS NULL AND says IN ('404', '403')),
r1 AS (SELECT ccn, no, host, 'site-page' AS method, 1 AS level FROM alive WHERE has_file),
care AS (SELECT a.ccn, a.no, h.* FROM alive a JOIN hosts h ON h.host = a.points_at WHERE a.ccn NOT IN (SELECT ccn FROM r1)),
r2 AS (SELECT ccn, no, host, CASE WHEN says = 'index' THEN 'site-link+cms-hpt' ELSE 'site-link+site-page' END AS method, 2 AS level FROM care WHERE says = 'index' OR has_file),
prices AS (SELECT c.ccn, c.no, h.* FROM care c JOIN hosts h ON h.host = c.points_at WHERE c.ccn NOT IN (SELECT ccn FROM r2)),
r3 AS (SELECT ccn, no, host, CASE WHEN says = 'index' THEN 'site-link+cms-hpt' ELSE 'site-link+site-page' END AS method, 3 AS level FROM prices WHERE says = 'index' OR has_file),
searched AS (SELECT ccn, h.* FROM d_raw_hospitals d JOIN hosts h ON h.host = 'www.group' || s_nationkey || '.org' WHERE s_suppkey % 4 < 3 AND ccn NOT IN (SELECT ccn FROM r0 UNION ALL SELECT ccn FROM r1 UNION ALL SELECT ccn FROM r2 UNION ALL SELECT ccn FROM r3)),
r4 AS (SELECT ccn, 1 AS no, coalesce(points_at, host) AS host, CASE WHEN says = 'index' THEN 'web-search+cms-hpt' WHEN has_file THEN 'web-search+site-page' ELSE 'web-search+site-link+cms-hpt' END AS method, 4 AS level FROM searched),
routes AS (SELECT DISTINCT ON (ccn) * FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4) ORDER BY ccn, level, no),
linked AS (SELECT r.ccn, r.level, (SELECT count(*) FROM care c WHERE c.ccn = r.ccn AND (r.level > 2 OR (r.level = 2 AND c.no <= r.no))) + (SELECT count(*) FROM prices p WHERE p.ccn = r.ccn AND (r.level > 3 OR (r.level = 3 AND p.no <= r.no))) + (r.method = 'web-search+site-link+cms-hpt')::INT AS hops FROM routes r),
registry AS ({_FIRST_REGISTRY}),
tied AS (SELECT k.ccn, k.entry_no, regexp_extract(e.mrf_url, '([0-9]{{10}})_', 1) AS x FROM candidates k JOIN decided d ON d.ccn = k.ccn AND d.verdict = 'ambiguous' JOIN d_entries e ON e.entry_no = k.entry_no),
tie_hits AS (SELECT t.ccn, t.entry_no FROM (SELECT ccn, entry_no, CASE WHEN length(x) = 10 AND {_LUHN} THEN x END AS npi FROM tied) t JOIN d_raw_hospitals h ON h.ccn = t.ccn JOIN registry r ON r.npi = t.npi
    WHERE coalesce(regexp_extract(h.address, '^[0-9]+') = regexp_extract(r.address, '^[0-9]+') AND ({duck.clean_name('h.city')} = {duck.clean_name('r.city')} OR r.zip = h.zip), false)),
npi AS (SELECT ccn, max(entry_no) AS entry_no FROM tie_hits GROUP BY ccn HAVING count(*) = 1),
entry AS (SELECT r.ccn, r.host, r.level, r.method LIKE '%site-page' AS on_site, d.verdict, CASE WHEN d.verdict = 'matched' THEN d.first_no ELSE n.entry_no END AS entry_no, r.method || CASE WHEN r.method NOT LIKE '%site-page' AND n.entry_no IS NOT NULL THEN '+npi' ELSE '' END AS method
    FROM routes r JOIN decided d ON d.ccn = r.ccn LEFT JOIN npi n ON n.ccn = r.ccn),
found AS (SELECT h.ccn, e.host AS domain, coalesce(e.method, 'failed') AS method, e.on_site, e.verdict, CASE WHEN e.on_site THEN 'https://' || e.host || '/pricing' WHEN e.host IS NOT NULL THEN 'https://' || e.host || '/cms-hpt.txt' END AS index_url,
    CASE WHEN e.on_site THEN e.host || '_standardcharges.csv' ELSE trim(x.location_name) END AS location_name,
    CASE WHEN e.on_site THEN 'https://' || e.host || '/pricing' END AS source_page_url,
    CASE WHEN e.on_site THEN 'https://' || e.host || '/files/' || e.host || '_standardcharges.csv' ELSE x.mrf_url || CASE WHEN x.entry_no % 5 = 0 THEN '?v=2' ELSE '' END END AS mrf_url,
    CASE WHEN e.on_site THEN length(e.host) % 3 <> 0 ELSE x.entry_no % 5 <> 0 AND x.entry_no % 6 <> 0 END AS good, CASE WHEN e.on_site THEN true ELSE x.entry_no % 5 <> 0 END AS probed, coalesce(l.hops, (SELECT count(*) FROM care c WHERE c.ccn = h.ccn) + (SELECT count(*) FROM prices p WHERE p.ccn = h.ccn)) AS hops
    FROM d_raw_hospitals h LEFT JOIN entry e ON e.ccn = h.ccn LEFT JOIN d_entries x ON x.entry_no = e.entry_no AND NOT e.on_site LEFT JOIN linked l ON l.ccn = h.ccn)
SELECT ccn, method, domain, index_url, location_name, source_page_url, CASE WHEN location_name IS NOT NULL THEN mrf_url END AS mrf_url, hops, CASE WHEN method = 'failed' THEN 'no cms-hpt.txt or linked file located' WHEN location_name IS NULL THEN 'index found but no entry for this hospital (' || verdict || ')'
    WHEN NOT probed THEN 'file URL failed' WHEN NOT good THEN 'file URL failed' ELSE '' END AS reason FROM found"""


@register("D16_locate", _CHAIN)
def locate(spark, folder):
    """The whole chain over landed logs: guessed domains, pages, sibling hosts, web searches, entries, probes."""
    from clearcharge.plans import discovery
    from clearcharge.sources import pages as page_links

    hospitals, lines, entries, nation = views.load(spark, folder, "d_raw_hospitals", "d_index_lines", "d_entries", "nation")
    texts = lines.groupBy("index_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("body"))
    texts = materialise(texts.withColumn("text_id", F.sha2("body", 256)), "index-texts")
    guessed = hospitals.select(F.col("s_nationkey").cast("string").alias("nation"), F.explode(names.domain_candidates(F.col("name"))).alias("host")).groupBy("host").agg(F.min("nation").alias("nation"))
    guessed.createOrReplaceTempView("guessed_hosts")
    nation.createOrReplaceTempView("nation")
    hosts = materialise(spark.sql(_HOSTS), "hosts")
    none = F.lit(None).cast("string")
    says = F.col("says")
    fetches = hosts.join(texts.select(F.col("index_id").alias("of"), "text_id"), F.concat(F.lit("N"), "nation") == F.col("of"), "left").select(
        F.col("host").alias("domain"), F.lit(0).alias("try_no"), "host", F.when(says == "index", 200).when(says != "dead", says.cast("int")).alias("status"), F.when(says == "dead", "ConnectError").alias("error"),
        F.when(says == "index", F.col("text_id")).alias("text_id"), F.lit("text/plain").alias("content_type"), F.concat(F.lit("https://"), "host", F.lit("/cms-hpt.txt")).alias("final_url"))
    link = lambda url: F.concat(F.lit('<a href="'), url, F.lit('">price transparency</a>'))
    file_url = F.concat(F.lit("/files/"), "host", F.lit("_standardcharges.csv"))
    html = F.concat(F.when(F.col("has_file"), link(file_url)).otherwise(""), F.when(F.col("has_list"), link(F.lit("/files/shoppable_standardcharges.csv"))).otherwise(""), F.coalesce(link(F.concat(F.lit("https://"), "points_at", F.lit("/price-transparency"))), F.lit("")))
    landed = hosts.filter("says <> 'dead'").select(F.xxhash64("host").alias("page_id"), F.concat(F.lit("https://"), "host", F.lit("/pricing")).alias("url"), html.alias("html"))
    of_index = entries.select(F.col("mrf_url").alias("url"), F.when(F.col("entry_no") % 6 == 0, 404).otherwise(200).alias("status"))
    of_site = hosts.filter("has_file").select(F.concat(F.lit("https://"), "host", file_url).alias("url"), F.when(F.length("host") % 3 == 0, 404).otherwise(200).alias("status"))
    probes = of_index.unionByName(of_site).select("url", "status", none.alias("error"), F.lit("text/csv").alias("content_type"), none.alias("disposition"), F.lit("a,b").alias("head"), F.lit(1).cast("bigint").alias("size_bytes"), none.alias("last_modified"), none.alias("etag"))
    searched = hospitals.filter("s_suppkey % 4 < 3").select("ccn", F.concat(F.lit("www.group"), F.col("s_nationkey").cast("string"), F.lit(".org")).alias("host"))
    found = discovery.locate(hospitals.drop("s_suppkey", "s_nationkey"), fetches, page_links.extract_links(landed), spark.sql(_FIRST_REGISTRY), probes, website_answers=searched, bodies=texts.select("text_id", "body"))
    hops = F.size(F.filter("steps", lambda x: x.startswith("a pricing link points at"))).cast("bigint")
    reason = F.when(F.col("reason").startswith("index found"), F.col("reason")).otherwise(F.element_at(F.split("reason", ":"), 1))
    return found.select("ccn", "method", "domain", "index_url", "location_name", "source_page_url", "mrf_url", hops.alias("hops"), reason.alias("reason"))
