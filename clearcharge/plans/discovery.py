"""Where a hospital's price file is, worked out from landed index files, pages and probe logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import names, text, web
from clearcharge.operators import matching
from clearcharge.session import materialise
from clearcharge.sources import index_text


def fetched_texts(index_fetches: DataFrame, bodies: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(fetches, lines): fetches with `text_id` and `is_index` in place of `body`, and (index_id, line_no, line) of every
    text that is an index. What several hosts serve is one text, told by its digest, and is cut into lines once; no
    whole text is written or carried along with a host. `bodies` (text_id, body): texts that are already kept apart."""
    if bodies is None:
        index_fetches = index_fetches.withColumn("text_id", F.sha2("body", 256))
        bodies = index_fetches.filter("body IS NOT NULL").select("text_id", "body")
        index_fetches = index_fetches.drop("body")
    texts = bodies.dropDuplicates(["text_id"]).filter(web.looks_like_index(F.col("body")))
    lines = materialise(index_text.index_lines(texts.select(F.col("text_id").alias("index_id"), F.col("body").alias("text"))), "index-lines")
    known = lines.filter("line_no = 0").select(F.col("index_id").alias("text_id"), F.lit(True).alias("is_index"))
    return index_fetches.join(known, "text_id", "left").withColumn("is_index", F.coalesce("is_index", F.lit(False))), lines


def domain_status(index_fetches: DataFrame) -> DataFrame:
    """Per domain over its hosts in order (the bare host, then www.): the first that is an
    index, else the last status and every reason. `index_fetches` as `fetched_texts` gives them."""
    said = index_fetches.select(
        "domain", "try_no", "host", "final_url", "text_id", web.fetch_status(F.col("status"), F.col("error"), F.col("is_index")).alias("state"),
        web.fetch_reason(F.col("host"), F.col("status"), F.col("error"), F.col("is_index"), F.col("content_type")).alias("reason"))
    ok = F.col("state") == "ok"
    reasons = F.array_sort(F.collect_list(F.when(~ok, F.struct("try_no", "reason"))))
    return said.groupBy("domain").agg(
        F.min_by(F.when(ok, F.struct("final_url", "text_id")), F.when(ok, F.col("try_no"))).alias("index"),
        F.max_by("state", "try_no").alias("last_state"), reasons.alias("reasons")).select(
        "domain", F.when(F.col("index").isNotNull(), F.lit("ok")).otherwise(F.col("last_state")).alias("state"), "index.final_url", "index.text_id",
        F.array_join(F.transform("reasons", lambda r: r["reason"]), "; ").alias("reason"))


def stored_answer(questions: DataFrame, answers: DataFrame, allowed: Column) -> DataFrame:
    """A stored decision by its key, refused when it lies outside the candidates.
    `questions`: key and candidates; `answers`: key, choice."""
    joined = questions.join(answers.select("key", "choice"), "key", "left")
    inside = F.coalesce(F.array_contains(allowed, F.col("choice")), F.lit(False))
    return joined.withColumn("choice", F.when(inside, F.col("choice"))).withColumn("known", F.col("choice").isNotNull())


_ROUTE = "ccn string, level int, no bigint, host string, how string, method string, page string, site_url string, site_name string, source_page string, tried string, steps array<string>"
_LEVEL_OF_SEARCH = 1_000_000  # levels from here on were reached through a web search


class _Hosts:
    """What is known of every landed host, whoever reached it: the state of its index, and of its site (the host
    without www.) the charges files linked on its pages and the sibling hosts its pricing links point at."""

    def __init__(self, index_fetches: DataFrame, links: DataFrame, bodies: DataFrame | None = None):
        fetches, self.lines = fetched_texts(index_fetches, bodies)
        self.status = materialise(domain_status(fetches), "domain-status")
        sites = links.select(web.without_www(web.host_of(F.col("page"))).alias("site"), "kind", "link", "link_host", "page", F.struct("page_id", "link_no").alias("at"))
        files = sites.filter("kind = 'file'").groupBy("site", "link").agg(F.min(F.struct("at", "page")).alias("first"))
        numbered = files.withColumn("entry_no", F.row_number().over(Window.partitionBy("site").orderBy("first.at", "link")).cast("bigint"))
        self.files = materialise(numbered.select(F.col("site").alias("index_id"), "entry_no", F.col("link").alias("url"), F.col("first.page").alias("page")), "site-files")
        self.with_files = materialise(self.files.groupBy(F.col("index_id").alias("site")).agg(F.count("*").alias("n_files"), F.min_by("page", "entry_no").alias("page")), "sites-with-files")
        siblings = sites.filter((F.col("kind") == "related") & (web.without_www(F.col("link_host")) != F.col("site")))
        self.related = materialise(siblings.groupBy("site", F.col("link_host").alias("next")).agg(F.min("at").alias("at")), "sibling-hosts")


def _tried(frontier: DataFrame, hosts: _Hosts, names_of: DataFrame, site_answers: DataFrame | None) -> DataFrame:
    """Every (hospital, host) of a level looked at: `method` is set where the host settles it. `frontier`: ccn, level,
    no, host, how, fetch (whether its index is asked for), said (steps before)."""
    state = hosts.status.select(F.col("domain").alias("host"), "state", "final_url", "reason")
    looked = materialise(frontier.withColumn("site", web.without_www(F.col("host"))).join(state, "host", "left").join(hosts.with_files, "site", "left").withColumn("indexed", F.col("fetch") & F.coalesce(F.col("state") == "ok", F.lit(False))), "hosts-tried")
    asked = looked.filter(~F.col("indexed") & F.col("n_files").isNotNull()).select("ccn", F.col("site").alias("index_id")).distinct().join(names_of, "ccn")
    on_site = matching.entry_from_site(asked, hosts.files.join(asked.select("index_id").distinct(), "index_id", "left_semi"), site_answers).select(
        "ccn", F.col("index_id").alias("site"), (F.col("verdict") == "matched").alias("settled"), F.col("location_name").alias("site_name"), F.col("mrf_url").alias("site_url"), F.col("source_page_url").alias("source_page"), "steps")
    joined = looked.join(on_site, ["ccn", "site"], "left")
    none = F.array().cast("array<string>")
    linked = F.concat(F.lit("no cms-hpt.txt at "), F.col("host"), F.lit(", but "), F.col("n_files").cast("string"), F.lit(" standard-charges link(s) on "), F.col("page"))
    steps = F.concat("said", F.when(F.col("indexed"), F.array(F.concat(F.lit("cms-hpt.txt found at "), F.col("final_url")))).when(F.col("n_files").isNotNull(), F.concat(F.array(linked), F.coalesce("steps", none))).otherwise(none))
    settled = F.coalesce("settled", F.lit(False))
    return joined.select(
        "ccn", "level", "no", "host", "how", F.when(F.col("indexed"), F.concat("how", F.lit("cms-hpt"))).when(settled, F.concat("how", F.lit("site-page"))).alias("method"),
        F.when(settled, F.col("page")).alias("page"), F.when(settled, F.col("site_url")).alias("site_url"), F.when(settled, F.col("site_name")).alias("site_name"), F.when(settled, F.col("source_page")).alias("source_page"),
        F.when(F.col("fetch") & ~F.col("indexed"), F.coalesce("reason", F.lit(""))).alias("tried"), steps.alias("steps"))


def _siblings(frontier: DataFrame, hosts: _Hosts, seen: DataFrame, level: int, how: str) -> DataFrame:
    """The hosts that pricing links of a level point at and nobody has tried for this hospital, in the order in which
    they were noted."""
    noted = frontier.select("ccn", web.without_www(F.col("host")).alias("site"), "no").join(hosts.related, "site").groupBy("ccn", F.col("next").alias("host")).agg(F.min(F.struct("no", "at")).alias("first"))
    fresh = noted.join(seen, ["ccn", "host"], "left_anti")
    numbered = fresh.withColumn("no", F.row_number().over(Window.partitionBy("ccn").orderBy("first", "host")).cast("bigint"))
    said = F.array(F.concat(F.lit("a pricing link points at "), F.col("host"), F.lit(", trying there")))
    return numbered.select("ccn", F.lit(level).alias("level"), "no", "host", F.lit(how).alias("how"), F.lit(True).alias("fetch"), said.alias("said"))


def _follow(frontier: DataFrame, seen: DataFrame, hosts: _Hosts, names_of: DataFrame, site_answers: DataFrame | None, sibling_how: str, log: list[DataFrame]) -> DataFrame:
    """Levels of hosts, each reached from the one before, until every hospital is settled or has nowhere to go. All
    hospitals go on together; no host is tried twice for one. Gives the hospitals that are settled."""
    settled = frontier.select("ccn").limit(0)
    while frontier.limit(1).count():
        level = frontier.agg(F.max("level")).first()[0]
        tried = materialise(_tried(frontier, hosts, names_of, site_answers), "level-tried")
        log.append(tried)
        done = tried.filter("method IS NOT NULL").select("ccn").distinct()
        settled = materialise(settled.unionByName(done), "hospitals-settled")
        open_ones = frontier.join(done, "ccn", "left_anti")
        seen = materialise(seen.unionByName(frontier.select("ccn", "host")).distinct(), "hosts-seen")
        frontier = materialise(_siblings(open_ones, hosts, seen, level + 1, sibling_how), "next-hosts")
    return settled


def routes(hospitals: DataFrame, hosts: _Hosts, website_answers: DataFrame | None, site_answers: DataFrame | None) -> DataFrame:
    """One row per hospital: how, where and with which steps its index or its file was found, and what every host
    said that was tried before (`tried`)."""
    names_of = hospitals.select("ccn", "name")
    guessed = hospitals.select("ccn", F.posexplode(names.domain_candidates(F.col("name"))).alias("no", "host"))
    states = materialise(guessed.join(hosts.status.withColumnRenamed("domain", "host"), "host", "left").withColumn("state", F.coalesce("state", F.lit("error"))), "guesses")
    first_ok = states.filter("state = 'ok'").groupBy("ccn").agg(F.min("no").alias("ok_no"))
    asked = materialise(states.join(first_ok, "ccn", "left").filter("ok_no IS NULL OR no <= ok_no"), "guesses-asked")
    none = F.lit(None).cast("string")
    found = F.col("state") == "ok"
    guess_log = asked.select(
        "ccn", F.lit(-1).alias("level"), F.col("no").cast("bigint").alias("no"), "host", F.lit("").alias("how"), F.when(found, F.lit("cms-hpt")).alias("method"), none.alias("page"), none.alias("site_url"), none.alias("site_name"), none.alias("source_page"),
        F.when(~found, F.coalesce("reason", F.lit(""))).alias("tried"), F.when(found, F.array(F.concat(F.lit("cms-hpt.txt found at "), F.col("final_url")))).otherwise(F.array().cast("array<string>")).alias("steps"))
    log = [guess_log]
    empty = F.array().cast("array<string>")
    alive = asked.filter("ok_no IS NULL").filter(F.col("state").isin("404", "html", "blocked"))
    first = materialise(alive.groupBy("ccn", "host").agg(F.min("no").cast("bigint").alias("no")).select("ccn", F.lit(0).alias("level"), "no", "host", F.lit("").alias("how"), F.lit(False).alias("fetch"), empty.alias("said")), "hosts-alive")
    done = _follow(first, first.select("ccn", "host"), hosts, names_of, site_answers, "site-link+", log)
    if website_answers is not None:
        open_ones = hospitals.select("ccn").join(done, "ccn", "left_anti").join(first_ok.select("ccn"), "ccn", "left_anti")
        searched = open_ones.join(website_answers.select("ccn", F.col("host").alias("found"), F.col("why") if "why" in website_answers.columns else F.lit("stored").alias("why")), "ccn")
        said = F.array(F.lit("cms-hpt.txt missing on guessed domains, searching the web for the site"), F.concat(F.lit("web search says "), F.col("found"), F.lit(" ("), F.col("why"), F.lit(")")))
        told = searched.select("ccn", F.posexplode(web.hosts_to_try(F.col("found"))).alias("no", "host"), said.alias("said"))
        start = told.select("ccn", F.lit(_LEVEL_OF_SEARCH).alias("level"), F.col("no").cast("bigint").alias("no"), "host", F.lit("web-search+").alias("how"), F.lit(True).alias("fetch"), F.when(F.col("no") == 0, F.col("said")).otherwise(empty).alias("said"))
        start = materialise(start, "hosts-searched")
        seen = first.select("ccn", "host")
        for tried in log[1:]:
            seen = seen.unionByName(tried.select("ccn", "host"))
        _follow(start, seen.distinct(), hosts, names_of, site_answers, "web-search+site-link+", log)
    every = log[0]
    for more in log[1:]:
        every = every.unionByName(more)
    every = materialise(every, "hosts-log")
    order = F.struct("level", "no")
    won = every.filter("method IS NOT NULL").groupBy("ccn").agg(F.min(F.struct("level", "no", "host", "method", "page", "site_url", "site_name", "source_page")).alias("won"))
    walked = every.join(won, "ccn", "left").filter(F.col("won").isNull() | (order <= F.struct("won.level", "won.no")))
    in_order = walked.groupBy("ccn").agg(F.array_sort(F.collect_list(F.struct("level", "no", "tried", "steps"))).alias("log"), F.first("won").alias("won"))
    said = F.filter(F.transform("log", lambda r: r["tried"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return in_order.select(
        "ccn", F.col("won.host").alias("domain"), F.col("won.method").alias("method"), F.col("won.page").alias("page"), F.col("won.site_url").alias("site_url"), F.col("won.site_name").alias("site_name"),
        F.col("won.source_page").alias("site_source"), F.array_join(said, "; ").alias("tried"), F.flatten(F.transform("log", lambda r: r["steps"])).alias("steps"))


def locate(hospitals: DataFrame, index_fetches: DataFrame, links: DataFrame, registry: DataFrame, probes: DataFrame,
           website_answers: DataFrame | None = None, entry_answers: DataFrame | None = None, site_answers: DataFrame | None = None,
           bodies: DataFrame | None = None) -> DataFrame:
    """One row per hospital: method, domain, index_url, entry, probe outcome, reason, and the steps that led there.

    `hospitals`: ccn, name, address, city, state, zip. `links`: extract_links output. `probes`: url, status, error,
    content_type, disposition, head, size_bytes, ... per file address. Stored answers: `website_answers` (ccn, host,
    perhaps why), `entry_answers` (ccn, entry_no) for an index, `site_answers` (ccn, index_id: a host, entry_no, perhaps
    why) for several files on a site. `index_fetches` has `body`, or `text_id` where `bodies` (text_id, body) keeps the
    texts. Hosts that serve the same text share its entries: they are read and matched once."""
    hosts = _Hosts(index_fetches, links, bodies)
    route = materialise(routes(hospitals, hosts, website_answers, site_answers), "routes")
    served = hosts.status.select("domain", "final_url", F.col("text_id").alias("index_id"))
    by_index = materialise(route.filter("method IS NOT NULL AND site_url IS NULL").select("ccn", "domain").join(served.select("domain", "index_id"), "domain").select("ccn", "index_id"), "by-index")
    entries = materialise(index_text.parse_index(hosts.lines.join(by_index.select("index_id").distinct(), "index_id", "left_semi")), "index-entries")
    sizes = entries.groupBy("index_id").agg(F.count("*").alias("n_entries"))
    matched = materialise(matching.match_entries(by_index.join(hospitals, "ccn"), entries), "matches")
    tie = matching.npi_tie_break(matched.filter("verdict = 'ambiguous'"), registry)
    settled = tie.select("ccn", F.col("entry_no").alias("npi_no"), F.col("location_name").alias("npi_name"), F.col("mrf_url").alias("npi_url"), F.col("why").alias("npi_why"))
    joined = route.join(served, "domain", "left").join(matched.select("ccn", "verdict", "entry_no", "location_name", "mrf_url", "score", "candidates"), "ccn", "left").join(settled, "ccn", "left").join(sizes, "index_id", "left")
    answers = entry_answers.select("ccn", F.col("entry_no").alias("told_no"), (F.col("why") if "why" in entry_answers.columns else F.lit("stored")).alias("told_why")) if entry_answers is not None else None
    joined = joined.join(answers, "ccn", "left") if answers is not None else joined.withColumn("told_no", F.lit(None).cast("bigint")).withColumn("told_why", F.lit(None).cast("string"))
    picked = F.try_element_at(F.filter("candidates", lambda c: c["entry_no"] == F.col("told_no")), F.lit(1))
    by_npi, by_answer = F.col("npi_no").isNotNull(), (F.col("verdict") == "ambiguous") & F.col("npi_no").isNull() & picked.isNotNull()
    located = joined.withColumn("picked", picked).withColumn("by_answer", F.coalesce(by_answer, F.lit(False))).withColumn("by_npi", by_npi)
    chosen = located.select(
        "ccn", "domain", "final_url", "index_id", "verdict", "page", "tried", "steps", "site_url", "site_source", "n_entries", "candidates", "score", "by_npi", "by_answer", "npi_why", "told_no", "told_why",
        F.concat("method", F.when(F.col("by_npi"), F.lit("+npi")).when(F.col("by_answer"), F.lit("+tie-break")).otherwise(F.lit(""))).alias("method"),
        F.when(F.col("site_url").isNull(), F.coalesce("entry_no", "npi_no", F.when(F.col("by_answer"), F.col("told_no")))).alias("entry_no"),
        F.coalesce("site_name", "location_name", "npi_name", F.when(F.col("by_answer"), F.col("picked.location_name"))).alias("location_name"),
        F.coalesce("site_url", "mrf_url", "npi_url", F.when(F.col("by_answer"), F.col("picked.mrf_url"))).alias("mrf_url"))
    seen = probes.select(
        F.col("url").alias("mrf_url"), web.probe_outcome(F.col("status"), F.col("error"), F.col("content_type"), F.col("head")).alias("probe"),
        web.classify_shape(F.col("url"), F.col("content_type"), F.col("disposition"), F.col("head")).alias("shape"), "size_bytes", "last_modified", "etag", "content_type")
    sources = entries.select("index_id", "entry_no", F.col("source_page_url").alias("index_source"))
    full = hospitals.select("ccn", "name").join(chosen, "ccn", "left").join(seen, "mrf_url", "left").join(sources, ["index_id", "entry_no"], "left")
    reason = text.first_matching([
        (F.col("method").isNull(), F.concat(F.lit("no cms-hpt.txt or linked file located: "), F.coalesce("tried", F.lit("")))),
        (F.col("location_name").isNull(), F.concat(F.lit("index found but no entry for this hospital ("), F.coalesce("verdict", F.lit("none")), F.lit(")"))),
        (F.col("mrf_url").isNull(), F.lit("entry has no mrf-url")),
        (F.col("probe").isNull(), F.lit("file URL failed: not probed")),
        (~F.col("probe.ok"), F.concat(F.lit("file URL failed: "), F.col("probe.reason")))], F.lit(""))
    on_site = F.col("site_url").isNotNull()
    told = full.withColumn("reason", reason)
    return told.select(
        "ccn", "name", (F.col("reason") == "").alias("ok"), F.coalesce("method", F.lit("failed")).alias("method"), "domain", F.when(on_site, F.col("page")).otherwise(F.col("final_url")).alias("index_url"), "location_name",
        F.when(on_site, F.col("site_source")).otherwise(F.col("index_source")).alias("source_page_url"), "mrf_url",
        "shape", "size_bytes", "last_modified", "etag", "content_type", "reason", F.array_compact(F.concat("steps", _closing_steps())).alias("steps"), F.lit(fv.DISCOVERY_VERSION).alias("discovery_version"))


def _closing_steps() -> Column:
    """What is said after a route was found or not: the entry, how a tie was settled, the probe. Nulls say nothing."""
    rounded = lambda score: text.fixed(score, 0)
    listed = F.array_join(F.transform("candidates", lambda c: F.concat(c["location_name"], F.lit(" ("), rounded(c["score"]), F.lit(")"))), "; ")
    counted = F.concat(F.coalesce(F.col("n_entries"), F.lit(0)).cast("string"), F.lit(" entries, "))
    indexed, ambiguous = F.col("method").isNotNull() & F.col("site_url").isNull(), F.col("verdict") == "ambiguous"
    entry = F.when(indexed, text.first_matching([
        (F.col("verdict") == "matched", F.concat(counted, F.lit("matched "), F.col("location_name"), F.lit(" ("), rounded(F.col("score")), F.lit(")"))),
        (ambiguous, F.concat(counted, F.lit("ambiguous match: "), listed))], F.concat(counted, F.lit("none resemble "), F.col("name"))))
    npi = F.when(indexed & ambiguous, F.when(F.col("by_npi"), F.concat(F.lit("NPI settled it: "), F.col("location_name"), F.lit(" ("), F.col("npi_why"), F.lit(")")))
                 .when(F.col("npi_why") != "no NPI in the filenames", F.concat(F.lit("NPI could not settle it ("), F.col("npi_why"), F.lit(")"))))
    unsettled = indexed & ambiguous & ~F.col("by_npi")
    tie = F.when(unsettled & F.col("by_answer"), F.concat(F.lit("tie-break picked "), F.col("location_name"), F.lit(" ("), F.col("told_why"), F.lit(")"))).when(
        unsettled & F.col("told_no").isNotNull(), F.concat(F.lit("tie-break declined: "), F.col("told_why")))
    found = F.col("location_name").isNotNull()
    size = F.concat(F.lit("price file "), F.col("shape"), F.lit(", "), text.size_text(F.col("size_bytes")), F.coalesce(F.concat(F.lit(", modified "), F.col("last_modified")), F.lit("")))
    end = text.first_matching([
        (F.col("method").isNull(), F.lit("no machine-readable index located — skipped")), (~found, F.lit(None).cast("string")),
        (F.col("mrf_url").isNull(), F.lit("entry has no mrf-url — skipped")), (F.col("reason") == "", size)], F.col("reason"))
    return F.array(entry, npi, tie, end)
