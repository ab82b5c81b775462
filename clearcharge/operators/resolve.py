"""What a typed query means: one catalog service, or a stated reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import billing_codes, text, words
from clearcharge.operators.close_words import best_known
from clearcharge.session import BROADCAST_ROWS, materialise

QUALIFIERS = tuple(dict.fromkeys(key for _, key, _ in fv.QUALIFIER_PATTERNS))
_NO_CANDIDATES = "array<struct<id:string,name:string>>"


def catalog_words(services: DataFrame) -> DataFrame:
    return services.select(
        "pos", "id", "name", "aliases", "qualifiers",
        F.concat(F.col("name"), F.lit(" ("), billing_codes.code_list(F.col("codes")), F.lit(")")).alias("shown"),
        F.array_join(F.transform(F.map_entries("qualifiers"), lambda e: F.concat_ws(" ", e["value"], e["key"])), ", ").alias("variant"),
        F.array_union(words.tokens(F.col("name")), words.tokens(F.array_join("aliases", " "))).alias("haystack"))


def vocabulary(services: DataFrame) -> DataFrame:
    return catalog_words(services).select(F.explode("haystack").alias("word")).distinct()


def parsed_queries(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.trim("query").alias("typed"), F.inline(F.array(words.parse_query(F.trim("query")))))


def token_hits(parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query, pos, hits): how many of a query's words each service has. An inverted-index join."""
    index = catalog.select("pos", F.explode("haystack").alias("token"))
    asked = parsed.select("query", F.explode("tokens").alias("token")).repartition("query")
    return asked.join(index, "token").groupBy("query", "pos").agg(F.count("*").alias("hits"))


def _wanted(key: str) -> Column:
    return F.try_element_at(F.try_element_at("asked", F.lit(key)), F.lit(1))


def _classified(parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every (query, service) sharing a word: its score and whether it fits in full, in part,
    in another variant, or leaves a qualifier open."""
    rows = token_hits(parsed, catalog).join(parsed, "query").join(catalog, "pos")
    have = lambda key: F.try_element_at("qualifiers", F.lit(key))
    coverage = F.col("hits") / F.size("tokens")
    named = (F.col("phrase") == F.lower("name")) | F.array_contains(F.transform("aliases", F.lower), F.col("phrase"))
    score = coverage + F.when(named, F.lit(0.5)).otherwise(F.lit(0.0))
    conflict, open_key = F.lit(False), F.lit(None).cast("string")
    for key in QUALIFIERS:
        score = score + F.when(have(key) == _wanted(key), F.lit(0.25)).otherwise(F.lit(0.0))
        conflict = conflict | F.coalesce(have(key) != _wanted(key), F.lit(False))
        open_key = F.when(_wanted(key).isNotNull() & have(key).isNull(), F.lit(key)).otherwise(open_key)
    kind = text.first_matching([
        (F.col("hits") < F.size("tokens"), F.lit("partial")), (conflict, F.lit("conflict")), (open_key.isNotNull(), F.lit("open"))], F.lit("full"))
    return rows.select("query", "pos", "id", "name", "shown", "variant", "haystack", score.alias("score"), kind.alias("kind"), open_key.alias("open_key"))


def _candidates(classified: DataFrame) -> DataFrame:
    """Per query, the services of each kind in their order; partial fits cut to the closest few."""
    by_score = F.col("kind").isin("full", "partial")
    order = [F.when(by_score, -F.col("score")).otherwise(F.lit(0.0)), F.when(by_score, F.col("name")).otherwise(F.lit("")), F.col("pos")]
    ranked = classified.withColumn("at", F.row_number().over(Window.partitionBy("query", "kind").orderBy(*order)))
    kept = ranked.filter((F.col("kind") != "partial") | (F.col("at") <= fv.CLOSEST_SERVICES))
    entry = F.struct("at", "id", "name", "shown", "variant", "haystack", "score", "open_key")
    return kept.groupBy("query").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))).alias(kind) for kind in ("full", "open", "conflict", "partial")])


def _as_candidates(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(e["id"].alias("id"), e["name"].alias("name")))


def resolve_once(queries: DataFrame, services: DataFrame) -> DataFrame:
    """One row per distinct query, without reading misspellings."""
    catalog = catalog_words(services)
    parsed = parsed_queries(queries.select("query").distinct())
    by_code = services.select("pos", "id", "name", F.explode(F.transform("codes", lambda c: c["code"])).alias("typed"))
    exact = by_code.groupBy("typed").agg(F.min(F.struct("pos", "id", "name")).alias("exact"))
    rows = parsed.join(exact, "typed", "left").join(_candidates(_classified(parsed, catalog)), "query", "left")

    some = lambda name: F.coalesce(F.size(name) > 0, F.lit(False))
    first = lambda name: F.try_element_at(name, F.lit(1))
    contradictory = F.try_element_at(F.filter(F.array(*[
        F.struct(F.lit(key).alias("key"), F.try_element_at("asked", F.lit(key)).alias("values")) for key in QUALIFIERS]),
        lambda a: F.coalesce(F.size(a["values"]) > 1, F.lit(False))), F.lit(1))
    tied = F.filter("full", lambda e: e["score"] == first("full")["score"])
    wanted_text = F.concat_ws(", ", *[F.concat(_wanted(key), F.lit(f" {key}")) for key in QUALIFIERS])
    open_first, conflict_first, closest = first("open"), first("conflict"), first("partial")
    wanted_open = text.first_matching([(open_first["open_key"] == key, _wanted(key)) for key in QUALIFIERS], F.lit(None).cast("string"))
    missing = F.array_join(F.array_sort(F.array_except("tokens", F.coalesce(closest["haystack"], F.array().cast("array<string>")))), " ")
    shown = F.when(missing != "", missing).otherwise(F.concat(F.lit("'"), F.col("typed"), F.lit("'")))

    def outcome(verdict: str, service: Column, candidates: Column, reason: Column) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), service.alias("service_id"), candidates.cast(_NO_CANDIDATES).alias("candidates"), reason.alias("reason"))

    nobody, none = F.lit(None).cast("string"), F.array()
    result = text.first_matching([
        (F.col("exact").isNotNull(), outcome(fv.SELECTED, F.col("exact.id"), F.array(F.struct(F.col("exact.id").alias("id"), F.col("exact.name").alias("name"))),
                                             F.concat(F.lit("code "), F.col("typed"), F.lit(" matched exactly")))),
        (F.size("tokens") == 0, outcome(fv.NOT_IN_CATALOG, nobody, none, F.lit("no searchable words in the query"))),
        (contradictory.isNotNull(), outcome(fv.NEEDS_CLARIFICATION, nobody, none, F.concat(
            F.lit("the query asks for both "), F.array_join(F.array_sort(contradictory["values"]), " and "), F.lit(" "), contradictory["key"], F.lit("; which one?")))),
        (some("full") & (F.size(tied) == 1), outcome(fv.SELECTED, first("full")["id"], _as_candidates(F.col("full")), F.lit(""))),
        (some("full"), outcome(fv.AMBIGUOUS, nobody, _as_candidates(F.col("full")), F.concat(
            F.size(tied).cast("string"), F.lit(" entries fit equally: "), F.array_join(F.transform(tied, lambda e: e["name"]), "; ")))),
        (some("open"), outcome(fv.NEEDS_CLARIFICATION, nobody, _as_candidates(F.col("open")), F.concat(
            F.lit("the catalog doesn't say whether "), open_first["shown"], F.lit(" is "), wanted_open, F.lit(" "), open_first["open_key"], F.lit("; ask before scanning")))),
        (some("conflict"), outcome(fv.UNSUPPORTED_VARIANT, nobody, _as_candidates(F.col("conflict")), F.concat(
            F.lit("the CMS list has "), conflict_first["shown"], F.lit(" only "), conflict_first["variant"], F.lit("; "), wanted_text, F.lit(" is not on it")))),
    ], outcome(fv.NOT_IN_CATALOG, nobody, F.coalesce(_as_candidates(F.col("partial")), F.array().cast(_NO_CANDIDATES)),
        F.concat(F.lit("nothing in the catalog matches "), shown, F.when(closest.isNotNull(), F.concat(F.lit("; closest is "), closest["name"])).otherwise(F.lit("")))))
    return rows.select("query", "tokens", F.inline(F.array(result)))


def correct_tokens(unknown_words: DataFrame, services: DataFrame) -> DataFrame:
    """(word, known): the catalog's word for words it does not contain. Short words never qualify."""
    known = vocabulary(services)
    strange = unknown_words.select("word").distinct().filter(F.length("word") >= fv.TYPO_MIN_LENGTH).join(known, "word", "left_anti")
    return best_known(strange, known, fv.TYPO_SCORE).select("word", "known")


def resolve(queries: DataFrame, services: DataFrame) -> DataFrame:
    """One row per distinct query: verdict, service_id, candidates, reason, corrections.

    Queries that matched nothing are read once more with misspelt words replaced; the
    second reading counts only when it helps."""
    spark = queries.sparkSession
    catalog = materialise(services, "catalog")
    if catalog.count() <= BROADCAST_ROWS // 100:  # a few words and codes per service
        catalog = F.broadcast(catalog)
    first = materialise(resolve_once(queries, catalog), "resolved")
    missed = first.filter((F.col("verdict") == fv.NOT_IN_CATALOG) & (F.size("candidates") == 0))
    typed = missed.select("query", F.explode("tokens").alias("word"))
    fixes = typed.join(correct_tokens(typed, catalog), "word").groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct(F.col("word").alias("typed"), "known"))).alias("corrections"))
    reread = F.aggregate("corrections", F.lower("query"), lambda acc, f: F.regexp_replace(acc, F.concat(F.lit(r"\b"), f["typed"], F.lit(r"\b")), f["known"]))
    again = materialise(fixes.withColumn("reread", reread), "reread")
    second = resolve_once(again.select(F.col("reread").alias("query")), catalog).filter(
        ~((F.col("verdict") == fv.NOT_IN_CATALOG) & (F.size("candidates") == 0)))
    columns = ("verdict", "service_id", "candidates", "reason")
    helped = again.join(second.select(F.col("query").alias("reread"), F.struct(*columns).alias("better")), "reread").select("query", "corrections", "better")
    merged = first.join(helped, "query", "left")
    return merged.select(
        "query", *[F.when(F.col("better").isNotNull(), F.col(f"better.{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        F.coalesce("corrections", F.array().cast("array<struct<typed:string,known:string>>")).alias("corrections"))


def by_id(service_ids: DataFrame, services: DataFrame) -> DataFrame:
    """Requested catalog ids; an unknown id comes back with the reason."""
    return service_ids.select("id").distinct().join(services, "id", "left").withColumn(
        "reason", F.when(F.col("pos").isNull(), F.concat(F.lit("no catalog entry with id "), F.col("id"))))
