"""Is a stored copy still the published file, and what has to be fetched?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import text
from clearcharge.operators.latest import days_before, latest_extraction, newest


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def validators_match(prev_etag: Column, prev_modified: Column, head_error: Column, etag: Column, modified: Column, has_head: Column) -> Column:
    """struct(same, why). ETags decide when both sides have one, whatever the date says."""
    say = lambda same, why: F.struct(F.lit(same).alias("same"), why.alias("why"))
    return text.first_matching([
        (~has_head, say(False, F.lit("HEAD failed (?)"))),
        (_filled(head_error), say(False, F.concat(F.lit("HEAD failed ("), head_error, F.lit(")")))),
        (_filled(etag) & _filled(prev_etag) & (etag == prev_etag), say(True, F.lit("same ETag"))),
        (_filled(etag) & _filled(prev_etag), say(False, F.lit("ETag changed"))),
        (_filled(modified) & _filled(prev_modified) & (modified == prev_modified), say(True, F.concat(F.lit("same Last-Modified ("), modified, F.lit(")")))),
        (~_filled(etag) & ~_filled(modified), say(False, F.lit("server sends no validators"))),
    ], say(False, F.lit("validators changed")))


def no_change_detected(as_of: Column, fetched_at: Column, matched: Column) -> Column:
    """struct(same, why): validators agree and the copy is young enough."""
    old = days_before(as_of, fetched_at) > fv.MAX_AGE_DAYS
    why = F.when(matched["same"], F.concat(matched["why"], F.lit(", fetched "), F.date_format(fetched_at, "yyyy-MM-dd"))).otherwise(matched["why"])
    return F.when(old, F.struct(F.lit(False).alias("same"), F.lit("cached copy older than 30 days").alias("why"))).otherwise(
        F.struct(matched["same"].alias("same"), why.alias("why")))


def with_freshness(previous: DataFrame, heads: DataFrame, as_of: Column) -> DataFrame:
    """`previous` (url, etag, last_modified, fetched_at, ...) plus `fresh` and `why`. `heads`:
    url, error, etag, last_modified, one row per URL that was asked."""
    h = heads.select("url", F.struct("error", "etag", "last_modified").alias("head"))
    joined = previous.join(h, "url", "left")
    matched = validators_match(F.col("etag"), F.col("last_modified"), F.col("head.error"), F.col("head.etag"), F.col("head.last_modified"), F.col("head").isNotNull())
    return joined.withColumn("_said", no_change_detected(as_of, F.col("fetched_at"), matched)).select(
        *previous.columns, F.col("_said.same").alias("fresh"), F.col("_said.why").alias("why"))


def reusable_downloads(fetches: DataFrame, heads: DataFrame, on_disk: DataFrame, as_of: Column) -> DataFrame:
    """URLs whose newest real download is young, still landed and unchanged on the server.
    A reuse never counts as a download."""
    real = fetches.filter(F.col("checksum").isNotNull() & (F.coalesce("reason", F.lit("")) != fv.REUSED_DOWNLOAD))
    last = newest(real, ["url"], F.col("fetched_at").desc(), F.col("checksum"))
    young = last.filter(days_before(as_of, F.col("fetched_at")) <= fv.MAX_AGE_DAYS).join(on_disk.select("checksum").distinct(), "checksum", "left_semi")
    h = heads.select("url", F.struct("error", "etag", "last_modified").alias("head"))
    joined = young.join(h, "url", "left")
    matched = validators_match(F.col("etag"), F.col("last_modified"), F.col("head.error"), F.col("head.etag"), F.col("head.last_modified"), F.col("head").isNotNull())
    return joined.filter(matched["same"]).select("url", "checksum", "size_bytes", "fetched_at")


def capped(needed: DataFrame, cap: int | None, run: str = "run_id", order: str = "arrival") -> DataFrame:
    """First-come places for downloads: `taken` for the first `cap` of each run. Rows past
    the cap stay, marked; only the winners are ranked, so a huge run sorts no more than `cap` rows per task."""
    if cap is None:
        return needed.withColumn("taken", F.lit(True))
    ranked = needed.select(run, "url", order).withColumn("_place", F.row_number().over(Window.partitionBy(run).orderBy(order)))
    winners = ranked.filter(F.col("_place") <= cap).select(run, "url", F.lit(True).alias("taken"))
    return needed.join(winners, [run, "url"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def scan_plan(requests: DataFrame, fetches: DataFrame, extractions: DataFrame, files: DataFrame, heads: DataFrame, on_disk: DataFrame,
              as_of: Column, cap: int | None = None) -> DataFrame:
    """What each requested URL needs: cached, reuse, fetch, capped-older or capped.

    `requests`: run_id, arrival, url, force. Hospitals that share a URL share its one fetch."""
    asked = requests.groupBy("run_id", "url").agg(F.min("arrival").alias("arrival"), F.max("force").alias("force"))
    prev = with_freshness(latest_extraction(fetches, extractions, files), heads, as_of).select(
        "url", F.col("extraction_id").alias("prev_extraction"), F.col("fetched_at").alias("prev_fetched"), "fresh", "why")
    reuse = reusable_downloads(fetches, heads, on_disk, as_of).select("url", F.col("checksum").alias("landed"))
    known = asked.join(prev, "url", "left").join(reuse, "url", "left")
    before = F.when(~F.col("force") & F.coalesce("fresh", F.lit(False)), F.lit("cached")).when(
        ~F.col("force") & F.col("landed").isNotNull(), F.lit("reuse"))
    staged = known.withColumn("action", before)
    need = capped(staged.filter(F.col("action").isNull()), cap)
    late = F.when(F.col("taken"), F.lit("fetch")).when(F.col("prev_extraction").isNotNull(), F.lit("capped-older")).otherwise(F.lit("capped"))
    columns = ["run_id", "url", "arrival", "action", "prev_extraction", "landed", "why"]
    return staged.filter(F.col("action").isNotNull()).select(*columns).unionByName(need.withColumn("action", late).select(*columns))


def not_yet_extracted(downloads: DataFrame, extractions: DataFrame) -> DataFrame:
    """Landed checksums without a good extraction by the current parser: the same bytes are never parsed twice."""
    done = extractions.filter(F.col("ok") & (F.col("parser_version") == fv.PARSER_VERSION)).select("checksum")
    return downloads.dropDuplicates(["checksum"]).join(done, "checksum", "left_anti")
