"""Links on landed web pages: charges files, transparency pages, sibling hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import web


def extract_links(pages: DataFrame) -> DataFrame:
    """Every href of every page, made absolute and sorted into file / page / related / other."""
    hrefs = pages.select("page_id", F.col("url").alias("page"), F.posexplode(F.regexp_extract_all("html", F.lit(fv.HREF), 1)).alias("link_no", "href"))
    linked = hrefs.withColumn("link", web.resolve_url(F.col("page"), F.col("href")))
    link_host, page_host = web.netloc(F.col("link")), web.netloc(F.col("page"))
    same_host = web.without_www(link_host) == web.without_www(page_host)
    pricing = F.col("href").rlike(fv.TRANSPARENCY_LINK)
    sibling = (link_host != "") & pricing & (web.registrable(link_host) == web.registrable(page_host))
    kind = (
        F.when(~same_host & sibling, F.lit("related")).when(~same_host, F.lit("other"))
        .when(F.col("link").rlike(fv.CHARGES_FILE_LINK), F.lit("file")).when(pricing, F.lit("page")).otherwise(F.lit("other")))
    return linked.select("page_id", "page", "link_no", "href", "link", link_host.alias("link_host"), kind.alias("kind"))


def site_results(links: DataFrame) -> DataFrame:
    """Per site: linked files (first page that linked each) and related hosts, in order of appearance."""
    host = web.host_of(F.col("page")).alias("site")
    files = links.filter("kind = 'file'").groupBy(host, "link").agg(F.min(F.struct("page_id", "link_no", "page")).alias("first"))
    return files.select("site", F.col("link").alias("url"), F.col("first.page").alias("page"), F.col("first.page_id").alias("page_id"), F.col("first.link_no").alias("link_no"))


def related_hosts(links: DataFrame) -> DataFrame:
    host = web.host_of(F.col("page")).alias("site")
    return links.filter("kind = 'related'").groupBy(host, F.col("link_host").alias("related")).agg(F.min(F.struct("page_id", "link_no")).alias("first")).select("site", "related", "first")
