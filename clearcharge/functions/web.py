"""URLs, hosts, HTTP outcomes as landed in fetch logs, provider numbers in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions.text import first_matching

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def _part(url: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), pattern, group)


def netloc(url: Column) -> Column:
    """Host with port of an absolute or scheme-relative URL; empty otherwise. Blanks are allowed."""
    return F.lower(_part(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return _part(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def host_of(url: Column) -> Column:
    return without_www(netloc(url))


def same_domain(mine: Column, theirs: Column) -> Column:
    """Equal hosts, or one a sub-domain of the other. Each side is a `host_of` value."""
    return (mine == theirs) | mine.endswith(F.concat(F.lit("."), theirs)) | theirs.endswith(F.concat(F.lit("."), mine))


def registrable(host: Column) -> Column:
    bare = without_www(F.lower(host))
    parts = F.split(bare, r"\.")
    return F.when(F.size(parts) > 2, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(bare)


def hosts_to_try(host: Column) -> Column:
    apex = registrable(host)
    return F.when(apex == without_www(host), F.array(host)).otherwise(F.array(host, apex))


def bare_domain(text: Column) -> Column:
    """Scheme and path stripped; NULL when nothing is left."""
    lowered = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "^https://", ""), "^http://", "")
    return F.nullif(F.element_at(F.split(F.regexp_replace(lowered, "^[/ ]+|[/ ]+$", ""), "/"), 1), F.lit(""))


def preferred_host(domain_text: Column, page_url: Column) -> Column:
    """The host of the hospital's own page when it is a sub-domain of the stated domain."""
    domain, page = bare_domain(domain_text), netloc(page_url)
    wins = domain.isNotNull() & (page != "") & (page != domain) & page.endswith(F.concat(F.lit("."), without_www(domain)))
    return F.when(wins, page).otherwise(domain)


def resolve_url(page_url: Column, href: Column) -> Column:
    """An href made absolute against its page."""
    link = F.trim(href)
    scheme = _part(page_url, _URL, 1)
    site = F.concat(scheme, F.lit("://"), _part(page_url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = url_path(page_url)
    query = _part(page_url, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    relative = F.concat(folder, link)
    return first_matching(
        [
            (link == "", F.concat(site, path, query)),
            (link.rlike(_URL), link),
            (link.startswith("//"), F.concat(scheme, F.lit(":"), link)),
            (link.startswith("/"), F.concat(site, _without_dots(link))),
            (link.startswith("?"), F.concat(site, path, link)),
            (link.startswith("#"), F.concat(site, path, query, F.when(link == "#", F.lit("")).otherwise(link))),
        ],
        F.concat(site, _without_dots(relative)),
    )


def _without_dots(target: Column) -> Column:
    """`.` and `..` segments folded away in the path; query and fragment untouched."""
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)

    def fold(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc)
        return F.when(seg == ".", acc).when(seg == "..", up).otherwise(F.concat(acc, F.array(seg)))

    folded = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1))), F.array(F.element_at(segments, 1)), fold)
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    shown = F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(folded, "/"), tail)).otherwise(path)
    return F.concat(shown, rest)


def file_name(url: Column) -> Column:
    """Last segment of the address, without its query."""
    return F.element_at(F.split(F.element_at(F.split(url, "/"), -1), r"\?"), 1)


# --- provider numbers ---------------------------------------------------------------------

def npi_valid(npi: Column) -> Column:
    """Check digit over the card-issuer prefix and the number."""
    digits = F.reverse(F.concat(F.lit(fv.NPI_PREFIX), npi))
    doubled = F.transform(
        F.split(digits, ""),
        lambda ch, i: F.when(i % 2 == 0, ch.try_cast("int")).otherwise(
            F.when(ch.try_cast("int") > 4, ch.try_cast("int") * 2 - 9).otherwise(ch.try_cast("int") * 2)),
    )
    total = F.aggregate(doubled, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return F.coalesce(npi.rlike(r"^\d{10}$") & (total % 10 == 0), F.lit(False))


def npi_in(url: Column) -> Column:
    """The last valid provider number in the file's name: after a tax number it comes second."""
    name = F.element_at(F.split(url_path(url), "/"), -1)
    runs = F.filter(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), lambda r: F.length(r) == 10)
    valid = F.filter(runs, npi_valid)
    return F.try_element_at(valid, F.lit(-1))


# --- HTTP outcomes ------------------------------------------------------------------------

def int_or_null(value: Column) -> Column:
    return F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value)).try_cast("bigint")


def content_range_total(value: Column) -> Column:
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"/(\d+)$", 1).try_cast("bigint")


def looks_like_index(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?im)^\s*(location-name|mrf-url)\s*:"), F.lit(False))


def index_status(status: Column, error: Column, body: Column) -> Column:
    return fetch_status(status, error, looks_like_index(body))


def fetch_status(status: Column, error: Column, is_index: Column) -> Column:
    return first_matching(
        [
            (error.rlike("(?i)timeout"), F.lit("timeout")),
            (error.isNotNull(), F.lit("error")),
            ((status == 200) & is_index, F.lit("ok")),
            (status == 200, F.lit("html")),
            (status.isin(401, 403), F.lit("blocked")),
            (status == 404, F.lit("404")),
        ],
        F.lit("error"),
    )


def index_reason(host: Column, status: Column, error: Column, body: Column, content_type: Column) -> Column:
    return fetch_reason(host, status, error, looks_like_index(body), content_type)


def fetch_reason(host: Column, status: Column, error: Column, is_index: Column, content_type: Column) -> Column:
    state = fetch_status(status, error, is_index)
    shown = first_matching(
        [
            (state == "ok", F.lit(None).cast("string")),
            (state == "timeout", F.lit("timeout")),
            (error.isNotNull(), error),
            (state == "html", F.concat(F.lit("200 but not an index file ("), F.coalesce(content_type, F.lit("?")), F.lit(")"))),
            (state == "blocked", F.concat(status.cast("string"), F.lit(" blocked"))),
            (state == "404", F.lit("404")),
        ],
        F.concat(F.lit("HTTP "), status.cast("string")),
    )
    return F.coalesce(F.concat(host, F.lit(": "), shown), F.lit(""))


def probe_outcome(status: Column, error: Column, content_type: Column, head: Column) -> Column:
    """(ok, reason) of looking at a file's address without reading it."""
    html_head = F.lower(F.ltrim(F.coalesce(head, F.lit("")))).rlike("^(<!doctype|<html)")
    is_html = F.coalesce(content_type, F.lit("")).contains("text/html") | html_head
    reason = first_matching(
        [
            (error.rlike("(?i)timeout"), F.lit("timeout")),
            (error.isNotNull(), error),
            (status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))),
            (is_html, F.lit("HTML page, not a data file (login wall or moved?)")),
        ],
        F.lit(""),
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))


def failure_text(status: Column, error: Column) -> Column:
    named = F.concat(F.lit(" ("), error, F.lit(")"))
    return first_matching(
        [
            (F.coalesce(status, F.lit(0)) != 0, F.concat(F.lit("HTTP "), status.cast("string"))),
            (error == "RemoteProtocolError", F.concat(F.lit("the server closed the connection before the file finished"), named)),
            (error.endswith("Timeout") | (error == "TimeoutException"), F.concat(F.lit("the server stopped sending"), named)),
            (error == "ConnectError", F.concat(F.lit("could not connect"), named)),
        ],
        error,
    )


def short_reason(reason: Column) -> Column:
    text = F.coalesce(reason, F.lit(""))
    return F.when(
        text.startswith("no cms-hpt.txt or linked file located"),
        F.lit("no index file or standard-charges link on any guessed domain (the trace lists them)"),
    ).otherwise(text)


def sniff_shape(head: Column) -> Column:
    """Content decides, not the extension: zip, json or csv from the first bytes as text."""
    start = F.regexp_replace(head, "^[﻿ \\r\\n\\t]+", "")
    return F.when(head.startswith("PK"), F.lit("zip")).when(start.startswith("{"), F.lit("json")).otherwise(F.lit("csv"))


def classify_shape(url: Column, content_type: Column, disposition: Column, head: Column) -> Column:
    """json / csv / zip from the address, the download name, the content type, the first bytes."""
    path = F.lower(F.element_at(F.split(url, r"\?"), 1))
    named = F.lower(F.regexp_extract(F.coalesce(disposition, F.lit("")), r'(?i)filename\*?="?([^";]+)', 1))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    start = F.regexp_replace(F.coalesce(head, F.lit("")), "^[﻿ \\t\\r\\n]+", "")
    shapes = ("json", "csv", "zip")
    cases = [(name.endswith(f".{shape}"), F.lit(shape)) for name in (path, named) for shape in shapes]
    cases += [(kind.contains(shape), F.lit(shape)) for shape in shapes]
    cases += [
        (start.rlike(r"^[{\[]"), F.lit("json")),
        (start.startswith("PK"), F.lit("zip")),
        (start.rlike(r"^[\x20-\x7e\t\r\n]+$") & start.contains(","), F.lit("csv")),
    ]
    return first_matching(cases, F.lit("unknown"))
