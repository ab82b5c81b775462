"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score.

DataFrame operations only. A text is cut by each expression: the pieces between the matches and the matches give
every start and end in code points. Base kinds are email, ip (parts at most 255), card (12 to 19 digits, Luhn) and
phone (9 to 15 digits); the method adds iban (mod 97) and ssn (only with a context word before it). A failing match is
dropped without another try. Scores: 0.5 for the expression, 0.3 for a checksum, 0.2 for a context word within 40
characters before the match.

The expressions here find what the plain ones find; guards before runs and possessive repeats only keep them linear
on long runs.

Cases: null and empty texts have no spans; spans of different kinds may overlap and are all kept; equal starts are
listed in the order of the kinds; repeated rows each get a row; extra columns are kept by `found`, dropped by `spans_of`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
# kind: expression, a character that every match holds (None: digits anyway), context words
KINDS = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "ip|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, "card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|tel|mobile"),
    "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", None, "iban|account|bank"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
NEAR = 40
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)
    value = lambda i: F.substr(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda s, i: s + F.floor(value(i) / 10).cast("int") + value(i) % 10)
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (country, check digits, rest) leaves 1."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def add(s: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (s * 100 + c - 55) % 97).otherwise((s * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def passes(kind: str, m: Column, context: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        number = digits(m)
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    return context if kind == "ssn" else F.lit(True)


def _span(kind: str):
    """From a match and its number: start, stop, score, and whether it is kept."""
    words = KINDS[kind][2]
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)

    def span(m: Column, i: Column) -> Column:
        start = total(F.slice(f"_{kind}_b", F.lit(1), i + 1)) + total(F.slice(f"_{kind}_m", F.lit(1), i))
        context = F.lower(F.right(F.element_at(f"_{kind}_between", i + 1), F.lit(NEAR))).rlike(words)
        score = F.lit(0.8 if kind in ("card", "iban") else 0.5) + F.when(context, 0.2).otherwise(0.0)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), score.alias("score"), passes(kind, m, context).alias("ok"))

    return span


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """The given columns and, for each kind, an array of (start, stop, score)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = docs
    for kind, (expression, sign, _) in KINDS.items():
        some = F.contains(whole, F.lit(sign)) if sign else whole.rlike("[0-9]")
        cut = cut.withColumn(f"_{kind}_matches", F.when(some, F.regexp_extract_all(whole, F.lit(f"({expression})"), F.lit(1))))
    for kind, (expression, _, _) in KINDS.items():
        cut = cut.withColumn(f"_{kind}_between", F.when(F.size(f"_{kind}_matches") > 0, F.split(whole, expression, -1)))
    for kind in KINDS:
        sizes = lambda c: F.transform(F.col(c), F.length)
        cut = cut.withColumn(f"_{kind}_m", sizes(f"_{kind}_matches")).withColumn(f"_{kind}_b", sizes(f"_{kind}_between"))
    for kind in KINDS:
        kept = F.filter(F.transform(f"_{kind}_matches", _span(kind)), lambda s: s["ok"])
        slim = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["score"].alias("score")))
        cut = cut.withColumn(kind, F.when(F.col(f"_{kind}_between").isNotNull(), slim).otherwise(F.array().cast("array<struct<start:int,stop:int,score:double>>")))
    return cut.drop(*[c for c in cut.columns if c.startswith("_")])


def _numbered(kind: str, order: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["score"].alias("score"))


def listed(kinds: tuple[str, ...]) -> Column:
    """(start, order, stop, kind, score) of several kinds in order."""
    order = list(KINDS)
    parts = [F.transform(k, _numbered(k, order.index(k))) for k in kinds]
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def spans_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores."""
    rows = found(docs.select(F.col(key).alias("doc"), F.col(text).alias("whole")), "whole")
    spans = rows.select("doc", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE], listed(BASE).alias("base"), listed(tuple(KINDS)).alias("every"))
    return spans.select(F.col("doc").alias(key), *[f"n_{k}" for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"),
                        F.array_join(F.transform("every", lambda s: F.format_number(s["score"], 1)), ",").alias("scores"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same columns, each span in the text replaced by its kind in angle brackets. Overlapping spans become one,
    named after the first."""
    rows = found(docs, text).withColumn("_spans", listed(tuple(KINDS)))
    reach = lambda i: F.array_max(F.transform(F.slice("_spans", 1, i), lambda s: s["stop"]))
    heads = F.filter(F.transform("_spans", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.when(i > 0, reach(i)).otherwise(0).alias("reach"))), lambda s: s["start"] >= s["reach"])
    rows = rows.withColumn("_heads", heads).withColumn("_end", F.array_max(F.transform("_spans", lambda s: s["stop"])))
    # Before each head stands the text since the spans before it end.
    pieces = F.transform("_heads", lambda h: F.concat(F.substr(F.col(text), h["reach"] + 1, h["start"] - h["reach"]), F.lit("<"), F.upper(h["kind"]), F.lit(">")))
    clean = F.concat(F.array_join(pieces, ""), F.substr(F.col(text), F.col("_end") + 1))
    return rows.withColumn(text, F.when(F.size("_heads") > 0, clean).otherwise(F.col(text))).select(*docs.columns)
