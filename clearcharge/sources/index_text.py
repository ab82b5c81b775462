"""Index files: `key: value` lines, one entry per location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import web
from clearcharge.operators.running import running_sum

_LINE = r"(?i)^\s*(" + "|".join(fv.INDEX_KEYS) + r")\s*:\s*(.*?)\s*$"


def index_lines(texts: DataFrame) -> DataFrame:
    """(index_id, line_no, line) of whole index texts."""
    return texts.select("index_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))


def read_index_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(index_id, text) of landed index files; pages that are not an index stay out."""
    texts = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("index_id"), F.col("value").alias("text"))
    return texts.filter(web.looks_like_index(F.col("text")))


def parse_index(lines: DataFrame) -> DataFrame:
    """Entries of index lines. A `location-name` opens an entry, the last value of a repeated
    key wins, other text is skipped, an entry without a name is dropped."""
    keyed = lines.select(
        "index_id", "line_no", F.lower(F.regexp_extract("line", _LINE, 1)).alias("key"),
        F.trim(F.regexp_extract("line", _LINE, 2)).alias("value"), (F.col("line").rlike(_LINE)).alias("fits"))
    opened = running_sum(keyed, "index_id", "line_no", F.when(F.col("key") == "location-name", 1).otherwise(0), "entry_no").filter("fits")

    def last(key: str):
        here = F.col("key") == key
        return F.nullif(F.max_by(F.when(here, F.col("value")), F.when(here, F.col("line_no"))), F.lit("")).alias(key.replace("-", "_"))

    entries = opened.groupBy("index_id", "entry_no").agg(*[last(k) for k in fv.INDEX_KEYS])
    return entries.filter(F.col("location_name").isNotNull())
