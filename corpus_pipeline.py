"""The corpus pipeline: documents from raw to encoded, one operator a stage.

1. quality: documents whose perplexity under trusted text is above their language's limit go.
2. near_dedup: of each group of near-copies (five-word shingles, similarity 0.8 or more) the smallest id stays.
3. decontamination: documents that hold a benchmark passage go.
4. personal_data: personal data in the text becomes its kind in angle brackets; n_chars follows.
5. encoding: two distinct sampled segmentations of each text.

Each stage takes every row its predecessor kept. Stages 1 to 4 return the columns of documents. Null and empty texts go
in stage 1; repeated rows with one id and text count as one document from stage 2 on; rows without an id pass stage 2
and stage 3 as they are, since nothing links them to another document; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcharge.llm.common import materialise, new_work_path, read_table
from clearcharge.llm.decontaminate import contaminated
from clearcharge.llm.near_dup import near_duplicates
from clearcharge.llm.piece_sampling import segmentations
from clearcharge.llm.pii import masked
from clearcharge.llm.quality import good_documents
from clearcharge.llm.queries import tokenizer_file
from clearcharge.session import broadcast_if_small


# Rows of text that go to a worker and come back at once; JVM and worker hold a batch each way.
BATCH_ROWS = "1000"
# Lattice nodes a worker keeps: fewer than on its own, since the executor still holds what earlier stages needed.
KEPT_NODES = 300_000


def modest(spark: SparkSession) -> None:
    """Stages run one after the other on the same executors, whose memory each leaves as large as it needed it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest(spark)
    return good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest(spark)
    groups = materialise(near_duplicates(docs, words=5, percent=80), "pipeline-groups")
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.limit(1).count() == 0:
        return left
    again = broadcast_if_small(materialise(repeated, "pipeline-repeated"))
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest(spark)
    gone = materialise(contaminated(docs, read_table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id"), "pipeline-contaminated")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest(spark)
    return segmentations(docs, tokenizer_file("piece_bpe_32k.model"), kept_nodes=KEPT_NODES)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("encoding", encoding)]
# Perplexity, sampling and sketches have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stage's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
