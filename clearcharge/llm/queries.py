"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clearcharge.llm.common import F, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Exact token counts of whole documents, and how much of each fits in 512 tokens."""
    from clearcharge.llm.token_counts import token_prefixes

    counted = token_prefixes(read_table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), 512, keep_table=False)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.c + nb.c - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT k.doc_id, coalesce(n.c, 0) AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)"""


@register("op2_minhash_near_dedup", NEAR_SQL)
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a similarity of 0.8 or more."""
    from clearcharge.llm.near_dup import near_duplicates

    return near_duplicates(read_table(spark, folder, "documents"), words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


# Each ten-word window of each item (or the whole of a shorter one) against each document's windows of that length.
DECONTAMINATION_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM benchmark),
g AS (SELECT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 10, 0) + 2), lambda i: array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' '))) AS s FROM iw WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS s FROM p),
h AS (SELECT doc_id, i, k, item_id FROM dg JOIN (SELECT DISTINCT * FROM g) g USING (k, s)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)"""


@register("op5_decontamination", DECONTAMINATION_SQL)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document, by winnowing."""
    from clearcharge.llm.decontaminate import contaminated

    return contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@register("op7_balanced_label_propagation")
def op7_balanced_label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of equal row counts, equal texts together."""
    from clearcharge.llm.sharding import sharded

    return sharded(read_table(spark, folder, "documents"))


def _found_sql(kind: str, expression: str, keep: str) -> str:
    """Spans of a kind: pieces between matches and matches, added up."""
    return f"""SELECT doc_id, '{kind}' AS kind, start, start + length(m) AS stop FROM (
  SELECT doc_id, ms[i + 1] AS m, ps[i + 1] AS piece, list_sum(list_transform(list_slice(ps, 1, i + 1), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i), lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, ms, ps, unnest(range(len(ms))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{expression}') AS ms, string_split_regex(t, '{expression}') AS ps FROM d))) WHERE {keep}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: (CAST(reverse({_DIGITS})[j] AS INT) * (2 - j % 2)) // 10 + (CAST(reverse({_DIGITS})[j] AS INT) * (2 - j % 2)) % 10)) % 10 = 0"
_ROTATED = "(m[5:] || m[:4])"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(range(1, length(m) + 1), lambda j: ord({_ROTATED}[j]))), lambda s, c: CASE WHEN c >= 65 THEN (s * 100 + c - 55) % 97 ELSE (s * 10 + c - 48) % 97 END) = 1"
PII_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join([
    _found_sql('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+', 'true'),
    _found_sql('ip', '[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)', "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"),
    _found_sql('card', '[0-9](?:[ -]?[0-9])+', f'length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}'),
    _found_sql('phone', '\\+[0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 9 AND 15'),
    _found_sql('iban', '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}', _MOD97),
    _found_sql('ssn', '[0-9]{3}-[0-9]{2}-[0-9]{4}', "regexp_matches(lower(right(piece, 40)), 'ssn|social security')")])}),
o AS (SELECT *, list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn'], kind) AS k, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS x FROM s),
a AS (SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
  string_agg(x, ',' ORDER BY start, k) FILTER (k <= 4) AS base, string_agg(x, ',' ORDER BY start, k) AS spans FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN a USING (doc_id)"""


@register("op9_personal_data", PII_SQL)
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Emails, addresses, cards, phones, accounts and numbers of persons in every document, as code point spans."""
    from clearcharge.llm.pii import spans_of

    return spans_of(read_table(spark, folder, "documents")).drop("scores")


@register("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    from clearcharge.llm.html_text import extract

    return extract(read_table(spark, folder, "pages"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@register("op4_exact_top_k", TOP_K_SQL)
def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector with all others."""
    from clearcharge.llm.vector_search import exact_top_k

    return exact_top_k(read_table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@register("op6_kneser_ney")
def op6_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under a model of the documents that are not held out."""
    from clearcharge.llm.kneser_ney import scored, train

    docs = read_table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@register("op3_sentencepiece_sampling")
def op3_sentencepiece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, piece ids and all, with inclusion scores and a round trip."""
    from clearcharge.llm.piece_sampling import segmentations

    return segmentations(read_table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@register("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and whether it is kept."""
    from clearcharge.llm.quality import Classifier

    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    classifier = Classifier(docs, read_table(spark, folder, "labels"))
    return classifier.classify(docs).select("doc_id", "lang", "n_words", "perplexity", "limit", "kept")


@register("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two vocabularies brought together by the bytes they cover, over every document."""
    from clearcharge.llm.token_alignment import aligned

    files = [tokenizer_file(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    return aligned(read_table(spark, folder, "documents"), *files).documents


@register("op12_lanczos_whitening")
def op12_lanczos_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen whitened components of every vector."""
    from clearcharge.llm.whitening import whitened

    return whitened(read_table(spark, folder, "embeddings"))


@register("op11_url_filter")
def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rules, then naive Bayes over segmented hosts and paths, for every page's URL."""
    from clearcharge.llm.url_filter import judged

    return judged(read_table(spark, folder, "pages"), read_table(spark, folder, "documents"))
