import random

import corpus_pipeline
from tests.llm.test_near_dup import plain as components
from tests.llm.test_decontamination import plain as overlap


def test_stages_keep_what_plain_versions_keep(spark, documents, prose, tmp_path):
    r = random.Random(1)
    clean = [prose(80, i) for i in range(120)]
    texts = [*clean, clean[3], clean[4] + " tail", *[" ".join(w + "%%%" for w in prose(50, 700 + i).split()) for i in range(10)], clean[9][:200] + " write q@r.st " + prose(60, 800), prose(40, 901) + " " + prose(30, 900), None, ""]
    docs = documents(texts).drop("hash")
    labels = [(i, 1, 0) for i in range(120) if r.random() < 0.8]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, prose(30, 900)), (2, "never seen anywhere in these texts at all here")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "encoding"]
    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id: x for x in table.collect()}
        assert len(kept[name]) == table.count()
    assert sorted(kept["quality"]) == [*range(122), 132, 133]
    order = sorted(kept["quality"])
    heads = {order[c] for _, _, c in components([texts[i] for i in order], 5)}
    assert set(kept["near_dedup"]) == heads and 120 not in heads and 121 not in heads
    assert set(kept["decontamination"]) == {i for i in heads if not overlap(texts[i], items)[4]} == heads - {133}
    assert "<EMAIL>" in kept["personal_data"][132].text and "q@r.st" not in kept["personal_data"][132].text
    assert all(x.n_chars == len(x.text) for x in kept["personal_data"].values())
    assert all(kept["personal_data"][i].text == texts[i] for i in kept["personal_data"] if i != 132)
    encoded = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
    assert {x.doc_id for x in encoded} == set(kept["personal_data"]) and all(x.decoded for x in encoded)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, encoded))


def test_repeated_rows_leave_one(spark, documents, prose):
    docs = documents([prose(40, 1), prose(40, 2)])
    out = corpus_pipeline.near_dedup(spark, docs.union(docs), "")
    assert sorted(x.doc_id for x in out.collect()) == [0, 1] and out.columns == docs.columns


def test_registered_queries_equal_their_sql(spark):
    from clearcharge.llm import queries
    from tests.oracle import connect, rows_of_duck, rows_of_spark

    folder = "/root/testdata/sf0.001"
    for name, sql in queries.ORACLES.items():
        assert rows_of_spark(queries.QUERIES[name](spark, folder)) == rows_of_duck(connect(folder), sql), name
