import zlib

import pytest

from clearcharge.llm.sharding import cut_links, propagate, sharded


def test_counts_slots_and_sizes(spark, documents, prose):
    texts = [prose(5 + i % 7, i % 40 if i % 3 else 1_000 + i) for i in range(330)] + [None, "", "é"]
    docs = documents(texts)
    got = sharded(docs, 7).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)
    assert len(got) == len(texts) and sorted(by) == list(range(7))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_copies_move_together(spark, documents, prose):
    texts = [prose(6, i // 3) if i < 240 else prose(6, 5_000 + i) for i in range(700)]
    before, after = (cut_links(propagate(documents(texts), 10, n)).first() for n in (0, 4))
    assert before.linked == after.linked == 240
    assert after.apart < before.apart / 5


def test_a_third_of_all_rows_alike(spark, documents, prose):
    texts = ["same"] * 200 + [prose(6, i) for i in range(400)]
    docs = documents(texts)
    state = propagate(docs, 10, 5)
    sizes = [r["count"] for r in state.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 600
    alike = state.filter("id < 200").groupBy("shard").count().collect()
    assert len(alike) < 10 and max(r["count"] for r in alike) >= 20


@pytest.mark.parametrize("n", [0, 3])
def test_fewer_rows_than_shards(spark, documents, n):
    docs = documents(["a"] * n)
    assert sorted(r.slot for r in sharded(docs.union(docs), 40).collect()) == [0] * (2 * n)


def test_same_rows_same_shards(spark, documents, prose):
    docs = documents([prose(5, i // 2) for i in range(120)])
    assert sorted(map(tuple, sharded(docs, 6).collect()), key=str) == sorted(map(tuple, sharded(docs.repartition(5), 6).collect()), key=str)


def test_no_python_in_the_plan(spark, documents, prose):
    plan = sharded(documents([prose(4, i) for i in range(20)]), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("copies,n,shards", [(2, 200, 10), (4, 400, 10), (3, 330, 10), (2, 202, 7)])
def test_tables_of_linked_rows_only(spark, documents, prose, copies, n, shards):
    state = propagate(documents([prose(9, 70_000 + i // copies) for i in range(n)]), shards).cache()
    sizes = [r["count"] for r in state.groupBy("shard").count().collect()]
    assert len(sizes) == shards and max(sizes) - min(sizes) <= 1 and state.select("id").distinct().count() == sum(sizes) == n
    links = cut_links(state).first()
    # quotas that are no multiple of a group leave at most one group's rest in each shard
    assert links.linked >= n - copies and links.apart <= sum(s % copies for s in sizes)
