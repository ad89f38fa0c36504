"""Rows without a key, and rows of one hot key, stay spread over tasks; far ids do not make one shard."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoebox.llm import common, decontam, license_scan, ngram_join, queries, sharding, suffix_dedup, url_filter, warc

MIT = "Released under the MIT License."


@pytest.fixture
def unbroadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def most_in_a_task(found):
    rows = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    return max(rows), sum(rows)


def largest_share(spark, run, least=2000):
    """Share of the rows of a stage that one of its tasks read from a shuffle, at most, among stages that read ``least`` rows or more."""
    context = spark.sparkContext._jsc.sc()
    store = context.statusStore()

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        none = spark._jvm.java.util.ArrayList()
        return store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)

    listed = stages()
    before = {listed.apply(i).stageId() for i in range(listed.size())}
    run()
    most, listed = 0.0, stages()
    for i in range(listed.size()):
        stage = listed.apply(i)
        if stage.stageId() in before:
            continue
        tasks = store.taskList(stage.stageId(), stage.attemptId(), 1000)
        metrics = [tasks.apply(j).taskMetrics() for j in range(tasks.size())]
        rows = [m.get().shuffleReadMetrics().recordsRead() for m in metrics if m.isDefined()]
        if sum(rows) >= least:
            most = max(most, max(rows) / sum(rows))
    return most


def rows_of(spark, few, many, name, n=400):
    """1 row in a hundred of ``few`` and the rest of ``many``, in 4 even partitions."""
    rows = [(i, few if i % 100 == 0 else many) for i in range(n)]
    return spark.createDataFrame(rows, f"doc_id bigint, {name} string").repartition(4)


@pytest.mark.parametrize("many", [None, "http://clean.example/x/1"])
def test_frequent_urls_without_a_rule(unbroadcast, many):
    pages = rows_of(unbroadcast, "http://b.org/es/9", many, "url", 4000).withColumnRenamed("doc_id", "page_id")
    assert largest_share(unbroadcast, lambda: url_filter.judge_urls(pages, url_filter.rule_table(unbroadcast, queries.URL_RULES)).collect()) < 0.5


@pytest.mark.parametrize("many", [None, "no license in this text at all"])
def test_frequent_texts_without_a_license(unbroadcast, many):
    docs = rows_of(unbroadcast, f"some {MIT} text", many, "text", 4000)
    assert largest_share(unbroadcast, lambda: license_scan.scan(docs, license_scan.template_table(unbroadcast)).collect()) < 0.5


def test_frequent_texts_that_meet_no_window(unbroadcast):
    items = unbroadcast.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id bigint, text string")
    docs = rows_of(unbroadcast, "x a b c d e f g h i j", "a b c d e f and other words", "text", 4000)
    assert largest_share(unbroadcast, lambda: decontam.contamination(docs, items).collect()) < 0.5


def test_frequent_texts_in_the_benchmark_stage(unbroadcast, tmp_path):
    unbroadcast.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = rows_of(unbroadcast, "x a b c d e f g h i j", "clean words only here", "text", 4000).withColumns({"is_hot": F.lit(1), "hot": F.lit(2), "is_hit": F.lit(3), "n": F.lit(4)})
    kept = corpus_pipeline.benchmark_stage(unbroadcast, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert largest_share(unbroadcast, lambda: kept.collect()) < 0.5 and kept.count() == 3960


@pytest.mark.parametrize("shared", [None, 7])
def test_rows_of_one_id_in_the_join_of_sets(unbroadcast, shared):
    docs = unbroadcast.createDataFrame([(i if i < 40 else shared, f"text number {i % 50} of a few words") for i in range(4000)], "doc_id bigint, text string").repartition(4)
    found = ngram_join.join_components(docs, shingle=3, percent=90)
    most, total = most_in_a_task(found)
    assert total == 4000 and most < 2000


def test_copies_of_a_row_in_suffix_dedup(unbroadcast):
    line = "a passage of some words that every copy of this one row has in full, and that is long enough to be found " * 2
    docs = unbroadcast.createDataFrame([(i, f"{i} {line}") if i < 40 else (900, line) for i in range(4000)], "doc_id bigint, text string").repartition(4)
    found = suffix_dedup.remove_repeats(docs)
    most, total = most_in_a_task(found)
    assert total == 4000 and most < 2000
    assert {r["n"] for r in found.where("doc_id = 900").select(F.size("spans").alias("n")).distinct().collect()} == {1}


def test_rows_of_one_key_in_extendible_hashing(unbroadcast):
    rows = [(1 if i % 100 else i, f"text {i}") for i in range(4000)]
    docs = unbroadcast.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    run = lambda: sharding.assign_shards(docs, limit=2000).collect()
    assert largest_share(unbroadcast, run) < 0.5 and len(run()) == 4000


def test_long_items_and_documents_stay_linear(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    items = spark.createDataFrame([(1, long), (2, "w7 w8 w9"), (3, "w5 w6 w7 w8 w9 w10 w11 w12 w13 other")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"before {long} after"), (2, "w1 w2 w3"), (3, "w100 w101 w102 w103 w104 w105 w106 w107 w108 w109 end")], "doc_id bigint, text string")
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontam.contamination(docs, items).collect()}
    assert hits == {1: (200_002, 200_000, ["1", "2"]), 2: (3, 0, []), 3: (11, 10, ["1"])}


@pytest.mark.parametrize("many", [None, "http://a.com/en/1"])
def test_urls_stay_spread(unbroadcast, many):
    pages = rows_of(unbroadcast, "http://b.org/es/9", many, "url").withColumnRenamed("doc_id", "page_id")
    most, total = most_in_a_task(url_filter.judge_urls(pages, url_filter.rule_table(unbroadcast, queries.URL_RULES)))
    assert total == 400 and most <= 200


@pytest.mark.parametrize("many", [None, "x", "y" * 2000])
def test_records_stay_spread(unbroadcast, many):
    pages = rows_of(unbroadcast, "z" * 3000, many, "html").withColumns({"page_id": F.col("doc_id"), "url": F.lit("u")})
    most, total = most_in_a_task(warc.records(pages))
    assert total == 400 and most <= 200


@pytest.mark.parametrize("many", [None, "no license here at all", f"so {MIT} yes"])
def test_licenses_stay_spread(unbroadcast, many):
    docs = rows_of(unbroadcast, MIT, many, "text")
    found = license_scan.scan(docs, license_scan.template_table(unbroadcast))
    most, total = most_in_a_task(found)
    assert total == 400 and most <= 200
    assert found.where("size(licenses) > 0").count() == (400 if many and MIT in many else 4)


@pytest.mark.parametrize("many", [None, "clean words only", "a b c d e f g h i j k"])
def test_decontaminated_rows_stay_spread(unbroadcast, many):
    items = unbroadcast.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, None)], "item_id bigint, text string")
    found = decontam.contamination(rows_of(unbroadcast, "x a b c d e f g h i j", many, "text"), items)
    most, total = most_in_a_task(found)
    assert total == 400 and most <= 200
    hit = found.where("contaminated").collect()
    assert len(hit) == (400 if many and "j k" in many else 4) and all((r["n_hit"], r["item_ids"]) == (10, ["1", "2"]) for r in hit)


def test_join_back_equals_a_left_join(unbroadcast):
    left = unbroadcast.createDataFrame([(k, i) for i, k in enumerate([None] * 5 + ["hot"] * 5000 + [f"k{i % 7}" for i in range(20)])], "k string, i int")
    right = left.where("k IS NOT NULL AND k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most"))
    got = common.join_back(left, right, "k")
    assert got.columns == ["k", "i", "most"]
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right.drop("n"), "k", "left").collect()))


@pytest.mark.parametrize("far", [2**60, 2**63 - 1])
def test_one_far_id_does_not_make_one_shard(spark, tmp_path, far):
    rows = [(i, f"u{i}", "x" * 100) for i in [*range(500), far, -far]] + [(None, f"n{i}", "x" * 100) for i in range(30)] + [(7, f"v{i}", f"{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    shards, n = warc._with_shards(warc.records(pages), 22_000)
    sizes = shards.groupBy("shard").agg(F.sum(F.col("payload_bytes") + 1024).alias("b"), F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("shard").collect()
    assert sum(r["n"] for r in sizes) == 732 and max(r["b"] for r in sizes) <= 22_000 and max(r["shard"] for r in sizes) < n
    known = [r for r in sizes if r["low"] is not None]
    assert all(a["high"] <= b["low"] for a, b in zip(known[:-1], known[1:], strict=True))
    assert warc.archive(pages, f"file://{tmp_path}/far", shard_bytes=22_000).count() == 732


def test_equal_keys_are_dealt_to_shards_that_fit(spark):
    rows = [(1, "same " * 20)] * 300 + [(1, f"other {i} " * 10) for i in range(300)] + [(i, "x" * 50) for i in range(2, 200)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=2000)
    assert got.count() == 798 and got.groupBy("shard").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] <= 2000


def test_texts_above_a_chunk(spark):
    long = " ".join(f"w{i}" for i in range(180_000))
    assert len(long) > 1_100_000
    docs = spark.createDataFrame([(1, f"{long} {MIT}"), (2, long), (3, f"a b c d e f g h i j {long} a b c d e f g h i j")], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["licenses"], r["n_windows"]) for r in license_scan.scan(docs, license_scan.template_table(spark)).collect()}
    assert found[1][0] == ["MIT"] and found[2] == found[3] == ([], 0)
    items = spark.createDataFrame([(1, "A b c d e f g h i j")], "item_id bigint, text string")
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontam.contamination(docs, items).collect()}
    assert hits == {1: (180_005, 0), 2: (180_000, 0), 3: (180_020, 20)}
    shards = {r["doc_id"]: r["n_bytes"] for r in sharding.assign_shards(docs, limit=1 << 20).collect()}
    assert shards == {1: len(long) + 1 + len(MIT), 2: len(long), 3: len(long) + 40}
