"""Findings of reviews, each on a table small enough to read."""

import random
import re
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from shoebox.functions.terms import TAG_WEIGHTS, text_index
from shoebox.operators import people, search
from shoebox.plans import ingest as ingest_plans
from shoebox.plans import library, search as search_plans  # noqa: F401
from shoebox.sources.files import scratch
from shoebox.sources.tables import load, table_sql


def test_alias_expansion_keeps_separators_as_its_sql_does(spark):
    terms = ["555-0303", "a_b", "-the-", "the", "x\n\ny", "v\x0bt", "der"]
    got = ingest_plans.ing13_alias_expand(spark.createDataFrame([(terms,)], "object_tags array<string>"))
    con = duckdb.connect()
    con.execute("CREATE TABLE analysis AS SELECT ? AS object_tags", [terms])
    own = "WITH" + library.SQL["ing13_alias_expand"].split("JOIN orders ON o_orderkey = doc_id),", 1)[1]
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(own).fetchall())


def _folder_bytes(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def _new_words(spark, n, words):
    """``n`` photos and analyses whose captions are words that no other has, with one that many have."""
    caption = F.concat_ws(" ", F.lit("common"), F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.sha1(F.concat_ws("-", F.col("id").cast("string"), i.cast("string")))))
    none = F.array().cast("array<string>")
    rows = spark.range(1, n + 1).select(F.lit(1).cast("bigint").alias("project_id"), F.col("id").alias("photo_id"), caption.alias("caption"), F.lit(None).cast("string").alias("ocr_text"), *(none.alias(c) for c in TAG_WEIGHTS))
    at = F.lit("2024-01-01").cast("timestamp")
    photos = spark.range(1, n + 1).select("id", F.lit(1).cast("bigint").alias("project_id"), F.concat(F.lit("img_"), F.col("id").cast("string")).alias("file_name"), at.alias("taken_at"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return photos, rows


def test_a_batch_of_requests_writes_no_words(spark):
    photos, analysis = _new_words(spark, 300, 100)
    queries = spark.createDataFrame([(1, 7, ["common"], ["img_299"])], "project_id bigint, query_id bigint, exact_terms array<string>, expanded_terms array<string>")
    folder = scratch(spark).removeprefix("file:").rsplit("/", 1)[0]
    before = _folder_bytes(folder)
    got = {r["photo_id"]: (r["score"], r["term_hits"]) for r in search.keyword_recall(queries, photos, analysis).collect()}
    assert len(got) == 300 and got[299] == (round((30 + 7) / (2 * 290), 4), ["exact:common", "strong:img_299"]) and got[1][1] == ["exact:common"]
    # The captions are 1.2 MB of words that no other photo has.
    assert _folder_bytes(folder) - before < 200_000


def test_a_given_index_finds_what_the_texts_hold(spark):
    photos, analysis = _new_words(spark, 40, 5)
    queries = spark.createDataFrame([(1, 7, ["common", "img_3"], ["ab", "n 0"], ["a"])], "project_id bigint, query_id bigint, exact_terms array<string>, expanded_terms array<string>, negative_terms array<string>")
    rows = lambda index: sorted(map(repr, search.keyword_recall(queries, photos, analysis, index=index).collect()))
    assert rows(None) == rows(text_index(search.searched_texts(photos, analysis)))


def test_analysis_leaves_words_behind_before_it_is_joined(spark):
    table = load(spark, "/root/testdata/sf0.001", "analysis")
    same = spark.sql(re.sub(r"(FROM|JOIN) (documents|orders)\b", r"\1 {\2}", table_sql("analysis", "spark")), **{t: load(spark, "/root/testdata/sf0.001", t) for t in ("documents", "orders")})
    assert table.schema.names == same.select(table.columns).schema.names and table.exceptAll(same.select(table.columns)).isEmpty() and table.count() == same.count()
    plan = table.select("project_id", "photo_id", "scene_tags")._jdf.queryExecution().optimizedPlan().toString()
    # Tags are cut below the join, so neither a text nor its words go through it.
    assert "slice(" in plan and "slice(" not in plan[: plan.index("Join")]


def test_rebuild_summary_hashes_texts_once(spark):
    found = library.QUERIES["ing18_rebuild_summary"](spark, "/root/testdata/sf0.001")
    # States come from written hashes; the plan that is left reads no text.
    assert "sha2(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_chain_of_recalls_writes_less_than_its_texts(spark):
    folder = scratch(spark).removeprefix("file:").rsplit("/", 1)[0]
    before = _folder_bytes(folder)
    assert library.QUERIES["sch23_summary"](spark, "/root/testdata/sf0.001").count() > 0
    texts = load(spark, "/root/testdata/sf0.001", "documents").agg(F.sum(F.length("text"))).first()[0]
    assert _folder_bytes(folder) - before < texts


def test_boxes_meet_in_cells_only_in_crowds(spark):
    rng = random.Random(5)
    box = lambda: (rng.randrange(60), rng.randrange(60), rng.randrange(1, 40), rng.randrange(1, 40))
    old = [(1, i % 5, *box(), i) for i in range(120)]
    new = [(1, i % 5, *(box() if i % 3 else old[i][2:6]), i) for i in range(120)]
    table = lambda rows, name: spark.createDataFrame(rows, f"project_id bigint, photo_id bigint, x bigint, y bigint, w bigint, h bigint, {name} bigint")
    found = lambda crowd: sorted(map(repr, people.reconcile_boxes(table(old, "face_id"), table(new, "place"), crowd=crowd).collect()))
    assert found(0) == found(22) == found(1000)
    cells = table(new, "place").select(F.size(people._cells("x", "y", "w", "h", (-1, 0, 1), F.col("photo_id") == 4)).alias("n"), "photo_id").groupBy("photo_id").agg(F.max("n").alias("n")).collect()
    assert {r["photo_id"]: r["n"] == 1 for r in cells} == {0: True, 1: True, 2: True, 3: True, 4: False}
