"""The pipeline's stages, and whole queries against their SQL on a small table."""

import random

import pytest

import corpus_pipeline
from shoebox.llm import queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(rng):
    vocabulary = {"en": ["the", "and", "thing", "with", "other", "that"], "de": ["der", "und", "nicht", "zeit", "haus", "über"]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["ing", "er", "ly", ""]) * rng.randrange(3) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de", 60), "en" if i % 2 else "de", "s", 1) for i in range(40)]
    passage = text("en", 60)
    rows += [(50, rows[3][1], "en", "s", 1), (51, rows[4][1] + " more", "de", "s", 1), (52, text("en", 70) + " " + passage, "en", "s", 1), (53, passage + " " + text("en", 70), "en", "s", 1)]
    rows += [(60, None, "en", "s", 1), (61, "123 456", None, "s", 1), (62, "", "en", None, None), (None, text("de", 50), "de", "s", 1), (7, rows[7][1], "en", "s", 1)]
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = corpus(random.Random(4))
    leak = rows[11][1]
    spark.createDataFrame([(1, " ".join(leak.split()[5:20]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[k] = docs.collect()
    ids = {k: sorted(str(r["doc_id"]) for r in v) for k, v in kept.items()}
    assert not {"60", "61", "62"} & set(ids[0]) and {str(i) for i in range(40)} | {"50", "51", "52", "53", "None"} == set(ids[0])
    assert set(ids[1]) == set(ids[0]) - {"50", "51"} and len(ids[1]) == len(set(ids[1]))
    texts = {r["doc_id"]: r for r in kept[2]}
    assert passage in texts[52]["text"] and passage[10:-10] not in texts[53]["text"]
    assert all(r["n_chars"] == len(r["text"]) for i, r in texts.items() if i == 53)
    assert "11" in ids[2] and set(ids[3]) == set(ids[2]) - {"11"}
    assert ids[4] == ids[3] and all(r["decoded"] == texts[r["doc_id"]]["text"] for r in kept[4])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, kept[4]))


CLASH = f"{SCHEMA}, row_id string, digest string, text_digest string, n string, id string, row string, is_hit string"


def test_near_duplicates_lose_no_text_for_its_id(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    a, b, c, d, long = text(50), text(50), text(50), text(50), text(250_000)
    assert len(long) > 1_000_000
    rows = [(1, a), (1, b), (1, a), (2, a + " more"), (3, b), (None, c), (None, c), (None, d), (4, d), (5, None), (5, None), (5, ""), (6, long), (7, long + " end")] + [(100 + i, f"{c} {i}") for i in range(300)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x", "y", "z", "n", "i", "r", "h") for r in rows], CLASH)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert found == sorted([(1, a), (1, b), (None, c), (None, d), (5, None), (5, None), (5, ""), (6, long)], key=repr)


def test_stages_keep_rows_with_clashing_names(spark, tmp_path):
    rows, _ = corpus(random.Random(9))
    spark.createDataFrame([(1, " ".join(rows[11][1].split()[5:20]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = spark.createDataFrame([(*r[:2], r[2], r[3], r[4]) for r in rows] * 2, SCHEMA)
    wide = spark.createDataFrame([(*r, "x", "y", "z", "n", "i", "r", "h") for r in rows] * 2, CLASH)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, str(tmp_path))
        assert got.columns == wide.columns
        assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, stage(spark, plain, str(tmp_path)).collect()))


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_warc", "op4_extendible_hashing", "op5_license_scan", "op7_ngram_jaccard_join", "op9_decontamination"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = queries.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    mine = sorted(map(repr, (tuple(r) for r in found.select(columns).collect())))
    assert mine == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()))
