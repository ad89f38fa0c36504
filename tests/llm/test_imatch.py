"""I-Match fingerprints against a plain count of terms, edits of edge texts, and SQL."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shoebox.llm import imatch, queries


def texts(rng, n, words=3000):
    """Texts of words whose frequencies fall off, some equal."""
    made = []
    for _ in range(n):
        made.append(" ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(rng.randrange(1, 400))) if rng.random() > 0.1 or not made else rng.choice(made))
    return made


def plain_edit(rows):
    """(doc_id, edited) in the order of ids."""
    rows = sorted(rows)
    n = len(rows)
    return [(i, t[: len(t) - len(t) // 4] + rows[(k + 1) % n][1][: len(t) // 4]) for k, (i, t) in enumerate(rows)]


def test_lexicon_is_the_band(spark):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(texts(rng, 300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = imatch.lexicon(docs, least=2, most=6)
    df = {}
    for _, t in rows:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    terms = spark.createDataFrame([(w,) for w in df], "w string")
    found = {r[0] for r in terms.where(held.holds(F.md5("w"))).collect()}
    want = {w for w, n in df.items() if n * 4 <= 300 and n * 64 >= 300}
    assert want and want <= found and len(found - want) <= 0.02 * len(df)


def test_fingerprint_by_hand(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(texts(rng, 200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs, least=-1, most=60).collect()}
    for i, t in rows:
        terms = sorted(hashlib.md5(w.encode()).hexdigest() for w in set(t.split()))
        level = min(14, (len(terms)).bit_length())
        parts = ""
        for j in range(16):
            for k in range(3):
                inside = [x for x in terms if int((x + x[:2])[2 * j : 2 * j + 4], 16) < 1 << (16 - level - k)]
                parts += hashlib.md5("".join(inside).encode()).hexdigest()[:6] if inside else "......"
        assert found[i] == f"{level:02}:{parts}"


def test_edits_and_likeness(spark):
    rng = random.Random(3)
    rows = [(i * 7, t) for i, t in enumerate(texts(rng, 400))]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id bigint, text string, digest string, fingerprint string, range int").repartition(5)
    found = {r["doc_id"]: r for r in imatch.edits(docs).collect()}
    want = dict(plain_edit(rows))
    assert {i: r["edited"] for i, r in found.items()} == want
    of_text = {}
    for i, t in rows:
        of_text.setdefault(t, set()).add(found[i]["fingerprint"])
        assert found[i]["n_chars"] == len(t) and 0 <= found[i]["near_next"] <= 1 and 0 <= found[i]["near_edited"] <= 1
    assert all(len(x) == 1 for x in of_text.values())
    ids = [i for i, _ in rows]
    for here, there in zip(ids, ids[1:] + ids[:1], strict=True):
        if found[here]["fingerprint"] == found[there]["fingerprint"]:
            assert found[here]["near_next"] == 1
    closer = [r["near_edited"] > r["near_next"] for i, r in found.items() if r["n_chars"] > 300 and r["near_next"] < 1]
    assert sum(closer) > 0.9 * len(closer)


def test_edits_of_edge_texts(spark):
    rows = [(None, "ünïcödé text, with words"), (1, None), (2, ""), (3, "..., !"), (4, "one"), (5, "four words are here"), (5, "another text of that id"), (6, "same same same text"), (6, "same same same text"), (7, "x" * 1_200_000), (8, "é" * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = imatch.edits(docs).collect()
    assert len(found) == len(rows)
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    order = sorted({(-1 if i is None else i, digest(t or ""), t or "") for i, t in rows})
    want = [(i, t, t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][2][: len(t) // 4]) for k, (i, _, t) in enumerate(order)]
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited"]) for r in found]
    assert sorted(set(got)) == sorted({(i, len(t), e) for i, t, e in want}) and sum(i == 6 for i, *_ in got) == 2
    empty = [r for r in found if r["n_chars"] == 0]
    assert all(r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"] for r in empty)
    assert {r["near_next"] for r in found if r["doc_id"] == 1} == {1.0} and {r["near_next"] for r in found if r["doc_id"] == 4} == {0.0}
    alone = imatch.edits(docs.where("doc_id = 4")).collect()
    assert [(r["edited"], r["near_edited"], r["near_next"]) for r in alone] == [("one", 1.0, 1.0)]
    assert imatch.edits(docs.limit(0)).count() == 0 and imatch.fingerprints(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_query_equals_sql(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(texts(rng, 150))] + [(200, None), (201, ""), (202, "!!"), (203, "Ää ß"), (204, "long " * 3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_document_fingerprints(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"SELECT {names} FROM ({queries.OP12_SQL})").fetchall())
