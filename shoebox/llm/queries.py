"""The training-data operators on their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import ann, clustering, decontam, imatch, language_id, license_scan, ngram_join, periodic_runs, sentencepiece_codec, sharding, suffix_dedup, url_filter, warc
from shoebox.llm.common import let, table

#: The file of the SentencePiece model; a parameter of the environment, else that of the installed public tokenizers.
PIECE_MODEL = os.environ.get("SHOEBOX_PIECE_MODEL", "piece_bpe_32k.model")


def piece_model() -> str:
    if os.path.sep in PIECE_MODEL:
        return PIECE_MODEL
    import public_tokenizers

    return str(public_tokenizers.path(PIECE_MODEL))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned_languages(docs: DataFrame) -> language_id.LanguageModel:
    return language_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, learned_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "noise")


URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


OP2_SQL = """
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, r_host, r_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, r_host || r_path AS rule, verdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM u JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path AND m.k = 1
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.archive(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS b FROM pages),
q AS (SELECT page_id, h, b, CASE WHEN b >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS head FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to
FROM q
"""

#: Bytes of text in a shard.
SHARD_LIMIT = 1 << 20


def op4_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), limit=SHARD_LIMIT)


def _op4_sql() -> str:
    """All 32 depths of the first address word; more are needed only for equal keys or digests."""
    deepest = 32
    sums = ", ".join(f"sum(b) OVER (PARTITION BY w >> {32 - d}) AS s{d}, count(*) OVER (PARTITION BY w >> {32 - d}) AS c{d}" for d in range(deepest + 1))
    first = " ".join(f"WHEN s{d} <= {SHARD_LIMIT} OR c{d} = 1 THEN {d}" for d in range(deepest))
    return f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b, CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS w FROM documents),
s AS (SELECT doc_id, b, w, {sums} FROM d),
x AS (SELECT doc_id, b, w, CASE {first} ELSE {deepest} END AS depth FROM s)
SELECT doc_id, substring(lpad(bin(w), 32, '0'), 1, depth) AS shard, CAST(depth AS INTEGER) AS depth, CAST(b AS BIGINT) AS n_bytes FROM x
"""


OP4_SQL = _op4_sql()


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), license_scan.template_table(spark))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_windows")


def _op5_sql() -> str:
    written = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in license_scan.TEMPLATES)
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS tid, license, {words} AS w FROM (VALUES {written}) v(license, text)),
ts AS (SELECT DISTINCT tid, license, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT tid, license, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM t)),
tn AS (SELECT tid, count(*) AS n, CAST(ceil(log2(count(*))) AS BIGINT) AS c FROM ts GROUP BY tid),
d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, i - 1 AS i, greatest(len(w) - 5, 0) + 1 AS m, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
h AS (SELECT doc_id, i, m, ts.tid, license, n, g, CAST(pow(2, c) AS BIGINT) AS k FROM s JOIN ts USING (g) JOIN tn ON tn.tid = ts.tid),
p AS (SELECT doc_id, tid, license, n, g, unnest([i // k, i // k - 1]) AS win, greatest(0, CAST(ceil((m - 2 * k) / k) AS BIGINT)) AS final FROM h),
f AS (SELECT doc_id, tid, license, win FROM p WHERE win BETWEEN 0 AND final GROUP BY doc_id, tid, license, win, n HAVING 100 * count(DISTINCT g) >= 80 * n),
r AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n_windows FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_windows, 0) AS n_windows FROM documents LEFT JOIN r USING (doc_id)
"""


OP5_SQL = _op5_sql()


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(x.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) x ON x.doc_id = d.doc_id
"""


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(substring(x, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM d WHERE len(x) >= 200)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS o FROM r),
i AS (SELECT doc_id, p, sum(o) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
t AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM t),
y AS (
  SELECT doc_id, string_agg(substring(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS h, max(b) AS z, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN y.doc_id IS NULL THEN x ELSE h || substring(x, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.col("n_hit").cast("bigint").alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items,
  sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), piece_model())
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(table(spark, sf_dir, "embeddings"), dims=64, k=40, rounds=5, scale=256, seed=2)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op11_sql(rounds: int = 5, k: int = 40) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.rid, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{r} m ON m.i = v.i GROUP BY v.rid, m.c)
  GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (rid) GROUP BY c, i),
m{r + 1} AS MATERIALIZED (
  SELECT c, i, CASE WHEN s IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM m{r} LEFT JOIN s{r} USING (c, i))""")
    return f"""
WITH k AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT rid, unnest(range(64)) AS i, CAST(unnest(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS BIGINT) AS x FROM k),
o AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), CAST(embedding AS DOUBLE[])) - 1 AS c FROM k WHERE vec_id IS NOT NULL),
m0 AS MATERIALIZED (SELECT c, i, x FROM o JOIN v USING (rid) WHERE c < {k}),{",".join(steps)},
z AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, z.h AS centroid_sha256
FROM a{rounds} a JOIN k USING (rid) JOIN z ON z.c = a.c
"""


OP11_SQL = _op11_sql()


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


#: Lexicon frequencies are counted and its filter is built in SQL too. All three texts of a row (own, edited, next) are fingerprinted.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS total, doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS u
  FROM documents),
e AS (SELECT *, left(t, n - n // 4) || left(u, n // 4) AS v FROM d),
x AS (SELECT r, 0 AS kind, t AS text FROM e UNION ALL SELECT r, 1, v FROM e),
w AS (
  SELECT DISTINCT r, kind, md5(unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS m FROM x),
k AS (SELECT *, CAST('0x' || substring(m, 1, 15) AS BIGINT) AS key FROM w),
f AS (SELECT key FROM k, (SELECT max(total) AS total FROM d) WHERE kind = 0 GROUP BY key, total HAVING count(*) * 32 <= total AND count(*) * 8192 >= total),
g AS (SELECT least(26, greatest(16, CAST(ceil(log2(greatest(count(*), 1) * 32)) AS BIGINT))) AS log FROM f),
s AS (SELECT key >> CAST(60 - log AS INTEGER) AS slot FROM f, g UNION SELECT key & ((1::BIGINT << CAST(log AS INTEGER)) - 1) FROM f, g),
i AS (
  SELECT r, kind, m, key >> CAST(60 - log AS INTEGER) IN (SELECT slot FROM s) AND key & ((1::BIGINT << CAST(log AS INTEGER)) - 1) IN (SELECT slot FROM s) AS held FROM k, g),
h AS (SELECT r, kind, m FROM i WHERE held UNION ALL SELECT r, kind, m FROM i WHERE (r, kind) NOT IN (SELECT (r, kind) FROM i WHERE held)),
c AS (SELECT r, kind, least(14, CAST(floor(log2(count(*))) AS BIGINT) + 1) AS level FROM h GROUP BY r, kind),
y AS (
  SELECT r, kind, j, q, substring(md5(string_agg(m, '' ORDER BY m)), 1, 6) AS p
  FROM h JOIN c USING (r, kind) CROSS JOIN (SELECT unnest(range(16)) AS j) CROSS JOIN (SELECT unnest(range(3)) AS q)
  WHERE substring(m || substring(m, 1, 2), 2 * j + 1, 4) < printf('%04x', 1::BIGINT << CAST(16 - q - level AS INTEGER)) GROUP BY r, kind, j, q),
z AS (
  SELECT r, kind, level, j, q, level + q AS depth, coalesce(p, '......') AS p
  FROM c CROSS JOIN (SELECT unnest(range(16)) AS j) CROSS JOIN (SELECT unnest(range(3)) AS q) LEFT JOIN y USING (r, kind, j, q)),
o AS (
  SELECT x.r, x.kind, coalesce(lpad(CAST(level AS VARCHAR), 2, '0') || ':' || string_agg(p, '' ORDER BY j, q), '--:' || md5(any_value(x.text))) AS print
  FROM x LEFT JOIN z ON z.r = x.r AND z.kind = x.kind GROUP BY x.r, x.kind, level),
l AS (
  SELECT a.r, b.kind AS edited, CAST(count(*) FILTER (a.p = b.p) AS DOUBLE) / greatest(1, count(*)) AS near
  FROM z a JOIN z b ON a.kind = 0 AND ((b.kind = 1 AND b.r = a.r) OR (b.kind = 0 AND b.r = a.r % (SELECT max(total) FROM d) + 1)) AND a.j = b.j AND a.depth = b.depth
  WHERE a.p <> '......' OR b.p <> '......' GROUP BY a.r, b.kind)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.v) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
  CASE WHEN a.print = b.print THEN 1.0 ELSE coalesce(m.near, 0.0) END::DOUBLE AS near_edited, CASE WHEN a.print = n.print THEN 1.0 ELSE coalesce(o2.near, 0.0) END::DOUBLE AS near_next
FROM e JOIN o a ON a.r = e.r AND a.kind = 0 JOIN o b ON b.r = e.r AND b.kind = 1 JOIN o n ON n.r = e.r % e.total + 1 AND n.kind = 0
LEFT JOIN l m ON m.r = e.r AND m.edited = 1 LEFT JOIN l o2 ON o2.r = e.r AND o2.edited = 0
"""


def repeating_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose h = crc32(doc_id) ends in 0 repeat their words i >= a = g % n with period 1 + floor((n - a) / (3 + g % 8)),
    g = floor(h / 10); other texts, and those of a null id, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def tail(w: Column) -> Column:
        n, g = F.size(w).cast("bigint"), F.floor(h / 10)

        def repeated(a: Column) -> Column:
            return let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int")))))

        return F.array_join(F.when(n > 0, let(g % F.greatest(n, F.lit(1)), repeated)).otherwise(w), " ")

    return docs.select("doc_id", F.when(h % 10 == 0, let(words, tail)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeating_tails(table(spark, sf_dir, "documents")))

    def longer(a: Column, b: Column) -> Column:
        more = a["length"] * b["period"] - b["length"] * a["period"]
        return F.when(more > 0, -1).when(more < 0, 1).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))

    best = F.get(F.array_sort("runs", longer), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("CAST(1000 * best.length DIV best.period AS BIGINT)").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


QUERIES = {"op1_language_id": op1_language_id, "op2_url_filter": op2_url_filter, "op3_warc": op3_warc, "op4_extendible_hashing": op4_extendible_hashing, "op5_license_scan": op5_license_scan, "op6_nearest_neighbours": op6_nearest_neighbours, "op7_ngram_jaccard_join": op7_ngram_jaccard_join, "op8_suffix_array_dedup": op8_suffix_array_dedup, "op9_decontamination": op9_decontamination, "op10_sentencepiece": op10_sentencepiece, "op11_centroid_clustering": op11_centroid_clustering, "op12_document_fingerprints": op12_document_fingerprints, "op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL = {"op2_url_filter": OP2_SQL, "op3_warc": OP3_SQL, "op4_extendible_hashing": OP4_SQL, "op5_license_scan": OP5_SQL, "op6_nearest_neighbours": OP6_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_suffix_array_dedup": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_centroid_clustering": OP11_SQL, "op12_document_fingerprints": OP12_SQL}
