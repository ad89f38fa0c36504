"""Training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next one's ``docs``. All but the last return the columns of ``docs``, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import decontam, language_id, ngram_join, sentencepiece_codec, suffix_dedup
from shoebox.llm.common import join_back, materialize, ordered_ids, table
from shoebox.llm.queries import learned_languages, piece_model
from shoebox.session import ship

#: A document is rejected if more than this share of its words is noise to every language.
MOST_NOISE = 0.5


def _rows(found: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` out of the carried struct ``row``, some replaced."""
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, longer if ``docs`` has such a column."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no language spells; ``lang`` becomes the language found.

    A null or empty text has no letters. Repeated rows and null ids are judged each; an empty table gives an empty one, and so does a
    table without any label, of which no language can be learned.
    """
    ship(spark)
    found = language_id.identify(docs, learned_languages(docs), carry=True)
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("noise") <= MOST_NOISE))
    return _rows(kept, docs, lang=F.col("lang_pred"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of rows linked by similar sets of five-word shingles, the one with the smallest id (null ids first).

    Only texts link rows: rows that share an id are rows of their own, in the order of their texts' digests. Of rows with equal ids and
    texts one stays. Texts without words link with nothing and stay; an empty table gives an empty one.
    """
    ship(spark)
    own = docs.where("doc_id IS NULL").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if own and docs.schema["doc_id"].dataType.simpleString() in ("int", "bigint"):
        groups = ngram_join.join_components(docs, shingle=5, percent=80, carry=True)
        return _rows(groups.where("doc_id = component_id"), docs)
    digest, row_id = _fresh(docs, "digest"), _fresh(docs, "row_id")
    keyed = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    numbers = ordered_ids(keyed, ["doc_id", digest]).select(F.col("doc_id").alias("n_doc"), F.col(digest).alias("n_digest"), F.col("row_id").alias("n_row"))
    numbered = keyed.join(numbers, keyed["doc_id"].eqNullSafe(numbers["n_doc"]) & (keyed[digest] == numbers["n_digest"]))
    numbered = materialize(numbered.select(*(docs[f"`{c}`"] for c in docs.columns), F.col("n_row").alias(row_id)), "rows")
    groups = ngram_join.join_components(numbered, id_col=row_id, shingle=5, percent=80, carry=True)
    kept = groups.where(F.col(row_id) == F.col("component_id"))
    one = kept.where("n_shingles > 0").groupBy(row_id).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return _rows(one.select("row").union(kept.where("n_shingles = 0").select("row")), docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every 100-byte string that starts earlier too, with the characters that a cut divides.

    Documents of which only white space is left are dropped; ``n_chars`` follows the text. Rows with equal ids and texts are one
    document, and all stay; null texts and null ids are left as they are; an empty table gives an empty one.
    """
    ship(spark)
    cut = suffix_dedup.remove_repeats(docs, carry=True)
    changed = F.size("spans") > 0
    left = cut.where(~changed | F.col("kept_text").rlike(r"(?U)\S"))
    return _rows(left, docs, text=F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")), n_chars=F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars")))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a ten-word window of a benchmark item occurs.

    Texts are judged by their digests, so ids may be null or repeated; of equal texts all go or all stay. Null and empty texts stay; an
    empty table gives an empty one, and an empty benchmark drops nothing.
    """
    ship(spark)
    key = _fresh(docs, "text_digest")
    keyed = docs.withColumn(key, F.when(F.length("text") > 0, F.sha2("text", 256)))
    found = decontam.contamination(keyed.select(F.col(key).alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    hit, n = _fresh(docs, "is_hit"), _fresh(docs, "n")
    bad = materialize(found.where("contaminated").select(F.col("key").alias(key)).distinct().withColumn(hit, F.lit(True)), "bad")
    counts = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    return join_back(keyed, bad, key, n, counts=counts).where(F.col(hit).isNull()).select(*(f"`{c}`" for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the SentencePiece ids of every text, one row for each document.

    A null or empty text has no ids and decodes to the empty string; repeated rows and null ids are kept.
    """
    ship(spark)
    coded = sentencepiece_codec.encode_texts(docs, piece_model())
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_passage_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: Language ID is learned and iterative and the last stage needs a tokenizer, so SQL can't give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
