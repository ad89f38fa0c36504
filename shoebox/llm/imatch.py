"""I-Match fingerprints: digests of the terms that a text has in several random parts of a lexicon.

The lexicon is a band of inverse document frequency: terms that too many documents share say little, and those of one document or a few
are noise. A text keeps its distinct lexicon terms. A random part of the lexicon holds each term with chance 2^-c, decided by bits of the
term's digest; the fingerprint hashes, for each of 16 such parts, the sorted terms of the text that lie in it. The level c follows
the number of terms, so that a part holds one of them or none and an edit leaves many parts as they were; the next two levels are there
too, so that texts with different numbers of terms still meet. Everything is built from Spark's functions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.common import let, materialize

#: Terms of the lexicon: log2(documents / documents with the term) lies between these.
LEAST_IDF, MOST_IDF = 5.0, 13.0
#: Random parts of the lexicon, levels, hexadecimal digits kept of a part's digest, and the sparsest first level.
PARTS, LEVELS, DIGITS, DEEPEST = 16, 3, 6, 14
#: Bits of the lexicon's filter for each term; the filter's smallest and largest size, as powers of two.
BITS_A_TERM, LEAST_TABLE, MOST_TABLE = 32, 16, 26
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that no term has.
_BETWEEN = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
_BLANK = "." * DIGITS


def digests(text: Column) -> Column:
    """MD5 (hexadecimal) of the distinct terms of a text: runs of ASCII letters and digits and of all other non-ASCII characters."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN)), " ")
    return F.transform(F.array_remove(F.array_distinct(words), ""), F.md5)


def term_key(digest: Column) -> Column:
    """The first 60 bits of a digest as a long."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


class Lexicon(NamedTuple):
    """A Bloom filter of 2^``log`` bits with two probes."""

    log: int
    bits: bytes

    def holds(self, digest: Column) -> Column:
        """Whether the term with this digest is in the lexicon."""
        return let(term_key(digest), lambda key: reduce(and_, (self._bit(slot) for slot in _slots(key, self.log))))

    def _bit(self, slot: Column) -> Column:
        byte = F.hex(F.substring(F.lit(self.bits), F.shiftright(slot, 3).cast("int") + 1, F.lit(1)))
        return F.getbit(F.conv(byte, 16, 10).cast("bigint"), slot.bitwiseAND(7).cast("int")) == 1


def _slots(key: Column, log: int) -> list[Column]:
    return [F.shiftright(key, 60 - log), key.bitwiseAND((1 << log) - 1)]


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST_IDF, most: float = MOST_IDF) -> Lexicon:
    """The terms in the band, as a filter that each task holds.

    Frequencies are counted over all texts, by 60 bits of the terms' digests. A band up to ``most`` holds at most 2^most times the distinct
    terms of an average text, whatever the number of texts; the filter has ``BITS_A_TERM`` bits for each of them, at most
    2^``MOST_TABLE`` (8 MB). The few terms outside of the band whose bits are set (0.4 %) count as lexicon terms in every text.
    """
    total = docs.count()
    terms = docs.select(F.explode(digests(F.col(text_col))).alias("digest")).groupBy(term_key(F.col("digest")).alias("key")).agg(F.count("*").alias("df"))
    inside = (F.col("df") * 2.0**least <= total) & (F.col("df") * 2.0**most >= total)
    kept = materialize(terms.where(inside).select("key"), "lexicon")
    log = min(max((max(kept.count(), 1) * BITS_A_TERM - 1).bit_length(), LEAST_TABLE), MOST_TABLE)
    slots = kept.select(F.explode(F.array(*(slot + 1 for slot in _slots(F.col("key"), log)))).alias("slot"))
    pages = slots.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = bytearray(max(1 << (log - 3), 4096))
    for page, part in pages.collect():
        bits[(page - 1) * len(part) : page * len(part)] = part
    return Lexicon(log, bytes(bits))


def fingerprint(text: Column, held: Lexicon) -> Column:
    """The fingerprint of a text: the first level, then for each part its digests at that level and the next two, a dot for each digit of
    a part without terms.

    A text without lexicon terms is known by all of its terms, and one without terms by its whole (a null one as an empty one).
    """

    def digest(chosen: Column) -> Column:
        return F.when(F.size(chosen) == 0, F.lit(_BLANK)).otherwise(F.substring(F.md5(F.array_join(F.transform(chosen, lambda x: F.substring(x, 1, 32)), "")), 1, DIGITS))

    def part(terms: Column, j: Column, bounds: list[Column]) -> Column:
        """Digests of part ``j``, each level's terms chosen among those of the level before."""

        def inside(x: Column) -> Column:
            return F.substring(x, 2 * j + 1, F.lit(4)) < bounds[0]

        rest = bounds[1:]
        return let(F.filter(terms, inside), lambda some: F.concat(digest(some), part(some, j, rest)) if rest else digest(some))

    def of_level(terms: Column, level: Column) -> Column:
        bounds = F.array(*(F.lpad(F.lower(F.hex(F.pow(F.lit(2.0), 16 - k - level).cast("bigint"))), 4, "0") for k in range(LEVELS)))
        # Four bits of a level are a zero in the digest's hexadecimal digits, so most terms can be in no part; the first byte follows the last.
        zeros = F.repeat(F.lit("0"), F.floor(level / 4).cast("int"))
        near = F.filter(F.transform(terms, lambda x: F.concat(x, F.substring(x, 1, 2))), lambda x: F.contains(x, zeros))
        chosen = F.struct(near.alias("terms"), bounds.alias("bounds"))
        found = let(chosen, lambda c: F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda j: part(c["terms"], j, [c["bounds"][k] for k in range(LEVELS)])))
        return F.concat(F.lpad(level.cast("string"), 2, "0"), F.lit(":"), F.array_join(found, ""))

    def of_terms(terms: Column) -> Column:
        level = F.least(F.floor(F.log2(F.greatest(F.size(terms), F.lit(1)).cast("double"))) + 1, F.lit(DEEPEST)).cast("int")
        return let(level, lambda c: of_level(terms, c))

    def of_digests(all_terms: Column) -> Column:
        own = F.array_sort(F.filter(all_terms, held.holds))
        return let(own, lambda some: of_terms(F.when(F.size(some) > 0, some).otherwise(F.array_sort(all_terms))))

    return let(digests(text), lambda t: F.when(F.size(t) > 0, of_digests(t)).otherwise(F.concat(F.lit("--:"), F.md5(F.coalesce(text, F.lit(""))))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the parts in which either text has terms, at the levels that both fingerprints have, the share with equal digests."""

    def level(x: Column) -> Column:
        return F.substring(x, 1, 2).try_cast("int")

    def shared(gap: int) -> Column:
        """1 for each pair of equal digests and 0 for each unequal one, when the levels of ``b`` begin ``gap`` above those of ``a``."""
        pairs = [(k + max(gap, 0), k + max(-gap, 0)) for k in range(LEVELS - abs(gap))]

        def pair(j: Column, x: int, y: int) -> Column:
            of_a, of_b = (F.substring(text, 4 + (LEVELS * j + k) * DIGITS, F.lit(DIGITS)) for text, k in ((a, x), (b, y)))
            return F.when(of_a != of_b, 0).when(of_a == _BLANK, F.lit(None)).otherwise(1)

        found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda j: F.array(*(pair(j, x, y) for x, y in pairs))))
        return F.filter(found, lambda x: x.isNotNull())

    gap = level(b) - level(a)
    votes = F.when(gap == 0, shared(0))
    for g in range(1, LEVELS):
        votes = votes.when(gap == g, shared(g)).when(gap == -g, shared(-g))
    share = F.aggregate(votes, F.lit(0.0), lambda n, x: n + x) / F.greatest(F.size(votes), F.lit(1))
    return F.when(a == b, 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band) -> DataFrame:
    """(``id_col``, n_chars, fingerprint) of every row. Equal texts have equal fingerprints; null texts count as empty. Repeated rows and
    null ids are kept, an empty table gives an empty one, and other columns are not carried."""
    held = lexicon(docs, text_col, **band)
    return docs.select(F.col(id_col), F.length(F.coalesce(text_col, F.lit(""))).cast("bigint").alias("n_chars"), fingerprint(F.col(text_col), held).alias("fingerprint"))


def _linked(rows: DataFrame) -> DataFrame:
    """(id, digest, n_chars, fingerprint, copies, before) of every distinct (id, digest), in their order; ``before`` has the same four
    columns of the row before, and of the last row before the first. Written. Rows are sorted in ranges, and each range needs the last row
    of the ones before it only."""
    names = ["id", "digest", "n_chars", "fingerprint"]
    distinct = rows.groupBy(*names).agg(F.count("*").alias("copies"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(distinct.repartitionByRange(ranges, "id", "digest").withColumn("range", F.spark_partition_id()), "ranges")
    own = F.struct(*names)
    ends = placed.groupBy("range").agg(F.max(own).alias("end"))  # a row for each range
    last = ends.groupBy().agg(F.max("end").alias("end")).scalar()
    earlier = ends.select("range", F.lag("end").over(Window.orderBy("range")).alias("end"))
    inside = Window.partitionBy("range").orderBy("id", "digest")
    linked = placed.withColumn("before", F.lag(own).over(inside)).join(F.broadcast(earlier), "range")
    return materialize(linked.select(*names, "copies", F.coalesce("before", "end", last).alias("before")), "linked")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band) -> DataFrame:
    """(``id_col``, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row: how a fingerprint bears an edit.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document, in the order
    of ids; after the last comes the first. Likenesses are those of a text's fingerprint to the edited text's and to the next document's.

    Null texts count as empty. Null ids come first. Rows with equal ids follow in the order of their texts' MD5, and those with equal
    texts too are one document, whose row is given as often. One document alone is its own next. An empty table gives an empty one.

    Texts are shuffled once: they meet, by id and digest, first the row before, for which they give the beginning it needs, and then the
    beginning that the row after them gave.
    """
    held = lexicon(docs, text_col, **band)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    known = rows.select("id", "digest", F.length("text").cast("bigint").alias("n_chars"), fingerprint(F.col("text"), held).alias("fingerprint"))
    linked = _linked(materialize(known, "fingerprints"))

    met = rows.join(linked.drop("n_chars"), rows["id"].eqNullSafe(linked["id"]) & (rows["digest"] == linked["digest"]))
    head = F.substring("text", F.lit(1), F.floor(F.col("before.n_chars") / 4).cast("int"))
    heads = met.select(F.col("before.id").alias("at_id"), F.col("before.digest").alias("at_digest"), head.alias("head"), F.col("before.fingerprint").alias("fingerprint"), F.col("fingerprint").alias("next_fingerprint"))
    if not linked.where("copies > 1").isEmpty():
        heads = heads.dropDuplicates(["at_id", "at_digest"])
    joined = rows.join(heads, rows["id"].eqNullSafe(heads["at_id"]) & (rows["digest"] == heads["at_digest"]))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head"))
    told = joined.select("id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    told = told.withColumn("edited_fingerprint", fingerprint(F.col("edited"), held))
    return told.select(
        F.col("id").alias(id_col), "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
