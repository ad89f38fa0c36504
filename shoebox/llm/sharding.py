"""Extendible hashing of rows into shards of bounded size, with DataFrame functions only.

A row's address is a string of hash bits. A directory starts with one bucket; only a bucket above the byte limit is split,
on one more bit, until all fit. Bytes are summed by address once, all depths are summed from these sums, and a row finds
its bucket by an equi-join of its address prefix with the directory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.common import join_back, materialize

#: Bits of one address word; a bucket that needs more is split on the next words.
WORD_BITS = 32
#: Bits by which the first directory may exceed what even hashing needs, and bits of each further one.
SPARE_BITS, MORE_BITS = 4, 16


def address_word(key: Column, word: int) -> Column:
    """32 bits of an MD5 digest, as a string: of the key for word 0, of the key and the word's number after."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.lpad(F.conv(F.substring(F.md5(text if word == 0 else F.concat(text, F.lit(f"#{word}"))), 1, 8), 16, 2), WORD_BITS, "0")


def first_depth(total: int, limit: int, width: int) -> int:
    return min(width, max(1, -(-total // limit)).bit_length() + SPARE_BITS)


def buckets(rows: DataFrame, limit: int, low: int, depth: int) -> DataFrame:
    """(prefix, over): the buckets in use of rows (bits, bytes), by the shortest prefixes of ``low`` to ``depth`` bits that fit.

    A bucket fits if it has at most ``limit`` bytes, or one row. ``over`` marks those that do not even with ``depth`` bits. No
    prefix of fewer than ``low`` bits fits.
    """
    fine = materialize(rows.groupBy(F.substring("bits", 1, depth).alias("address")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "sums")
    levels = fine.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(depth))))
    levels = levels.groupBy("d", F.substring("address", F.lit(1), F.col("d")).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    pair = Window.partitionBy("d", F.substring("prefix", F.lit(1), F.col("d") - 1))  # a bucket and its sibling
    fits = lambda size, n: (size <= limit) | (n == 1)
    judged = levels.select("prefix", "d", fits(F.col("bytes"), F.col("n")).alias("fits"), fits(F.sum("bytes").over(pair), F.sum("n").over(pair)).alias("both_fit"))
    whole = F.col("fits") & ((F.col("d") == low) | ~F.col("both_fit"))
    over = ~F.col("fits") & (F.col("d") == depth)
    return materialize(judged.where(whole | over).select("prefix", over.alias("over")), "buckets")


def split_by_bits(rows: DataFrame, limit: int, width: int) -> DataFrame:
    """(prefix, over): all buckets in use of rows (bits, bytes); each round only reads the rows of buckets that were too large."""
    low, depth, found = 0, first_depth(rows.agg(F.sum("bytes")).first()[0] or 0, limit, width), []
    while True:
        made = buckets(rows, limit, low, depth)
        found.append(made.where(~F.col("over") | F.lit(depth == width)))
        if depth == width or made.where("over").isEmpty():
            return reduce(DataFrame.union, found)
        rows = materialize(rows.join(made.where("over"), F.substring("bits", 1, depth) == F.col("prefix"), "left_semi"), "pending")
        low, depth = depth + 1, min(width, depth + MORE_BITS)


def _directory(made: DataFrame, depth: int) -> DataFrame:
    """(address, prefix, over): the bucket of every address of ``depth`` bits below it."""
    wide = made.withColumn("free", F.lit(depth) - F.length("prefix")).withColumn("i", F.expr("explode(sequence(0L, shiftleft(1L, free) - 1))"))
    return wide.select(F.concat("prefix", F.expr("lpad(bin(i), free, '0')")).alias("address"), "prefix", "over")


def assign_shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 20) -> DataFrame:
    """(``key_col``, shard, depth, n_bytes), one row for each row of ``docs``.

    ``n_bytes`` is the UTF-8 length of the text (null: 0) and ``shard`` the bits of the row's bucket, the empty string if
    everything fits in one; ``depth`` is their number. The bytes of a shard are at most ``limit``, unless a single row is
    larger: a bucket of one row is not split. Addresses are bits of MD5 digests of the key (null: as the empty text). Rows with equal
    keys share all bits of the key, so a bucket that is still too large is split further on bits of the key and the text together,
    and identical rows are dealt into numbered shards (``…/1``, ``…/2``) that hold as many copies as fit. Other columns are not
    carried; an empty table gives an empty result.

    The directory has about ``2 ** SPARE_BITS`` addresses for each shard. Each further round only reads the rows of buckets
    that were too large, of whose texts it keeps a digest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(key_col).alias("key"), text.alias("text"), F.octet_length(text).cast("bigint").alias("bytes"))
    pending = source.select("key", "text", "bytes", address_word(F.col("key"), 0).alias("bits"))
    done: list[DataFrame] = []
    low, width = 0, WORD_BITS
    depth = first_depth(source.agg(F.sum("bytes")).first()[0] or 0, limit, width)
    while True:
        made = buckets(pending.select("bits", "bytes"), limit, low, depth)
        addressed = pending.withColumn("address", F.substring("bits", 1, depth))
        counts = addressed.groupBy("address").agg(F.count("*").alias("n"))
        placed = join_back(addressed, materialize(_directory(made, depth), "directory"), "address", counts=counts)
        done.append(placed.where("NOT over").select("key", F.col("prefix").alias("shard"), "bytes"))
        if made.where("over").isEmpty():
            break
        if depth == 3 * WORD_BITS:
            done.append(_deal_copies(placed.where("over"), limit))
            break
        digest = F.sha2("text", 256) if "text" in pending.columns else F.col("digest")
        left = placed.where("over").select("key", digest.alias("digest"), "bytes", "bits")
        if depth == WORD_BITS:
            both = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("\x00"), F.col("digest"))
            left, width = left.withColumn("bits", F.concat("bits", address_word(both, 1), address_word(both, 2))), 3 * WORD_BITS
        pending = materialize(left, "pending")
        low, depth = depth + 1, min(width, depth + MORE_BITS)
    out = reduce(DataFrame.union, done)
    bits = F.length(F.substring_index("shard", "/", 1))
    return out.select(F.col("key").alias(key_col), "shard", bits.alias("depth"), F.col("bytes").alias("n_bytes"))


def _deal_copies(rows: DataFrame, limit: int) -> DataFrame:
    """Identical rows, counted and written out again shard by shard, so that no task holds all of them."""
    counted = rows.groupBy("prefix", "key", "digest", "bytes").agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("bytes")))).cast("bigint")
    shards = counted.withColumn("each", each).withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("each")) - 1)))
    own = F.least(F.col("each"), F.col("n") - F.col("at") * F.col("each"))
    copies = shards.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), own)))
    return copies.select("key", F.concat("prefix", F.lit("/"), F.substring("digest", 1, 8), F.lit("/"), (F.col("at") + 1).cast("string")).alias("shard"), "bytes")
