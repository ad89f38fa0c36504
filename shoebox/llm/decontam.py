"""Benchmark decontamination: a prefix-filtered set join on word shingles with exact, item-sized windows.

Every window of a benchmark item is a run of shingles. One pass over the documents hashes all shingles and keeps, for each
text, the runs of consecutive positions whose shingle occurs anywhere in the benchmark. From these rows Spark counts how
often each shingle occurs in the corpus, orders the shingles of a window by rarity, joins only the rarest one (all that is
necessary for full containment) with the runs, bounds the window's start and length from the position met, and compares
the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.common import join_back, materialize
from shoebox.llm.textkit import ALNUM, Words, chunks, flat

#: Words of a window and of the shingles it is made of.
WINDOW, SHINGLE = 10, 5
#: Largest Bloom filter that is sent to the tasks; with more benchmark shingles it only lets more rows through.
FILTER_BITS = 1 << 25


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, n_words, size, tokens array<long>) of every window: ``window`` consecutive words, or the whole item if it
    has fewer; ``size`` is the shingle size, at most the words of the item."""
    source = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("at", pa.int64()), ("n_words", pa.int32()), ("size", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, offsets = flat(whole.column(1))
            for lo, hi, part, local in chunks(raw, offsets):
                words = Words(part, local, ALNUM)
                counts = np.diff(words.first)
                rows: list[tuple] = []
                for size in range(1, shingle + 1):
                    at, hashes = words.ngrams(size)
                    of = words.row[at]
                    edges = np.searchsorted(of, np.arange(hi - lo + 1))
                    chosen = np.flatnonzero(counts == size) if size < shingle else np.flatnonzero(counts >= size)
                    for row in chosen:
                        tokens = hashes[edges[row] : edges[row + 1]].view(np.int64)
                        n = min(int(counts[row]), window)
                        rows += [(lo + row, n, size, tokens[i : i + n - size + 1]) for i in range(int(counts[row]) - n + 1)]
                if rows:
                    at, n_words, sizes, tokens = zip(*rows, strict=True)
                    ids = whole.column(0).take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int32()), pa.array(sizes, pa.int32()), pa.array([t.tolist() for t in tokens], pa.list_(pa.int64()))], ["item_id", *schema.names[1:]])

    kind = source.schema["item_id"].dataType.simpleString()
    return source.mapInArrow(run, f"item_id {kind}, n_words int, size int, tokens array<bigint>")


def _filter_bits(windows: DataFrame) -> tuple[int, np.ndarray, list[int]]:
    """(log2 of bits, bitmap, shingle sizes) of the benchmark's shingles; built by Spark, of bounded size."""
    tokens = windows.select("size", F.explode("tokens").alias("token")).distinct()
    sizes = [r[0] for r in tokens.select("size").distinct().collect()]
    n = tokens.count()
    log = int(np.clip(np.ceil(np.log2(max(n, 1) * 32)), 15, np.log2(FILTER_BITS)))
    at = F.shiftrightunsigned("token", 64 - log)
    bits = np.zeros((1 << log) // 8, np.uint8)
    pages = tokens.select(at.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    for page, blob in pages.collect():
        begin = (page - 1) * 4096
        part = np.frombuffer(bytes(blob), np.uint8)[: len(bits) - begin]
        bits[begin : begin + len(part)] |= part
    return log, bits, sorted(sizes)


def shingle_runs(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, text_key, runs): of every document, the runs of consecutive shingles that may be in the benchmark."""
    log, bits, sizes = _filter_bits(windows)
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    run_type = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int32()), ("tokens", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.unpackbits(sent.value, bitorder="little").view(bool)
        for whole in batches:
            raw, offsets = flat(whole.column(1))
            for lo, hi, part, local in chunks(raw, offsets):
                words = Words(part, local, ALNUM)
                found: list[list] = [[] for _ in range(hi - lo)]
                for size in sizes:
                    at, hashes = words.ngrams(size)
                    keep = np.flatnonzero(member[hashes >> np.uint64(64 - log)])
                    if not len(keep):
                        continue
                    at, hashes = at[keep], hashes[keep].view(np.int64)
                    row = words.row[at]
                    edges = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0), [True]]))
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        r = row[a]
                        found[r].append({"size": size, "start": int(at[a] - words.first[r]), "tokens": hashes[a:b]})
                view = memoryview(part)
                keys = [xxhash.xxh3_128_digest(view[local[i] : local[i + 1]]) if found[i] else None for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(lo, hi - lo), pa.array(np.diff(words.first)), pa.array(keys, pa.binary()), pa.array([f or None for f in found], run_type)], ["id", "n_words", "text_key", "runs"]
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_words bigint, text_key binary, runs array<struct<size:int,start:int,tokens:array<bigint>>>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(``id_col``, n_words, n_hit, item_ids array<string>, contaminated), one row for each row of ``docs``.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased. A word is hit if it
    lies inside any occurrence of an item's window. ``item_ids`` are the distinct items with an occurring window, as
    sorted strings; an item without an id can hit words but is not listed. Null and empty texts have no words; items
    without words have no window; repeated rows count each; copies of a text are joined once; an empty table on either
    side gives no hits. Other columns are not carried.
    """
    windows = materialize(item_windows(items, item_col, "text", window, shingle), "windows")
    runs = materialize(shingle_runs(docs, windows, id_col, text_col), "runs")
    texts = runs.where("text_key IS NOT NULL").groupBy("text_key").agg(F.first("runs").alias("runs"), F.count("*").alias("copies"))
    met = texts.select("text_key", "copies", F.explode("runs").alias("run")).select("text_key", "copies", "run.*")

    # Rarity of every shingle over all documents, then the rarest shingle of each window.
    rarity = met.select("copies", "size", F.explode("tokens").alias("token")).groupBy("size", "token").agg(F.sum("copies").alias("df"))
    places = windows.select("size", "n_words", "tokens").distinct().select("*", F.posexplode("tokens").alias("place", "token")).join(rarity, ["size", "token"])
    prefix = places.groupBy("size", "n_words", "tokens").agg(F.min_by(F.struct("token", "place"), F.struct("df", "place")).alias("rare"), F.count("*").alias("present"))
    prefix = prefix.where(F.col("present") == F.size("tokens")).select("size", F.col("n_words").alias("w_words"), F.col("tokens").alias("w_tokens"), "rare.*")

    # Each position takes along only the shingles that a window around it can have, so a long run stays linear.
    reach = window - shingle
    low = lambda pos: F.greatest(pos - reach, F.lit(0))
    around = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("pos"), F.slice("tokens", low(i) + 1, 2 * reach + 1).alias("near")))
    at = met.select("text_key", "size", "start", F.inline(around))
    near = at.join(prefix, ["size", "token"]).withColumn("offset", F.col("pos") - F.col("place"))
    from_low = F.col("offset") - low(F.col("pos"))
    near = near.where((F.col("offset") >= 0) & (from_low + F.size("w_tokens") <= F.size("near")))
    exact = near.where(F.slice("near", from_low + 1, F.size("w_tokens")) == F.col("w_tokens"))
    exact = exact.select("text_key", (F.col("start") + F.col("offset")).alias("a"), (F.col("start") + F.col("offset") + F.col("w_words")).alias("b"), "size", "w_words", "w_tokens")

    # Words covered: each window adds what lies behind the furthest end so far.
    before = F.coalesce(F.max("b").over(Window.partitionBy("text_key").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = exact.groupBy("text_key", "a").agg(F.max("b").alias("b"))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("b") - F.greatest("a", before))).groupBy("text_key").agg(F.sum("new").alias("n_hit"))
    # Items by window: a window that many items share is joined, not carried along as a list.
    own = windows.select("size", F.col("n_words").alias("w_words"), F.col("tokens").alias("w_tokens"), F.col("item_id").cast("string").alias("item")).where("item IS NOT NULL").distinct()
    named = exact.select("text_key", "size", "w_words", "w_tokens").distinct().join(own, ["size", "w_words", "w_tokens"]).groupBy("text_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    hits = covered.join(named, "text_key", "left")
    out = join_back(runs.select("id", "n_words", "text_key"), materialize(hits, "hits"), "text_key", "copies", counts=texts.select("text_key", "copies"))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
