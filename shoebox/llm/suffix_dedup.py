"""Removal of repeated byte strings by distributed prefix doubling on anchored positions.

Two positions have the same rank at length h if their next h bytes are equal. Ranks start at half the threshold (rounded up), and only
at anchors: of every window of ``length`` bytes the position whose half-length rank is smallest, so equal windows have
their anchor at the same place. Spark brings equal ranks together, and

* anchors whose rank is unique go: no window around them repeats;
* the rest is ranked again by the whole context, that is all windows of the anchor. The first of equal contexts stays, all
  windows of the others are repeats;
* first contexts that are alone at their anchor go. For the others, in each anchor group, every window gets the pair of the
  half-length ranks at its start and in its middle, which is its rank at the threshold, and all but the first of equal
  ranks are repeats.

Ranks are hashes of the bytes, equal wherever they stand, so no rank has to be looked up; two equal windows compare 128
bits (rank of the anchor and of the pair).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import bins_for, carried, join_back, materialize, ordered_ids, packed, text_bytes, unpacked, with_row
from shoebox.llm.textkit import chunks, flat, prefix_hash, span_hash, splitmix, window_reduce

LENGTH = 100
_U = np.uint64
_SPANS = "bin int, doc binary, a binary, b binary"
_MARKS = "rank binary, m_doc binary, m_a binary, m_b binary, m_at binary"


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(position, rank, first window, last window, context rank) of the anchors; windows are given by their starts.

    A position is an anchor if it has the smallest rank, ties included, in some window of its text. Windows that share
    their smallest rank in several places belong to each of these anchors.
    """
    half = (length + 1) // 2
    reach = length - half
    n = len(raw)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(_U), none, none, none.astype(_U)
    sums, inverse = prefix_hash(raw)
    with np.errstate(over="ignore"):
        rank = splitmix((sums[half:] - sums[:-half]) * inverse[: n - half + 1]) | _U(1)
    least = window_reduce(rank, reach + 1, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    least[np.arange(length, n + 1) > ends[: n - length + 1]] = 0  # windows that leave their text
    around = np.zeros(reach, _U)
    at = np.flatnonzero(window_reduce(np.concatenate([around, least, around]), reach + 1, np.maximum) == rank)
    # The windows of an anchor are the stretch of windows around it that have its rank as their smallest.
    changes = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts, stops = np.concatenate([[0], changes]), np.concatenate([changes, [len(least)]])
    low, high = np.maximum(at - reach, 0), np.minimum(at, len(least) - 1)
    run = np.searchsorted(starts, low, "right") - 1
    wrong = np.flatnonzero(least[starts[run]] != rank[at])
    while len(wrong):
        run[wrong] += 1
        wrong = wrong[least[starts[run[wrong]]] != rank[at[wrong]]]
    first, last = np.maximum(starts[run], low), np.minimum(stops[run] - 1, high)
    context = splitmix(span_hash(sums, inverse, first, last + length) + (at - first).astype(_U))
    return at, rank[at], first, last, context


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [a, b) of each document, sorted, with overlapping and touching ones joined."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    group = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    wide = int(b.max()) + 1
    furthest = np.maximum.accumulate(b + group * wide) - group * wide
    opens = np.ones(len(doc), bool)
    opens[1:] = (group[1:] != group[:-1]) | (a[1:] > furthest[:-1])
    first = np.flatnonzero(opens)
    return doc[first], a[first], furthest[np.append(first[1:], len(doc)) - 1]


def _first_and_rest(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first (smallest document, then position) and of the other rows of each distinct key."""
    order = np.lexsort((at, doc, *keys))
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order[fresh], order[~fresh]


class _Rows:
    """Packed rows by bin: spans to remove go to the bin of their document, anchors to the bin of their rank."""

    def __init__(self, bins: int, n: int):
        self.bins, self.n, self.rows = bins, n, {}

    def put(self, slot: int, at: np.ndarray, columns: list[np.ndarray]) -> None:
        for b, data in packed(at % self.bins, self.bins, columns):
            self.rows.setdefault(b, [b""] * self.n)[slot : slot + len(data)] = data

    def batch(self, names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*self.rows.values(), strict=True)) or [()] * self.n
        return pa.RecordBatch.from_arrays([pa.array(list(self.rows), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def _read(rows: pa.Table, *columns: tuple[str, type]) -> list[np.ndarray]:
    return [unpacked(rows[name], kind) for name, kind in columns]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, starts, ends): disjoint sorted byte spans of (id, text), ids distinct, that repeats of ``length`` bytes cover."""
    bins = bins_for(docs.sparkSession, 2 * text_bytes(docs), 8)
    reach = length // 2
    anchor_schema = f"{_SPANS}, rank binary, context binary, c_doc binary, c_at binary, c_low binary, c_high binary"
    by_doc_schema = f"{_SPANS}, {_MARKS}"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids = whole.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offsets = flat(whole.column(1))
            found = []
            for lo, _, part, local in chunks(raw, offsets):
                at, rank, first, last, context = anchors(part, local, length)
                row = np.searchsorted(local, at, "right") - 1
                found.append((ids[lo + row], at - local[row], rank, context, at - first, at - last))
            if not found:
                continue
            doc, at, rank, context, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
            keep, rest = _first_and_rest((context, rank), doc, at)
            out = _Rows(bins, 9)
            out.put(3, (rank[keep] % _U(bins)).astype(np.int64), [rank[keep], context[keep], doc[keep], at[keep].astype(np.int32), low[keep].astype(np.uint8 if reach < 256 else np.int32), high[keep].astype(np.uint8 if reach < 256 else np.int32)])
            spans = _merged(doc[rest], at[rest] - low[rest], at[rest] - high[rest] + length)
            out.put(0, spans[0], list(spans))
            yield out.batch(_names(anchor_schema))

    small = np.uint8 if reach < 256 else np.int32

    def meet(rows: pa.Table) -> pa.Table:
        rank, context, doc, at, low, high = _read(rows, ("rank", _U), ("context", _U), ("c_doc", np.int64), ("c_at", np.int32), ("c_low", small), ("c_high", small))
        at, low, high = at.astype(np.int64), low.astype(np.int64), high.astype(np.int64)
        keep, rest = _first_and_rest((context, rank), doc, at)
        spans = [np.concatenate(x) for x in zip((doc[rest], at[rest] - low[rest], at[rest] - high[rest] + length), _read(rows, ("doc", np.int64), ("a", np.int64), ("b", np.int64)), strict=True)]
        spans = _merged(*spans)
        kept = rank[keep]
        shared = np.zeros(len(keep), bool)
        if len(keep) > 1:
            same = kept[1:] == kept[:-1]
            shared[1:] |= same
            shared[:-1] |= same
        k = keep[shared]
        out = _Rows(bins, 8)
        out.put(0, spans[0], list(spans))
        out.put(3, doc[k], [rank[k], doc[k], at[k] - low[k], at[k] - high[k] + length, at[k]])
        return pa.Table.from_batches([out.batch(_names(by_doc_schema))])

    def gather(rows: pa.Table) -> pa.Table:
        doc, a, b = _merged(*_read(rows, ("doc", np.int64), ("a", np.int64), ("b", np.int64)))
        rank, m_doc, m_a, m_b, m_at = _read(rows, ("rank", _U), ("m_doc", np.int64), ("m_a", np.int64), ("m_b", np.int64), ("m_at", np.int64))
        order = np.argsort(m_doc, kind="stable")
        ids = np.unique(np.concatenate([doc, m_doc]))
        own = lambda of, x: _lists(np.append(np.searchsorted(of, ids), len(of)), x)
        m_doc = m_doc[order]
        return pa.table({"id": ids, "starts": own(doc, a), "ends": own(doc, b), "rank": own(m_doc, rank[order].view(np.int64)), "m_a": own(m_doc, m_a[order]), "m_b": own(m_doc, m_b[order]), "m_at": own(m_doc, m_at[order])})

    lists = "starts array<bigint>, ends array<bigint>"
    first = docs.mapInArrow(find, anchor_schema).groupBy("bin").applyInArrow(meet, by_doc_schema)
    marked = materialize(first.groupBy("bin").applyInArrow(gather, f"id bigint, {lists}, rank array<bigint>, m_a array<bigint>, m_b array<bigint>, m_at array<bigint>"), "anchors")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, offsets = flat(whole.column(1))
            ids = whole.column(0).to_numpy().astype(np.int64)
            (rank, sizes), (a, _), (b, _), (at, _) = (_flat_list(whole.column(i)) for i in range(2, 6))
            doc = np.repeat(ids, sizes)
            base = np.repeat(offsets[:-1], sizes)
            out = _Rows(bins, 5)
            bin_of = (rank.view(_U) % _U(bins)).astype(np.int64)
            out.put(0, bin_of, [rank, doc, a, b, at])
            for group, (begin, end) in packed(bin_of, bins, [base + a, base + b]):
                spans = zip(np.frombuffer(begin, np.int64), np.frombuffer(end, np.int64), strict=True)
                out.rows[group].append(b"".join(raw[x:y].tobytes() for x, y in spans))
            out.n = 6
            yield out.batch([*_names(f"bin int, {_MARKS}"), "bytes"])

    def double(rows: pa.Table) -> pa.Table:
        rank, doc, a, b, at = _read(rows, ("rank", _U), ("m_doc", np.int64), ("m_a", np.int64), ("m_b", np.int64), ("m_at", np.int64))
        raw = unpacked(rows["bytes"], np.uint8)
        base = np.cumsum(b - a) - (b - a)
        windows = b - a - length + 1
        of = np.repeat(np.arange(len(a)), windows)
        step = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = base[of] + step
        sums, inverse = prefix_hash(raw)
        half = (length + 1) // 2
        front, back = (span_hash(sums, inverse, s, s + half) for s in (start, start + length - half))
        with np.errstate(over="ignore"):
            pair = splitmix(front * _U(0x9E3779B97F4A7C15) + back) + (at[of] - a[of] - step).astype(_U)
        _, rest = _first_and_rest((pair, rank[of]), doc[of], a[of] + step)
        at_ = a[of[rest]] + step[rest]
        spans = _merged(doc[of[rest]], at_, at_ + length)
        out = _Rows(bins, 8)
        out.put(0, spans[0], list(spans))
        return pa.Table.from_batches([out.batch(_names(by_doc_schema))])

    texts = docs.join(marked.where("size(rank) > 0").select("id", "rank", "m_a", "m_b", "m_at"), "id").select("id", "text", "rank", "m_a", "m_b", "m_at")
    doubled = texts.mapInArrow(contexts, f"bin int, {_MARKS}, bytes binary").groupBy("bin").applyInArrow(double, by_doc_schema)
    more = materialize(doubled.groupBy("bin").applyInArrow(gather, f"id bigint, {lists}, rank array<bigint>, m_a array<bigint>, m_b array<bigint>, m_at array<bigint>").select("id", "starts", "ends"), "windows")
    both = marked.where("size(starts) > 0").select("id", "starts", "ends").union(more)
    return both.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def _lists(edges: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def _flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _known(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` with row_id, distinct (id, text) of them): ids in the order of id, then digest of the text.

    A table of unique integer ids keeps its own; else pairs of id and digest are numbered, and copies of a row have one number.
    """
    whole = docs.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and docs.groupBy("id").count().where("count > 1").isEmpty():
        known = docs.select(F.col("id").cast("bigint").alias("row_id"), "*")
        return known, known.select(F.col("row_id").alias("id"), "text")
    keyed = docs.withColumn("own", F.struct("id", F.sha2("text", 256).alias("digest")))
    counts = keyed.groupBy("own").agg(F.count("*").alias("n"))
    numbers = ordered_ids(keyed.select("own.*"), ["id", "digest"]).select(F.struct("id", "digest").alias("own"), "row_id")
    known = join_back(keyed, numbers, "own", counts=counts).drop("own")
    return known, known.groupBy("row_id").agg(F.first("text").alias("text")).select(F.col("row_id").alias("id"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: bool = False) -> DataFrame:
    """(``id_col``, n_bytes, spans array<struct<a, b>>, kept binary, kept_text), one row for each row of ``docs``.

    Texts are their UTF-8 bytes; a null text is empty. A byte is removed if a ``length``-byte string covers it that also
    starts earlier: in a text of a smaller id, or earlier in the same text; overlaps count, and matches never cross texts.
    ``spans`` are the maximal removed runs [a, b), ``kept`` the other bytes, which may cut a character, and ``kept_text`` the
    whole characters among them. Rows with the same
    id and text are one document; of different texts with the same id, that with the smaller SHA-256 is the earlier one. A
    row with a null id is left whole and is nobody's source. An empty table gives an empty result. With ``carry`` the
    input row follows as the struct ``row``; else other columns are not carried. Ids have any type with an order.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried(docs, carry))
    known, distinct = _known(source.where("id IS NOT NULL"))
    more = ["row"] * carry
    spans = materialize(repeated_spans(distinct, length).withColumnRenamed("id", "row_id"), "spans")
    counts = known.groupBy("row_id").agg(F.count("*").alias("n"))
    rows = join_back(known, spans, "row_id", counts=counts).select("id", "text", "starts", "ends", *more)
    rows = rows.union(source.where("id IS NULL").select("id", "text", F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<bigint>"), *more))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, offsets = flat(whole.column(1))
            starts, ends = whole.column(2).to_pylist(), whole.column(3).to_pylist()
            for lo, hi, part, local in chunks(raw, offsets):
                found, kept = [], []
                for i in range(hi - lo):
                    text = part[local[i] : local[i + 1]]
                    if starts[lo + i]:
                        a, b = (np.array(x, np.int64) for x in (starts[lo + i], ends[lo + i]))
                        _, a, b = _merged(np.zeros(len(a), np.int64), a, b)
                        drop = np.zeros(len(text) + 1, np.int8)
                        drop[a] += 1
                        drop[b] -= 1
                        kept.append(text[np.cumsum(drop[:-1]) == 0].tobytes())
                        found.append([{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)])
                    else:
                        kept.append(text.tobytes())
                        found.append([])
                spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                texts = [k.decode("utf-8", "ignore") for k in kept]
                columns = [whole.column(0).slice(lo, hi - lo), pa.array(np.diff(local)), pa.array(found, spans_type), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *(whole.column(4).slice(lo, hi - lo) for _ in more)], ["id", "n_bytes", "spans", "kept", "kept_text", *more])

    schema = with_row(f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, spans array<struct<a:bigint,b:bigint>>, kept binary, kept_text string", rows)
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
