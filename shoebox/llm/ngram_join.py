"""Jaccard self-join of word shingle sets through parity sketches.

A set's shingles are XOR-hashed into the parts of a sketch. One differing shingle changes one part, so the Hamming
distance of two sketches, counted in parts, is at most the symmetric difference of the sets. For two sets of a size band
that the threshold can link, the difference is bounded by ``d``, so of ``2 d + 1`` parts at least ``d + 1`` agree. By the
pigeonhole principle two sketches that agree in so many share one of the ``d + 1`` parts that come first in any order: sketches
meet by an equi-join on (band, part, value) of the rarest parts, and parts that very many texts share come last. Candidates are tested
on bit sketches (one parity bit for a shingle, XORed), whose Hamming distance is a lower bound of the difference too, and what
passes is verified on the exact sets.

Equal sets are one node from the start. Of up to ``PAIRED`` nodes that share a part all pairs are candidates. More than that
are joined into hot families by one edge for each, and a family's bit sketches, a few bytes for a shingle, are compared block by
block inside tasks, which only report a spanning forest of what passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import bins_for, carried, join_back, materialize, packed, unpacked, with_row
from shoebox.llm.components import components
from shoebox.llm.textkit import NOT_SPACE, Words, chunks, flat, shingle_sets, splitmix

#: Nodes with a part in common of which all pairs are candidates.
PAIRED = 16
#: Bit sketches, and exact sets, of a family that one task compares with each other.
SKETCH_BLOCK, BLOCK = 2048, 512
#: Logarithms of the number of counters of parts, and of the rows that these are added up in. Parts that share a counter only rank
#: less well.
COUNTERS, SEGMENTS = 20, 6
_U = np.uint64


def band_starts(limit: int = 1 << 40) -> np.ndarray:
    """First size of each size band; bands grow by a half."""
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, starts[-1] * 3 // 2))
    return np.array(starts, np.int64)


_STARTS = band_starts()


def most_different(total, percent: int):
    """Largest symmetric difference of two sets of ``total`` elements together that are similar enough."""
    return total * (100 - percent) // (100 + percent)


def band_differences(percent: int) -> np.ndarray:
    """Largest symmetric difference of two similar sets that meet in a band."""
    return most_different(2 * (_STARTS[1:] - 1), percent)


def sketch_parts(hashes: np.ndarray, edges: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, needed) of all sketch parts of every set, for its own band and each higher one that could hold a partner; ``needed``
    of the parts of a row, whichever come first in an order of keys, are enough to meet its partners there."""
    sizes = np.diff(edges)
    differences = band_differences(percent)
    own = np.searchsorted(_STARTS, sizes, "right") - 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    ahead = 0
    while True:
        band = own + ahead
        on = (sizes > 0) & ((ahead == 0) | (100 * sizes >= percent * _STARTS[np.minimum(band, len(_STARTS) - 1)]))
        if not on.any():
            return
        d = differences[np.minimum(band, len(differences) - 1)]
        m = np.where(on, 2 * d + 1, 0)
        base = np.cumsum(m) - m
        chosen = on[of]
        doc, h = of[chosen], hashes[chosen]
        mixed = splitmix(h + _U(0x632BE59BD9B4E019) * (band[doc] + 1).astype(np.uint64))
        slot = base[doc] + (((mixed >> _U(32)) * m[doc].astype(np.uint64)) >> _U(32)).astype(np.int64)
        value = np.zeros(int(m.sum()), np.uint64)
        np.bitwise_xor.at(value, slot, splitmix(mixed))
        row = np.repeat(np.arange(len(sizes)), m)
        place = np.arange(len(value)) - base[row]
        tag = (band[row].astype(np.uint64) << _U(48)) ^ place.astype(np.uint64)
        yield row, splitmix(value + splitmix(tag + _U(1))), d[row] + 1
        ahead += 1


def part_keys(hashes: np.ndarray, edges: np.ndarray, percent: int, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the parts of every set that are rarest by the counters ``counts`` (none: all equal), as many as it needs."""
    for row, key, needed in sketch_parts(hashes, edges, percent):
        often = counts[key >> _U(64 - COUNTERS)] if counts is not None else np.zeros(len(key), np.uint32)
        order = np.lexsort((key, often, row))
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = order[rank < needed]
        yield row[first], key[first]


def _sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(Words(raw, offsets, NOT_SPACE), k, len(offsets) - 1)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two halves of a set's 128-bit digest."""
    high, low = divmod(xxhash.xxh3_128_intdigest(hashes.tobytes()), 1 << 64)
    return low - (1 << 63), high - (1 << 63)


#: Nodes of sets whose first half of the digest is also another set's.
Renamed = dict[tuple[int, int], int]


def _node(hashes: np.ndarray, renamed: Renamed) -> int:
    """Identity of a set: the first half of its digest, or another number if sets with another second half have that too."""
    digest = _digest(hashes)
    return renamed.get(digest, digest[0])


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """One parity bit for each shingle, in at least twice as many bits; 64-bit words. Halves XORed give the sketch of half the size."""
    log = max(6, int(2 * len(hashes) - 1).bit_length())
    bits = np.zeros(1 << (log - 3), np.uint8)
    at = (hashes & _U((1 << log) - 1)).astype(np.int64)
    np.bitwise_xor.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bits.view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def node_table(docs: DataFrame, k: int) -> DataFrame:
    """(id, node, half, n, bits) of every text with words, from (id, text): its set's digest in halves, size and bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, offsets = flat(whole.column(1))
            for lo, _, part, local in chunks(raw, offsets):
                hashes, edges = _sets(part, local, k)
                full = np.flatnonzero(np.diff(edges))
                sets = [hashes[edges[i] : edges[i + 1]] for i in full]
                halves = [_digest(x) for x in sets]
                columns = [pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64()), pa.array(np.diff(edges)[full]), pa.array([bit_sketch(x).tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(full + lo)), *columns], ["id", "node", "half", "n", "bits"])

    return docs.mapInArrow(run, "id bigint, node bigint, half bigint, n bigint, bits binary")


def rename_clashes(nodes: DataFrame) -> tuple[DataFrame, Renamed]:
    """``nodes`` without half, different sets having different nodes, and the new numbers by digest.

    N sets are expected to have N**2 / 2**65 clashes of the first half: 11 for 2 * 10**10 sets. These few reach the driver.
    """
    clashing = nodes.groupBy("node").agg(F.min("half").alias("least"), F.max("half").alias("most")).where("least <> most").select("node", "least")
    if clashing.isEmpty():
        return nodes.drop("half"), {}
    others = nodes.join(clashing, "node").where("half <> least").select("node", "half").distinct()
    renamed = {(r["node"], r["half"]): r["new"] for r in others.withColumn("new", F.xxhash64("node", "half")).collect()}
    node = F.col("node")
    for (first, second), new in renamed.items():
        node = F.when((F.col("node") == first) & (F.col("half") == second), F.lit(new)).otherwise(node)
    return nodes.select("id", node.alias("node"), "n", "bits"), renamed


def part_counts(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """How many sets have a sketch part, added up in ``2 ** COUNTERS`` counters over all documents; copies within a batch count once.

    A task adds up its own counters and sends them in ``2 ** SEGMENTS`` rows; the driver gets one sum of each row, 4 MB in all.
    """
    width = 1 << (COUNTERS - SEGMENTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for whole in batches:
            raw, offsets = flat(whole.column(1))
            for _, _, part, local in chunks(raw, offsets):
                hashes, edges = _sets(part, local, k)
                _, first = np.unique([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)], return_index=True)
                once = np.zeros(len(edges) - 1, bool)
                once[first] = True
                for row, key, _ in sketch_parts(hashes, edges, percent):
                    total += np.bincount((key[once[row]] >> _U(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
        rows = np.minimum(total, 65535).astype(np.uint16).reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([r.tobytes() for r in rows], pa.binary())], ["segment", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for x in rows["counts"]:
            total += np.frombuffer(x.as_buffer(), np.uint16)
        return pa.table({"segment": rows["segment"][:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    sums = docs.mapInArrow(count, "segment bigint, counts binary").groupBy("segment").applyInArrow(add, "segment bigint, counts binary")
    found = np.zeros((1 << SEGMENTS, width), np.uint32)
    for segment, counts in sums.collect():
        found[segment] = np.frombuffer(bytes(counts), np.uint32)
    return found.ravel()


def candidates(docs: DataFrame, k: int, percent: int, renamed: Renamed, bins: int) -> DataFrame:
    """Distinct (u, v, hot) of nodes that share a sketch part, from (id, text).

    hot = false: a candidate pair. hot = true: u and v belong to one hot family. A batch sends a part's nodes once; if it has
    more than ``PAIRED`` of them it joins them itself and sends one, so a part that very many texts share stays small.
    """
    often = docs.sparkSession.sparkContext.broadcast(part_counts(docs, k, percent))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, offsets = flat(whole.column(1))
            found = []
            for _, _, part, local in chunks(raw, offsets):
                hashes, edges = _sets(part, local, k)
                nodes = np.array([_node(hashes[a:b], renamed) if b > a else 0 for a, b in zip(edges[:-1], edges[1:], strict=True)], np.int64)
                found += [(nodes[row], key) for row, key in part_keys(hashes, edges, percent, often.value)]
            if not found:
                continue
            node, key = np.concatenate([d for d, _ in found]), np.concatenate([x for _, x in found])
            key, node, starts, sizes = _groups(key, node)
            wide = np.repeat(sizes > PAIRED, sizes)
            lead = np.zeros(len(key), bool)
            lead[starts] = True
            u, v = node[wide & ~lead], np.repeat(node[starts], sizes)[wide & ~lead]
            sent = ~wide | lead
            columns = [_short(key[sent], bins), node[sent], wide[sent]]
            rows = {b: [*data, b"", b""] for b, data in packed((key[sent] % _U(bins)).astype(np.int64), bins, columns)}
            for b, (us, vs) in packed(u % bins, bins, [u, v]):
                rows[b] = [*rows.get(b, [b"", b"", b""])[:3], us, vs]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows.values(), strict=True))], ["bin", "keys", "nodes", "wide", "us", "vs"])

    def meet(rows: pa.Table) -> pa.Table:
        key = np.zeros((sum(len(x.as_buffer()) for x in rows["keys"]) // 6, 8), np.uint8)
        key[:, :6] = unpacked(rows["keys"], np.uint8).reshape(-1, 6)
        key, node, starts, sizes, wide = _groups(key.view(_U).ravel(), unpacked(rows["nodes"], np.int64), unpacked(rows["wide"], bool))
        hot = (np.add.reduceat(wide, starts) > 0) | (sizes > PAIRED) if len(starts) else np.zeros(0, bool)
        first = np.repeat(node[starts], sizes)
        far = np.repeat(hot, sizes) & (node != first)
        edges = {True: [np.stack([node[far], first[far]]), np.stack([unpacked(rows["us"], np.int64), unpacked(rows["vs"], np.int64)])], False: []}
        for size in np.unique(sizes[~hot & (sizes > 1)]):
            block = node[starts[~hot & (sizes == size)][:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            edges[False].append(np.stack([block[:, j].ravel(), block[:, i].ravel()]))
        out = []
        for kind, parts in edges.items():
            pairs = np.unique(np.concatenate([*parts, np.zeros((2, 0), np.int64)], axis=1), axis=1)
            out.append(pa.table({"u": pairs[0], "v": pairs[1], "hot": np.full(pairs.shape[1], kind)}))
        return pa.concat_tables(out)

    rows = docs.mapInArrow(sketch, "bin int, keys binary, nodes binary, wide binary, us binary, vs binary")
    return rows.groupBy("bin").applyInArrow(meet, "u bigint, v bigint, hot boolean").distinct()


def _short(key: np.ndarray, bins: int) -> np.ndarray:
    """Six bytes of each key beyond those that choose its bin; keys that agree in them only make a candidate more."""
    return np.ascontiguousarray((key // _U(bins)).view(np.uint8).reshape(-1, 8)[:, :6])


def _groups(key: np.ndarray, node: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, node, starts, sizes, …): distinct rows sorted by key and node; flags of equal rows are joined."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    at = np.flatnonzero(fresh)
    more = tuple(np.logical_or.reduceat(m[order], at) if len(at) else m for m in more)
    key, node = key[at], node[at]
    opens = np.ones(len(key), bool)
    opens[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(opens)
    return key, node, starts, np.diff(np.append(starts, len(key))), *more


def _in_blocks(rows: DataFrame, sizes: DataFrame, block: int, bins: int) -> DataFrame:
    """Rows (family, node, …) dealt to tasks so that every two of a family meet: columns small, group, b1, b2 name the task and own
    the row's block. Families of at most ``block`` rows share tasks."""
    large = sizes.select("family", F.ceil(F.col("n_nodes") / block).cast("int").alias("blocks")).where("blocks > 1")
    spread = rows.join(large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.col("family"))
    return spread.select(*rows.columns, "own", (F.col("blocks") == 1).alias("small"), group.alias("group"), F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))


_TASK = ("small", "group", "b1", "b2")


def close_pairs(found: DataFrame, sketches: DataFrame, percent: int, bins: int) -> DataFrame:
    """(u, v) of nodes whose bit sketches (node, n, bits) do not rule out a link; of a hot family only a spanning forest."""
    sides = [sketches.toDF(*(f"{s}_{c}" for c in ("node", "n", "bits"))) for s in "uv"]
    pairs = found.where("NOT hot").join(sides[0], F.col("u") == F.col("u_node")).join(sides[1], F.col("v") == F.col("v_node"))
    pairs = pairs.where(100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n")).select("u", "v", "u_n", "v_n", "u_bits", "v_bits")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            u, v, n, m = (whole.column(i).to_numpy() for i in range(4))
            keep = np.zeros(len(u), bool)
            for i, (a, b) in enumerate(zip(whole.column(4), whole.column(5), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
                words = min(len(a), len(b))
                keep[i] = np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum() <= most_different(n[i] + m[i], percent)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    def compare(rows: pa.Table) -> pa.Table:
        return _edge_table(_across(rows, lambda group, sides_: _forest(group, sides_, percent)))

    hot = components(found.where("hot").select("u", "v")).select("node", F.col("component").alias("family"))
    members = hot.join(sketches, "node").withColumn("size", F.explode(_size_classes(F.col("n"), percent)))
    members = members.select(F.xxhash64("family", "size").alias("family"), "node", "n", "bits")
    dealt = _in_blocks(members, members.groupBy("family").agg(F.count("*").alias("n_nodes")), SKETCH_BLOCK, bins)
    return pairs.mapInArrow(test, "u bigint, v bigint").union(dealt.groupBy(*_TASK).applyInArrow(compare, "u bigint, v bigint"))


def _size_classes(n, percent: int):
    """Both places of a set among its family's sizes: a class is a little wider than the ratio that two similar sets can have, so
    they are in one class or in neighbours, and a place holds a class and the next. A family's sets that differ more in size
    never meet."""
    own = F.floor(F.log(n.cast("double")) / float(np.log(100 / percent * 1.001)))
    return F.array(own, own - 1)


def _edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})


def _across(rows: pa.Table, link) -> list[tuple[int, int]]:
    """Edges that ``link`` finds in each family of a task's rows; with two blocks it gets the block of each row."""
    family, own = rows["family"].to_numpy(), rows["own"].to_numpy()
    across = rows.num_rows > 0 and rows["b1"][0].as_py() != rows["b2"][0].as_py()
    order = np.argsort(family, kind="stable")
    edges: list[tuple[int, int]] = []
    for at in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
        if len(at) > 1:
            edges += link(rows.take(pa.array(at)), own[at] if across else None)
    return edges


def _forest(rows: pa.Table, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a family whose bit sketches are close enough."""
    sizes = rows["n"].to_numpy()
    order = np.argsort(sizes, kind="stable")
    nodes, sizes = rows["node"].to_numpy()[order], sizes[order]
    side = side[order] if side is not None else None
    raw = [np.frombuffer(x.as_buffer(), _U) for x in rows["bits"].take(pa.array(order))]
    lens = np.array([len(x) for x in raw])  # grows with the size, so the sketches that a width is compared with stand together
    reach = 1 << int(np.ceil(np.log2(100 / percent)))
    stacked = {int(w): (at := np.flatnonzero((lens >= w) & (lens <= reach * w)), np.stack([_folded(raw[i], int(w)) for i in at])) for w in np.unique(lens)}
    root, edges = np.arange(len(nodes)), []
    for i in range(len(nodes) - 1):
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        near = np.arange(i + 1, end)
        near = near[root[near] != root[i]]
        if side is not None:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        at, bits = stacked[int(lens[i])]
        apart = np.bitwise_count(bits[near - at[0]] ^ bits[i - at[0]]).sum(axis=1, dtype=np.int64)
        for j in near[apart <= most_different(sizes[near] + sizes[i], percent)]:
            if root[i] != root[j]:
                edges.append((int(max(nodes[i], nodes[j])), int(min(nodes[i], nodes[j]))))
                root[root == root[j]] = root[i]
    return edges


def similar_pairs(docs: DataFrame, nodes: DataFrame, families: DataFrame, k: int, percent: int, renamed: Renamed, bins: int) -> DataFrame:
    """(u, v): verified links that connect, within every family (node, component), all nodes that are linked through similar sets."""
    shown = nodes.groupBy("node").agg(F.min("id").alias("id")).join(families.withColumnRenamed("component", "family"), "node")
    # Texts are shuffled at every size: a broadcast of the families would stop working somewhere between two inputs.
    members = docs.hint("merge").join(shown, "id").select("id", "family", "node", "text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, offsets = flat(whole.column(3))
            node = whole.column(2).to_numpy()
            for lo, hi, part, local in chunks(raw, offsets):
                hashes, edges = _sets(part, local, k)
                sets = [hashes[edges[i] : edges[i + 1]] for i in range(hi - lo)]
                own = np.array([i for i, x in enumerate(sets) if len(x) and _node(x, renamed) == node[lo + i]], np.int64)
                yield pa.RecordBatch.from_arrays([whole.column(1).take(pa.array(own + lo)), whole.column(2).take(pa.array(own + lo)), pa.array([sets[i].tobytes() for i in own], pa.binary())], ["family", "node", "tokens"])

    def compare(rows: pa.Table) -> pa.Table:
        return _edge_table(_across(rows, lambda group, side: _linked([np.frombuffer(x.as_buffer(), _U) for x in group["tokens"]], group["node"].to_numpy(), side, percent)))

    sets = members.mapInArrow(expand, "family bigint, node bigint, tokens binary")
    sizes = families.groupBy(F.col("component").alias("family")).agg(F.count("*").alias("n_nodes"))
    return _in_blocks(sets, sizes, BLOCK, bins).groupBy(*_TASK).applyInArrow(compare, "u bigint, v bigint")


def _linked(sets: list[np.ndarray], ids: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(sizes, kind="stable")
    sets, ids, sizes = [sets[i] for i in order], ids[order], sizes[order]
    side = side[order] if side is not None else None
    log = max(8, int(np.ceil(np.log2(4 * max(1, int(sizes[-1]))))))
    bits = np.zeros((len(sets), 1 << (log - 3)), np.uint8)
    for i, s in enumerate(sets):
        at = (s >> _U(64 - log)).astype(np.int64)
        np.bitwise_xor.at(bits[i], at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    bits = bits.view(np.uint64)
    root = np.arange(len(sets))
    edges = []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        near = np.arange(i + 1, end)
        if side is not None:
            near = near[side[near] != side[i]]
        near = near[root[near] != root[i]]
        if not len(near):
            continue
        apart = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for j in near[apart <= most_different(sizes[near] + sizes[i], percent)]:
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                edges.append((int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))))
                root[root == root[j]] = root[i]
    return edges


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, carry: bool = False) -> DataFrame:
    """(``id_col``, n_shingles, component_id), one row for each row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct ``shingle``-word shingles,
    or the whole sequence of a shorter text. Two ids link when 100 * intersection >= ``percent`` * union of their sets
    (``percent`` from 1 to 100); ``component_id`` is the smallest id reachable by links. Null, empty and blank texts have
    no shingles and link with nothing. Rows that share an id are one node, linked if any of their texts is; a row with a
    null id has a null component and links nothing. An empty table gives an empty result. With ``carry`` the input row
    follows as the struct ``row``; else other columns are not carried. Ids are integers.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *carried(docs, carry))
    known = source.where("id IS NOT NULL").select("id", "text")
    nodes, renamed = rename_clashes(materialize(node_table(known, shingle), "nodes"))
    # A shingle takes 8 bytes of a set, and about as many of its keys.
    bins = bins_for(docs.sparkSession, 16 * (nodes.agg(F.sum("n")).first()[0] or 0))
    found = materialize(candidates(known, shingle, percent, renamed, bins), "candidates")
    families = components(close_pairs(found, nodes.select("node", "n", "bits").dropDuplicates(["node"]), percent, bins))
    linked = components(_with_shared_ids(similar_pairs(known, nodes, families, shingle, percent, renamed, bins), nodes))
    labels = materialize(_labels(nodes, linked), "labels")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, offsets = flat(whole.column(1))
            for lo, hi, part, local in chunks(raw, offsets):
                row = [whole.column(2).slice(lo, hi - lo)] if carry else []
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(lo, hi - lo), pa.array(np.diff(_sets(part, local, shingle)[1])), *row], ["id", "n_shingles", *["row"] * carry])

    def sized(part: DataFrame) -> DataFrame:
        return part.mapInArrow(count, with_row("id bigint, n_shingles bigint", source))

    counts = docs.select(F.col(id_col).cast("bigint").alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))
    out = join_back(source, labels, "id", counts=counts, prepare=sized)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("label", "id").alias("component_id"), *["row"] * carry)


def _with_shared_ids(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links, and those between different sets of rows that share an id."""
    own = nodes.select("id", "node")
    shared = own.groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w")
    return links.union(own.join(shared, "id").where("node <> v").select(F.col("node").alias("u"), "v"))


def _labels(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, label): the smallest id of the component of every id that is not the smallest itself."""
    copies = nodes.groupBy("node").agg(F.count("*").alias("n"))
    placed = join_back(nodes.select("id", "node"), linked.join(copies, "node"), "node").select("id", F.coalesce("component", "node").alias("c"))
    least = placed.groupBy("c").agg(F.min("id").alias("label"), F.max("id").alias("most"), F.count("*").alias("n")).where("label <> most")
    return join_back(placed, least, "c").where("id <> label").select("id", "label").distinct()
