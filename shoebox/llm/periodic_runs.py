"""Periodic runs of words by a suffix automaton whose suffix links are a link-cut tree.

Words are appended one by one. Every state of the automaton has the position where its strings ended last; states on the way from the
newest state to the root are recoloured to the new position by one access of the link-cut tree, which meets the old colours
segment by segment: a segment of colour e whose longest string has n words says that the last n words ended at e before. If the
distance p to the new end is not larger than n, the n + p words that end here have period p, and n is as large as it can be, so
they start where the run starts. The run is extended to the right and reported once.

The automaton is built over regions only. A run repeats its 3-word strings at a distance of at most its period, for three periods on
end; stretches where a text does so are found for all texts of a batch at once, and everything else can't hold a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import carried, with_row
from shoebox.llm.textkit import NOT_SPACE, Words, chunks, flat, splitmix

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
_GRAM = 3


def runs_between(words: list[int], lo: int, hi: int, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words`` that lie between ``lo`` and ``hi``, by start, then period.

    A run is as long as it can be and has its smallest period; it has at least ``least`` words and ``times`` periods (3 or more).
    Time is O(n log n) amortised; memory is some 500 bytes a word of the region.
    """
    # State 1 is the root, 0 is none. up is the parent in a splay tree, or of a tree's root the link to the path above it; colour is
    # kept at a tree's root only, for the whole path.
    step: list[dict[int, int]] = [{}, {}]
    link, size = [0, 0], [0, 0]
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        up[p], up[x] = x, g

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                colour[x] = colour[g]
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            else:
                colour[x] = colour[p]
            rotate(x)

    def state(n: int, steps: dict[int, int], shorter: int) -> int:
        step.append(steps)
        size.append(n)
        link.append(shorter)
        left.append(0)
        right.append(0)
        up.append(shorter)
        colour.append(-1)
        return len(size) - 1

    found: set[tuple[int, int, int]] = set()
    reported: dict[int, int] = {}  # the end of the last run of each period
    n_words, last = len(words), 1
    for i in range(lo, hi):
        word = words[i]
        new = state(i - lo + 1, {}, 0)
        at = last
        while at and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if not at:
            link[new] = up[new] = 1
        else:
            to = step[at][word]
            if size[to] == size[at] + 1:
                link[new] = up[new] = to
            else:
                # The copy goes into the path right above ``to``, whose colour it shares.
                splay(to)
                copy = state(size[at] + 1, dict(step[to]), link[to])
                above = left[to]
                left[copy] = above
                if above:
                    up[above] = copy
                left[to], up[copy] = copy, to
                while at and step[at].get(word) == to:
                    step[at][word] = copy
                    at = link[at]
                link[to] = link[new] = up[new] = copy
        last = new

        x, y = new, 0
        while x:
            splay(x)
            before, n = colour[x], size[x]
            below = right[x]
            if below:
                colour[below] = before
            right[x] = y
            y, x = x, up[x]
            p = i - before
            if before >= 0 and n + p >= least and n + p >= times * p and reported.get(p, -1) < i:
                start, end = i - n - p + 1, i + 1
                while start > 0 and words[start - 1] == words[start - 1 + p]:
                    start -= 1
                while end < n_words and words[end] == words[end - p]:
                    end += 1
                reported[p] = end - 1
                found.add((start, end - start, p))
        colour[y] = i
    return sorted(found, key=lambda r: (r[0], r[2]))


def regions(words: Words, rows: int, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[list[tuple[int, int]]]:
    """For each row, the disjoint parts [from, to) outside of which it has no run; places are words of the chunk.

    In a run of period q, 3-word strings come back within q words on (``times`` - 1) * q - 2 or more places on end, for q = 1 on
    ``least`` - 3 or more. Periods are taken by powers of two.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    at, grams = words.ngrams(_GRAM)
    if not len(at):
        return found
    of = words.row[at]
    with np.errstate(over="ignore"):
        key = grams ^ splitmix(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    back = np.full(len(at), np.iinfo(np.int64).max)
    back[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
    longest = int(np.diff(words.first).max())
    near = np.flatnonzero(back <= longest // times)
    parts: list[np.ndarray] = []
    reach = 1
    while len(near) and reach // 2 < max(longest // times, 1):
        close = near[back[near] <= reach]
        if len(close):
            place, row = at[close], of[close]
            cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(row) != 0))
            first, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(close) - 1]])
            need = least - _GRAM if reach == 1 else min((times - 1) * (reach // 2 + 1) - 2, 1 << 62)
            wide = np.flatnonzero(end - first + 1 >= need)
            a, b, r = place[first[wide]], place[end[wide]], row[first[wide]]
            parts.append(np.stack([np.maximum(a - reach, words.first[r]), b + _GRAM, r], axis=1))
        reach *= 2
    if parts:
        whole = np.concatenate(parts)
        for a, b, r in whole[np.lexsort((whole[:, 0], whole[:, 2]))].tolist():
            if found[r] and a <= found[r][-1][1]:
                found[r][-1] = (found[r][-1][0], max(b, found[r][-1][1]))
            else:
                found[r].append((a, b))
    return found


def row_runs(words: Words, rows: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each row of a chunk, by start, then period; words are known by 64-bit hashes."""
    out: list[list[tuple[int, int, int]]] = []
    for row, parts in enumerate(regions(words, rows)):
        first, end = int(words.first[row]), int(words.first[row + 1])
        out.append([])
        if parts:
            known = words.hash[first:end].tolist()
            for a, b in parts:
                out[-1] += runs_between(known, a - first, b - first)
    return out


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that a run holds after its first period, joined by one space."""
    parts = text.split()  # of bytes: at 0x20 and 0x09 to 0x0D
    if runs:
        keep = np.ones(len(parts), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        parts = [parts[i] for i in np.flatnonzero(keep)]
    return b" ".join(parts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(``id_col``, n_words, runs array<struct<start, length, period>>, collapsed), one row for each row of ``docs``.

    Words are what stands between ASCII white space, compared as they are. A run is a stretch with smallest period q of at least 6 words
    and 4 q words that no neighbouring word extends; runs come by start, then period. ``collapsed`` are the words without those
    that a run repeats, joined by one space.

    Null and empty texts have no words, no runs and the empty string. Repeated rows and null ids are kept, each with its own runs. An
    empty table gives an empty one. Other columns don't matter; with ``carry`` the whole input row is in the column ``row``.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried(docs, carry))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw, offsets = flat(whole.column(1))
            for lo, hi, part, local in chunks(raw, offsets):
                words = Words(part, local, NOT_SPACE, fold=False)
                runs = row_runs(words, hi - lo)
                view = memoryview(part)
                left = [_collapsed(bytes(view[local[i] : local[i + 1]]), runs[i]).decode() for i in range(hi - lo)]
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
                columns = [whole.column(0).slice(lo, hi - lo), pa.array(np.diff(words.first).astype(np.int64)), pa.array(rows, run_type), pa.array(left, pa.large_string())]
                yield pa.RecordBatch.from_arrays([*columns, *(c.slice(lo, hi - lo) for c in whole.columns[2:])], ["id", "n_words", "runs", "collapsed", *whole.schema.names[2:]])

    kind = source.schema["id"].dataType.simpleString()
    schema = with_row(f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", source)
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
