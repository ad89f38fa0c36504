"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of a model has a whitespace marker behind another character, no merge crosses from a word to the next
marker. A text is then a sequence of chunks (markers, then characters up to the next marker) that are segmented
independently. Each task keeps a table of the distinct chunks that it has met, segments only new ones, and puts the ids
back by position with one vectorised gather. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of chunks that a task's table holds before it starts anew.
TABLE_CHARS = 1 << 23


def check_model(model_path: str) -> None:
    """Raise unless the model can be segmented chunk by chunk: it only marks spaces (identity normalisation, a marker in
    front, no white space removed) and no piece crosses into a marker."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    if not plain or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model changes texts beyond marking spaces")
    if MARK not in {p.piece for p in model.pieces} or any(p.type == p.USER_DEFINED or MARK in p.piece.lstrip(MARK) for p in model.pieces):
        raise ValueError("pieces of this model cross whitespace markers")


class ChunkTable:
    """Ids and decoded text of distinct chunks, in flat arrays that a batch gathers from."""

    def __init__(self, processor):
        self.processor = processor
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ids, self.lens, self.texts = np.zeros(0, np.int32), np.zeros(0, np.int64), []

    def add(self, chunks: list[str]) -> None:
        """Segment chunks that are not in the table. The first marker of a chunk is the one that the library adds, but to an
        empty text it adds none: a marker alone, at the end of a text, is its piece."""
        encoded = self.processor.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        self.texts += [" " + t for t in self.processor.decode(encoded, num_threads=1)]
        if MARK in chunks:
            encoded[chunks.index(MARK)] = [self.processor.piece_to_id(MARK)]
        lens = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), np.int32, int(lens.sum()))
        self.ids, self.lens = np.concatenate([self.ids, flat]), np.concatenate([self.lens, lens])
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(flat ids, number of ids of each text, decoded texts)."""
        split = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if new := list({c for chunks in split for c in chunks} - self.index.keys()):
            if self.chars > TABLE_CHARS:
                self.clear()
                new = list({c for chunks in split for c in chunks})
            self.add(new)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((self.index[c] for chunks in split for c in chunks), np.int64, int(sizes.sum()))
        begins, lens = np.cumsum(self.lens) - self.lens, self.lens[at]
        ends = np.cumsum(lens)
        source = np.repeat(begins[at] - (ends - lens), lens) + np.arange(int(lens.sum()))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        text_of, index = self.texts, self.index
        return self.ids[source], np.diff(bounds), ["".join([text_of[index[c]] for c in chunks])[1:] for chunks in split]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>, decoded string), one row for each row of ``docs``.

    The ids are those of the sentencepiece library without begin or end ids and without sampling; ``decoded`` is its
    decode of them. A null or empty text has no ids and decodes to the empty string. Repeated rows are encoded each, null
    ids are kept, other columns are not carried, an empty table gives an empty result. ``model_path`` must be readable on
    every executor. Memory is bounded by ``TABLE_CHARS``, one slice of about a megabyte of texts, or the longest text.
    """
    check_model(model_path)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        chunk_table = ChunkTable(sentencepiece.SentencePieceProcessor(model_file=model_path))
        for whole in batches:
            for part in slices(whole):
                ids, sizes, decoded = chunk_table.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def slices(whole: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose second column has about ``size`` bytes together."""
    ends = np.cumsum(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < whole.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield whole.slice(lo, hi - lo)
        lo = hi
