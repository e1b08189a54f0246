"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model crosses from another character to a whitespace marker,
so a text falls apart in front of each run of markers into chunks that are
encoded on their own.  Each task keeps a table of the distinct chunks it has
met: a chunk is segmented once, by the library, and its ids are put at every
position where it stands.  The table is bounded and holds small objects: chunks
with spaces for markers (a byte a character in most scripts) and the ids'
bytes.  What no longer fits is segmented again, with the same result.  Models
whose pieces do cross markers are encoded text by text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, slices

MARK = "▁"
#: Chunks in a task's table, and characters from which a chunk is not kept.
TABLE, LONG = 150_000, 64
#: A chunk, with spaces for markers.
CHUNK = re.compile(" *[^ ]+| +$")
#: Texts that are cut into chunks together.
TOGETHER = 100


class Codec:
    """The library's encoder and decoder, the encoder behind a table of distinct chunks."""

    def __init__(self, path: str, size: int = TABLE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.table = size, {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        lists = self.model.encode(["a", " a", "  a  "], out_type=str, num_threads=1)
        # Chunks are right where markers only start pieces, and where the library keeps white space and adds a marker in front.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and lists[0][0][0] == MARK and "".join(lists[1]) == f"{MARK}{MARK}a" and "".join(lists[2]) == f"{MARK * 3}a{MARK * 2}"

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, as the bytes of 32-bit numbers. The library puts a marker in front, so the chunk's own first space is left out; of a lone marker nothing would be left."""
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        return [array("i", ids or [self.model.piece_to_id(MARK)]).tobytes() for ids in found]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(ids, np.int32) for ids in self.model.encode(texts, num_threads=1)]
        parts = [CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        table = self.table
        if len(table) > self.size:
            table.clear()
        if new := list(set().union(*parts).difference(table)):
            table.update(zip(new, self.segment(new)))
        out = [np.frombuffer(b"".join(map(table.__getitem__, p)), np.int32) for p in parts]
        for chunk in new:
            if len(chunk) >= LONG:
                del table[chunk]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


def id_lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def coder(path: str, decoded: bool):
    """A column function: text -> (ids, decoded); null is empty. Both come from one worker, so a task keeps one table and one model."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(path)
        for batch in batches:
            ids, texts = [], []
            for part in slices([batch], TOGETHER):
                found = codec.encode([t or "" for t in part.to_pylist()])
                ids.append(id_lists(found))
                texts.append(pa.array([codec.decode(x) for x in found] if decoded else [None] * len(found), pa.string()))
            columns = [pa.chunked_array(x, kind).combine_chunks() for x, kind in ((ids, pa.list_(pa.int32())), (texts, pa.string()))]
            yield pa.StructArray.from_arrays(columns, ["ids", "decoded"])

    return code


def decoder(path: str):
    """A column function: ids -> text; null is null."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(path)
        for batch in batches:
            values, offsets, gone = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy(), batch.is_null().to_numpy(zero_copy_only=False)
            yield pa.array([None if gone[i] else codec.decode(values[offsets[i] : offsets[i + 1]]) for i in range(len(batch))], pa.string())

    return decode


def encode_texts(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) or, with ``decoded``, (id, ids, decoded): one row for each document, without begin or end ids.

    decoded is what the library makes of the ids again.  Null and empty texts
    have no ids and decode to an empty text.  Repeated rows stay, null ids
    too; other columns are not read; an empty table gives no rows.
    """
    coded = batched(documents).select(F.col(id_col).alias(id_col), coder(path, decoded)(F.col(text_col)).alias("c"))
    return coded.select(id_col, "c.ids", *["c.decoded"] * decoded)


def decode_ids(encoded: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (replaced if it is there); no ids give an empty text, null gives null."""
    return batched(encoded).withColumn("decoded", decoder(path)(F.col(ids_col)))
