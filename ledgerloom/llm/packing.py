"""Packing token pieces into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at every ``capacity`` ids; such full pieces fill a sequence each. What is left is cut
at every ``piece`` ids and packed in blocks of about ``block`` documents: multiway differencing merges partial
partitions with opposing imbalances, and a block's window count rises whenever a window exceeds the capacity.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common, differencing, encoding

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    full = n // capacity * capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(piece, n - s)) for s in range(full, n, piece)]


def _pieces(batches, path: str, end: int, capacity: int, piece: int):
    from pyspark import TaskContext

    task, seen = TaskContext.get().partitionId(), 0
    tool, tail = encoding.encoder(path), struct.pack("<I", end)
    for b in batches:
        for ids, texts in common.text_slices(b, 2 << 20):
            rows = []
            for key, raw in zip(ids, tool.encode(texts), strict=True):
                raw += tail
                n, seen = len(raw) // 4, seen + 1
                rows += [(key, s, size, zlib.crc32(raw[4 * s : 4 * (s + size)]), n, task << 40 | seen) for s, size in cuts(n, capacity, piece)]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 10_000], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])


def _pack(batches, capacity: int):
    """Rows come sorted by block; one block is held at a time."""
    held, block = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != block:
                yield from _pack_block(block, held, capacity)
                held, block = [], row[0]
            held.append(row)
    yield from _pack_block(block, held, capacity)


def _pack_block(block, rows: list, capacity: int):
    if not rows:
        return
    full = [r for r in rows if r[4] == capacity]
    rest = [r for r in rows if r[4] < capacity]
    sets = [[rest[i] for i in w] for w in differencing.windows([r[4] for r in rest], capacity)] + [[r] for r in full]
    out = []
    for k, members in enumerate(sets):
        at = 0
        for _, _, doc_id, start, length, crc, doc_tokens in members:
            out.append((doc_id, start, length, crc, doc_tokens, block << 32 | k, at))
            at += length
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, piece: int = 512, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; null and repeated ids are packed like others, each row for
    itself. Other columns are not read. An empty table gives an empty one. A document of any length is cut
    whole. Only pieces' numbers are shuffled, no ids; blocks are dealt by a hash of the row's place, so no id or
    source can make one large.
    """
    texts = common.id_text(docs, id_col, text_col)
    blocks = max(1, -(-docs.select(F.lit(1)).count() // block))
    pieces = common.arrow_map(texts, "ledgerloom.llm.packing:_pieces", f"{_PIECE}, row long", path=tokenizer, end=end, capacity=capacity, piece=piece)
    keyed = pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).select("block", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    dealt = keyed.repartition(common.tasks(docs), "block").sortWithinPartitions("block", "row", "start")
    return common.arrow_map(dealt, "ledgerloom.llm.packing:_pack", f"{_PIECE}, sequence_id long, offset long", capacity=capacity)
