"""BPE encoding and decoding through tables of distinct words and of pieces.

Texts are split into words; a block of some megabytes of texts becomes one row of word numbers, by position, and rows of
the block's distinct words, dealt by a hash of the word. Where all blocks' rows of a share of the words meet, each distinct
word is encoded once, and the ids go back to the blocks that asked for it; there each document's ids are put together by
its words' positions. Decoding is the same the other way: the distinct ids of a block are joined with the table of pieces,
and pieces are put together by position.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common, encoding, pretoken
from ledgerloom.llm.token_count import byte_symbols

_BLOCK = 12 << 20  # characters of a block's texts
_SHARE = 64 << 20  # bytes of text to a share of the words
_SPLIT = "block long, share long, numbers binary, words binary"
_IDS = "block long, place int, doc_id long, ids array<int>, code int, id int"


class _Codes(dict):
    """Numbers keys in the order in which they are first seen."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


@lru_cache(maxsize=2)
def _tool(path: str):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


def _special(path: str) -> list[str]:
    return sorted((t.content for t in _tool(path).get_added_tokens_decoder().values()), key=len, reverse=True)


def parts_of(text: str, special: list[str]):
    """(is special, part) of a text: strings of added tokens, and what stands between them."""
    if not special:
        yield False, text
        return
    head, *rest = special
    for k, between in enumerate(text.split(head)):
        if k:
            yield True, head
        if between:
            yield from parts_of(between, rest)


def words_of(text: str, special: list[str]):
    """(lead, words) of a text in order: with ``lead`` each of the words has a space in front."""
    for whole, part in parts_of(text, special):
        if whole:
            yield False, [part]
            continue
        for first, piece in pretoken.slices(part):
            found = pretoken.units(piece)
            if first:
                yield False, found[:1] if found[0] else []
                found = found[1:]
            yield True, found


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit integers in one compressed frame, byte planes apart."""
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(arrays), *map(len, arrays)], "<u8").tobytes(), *planes]))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    out, at = [], 8 * (n + 1)
    for size in np.frombuffer(raw, "<u8", n, 8).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").reshape(-1))
        at += 4 * size
    return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.fromiter(map(len, words), np.int64, len(words)), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def _apart(sizes: np.ndarray, data: bytes) -> list[bytes]:
    raw, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(sizes.astype(np.int64)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _split(batches, special: list, block: int, shares: int, want: str):
    """Of each block the row of its word numbers, or the rows of its distinct words: one a share."""
    from pyspark import TaskContext

    common.claim("word_split", common.give_back)
    task, number = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        for ids, texts in common.text_slices(b, block):
            tables, numbers, counts = (_Codes(), _Codes()), [np.zeros(0, np.int32)], []
            for text in texts:
                n = 0
                for lead, words in words_of(text, special):
                    numbers.append(np.fromiter(map(tables[lead].__getitem__, words), np.int32, len(words)) * 2 + lead)
                    n += len(words)
                counts.append(n)
            at, number = task | number, number + 1
            if want == "numbers":
                keys = np.array([k or 0 for k in ids], np.int64).view(np.uint64)
                named = np.array([k is not None for k in ids])
                packed = _packed(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), named, np.array(counts), np.concatenate(numbers))
                del tables, numbers
                common.give_back()  # the tables of words were large, and the worker lives on
                yield _batch(_SPLIT, block=[at], numbers=[packed])
                continue
            codes, raws = [], []
            del numbers
            for lead, table in enumerate(tables):
                front = b" " if lead else b""
                raws += [front + w.encode("utf-8", "surrogatepass") for w in table]
                codes.append(np.arange(len(table)) * 2 + lead)
                table.clear()
            codes, share, rows = np.concatenate(codes), np.fromiter((zlib.crc32(r) % shares for r in raws), np.int64, len(raws)), []
            order = np.argsort(share, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(share[order])) + 1) if len(order) else ():
                words, which = zip(*sorted((raws[k], k) for k in own.tolist()), strict=True)
                sizes, data = _joined(list(words))
                rows.append((int(share[own[0]]), _packed(codes[list(which)], sizes), data))
            del raws, codes, share, order
            for k in range(0, len(rows), 1000):
                some = rows[k : k + 1000]
                yield _batch(_SPLIT, block=[at] * len(some), share=[r[0] for r in some], numbers=[r[1] for r in some], words=[r[2] for r in some])
            del rows
            common.give_back()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch of a schema's columns; those not given are null."""
    fields = [f.split(" ") for f in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c, _ARROW[kind])) if (c := columns.get(name)) is not None else pa.nulls(n, _ARROW[kind]) for name, kind in fields], [name for name, _ in fields])


def _encode(batches, path: str):
    """Rows come sorted by share; a share's distinct words are encoded once each and kept while its rows pass."""
    common.claim("word_table", _tool.cache_clear)
    tool, share, known = _tool(path), None, {}
    for b in batches:
        out = []
        for block, own, numbers, words in zip(b.column("block").to_pylist(), b.column("share").to_pylist(), b.column("numbers").to_pylist(), b.column("words").to_pylist(), strict=True):
            if own != share:
                share, known = own, {}
            codes, sizes = _unpacked(numbers)
            asked = _apart(sizes, words)
            new = [w for w in asked if w not in known]
            for k in range(0, len(new), 4096):
                some = new[k : k + 4096]
                found = tool.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False)
                known.update((w, np.array(e.ids, np.int32)) for w, e in zip(some, found, strict=True))
            ids = [known[w] for w in asked]
            out.append((block, _packed(codes, np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids))))
        for block, numbers in out:
            yield _batch("at long, numbers binary", at=[block], numbers=[numbers])


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """Runs of ``values``, one a code, one after another; positions are made for ``most`` codes at a time."""
    parts = range(0, len(codes), most)
    out, at = np.empty(sum(int(sizes[codes[k : k + most]].sum()) for k in parts), values.dtype), 0
    for k in parts:
        some = codes[k : k + most]
        n = sizes[some]
        ends = np.cumsum(n)
        np.take(values, np.arange(ends[-1]) + np.repeat(starts[some] - (ends - n), n), out=out[at : at + int(ends[-1])])
        at += int(ends[-1])
    return out


def _by_code(code: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs that lie one after another, by their code; every code below ``most`` that occurs must be there."""
    starts, lens = np.zeros(most, np.int64), np.full(most, -1, np.int64)
    starts[code], lens[code] = np.cumsum(sizes) - sizes, sizes
    return starts, lens


def _together(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """Ids of a block's documents: each document's word numbers replaced by their ids, in position."""
    common.claim("word_places", common.give_back)  # lets go the tokenizer, which is not needed here
    common.give_back()  # a worker puts many blocks together, and what it freed of one would stay
    parts = [_unpacked(raw) for raw in words.column("numbers").to_pylist()]
    code, sizes, flat = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint32) for k in range(3))
    del parts
    flat, keys, found, lengths = flat.view(np.int32), [], [], []
    for raw in blocks.column("numbers").to_pylist():
        high, low, named, counts, numbers = _unpacked(raw)
        starts, lens = _by_code(code, sizes.astype(np.int64), int(max(numbers.max(initial=0), code.max(initial=0))) + 1)
        used = np.zeros(len(lens), bool)
        used[numbers] = True
        if (lens[used] < 0).any():
            raise ValueError("a block's words are not all there")
        ids = (high.astype(np.uint64) << np.uint64(32) | low).view(np.int64)
        keys.append(pa.array(ids, mask=named == 0))
        lengths += [int(lens[own].sum()) for own in np.split(numbers, np.cumsum(counts.astype(np.int64))[:-1])]
        found.append(gathered(flat, starts, lens, numbers))
    offsets = np.cumsum([0, *lengths], dtype=np.int64).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.int32), *found])))
    return pa.table({"doc_id": pa.chunked_array(keys, pa.int64()).combine_chunks() if keys else pa.array([], pa.int64()), "ids": ids})


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block: int = _BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int), as the library encodes the whole text.

    Null and empty texts have no ids; null and repeated ids each keep their row; an empty table gives an empty one;
    strings of added tokens inside a text become their ids, as the library has it by default. Other columns are not
    read. Every distinct word is encoded once in the whole job. What is shuffled is a block's distinct words, their ids,
    and a number for each word of a text, all packed; a block is held by one task, and is at most a batch of rows,
    12 million characters or one longer document. The words are dealt into as many shares as the texts' size asks for, so
    that a share's table stays small; a word that all blocks hold is one entry a block, so no share grows with one word.
    The texts are split twice in one plan, for words and for numbers, which costs less than writing both down; both
    splits read the same partitions, and a block whose words and numbers did not agree would stop the job.
    """
    return common.arrow_cogroups(*_sides(docs, tokenizer, id_col, text_col, block), "ledgerloom.llm.word_table:_together", "doc_id long, ids array<int>")


def _sides(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, block: int):
    """Blocks of word numbers, and the ids of their words, both grouped by block."""
    texts = common.id_text(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    shares = max(2 * common.tasks(docs), -(-size // _SHARE))
    split = lambda want: common.arrow_map(texts, "ledgerloom.llm.word_table:_split", _SPLIT, special=_special(tokenizer), block=block, shares=shares, want=want)
    words = split("words").repartition(shares // 2, "share").sortWithinPartitions("share", "block")
    known = common.arrow_map(words, "ledgerloom.llm.word_table:_encode", "at long, numbers binary", path=tokenizer)
    blocks = split("numbers").select("block", "numbers")
    return blocks.groupBy("block"), known.groupBy("at")


def pieces(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece) of a byte-level vocabulary file, pieces as bytes: as many rows as the file has entries."""
    spec = json.load(open(tokenizer, encoding="utf-8"))
    value = {s: b for b, s in enumerate(byte_symbols())}
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    raw = lambda t: bytearray(value[c] for c in t) if all(c in value for c in t) else bytearray(t.encode())
    return spark.createDataFrame([(i, raw(t)) for i, t in tokens.items()], "id int, piece binary")


def _numbered(at: int, doc_ids: pa.Array, ids: pa.ListArray):
    """Documents of ids as rows of a block, and the block's distinct ids."""
    whole = pc.if_else(ids.is_valid(), ids, pa.scalar([], ids.type)) if ids.null_count else ids
    yield _batch(_IDS, block=[at] * len(ids), place=range(len(ids)), doc_id=doc_ids, ids=whole)
    del whole
    distinct = np.unique(ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False))  # a null id is in no vocabulary
    yield _batch(_IDS, block=[at] * len(distinct), code=range(len(distinct)), id=distinct.astype(np.int32))


def _number(batches, block: int):
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // block, prepend=0)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if a < z:
                some = b.slice(a, z - a)
                yield from _numbered(task | number, some.column("doc_id"), some.column("ids"))
                number += 1


def _together_numbered(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """As _together(), in the rows that decoding takes: a block of texts is a block of ids."""
    out = _together(blocks, words)
    return pa.Table.from_batches(list(_numbered(blocks.column("block")[0].as_py(), out.column("doc_id").combine_chunks(), out.column("ids").combine_chunks())))


def _read_back(batches):
    """Rows come sorted by block, a block's pieces first; pieces of one block are held at a time."""
    common.claim("word_places", common.give_back)
    block, known, raws, table = None, [], [], None
    for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        texts, rows = [], []
        for k, (at, doc) in enumerate(zip(b.column("block").to_pylist(), b.column("ids"), strict=True)):
            if at != block:
                block, known, raws, table = at, [], [], None
                common.give_back()
            if not doc.is_valid:
                known.append(b.column("id")[k].as_py())
                raws.append(b.column("piece")[k].as_py() or b"")
                continue
            if table is None:
                keys = np.array(known, np.int64)
                sizes = np.fromiter(map(len, raws), np.int64, len(raws))
                table = np.frombuffer(b"".join(raws), np.uint8), np.cumsum(sizes) - sizes, sizes
                order = np.argsort(keys)
            codes = order[np.searchsorted(keys, doc.values.fill_null(-1).to_numpy(zero_copy_only=False), sorter=order)] if len(doc.values) else np.zeros(0, np.int64)
            texts.append(gathered(*table, codes).tobytes().decode("utf-8", "replace"))
            rows.append(k)
        if rows:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), b.column("ids").take(pa.array(rows)), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids", block: int = 1 << 20) -> DataFrame:
    """One row per row of ``encoded``: doc_id, ids, text, the library's decode() with special tokens kept.

    Null and empty ids give the empty text; ids outside the vocabulary and null ones give nothing; bytes that are no UTF-8 become
    replacement characters. Null and repeated document ids each keep their row; an empty table gives an empty one; other
    columns are not read. The piece table, as large as the vocabulary file, is broadcast to the join; nothing is shuffled.
    """
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return _pieced(common.arrow_map(rows, "ledgerloom.llm.word_table:_number", _IDS, block=block), tokenizer)


def _pieced(numbered: DataFrame, tokenizer: str) -> DataFrame:
    joined = numbered.join(F.broadcast(pieces(numbered.sparkSession, tokenizer)), "id", "left")
    laid = joined.select("block", "place", "doc_id", "ids", "code", "id", "piece").sortWithinPartitions("block", F.col("place").asc_nulls_first(), "code")
    return common.arrow_map(laid, "ledgerloom.llm.word_table:_read_back", "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block: int = _BLOCK) -> DataFrame:
    """decode(encode(docs)), with a block's ids handed on as a block: one Python worker less in a task."""
    return _pieced(common.arrow_cogroups(*_sides(docs, tokenizer, id_col, text_col, block), "ledgerloom.llm.word_table:_together_numbered", _IDS), tokenizer)


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8)."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
