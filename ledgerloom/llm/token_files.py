"""Token-id files: one zstandard frame a document, then a trailing seek table with a checksum for each frame.

A file is a series of independent frames of uint32 ids, a skippable frame with the frames' document ids, and
the seek table of the zstandard seekable format: for each frame its compressed size, its raw size and the low
half of the raw bytes' xxh64; then the number of frames, a descriptor byte and a magic number. A reader takes
the table from the end and decompresses only the documents it is asked for.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common, encoding

# Fixed values of the format.
_SKIP_IDS = 0x184D2A50
_SKIP_TABLE = 0x184D2A5E
_FOOT = 0x8F92EAB1
_CHECKSUMS = 0x80


def _place(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def write_file(uri: str, documents: Iterable[tuple[int | None, bytes]], level: int = 1) -> tuple[int, int]:
    """Write (doc_id, ids as bytes) to a new file and move it into place; numbers of documents and ids.

    A task that runs again writes the same bytes to the same name.
    """
    fs, path = _place(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    tool, table, keys, ids = zstandard.ZstdCompressor(level=level, write_content_size=True), [], [], 0
    with fs.open_output_stream(part, buffer_size=1 << 20) as out:
        for key, raw in documents:
            frame = tool.compress(raw)
            out.write(frame)
            table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            keys.append(struct.pack("<?q", key is not None, key or 0))
            ids += len(raw) // 4
        body = b"".join(keys)
        out.write(struct.pack("<II", _SKIP_IDS, len(body)) + body)
        foot = b"".join(table) + struct.pack("<IBI", len(table), _CHECKSUMS, _FOOT)
        out.write(struct.pack("<II", _SKIP_TABLE, len(foot)) + foot)
    fs.move(part, path)
    return len(table), ids


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, uri: str):
        fs, path = _place(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, kind, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _FOOT or not kind & _CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(count, 3)
        self.sizes, self.raw_sizes, self.sums = table[:, 0].astype(np.int64), table[:, 1], table[:, 2]
        self.starts = np.cumsum(self.sizes) - self.sizes
        keys = self.file.read_at(9 * count, int(self.sizes.sum()) + 8)
        self.doc_ids = [k if there else None for there, k in struct.iter_unpack("<?q", keys)]
        self.tool = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def raw(self, k: int) -> bytes:
        """Bytes of the k-th document; its frame alone is read and decompressed."""
        return self._checked(k, self.file.read_at(int(self.sizes[k]), int(self.starts[k])))

    def every(self, most: int = 4 << 20) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, bytes) of all documents in order, reading about ``most`` bytes of frames at once."""
        at = 0
        while at < len(self):
            stop = max(at + 1, int(np.searchsorted(self.starts + self.sizes, self.starts[at] + most, "right")))
            held = memoryview(self.file.read_at(int(self.starts[stop - 1] + self.sizes[stop - 1] - self.starts[at]), int(self.starts[at])))
            for k in range(at, stop):
                a = int(self.starts[k] - self.starts[at])
                yield self.doc_ids[k], self._checked(k, held[a : a + int(self.sizes[k])])
            at = stop

    def _checked(self, k: int, frame) -> bytes:
        out = self.tool.decompress(frame, max_output_size=int(self.raw_sizes[k]))
        if xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return out

    def read(self, doc_id: int) -> np.ndarray:
        return np.frombuffer(self.raw(self.doc_ids.index(doc_id)), "<u4")

    def close(self) -> None:
        self.file.close()


def _write(batches, path: str, end: int, where: str):
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    tool, tail = encoding.encoder(path), struct.pack("<I", end)

    def documents(first) -> Iterator:
        b = first
        while b is not None:
            for ids, texts in common.text_slices(b, 2 << 20):
                for key, raw in zip(ids, tool.encode(texts), strict=True):
                    yield key, raw + tail
            b = next(batches, None)

    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    uri = f"{where}/tokens-{shard:06d}.zst"
    docs, ids = write_file(uri, documents(first))
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [uri], "docs": [docs], "ids": [ids]})


def _read(batches):
    for b in batches:
        for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist(), strict=True):
            f, rows, start = TokenFile(uri), [], base
            for k, (key, raw) in enumerate(f.every()):
                rows.append((key, start, len(raw) // 4, zlib.crc32(raw)))
                start += len(raw) // 4
                if len(rows) == 10_000 or k == len(f) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    rows = []
            f.close()


def write_tokens(docs: DataFrame, tokenizer: str, where: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 256 << 20) -> DataFrame:
    """Encode whole texts, add id ``end``, write files under ``where`` in ascending id order; the files' manifest.

    Manifest: shard, uri, docs, ids, base (ids in all files before). ``where`` must be a folder all executors
    reach. Null texts are empty and hold ``end`` alone; null ids come first; rows of the same id are ordered by a hash
    of their texts, so that one id may fill several files. One file a non-empty range; an empty table gives no
    file. A file holds about ``file_bytes`` of text at most, however large the table. The texts are shuffled once, by range;
    ids are only ever held a slice at a time.
    """
    texts = common.id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    n = max(common.tasks(docs), -(-size // file_bytes))
    ranged = texts.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    written = common.materialize(common.arrow_map(ranged, "ledgerloom.llm.token_files:_write", "shard int, uri string, docs long, ids long", path=tokenizer, end=end, where=where), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file, so one task can hold it
    return written.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_index(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Null and repeated ids are as the files hold them; a manifest without files gives an empty table; a frame that
    does not match its checksum stops the read. Files are dealt out one by one and read some megabytes at a time.
    """
    spread = manifest.select("uri", "base").repartition(common.tasks(manifest), "uri")
    return common.arrow_map(spread, "ledgerloom.llm.token_files:_read", "doc_id long, start long, n_tokens long, ids_crc32 long")
