"""Removal of byte strings that occur more than once, by blockwise suffix sorting with cover-sample ranks.

Equal strings of ``length`` bytes hold equal anchors at equal places: the ``gram``-byte strings whose hash is
the least in some window. An anchor is the head of a suffix bucket. Buckets of one suffix hold nothing
repeated; suffixes with equal surroundings are settled by counting; only what is left is sorted, a block of
whole buckets at a time, so memory is bounded by a block.

In a bucket all suffixes start at the same anchor, so two of them always differ by zero modulo the sampling
period and the cover {0} suffices. Before the buckets are sorted, the samples of the block, every ``_PERIOD``
bytes of each suffix, are ranked from the far end; ties longer than a period are settled by these ranks
without looking at the bytes again. Neighbours' common lengths on both sides of the anchor then tell which
strings repeat. A bucket too large for a block is split by the bytes beside the anchor, again and again: strings
that start close before it share most of what follows, the others most of what precedes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common, shingles

LENGTH, GRAM = 400, 200
SIDE = LENGTH - GRAM
_PERIOD = 40
# Suffixes of the largest bucket that is sorted, of a block of buckets, and entries of (suffix, step) looked at together.
_BUCKET_MOST, _BLOCK, _ENTRIES = 32_768, 8192, 1 << 20


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each run of ``width`` values."""
    pick, fill = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, fill, np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = pick.accumulate(grid, axis=1).reshape(-1)
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def _sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(shingles._VALUE[raw] * shingles._power(shingles._BASE, len(raw)), out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, wherever they stand."""
    return common.mix64((sums[end] - sums[start]) * shingles._power(shingles._INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, anchor hashes, hashes of anchor and surroundings) of a text's bytes."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = _sums(raw)
    at = np.arange(n - GRAM + 1)
    h = _hash(sums, at, at + GRAM)
    least = _slide(h, SIDE + 1, True)
    edge = np.zeros(SIDE, np.uint64)
    where = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), SIDE + 1, False) == h)
    data = memoryview(raw)
    around = np.array([xxhash.xxh3_64_intdigest(data[max(p - SIDE, 0) : p + LENGTH], min(p, SIDE)) for p in where.tolist()], np.uint64)
    return where, h[where], around


def content_key(raw: bytes) -> tuple[int, int]:
    """A 128-bit content hash as two signed numbers."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64)
    return int(a), int(b)


def _first(batches):
    """Of each text: size, content key and anchors."""
    common.claim("shingles", shingles.forget)
    for b in batches:
        for _, texts in common.text_slices(b):
            rows, sizes, parts = [], [0], []
            for t in texts:
                raw = t.encode()
                found = anchors(np.frombuffer(raw, np.uint8))
                parts.append(found)
                sizes.append(sizes[-1] + len(found[0]))
                rows.append((len(raw), *content_key(raw)))
            n, d1, d2 = zip(*rows, strict=True)
            pos, head, around = (np.concatenate(c) for c in zip(*parts, strict=True))
            struct = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(head.view(np.int64)), pa.array(around.view(np.int64))], ["pos", "head", "around"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct)],
                ["n_bytes", "d1", "d2", "anchors"],
            )


def _keyed(batches):
    """The content key of each text, before its row's columns."""
    for b in batches:
        keys = [content_key(t.as_buffer().to_pybytes()) for t in b.column("text")]
        d1, d2 = zip(*keys, strict=True) if keys else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *b.columns], ["d1", "d2", *b.schema.names])


_KIND = "head long, size long, lo int, hi int, d1 long, d2 long, pos long, before int, around binary"


def _surroundings(batches):
    """Rows of anchor, content key, position and the bytes around the anchor."""
    for b in batches:
        lists = b.column("wanted")
        flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(b.num_rows), counts)
        pos = flat.field("pos").to_numpy()
        for at in range(0, len(pos), 4000):
            part = slice(at, at + 4000)
            rows, p = owner[part], pos[part]
            raws, last = [], None
            for k, q in zip(rows.tolist(), p.tolist(), strict=True):
                if k != last:
                    raw, last = b.column("text")[k].as_buffer(), k
                raws.append(raw[max(0, q - SIDE) : q + LENGTH].to_pybytes())
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [flat.field("head").slice(at, len(p)), flat.field("size").slice(at, len(p)), pa.array(np.zeros(len(p), np.int32)), pa.array(np.full(len(p), SIDE, np.int32)), b.column("d1").take(take), b.column("d2").take(take), pa.array(p.astype(np.int64)), pa.array(np.minimum(p, SIDE).astype(np.int32)), pa.array(raws, pa.binary())],
                [c.split()[0] for c in _KIND.split(", ")],
            )


def sample_ranks(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranks of byte rows, of which the first ``sizes`` bytes count, from samples every _PERIOD bytes.

    A sample's rank follows from its period's bytes and the next sample's rank, so the whole rows' rank is that of
    the first sample. A row that ends comes before one that goes on, whatever the bytes: equal fillings are told
    apart by size.
    """
    m, width = rows.shape
    rank = sizes.astype(np.int64)
    for at in range((width - 1) // _PERIOD * _PERIOD, -1, -_PERIOD):
        block = np.ascontiguousarray(rows[:, at : at + _PERIOD])
        words = np.zeros((m, -(-block.shape[1] // 8) * 8), np.uint8)
        words[:, : block.shape[1]] = block
        keys = words.view(">u8")
        order = np.lexsort([rank, *keys.T[::-1]])
        new = np.any(keys[order[1:]] != keys[order[:-1]], axis=1) | (rank[order[1:]] != rank[order[:-1]])
        rank = np.empty(m, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
    return rank


def _alike(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows of a and b, at most ``most``."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def _sorted_side(rows: np.ndarray, sizes: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by bucket and bytes, and what each shares with the one before in its bucket; -1 for the first."""
    order = np.lexsort([sample_ranks(rows, sizes), bucket])
    one, two = order[:-1], order[1:]
    shared = _alike(rows[one], rows[two], np.minimum(sizes[one], sizes[two]))
    return order, np.concatenate([[-1], np.where(bucket[one] == bucket[two], shared, -1)])


def repeated(bucket: np.ndarray, before: np.ndarray, after: np.ndarray, grid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix, the least and the greatest step before the anchor at which a string starts that repeats; none: SIDE + 1 and -1.

    ``bucket`` ascends; ``grid`` holds the bytes around the anchor, which starts at column SIDE; ``before`` and
    ``after`` tell how many of them there are before and from the anchor; only steps from lo to hi count. All
    strings of a suffix overlap at the anchor, so the two steps say what they cover.
    """
    m = len(bucket)
    least, greatest = np.full(m, SIDE + 1), np.full(m, -1)
    if not m:
        return least, greatest
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
    size = np.diff(first, append=m)
    gram = grid[:, SIDE:LENGTH]
    if (gram != np.repeat(gram[first], size, 0)).any():  # hashes agree though the anchors do not: buckets of their own
        own = np.unique(gram, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort([own, bucket])
        new = (np.diff(bucket[order], prepend=-1) != 0) | (np.diff(own[order], prepend=-1) != 0)
        least[order], greatest[order] = repeated(np.cumsum(new), *(c[order] for c in (before, after, grid, lo, hi)))
        return least, greatest
    left, right = grid[:, SIDE - 1 :: -1], grid[:, LENGTH:]
    ahead = after - GRAM

    one = first[size == 2]  # two suffixes need no order
    two = one + 1
    low = np.maximum(SIDE - _alike(right[one], right[two], np.minimum(ahead[one], ahead[two])), lo[one])
    high = np.minimum(_alike(left[one], left[two], np.minimum(before[one], before[two])), hi[one])
    for own in (one[low <= high], two[low <= high]):
        least[own], greatest[own] = low[low <= high], high[low <= high]

    rows = np.flatnonzero(np.repeat(size, size) > 2)
    if len(rows):
        least[rows], greatest[rows] = _among(bucket[rows], np.ascontiguousarray(left[rows]), before[rows], np.ascontiguousarray(right[rows]), ahead[rows], lo[rows], hi[rows])
    return least, greatest


def _among(bucket, left, before, right, ahead, lo, hi):
    """For repeated(): buckets of three and more. Which suffixes share a step changes only where a common length ends."""
    m = len(bucket)
    least, greatest = np.full(m, SIDE + 1), np.full(m, -1)
    bucket = np.cumsum(np.diff(bucket, prepend=bucket[0]) != 0)
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    size = np.diff(start, append=m)
    order_l, shared_l = _sorted_side(left, before, bucket)
    order_r, shared_r = _sorted_side(right, ahead, bucket)
    ends = [np.where(shared_l >= 0, shared_l + 1, 0), np.where(shared_r >= 0, SIDE - shared_r, 0), np.zeros(m, np.int64)]
    marks = np.unique(np.concatenate([bucket * 1024 + np.clip(e, lo, hi) for e in ends]))
    of, step = marks // 1024, marks % 1024
    until = np.where(np.append(of[1:], -1) == of, np.append(step[1:], 0) - 1, hi[start[of]])
    reach = np.cumsum(size[of])
    for at in range(0, int(reach[-1]), _ENTRIES):
        k = slice(np.searchsorted(reach, at, "right"), np.searchsorted(reach, at + _ENTRIES, "right"))
        n = size[of[k]]
        if not len(n):
            continue
        offset, total = np.cumsum(n) - n, int(n.sum())
        mark = np.repeat(np.arange(len(n)), n)
        base = start[of[k]][mark]
        place = base + np.arange(total) - offset[mark]
        step_of = step[k][mark]
        groups = []
        for order, shared, need in ((order_l, shared_l, step_of), (order_r, shared_r, SIDE - step_of)):
            group = np.empty(total, np.int64)
            group[offset[mark] + order[place] - base] = np.cumsum(shared[place] < need)
            groups.append(group)
        several = np.flatnonzero((np.bincount(groups[0])[groups[0]] > 1) & (np.bincount(groups[1])[groups[1]] > 1))
        if not len(several):
            continue
        keys = groups[0][several] * (total + 1) + groups[1][several]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        none = np.zeros(1, bool)
        found = several[order[np.append(none, same) | np.append(same, none)]]
        np.minimum.at(least, place[found], step_of[found])
        np.maximum.at(greatest, place[found], until[k][mark[found]])
    return least, greatest


def _grid(arounds, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes around anchors in rows, anchors in one column, and the number of bytes from the anchor on."""
    buffers, n = arounds.buffers(), len(arounds)
    ends = np.frombuffer(buffers[1], np.int32)[arounds.offset : arounds.offset + n + 1]
    data, sizes = np.frombuffer(buffers[2] or b"", np.uint8), np.diff(ends)
    if n and (sizes == SIDE + LENGTH).all():
        return data[ends[0] : ends[-1]].reshape(n, SIDE + LENGTH), sizes - before
    grid = np.zeros((n, SIDE + LENGTH), np.uint8)
    for r, (k, a, b) in enumerate(zip(before.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        grid[r, SIDE - k : SIDE - k + b - a] = data[a:b]
    return grid, sizes - before


def _settled(table: pa.Table):
    """Spans of strings that repeat, of whole buckets."""
    if not table.num_rows:
        return
    b = table.combine_chunks().to_batches()[0]
    before, pos, lo, hi = (b.column(c).to_numpy().astype(np.int64) for c in ("before", "pos", "lo", "hi"))
    grid, after = _grid(b.column("around"), before)
    bucket = np.cumsum(np.diff(b.column("head").to_numpy(), prepend=b.column("head")[0].as_py()) != 0)
    least, greatest = repeated(bucket, before, after, grid, lo, hi)
    k = np.flatnonzero(greatest >= 0)
    if len(k):
        take = pa.array(k)
        yield pa.RecordBatch.from_arrays([b.column("d1").take(take), b.column("d2").take(take), pa.array(pos[k] - greatest[k]), pa.array(pos[k] - least[k] + LENGTH)], ["d1", "d2", "start", "stop"])


def _buckets(batches):
    """Rows come sorted by anchor; a block of whole buckets is held at a time."""
    held = None
    for b in batches:
        now = pa.Table.from_batches([b])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows >= _BLOCK:
            heads = held.column("head").to_numpy()
            others = np.flatnonzero(heads != heads[-1])
            if len(others):
                yield from _settled(held.slice(0, int(others[-1]) + 1))
                held = held.slice(int(others[-1]) + 1)
    if held is not None:
        yield from _settled(held)


def _halves(batches):
    """Each suffix in two buckets, of the lower and of the upper half of its steps, named by the bytes that all strings of the half share."""
    for b in batches:
        out = []
        for head, lo, hi, d1, d2, pos, before, raw in zip(*(b.column(c).to_pylist() for c in ("head", "lo", "hi", "d1", "d2", "pos", "before", "around")), strict=True):
            mid = (lo + hi) // 2
            for low, high in ((lo, mid), (mid + 1, hi)):
                if before >= low and len(raw) - before >= LENGTH - high:
                    name = xxhash.xxh3_128_digest(raw[before - low : before + LENGTH - high], head & 0xFFFFFFFF) + bytes([low, high])
                    out.append((xxhash.xxh3_64_intdigest(name, head >> 32 & 0xFFFFFFFF) - (1 << 63), 0, low, high, d1, d2, pos, before, raw))
        fields = [pa.field(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _KIND.split(", ")]
        for at in range(0, len(out), 4000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 4000], strict=True), fields, strict=True)], [f.name for f in fields])


def _cut(batches, most: int = 8 << 20):
    """Of each text: size, what the union of its spans leaves, and that union as runs; some ``most`` bytes at a time."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "kept", "spans"])

    for b in batches:
        out, size = [], 0
        for key, t, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans"), strict=True):
            raw, runs = t.as_buffer().to_pybytes(), []
            for start, stop in sorted((s["start"], s["stop"]) for s in spans.as_py() or ()):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(stop, runs[-1][1])
                else:
                    runs.append([start, stop])
            edges = [0, *(e for run in runs for e in run), len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if runs else raw
            if out and size + len(kept) > most:
                yield batch(out)
                out, size = [], 0
            out.append((key, len(raw), kept, [{"start": a, "stop": z} for a, z in runs]))
            size += len(kept)
        if out:
            yield batch(out)


_HERE = "ledgerloom.llm.suffix_dedup:"
_SPAN = "d1 long, d2 long, start long, stop long"


def _doubled_spans(texts: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """Spans by content key: see the module's text."""
    flat = first.select("row", F.explode("anchors").alias("a")).select("row", F.col("a.pos").alias("pos"), F.col("a.head").alias("head"), F.col("a.around").alias("around"))
    counted = flat.groupBy("head", "around").agg(F.count("*").alias("n"))
    heads = counted.groupBy("head").agg(F.count("*").alias("size"), F.sum("n").alias("total")).filter("total > 1")
    kinds = common.materialize(counted.join(heads, "head").select("head", "around", "n", "size"), "kinds")
    placed = flat.join(kinds, ["head", "around"]).join(first.select("row", "d1", "d2", "n_bytes"), "row")
    shared = common.materialize(placed.select("d1", "d2", "n_bytes", "pos", "head", "around", "n", "size"), "shared")
    common.drop_table(kinds)

    start, stop = F.greatest(F.col("pos") - SIDE, F.lit(0)).cast("long"), F.least(F.col("pos") + LENGTH, F.col("n_bytes")).cast("long")
    settled = shared.filter("n > 1").select("d1", "d2", start.alias("start"), stop.alias("stop")).filter(f"stop - start >= {LENGTH}").distinct()
    alone = shared.filter("n = 1").select("head", "size", "d1", "d2", "pos")
    one = shared.filter("n > 1 and size > 1").groupBy("head", "around").agg(F.min(F.struct("d1", "d2", "pos")).alias("r"), F.first("size").alias("size"))
    wanted = alone.union(one.select("head", "size", "r.d1", "r.d2", "r.pos"))
    by_content = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("head", "size", "pos")).alias("wanted"))
    fetched = common.arrow_map(texts.select("text"), _HERE + "_keyed", "d1 long, d2 long, text string").join(by_content, ["d1", "d2"])
    held = common.materialize(fetched.groupBy("d1", "d2").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted")), "held")

    around = common.arrow_map(held.select("d1", "d2", "text", "wanted"), _HERE + "_surroundings", _KIND)
    found, spent = [settled, _sorted_spans(around.filter(F.col("size") <= most), common.tasks(texts))], [shared, held]
    if wanted.filter(F.col("size") > most).head(1):
        found += _split_spans(around.filter(F.col("size") > most), most, common.tasks(texts), spent)
    out = common.materialize(functools.reduce(DataFrame.union, found), "spans")
    for table in spent:
        common.drop_table(table)
    return out


def _sorted_spans(around: DataFrame, n: int) -> DataFrame:
    return common.arrow_map(around.repartition(n, "head").sortWithinPartitions("head"), _HERE + "_buckets", _SPAN)


def _split_spans(large: DataFrame, most: int, n: int, spent: list) -> list[DataFrame]:
    """Spans of buckets too large for a block: halved by steps until they fit; the strings of a single step are equal."""
    found = []
    for _ in range(SIDE.bit_length() + 1):
        halves = common.materialize(common.arrow_map(large, _HERE + "_halves", _KIND), "halves")
        sizes = halves.groupBy("head").agg(F.count("*").alias("size")).filter("size > 1")
        sized = common.materialize(halves.drop("size").join(sizes, "head").select(*(c.split()[0] for c in _KIND.split(", "))), "sized")
        common.drop_table(halves)
        spent.append(sized)
        found.append(sized.filter("lo = hi").select("d1", "d2", (F.col("pos") - F.col("lo")).alias("start"), (F.col("pos") - F.col("lo") + LENGTH).alias("stop")))
        found.append(_sorted_spans(sized.filter((F.col("size") <= most) & (F.col("lo") < F.col("hi"))), n))
        large = sized.filter((F.col("size") > most) & (F.col("lo") < F.col("hi")))
        if not large.head(1):
            break
    return found


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_most: int = _BUCKET_MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, kept (the bytes that are left) and spans (the runs removed, in order, stop exclusive).

    Every byte covered by a 400-byte string that also starts anywhere else, in any row, is removed; overlaps
    within a text count; strings never cross texts and are judged on the input. A text of which a repeated row
    has a copy goes whole, if it has 400 bytes or more. Null and empty texts, and texts under 400 bytes, lose
    nothing. Null ids stay null. Other columns are not read; an empty table gives an empty one. ``bucket_most``
    bounds what a task sorts at once and never the result. A run may begin or end within a character, so
    ``kept`` need not be UTF-8.
    """
    texts = common.id_text(docs, id_col, text_col)
    described = common.arrow_map(texts, _HERE + "_first", "n_bytes long, d1 long, d2 long, anchors array<struct<pos:int,head:long,around:long>>")
    first = common.materialize(described.withColumn("row", F.monotonically_increasing_id()), "first")
    spans = _doubled_spans(texts, first, bucket_most)
    common.drop_table(first)
    listed = spans.distinct().groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = common.arrow_map(texts, _HERE + "_keyed", "d1 long, d2 long, doc_id long, text string").join(listed, ["d1", "d2"], "left")
    return common.arrow_map(rows.select("doc_id", "text", "spans"), _HERE + "_cut", "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_most: int = _BUCKET_MOST) -> DataFrame:
    """Per row of without_repeats(): doc_id, n_bytes, n_removed, n_spans, kept_sha256, then spans (``start:stop``, comma-joined) and text.

    ``text`` is what is left as a string; of a character cut through, U+FFFD is left.
    """
    cut = without_repeats(docs, id_col, text_col, bucket_most)
    return cut.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("spans"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
