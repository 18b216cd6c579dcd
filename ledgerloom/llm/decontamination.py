"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some positions of a window of words and ignore the rest. Hashes of the masked benchmark
windows are joined with those of every training window in the worker, where a bit table of a block of bounded size lets
almost all training windows pass by; around each hit the texts are compared word by word without gaps, so
substituted words do not hide a passage.
"""

from __future__ import annotations

import functools
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common, shingles

# Sets of masks, heaviest first; positions with 0 are ignored (fixed values). The first hits all that 75 per cent of
# 7 to 13 words can mean, see masks_for().
MASK_SETS = (("10111", "111001", "10001011"), ("111",), ("11",), ("1",))
_TABLE_BITS, _HITS_AT_ONCE = 24, 1 << 20


def hiding(masks: tuple[str, ...], words: int) -> int:
    """The least number of differing words that hides every mask from a window of so many words; words + 1 where none can."""
    span = max(map(len, masks))
    seen = [(len(m), int(m, 2)) for m in masks]
    cost = {0: 0}  # places of differing words among the last ones, newest lowest -> their least number so far
    for n in range(1, words + 1):
        now: dict[int, int] = {}
        for state, c in cost.items():
            for differs in (0, 1):
                new = (state << 1 | differs) & ((1 << span) - 1)
                if all(n < size or new & bits for size, bits in seen):
                    now[new] = min(c + differs, now.get(new, words + 1))
        cost = now
    return min(cost.values(), default=words + 1)


def masks_for(least: int, percent: int, shortest: int = 7) -> tuple[str, ...]:
    """The heaviest set that shares a seed with every overlap of the rule of contaminated(), whichever words differ."""
    if percent < 1:
        raise ValueError("overlaps without an equal word share no seed")
    for masks in MASK_SETS:
        if all(hiding(masks, n) > n - -(-percent * n // 100) for n in range(max(1, min(shortest, least)), least + 1)):
            return masks
    raise ValueError("no mask set is lossless for this rule")


def masked_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of the mask's length over its 1-positions."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return common.mix64(out)


class Seeds:
    """Seeds of a block of benchmark items: sorted hashes, the item and word position of each, and a bit table."""

    def __init__(self, items: list[tuple[int, str]], least: int, percent: int, shortest: int = 7):
        self.least, self.percent, self.masks = least, percent, masks_for(least, percent, shortest)
        self.ids = [i for i, _ in items]
        self.words = [shingles.word_hashes((t or "").encode("utf-8", "surrogatepass"))[0] for _, t in items]
        hashes, owner, place = [], [], []
        for k, w in enumerate(self.words):
            for mask in self.masks if len(w) >= shortest else ():
                h = masked_hashes(w, mask)
                hashes.append(h)
                owner.append(np.full(len(h), k, np.int32))
                place.append(np.arange(len(h), dtype=np.int32))
        joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.hashes = joined[order]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int32))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int32))[order]
        self.shift = np.uint64(64 - max(_TABLE_BITS, (8 * len(self.hashes)).bit_length()))  # at most an eighth of the bits is set
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.hashes >> self.shift).astype(np.int64)] = True

    def touched(self, words: np.ndarray, at: np.ndarray) -> list[int]:
        """Numbers of the texts, of words one after another with offsets ``at``, that may hold a seed."""
        found = []
        for mask in self.masks:
            h = masked_hashes(words, mask)
            k = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, h[k]), max(len(self.hashes) - 1, 0))
            found.append(k[self.hashes[place] == h[k]] if len(self.hashes) else k[:0])
        return np.unique(np.searchsorted(at, np.concatenate(found), "right") - 1).tolist()

    def hits(self, words: np.ndarray):
        """Distinct rows of item and of text position less item position, some at a time: a phrase that both repeat is never paired whole."""
        for mask in self.masks:
            h = masked_hashes(words, mask)
            at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            edges = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + _HITS_AT_ONCE, _HITS_AT_ONCE))
            for a, b in itertools.pairwise([*edges.tolist(), len(at)]):
                own = count[a:b]
                k = np.repeat(lo[a:b] - np.cumsum(own) + own, own) + np.arange(own.sum())
                yield np.unique(np.stack([self.owner[k], np.repeat(at[a:b], own) - self.place[k]], 1), axis=0)

    def passages(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first text word, words, equal words) of each verified overlap; see contaminated() for the rule."""
        out, tested = [], set()
        for k, shift in itertools.chain.from_iterable(part.tolist() for part in self.hits(words)):
            if (k, shift) in tested:
                continue
            tested.add((k, shift))
            item = self.words[k]
            a, b = max(0, shift), min(len(words), shift + len(item))
            need = min(self.least, len(item))
            if b - a < need:
                continue
            same = words[a:b] == item[a - shift : b - shift]
            total = np.concatenate([[0], np.cumsum(same)])
            good = np.flatnonzero(100 * (total[need:] - total[:-need]) >= self.percent * need)
            if len(good):
                first, last = int(good[0]), int(good[-1]) + need
                out.append((self.ids[k], a + first, last - first, int(total[last] - total[first])))
        return out


_kept: dict[str, Seeds] = {}


def _forget() -> None:
    _kept.clear()
    shingles.forget()


def _seeds(key: str, items: list, least: int, percent: int, shortest: int) -> Seeds:
    """The worker's seeds of a block, made once for all its tasks; one block is kept at a time."""
    common.claim("seeds", _forget)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Seeds(items, least, percent, shortest)
    return _kept[key]


_SCHEMA = "doc_id long, n_passages int, passages array<struct<item_id:long,first_word:long,words:long,same:long>>, digest string"


def _found(texts: list[str], seeds: Seeds) -> dict[int, list]:
    """Passages of the texts that have any, by the text's number."""
    words, at = shingles.words_of(texts)
    found = ((k, seeds.passages(words[at[k] : at[k + 1]])) for k in seeds.touched(words, at))
    return {k: sorted(p, key=lambda f: (f[0] is None, f)) for k, p in found if p}


def _search(batches, key: str, items: list, least: int, percent: int, shortest: int):
    seeds = _seeds(key, items, least, percent, shortest)
    names = ("item_id", "first_word", "words", "same")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in names]))
    for b in batches:
        at, picked, rows = 0, [], []
        for _, texts in common.text_slices(b, 1 << 20):
            for k, found in _found(texts, seeds).items():
                picked.append(at + k)
                rows.append([dict(zip(names, f, strict=True)) for f in found])
            at += len(texts)
        own = b.take(pa.array(picked, pa.int64()))
        yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(list(map(len, rows)), pa.int32()), pa.array(rows, kind), own.column("digest")], ["doc_id", "n_passages", "passages", "digest"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int):
    """Benchmark items in blocks of about ``most`` characters, one block at the driver at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if held and size + len(row["text"] or "") > most:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, percent: int = 75, shortest: int = 7, block_chars: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated row of ``docs``: doc_id, n_passages, passages, these by item, null items last.

    An overlap counts when, at one alignment without gaps, some window of ``least`` words (the whole item, if
    shorter) has at least ``percent`` in a hundred equal words; it reaches from the first such window to the
    last. Words are lower-cased A-Z and split at ASCII white space. The masks are chosen so that every such overlap
    holds a seed, whichever words differ. Items of fewer than ``shortest`` words are no evidence, so they are part of
    no overlap; with a smaller ``shortest`` lighter masks find those too.

    The benchmark is taken in blocks of ``block_chars`` characters, one at a time at the driver and in the tasks; a
    larger benchmark costs more passes over the documents. A character of a block takes some ten bytes of a worker
    (three seeds of 16 bytes a word), so 160 MB by default, and its seeds are made once a worker. What each pass has found is written to the shared
    folder, and that alone is shuffled then, to make one row of a document's parts; rows of the same id and text
    have the same parts. Null and empty texts, on either side, match nothing; null ids are reported as null;
    repeated rows each give a row; an empty table on either side gives an empty one. Other columns are not read.
    Texts are searched whole. One block takes no shuffle.
    """
    return _contaminated(docs, benchmark, least, percent, shortest, block_chars, id_col, text_col, item_col, item_text_col).drop("digest")


def _contaminated(docs, benchmark, least, percent, shortest, block_chars, id_col, text_col, item_col, item_text_col) -> DataFrame:
    """contaminated() with the texts' MD5 as ``digest``."""
    texts = common.id_text(docs, id_col, text_col).withColumn("digest", F.md5("text"))
    search = lambda items: common.arrow_map(texts, "ledgerloom.llm.decontamination:_search", _SCHEMA, key=uuid.uuid4().hex, items=items, least=least, percent=percent, shortest=shortest)
    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return search(first) if first else docs.sparkSession.createDataFrame([], _SCHEMA)
    return _merged([common.materialize(search(items), "passages") for items in itertools.chain([first, second], blocks)])


def _merged(parts: list[DataFrame]) -> DataFrame:
    """One row per row found in any of the parts: equal rows are counted in each part, which has all of them or none."""
    found = functools.reduce(DataFrame.union, (part.withColumn("part", F.lit(i)) for i, part in enumerate(parts)))
    once = found.groupBy("doc_id", "digest", "part").agg(F.count("*").alias("copies"), F.first("passages").alias("passages"))
    whole = once.groupBy("doc_id", "digest").agg(F.first("copies").alias("copies"), F.flatten(F.collect_list("passages")).alias("all"))
    keyed = F.array_sort(F.transform("all", lambda p: F.struct(p["item_id"].isNull().alias("unnamed"), p.alias("p"))))
    rows = whole.select("doc_id", "digest", F.transform(keyed, lambda s: s["p"]).alias("passages"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("doc_id", F.size("passages").alias("n_passages"), "passages", "digest")


def _drop(batches, key: str, items: list, least: int, percent: int, shortest: int):
    seeds = _seeds(key, items, least, percent, shortest)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            bad = _found(part.column("text").to_pylist(), seeds)
            yield part.filter(pa.array([k not in bad for k in range(part.num_rows)], pa.bool_()))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, percent: int = 75, shortest: int = 7, block_chars: int = 16 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows contaminated() would report; columns stay. Edge cases as there.

    With one block of the benchmark there is no shuffle; with more, the found texts' digests are joined.
    """
    blocks = list(itertools.islice(_blocks(benchmark, item_col, item_text_col, block_chars), 2))
    if not blocks:
        return docs
    if len(blocks) == 1:
        inner = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*docs.columns).alias("kept"))
        kind = inner.schema["kept"].dataType.simpleString()
        kept = common.arrow_map(inner, "ledgerloom.llm.decontamination:_drop", f"text string, kept {kind}", key=uuid.uuid4().hex, items=blocks[0], least=least, percent=percent, shortest=shortest)
        return kept.select("kept.*")
    ids = docs.withColumn("_id", F.lit(None).cast("long"))
    found = _contaminated(ids, benchmark, least, percent, shortest, block_chars, "_id", text_col, item_col, item_text_col)
    bad = found.select(F.col("digest").alias("_digest")).distinct()
    return docs.join(bad, F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_digest"), "left_anti")
