"""Near-duplicate groups by HyperMinHash.

A text's shingle hashes fall into buckets; of each bucket's least value only the number of leading zeros and
some mantissa bits are kept. Empty buckets borrow from a filled one, chosen by fixed pair priorities, so small
sets match as often as their similarity says. Bands of registers give candidates, a collision-corrected
estimate thins them out, and full sets confirm what is left.

No group is ever gathered or paired with itself: equal sets are one class; in each band every class is compared
with the band's least and greatest class only; components of confirmed links are contracted. Then only the classes
outside a band's largest component are compared further, in blocks of bounded size, with what is not in theirs;
a block contracts as it goes and returns links that join components, never all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common, components, shingles

REGISTERS, ROWS = 360, 6
BANDS = REGISTERS // ROWS
_PRIORITY = (common.mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32).reshape(REGISTERS, REGISTERS)
_FACTORS = common.mix64(np.arange(7, 7 + REGISTERS, dtype=np.uint64)) | np.uint64(1)
_BAND_SALT = common.mix64(np.arange(1000, 1000 + BANDS, dtype=np.uint64))
# Chance that registers of unrelated sets agree: sum over l of 4**-(l+1), times 2**-10.
_COLLISION = 2.0**-10 / 3
# Least estimate that goes to verification; 0.75 lies over four standard errors above it.
_LEAST_ESTIMATE = 0.6
_BLOCK = 2048
# Largest set that a block of a crowded band holds as a whole; pairs with a larger one are verified outside. Results are the same.
_WHOLE = 2048


def sketch(found: np.ndarray) -> np.ndarray:
    """Registers of a set of ascending uint64 hashes: leading zeros << 10 | mantissa, reversed so that more zeros are less."""
    bucket = ((found >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(REGISTERS)) != 0)
    at = bucket[first].astype(np.int64)
    rest = found[first] * np.uint64(REGISTERS)  # what of the product is below the bucket's number
    bits = np.maximum(rest >> np.uint64(11), np.uint64(1)).astype(np.float64).view(np.uint64)
    code = ((bits >> np.uint64(42)) - np.uint64(1023 << 10)).astype(np.uint16)
    out = np.zeros(REGISTERS, np.uint16)
    out[at] = code
    if len(at) < REGISTERS:
        empty = np.ones(REGISTERS, bool)
        empty[at] = False
        empty = np.flatnonzero(empty)
        out[empty] = code[_PRIORITY[empty][:, at].argmin(1)]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    mixed = common.mix64((sketches.astype(np.uint64) + np.uint64(1)) * _FACTORS)
    return common.mix64(mixed.reshape(len(sketches), BANDS, ROWS).sum(2, dtype=np.uint64) + _BAND_SALT)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches, row by row or one to each of many, corrected for chance agreement."""
    return ((many == one).mean(-1) - _COLLISION) / (1 - _COLLISION)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b| for ascending distinct arrays."""
    common_size = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common_size >= percent * (len(a) + len(b) - common_size)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sketches(batches, words: int):
    common.claim("shingles", shingles.forget)
    for b in batches:
        at = 0
        for ids, texts in common.text_slices(b):
            own, at = b.column("text_key").slice(at, len(ids)), at + len(ids)
            sizes, keys, regs = [], [], []
            for s in shingles.shingle_sets(texts, words):
                sizes.append(len(s))
                keys.append(_digest(s))
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), own, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "text_key", "n_shingles", "digest", "sketch"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches):
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            keys = band_keys(_matrix(part.column("sketch")))
            cls = np.repeat(part.column("cls").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(cls)], ["band", "cls"])


def _matching(batches, words: int):
    """Texts whose own set is the class's; only rows whose ids and text hashes both agree could bring others."""
    common.claim("shingles", shingles.forget)
    for b in batches:
        sets = shingles.shingle_sets(b.column("text").to_pylist(), words)
        keep = [_digest(s) == d for s, d in zip(sets, b.column("digest").to_pylist(), strict=True)]
        yield b.filter(pa.array(keep, pa.bool_())).select(["cls", "sketch", "text"])


def _close(batches):
    """Pairs whose estimate lets them go on to verification."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            est = estimate(_matrix(part.column("sketch_a")), _matrix(part.column("sketch_b")))
            yield part.filter(pa.array(est >= _LEAST_ESTIMATE)).select(["a", "b"])


def _verify(batches, words: int, percent: int):
    common.claim("shingles", shingles.forget)
    for b in batches:
        kept, sets = [], {}
        for a, ta, tb in zip(b.column("a").to_pylist(), b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
            if a not in sets:
                sets = {a: next(shingles.shingle_sets([ta], words))}  # rows of one class tend to follow each other
            kept.append(linked(sets[a], next(shingles.shingle_sets([tb], words)), percent))
        yield b.filter(pa.array(kept, pa.bool_())).select(["a", "b"])


def _sets(batches, words: int):
    """For crowded bands: the set's size, and the whole set up to _WHOLE shingles."""
    common.claim("shingles", shingles.forget)
    for b in batches:
        sets = list(shingles.shingle_sets(b.column("text").to_pylist(), words))
        yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("sketch"), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() if len(s) <= _WHOLE else None for s in sets], pa.binary())], ["cls", "sketch", "size", "whole"])


def _across(table: pa.Table, percent: int) -> pa.Table:
    """Links within a block of a band that join components, and pairs with a large set that look similar enough.

    Each class of the left side is asked for the right side's classes of other components that are near enough by
    size and by sketch; whole sets decide at once, and the two components count as one from then on.
    """
    cls, comp, left, size = (table.column(c).to_numpy() for c in ("cls", "comp", "left", "size"))
    sketches = _matrix(table.column("sketch"))
    sets = [None if v is None else np.frombuffer(v, np.uint64) for v in table.column("whole").to_pylist()]
    label = np.unique(comp, return_inverse=True)[1]
    right = np.ones(len(cls), bool) if left.all() else ~left
    out = []
    for x in np.flatnonzero(left).tolist():
        y = np.flatnonzero(right & (label != label[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])))
        if not len(y):
            continue
        for z in y[estimate(sketches[x], sketches[y]) >= _LEAST_ESTIMATE].tolist():
            sure = sets[x] is not None and sets[z] is not None
            if label[z] == label[x] or sure and not linked(sets[x], sets[z], percent):
                continue
            out.append((min(cls[x], cls[z]), max(cls[x], cls[z]), sure))
            if sure:
                label[label == label[z]] = label[x]
    a, b, sure = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})


def _confirmed(pairs: DataFrame, full: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those that are linked: sketches travel first, texts only to the pairs that look similar enough."""
    side = lambda k, c: full.select(F.col("cls").alias(k), F.col(c).alias(f"{c}_{k}"))
    both = pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").select("a", "b", "sketch_a", "sketch_b")
    close = common.arrow_map(both, "ledgerloom.llm.hyperminhash:_close", "a long, b long")
    texts = close.join(side("b", "text"), "b").join(side("a", "text"), "a").select("a", "b", "text_a", "text_b")
    return common.materialize(common.arrow_map(texts, "ledgerloom.llm.hyperminhash:_verify", "a long, b long", words=words, percent=percent), "links")


def _scattered(number):
    """Distinct numbers for distinct numbers, in no order: one xorshift step (fixed values)."""
    for shift, left in ((13, True), (7, False), (17, True)):
        number = number.bitwiseXOR(F.shiftleft(number, shift) if left else F.shiftrightunsigned(number, shift))
    return number


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two texts are linked when 100 * |A & B| >= percent * |A | B| over their distinct shingles of ``words``
    words; component_id is the least id reachable over links, kept tells whether it is the row's own.

    Null and empty texts, or such without words, have no shingles, are linked with nothing and are kept. With
    fewer words than ``words`` the whole sequence is one shingle. Null ids take part like others; a component
    of null ids alone has a null component_id and keeps none. Repeated rows each give a row. Other columns are
    not read; an empty table gives an empty one; texts are read whole. A link at exactly the threshold shares
    no band, and is missed, with a chance of 8 in a million, less above it; bands and thresholds are made for
    75 per cent and more, so a smaller ``percent`` is refused.
    """
    out = _grouped(docs, words, percent, id_col, text_col)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _row_key():
    """Orders rows by id, null ids last, and then by text."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")


def _grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """For near_duplicates(): doc_id, text_key, n_shingles, and of the component its least id and the row key of its first row."""
    if percent < 75:
        raise ValueError("bands and estimates are made for 75 per cent or more")
    texts = common.id_text(docs, id_col, text_col)
    sketched = common.materialize(common.arrow_map(texts.withColumn("text_key", _text_key("text")), "ledgerloom.llm.hyperminhash:_sketches", "doc_id long, text_key long, n_shingles long, digest binary, sketch binary", words=words), "sketched")
    members = common.materialize(sketched.select("doc_id", "text_key", "n_shingles", "digest"), "members")
    grouped = sketched.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.min(_row_key()).alias("best"), F.first("sketch").alias("sketch"))
    classes = common.materialize(grouped.withColumn("cls", _scattered(F.monotonically_increasing_id())).select("cls", "digest", "least_id", "best", "sketch"), "classes")
    common.drop_table(sketched)

    bands = common.arrow_map(classes.select("cls", "sketch"), "ledgerloom.llm.hyperminhash:_bands", "band long, cls long")
    ends = bands.groupBy("band").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    shared = common.materialize(bands.join(ends, "band"), "shared")
    star = shared.select(F.explode(F.array(F.struct(F.least("cls", "lo").alias("a"), F.greatest("cls", "lo").alias("b")), F.struct(F.least("cls", "hi").alias("a"), F.greatest("cls", "hi").alias("b")))).alias("p")).select("p.a", "p.b").filter("a <> b").distinct()
    pairs = common.materialize(star, "pairs")

    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(classes, "cls").select("cls", "digest", "sketch", "best")
    fetched = _texts_of(wanted, texts)
    own = common.arrow_map(fetched, "ledgerloom.llm.hyperminhash:_matching", "cls long, sketch binary, text string", words=words)
    full = common.materialize(own.dropDuplicates(["cls"]), "full")

    links = _confirmed(pairs, full, words, percent)
    comps = components.components(links)
    spent = [shared, pairs, full, links]
    rest = _rest(shared, full, comps, words, percent)
    if rest is not None:
        unsure = rest.filter("not sure").select("a", "b").join(pairs, ["a", "b"], "left_anti")
        more = _confirmed(unsure, full, words, percent)
        comps = components.components(links.union(rest.filter("sure").select("a", "b")).union(more))
        spent += [rest, more]
    for table in spent:
        common.drop_table(table)

    named = classes.select("cls", "digest", "least_id", "best").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.min("best").alias("best"))
    of_digest = named.select("comp", "digest").join(least, "comp").select("digest", "component_id", "best")
    empty = members.filter("n_shingles = 0")  # these all have one digest
    return members.filter("n_shingles > 0").join(of_digest, "digest", "left").unionByName(empty, allowMissingColumns=True)


def _texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(cls, digest, sketch, text) of the row that stands for each class: found by id and text, so that rows that share
    an id, or have none, bring their own text alone. Copies of one row with the same id come once each."""
    mark = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    named = wanted.select("cls", "digest", "sketch", mark(F.col("best.doc_id")).alias("key"), F.col("best.text_key").alias("text_key"))
    return texts.select(mark(F.col("doc_id")).alias("key"), _text_key("text").alias("text_key"), "text").join(named, ["key", "text_key"]).select("cls", "digest", "sketch", "text")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near_duplicates(): of the least id, null ids being last.

    Of several texts under that id one is kept, always the same, and of rows repeated with id and text any one.
    Rows without shingles all stay. Rows are told apart by id and a 64-bit hash of the text.
    """
    found = _grouped(docs, words, percent, id_col, text_col).filter("n_shingles > 0").select("doc_id", "text_key", (_row_key() == F.col("best")).alias("first"))
    named = lambda rows: rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (_text_key(text_col) == F.col("_text"))
    gone = named(found.filter("not first")).distinct()
    again = common.materialize(named(found.filter("first").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1")), "again")
    kept = docs.join(gone, same, "left_anti")
    if not again.head(1):
        return kept
    several = docs.join(again, same, "left_semi").withColumn("_text", _text_key(text_col))
    return kept.join(again, same, "left_anti").unionByName(several.dropDuplicates([id_col, "_text"]).drop("_text"))


def _rest(shared: DataFrame, full: DataFrame, comps: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(a, b, sure) of classes that share a band and lie in different components: see _across().

    In a band, the k classes outside its largest component meet each other and the n - k others: of a class, as many rows
    as there are blocks of the side it meets. So a band of one large group costs n rows, whatever its size.
    """
    crowded = shared.filter("n > 3").select("band", "cls", "n")  # up to three classes, all pairs hold the least or the greatest
    placed = common.materialize(crowded.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "placed")
    counted = placed.groupBy("band", "comp").agg(F.count("*").alias("own"))
    mixed = counted.groupBy("band").agg(F.max(F.struct("own", "comp")).alias("most"), F.sum("own").alias("all")).filter("all > most.own")
    blocks = lambda n: F.ceil(n / _BLOCK).cast("long")
    sized = mixed.select("band", F.col("most.comp").alias("most"), blocks(F.col("all") - F.col("most.own")).alias("few"), blocks(F.col("most.own")).alias("many"))
    open_ = common.materialize(placed.join(sized, "band").withColumn("outside", F.col("comp") != F.col("most")), "open")
    common.drop_table(placed)
    if not open_.head(1):
        common.drop_table(open_)
        return None
    sets = common.arrow_map(full.join(open_.select("cls").distinct(), "cls", "left_semi").select("cls", "sketch", "text"), "ledgerloom.llm.hyperminhash:_sets", "cls long, sketch binary, size long, whole binary", words=words)
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("outside"), F.col("few")).otherwise(F.col("many")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), left.alias("left"))
    # blocks of the largest component are numbered below zero
    among = F.transform(upto(F.col("few")), lambda k: place(F.least("own", k), F.greatest("own", k), F.col("own") <= k))
    met = F.transform(upto(F.col("many")), lambda k: place(F.col("own"), -1 - k, F.lit(True)))
    asked = F.transform(upto(F.col("few")), lambda k: place(k, -1 - F.col("own"), F.lit(False)))
    dealt = open_.withColumn("own", own).select("band", "cls", "comp", F.explode(F.when(F.col("outside"), F.concat(among, met)).otherwise(asked)).alias("p"))
    keyed = dealt.join(sets, "cls").select("band", "p.i", "p.j", "p.left", "cls", "comp", "sketch", "size", "whole")
    found = common.arrow_groups(keyed.groupBy("band", "i", "j"), "ledgerloom.llm.hyperminhash:_across", "a long, b long, sure boolean", percent=percent).distinct()
    out = common.materialize(found, "rest")
    common.drop_table(open_)
    return out
