"""Secret scans with corpus-wide ownership frequency.

Fixed patterns give the base spans. They and wider candidates, long mixed runs that no pattern names, are hashed;
over the whole corpus the hashes' distinct repositories and owners are counted. A candidate that one owner alone
has, in few repositories, looks live; one that several owners or many repositories have is a widely copied
example. Wider candidates are added where they look live; base spans stay, and which are copied is told.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common

# Order in which kinds are listed.
KINDS = ("assign", "access", "hex", "live")
_ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WIDE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_SPAN = "array<struct<start:long,end:long,kind:int>>"
_FOUND = "array<struct<start:long,end:long,kind:int,hash:binary>>"
_SCHEMA = f"doc_id long, row long, found {_FOUND}, owner string, base_sha256 string"
_WIDE_KIND = KINDS.index("live")


def _candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of base spans, by start and then kind."""
    found = [(m.start(), m.end(), 0, m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), m.end(), 1, m.start()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m.start()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start and then kind."""
    return [s[:3] for s in _candidates(text)]


def wider_spans(text: str, base: list) -> list[tuple[int, int]]:
    """Runs of 20 or more key characters with lower case, upper case and a digit that no base span touches."""
    out, at, reach = [], 0, 0  # reach: where the spans that start before a run end at most
    for m in _WIDE.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][1])
            at += 1
        run = m.group()
        if reach <= s and run != run.lower() and run != run.upper() and any(map(str.isdigit, run)):
            out.append((s, e))
    return out


def _hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _batches(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("hash", pa.binary())]))
    for b in batches:
        every, digests = [], []
        for t in b.column("text"):
            text = t.as_py()
            base = _candidates(text)
            own = [{"start": s, "end": e, "kind": k, "hash": _hash(text[v:e])} for s, e, k, v in base]
            every.append(own + [{"start": s, "end": e, "kind": _WIDE_KIND, "hash": _hash(text[s:e])} for s, e in wider_spans(text, base)])
            digests.append(hashlib.sha256(joined(s[:3] for s in base).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(every, kind), b.column("owner"), pa.array(digests, pa.string())], ["doc_id", "row", "found", "owner", "base_sha256"])


def _wide(batches):
    """Hashes of wider candidates, once a text."""
    for b in batches:
        rows = []
        for key, own, owner, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_key", "owner", "text")), strict=True):
            rows += [(key, own, owner, h) for h in {_hash(t[s:e]) for s, e in wider_spans(t, _candidates(t))}]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["doc_id", "text_key", "owner", "hash"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = 1, most_repos: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, row, base and added spans (start, end, kind), n_copied, base_sha256.

    A repository is a document id, an owner the value of ``owner_col``. Candidates held by at most
    ``most_owners`` owners in at most ``most_repos`` repositories look live: wider ones are added as kind ``live``.
    n_copied counts the base spans whose value does not look live. Owners and repositories are counted exactly.

    Null and empty texts have no spans. A null owner counts as one owner of its own; null ids count as one
    repository. Repeated rows each give a row. Other columns are not read. An empty table gives an empty one.
    Texts are searched whole. Only hashes and spans are shuffled, never texts; they are counted
    by (hash, owner, document id) first, then by (hash, owner), so no task gathers a candidate in a third of all rows.
    """
    found = common.materialize(common.arrow_map(_rows(docs, id_col, text_col, owner_col), "ledgerloom.llm.secret_scan:_batches", _SCHEMA), "secrets")
    each = found.filter(F.size("found") > 0).select("row", "doc_id", "owner", F.explode("found").alias("f")).select("row", "doc_id", "owner", "f.hash", "f.start", "f.end", "f.kind")
    judged = each.join(_owned(each).select("hash", _copied(most_owners, most_repos).alias("copied")), "hash")
    span = F.struct("start", "end", "kind")
    wide = F.col("kind") == _WIDE_KIND
    added = judged.filter((wide & ~F.col("copied")) | (~wide & F.col("copied"))).groupBy("row").agg(F.sort_array(F.collect_list(F.when(wide, span))).alias("added"), F.count(F.when(~wide, 1)).alias("n_copied"))
    base = F.transform(F.filter("found", lambda f: f["kind"] != _WIDE_KIND), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind")))
    none = F.expr(f"cast(array() as {_SPAN})")
    return found.select("doc_id", "row", base.alias("base"), "base_sha256").join(added, "row", "left").withColumn("added", F.coalesce("added", none)).withColumn("n_copied", F.coalesce("n_copied", F.lit(0)))


def _owned(each: DataFrame) -> DataFrame:
    """(hash, owners, repos, seen) over rows of (doc_id, owner, hash)."""
    by_repo = each.groupBy("hash", "owner", "doc_id").agg(F.count("*").alias("seen"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("seen").alias("seen"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("seen").alias("seen"))


def _copied(most_owners: int, most_repos: int):
    return (F.col("owners") > most_owners) | (F.col("repos") > most_repos)


def _rows(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    text, owner = (F.col(c).cast("string") for c in (text_col, owner_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(owner, F.lit("\0none")).alias("owner")).withColumn("text_key", F.xxhash64("text"))


def ownership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = 1, most_repos: int = 10) -> DataFrame:
    """One row per distinct candidate, base or wider: hash, owners, repos, seen, widely_copied."""
    found = common.arrow_map(_rows(docs, id_col, text_col, owner_col), "ledgerloom.llm.secret_scan:_batches", _SCHEMA)
    return _owned(found.select("doc_id", "owner", F.explode("found.hash").alias("hash"))).withColumn("widely_copied", _copied(most_owners, most_repos))


def _text_of(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def digest(docs: DataFrame, **columns) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_copied (see scan() for the edge cases)."""
    found = scan(docs, **columns)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    spans = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", _text_of(spans).alias("spans"), F.size("added").cast("long").alias("n_added"), F.col("n_copied").cast("long").alias("n_copied"))


def _redact(batches, mark: str):
    for b in batches:
        texts = []
        for t, live in zip(b.column("text"), b.column("live").to_pylist(), strict=True):
            text, out, at = t.as_py(), [], 0
            spans = base_spans(text)
            if live:
                live = set(live)
                spans = sorted(spans + [(s, e, 3) for s, e in wider_spans(text, spans) if _hash(text[s:e]) in live])
            for s, e, _ in spans:
                if s >= at:
                    out += [text[at:s], mark]
                at = max(at, e)
            texts.append("".join(out) + text[at:] if spans else text)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column("kept")], ["text", "kept"])


def redact(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = 1, most_repos: int = 10) -> DataFrame:
    """``docs`` with every span of scan(), base and added, replaced by ``mark``; overlapping spans give one mark.

    Columns and their order stay; a null text stays null; ``n_chars``, where it is a column, follows the text.
    Edge cases as in scan().
    """
    found = common.arrow_map(_rows(docs, id_col, text_col, owner_col), "ledgerloom.llm.secret_scan:_wide", "doc_id long, text_key long, owner string, hash binary")
    wide = common.materialize(found, "candidates")
    live = _owned(wide).filter(~_copied(most_owners, most_repos)).select("hash")
    of_text = wide.join(live, "hash", "left_semi").groupBy("text_key").agg(F.collect_set("hash").alias("live")).withColumnRenamed("text_key", "live_key")  # at most a text's own candidates
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*docs.columns).alias("kept"))
    both = rows.join(of_text, F.xxhash64("text") == F.col("live_key"), "left").select("text", "live", "kept")
    kind = rows.schema["kept"].dataType.simpleString()
    out = common.arrow_map(both, "ledgerloom.llm.secret_scan:_redact", f"text string, kept {kind}", mark=mark)
    text = F.when(F.col(f"kept.{text_col}").isNotNull(), F.col("text"))
    new = {text_col: text} | ({"n_chars": F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("kept.n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns))
