"""Token counts by heap-and-linked-list byte-pair merging: no identifiers are made, only merges counted."""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm import common, pretoken

# Entries of each cache in a worker; at about 100 bytes each
_CACHE_MOST = 1_200_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in table)
    return [s for _, s in sorted((table | {b: chr(256 + i) for i, b in enumerate(rest)}).items())]


class MergeCounter:
    """Counts tokens of texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer or prefix space is counted here")
        vocab, stand_in = model["vocab"], byte_symbols()
        self.start = [vocab[s] for s in stand_in]
        # A pair is left << 32 | right. Of each rank: its pair and the id it makes.
        self.rank_of, self.pair_at, self.made_at = {}, [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[a] << 32 | vocab[b]
            self.rank_of.setdefault(key, len(self.pair_at))
            self.pair_at.append(key)
            self.made_at.append(vocab[a + b])
        self.special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.words: dict[str, int] = {}
        self.cache: dict[str, int] = {}

    def merges(self, word: bytes) -> int:
        """Merges done on a pretoken: pop the lowest-ranked adjacent pair, the leftmost of equals, until none is left."""
        n = len(word)
        if n < 2:
            return 0
        start, rank_of, pair_at, made_at = self.start, self.rank_of.get, self.pair_at, self.made_at
        ids = [start[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []  # rank << 40 | position
        for i in range(n - 1):
            if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None:
                heap.append(rank << 40 | i)
        heapify(heap)
        done = 0
        while heap:
            top = heappop(heap)
            rank, i = top >> 40, top & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or ids[i] << 32 | ids[j] != pair_at[rank]:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = made_at[rank], -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (rank := rank_of(ids[i] << 32 | ids[k])) is not None:
                    heappush(heap, rank << 40 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(ids[h] << 32 | ids[i])) is not None:
                heappush(heap, rank << 40 | h)
        return done

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            raw = word.encode()
            n = len(raw) - self.merges(raw)
            if len(word) <= 64:
                if len(self.words) >= _CACHE_MOST:
                    self.words.clear()
                self.words[word] = n
        return n

    def unit(self, unit: str) -> int:
        return sum(map(self.word, pretoken.PATTERN.findall(unit)))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, get, cache = 0, self.cache.get, self.cache
        for first, part in pretoken.slices(text):
            pieces = pretoken.units(part)
            if first:
                total += self.unit(pieces[0])
                pieces = pieces[1:]
            counts = list(map(get, pieces))
            if None in counts:
                for i, n in enumerate(counts):
                    if n is None:
                        counts[i] = n = self.unit(" " + pieces[i])
                        if len(pieces[i]) <= 64:
                            cache[pieces[i]] = n
                if len(cache) > _CACHE_MOST:
                    cache.clear()
            total += sum(counts)
        return total

    def count(self, text: str) -> int:
        for s in self.special:
            if s in text:
                head, _, tail = text.partition(s)
                return self.count(head) + 1 + self.count(tail) if len(self.special) > 1 else sum(map(self.plain, filter(None, text.split(s)))) + text.count(s)
        return self.plain(text) if text else 0


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def _batches(batches, path: str, limit: int):
    common.claim("token_count", counter.cache_clear)
    tool = counter(path)
    for b in batches:
        ids, sizes, counts = b.column("doc_id"), [], []
        for t in b.column("text"):
            s = t.as_py()
            sizes.append(t.as_buffer().size)
            counts.append(tool.count(s))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts: no bytes, no tokens. A null id stays null. Repeated rows each give a row. Other
    columns are not read. An empty table gives an empty one. A text of any length is counted whole, in slices;
    special strings inside a text count as one token each, as the library has it. No shuffle.
    """
    return common.arrow_map(common.id_text(docs, id_col, text_col), "ledgerloom.llm.token_count:_batches", "doc_id long, n_bytes long, n_tokens long, over_limit boolean", path=path, limit=limit)
