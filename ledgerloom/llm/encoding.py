"""Token ids of whole texts through the tokenizers library, a unit at a time with a per-worker store."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

from ledgerloom.llm import common, pretoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
# Units kept in a worker; about 200 bytes each.
_KEPT_MOST = 1_000_000
# Letters and a tail of ASCII punctuation: always two pretokens.
_TAILED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)\Z")


class Encoder:
    """Little-endian uint32 ids of texts as bytes, equal to the library's over the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {"": b""}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        """Words of letters alone are one pretoken each: a whole line of them is encoded at once and cut by word."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            e = self.tool.encode(" " + " ".join(some), add_special_tokens=False)
            ids, of = np.array(e.ids, "<u4"), np.array(e.word_ids)
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            if len(cuts) + 1 != len(some):
                self.kept.update(zip(some, self._raw([" " + w for w in some]), strict=True))
                continue
            raw, edges = ids.tobytes(), [0, *(4 * cuts).tolist(), 4 * len(ids)]
            self.kept.update((w, raw[a:b]) for w, a, b in zip(some, edges, edges[1:], strict=False))

    def _learn(self, new: dict) -> None:
        kept, words, tails, tailed, rest = self.kept, {}, {}, [], []
        for u in new:
            if u.isalpha():
                words[u] = None
            elif m := _TAILED.match(u):
                stem, tail = m.groups()
                tailed.append((u, stem, tail))
                if stem not in kept:
                    words[stem] = None
                if tail not in self.tails:
                    tails[tail] = None
            else:
                rest.append(u)
        self._words(list(words))
        self.tails.update(zip(tails, self._raw(list(tails)), strict=True))
        kept.update((u, kept[stem] + self.tails[tail]) for u, stem, tail in tailed)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            kept.update(zip(some, self._raw([" " + u for u in some]), strict=True))
        if len(self.tails) > 50_000:
            self.tails.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """A batch's ids. Texts with special strings go to the library whole; others in units."""
        if len(self.kept) > _KEPT_MOST:
            self.kept.clear()
        get = self.kept.get
        out: list = [None] * len(texts)
        cut, new, heads = {}, {}, {}
        if len(self.heads) > 100_000:
            self.heads = {"": b""}
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[k] = self._raw([text])[0]
                continue
            cut[k] = []
            for first, part in pretoken.slices(text):
                found, head = pretoken.units(part), ""
                if first:
                    head, found = found[0], found[1:]
                    if head not in self.heads:
                        heads[head] = None
                values = list(map(get, found))
                missing = [(i, found[i]) for i, v in enumerate(values) if v is None]
                new.update(dict.fromkeys(u for _, u in missing))
                cut[k].append((head, values, missing))
        if new:
            self._learn(new)
        self.heads.update(zip(heads, self._raw(list(heads)), strict=True))
        kept, known = self.kept, self.heads
        for k, parts in cut.items():
            for _, values, missing in parts:
                for i, u in missing:
                    values[i] = kept[u]
            out[k] = b"".join([known[head] + b"".join(values) for head, values, _ in parts])
        for u in new:
            if len(u) > 64:
                kept.pop(u, None)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, with what it has encoded before."""
    common.claim("encoding", _encoder.cache_clear)
    return _encoder(path)
