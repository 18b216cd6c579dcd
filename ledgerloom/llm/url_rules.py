"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed end to end into the bits of a few 64-bit words (multiword Shift-And). Reading one
character of every URL of a batch moves all rules on at once:

    D = ((D << 1 | starts) & accepts[char]) | (D & loops[char])

``accepts`` has a bit for each position a character may fill, ``loops`` for each position whose following
wildcard may swallow it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common


@dataclass(frozen=True)
class Rule:
    """verdict for urls that fit ``text``: a host and path prefix (``com/en/``), or with ``glob`` a wildcard
    pattern over ``.host/path`` in which ``*`` stands for any run without ``/``, ``**`` for any run, ``?`` for one character.
    """

    verdict: str
    text: str
    glob: bool = False

    @property
    def pattern(self) -> str:
        if self.glob:
            return self.text
        host, slash, path = self.text.partition("/")
        return f"*.{host}{slash}{path}**"


class Automaton:
    """Shift-And masks of many globs, simulated over whole batches."""

    def __init__(self, patterns: Sequence[str]):
        cells: list[list[tuple[object, bool, bool]]] = []  # of each pattern: (byte or any, loops without slash, loops with slash)
        for p in patterns:
            raw, own, i, lead = p.encode(), [], 0, (False, False)
            state = [[None, *lead]]  # the state before any character
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    state[-1][1] = state[-1][2] = True
                    i += 2
                elif raw[i : i + 1] == b"*":
                    state[-1][1] = True
                    i += 1
                else:
                    state.append([-1 if raw[i : i + 1] == b"?" else raw[i], False, False])
                    i += 1
            own = [tuple(x) for x in state]
            cells.append(own)
        flat = [c for own in cells for c in own]
        self.words = max(1, -(-len(flat) // 64))
        self.starts = np.zeros(self.words, np.uint64)
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.loops = np.zeros((256, self.words), np.uint64)
        self.ends = np.zeros((len(cells), 2), np.int64)
        at = 0
        for k, own in enumerate(cells):
            for j, (char, no_slash, slash) in enumerate(own):
                w, bit = at >> 6, np.uint64(1 << (at & 63))
                if j == 0:
                    self.starts[w] |= bit
                elif char == -1:
                    self.accepts[:, w] |= bit
                else:
                    self.accepts[char, w] |= bit
                if no_slash:
                    self.loops[:, w] |= bit
                    if not slash:
                        self.loops[ord("/"), w] &= ~bit
                at += 1
            self.ends[k] = (at - 1) >> 6, (at - 1) & 63

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """Whether each text fits each pattern as a whole: rows by patterns."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        joined = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        sorted_sizes = sizes[order]
        d = np.tile(self.starts, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        active = n
        for t in range(int(sorted_sizes[0]) if n else 0):
            while active and sorted_sizes[active - 1] <= t:
                active -= 1
            c = joined[starts[:active] + t]
            now = d[:active]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            d[:active] = moved & self.accepts[c] | now & self.loops[c]
        fits = (d[:, self.ends[:, 0]] >> self.ends[:, 1].astype(np.uint64)) & one
        out = np.empty((n, len(self.ends)), bool)
        out[order] = fits.astype(bool)
        return out


@lru_cache(maxsize=4)
def _prepared(rules: tuple[Rule, ...]) -> tuple[Automaton, list[int]]:
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))
    return Automaton([rules[i].pattern for i in ranked]), ranked


def _batches(batches, rules: tuple[Rule, ...], default: str):
    tool, ranked = _prepared(rules)
    names = [rules[i].text for i in ranked] + [None]
    verdicts = [rules[i].verdict for i in ranked] + [default]
    for b in batches:
        hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
        first = np.full(len(hosts), len(ranked))
        for at in range(0, len(hosts), 4096):
            fits = tool.run([f".{h}{p}".encode() for h, p in zip(hosts[at : at + 4096], paths[at : at + 4096], strict=True)])
            if fits.size:
                first[at : at + 4096] = np.where(fits.any(1), fits.argmax(1), len(ranked))
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("host"), b.column("path"), pa.array([names[i] for i in first], pa.string()), pa.array([verdicts[i] for i in first], pa.string())],
            ["page_id", "host", "path", "rule", "verdict"],
        )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical parts: what follows the first ``://`` up to / ? # with A-Z lower-cased, then up to ? or #; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (text of the longest that fits, of equals the first; else null), verdict.

    Null urls and such without ``://``: empty host and path, no rule, verdict ``default``. A null id stays null;
    repeated rows each give a row; other columns, also such named host or rule, are not read. Urls of any length
    are read whole. Without rules every page gets ``default``. No shuffle.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    return common.arrow_map(parts, "ledgerloom.llm.url_rules:_batches", f"page_id {kind}, host string, path string, rule string, verdict string", rules=tuple(rules), default=default)
