"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one Shift-And machine: one bit for each literal of each rule, in as many 64-bit words as that
takes. One step reads one byte of every url of a batch:

    D = ((D << 1 | starts) & B[byte]) | (D & loops)

B[byte] has the bits whose literal is that byte (? has all), loops the bits that a * follows, starts the first bits of rules at
the first byte, and of rules with a leading * at every byte. Carries pass from word to word; a first bit never takes one from
the rule before it. A rule matches when its last bit is set after the last byte.

The canonical form of a url that the machine reads is "." + host + SEP + path, so a host glob after "*." fits a host and its
subdomains, and no wildcard of the host reaches into the path. ? stands for one byte.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?", "#" or the end. A null
url or one without "://" has neither, fits no rule, and is judged by the method's globs like any other. Host and path rules come
first and the longest one that fits wins; elsewhere a url is blocked if a block glob fits it, else allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import derived

SEP = "\x01"
#: 64-bit words of automaton state that are held at a time
STATE_WORDS = 1 << 20
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str = ""  # what the path starts with

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{SEP}{self.path}*"


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class ShiftAnd:
    """Simulates globs (* any bytes, ? one byte, all else literal) over many byte strings at once."""

    def __init__(self, globs: Sequence[str]):
        literals: list[bytes | None] = []
        loops, first, always, self.last, self.bare = [], [], [], [], []
        for g in globs:
            # what stands between stars; empty parts at either end say that the glob begins or ends with one
            parts = [p.encode() for p in g.split("*")]
            begin = len(literals)
            for k, part in enumerate(parts):
                literals += [None if c == 0x3F else bytes([c]) for c in part]
                if k < len(parts) - 1 and len(literals) > begin:
                    loops.append(len(literals) - 1)
            self.bare.append(len(literals) == begin)  # only stars, or nothing
            if len(literals) > begin:
                first.append(begin)
                if not parts[0]:
                    always.append(begin)
            self.last.append(len(literals) - 1)
        self.empty = [g == "" for g in globs]
        self.width = max(1, -(-len(literals) // 64))
        self.loops, self.first, self.always = (self._bits(x) for x in (loops, first, always))
        self.on = np.stack([self._bits([i for i, x in enumerate(literals) if x is None or x[0] == c]) for c in range(256)])

    def _bits(self, at: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        for i in at:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def run(self, urls: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: url by glob."""
        length = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-length, kind="stable")
        state = np.zeros((len(urls), self.width), np.uint64)
        data = np.frombuffer(b"".join(urls), np.uint8)
        begins = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)[order] if len(urls) else length
        ranked = length[order]
        for j in range(int(length.max(initial=0))):
            alive = int(np.searchsorted(-ranked, -j, "left"))  # the longer ones
            d = state[:alive]
            shifted = d << np.uint64(1)
            shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            shifted = (shifted & ~self.first) | (self.first if j == 0 else self.always)
            state[:alive] = (shifted & self.on[data[begins[:alive] + j]]) | (d & self.loops)
        out = np.empty((len(urls), len(self.last)), bool)
        for g, bit in enumerate(self.last):
            if self.bare[g]:
                out[order, g] = (ranked == 0) if self.empty[g] else True
            else:
                out[order, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def judge_urls(df: DataFrame, rules: Sequence[Rule], blocked: Sequence[str], url: str = "url") -> DataFrame:
    """df with host, path, rule (name of the longest rule that fits, else null) and verdict. blocked: globs over host + SEP + path."""
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [r.glob for r in ranked] + list(blocked)

    def start():
        machine = ShiftAnd(globs)

        def work(urls: pa.Array) -> list[list]:
            parts = [split_url(u) for u in urls.to_pylist()]
            # machines of hundreds of words hold their state for a part of the urls at a time
            step = max(1, STATE_WORDS // machine.width)
            canonical = [f".{h}{SEP}{p.replace(SEP, '%01')}".encode() for h, p in ((h.replace(SEP, "%01"), p) for h, p in parts)]
            rule, verdict = [], []
            for at in range(0, len(parts), step):
                fits = machine.run(canonical[at : at + step])
                by_rule, by_glob = fits[:, : len(ranked)], fits[:, len(ranked) :].any(axis=1)
                hit = by_rule.any(axis=1)
                best = by_rule.argmax(axis=1) if ranked else np.zeros(len(fits), int)
                rule += [ranked[k].name if h else None for h, k in zip(hit, best, strict=True)]
                verdict += [ranked[k].verdict if h else "block" if g else "allow" for h, k, g in zip(hit, best, by_glob, strict=True)]
            return [[h for h, _ in parts], [p for _, p in parts], rule, verdict]

        return work

    return derived(df, url, [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")], start)
