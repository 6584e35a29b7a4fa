"""Token counts by the tokenizer library, in Arrow batches that return lengths only.

A batch of rows is cut into pieces of at most PIECE characters at safe boundaries, and the pieces are encoded in groups of about
GROUP_BYTES, so that neither a long text nor a batch of long texts decides how much memory a call takes. A boundary is safe
between a letter, digit or mark of ASCII punctuation and a blank or line feed: every token rule of a byte-level pre-tokenizer
either starts with white space or holds none, so a token always begins there, and what comes before it has no say in it. A
stretch without such a boundary stays whole. Where a tokenizer normalizes, adds a leading space or has another pre-tokenizer,
texts aren't cut at all.

Special strings in a text are handled as the library does by default. Nulls and empty texts have 0 tokens. Repeated texts of a
group are encoded once. Columns of the names to be added are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import derived
from .textbytes import blocks

PIECE, GROUP_BYTES = 32_768, 1 << 20
#: bytes of texts that are Python objects at a time, unless one text has more
BATCH = 4 << 20
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?)\]'\"])[ \n]")
_LOADED: dict[str, tuple] = {}


def tokenizer(path: str):
    """(tokenizer, whether texts may be cut) of a .json file; loaded once in each worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        cut = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        cut = cut and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded, cut
    return _LOADED[path]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """text in pieces whose tokens together are the tokens of text."""
    at = 0
    while len(text) - at > most:
        found = next((m for m in _SAFE.finditer(text, at + most // 2, at + most)), None) or _SAFE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def count(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    found, cut = tokenizer(path)
    total = np.zeros(len(texts), np.int64)
    group: dict[str, list[int]] = {}
    held = 0

    def flush() -> None:
        for owners, e in zip(group.values(), found.encode_batch(list(group), add_special_tokens=False), strict=True):
            for i in owners:
                total[i] += len(e)
        group.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text) if cut else [text]:
            if piece:
                group.setdefault(piece, []).append(i)
                held += len(piece) if piece.isascii() else len(piece.encode())
            if held >= GROUP_BYTES:
                flush()
                held = 0
    flush()
    return total


def with_token_counts(df: DataFrame, path: str, limit: int = 512, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", over: str = "over_limit") -> DataFrame:
    """df with the UTF-8 length, the number of tokens, and whether that is over the limit. Texts go to Python, lengths come back."""
    fields = [T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType()), T.StructField(over, T.BooleanType())]

    def start():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks

        def work(texts: pa.Array) -> list[pa.Array]:
            n = np.zeros(len(texts), np.int64)
            for b in blocks(texts, BATCH):  # some texts at a time as Python objects
                n[b.first : b.first + b.n] = count(texts.slice(b.first, b.n).to_pylist(), path)
            return [pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)]

        return work

    return derived(df, text, fields, start)
