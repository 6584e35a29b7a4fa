"""SentencePiece encoding and decoding through a table of distinct marked words.

The library writes a text as one marker, then the text with every blank as a marker. Where no piece has a marker after another
character, no merge crosses from a word into the next marker, so a text is a row of chunks (markers, then other characters) that
are segmented independently. Each distinct chunk is segmented once per worker while it stays in the table, and the chunks' ids
are put together again by position and decoded as a whole. The table is two of TABLE chunks at most: when the young one is full it
becomes the old one, from which chunks that are met again come back; what neither has is segmented anew.

check_model says whether a model allows this; others are encoded text by text. Nulls and empty texts have no ids and decode to an
empty text. Ids are all ids, with no begin or end. Columns of the names to be added are replaced.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import derived

MARK = "▁"
TABLE, LONGEST = 200_000, 256
#: rows that are worked off at a time
SLICE = 64
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_LOADED: dict[str, Pieces] = {}


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # one object for each id, and for its decimal form, however often the tables and texts hold it
        self.numbers = list(range(self.model.get_piece_size()))
        self.decimals = list(map(str, self.numbers))
        self.by_chunk = self.check_model()
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def check_model(self) -> bool:
        """No piece has a marker behind another character, blanks are kept, one marker is put in front, nothing else is normalized."""
        m = self.model
        probe = f"ﬁ  AÅÅ\t\n x　{MARK} "
        return not any(re.search(f"[^{MARK}]{MARK}", m.id_to_piece(i)) for i in range(m.get_piece_size())) and m.decode(m.encode(probe)) == probe.replace(MARK, " ") and m.encode("x", out_type=str)[0].startswith(MARK)

    def _learn(self, chunks: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each chunk; encode() puts the first marker back itself."""
        plain = [c for c in chunks if c != MARK]
        ids = dict(zip(plain, self.model.encode([c[1:] for c in plain], num_threads=1) if plain else [], strict=True))
        if len(plain) < len(chunks):
            ids[MARK] = self.model.encode(f"x{MARK}")[len(self.model.encode("x")) :]
        number = self.numbers.__getitem__
        return {c: tuple(map(number, v)) for c, v in ids.items()}

    def _look_up(self, chunks: list[str]) -> list[tuple[int, ...]]:
        found = list(map(self.young.get, chunks))
        if all(found):
            return found
        missing = dict.fromkeys(c for c, v in zip(chunks, found, strict=True) if v is None)
        known = {c: self.old[c] for c in missing if c in self.old}
        known |= self._learn([c for c in missing if c not in known])
        if len(self.young) + len(known) > TABLE:
            self.young, self.old = {}, self.young
        self.young.update((c, v) for c, v in known.items() if len(c) <= LONGEST)
        return [known[c] if v is None else v for c, v in zip(chunks, found, strict=True)]

    def encode(self, text: str) -> list[int]:
        if not text or not self.by_chunk:
            return self.model.encode(text) if text else []
        return list(chain.from_iterable(self._look_up(_CHUNK.findall(MARK + text.replace(" ", MARK)))))

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids) if ids else ""

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.decimals.__getitem__, ids))


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def with_pieces(df: DataFrame, path: str, text: str = "text", ids: str | None = None, decoded: str | None = None, digests: bool = True) -> DataFrame:
    """df with n_tokens, and as asked for: ids (array<int>), the decoded text, digests of both. Texts go to Python, these come back."""
    added = {"n_tokens": T.LongType()} | ({ids: T.ArrayType(T.IntegerType())} if ids else {}) | ({decoded: T.StringType()} if decoded else {}) | ({"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {})
    kinds = {"n_tokens": pa.int64(), ids: pa.list_(pa.int32())}

    def start():
        model = pieces(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            done: dict[str, list[pa.Array]] = {n: [pa.array([], kinds.get(n, pa.string()))] for n in added}
            for at in range(0, len(texts), SLICE):  # ids are several times as large as texts: few rows are Python objects at a time
                new: dict[str, list] = {n: [] for n in added}
                for x in texts.slice(at, SLICE):
                    own = model.encode(x.as_py())
                    new["n_tokens"].append(len(own))
                    if ids:
                        new[ids].append(np.array(own, np.int32))
                    if decoded or digests:
                        back = model.decode(own)
                    if decoded:
                        new[decoded].append(back)
                    if digests:
                        new["ids_sha256"].append(_sha256(model.joined(own)))
                        new["decoded_sha256"].append(_sha256(back))
                for n, v in new.items():
                    done[n].append(pa.array(v, kinds.get(n, pa.string())))
            return [pa.concat_arrays(v) for v in done.values()]

        return work

    return derived(df, text, [T.StructField(n, t) for n, t in added.items()], start)
