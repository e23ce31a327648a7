"""Byte-level BPE through sentencepiece, from a rank file alone.

A rank file is served by a sentencepiece BPE model that is serialised here, field
by field, with no training: every token's bytes become the characters U+0100 to
U+01FF, its score is its negative rank, normalisation is the identity.  The merge
of highest score is then the merge of lowest rank.  Each match of the pattern is
encoded by itself; ids equal ranks, so decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship

#: Bytes of text for which a task holds ids at once; a longer text is held alone.
SLICE_BYTES = 1 << 20
#: Distinct pre-tokens, of at most so many characters, whose ids a worker remembers.
CACHE_TOKENS, CACHE_CHARS = 200_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    n &= 2**64 - 1  # negative numbers take ten bytes
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def mapped(data: bytes) -> str:
    """Each byte b as the character U+0100 + b."""
    return data.decode("latin-1").translate(_SHIFT)


_SHIFT = {b: 0x100 + b for b in range(256)}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised ModelProto; ranks must be 0 to n - 1 and hold every single byte."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0 to n - 1, each once")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must have a rank")
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    pieces = [_bytes(1, _bytes(1, mapped(t).encode()) + score(-float(r))) for r, t in enumerate(tokens)]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + score(0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


class Encoder:
    """The encoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.cache: dict[str, bytes] = {}

    def fresh(self, matches: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of matches that the cache lacks; it takes up short ones while it has room."""
        # A match that is a token is that token, whether or not merges lead to it.
        whole = [self.ranks.get(m.encode()) for m in matches]
        rest = [mapped(m.encode()) for m, r in zip(matches, whole, strict=True) if r is None]
        ids = iter(self.model.encode(rest, out_type=int, num_threads=1) if rest else [])
        new = {m: struct.pack("<I", r) if r is not None else np.array(next(ids), "<u4").tobytes() for m, r in zip(matches, whole, strict=True)}
        if (room := CACHE_TOKENS - len(self.cache)) > 0:
            self.cache.update(islice(((m, i) for m, i in new.items() if len(m) <= CACHE_CHARS), room))
        return new

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.find(t) for t in texts]
        known = self.cache.get
        if missing := list(set().union(*split).difference(self.cache)):
            new = self.fresh(missing)
            return [np.frombuffer(b"".join([known(m) or new[m] for m in s]), "<u4") for s in split]
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, s)), "<u4") for s in split]


class Decoder:
    """The inverse mapping, read back from the model: all tokens' bytes, and where each one's begin."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(read_ranks(path)))
        back = {0x100 + b: b for b in range(256)}
        tokens = [model.id_to_piece(i).translate(back).encode("latin-1") for i in range(len(model) - 1)]
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids."""
        sizes = self.sizes[ids]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.blob[np.repeat(self.starts[ids], sizes) + within].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    """One for all tasks of a worker."""
    return Decoder(path)


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes."""
    i, total = 0, np.cumsum(sizes)
    while i < len(sizes):
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def _with(df: DataFrame, name: str, kind: str) -> str:
    if name in df.columns:
        raise ValueError(f"the column {name} is there already; name another")
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name.replace('`', '``')}` {kind}"


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column of token ids, array<int>, and if ``decoded`` names one, a column of the bytes that ``decode`` gets from them.

    Null and empty texts have no ids.  Other columns are kept as they are; a
    column that has the new one's name already raises ValueError.  Decoded here,
    ids need no second worker for each task.
    """
    ship(docs.sparkSession)
    names, schema = [to], _with(docs, to, "array<int>")
    if decoded is not None:
        _with(docs, decoded, "binary")
        names, schema = [to, decoded], f"{schema}, `{decoded.replace('`', '``')}` binary"

    def run(batches):
        use, back = encoder(path, pattern), decoder(path) if decoded is not None else None
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, _sizes(batch.column(at)), SLICE_BYTES):
                ids = use.encode([t or "" for t in part.column(at).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids).view(np.int32)
                new = [pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat))]
                if back is not None:
                    new.append(pa.array([back.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with a column of the ids' bytes, binary; null for null ids, empty for none."""
    ship(df.sparkSession)

    def run(batches):
        use = decoder(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for part in slices(batch, _sizes(batch.column(at)), SLICE_BYTES // 4):
                out = [use.decode(i.values.to_numpy(zero_copy_only=False)) if i.is_valid else None for i in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, to])

    return df.mapInArrow(run, _with(df, to, "binary"))


def _sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    measure = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    return pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def digests(coded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> tuple[Column, Column, Column]:
    """(n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    ids = F.col(ids_col)
    return F.size(ids).cast("long"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256), F.sha2(F.col(decoded_col), 256)
