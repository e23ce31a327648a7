"""Token ids in files of fixed-width bits.

A file holds the ids of a run of documents.  Every id takes as many bits as the
largest id of the vocabulary needs, highest bit first, in blocks of ``BLOCK`` ids
that start at a byte; the last block may be shorter.  After the blocks come

* the blocks' offsets, unsigned 64-bit;
* the documents' index: ids, validity (one byte), first token, tokens;
* the trailer: documents, tokens, blocks, ids a block, bits, version, magic.

All numbers are little-endian.  numpy unpacks a block at once, and any token or
document is read from the blocks that hold it.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, materialize, ship, workspace
from .textbytes import blocks

MAGIC, VERSION, BLOCK = b"TOKBITS\0", 1, 1 << 14
TRAILER = struct.Struct("<QQQIHH8s")
#: Bytes of text encoded at once, tokens read at once, words a worker remembers and their length.
SLICE_BYTES, READ_BLOCKS, CACHE_WORDS, CACHE_BYTES = 4 << 20, 64, 500_000, 48


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, highest bit first, without gaps; zeros fill the last byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits == 16:
        return ids.astype(">u2").tobytes()
    planes = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(planes.reshape(-1)).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of ``data``."""
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = planes
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


class Writer:
    """Writes one file, a block in memory at a time."""

    def __init__(self, out, bits: int, block: int = BLOCK) -> None:
        self.out, self.bits, self.block = out, bits, block
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.at = 0
        self.offsets: list[int] = []
        self.docs: list[tuple[int, bool, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.held += len(ids)
        self.waiting.append(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.waiting)
            full = len(flat) // self.block * self.block
            for i in range(0, full, self.block):
                self._block(flat[i : i + self.block])
            self.waiting, self.held = [flat[full:]], len(flat) - full

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        ids, valid, first, n = (np.array([d[c] for d in self.docs], t) for c, t in enumerate(("<i8", "<u1", "<u8", "<u8")))
        for part in (np.array(self.offsets, "<u8"), ids, valid, first, n):
            self.out.write(part.tobytes())
        self.out.write(TRAILER.pack(len(self.docs), self.tokens, len(self.offsets), self.block, self.bits, VERSION, MAGIC))


class Reader:
    """Random access to one file: ``seekable`` has seek and read."""

    def __init__(self, seekable, size: int) -> None:
        self.source = seekable
        seekable.seek(size - TRAILER.size)
        docs, self.tokens, blocks, self.block, self.bits, version, magic = TRAILER.unpack(seekable.read(TRAILER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of packed tokens")
        self.end = size - TRAILER.size - docs * 25 - blocks * 8
        seekable.seek(self.end)
        take = lambda kind, n: np.frombuffer(seekable.read(np.dtype(kind).itemsize * n), kind)
        self.offsets = np.append(take("<u8", blocks), self.end).astype(np.int64)
        self.doc_ids, self.valid = take("<i8", docs), take("<u1", docs).astype(bool)
        self.first, self.counts = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The tokens [start, stop) of the file."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        self.source.seek(int(self.offsets[a]))
        data = self.source.read(int(self.offsets[b + 1] - self.offsets[a]))
        width = self.block * self.bits
        if width % 8 == 0:  # whole blocks leave no gap
            got = unpack(data, min(self.tokens, (b + 1) * self.block) - a * self.block, self.bits)
        else:
            got = np.concatenate([unpack(data[self.offsets[x] - self.offsets[a] : self.offsets[x + 1] - self.offsets[a]], min(self.block, self.tokens - x * self.block), self.bits) for x in range(a, b + 1)])
        return got[start - a * self.block : stop - a * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token, ids) of each document, some blocks at a time."""
        i = 0
        while i < len(self.counts):
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + READ_BLOCKS * self.block, "right")) - 1)
            base = int(self.first[i])
            got = self.ids(base, int(self.first[j - 1] + self.counts[j - 1]))
            for d in range(i, j):
                at = int(self.first[d]) - base
                yield (int(self.doc_ids[d]) if self.valid[d] else None), int(self.first[d]), got[at : at + int(self.counts[d])]
            i = j


#: What ``WordEncoder`` relies on to encode words apart: the normaliser and splitter of a tokenizers file.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


class WordEncoder:
    """A tokenizers file; ids are those of ``encode(text, add_special_tokens=False)``, strings of added tokens included.

    Where the normaliser and splitter are known to keep nothing of white space, a
    text's ids are those of its runs between ASCII spaces, one after the other, and
    each distinct run is encoded once.  They lower-case too, and always part an
    ASCII letter from a following mark like a comma; both are done beforehand, so
    that a word has one form in the cache.  Texts that hold the string of an added
    token, and all texts with any other normaliser or splitter, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        model = told.get("model") or {}
        self.by_word = told.get("normalizer") == _NORMALIZER and split[0] == _SPLIT and len(split) == 2 and {k: split[1].get(k) for k in _BYTES} == _BYTES and model.get("type") == "BPE" and not model.get("dropout")
        # Lower-cased: a text without them holds none, however a token is normalised.
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts, each encoded at once."""
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian 32-bit ids of words that the cache lacks; it takes up short ones while it has room."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got))) * 4
        flat = np.fromiter(chain.from_iterable(got), "<u4").tobytes()
        new = {w: flat[a:b] for w, a, b in zip(words, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}
        if (room := CACHE_WORDS - len(self.cache)) > 0:
            self.cache.update(islice(((w, i) for w, i in new.items() if len(w) <= CACHE_BYTES), room))
        return new

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null ones have none."""
        for _, _, data, offsets in blocks(column, SLICE_BYTES):
            if not self.by_word:
                plain, at = data.tobytes(), offsets.tolist()
                yield from self.whole([plain[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
                continue
            lower = _LOWER[data]
            special = self.special(data.tobytes(), lower.tobytes(), offsets)
            cut = np.flatnonzero(_LETTER[lower[:-1]] & _MARK[lower[1:]]) + 1
            text = np.insert(lower, cut, 0x20).tobytes()
            at = (offsets + np.searchsorted(cut, offsets)).tolist()
            # A text that begins with a mark after another's last letter gets that space, which is nothing.
            split = [text[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]
            missing = list(set().union(*split).difference(self.cache))
            new = self.fresh(missing) if missing else {}
            known = self.cache.get
            for row, words in enumerate(split):
                if row in special:
                    yield special[row]
                else:
                    yield np.frombuffer(b"".join([known(w) or new.get(w, b"") for w in words] if new else map(self.cache.__getitem__, words)), "<u4")

    def special(self, plain: bytes, lower: bytes, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Ids of the rows that hold an added token's string."""
        found: set[int] = set()
        for token in self.added:
            at = lower.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                found.add(row)
                at = lower.find(token, int(offsets[row + 1]))
        rows = sorted(found)
        return dict(zip(rows, self.whole([plain[offsets[r] : offsets[r + 1]] for r in rows]), strict=True))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.;:!?"]] = True


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(path)


def write(docs: DataFrame, to: str, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the texts, end each with ``end_id``, and write them in ascending order of id.

    Files go to the folder ``to``, each a run of the order; the result, which is
    written too, has a row for each file: path, first (tokens of all files
    before), tokens, documents.  Null texts are empty.  Rows that repeat an id
    come in the order of their texts; rows with a null id come first.
    """
    spark = docs.sparkSession
    ship(spark)
    bits = bits_for(vocabulary)
    schema = pa.schema([("path", pa.string()), ("least", pa.int64()), ("tokens", pa.int64()), ("documents", pa.int64())])

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        use, writer, path, least = encoder(tokenizer), None, "", None
        store, folder = filesystem(to)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), use.encode(batch.column(1)), strict=True):
                if writer is None:
                    store.create_dir(folder, recursive=True)
                    path, least = f"{folder}/{uuid.uuid4().hex}.tok", doc_id
                    writer = Writer(store.open_output_stream(path, compression=None), bits)
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([least], pa.int64()), pa.array([writer.tokens]), pa.array([len(writer.docs)])], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = materialize(ordered.mapInArrow(run, "path string, least long, tokens long, documents long"), f"{to}/files")
    # One row a file: their number is that of the tasks that wrote them.
    rows, first, listed = sorted(files.collect(), key=lambda r: (r.least is not None, r.least or 0)), 0, []
    for r in rows:
        listed.append((r.path, first, r.tokens, r.documents))
        first += r.tokens
    return spark.createDataFrame(listed, "path string, first long, tokens long, documents long")


def read(files: DataFrame, root: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the files; ids as little-endian unsigned 32-bit numbers, start over all files."""
    ship(files.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        store, _ = filesystem(root)
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    rows, held = [], 0
                    for doc_id, start, ids in Reader(source, source.size()).documents():
                        rows.append((doc_id, first + start, len(ids), ids.astype("<u4").tobytes()))
                        held += len(ids)
                        if held > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path", "first").repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def pack_tokens(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, **columns: str) -> tuple[DataFrame, str]:
    """``write`` to a new shared folder; (files, folder)."""
    to = workspace(docs.sparkSession, "tokens")
    return write(docs, to, tokenizer, vocabulary, end_id, **columns), to

