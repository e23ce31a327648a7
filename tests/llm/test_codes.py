"""Tokens, packed files and archives: exact round trips and other implementations."""

import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergeloom.llm import bpe, token_pack, warc
from mergeloom.llm.shared import filesystem

RANKS, PATTERN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n  \t x", "it's DON'T we'll", "<|endoftext|> x", "naïve Ünïcode ß İ Σας", "日本語 テスト", "👩‍👩‍👧 é", "a\x00b\x1cc\x85d", "x" * 3000, "1234567 3.14", "ab " * 4000, "a", "a"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, PATTERN)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_are_those_of_the_merges(reference, encoder, text):
    assert encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_every_token_encodes_as_itself(encoder):
    tokens = [t for t in encoder.ranks if encoder.find(t.decode("utf-8", "replace")) == [t.decode("utf-8", "replace")] and "�" not in t.decode("utf-8", "replace")]
    assert [encoder.encode([t.decode()])[0].tolist() for t in tokens[:5000]] == [[encoder.ranks[t]] for t in tokens[:5000]]


def test_columns_round_trip(spark, reference):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    coded = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS)
    n, ids, decoded = bpe.digests(coded)
    for r in coded.select("doc_id", "ids", "decoded", "n_tokens", n.alias("n"), ids.alias("h"), decoded.alias("d")).collect():
        text = ODD[r.doc_id] or ""
        want = reference.encode_ordinary(text)
        assert r.ids == want and bytes(r.decoded) == text.encode() and r.n == len(want) and r.n_tokens == 1
        assert r.h == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and r.d == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(df.where("false"), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError, match="there already"):
        bpe.encode(df, RANKS, PATTERN, to="text")


def test_one_worker_encodes_and_decodes(spark, rows):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    once, twice = bpe.encode(df, RANKS, PATTERN, decoded="decoded"), bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS)
    assert rows(once) == rows(twice)
    assert once._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    with pytest.raises(ValueError, match="there already"):
        bpe.encode(df, RANKS, PATTERN, decoded="text")


def test_full_cache_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_TOKENS", 3)
    small = bpe.Encoder(RANKS, PATTERN)
    texts = [t or "" for t in ODD] * 2
    assert [i.tolist() for i in small.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_broken_vocabularies_are_refused():
    with pytest.raises(ValueError, match="ranks"):
        bpe.sentencepiece_model({b"a": 1})
    with pytest.raises(ValueError, match="single byte"):
        bpe.sentencepiece_model({b"a": 0})


@settings(max_examples=60, deadline=None)
@given(bits=st.integers(1, 32), data=st.data())
def test_bits_round_trip(bits, data):
    docs = data.draw(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.lists(st.integers(0, 2**bits - 1), max_size=40)), max_size=12))
    out = io.BytesIO()
    writer = token_pack.Writer(out, bits, block=data.draw(st.integers(1, 33)))
    for i, ids in docs:
        writer.add(i, np.array(ids, np.uint32))
    writer.close()
    reader = token_pack.Reader(out, len(out.getvalue()))
    assert [(i, ids.tolist()) for i, _, ids in reader.documents()] == docs
    flat = [x for _, ids in docs for x in ids]
    a, b = sorted((data.draw(st.integers(0, len(flat))), data.draw(st.integers(0, len(flat)))))
    assert reader.ids(a, b).tolist() == flat[a:b]


def test_too_large_an_id_is_refused():
    with pytest.raises(ValueError, match="more than 3 bits"):
        token_pack.pack(np.array([8], np.uint32), 3)
    assert token_pack.bits_for(49_408) == 16 and token_pack.bits_for(1) == 1 and token_pack.bits_for(65_537) == 17


def test_files_hold_what_the_tokenizer_says(spark):
    from tokenizers import Tokenizer

    docs = [(7 * i % 31, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "twice b"), (3, "twice a")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int")
    files, root = token_pack.pack_tokens(df.repartition(5), WORDS, 49_408, 2)
    got = sorted(token_pack.read(files, root).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(WORDS)
    start = 0
    for r, (i, text) in zip(got, sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")), strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty, root = token_pack.pack_tokens(df.where("false"), WORDS, 49_408, 2)
    assert token_pack.read(empty, root).count() == 0


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "a b", ",", " "])), max_size=6).map("".join), max_size=6))
def test_ids_are_the_librarys(texts):
    """Of texts side by side in one block, special strings included."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    assert [i.tolist() for i in token_pack.encoder(WORDS).encode(pa.array(texts, pa.string()))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, t = token_pack.WordEncoder(path), Tokenizer.from_file(path)
    assert token_pack.encoder(WORDS).by_word and not mine.by_word
    assert [i.tolist() for i in mine.encode(pa.array(ODD))] == [t.encode(x or "", add_special_tokens=False).ids for x in ODD]


def test_archive(spark, monkeypatch):
    pages = [(3, "http://a/ b\n", "same"), (1, None, "same"), (9, "u", "same"), (2, "u", ""), (4, "u", None), (5, "u", "é" * 300_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "same2"), (None, "u", "same"), (5, "u", "other"), (1, None, "same")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int")
    index, root = warc.archive(df.repartition(3))
    got = {}
    for r in warc.read(index, root).collect():
        got.setdefault((r.page_id, r.payload_digest), []).append(r)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    assert sum(map(len, got.values())) == len(pages)
    for i, u, h in pages:
        body = (h or "").encode()
        for r in got[i, base64.b32encode(hashlib.sha1(body).digest()).decode()]:
            revisit = i is not None and i > first[h or ""]
            assert (r.payload_bytes, r.record_type, r.refers_to) == (len(body), "revisit" if revisit else "response", first[h or ""] if revisit else None)
            assert r.payload is None if revisit else bytes(r.payload) == body
    assert warc.read(index, root, payload=False).where("payload is not null").count() == 0
    want = warc.fetch(index, root, spark.createDataFrame([(6,), (404,)], "page_id long")).collect()
    assert len(want) == 1 and b"\r\n\r\nWARC/1.1\r\n" in bytes(want[0].record)
    # Any decompressor that knows skippable frames reads a bundle as one WARC file.
    import zstandard

    store, _ = filesystem(root)
    path = index.first().bundle
    with store.open_input_file(path) as f:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert len(list(warc.records(plain))) == index.where(F.col("bundle") == path).count()
    empty, root = warc.archive(df.where("false"))
    assert warc.read(empty, root).count() == 0


def test_least_bytes_of_a_copy(spark, rows):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    index, root = warc.archive(df, min_bytes=3)
    assert rows(warc.read(index, root), "page_id", "refers_to") == [(1, None), (2, None), (3, None), (4, 3)]


def test_damage_is_noticed():
    out = io.BytesIO()
    out.close = lambda: None
    w = warc.BundleWriter(out)
    w.add(warc.record(1, "u", b"body", warc.base32_sha1(b"other"), None, "2020"))
    w.close()
    data = out.getvalue()
    frame = warc.BundleReader(io.BytesIO(data), len(data)).frame(0)
    (_, _, headers, block), = warc.records(frame)
    with pytest.raises(ValueError, match="payload"):
        warc.parsed(headers, block, True)
    with pytest.raises(ValueError, match="seek table"):
        warc.BundleReader(io.BytesIO(data[:-1]), len(data) - 1)
