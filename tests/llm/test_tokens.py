import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronofact.llm import packing, tokenfile, tokens
from tests.llm.helpers import LONG, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(PATH, memory=20_000)
WORDS = st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\n\n", "\t", "don't", ",", ".", "...", "ü", "日本", "12", "x1", "\u00a0", "\x1c", "\0", "!?", "²", "<|endoftext|>", "ab.%%", "ab's", "ab!'"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(WORDS, st.text(max_size=40)))
def test_encoder_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(WORDS | st.none(), max_size=12))
def test_many_texts_at_once(texts):
    import pyarrow as pa

    got = [x.tolist() for x in ENCODER.each(pa.array(texts, pa.string()))]
    assert got == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_special_strings():
    """A special token's string is that token, as the library has it, or ordinary text if asked for."""
    assert 50256 in np.frombuffer(ENCODER.encode("a <|endoftext|> b"), "<u4").tolist()
    assert 50256 not in np.frombuffer(tokens.Encoder(PATH, special_as_text=True).encode("a <|endoftext|> b"), "<u4").tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50_000), max_size=300), max_size=6))
def test_shard_round_trip(docs):
    lengths = np.array([len(d) for d in docs], np.int64)
    ids = np.array([x for d in docs for x in d], np.uint32)
    shard = tokenfile.Shard(tokenfile.pack(ids, [*range(len(docs) - 1), *[None] * bool(docs)], np.cumsum(lengths) - lengths))
    got = [(d, x.tolist()) for d, _, x in shard.documents(most=100)]
    assert got == [(None if i == len(docs) - 1 else i, d) for i, d in enumerate(docs)]
    for a in range(0, len(ids), 97):
        assert shard.read(a, min(50, len(ids) - a)).tolist() == ids[a : a + 50].tolist()


def test_blocks_are_narrow_with_exceptions():
    ids = np.full(1280, 7, np.uint32)
    ids[::64] = 50_000
    assert len(tokenfile.pack(ids, [0], np.array([0]))) < 700


def test_round_trip(spark):
    docs = documents(spark)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokenfile.round_trip(docs, PATH).collect()]
    got.sort(key=lambda r: r[1])
    source = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for (doc_id, text), row in zip(source, got, strict=True):
        ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert row == (doc_id, at, len(ids) // 4, ids)
        at += len(ids) // 4
    assert tokenfile.round_trip(documents(spark, []), PATH).count() == 0


def test_many_shards(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(200)], "doc_id long, text string")
    manifest = tokenfile.write(docs, PATH, shard_ids=100)
    assert manifest.count() > 10
    rows = sorted(tokenfile.read(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == list(range(200)) and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("n", [1, 5, 1024, 1025, 2048, 3000])
def test_cut(n):
    found = packing.cut(n)
    assert sum(k for _, k in found) == n and all(k == 1024 for _, k in found[1:]) and [s for s, _ in found] == [sum(k for _, k in found[:i]) for i in range(len(found))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=0, max_size=300))
def test_plan_uses_every_length(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    chosen = packing.plan(counts)
    used = np.zeros(65, np.int64)
    for found, n in chosen:
        assert sum(found) <= 64 and n > 0
        for v in found:
            used[v] += n
    assert used.tolist() == counts.tolist()
    total = sum(n for _, n in chosen)
    least = max(-(-sum(lengths) // 64), sum(v > 32 for v in lengths))
    assert total <= least * 1.25 + 2


def test_pack(spark):
    docs = documents(spark)
    packed = packing.pack(docs, PATH).collect()
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.length, r.ids_crc32) for r in packed)
    expected = []
    for d, text in ((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()):
        ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected += [(d is None, d or 0, i, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids)))]
    assert pieces == sorted(expected)
    sequences: dict = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert any(r.length == 1024 for r in packed) and LONG
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.pack(docs, PATH)).collect()}
    assert sum(map(len, joined.values())) == 4 * sum(r.length for r in packed)
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_memory_of_runs_of_marks_is_bounded():
    """Long runs of marks are encoded, not remembered."""
    encoder = tokens.Encoder(PATH)
    texts = [f"word{'!?.;:,'[i % 6] * (2000 + i)}" for i in range(60)]
    for t in texts:
        assert encoder._tail(t[4:]) == encoder._by_library([t[4:]])[0]
    assert not encoder.tails
    for i in range(1500):
        encoder._tail("!" * (i % 60) + "?;"[i % 2] * 3)
    assert len(encoder.tails) <= 1001
