import random
import re

import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from chronofact.llm import simhash
from tests.llm.helpers import documents


def brute(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, bits=2):
    root = {v: v for v in values}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {frozenset(v for v in values if find(v) == find(w)) for w in values}


@given(st.text())
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode("utf-8", "ignore")) == brute(text.encode("utf-8", "ignore").decode())


def test_spark_hash_is_xxh64(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a b ü"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("a b ü".encode(), 42)


def test_near_duplicates(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [(r.doc_id, brute(r.text)) for r in docs.select("doc_id", "text").collect()]
    groups = brute_components(sorted({f for _, f in fps}))
    least = {f: min((d for d, g in fps if g in group and d is not None), default=None) for group in groups for f in group}
    assert got == {(d, f"{f:016x}", least[f]) for d, f in fps}
    assert simhash.near_duplicates(docs).count() == docs.count()


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("crowd", [1, 16])
def test_links_and_components(spark, bits, crowd):
    rng = random.Random(7)
    values = []
    for _ in range(8):
        v = rng.getrandbits(64)
        for _ in range(25):
            values.append(v)
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                v ^= 1 << rng.randrange(64)
    values = sorted(set(values))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    pairs = simhash.links(fps, bits, crowd)
    assert all((r.a ^ r.b) % 2**64 and ((r.a ^ r.b) % 2**64).bit_count() <= bits for r in pairs.collect())
    groups: dict = {}
    for r in simhash.components(pairs).collect():
        groups.setdefault(r.root, {r.root % 2**64}).add(r.node % 2**64)
    assert {frozenset(g) for g in groups.values()} == {g for g in brute_components(values, bits) if len(g) > 1}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)}


def test_keep_one(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids and ids.count(3) == 1 and 4 not in ids and 8 in ids


def test_empty(spark):
    docs = documents(spark, [])
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
