"""Operator 12 against the tokenizers library and on odd tables; the encoder and the index on their own."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from netvigil.llm import token_store
from netvigil.llm.byte_tokens import ByteEncoder, kinds_of
from netvigil.llm.common import table
from netvigil.llm.tokens import vocabulary_path
from tests.llm.test_operators import SF, empty_docs, odd_docs

PATH = vocabulary_path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_segments_give_the_librarys_ids():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "É", "ß", "İ", "1", "²", ".", ",", "'", "'s", "'RE", "<|endoftext|>", "<|e", "|>", "#", "A1", "2b",
                "?!", "x.y", "(", "日本", "。", "́", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ",
                " ", "　", "᠎", "​", "﻿", "×", "÷", "ﬁ", "’", "don't", "the", "😀", "\x7f", "\x00"]
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(6000)] + ["", None]
    encoder = ByteEncoder(PATH)
    assert encoder.kind is not None
    ids, bound = encoder.encode(pa.array(some))
    assert [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])] == library(some)
    encoder.kind = None  # as for a vocabulary whose settings forbid segments
    ids, bound = encoder.encode(pa.array(some[:50]))
    assert [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])] == library(some[:50])
    assert kinds_of(vocabulary_path("word_bpe_49k.json")) is None


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 1000, 40_000):
        keys = np.unique(rng.integers(-2 ** 62, 2 ** 62, n))
        h = token_store.key_hash(keys)
        assert [int(v) for v in h[:50]] == [xxhash.xxh64_intdigest(struct.pack("<q", k), 42) for k in keys[:50].tolist()]
        perfect = token_store.PerfectHash.build(h)
        assert sorted(perfect.slots(h).tolist()) == list(range(len(keys)))  # minimal and perfect
        assert sum(perfect.bits) <= 4.5 * len(keys) + 64 * 12
        part = token_store.IndexPart(token_store.IndexPart.packed(keys, {"first_row": np.arange(len(keys))}))
        found, entries = part.find(keys)
        assert found.all() and entries["first_row"].tolist() == list(range(len(keys)))
        found, _ = part.find(rng.integers(2 ** 62, 2 ** 63 - 1, 5000))
        assert found.sum() == 0


def test_hash_matches_spark(spark):
    keys = np.array([0, -1, 7, 2 ** 63 - 1, -2 ** 63, 123456789], np.int64)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    rows = {r.k: (r.h, r.p) for r in df.select("k", F.xxhash64("k").alias("h"), token_store._part("k", 13).alias("p")).collect()}
    h = token_store.key_hash(keys)
    assert [rows[int(k)][0] for k in keys] == h.view(np.int64).tolist()
    assert [rows[int(k)][1] for k in keys] == token_store.part_of(h, 13).tolist()


def test_query_matches_library(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    want, start = {}, 0
    for i, ids in sorted(zip(texts, library(texts.values()))):
        ids = [*ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = token_store.op12_token_id_output(spark, SF).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want


@pytest.mark.parametrize("bounds", [(token_store.SHARD_BYTES, token_store.KEYS_A_PART), (600, 3)])
def test_store_of_odd_tables(spark, tmp_path, bounds):
    """One shard, or many that single keys span; keyed access and bulk reads agree with the library."""
    docs = odd_docs(spark).unionByName(spark.createDataFrame(
        [(50, f"copy {i % 2}", None, None, None, "x", 1, 0) for i in range(200)]
        + [(None, "null " * i, None, None, None, "x", 1, 0) for i in range(30)]
        + [(0, "zero", None, None, None, "x", 1, 0), (-5, "below", None, None, None, "x", 1, 0)], odd_docs(spark).schema))
    rows = docs.collect()
    store = token_store.write_store(docs.repartition(5), f"file:{tmp_path}/store", shard_bytes=bounds[0], keys_a_part=bounds[1])
    want = {}
    for r, ids in zip(rows, library([r.text for r in rows])):
        want.setdefault(r.doc_id, []).append((*ids, 2))
    at, places = 0, {}
    for key in sorted(want, key=lambda k: (k is not None, k or 0)):
        got = store.get(key)
        assert sorted(tuple(ids.tolist()) for _, ids in got) == sorted(want[key])
        for start, ids in got:  # documents lie one after another, in ascending order of the key
            assert start == at
            at += len(ids)
        places[key] = [(s, tuple(ids.tolist())) for s, ids in got]
    assert all(store.get(k) == [] for k in (-1, 999, 2 ** 62))
    asked = spark.createDataFrame([(k,) for k in [*want, 999, 50, 50]], "key long")
    back = {}
    for r in store.documents(asked).collect():
        back.setdefault(r.key, []).append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
    assert {k: sorted(v) for k, v in back.items()} == places
    shards = spark.read.parquet(f"{tmp_path}/store/shards")
    assert shards.count() == 1 if bounds[0] > 600 else shards.count() > 10
    assert len(store.documents(asked.where("key = 4")).collect()) == 1


def test_empty_store(spark, tmp_path):
    store = token_store.write_store(empty_docs(spark), f"{tmp_path}/store")
    assert store.get(1) == [] and store.get(None) == []
    assert store.documents(spark.createDataFrame([(1,), (None,)], "key long")).count() == 0
