"""What the packing and token-file queries return, against the tokenizers library document by document."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from guilloche.llm import packing, token_files
from guilloche.llm.tokenize import vocabulary


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packed_pieces_hold_each_id_once_and_little_padding(spark, data, texts):
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {d: [*e.ids, 1] for d, e in zip(texts, lib.encode_batch(list(texts.values()), add_special_tokens=False))}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.op4_packing(spark, data).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for held, total in [*((p, len(ids[d])) for d, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length
        assert at == total or total is None and at <= 2048
    used = sum(map(len, ids.values()))
    assert len(sequences) * 2048 <= 1.03 * used + 2048


def test_token_files_give_back_every_id(spark, data, texts):
    lib, at = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    order = sorted(texts)
    want = []
    for d, e in zip(order, lib.encode_batch([texts[d] for d in order], add_special_tokens=False)):
        own = [*e.ids, 2]
        want.append((d, at, len(own), crc(own)))
        at += len(own)
    got = token_files.op8_token_files(spark, data)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_checksums_of_lists_and_of_none(spark):
    rows = [(1, 0, 3, [0, 65536, 2147483647]), (2, 3, 0, []), (None, 3, 1, [7])]
    table = spark.createDataFrame(rows, "doc_id long, start long, n_tokens long, tokens array<int>").repartition(2)
    got = token_files.with_crc32(table.withColumn("base", F.lit(1)))
    assert {r.doc_id: r.ids_crc32 for r in got.collect()} == {d: crc(ids) for d, _, _, ids in rows}
