"""Batches of texts between tasks and their Python workers are bounded by bytes, not by rows."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visitwise.llm import bpe, common, quality, simhash


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(common.BATCH_CONF)
    spark.conf.set(common.BATCH_CONF, "1g")
    yield spark
    spark.conf.set(common.BATCH_CONF, before)


def test_long_texts_come_in_small_batches(unbounded):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    texts = unbounded.range(0, 3000, 1, 1).select(F.repeat(F.lit("some words "), 1000).alias("text"))
    got = common.map_batches(texts, sizes, "n bigint, bytes bigint").collect()
    assert sum(r["n"] for r in got) == 3000
    assert max(r["bytes"] for r in got) <= 2 * common.BATCH_BYTES < 3000 * 11_000


def test_a_lower_limit_of_the_session_stays(unbounded):
    unbounded.conf.set(common.BATCH_CONF, "64k")
    common.map_batches(unbounded.range(3), lambda batches: batches, "id bigint").collect()
    assert unbounded.conf.get(common.BATCH_CONF) == "64k"


@pytest.mark.parametrize("operator", ["quality", "simhash", "bpe"])
def test_stages_of_the_pipeline_bound_their_batches(unbounded, operator):
    docs = unbounded.createDataFrame([(1, "a b")], "doc_id long, text string")
    if operator == "quality":
        quality.keep_accepted(docs, quality.Network(quality.Settings()))
    elif operator == "simhash":
        simhash.fingerprints(docs)
    else:
        bpe.word_counts(docs, bpe.Vocabulary({bytes([b]): b for b in range(256)}, r"\w+|\W+"))
    assert unbounded.conf.get(common.BATCH_CONF) == str(common.BATCH_BYTES)


def test_bpe_never_chains_python_workers(spark):
    docs = spark.createDataFrame([(1, "a ab"), (2, None)], "doc_id long, text string")
    encoded = bpe.encode(docs, bpe.Vocabulary({bytes([b]): b for b in range(256)}, r"\w+|\W+"))
    assert encoded._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {row["doc_id"]: row["ids"] for row in encoded.collect()} == {1: [97, 32, 97, 98], 2: []}


def test_bpe_fills_a_run_in_blocks_of_tokens(spark):
    docs = spark.createDataFrame([(i, "xyxyx q" * (i % 4)) for i in range(40)] + [(None, None)], "doc_id long, text string")
    vocabulary = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"xy": 256}, r"\w+|\W+")
    settings = bpe.Settings(dictionary_words=0, run_bytes=64, block_bytes=16, block_tokens=8)
    want = {i: [256, 256, 120, 32, 113] * (i % 4) for i in range(40)} | {None: []}
    assert {row["doc_id"]: row["ids"] for row in bpe.encode(docs, vocabulary, settings).collect()} == want


def test_bpe_numbers_survive_their_halves():
    ids = np.array([0, 1, 65535, 65536, bpe.LATER, bpe.LATER + 70_000, 2**32 - 1], dtype="<u4")
    assert bpe.whole(pa.py_buffer(bpe.halves(ids))).tolist() == ids.tolist()
    assert bpe.whole(pa.py_buffer(b"")).tolist() == []


def test_bpe_plain_parts_are_cut_as_the_pattern_does():
    cutter = bpe.Cutter(bpe.Vocabulary.load().pattern)
    letters = [chr(i) for i in range(33, 0x260) if not chr(i).isspace()]
    parts = letters + [a + b for a in letters for b in "aé.,;:!?'1"] + ["", ".", "..", "ab..", "a.b", "'s", "I'm.", "東京."]
    assert dict(cutter.cut(parts)) == {part: cutter.matches(part) for part in parts}


def test_bpe_dictionary_stays_packed_until_it_is_looked_up(spark):
    docs = spark.createDataFrame([(1, "xyx xyx q")], "doc_id long, text string")
    vocabulary = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"xy": 256}, r"\w+|\W+")
    found = bpe.dictionary(docs, vocabulary)
    assert found.words.nbytes + found.ids.nbytes < 200 and "numbers" not in vars(pickle.loads(pickle.dumps(found)))
    assert found.numbers == {"xyx": np.array([256, 120], dtype="<u4").tobytes()}
    assert bpe.dictionary(docs, vocabulary, bpe.Settings(dictionary_words=0)).numbers == {}
