"""Matrix CRCs against zlib, features, gains and draws against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from tests import oracle
from tests.llm import plain
from tests.llm.data import awkward_rows, frame
from visitwise.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, ngram):
    words = WORD.findall(plain.lower(text))
    return words, [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, s):
    def buckets(found):
        return [zlib.crc32(f.encode()) % s.buckets for f in found]

    seen = [(i, *grams(t, s.ngram)) for i, t in docs]
    raw = Counter(b for _, _, found in seen for b in buckets(found))
    wanted = Counter(b for t in target for b in buckets(grams(t, s.ngram)[1]))
    all_raw, all_wanted = float(raw.total()), float(wanted.total())

    def gain(b):
        above = (wanted[b] + 1.0) * (all_raw + s.buckets)
        return math.floor(s.scale * math.log(above / ((raw[b] + 1.0) * (all_wanted + s.buckets))))

    rows = []
    for i, words, found in seen:
        weight = sum(map(gain, buckets(found)))
        h = int(hashlib.sha256(f"{s.seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-s.scale * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words), len(found), weight, score, None])
    ranked = sorted((r for r in rows if r[1] >= s.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, row in enumerate(ranked[: len(ranked) * s.percent // 100], 1):
        row[5] = place
    return sorted(map(tuple, rows), key=repr)


def got(docs, target, settings):
    return sorted(map(tuple, R.resample(docs, target, settings).collect()), key=repr)


@pytest.mark.parametrize("length", [1, 2, 3, 7, 64, R.CHUNK - 1, R.CHUNK, R.CHUNK + 1, 2 * R.CHUNK, 5 * R.CHUNK + 13])
def test_matrix_crcs(length):
    rows = np.random.default_rng(length).integers(0, 256, (9, length), dtype=np.uint8)
    assert R.crc32_rows(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


def test_crcs_come_back_in_text_order(monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BYTES", 40)
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.choice([1, 2, 3, 90, 700]))) for _ in range(300)]
    lengths = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    assert R.crcs(data, np.cumsum(lengths) - lengths, lengths).tolist() == [zlib.crc32(w) for w in words]


@pytest.mark.parametrize("ngram", [1, 2, 3])
@pytest.mark.parametrize("block", [R.BLOCK_BYTES, 50])
def test_features(monkeypatch, ngram, block):
    """No n-gram crosses from text to text, also where no separator stands between them."""
    monkeypatch.setattr(R, "BLOCK_BYTES", block)
    import pyarrow as pa

    texts = [r[1] for r in awkward_rows()] + ["Ab", "cD", "", "e", None, "\x7f", "f g", "h", "東京b 1"]
    s = R.Settings(ngram=ngram)
    words, found = [], [[] for _ in texts]
    for row, raw, ends in R.text_blocks(pa.array(texts, pa.string()).slice(0)):
        n_words, owner, buckets = R.features(raw, ends, s)
        words += n_words.tolist()
        for o, b in zip(owner, buckets):
            found[row + o].append(b)
    assert words == [len(grams(t, 1)[0]) for t in texts]
    for text, have in zip(texts, found):
        assert Counter(have) == Counter(zlib.crc32(f.encode()) % s.buckets for f in grams(text, ngram)[1])


@pytest.mark.parametrize("settings", [R.Settings(min_words=1, percent=50), R.Settings(ngram=2, buckets=97, percent=100)])
def test_awkward_rows(spark, settings):
    docs = frame(spark)
    target = spark.createDataFrame([("River stone RIVER",), (None,), ("",)], "text string")
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert got(docs, target, settings) == plain_resample(rows, ["River stone RIVER", None, ""], settings)


def test_draw_of_equal_scores_and_third_of_rows_alike(spark):
    """Copies differ by their noise only; repeated ids tie and are ranked one after the other."""
    rows = [(i % 400, "one two three " * 8 if i % 3 else f"word{i} " * 25) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("two two",)], "text string")
    have, want = got(docs, target, R.Settings()), plain_resample(rows, ["two two"], R.Settings())
    assert [r[:5] for r in have] == [r[:5] for r in want]
    assert sorted(r[5] for r in have if r[5]) == list(range(1, 121))
    ranked = sorted((r for r in have if r[5]), key=lambda r: r[5])
    assert [(-r[4], r[0]) for r in ranked] == sorted((-r[4], r[0]) for r in have)[:120]


def test_empty_tables(spark):
    docs, none = frame(spark), frame(spark).limit(0)
    assert got(none, docs, R.Settings()) == []
    settings = replace(R.Settings(), min_words=5)
    assert got(docs, none, settings) == plain_resample([(r[0], r[1]) for r in awkward_rows()], [], settings)


def test_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    assert oracle.spark_result(R.op12_resampling(spark, sf_dir)) == oracle.duck_result(con, R.ORACLE)
