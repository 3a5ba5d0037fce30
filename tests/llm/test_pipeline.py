"""The pipeline against a chain of plain stages, on the test tables, awkward rows and empty tables."""

import hashlib
import random
from collections import Counter

import pytest
import tiktoken

import corpus_pipeline
from tests.llm import data, plain
from tests.llm.test_mixing import reshared
from tests.llm.test_passages import plain_spans
from visitwise.llm import bpe, mixing, passages, quality, simhash
from visitwise.llm.paragraphs import cut_words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_near(rows):
    """One row of each class: the smallest id, rows of one id and class in any order."""
    values = plain.simhash_classes([r[:2] for r in rows])
    best = {}
    prints = [int(values[r[:2]][0], 16) for r in rows]
    sets = plain.Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                sets.join(i, j)
    for i, r in enumerate(rows):
        best.setdefault(sets.find(i), []).append(r)
    return [sorted(found, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))[0] for found in best.values()]


def plain_passages(rows):
    settings = passages.Settings()
    units, classes = plain_spans([r[:2] for r in rows], settings)
    first, gone = {}, {}
    for unit, c in sorted(zip(units, classes), key=lambda p: (p[0][0], p[0][2])):
        if first.setdefault(c, unit) is not unit:
            gone.setdefault(unit[:2], []).append((unit[2], unit[3]))
    out = []
    for r in rows:
        spans = sorted(gone.get(r[:2], []))
        text, cut = cut_words(r[1], spans, 1) if spans else (r[1], 0)
        out.append((r[0], text, r[2], r[3], len(text) if cut else r[4]))
    return out


def plain_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(plain.words(r[1]))
    targets, out = reshared(sizes), []
    for r in rows:
        rate = targets[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        digits = hashlib.md5(f"{'null' if r[0] is None else r[0]}:{mixing.SEED}".encode()).hexdigest()[: mixing.DIGITS]
        out += [r] * (int(rate) + (int(digits, 16) / 16**mixing.DIGITS < rate - int(rate)))
    return out


def plain_codes(rows):
    vocabulary = bpe.Vocabulary.load()
    codec = tiktoken.Encoding("plain", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    return Counter((r[0], tuple(codec.encode_ordinary(r[1] or ""))) for r in rows)


def saved(spark, folder, rows, labels):
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def chained(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = [r for r in rows if net is None or net.score(r[1]) >= net.settings.threshold]
    return plain_codes(plain_mix(plain_passages(plain_near(kept))))


def found(spark, sf_dir):
    return Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect())


def test_stages_follow_the_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "paragraphs", "mixing", "encoding"]


def test_awkward_rows(spark, tmp_path):
    """Nulls, empties, copies, repeated rows and ids; nothing is learned, so every document passes the first stage."""
    # The passages' plain version orders texts of one id by themselves; here such texts have no common passage.
    rows = [r[:5] for r in data.awkward_rows() if len(r[1] or "") < 20_000]
    rows += [(2, "a text of its own " * 3, "en", "s1", 9), (2, rows[10][1], "en", "s1", 9), (None, rows[10][1], None, None, None)]
    sf_dir = saved(spark, tmp_path, rows, [(None, 1, 0), (3, None, 0)])
    assert found(spark, sf_dir) == chained(spark, sf_dir, rows)


def test_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[c.split()[0] for c in COLUMNS.split(", ")])
    rows = [tuple(r) for r in docs.collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    own = saved(spark, tmp_path, rows, labels)
    got = found(spark, own)
    assert got == chained(spark, own, rows) and len(got) > len(rows) / 4


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, saved(spark, tmp_path, [], [])).count() == 0


def test_filter_stages_keep_columns_and_choose_alike(spark):
    """An id with a unique text and with a copy of another document keeps the unique one, in any input order."""
    rows = [(1, data.prose(random.Random(1), 60), "x"), (2, data.prose(random.Random(2), 60), "y")]
    rows.append((2, rows[0][1], "z"))
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, _text_mark string").coalesce(1)
        kept = sorted(map(tuple, simhash.drop_near_duplicates(docs).collect()))
        assert kept == sorted(rows[:2])


def test_quality_filter_keeps_columns(spark):
    docs = data.frame(spark)
    net = quality.Network(quality.Settings(threshold=0.5))
    kept = quality.keep_accepted(docs, net)
    assert kept.columns == docs.columns
    want = Counter(tuple(r) for r in docs.collect() if net.score(r["text"]) >= 0.5)
    assert Counter(map(tuple, kept.collect())) == want
    assert quality.keep_accepted(docs, None).count() == docs.count()


@pytest.mark.parametrize("text", ["", None, "abc"])
def test_scores_are_probabilities(text):
    assert 0 <= quality.Network(quality.Settings()).score(text) <= 1
