"""Operators against plain versions: the test tables, and documents with every awkward case."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm import data, plain
from visitwise.llm import bpe, neighbours, paragraphs, repetition, simhash, suffixes
from visitwise.llm.common import table
from visitwise.llm.catalog import QUERIES


@pytest.fixture(scope="module")
def awkward(spark):
    return data.frame(spark)


@pytest.fixture(scope="module", params=["tables", "awkward"])
def docs(request, spark, sf_dir):
    return table(spark, sf_dir, "documents") if request.param == "tables" else data.frame(spark)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_repetition(spark, docs):
    texts = [r["text"] for r in docs.select("text").collect()]
    numbered = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repetition.repetition_rules(numbered).collect()
    assert len(got) == len(texts)
    for row in got:
        assert tuple(row)[1:7] == plain.base_counts(texts[row["doc_id"]])
        assert not (row["base_failed"] and row["kept"])
    assert repetition.repetition_rules(docs).count() == len(texts)


def test_rolling_hash_finds_all_repeats():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 4, 400)
    for n in (2, 3, 5, 8):
        grams = [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)]
        repeated, later = repetition.RollingHash(ids).repeats(n)
        assert repeated.tolist() == [i for i, g in enumerate(grams) if grams.count(g) > 1]
        assert sorted(later.tolist()) == [i for i, g in enumerate(grams) if g in grams[:i]]


def test_simhash(docs):
    rows = rows_of(docs)
    want = plain.simhash_classes(rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    known = {}
    for (doc, _), value in want.items():
        known.setdefault(doc, set()).add(value)
    assert all((r["fingerprint"], r["component_id"]) in known[r["doc_id"]] for r in got)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    stay = {v[1] for v in want.values()} - {None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(stay)


@pytest.mark.parametrize("leading", [0, 5, 9])
def test_collisions_find_every_near_pair(leading):
    rng = np.random.default_rng(leading)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 1, 2, 3, 4, 5)]
    prints = np.unique(np.concatenate([centres ^ f for f in flips]))
    found = set()
    for prefix in range(1 << leading):
        near = prints
        if leading:
            near = prints[np.bitwise_count((prints >> np.uint64(64 - leading)) ^ np.uint64(prefix)) <= 2]
        a, b = simhash.collisions(prefix, leading, near, 2)
        found |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    sets = plain.Sets(len(prints))
    place = {int(p): i for i, p in enumerate(prints)}
    for a, b in found:
        assert (a ^ b).bit_count() <= 4
        sets.join(place[a], place[b])
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints ^ p) <= 4):
            assert sets.find(i) == sets.find(int(j))


def check_paragraphs(docs, settings):
    rows = rows_of(docs)
    want = plain.paragraph_removals(rows)
    got = {
        r["doc_id"]: {x["line"]: x["first_doc"] for x in r["removed"]}
        for r in paragraphs.repeated_paragraphs(docs, settings).collect()
    }
    assert got == dict(want)
    left = paragraphs.remove_repeated_paragraphs(docs, settings)
    assert left.columns == docs.columns
    expected = []
    for doc, text in rows:
        gone = want.get(doc, {})
        expected.append((doc, text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)))
    assert sorted(rows_of(left), key=repr) == sorted(expected, key=repr)


def test_paragraphs(docs):
    check_paragraphs(docs, paragraphs.Settings())


def test_paragraph_blocks(spark, sf_dir):
    check_paragraphs(table(spark, sf_dir, "documents"), paragraphs.Settings(block=2, seen_paragraphs=5))


def repeated_words(rows, length=50):
    """Words inside windows of ``length`` words that stand earlier, in order of the documents."""
    seen, n = set(), 0
    for _, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        w, inside = plain.words(plain.lower(text)), set()
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                inside.update(range(i, i + length))
            seen.add(window)
        n += len(inside)
    return n


def test_passages_in_short_and_long_lines(spark):
    rng = random.Random(5)
    passage = data.prose(rng, 80).split()
    wrapped = "\n".join(" ".join(passage[i : i + 11]) for i in range(0, 80, 11))
    listed = "\n\n".join(" ".join(passage[i : i + 4]) for i in range(0, 80, 4))
    long = [data.prose(rng, 200) for _ in range(4)]
    lone = data.prose(rng, 9)
    texts = [
        long[0] + " " + " ".join(passage) + " " + long[1],
        wrapped,
        wrapped.replace(passage[40], "other", 1),
        listed,
        long[2] + " " + " ".join(passage) + " " + long[3],
        lone + "\n\n" + data.prose(rng, 30),
        lone + "\n\n" + data.prose(rng, 30),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = dict(rows_of(paragraphs.remove_repeated_passages(docs)))
    assert left[0] == texts[0]
    # A passage loses all but its ends, where its first and last pieces differ; short lines that recur alone stay.
    assert [len(left[i].split()) <= 40 for i in (1, 2, 3)] == [True] * 3
    assert 400 <= len(left[4].split()) <= 440 and left[4].startswith(long[2][:200]) and left[4].endswith(long[3][-200:])
    assert (left[5], left[6]) == (texts[5], texts[6])
    # What is cut stands elsewhere: no piece is lost with its last copy.
    lines = dict(rows_of(paragraphs.remove_repeated_paragraphs(docs, paragraphs.WHOLE)))
    kept = " | ".join(" ".join(t.lower().split()) for t in left.values())
    for before in lines.values():
        words = before.lower().split()
        assert all(" ".join(words[a : a + n]) in kept for a, n, _ in paragraphs.Shingler(paragraphs.WHOLE).pieces(before))


def test_no_passage_stays(spark, docs):
    rows = rows_of(docs)
    left = paragraphs.remove_repeated_passages(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    kept = rows_of(left)
    assert repeated_words(kept) <= 0.1 * repeated_words(rows)


def test_similar_connects_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1000, 60)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 1000, 3)])).astype(np.uint64) for _ in range(40)]
    got, want = plain.Sets(40), plain.Sets(40)
    for i, j, s in paragraphs.similar(sets, 0.8):
        assert s >= 0.8
        got.join(i, j)
    for i in range(40):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                want.join(i, j)
    assert [got.find(i) for i in range(40)] == [want.find(i) for i in range(40)]


SUFFIX_SETTINGS = [
    suffixes.Settings(),
    suffixes.Settings(run_bytes=40_000, hot_rows=3),
    suffixes.Settings(run_bytes=60_000, hot_rows=0),
]


@pytest.mark.parametrize("settings", SUFFIX_SETTINGS)
def test_suffixes(docs, settings):
    want = plain.byte_removals(rows_of(docs))
    known = {}
    for (doc, _), value in want.items():
        known.setdefault(doc, set()).add(value)
    left = suffixes.remove_repeated_bytes(docs, settings)
    got = left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert len(got) == docs.count()
    # Two documents without an id have no order of their own; only their totals are fixed.
    assert all(tuple(r)[1:] in known[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_loser_tree_merges_and_knows_prefixes():
    rng = np.random.default_rng(2)
    runs = []
    for size in (0, 1, 7, 40, 3):
        runs.append(sorted(bytes(rng.integers(97, 99, 12).tolist()) for _ in range(size)))
    shared = [[0 if i == 0 else common(run[i - 1], run[i]) for i in range(len(run))] for run in runs]
    who, number, prefix = suffixes.merge(runs, shared)
    out = [runs[r][i] for r, i in zip(who, number)]
    assert out == sorted(sum(runs, []))
    assert prefix[1:] == [common(a, b) for a, b in zip(out, out[1:])]


def common(a, b):
    return next((i for i in range(len(a)) if a[i] != b[i]), len(a))


def test_anchors_of_long_texts_match_short_ones(monkeypatch):
    raw = np.random.default_rng(3).integers(97, 100, 5000).astype(np.uint8)
    whole = suffixes.Anchors(suffixes.Settings()).find(raw)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[1], whole[2])])
    assert starts.tolist() == list(range(len(raw) - 99))


def test_bpe(docs):
    vocabulary = bpe.Vocabulary.load()
    plain_bpe = tiktoken.Encoding("plain", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = {}
    for doc, text in rows_of(docs):
        texts.setdefault(doc, set()).add(tuple(plain_bpe.encode_ordinary(text or "")))
    # A dictionary of few words, so that folding inside documents is met as well.
    few = bpe.Settings(dictionary_words=200)
    rows = bpe.decode(bpe.encode(docs, vocabulary, few), vocabulary).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert tuple(row["ids"]) in texts[row["doc_id"]]
        assert bytes(row["data"]) == plain_bpe.decode_bytes(list(row["ids"]))
    for row in bpe.encode(docs, vocabulary, few, bpe.Encoded(data=True, digests=True)).collect():
        assert row["decoded_sha256"] == hashlib.sha256(row["data"]).hexdigest()
        assert bytes(row["data"]) == plain_bpe.decode_bytes(row["ids"]) and row["n_tokens"] == len(row["ids"])
        digests = {hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest() for ids in texts[row["doc_id"]]}
        assert row["ids_sha256"] in digests


def test_bpe_parts_keep_the_matches():
    cutter = bpe.Cutter(bpe.Vocabulary.load().pattern)
    rng = np.random.default_rng(5)
    signs = ["a", "É", "7", "'s", "-", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000", "\u0301", "\U0001f600"]
    for size in [0, 1, 2, 3] * 300 + [40] * 1500:
        text = "".join(rng.choice(signs, size))
        head, later = cutter.parts(text)
        assert cutter.find(head) + [word for part in later for word in cutter.matches(part)] == cutter.find(text)
    other = bpe.Cutter(r"\S+ \S+|\s+|\S+")
    assert other.parts("a b c d") == ("a b c d", [])


def test_bpe_fold_and_long_words(spark):
    vocabulary = bpe.Vocabulary.load()
    plain_bpe = tiktoken.Encoding("plain", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = np.random.default_rng(8)
    words = ["a", "é", "aa", "東京", "\U0001f600\U0001f600"]
    words += ["".join(rng.choice(list(letters), n)) for letters in ("a", "ab", "etaoinshrdluéß東") for n in (2, 5, 17, 80, 240, 300)]
    docs = spark.createDataFrame(list(enumerate(words + [" ".join(words)])), "doc_id long, text string")
    for few in (bpe.Settings(dictionary_words=0), bpe.Settings(fold_bytes=8), bpe.Settings(remembered_parts=2)):
        for row in bpe.encode(docs, vocabulary, few).join(docs, "doc_id").collect():
            assert row["ids"] == plain_bpe.encode_ordinary(row["text"])


def test_bpe_long_matches():
    vocabulary = bpe.Vocabulary.load()
    plain_bpe = tiktoken.Encoding("plain", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = np.random.default_rng(6)
    for size in (1, 2, 65, 400, 3000):
        for letters in ("a", "ab", "etaoinshrdluéß"):
            word = "".join(rng.choice(list(letters), size))
            assert vocabulary.merge_long(word.encode()) == plain_bpe.encode_ordinary(word)


def brute_neighbours(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def test_neighbours_recall(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    want = brute_neighbours(rows)
    got = {}
    for r in QUERIES["op5_neighbours"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and len(found) == 20


def test_neighbours_awkward(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(50)] + [(i, rows[i][1]) for i in range(5)]
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(280, []), (300, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (320, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # Probing every slot makes the search exact, and buckets of 7 rows are split.
    settings = neighbours.Settings(projections=2, probes=9, width=4.0, bucket_rows=7, region_rows=50)
    good = list({i: v for i, v in rows[:110]}.items())
    want = brute_neighbours(good)
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, 20, settings).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [v for v, _ in found] for q, found in got.items()} == {q: [v for v, _ in found] for q, found in want.items()}
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def unit_vectors(rng, count):
    x = rng.normal(size=(count, 64))
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]).tolist()


@pytest.mark.parametrize("count", [15, 400])
def test_neighbours_are_completed(spark, count):
    """Every query gets all of its k rows, with few vectors and beside one that is far longer than the others."""
    rng = np.random.default_rng(count)
    x = unit_vectors(rng, count)
    x[7] = (100 * np.array(x[7])).tolist()
    rows = list(enumerate(x))
    want = brute_neighbours(rows)
    got = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # Few probes leave nearly every query short; the scan that completes them is exact.
    settings = neighbours.Settings(tables=1, probes=1)
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, 20, settings).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {q: len(found) for q, found in got.items()} == {q: min(20, count - 1) for q in want}
    if count == 15:
        assert got == {q: [v for v, _ in found] for q, found in want.items()}


def test_norm_bands_keep_recall(spark):
    rng = np.random.default_rng(8)
    x = unit_vectors(rng, 1000)
    rows = list(enumerate(x)) + [(1001, (100 * np.array(x[0])).tolist())]
    want = brute_neighbours(rows)
    got = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(got.get(q, ())) == 20 for q in want)
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def held(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def test_language_accuracy(spark, sf_dir):
    rows = QUERIES["op2_language"](spark, sf_dir).join(table(spark, sf_dir, "documents"), "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    unseen = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert np.mean(unseen) > 0.9


def test_quality_accuracy(spark, sf_dir):
    rows = QUERIES["op8_quality"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    unseen = [r["predicted"] == r["quality"] for r in rows if r["held_out"]]
    assert np.mean(unseen) > 0.85


@pytest.mark.parametrize("name", ["doc_id", "text"])
def test_models_survive_awkward_documents(spark, awkward, name):
    from visitwise.llm import language, quality

    broken = awkward.withColumn(name, F.lit(None).cast(dict(awkward.dtypes)[name]))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(24)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for docs_ in (awkward, broken, awkward.limit(0)):
        found = language.language_codes(docs_)
        assert found.count() == docs_.count()
        bad = found.where("score < 0 OR score > 1 OR lang_pred IS NULL").count()
        scored = quality.quality_scores(docs_, labels)
        assert bad == 0 and scored.where("score IS NULL OR held_out IS NULL").count() == 0
        assert scored.count() == docs_.count()


def test_empty_tables(awkward):
    empty = awkward.limit(0)
    vocabulary = bpe.Vocabulary.load()
    assert repetition.repetition_rules(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert paragraphs.remove_repeated_paragraphs(empty).count() == 0
    assert suffixes.remove_repeated_bytes(empty).count() == 0
    assert bpe.encode(empty, vocabulary).count() == 0
