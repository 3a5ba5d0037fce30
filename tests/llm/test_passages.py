"""Repeated paragraphs against a plain version of the cut, and passages in every surrounding."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm import data, plain
from tests.llm.data import frame
from visitwise.llm import passages as P
from visitwise.llm import words


def runs_of(text, cutter):
    """(first word, words, shingle set) of the paragraphs, one text at a time."""
    words = plain.lower(text).encode("utf-8", "surrogatepass").split()
    codes = [cutter.known[w] for w in words]
    s, out, begin = cutter.settings, [], 0
    marks = []
    for i in range(1, len(words)):
        pair = P.mix(np.array([codes[i]], dtype=np.uint64) ^ P.mix(np.array([codes[i - 1]], dtype=np.uint64)))[0]
        if int(pair) % s.cut == 0:
            marks.append(i + 1)
    while begin < len(words):
        ends = [m for m in marks if m >= begin + s.least] + [len(words)]
        end = min(ends[0], begin + s.most)
        if end - begin >= s.least:
            grams = {tuple(words[i : i + s.shingle]) for i in range(begin, end - s.shingle + 1)}
            out.append((begin, end - begin, tuple(words[begin:end]), grams))
        begin = end
    return out


def plain_spans(rows, settings):
    """Spans by comparing all pairs of paragraphs; repeated rows are one document."""
    cutter = P.Cutter(settings)
    units = [
        (i, text, word, n, words, grams)
        for i, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}, key=repr)
        for word, n, words, grams in runs_of(text, cutter)
    ]
    sets = plain.Sets(len(units))
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a[4] == b[4] or len(a[5] & b[5]) >= settings.similarity * len(a[5] | b[5]):
                sets.join(i, j)
    return units, [sets.find(i) for i in range(len(units))]


def test_cut_is_that_of_single_texts():
    """Texts taken together are cut as they are alone; every word lies in one run."""
    rng = random.Random(1)
    texts = [data.prose(rng, rng.choice([0, 1, 3, 7, 30, 200])) for _ in range(60)] + [None, "A a B b " * 30, "one"]
    for block in (1, 50, 10**6):
        cutter = P.Cutter(P.Settings(block_words=block))
        got = [[] for _ in texts]
        for first, units in cutter.blocks(pa.array(texts, pa.string())):
            for i in range(len(units.text)):
                grams = cutter.shingle_set(units, i)
                got[first + units.text[i]].append((int(units.word[i]), int(units.words[i]), len(grams)))
        assert got == [[(w, n, len(g)) for w, n, _, g in runs_of(t or "", cutter)] for t in texts]


@pytest.mark.parametrize("settings", [P.Settings(), P.Settings(block=2, block_words=100, memo_words=5, filter_bits=18)])
def test_spans(spark, settings):
    """Every paragraph that is not the first of its class goes, and no other one."""
    docs = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    units, classes = plain_spans([r for r in rows if len(r[1] or "") < 20_000], settings)
    small = docs.where("text is null or length(text) < 20000")
    got = {(r["doc_id"], s["word"], s["words"]) for r in P.repeated_spans(small, settings).collect() for s in r["spans"]}
    by_class = {}
    for unit, c in zip(units, classes):
        by_class.setdefault(c, []).append(unit[:4])
    want = set()
    for members in by_class.values():
        # Two texts of one id are ordered by a hash; only their first may differ.
        if len({(m[0], m[2]) for m in members}) == len(members):
            want |= {(m[0], m[2], m[3]) for m in sorted(members, key=lambda m: (m[0], m[2]))[1:]}
    assert want and got == want


def test_passages_in_any_surrounding(spark):
    rng = random.Random(5)
    passage = data.prose(rng, 80).split()
    wrapped = "\n".join(" ".join(passage[i : i + 11]) for i in range(0, 80, 11))
    listed = "\n\n".join(" ".join(passage[i : i + 4]) for i in range(0, 80, 4))
    around = [data.prose(rng, 40) for _ in range(10)]
    texts = [
        around[0] + " " + " ".join(passage) + " " + around[1],
        around[2] + "\n" + wrapped + "\n" + around[3],
        around[4] + "\n\n" + listed + "\n\n" + around[5],
        around[6] + " " + " ".join(passage).replace(passage[40], "other", 1) + " " + around[7],
        around[8] + " " + around[9],
    ]
    docs = spark.createDataFrame([(i, t, len(t), "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, _doc string, _cut string")
    left = P.remove_repeated(docs)
    assert left.columns == docs.columns
    got = {r["doc_id"]: r for r in left.collect()}
    assert got[0]["text"] == texts[0] and got[4]["text"] == texts[4]
    for i in (1, 2, 3):
        stays = [w for w in got[i]["text"].split() if w in passage]
        assert len(got[i]["text"].split()) < 80 + 45 and got[i]["n_chars"] == len(got[i]["text"])
        for part in (around[2 * i], around[2 * i + 1]):
            assert set(part.split()) - set(passage) <= set(got[i]["text"].split()), stays


def test_empty_null_repeated_and_awkward_rows(spark):
    docs = frame(spark)
    left = P.remove_repeated(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    before = {(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is None or not r["text"]}
    assert before <= {(r["doc_id"], r["text"]) for r in left.collect()}
    again = left.collect()
    assert len([r for r in again if r["doc_id"] == 7]) == 2 and len({r["text"] for r in again if r["doc_id"] == 7}) == 1
    assert P.remove_repeated(docs.limit(0)).count() == 0


def test_word_hashes_are_those_of_single_words():
    rng = random.Random(8)
    texts = [None, "", " \t", "a", "no end", "\x0bÀÉ Zz\x0c@[`{\x1c字", *(" ".join("Q" * rng.randrange(1, 70) for _ in range(80)) for _ in range(20))]
    texts += ["".join(rng.choice("aBz9é字\t\n @[Z`\x85") for _ in range(rng.randrange(200))) for _ in range(100)]
    for array in (pa.array(texts, pa.string()), pa.array(["x", *texts, "y"], pa.large_string())[1:-1]):
        raw, ends = words.utf8(array)
        first, lengths, sizes = words.places(raw, ends)
        got = words.xxh64(words.lowered(raw), first, lengths, xxhash.xxh64_intdigest)
        want = [(t or "").encode("utf-8").lower().split() for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        assert got.tolist() == [xxhash.xxh64_intdigest(w) for ws in want for w in ws]


def common_phrases(n):
    """Texts of a few phrases, each between words of the text's own."""
    rng = random.Random(9)
    phrases = [data.prose(rng, 7) for _ in range(3)]
    own = lambda: " ".join(f"{rng.getrandbits(40):x}" for _ in range(rng.randrange(4, 12)))
    return [(i, f"{own()} {rng.choice(phrases)} {own()} {rng.choice(phrases)} {own()}") for i in range(n)]


def test_paragraphs_around_a_common_phrase_do_not_all_meet(spark):
    """Paragraphs that share a phrase and little else were compared each with each."""
    rows = common_phrases(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    settings = P.Settings()
    units = P.repeated_units(docs, P.shared_keys(docs, settings), settings)
    sets = units.where("keys is not null").groupBy("pid").agg({"keys": "first", "shingles": "first"}).toDF("pid", "keys", "shingles")
    largest = lambda groups, *by: groups.groupBy(*by).count().selectExpr("coalesce(max(count), 0)").first()[0]
    by_key = largest(sets.selectExpr("explode(keys) key"), "key")
    met = largest(P.candidate_groups(sets, settings), "key", "i", "j")
    assert by_key > 40 and met < by_key / 4, (by_key, met)
    found, classes = plain_spans(rows, settings)
    firsts = {}
    for unit, c in sorted(zip(found, classes), key=lambda x: (x[0][0], x[0][2])):
        firsts.setdefault(c, unit)
    want = {(u[0], u[2], u[3]) for u, c in zip(found, classes) if firsts[c] is not u}
    got = {(r["doc_id"], s["word"], s["words"]) for r in P.repeated_spans(docs, settings).collect() for s in r["spans"]}
    assert got == want


def test_few_and_many_members_are_connected_alike():
    rng = np.random.default_rng(4)
    for count in (2, 9, P.FEW, P.FEW + 1, 150):
        pool = [np.unique(rng.integers(0, 60, 12).astype(np.uint64)) for _ in range(count // 4 + 1)]
        sets = [np.unique(np.append(pool[rng.integers(len(pool))][: rng.integers(8, 13)], np.uint64(rng.integers(60)))) for _ in range(count)]
        links = P.connected([s.tobytes() for s in sets], 0.8)
        got, want = plain.Sets(count), plain.Sets(count)
        for i, j in links:
            got.join(i, j)
        for i in range(count):
            for j in range(i):
                if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                    want.join(i, j)
        same = [[x.find(i) == x.find(j) for i in range(count) for j in range(i)] for x in (got, want)]
        assert same[0] == same[1] and len(links) == count - len({want.find(i) for i in range(count)})


def test_filter_grows_with_its_values(spark):
    """Every value is found, and few others, however many there are."""
    marks = P.Marks(spark.range(20_000).selectExpr("xxhash64(id) v"), "v", 20_000, 10)
    held = spark.range(20_000).selectExpr("xxhash64(id) v").toArrow()["v"].to_numpy().view(np.uint64)
    other = spark.range(50_000, 90_000).selectExpr("xxhash64(id) v").toArrow()["v"].to_numpy().view(np.uint64)
    assert marks.has(held).all() and marks.has(other).mean() < 0.03
    assert marks.has(held.reshape(-1, 4)).shape == (5000, 4)
