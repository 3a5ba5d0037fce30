"""The content sort against a dictionary, with ordinary and sliced groups."""

import hashlib

import pytest

from tests import oracle
from tests.llm.data import frame
from visitwise.llm import exact


def plain(rows, keep="largest"):
    """One (doc_id, keep_id, group_size, kept, digest) per row; a null id is the smallest."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=keep == "largest")
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, order[0], len(ids), place == 0, digest) for place, i in enumerate(order)]
    return sorted(out, key=repr)


def got(docs, **more):
    return sorted(map(tuple, exact.duplicates(docs, **more).collect()), key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("slice_bytes", [exact.SLICE_BYTES, 200, 1])
def test_awkward_rows(spark, keep, slice_bytes):
    """Nulls, empties, long texts, repeated rows and clashing names; every group sliced, some, or none."""
    docs = frame(spark)
    docs = docs.toDF(*[{"key": "_id", "h": "_text", "gram": "_sha", "run": "_run"}.get(c, c) for c in docs.columns])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(docs, keep=keep, slice_bytes=slice_bytes) == plain(rows, keep)


def test_one_text_holds_a_third_of_the_rows(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(docs, slice_bytes=5000) == plain(rows)
    runs = exact.content_sort(docs.selectExpr("doc_id AS _id", "text AS _text"), "largest", 5000)
    slices = runs.where("_slice > 0").groupBy("_prefix", "_slice").count().collect()
    assert len(slices) > 10 and max(r["count"] for r in slices) < 200


def test_texts_of_one_digest_stay_apart(spark, monkeypatch):
    """A digest that collides sends unlike texts to one place; only the full comparison tells them apart."""
    monkeypatch.setattr(exact.F, "sha2", lambda c, bits: exact.F.substring(exact.F.md5(c), 1, 2))
    rows = [(i, f"same beginning of {i % 700}") for i in range(2000)] + [(None, "same beginning of 1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [r[:4] for r in plain(rows)]
    for size in (exact.SLICE_BYTES, 300):
        assert sorted((r[:4] for r in got(docs, slice_bytes=size)), key=repr) == sorted(want, key=repr)


def test_texts_differ_by_bytes_only(spark):
    """Case, white space, composed accents and bytes behind a long common beginning all count."""
    texts = ["a", "A", "a ", "é", "é", "x" * 5000, "x" * 5000 + "y", "", " ", "\x00", "\x00\x00"]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_empty_table_and_unknown_rule(spark):
    docs = frame(spark).limit(0)
    assert got(docs) == []
    with pytest.raises(ValueError):
        exact.duplicates(docs, keep="first")


def test_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    assert oracle.spark_result(exact.op11_exact(spark, sf_dir)) == oracle.duck_result(con, exact.ORACLE)


def test_whole_texts_are_exchanged_once(spark, sf_dir):
    """Only the range exchange carries the text; windows and aggregates behind it need no other one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.selectExpr("doc_id AS _id", "coalesce(text, '') AS _text")
    plan = exact.content_sort(rows, "largest", exact.SLICE_BYTES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert plan.count("Sort [") == 1 and "Python" not in plan and "Arrow" not in plan
