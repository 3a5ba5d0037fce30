"""The composite jobs, end to end on small files."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from visitwise.catalog import fixtures as T
from visitwise.operators import clustering as C
from visitwise.plans import cluster as K
from visitwise.plans.exploration import explore
from visitwise.plans.preprocess import preprocess
from visitwise.operators.words import word_count
from visitwise.sources import extracts as E

VISIT_FIELDS = [
    ("donor_id", "string"), ("donation_dt", "date"), ("site_zip", "string"), ("donation_type", "string"),
    ("first_donat_ind", "integer"), ("walk_in_ind", "integer"), ("deferral_ind", "integer"),
    ("sponsor_category", "string"), ("StateAbbr", "string"),
]
PERSON_FIELDS = [
    ("donor_id", "string"), ("birth_dt", "date"), ("race", "string"), ("gender", "string"), ("zip5c", "string"),
]


@pytest.fixture(scope="module")
def extracts(tmp_path_factory):
    root = tmp_path_factory.mktemp("extracts")
    rnd = random.Random(5)
    for name in ("visits", "persons", "schema"):
        (root / name).mkdir()
    for name, fields in (("states", VISIT_FIELDS), ("summary", PERSON_FIELDS)):
        doc = {"fields": [{"name": n, "type": t} for n, t in fields]}
        (root / "schema" / f"{name}_schema.json").write_text(json.dumps(doc))
    header = ",".join(n for n, _ in VISIT_FIELDS)
    visits = []
    for i in range(400):
        day = dt.date(1999, 6, 1) + dt.timedelta(rnd.randrange(900))
        visits.append(f" d{rnd.randrange(60)},{day},{rnd.choice(['123', '02139', 'NA'])},whole blood,{i % 2},1,0,school,MA")
    visits += [visits[0], "NA,2001-01-01,1,x,1,1,0,s,MA", "d1,2001-01-01,1"]
    (root / "visits" / "a.csv").write_text("\n".join([header, *visits[:200]]) + "\n")
    (root / "visits" / "b.csv").write_text("\n".join([header, *visits[200:]]) + "\n")
    persons = [f"d{i},{1950 + i % 50}/0{1 + i % 9}/10,{'none' if i % 4 == 0 else 'r'},f,0{i}" for i in range(50)]
    (root / "persons" / "p.csv").write_text("\n".join([",".join(n for n, _ in PERSON_FIELDS), *persons]) + "\n")
    return root


def run(spark, root, out, **more):
    return preprocess(spark, str(root / "visits"), str(root / "persons"), str(root / "schema"), str(out), **more)


def test_preprocess(spark, extracts, tmp_path):
    out = run(spark, extracts, tmp_path)
    rows = spark.read.parquet(out.data)
    assert rows.count() == 401
    assert {"birth_dt", "donation_order", "since_last_donation", "avg_elapse", "active", "age_bucket"} <= set(rows.columns)
    assert dict(rows.dtypes)["since_last_donation"] == "float"
    ordinals = rows.groupBy("donor_id").agg(
        F.max("donation_order").alias("m"), F.count("*").alias("n"), F.countDistinct("donation_order").alias("d")
    )
    assert ordinals.where("m <> n OR d <> n").count() == 0
    reasons = {(r["extract"], r["reject_reason"]) for r in spark.read.parquet(out.rejects).collect()}
    assert reasons == {("visits", "arity"), ("visits", "missing donor_id")}


def test_hot_persons_are_sliced_with_the_same_result(spark, extracts, tmp_path, monkeypatch):
    small = spark.read.parquet(run(spark, extracts, tmp_path / "small").data)
    monkeypatch.setattr("visitwise.operators.slices.ROWS_PER_SLICE", 5)
    large = spark.read.parquet(run(spark, extracts, tmp_path / "large").data)
    assert sorted(map(str, large.select(small.columns).collect())) == sorted(map(str, small.collect()))


def test_preprocess_sample(spark, extracts, tmp_path):
    out = run(spark, extracts, tmp_path, fraction=0.5, seed=3)
    assert out.data.endswith("0.5_3_sample_data")
    sample = spark.read.parquet(out.data)
    full = spark.read.parquet(run(spark, extracts, tmp_path / "full").data)
    kept = full.join(sample.select("donor_id").distinct(), "donor_id", "left_semi")
    assert 0 < sample.count() < full.count()
    assert sorted(map(str, kept.select(sample.columns).collect())) == sorted(map(str, sample.collect()))
    with pytest.raises(ValueError):
        run(spark, extracts, tmp_path, fraction=1.5)


def test_cluster_job(spark, extracts, tmp_path):
    out = run(spark, extracts, tmp_path)
    clusters = K.cluster_job(spark, out.data, 3, 10)
    again = K.cluster_job(spark, out.data, 3, 10)
    assert clusters.centers.count() == 3 * len(K.FEATURES)
    assert clusters.names[:3] == ["donation_year", "donation_season_index", "age_bucket_index"]
    assert clusters.wssse.first()["wssse"] == pytest.approx(again.wssse.first()["wssse"])


def test_sweep_job(spark, extracts, tmp_path):
    out = run(spark, extracts, tmp_path)
    K.sweep_job(spark, out.data, str(tmp_path / "sweep"), range(2, 4), 5)
    back = E.read_csv(spark, str(tmp_path / "sweep"))
    assert back.columns == ["K", "WSSSE", "Centers"] and {r["K"] for r in back.collect()} == {2, 3}


def test_weighted_vectors_cost_what_single_rows_cost(spark):
    df = spark.range(300).select(
        (F.col("id") % 7).cast("int").alias("a"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("b")
    )
    encoder, vectors = C.encode(df, ["a", "b"])
    model = C.fit(vectors, 4, 10)
    singles = encoder.assemble(df)
    centers = model.points
    cost = 0.0
    for row in singles.select("features").collect():
        cost += min(sum((x - c) ** 2 for x, c in zip(row["features"], center)) for center in centers)
    got = C.wssse(vectors, model).first()
    assert got["n_rows"] == 300 and got["wssse"] == pytest.approx(cost)


def test_sweep_has_one_row_per_k(spark):
    df = spark.range(200).select((F.col("id") % 40).cast("int").alias("a"), (F.col("id") % 3).cast("int").alias("b"))
    _, vectors = C.encode(df, ["a", "b"])
    rows = C.sweep(vectors, range(3, 6), 5).orderBy("k").collect()
    assert [r["k"] for r in rows] == [3, 4, 5]
    assert all(len(r["centers"].split(";")) == r["n_centers"] for r in rows)


def test_more_clusters_than_distinct_rows(spark):
    df = spark.range(100).select((F.col("id") % 4).cast("int").alias("a"))
    _, vectors = C.encode(df, ["a"])
    for k in (4, 15):
        found = C.fit(vectors, k, 5)
        assert found.points == [[0.0], [1.0], [2.0], [3.0]] and found.cost == 0 and found.n_centers == 4
    one = C.fit(vectors, 1, 5)
    assert one.points == [[1.5]] and one.cost == pytest.approx(125.0)


def test_clusters_of_one_or_no_row(spark):
    df = spark.range(9).select(F.lit(3).alias("a"))
    _, vectors = C.encode(df, ["a"])
    assert C.fit(vectors, 1, 5).points == [[3.0]] and C.fit(vectors, 5, 5).points == [[3.0]]
    with pytest.raises(ValueError):
        C.fit(C.encode(df.limit(0), ["a"])[1], 2, 5)


def test_fit_does_not_depend_on_the_layout(spark):
    df = spark.range(3000).select((F.col("id") % 97).cast("int").alias("a"), (F.col("id") % 31).cast("int").alias("b"))
    costs = [C.fit(C.encode(df.repartition(n), ["a", "b"])[1], 5, 10).cost for n in (1, 7)]
    assert costs[0] == pytest.approx(costs[1], rel=1e-9)


def test_label_order_is_that_of_the_string_indexer(spark):
    from pyspark.ml.feature import StringIndexer

    df = spark.createDataFrame([(x,) for x in "bbaacdde"] + [(None,)], "s string")
    encoder = C.Encoder.fit(C.combinations(df, ["s"]), ["s"])
    want = StringIndexer(inputCol="s", outputCol="i").fit(C.fill_labels(df, ["s"])).labels
    got = encoder.ranks.orderBy("rank").collect()
    assert [r["label"] for r in got] == list(want) and [r["rank"] for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0][: len(got)]


def test_explore(spark, sf_dir, tmp_path):
    persons = T.persons(spark, sf_dir).drop("nation_key")
    report = explore(T.visits(spark, sf_dir), persons, T.WHOLE_TYPE)
    assert report["table_shape"].first()["n_rows"] == T.visits(spark, sf_dir).count()
    assert "age_at_donation" in report["early_return_preview"].columns
    assert report["early_returns"].count() == report["early_return_count"].first()["n"]
    assert report["early_return_ids"].count() == report["early_returns"].select("donor_id").distinct().count()
    total = report["hist_lapse_years"].agg(F.sum("n")).first()[0]
    assert total == report["lapse_years_all"].count()
    path = str(tmp_path / "missing")
    E.write_csv(report["missing_values"], path)
    assert E.read_csv(spark, path).count() == len(T.visits(spark, sf_dir).columns) + len(persons.columns) - 1
    for name in ("deferred_head", "lapse_preview", "early_return_preview"):
        assert report[name].count() in (5, 8, 10)


def test_word_count_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.txt").write_text("a b  a\n\n  \nb \n")
    counts = word_count(E.read_lines(spark, str(tmp_path / "in")))
    counts.select(F.concat_ws("\t", "word", "cnt").alias("value")).write.text(str(tmp_path / "out"))
    got = dict(r["value"].split("\t") for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == {"a": "2", "b": "2", "": "2"}


def test_csv_with_inferred_types(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 2.5, None)], "s string, i int, d double, n string")
    E.write_csv(df, str(tmp_path / "c"))
    back = E.read_csv(spark, str(tmp_path / "c"))
    assert dict(back.dtypes)["i"] == "int" and dict(back.dtypes)["d"] == "double"
    assert tuple(back.first()) == ("x", 1, 2.5, None)


def test_views(spark):
    E.register_views(named_rows=spark.range(3))
    assert spark.sql("SELECT count(*) AS n FROM named_rows").first()["n"] == 3
