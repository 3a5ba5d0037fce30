"""Row numbers of a global order."""

from pyspark.sql import functions as F

from visitwise.operators.ordering import numbered


def test_numbers_follow_the_order(spark):
    rows = [((i * 7919) % 1009, None if i % 10 == 0 else f"k{i % 3}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, _Part string, _start int").repartition(9)
    got = numbered(df, F.desc("a"), F.col("_part").asc_nulls_first(), "_start", name="n").orderBy("n").collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or "", r[2]))
    assert [tuple(r)[:3] for r in got] == want and [r["n"] for r in got] == list(range(1, 2001))


def test_a_key_of_most_rows_is_cut(spark):
    """The tie lets the sort cut inside a key that holds nearly all rows; several files, one numbering."""
    df = spark.range(200_000, numPartitions=4).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
    got = numbered(df, "k", "i")
    assert got.where("rank <> i + 1").count() == 0


def test_empty(spark):
    assert numbered(spark.range(0), "id").collect() == []


def test_files_of_few_rows(spark):
    """A limit on the rows of a file does not split a task's file."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        assert numbered(spark.range(500, numPartitions=3), F.desc("id")).where("rank <> 500 - id").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
