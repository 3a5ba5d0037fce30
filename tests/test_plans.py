"""What the plans must and must not contain."""

import re

import pytest

from visitwise.catalog import clusters, ingest, jobs, reports, visits  # noqa: F401
from visitwise.catalog.registry import QUERIES
from visitwise.operators.histories import Histories, Keys
from visitwise.sources import workspace

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")
# These fit while the plan is built; their fits are tested in test_kmeans.py.
ITERATIVE = {
    "kmeans_one", "kmeans_every_point", "kmeans_centers", "kmeans_wssse", "kmeans_sweep", "kmeans_fixed_point",
    "kmeans_sweep_fixed_points", "kmeans_members", "cluster_job", "sweep_job",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan(df))


@pytest.fixture
def no_broadcast(spark):
    """Joins planned as they would be between large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ITERATIVE))
def test_no_python_rows_and_no_cross_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in text]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("donation_order", 1),
        ("donation_lapse", 1),
        ("donor_frequency", 1),
        ("donor_frequency_join", 1),
        ("early_return_donors", 1),
        ("whole_blood_lapse", 1),
        ("join_summary", 2),
        ("first_donation_age", 2),
        ("word_count", 1),
        ("ingest_clean", 0),
    ],
)
def test_number_of_exchanges(spark, sf_dir, no_broadcast, name, expected):
    assert len(exchanges(QUERIES[name](spark, sf_dir))) == expected


def test_enriched_exchanges_visits_and_persons_once(spark, sf_dir, no_broadcast):
    # Two more belong to the small nation table, which is broadcast by default.
    assert len(exchanges(QUERIES["donor_enriched"](spark, sf_dir))) == 4


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(QUERIES["donor_frequency"](spark, sf_dir))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["o_custkey:bigint,o_orderdate:timestamp_ntz"]


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["whole_blood_lapse"](spark, sf_dir))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text


def test_no_window_runs_over_a_whole_hot_person(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    hot = Histories.of(events, Keys("user_id", "ts", "event_id"), 2)
    assert hot.base is not None
    table = hot.number("nth", "gap").rows
    # The window over the visits is partitioned by person and slice.
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(user_id#\d+L, _slice#\d+", plan(table))


class Session:
    """A session with the given checkpoint settings, over the real one."""

    def __init__(self, named, context_dir, master="local[2]"):
        self.conf, self.sparkContext = self, self
        self.named, self.context_dir, self.master = named, context_dir, master

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.named or default

    def getCheckpointDir(self):
        return self.context_dir

    def setCheckpointDir(self, folder):
        self.context_dir = folder


def test_shared_folder_is_the_one_in_the_session():
    assert workspace.shared_dir(Session("hdfs:///named", "hdfs:///context")) == "hdfs:///named"
    assert workspace.shared_dir(Session(None, "hdfs:///context")) == "hdfs:///context"
    own = Session(None, None)
    assert workspace.shared_dir(own) == workspace.shared_dir(own) == own.context_dir
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session(None, None, "yarn"))


def test_staged_rows_have_a_stable_unique_id(spark):
    staged = workspace.stage(spark.range(100), "ten", row_id="row")
    assert f"{workspace.shared_dir(spark)}/ten-" in staged.inputFiles()[0]
    assert staged.select("row").distinct().count() == 100
    assert sorted(map(str, staged.collect())) == sorted(map(str, staged.repartition(3).collect()))
