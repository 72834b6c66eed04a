"""Where intermediate tables go."""

import pytest

from loomgrid import session
from loomgrid.sources.tables import spread_scan


class Conf:
    def get(self, name, default=None):
        return default


class Context:
    def __init__(self, master):
        self.master, self.folder, self.applicationId = master, None, "app"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master):
        self.conf, self.sparkContext = Conf(), Context(master)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(master))


def test_a_local_session_gets_a_folder_once():
    local = Session("local[2]")
    assert session.shared_folder(local) == session.shared_folder(local) == local.sparkContext.folder


def test_written_tables_lie_in_one_folder_and_can_be_dropped(spark):
    rows = session.written_table(spark.range(5))
    assert session.run_folder(spark) in rows.inputFiles()[0] and rows.count() == 5
    assert session.drop_tables(spark)


def test_scans_of_few_splits_are_dealt_to_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(8 * cores).write.parquet(f"{tmp_path}/many")
    spark.range(0).write.parquet(f"{tmp_path}/none")
    one = spread_scan(spark.read.parquet(f"{tmp_path}/one"))
    assert one.rdd.getNumPartitions() == cores or cores == 1
    assert sorted(r.id for r in one.collect()) == list(range(100))
    many = spark.read.parquet(f"{tmp_path}/many")
    assert spread_scan(many) is many
    assert spread_scan(spark.read.parquet(f"{tmp_path}/none")).collect() == []
