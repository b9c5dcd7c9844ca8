"""The folder that all executors share."""

from types import SimpleNamespace

import pytest

from linkmosaic.errors import InputError
from linkmosaic.sources import shared


def session(master, held=None):
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)), setCheckpointDir=lambda at: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: held), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,2,1024]", "k8s://host"])
def test_a_cluster_needs_the_setting(master):
    with pytest.raises(InputError):
        shared.shared_dir(session(master))
    assert shared.shared_dir(session(master, "hdfs://at/here/")) == "hdfs://at/here"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_process_gets_a_folder(master):
    assert shared.shared_dir(session(master)).startswith("file://")


def test_written_tables_can_be_discarded(spark):
    df = shared.materialize(spark.range(3), "t")
    assert df.count() == 3
    shared.discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._linkmosaic_path).count()
