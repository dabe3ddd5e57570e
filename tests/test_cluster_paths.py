"""Where intermediate tables are written."""

from types import SimpleNamespace

import pytest

from driftloom.plans.lineage import ensure_checkpoint_dir


def session(master, configured=None, current=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: current, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: configured)), made


def test_a_cluster_needs_a_shared_folder():
    spark, made = session("spark://host:7077")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(spark)
    assert not made


def test_the_configured_folder_comes_first():
    spark, made = session("spark://host:7077", configured="/shared/x")
    assert ensure_checkpoint_dir(spark) == "/shared/x" and made == ["/shared/x"]
    spark, made = session("local[2]", current="/set/earlier")
    assert ensure_checkpoint_dir(spark) == "/set/earlier" and not made


def test_one_machine_makes_its_own():
    spark, made = session("local[2]")
    assert ensure_checkpoint_dir(spark) == made[0]
