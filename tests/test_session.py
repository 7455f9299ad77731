"""The shared checkpoint folder rule: read it from the session, never invent a local one on a cluster."""

import types

import pytest

from churnlens.session import ensure_checkpoint_dir


def _stub(master, conf_dir=None, current=None):
    calls = {}
    sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: current,
                               setCheckpointDir=lambda d: calls.setdefault("set", d))
    conf = types.SimpleNamespace(get=lambda k, default=None: conf_dir if k == "spark.checkpoint.dir" else default)
    return types.SimpleNamespace(sparkContext=sc, conf=conf), calls


def test_cluster_without_shared_dir_is_refused():
    spark, _ = _stub("yarn")
    with pytest.raises(ValueError, match="shared"):
        ensure_checkpoint_dir(spark)


def test_configured_dir_is_used():
    spark, calls = _stub("yarn", conf_dir="/mnt/shared/ckpt")
    assert ensure_checkpoint_dir(spark) == "/mnt/shared/ckpt"
    assert calls["set"] == "/mnt/shared/ckpt"


def test_existing_dir_is_kept():
    spark, calls = _stub("yarn", current="/mnt/shared/existing-ckpt")
    assert ensure_checkpoint_dir(spark) == "/mnt/shared/existing-ckpt"
    assert "set" not in calls


def test_local_mode_gets_a_scratch_dir():
    spark, calls = _stub("local[4]")
    d = ensure_checkpoint_dir(spark)
    assert calls["set"] == d and "churnlens-ckpt-" in d
