"""Scratch on shared storage only, and gone when its block ends."""

import os
from types import SimpleNamespace

import pytest

from harvestline import session
from harvestline.streaming.feeds import for_each_batch


def test_no_local_fallback_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        fake = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError):
            session.scratch_path(fake, "x")
        assert session.shared_folder(fake, "s3a://bucket/tmp/") == "s3a://bucket/tmp"
    fake.conf["spark.checkpoint.dir"] = "hdfs://name/checkpoints"
    path = session.scratch_path(fake, "x")
    session._SCRATCH.pop(path)
    assert path.startswith("hdfs://name/checkpoints/x-")


def test_ten_batches_leave_no_scratch(spark, tmp_path):
    for k in range(10):
        spark.range(k, k + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = []

    def apply(batch, batch_id):
        before = set(session._SCRATCH)
        session.cut_lineage(batch, "batch").count()
        made.extend(set(session._SCRATCH) - before)

    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for_each_batch(stream, apply, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(made) >= 10 and not any(os.path.exists(p) for p in made)
    assert not set(made) & set(session._SCRATCH)
