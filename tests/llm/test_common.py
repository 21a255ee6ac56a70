import os
from types import SimpleNamespace

import pytest

from lodestar.llm import common, registry


def test_a_cluster_needs_a_shared_folder():
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(away)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "s3a://bucket/x/"))
    assert common.shared_dir(named) == "s3a://bucket/x"


def test_nothing_is_left_after_a_cleanup(spark, sf_dir):
    common.cleanup(spark)
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    kept = common.stored(spark.range(3))
    registry.op10_mixing(spark, sf_dir).collect()
    registry.op7_url_filter(spark, sf_dir).collect()
    common.cleanup(spark, [kept])
    assert kept.count() == 3 and len(common.stored_tables()) == 1
    common.cleanup(spark)
    assert set(os.listdir(folder)) == before and not common.stored_tables()
