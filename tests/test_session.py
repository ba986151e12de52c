import os
from types import SimpleNamespace

import pytest

from veilcraft import session


def test_run_folder_is_removed(spark):
    with session.run_folder(spark) as folder:
        kept = session.materialize(spark.range(3).toDF("x"), "kept")
        both = session.materialize_all(one=spark.range(1).toDF("x"), two=spark.range(2).toDF("x"))
        assert kept.count() == 3 and both["two"].count() == 2 and len(os.listdir(folder)) == 3
    assert not os.path.exists(folder)
    assert not session.work_path(spark, "later").startswith(folder)


@pytest.mark.parametrize("master, allowed", [("local[4]", True), ("spark://host:7077", False), ("local-cluster[2,1,1024]", False)])
def test_a_cluster_must_name_the_shared_folder(master, allowed, tmp_path):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    fake = SimpleNamespace(conf={}, sparkContext=context)
    if allowed:
        assert made == [] and session.shared_dir(fake) == made[0]
    else:
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            session.shared_dir(fake)
