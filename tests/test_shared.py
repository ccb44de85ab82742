from types import SimpleNamespace

import pytest

from foliant import shared


def session(master, **settings):
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default), set=lambda key, value: settings.update({key: value}))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(session(master))
    assert shared.shared_dir(session(master, **{"spark.checkpoint.dir": "hdfs://host/shared/"})) == "hdfs://host/shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]", "local[4,2]"])
def test_one_process_has_a_folder_of_its_own(master):
    one = session(master)
    assert shared.shared_dir(one).startswith("file:///") and shared.shared_dir(one) == shared.shared_dir(one)


def test_tables_are_kept_and_dropped(spark):
    space = shared.Workspace(spark, "kept")
    kept = space.keep(spark.range(5))
    assert kept.count() == 5 and not shared.is_empty(kept) and shared.is_empty(kept.where("id > 9"))
    space.drop(kept)
    assert not _exists(spark, kept._foliant_path)


def _exists(spark, path):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
