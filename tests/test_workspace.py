"""Where work tables go: the shared folder, or nowhere."""

from types import SimpleNamespace

import pytest

from toolwarden.plans.workspace import shared_folder


def session(master, warehouse, folder=None):
    conf = {"spark.sql.warehouse.dir": warehouse} | ({"spark.checkpoint.dir": folder} if folder else {})
    context = SimpleNamespace(master=master, getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder():
    assert shared_folder(session("spark://a:7077", "file:/w", "hdfs://n/c/")) == "hdfs://n/c"
    assert shared_folder(session("local[4]", "file:/w/")) == "file:/w/toolwarden_work"
    assert shared_folder(session("yarn", "hdfs://n/w")) == "hdfs://n/w/toolwarden_work"
    for warehouse in ("file:/w", "file:///w", "/w"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session("yarn", warehouse))
