"""The shared folder and the tables in it."""

import os
from types import SimpleNamespace

import pytest

from snapweave import session


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


def _stub(master, configured=None):
    made = []
    conf = _Conf({"spark.checkpoint.dir": configured} if configured else {})
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(
        isDefined=lambda: bool(made), get=lambda: made[0])))
    sc = SimpleNamespace(master=master, _jsc=jsc, getConf=lambda: conf, setCheckpointDir=made.append)
    return SimpleNamespace(conf=conf, sparkContext=sc)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"])
def test_unset_folder_raises_off_local_mode(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_stub(master))
    assert session.ensure_checkpoint_dir(_stub(master, "hdfs://x/shared")) == "hdfs://x/shared"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]", "local[4,2]"])
def test_private_folder_in_local_mode(master):
    assert os.path.isdir(session.ensure_checkpoint_dir(_stub(master)))


def test_tables_are_dropped(spark):
    before = session.materialized_mark(spark)
    a, b = session.cut_lineage(spark.range(5)), session.cut_lineage(spark.range(6))
    folder = a.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder) and session.materialized_mark(spark) == before + 2
    session.drop_table(a)
    assert not os.path.isdir(folder) and session.materialized_mark(spark) == before + 1
    assert b.count() == 6
    assert session.drop_materialized(spark, since=before) == 1
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) in (None, "false")


def test_mime_table_is_the_interpreters():
    """Pinned from Python 3.13; other versions may differ, results must not."""
    import mimetypes
    import sys
    from snapweave.functions import mime
    assert len(mime.mime_rows()) == 154
    if sys.version_info[:2] == (3, 13):
        assert mime.mime_rows() == sorted(mimetypes.MimeTypes(filenames=()).types_map[True].items())
