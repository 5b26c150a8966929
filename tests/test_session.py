"""The shared folder comes from the session; a private one is set only when unset."""

from biblioscope.session import checkpoint_root


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Context:
    def __init__(self, conf, checkpoint_dir=None):
        self._conf, self._dir, self.set_calls = conf, checkpoint_dir, []

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, path):
        self.set_calls.append(path)
        self._dir = path


class _Session:
    def __init__(self, conf, checkpoint_dir=None):
        self.conf = _Conf(conf)
        self.sparkContext = _Context(_Conf(conf), checkpoint_dir)


def test_configured_folder_is_used():
    s = _Session({"spark.checkpoint.dir": "hdfs://cluster/shared/ckpt/"})
    assert checkpoint_root(s) == "hdfs://cluster/shared/ckpt"
    assert s.sparkContext.set_calls == ["hdfs://cluster/shared/ckpt/"]


def test_existing_context_folder_is_kept():
    s = _Session({"spark.checkpoint.dir": "s3a://bucket/ckpt"}, checkpoint_dir="s3a://bucket/ckpt/app-1")
    assert checkpoint_root(s) == "s3a://bucket/ckpt"
    assert s.sparkContext.set_calls == []


def test_private_folder_only_when_unset():
    s = _Session({})
    root = checkpoint_root(s)
    assert root and s.sparkContext.set_calls == [root]


def test_real_session(spark):
    assert checkpoint_root(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
