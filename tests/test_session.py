from __future__ import annotations

from types import SimpleNamespace

import pytest

from usagemill import session


def stub(folder, master):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used():
    assert session.shared_root(stub("hdfs://nn/shared/", "yarn")) == "hdfs://nn/shared"
    first, second = (session.fresh_folder(stub("/shared", "yarn"), "x") for _ in range(2))
    assert first != second and first.startswith("/shared/x-")


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(stub(None, "spark://host:7077"))


def test_a_local_master_may_do_without(tmp_path, monkeypatch):
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path / prefix))
    monkeypatch.setattr(session, "_local_root", None)
    assert session.shared_root(stub(None, "local[2]")) == str(tmp_path / "usagemill-")
