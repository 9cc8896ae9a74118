"""The shared folder of intermediate tables."""

from types import SimpleNamespace

import pytest

from tellurion.llm.common import shared_dir


def _session(master: str, folder: str | None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder if folder else default), sparkContext=context)


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_local_sessions_have_a_folder_of_their_own(master):
    assert shared_dir(_session(master, None)) == "file:///tmp/checkpoints"


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://host"])
def test_clusters_must_name_a_folder(master):
    with pytest.raises(ValueError):
        shared_dir(_session(master, None))
    assert shared_dir(_session(master, "hdfs:///shared/")) == "hdfs:///shared"
