"""Settings from a file and the environment."""

import pytest

from contentlake.config import Config


def test_defaults_file_and_environment(tmp_path, monkeypatch):
    assert Config.load().pull_limit == 2000
    file = tmp_path / "c.yaml"
    file.write_text("path: /data\nparallel: '4'\n")
    monkeypatch.setenv("CONTENTLAKE_DEVICE", "d7")
    assert Config.load(str(file)) == Config(path="/data", parallel=4, device="d7")
    file.write_text("nope: 1\n")
    with pytest.raises(ValueError):
        Config.load(str(file))
