"""Strict settings."""

import pytest

from tempofuse import config


def test_round_trip_and_strictness():
    s = config.Settings()
    assert config.loads(config.dumps(s)) == s
    assert config.loads('{"event": {"trigger": 12.5}}').event.trigger == 12.5
    with pytest.raises(KeyError):
        config.loads('{"event": {"triger": 1}}')
    with pytest.raises(KeyError):
        config.loads('{"more": {}}')
    with pytest.raises(ValueError):
        config.loads('{"bar": {"markers": {"a": 0.2}}}')
