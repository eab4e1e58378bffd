"""The stream queries against batch SQL over all events, with the feed in one range of time and in many."""

import pytest
from helpers import differences

from vacantia.plans import stream_queries

SQL = {name: sql for name, (_, sql) in stream_queries.QUERIES.items()}


@pytest.mark.parametrize(("seconds", "ranges"), [(5 * 86_400, 1), (86_400, 7), (10**9, 1)])
@pytest.mark.parametrize("name", sorted(SQL))
def test_all_events_are_in_the_result(spark, monkeypatch, name, seconds, ranges):
    monkeypatch.setattr(stream_queries, "RANGE_SECONDS", seconds)
    monkeypatch.setattr(stream_queries, "RANGES", ranges)
    assert differences(spark, stream_queries.QUERIES[name][0], SQL[name]) == ""
