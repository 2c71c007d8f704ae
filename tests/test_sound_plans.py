"""Queries on sound hold samples where they are worked on: no join, shuffle or sort has them."""

import re

from parlance.plans import changes

DATA = "/root/testdata/sf0.001"


def test_no_samples_are_shuffled_or_broadcast(spark):
    for query in (changes.echo_removed, changes.segment_stream):
        plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("transform(org" if "transform(org" in plan else "sequence(")]
        assert "Join" not in plan and "BroadcastExchange" not in plan
        below_groups = above[above.index("FlatMapGroupsInPandas") :]
        assert not re.search(r"\bExchange\b|\bSort\b", below_groups), query.__name__
