"""A sample of registered queries against their SQL at the smallest scale."""

import os

import pytest

from checks import registry
from checks.compare import duck, rows

registry.load()
SF = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()
SAMPLE = ["canonical_identities", "filtered_events", "event_timeline", "node_risk", "node_roles", "kill_chain_levels", "tool_sightings",
          "group_attribution", "report_narrative", "normalized_vendor_lines", "hunting_records", "ariel_records", "trade_degrees"]


def test_every_query_has_a_check():
    assert set(registry.QUERIES) - set(registry.ORACLES) == ROWS_ONLY


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck(SF).execute(registry.ORACLES[name]).df()
    assert rows(got) == rows(want) and sorted(got.columns) == sorted(want.columns)
