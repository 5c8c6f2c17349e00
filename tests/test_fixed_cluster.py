import pytest

from logweave.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["quorum_commit_index", "quorum_health", "replication_lag", "rebalance_candidates", "shard_status"])
def test_peers_are_no_part_of_a_table(spark, name):
    files = CATALOG[name][0](spark, SF).inputFiles()
    assert files and not any("supplier" in f for f in files)
