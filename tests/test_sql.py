"""Queries beside their SQL on the smallest tables (``check.py`` runs all of them)."""

import pytest
from check import connect, differences

from sparkwalk.oracle import ORACLE
from sparkwalk.workload import QUERIES

FOLDER = "/root/testdata/sf0.001"
FAST = [
    "variant_edges", "label_edges", "used_nodes", "od_aggregate", "od_attach", "best_links_first", "filled_gaps", "poi_tags",
    "building_centroids", "line_measures", "great_circle", "node_in_zone", "multi_part_zone", "reprojected_layer", "zones_meet", "city_pois", "land_use",
    "sample_od", "chains_contracted", "shortest_distances", "edge_trips", "part_flags", "parts_exploded", "unlinked_pairs", "trips_connected", "layer_round_trip", "feature_round_trip",
]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).sql(ORACLE[name]).df()) is None


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
