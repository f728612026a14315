"""One fixed schema per layer; columns a city lacks are added as typed nulls on load."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
MULTILINE = f"array<{LINE}>"
POLYGON = f"array<{LINE}>"

LAYERS: dict[str, str] = {
    "boundary": f"geometry {POLYGON}",
    "roads": "id int, kind string, fclass int, is_highway boolean, direction string, one_way string, width double, "
    f"speed_limit double, slope_pct double, major_road string, geometry {LINE}",
    "sidewalks": "id int, kind string, `exists` boolean, condition string, side string, surface string, width double, "
    f"road_type string, geometry {LINE}",
    "crosswalks": "id int, kind string, location string, size string, signalized boolean, condition string, "
    f"road_type string, geometry {LINE}",
    "candidate_crosswalks": "id bigint, ixn_id bigint, road_id int, len double, sw_pt_id_x bigint, sw_pt_id_y bigint, "
    f"sw_id_x int, sw_id_y int, geometry {LINE}",
    "network_nodes": "vid int, x double, y double",
    "network_edges": "eid int, orig_id int, kind string, `exists` boolean, is_xwalk boolean, len double, src_vid int, "
    f"trg_vid int, geometry {LINE}",
    "contracted_edges": "eids array<int>, orig_id int, kind string, is_xwalk boolean, `exists` boolean, "
    f"src_vid int, trg_vid int, len double, geometry {MULTILINE}",
    "osm_buildings": "osmid bigint, element_type string, kind string, x double, y double",
    "osm_pois": "element_type string, osmid bigint, subcategory string, category string, x double, y double",
    "pois": "placekey string, latitude double, longitude double, naics_code int, top_category string",
    "land_use": f"lu_code int, category string, dmd_kind string, geometry {POLYGON}",
    "acs": f"geoid string, popu double, geometry {POLYGON}",
    "od_points": "id bigint, origin boolean, base_id string, category string, weight double, source string, x double, y double",
    "odpt2node": f"odpt_id bigint, vid int, is_source boolean, dist_odpt2cp double, dist_cp2node double, geometry {LINE}",
    "od_sample": "od_id bigint, orig_odpt bigint, dest_odpt bigint, n int, seed int, max_dist double",
    "edges": "variant string, id int, src_vid int, trg_vid int, len bigint, `exists` boolean, is_xwalk boolean, cid int, "
    "n_trips bigint, bwness double, pedscore double",
    "paths": "variant string, vid_o int, vid_d int, edge_id int, hop int",
    "ntrips": "kind string, n_links int, pct_links double, pct_new_trips double, length bigint, n_trips bigint",
    "distance_snapshots": "kind string, step int, vid_o int, vid_d int, n_ods bigint, d bigint, changed boolean",
}


def schema(layer: str) -> T.StructType:
    return T.StructType.fromDDL(LAYERS[layer])
