"""Registered queries against DuckDB on the smallest tables; the slow ones run at the driver only."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tessera import queries as Q

QUICK = [
    "a1_read_range", "h11_supplier_mesh", "h14_supplier_deform", "i10_supplier_patch", "a4_image_headers", "a5_read_rigs_bones", "a5_read_rigs_errors", "a5_read_rigs_kept", "a7_correction_errors", "a7_corrections_kept", "d16_connected_regions", "g7_morph_loop", "h8_bone_world", "h12_backward_map", "i5_fill_region", "i8_heal", "i11_layer_fingerprint", "i13_resolve_plates", "k4_stream_motion", "k5_stream_stall", "a6_read_strokes", "c3_cluster_colors", "d11_gaussian_blur", "e2_glow", "g15_best_match_point", "g16_make_loop_fade", "h1_audit_rigs", "h13_remap", "i8_heal_box", "i9_apply_corrections", "i13_resolve_layers", "flagship_foreground", "a2_scan_range", "a7_load_corrections", "a9_probe", "a11_project_summary", "a12_output_format", "a13_export_variants", "b1_parse_color", "b2_parse_color_rgba", "b6_mask_or", "b7_merge_channels", "b8_bgr_to_hsv", "b11_blend_overlay", "b13_composite_over", "b15_orient_6",
    "c1_color_ranges", "c2_corner_samples", "c5_border_color", "c6_dominant_color", "c7_frame_stats", "c8_crop", "d2_key_mask_adaptive", "d3_hsv_mask", "d6_motion_region", "d8_soft_edges", "d15_missed_blocks", "e1_outline", "f1_resize", "f3_trim", "f6_retime_interpolate", "f7_block_match_flow", "f8_concat_clips", "f9_frame_chunks", "f12_frame_plan",
    "g1_pingpong_until", "g4_fade_loop", "g5_blend_loop_add", "g6_speedramp_slow", "g10_detect_cycle", "g11_analyze_loop", "g14_best_loop_points", "h2_bone_closure", "h6_interpolate_poses", "h10_bone_weights", "h11_grid_mesh_triangles", "h17_pose_curves", "h18_bone_tree", "h19_nearest_bone", "i1_layer_settings", "i3_distance_transform", "i7_correction_band", "i14_patch_state",
    "j1_frame_diff_report", "j3_attempt_outcomes", "j4_job_status", "j5_merge_plan", "k2_stream_progress", "k3_stream_attempts", "l2_registry_run",
]


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def rows(df):
    flat = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(map(flat, r))) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, db, name):
    got, want = rows(Q.queries()[name](spark, sf_dir).toPandas()), rows(db.sql(Q.oracle_sql()[name]).df())
    assert got == want


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["clip_id", "frame", "fg"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
