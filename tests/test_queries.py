"""Registered queries against their SQL on the smallest data."""

import pytest
from conftest import DATA

from flowloom.queries import registry

CHECKED = [
    "p3_found", "p3_report", "p3_partial_keys", "p4_found", "p5_found", "p5_descendants", "B2_domain", "B3_url_bare", "B9_tag_group", "B11_meta_absent_matches_empty", "B13_response_headers_not", "B14_body", "B17_negation", "B18_cost_order", "B19_hidden",
    "B20_hints", "B21_patterns", "C1_payload", "C5_message_annotations", "C6_unknown_term", "D4_scan_cap", "D8_backward", "D9_cursors", "D10_hydrated", "D14_undecoded", "E1_grep", "E2_search", "E5_cross_session", "E8_unsearchable", "E15_advice", "E16_strict_arguments", "M8_pretty_bodies", "F4_headers", "F8_redirects", "F12_asof_names", "F13_fifo_pairs",
    "F14_classify", "F15_verify", "F16_compare", "G3_reason_counts", "G7_hosts", "H1_body_refs", "H4_toggle_favorite", "H4_set_tags", "H6_marks", "H9_finish", "H10_delete_cascade", "I2_connections", "I12_http1", "J_read_only", "J_params", "J_recursive_cte", "J_window_frames", "J_grouping_sets",
    "K4_changelog", "K4_hidden_and_side_terms", "K3_message_bumps", "K5_session_events", "K8_message_stream", "K10_flush", "K10_settled", "K14_undecoded_index", "H1_published", "D1_timeline", "D2_keyset", "A12_stream_records", "A14_bundle_import", "A15_import", "A20_export_texts", "E1_grep_summary", "E5_session_rows", "E11_overview", "G8_natural_keys",
    "I17_hellos", "I19_fingerprint_score", "I22_framed", "I28_names", "M1_compare_flows", "M2_header_diff", "M3_http2_text", "M5_capture_filter", "M6_curl", "J_glob", "J_arrays", "J_maps", "J_not_exists", "J_not_in", "p4_inferred", "M4_formats", "A13_bundle", "A17_list_sessions", "A18_source_kinds",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, agree, name):
    agree(registry.queries()[name](spark, DATA), registry.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
