"""Registered queries against their SQL on DuckDB. ``ALL_QUERIES=1`` runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

QUICK = (
    "classify_files path_expressions display_metadata group_products scan_summary pack_by_bytes import_images "
    "glob_matches route_products plan_batch usable_analyses merge_analyses version_diff frame_catalog "
    "framing_violations job_stats batch_rollup batch_progress batch_failures backlog dedupe_requests fill_dependency "
    "bulk_controls clear_queue storage_usage sweep_orphans archive_name_clashes report_cells decode_pose "
    "suppress_persons mask_features parse_features classify_shot validate_rules parse_payload audit_blobs "
    "content_addressed_store stream_throughput stream_job_state"
).split()
NAMES = sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    line, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
    assert ok, line


def test_every_query_has_sql():
    from framejobs.plans import load_all
    from framejobs.plans.registry import ORACLES, QUERIES

    load_all()
    assert set(QUERIES) == set(ORACLES)
