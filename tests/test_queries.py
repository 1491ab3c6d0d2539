"""A cross-section of the registered queries against their SQL, on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from tests.checker import arrow, connect, difference
from tracelake.plans.registry import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "p01_ref_parse", "p11_identity_validation", "j01_item_pairing", "w01_duplicate_groups", "f09_search", "j05_ref_status",
    "g01_upstream_turns", "c11_dangling_derived_from", "c17_missing_code_blob", "w04_w05_snapshot_caps", "u01_catalog_diff",
    "n02_rate_limited_snapshots", "w02_names_duplicate", "t06_rewritten_refs", "m03_renamed_edges", "s02_sidecar_documents",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    assert difference(got, arrow(con, entry.oracle_sql()[name])) is None


def test_every_query_has_a_check():
    entry.queries()
    assert set(QUERIES) == set(CHECKS)
