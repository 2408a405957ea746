"""Registered queries against SQL on the smallest data set; all of them with FULL_ORACLE=1."""

import os

import pytest

from shelfcheck_queries.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "prepare_catalog", "prepare_catalog_ng", "fill_metadata", "chk_restricted_brand", "chk_prohibited", "chk_country_ng",
    "chk_powerbank", "all_row_hits", "chk_duplicates", "final_report", "final_report_ma", "reapprove", "quality_report",
    "weekly_insights", "keyword_category", "category_similarity", "page_product_fields", "page_nested_blocks", "page_fields", "predicted_categories",
    "wrong_category", "listing_cards", "visual_duplicates",
    "read_catalog_csv", "read_master", "read_many", "load_prohibited", "load_restricted_brands", "load_price_caps", "lookup_inputs",
]
NAMES = list(QUERIES) if os.environ.get("FULL_ORACLE") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, _, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note


def test_registration():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
