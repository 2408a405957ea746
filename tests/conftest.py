from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("shelfcheck-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def products(spark):
    """Builds a raw catalog from dicts; missing keys are NULL, ``_seq`` is the row number."""

    columns = [
        "PRODUCT_SET_SID", "NAME", "BRAND", "CATEGORY", "CATEGORY_CODE", "ACTIVE_STATUS_COUNTRY", "SELLER_NAME", "COLOR",
        "COLOR_FAMILY", "GLOBAL_PRICE", "GLOBAL_SALE_PRICE", "PRODUCT_WARRANTY", "WARRANTY_DURATION", "COUNT_VARIATIONS",
        "PARENTSKU", "MAIN_IMAGE",
    ]

    def build(rows, drop=()):
        full = []
        for i, row in enumerate(rows):
            base = {"PRODUCT_SET_SID": f"s{i}", "NAME": "a plain product name", "BRAND": "Acme", "CATEGORY_CODE": "100",
                    "ACTIVE_STATUS_COUNTRY": "KE", "SELLER_NAME": "Seller"} | row
            full.append((i, *[base.get(c) for c in columns]))
        schema = "_seq long, " + ", ".join(f"{c} string" for c in columns)
        return spark.createDataFrame(full, schema).drop(*drop)

    return build
