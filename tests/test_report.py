import random

import pytest

from shelfcheck.operators.catalog import prepare_catalog
from shelfcheck.operators.checks import Check
from shelfcheck.plans import preqc as R
from shelfcheck.registry import register_check, unregister_check
from shelfcheck.sources.rules import SCHEMAS, RuleSet, small_table


@pytest.fixture(scope="module")
def rules(spark):
    t = lambda n, rows: small_table(spark, rows, SCHEMAS[n])
    return RuleSet(spark, {
        "word_list": t("word_list", [("unnecessary", "buy now"), ("colors", "red")]),
        "code_list": t("code_list", [("fashion", "7"), ("books", "9")]),
        "program_category": t("program_category", [("perfume", "5"), ("powerbank", "8")]),
        "program_keyword": t("program_keyword", [(None, "perfume", "chanel")]),
        "prohibited": t("prohibited", [(None, 1, "gun", [])]),
        "restricted_brand": t("restricted_brand", [(None, 1, "nike", "Nike", [], [], [])]),
    }, "Shop")


def rows(seed=0, n=120):
    rng = random.Random(seed)
    return [{
        "NAME": " ".join(rng.choice(["red", "hat", "gun", "buy now", "acme", "big", "nice", "power bank"]) for _ in range(rng.randint(1, 5))),
        "BRAND": rng.choice(["Acme", "Nike", "Generic", "Fashion"]), "CATEGORY_CODE": rng.choice(["7", "9", "5", "8", "1"]),
        "SELLER_NAME": rng.choice(["A", "B"]), "COLOR": rng.choice([None, "Red"]), "GLOBAL_PRICE": "100",
        "GLOBAL_SALE_PRICE": rng.choice(["90", "30", None]), "PARENTSKU": "P",
    } for _ in range(n)]


def collect(report):
    return {r["ProductSetSid"]: tuple(r) for r in report.collect()}


def test_every_product_once_and_partition_invariant(products, rules):
    df = products(rows())
    one = collect(R.final_report(prepare_catalog(df), rules, "KE"))
    two = R.final_report(prepare_catalog(df.repartition(9, "NAME")), rules, "KE")
    assert two.count() == 120 and collect(two) == one
    assert {r[2] for r in one.values()} == {"Approved", "Rejected"}


def test_priority_expansion_and_texts(products, rules):
    df = products([
        {"NAME": "gun buy now red hat", "BRAND": "Nike"}, {"NAME": "nike", "BRAND": "x"},
        {"NAME": "a nice big red hat", "COLOR": "Red", "CATEGORY_CODE": "7", "BRAND": "Generic"},
        {"NAME": "A NICE big red hat", "COLOR": "red", "CATEGORY_CODE": "1", "BRAND": "generic"},
        {"NAME": "nice power bank one", "CATEGORY_CODE": "1"}, {"NAME": "a perfectly fine item"},
    ])
    got = collect(R.final_report(prepare_catalog(df), rules, "KE"))
    assert got["s0"][5] == "Restricted brands"
    assert got["s0"][4] == "Missing license for this item. Raise a claim via Vendor Center. (Restricted Brand: Nike - No sellers approved)"
    assert got["s2"][5] == "Generic BRAND Issues"
    # an equal listing takes the flag over, with the base comment only
    assert got["s3"][5] == "Generic BRAND Issues" and "(" not in got["s3"][4]
    assert got["s4"][3:6:2] == ("1000007 - Wrong Category", "Wrong Category")
    assert got["s5"][2:6] == ("Approved", "", "", "")
    assert collect(R.final_report(prepare_catalog(df), rules, "MA"))["s2"][5] != "Generic BRAND Issues"


def test_spread_is_idempotent(products, rules):
    df = prepare_catalog(products(rows(4)))
    hits = R.flag_hits(df, rules, "KE")
    first = {(r["sid"], r["flag"]) for r in R.expanded_hits(hits, df).collect()}
    again = R.expanded_hits(R.expanded_hits(hits, df).select(*R.HIT_COLS).distinct(), df)
    keyed = {(r["sid"], r["flag"]) for r in again.collect()}
    assert first <= keyed


def test_registered_checks_join_last(products, rules):
    df = prepare_catalog(products(rows(2)))
    before = collect(R.final_report(df, rules, "KE"))
    register_check("Too cheap", build=lambda s: [_cheap()])
    try:
        after = collect(R.final_report(df, rules, "KE"))
    finally:
        unregister_check("Too cheap")
    assert all(after[k] == v for k, v in before.items() if v[2] == "Rejected")
    with pytest.raises(ValueError):
        register_check("x")


def _cheap():
    from pyspark.sql import functions as F

    return Check("Too cheap", F.col("_sale") < 50, F.lit("cheap"))


def test_decisions_last_one_holds(spark, products, rules):
    report = R.final_report(prepare_catalog(products([{}, {}, {}, {"NAME": "x"}])), rules, "KE")
    decisions = spark.createDataFrame([
        ("s0", "reject", "REJECT_COLOR", 1), ("s1", "reject", "REJECT_FAKE", 1), ("s1", "undo", "", 2),
        ("s2", "reject", "Other Reason (Custom): bad photo: blurred", 1)], "sid string, action string, key string, seq long")
    got = collect(R.apply_decisions(report, decisions, rules, "KE"))
    assert got["s0"][2:6] == ("Rejected", "1000005 - Kindly confirm the actual product colour",
                              "Product color must be mentioned in title/color tab.", "Missing COLOR")
    assert got["s1"][2:6] == ("Approved", "", "", "Approved by User")
    assert got["s2"][3:6] == ("1000007 - Other Reason", "bad photo: blurred", "Other Reason (Custom)")
    assert got["s3"][5] == "Single-word NAME"


def test_reapprove_moves_to_the_next_flag(spark, products, rules):
    df = prepare_catalog(products([{"NAME": "gun buy now red hat"}, {"NAME": "gun and a long name"}]))
    report = R.final_report(df, rules, "KE")
    sids = spark.createDataFrame([("s0",), ("s1",)], "sid string")
    got = collect(R.reapprove(report, df, rules, "KE", sids, "Prohibited products"))
    assert got["s0"][5] == "Unnecessary words in NAME" and got["s1"][2:6] == ("Approved", "", "", "Approved by User")


def test_numbers_without_a_global_sort(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(8)
    from pyspark.sql import functions as F

    out = R.number_rows(df, [F.desc("k"), F.asc("id")], "n", start=1).collect()
    want = {i: n for n, (i, _) in enumerate(sorted(((i, i % 7) for i in range(1000)), key=lambda t: (-t[1], t[0])), 1)}
    assert {r["id"]: r["n"] for r in out} == want


def test_review_helpers(spark, products, rules):
    report = spark.createDataFrame([
        ("s0", "Rejected", "Image Stretched", "Image Stretched - Tall"), ("s1", "Rejected", "Image Blurry", "small image"),
        ("s2", "Approved", "", "")], "ProductSetSid string, Status string, FLAG string, Comment string")
    got = {r["sid"]: r["warnings"] for r in R.review_warnings(report).collect()}
    assert got == {"s0": ["Tall (Screenshot?)", "Wide Aspect"], "s1": ["Low Resolution"]}
    cards = spark.createDataFrame([("a", []), ("b", ["Wide Aspect"]), ("c", None)], "PRODUCT_SET_SID string, warnings array<string>")
    assert [r[0] for r in R.sort_review(cards, "wide").collect()] == ["b", "a", "c"]
    assert [r[0] for r in R.sort_review(cards, "no_issue").collect()] == ["a", "c", "b"]
    df = prepare_catalog(products([{}, {}, {}]))
    assert R.review_scope(report, df, rules).count() == 3
    notes = spark.createDataFrame([("s0", "n"), ("s2", "n")], "sid string, note string")
    assert [r[0] for r in R.advisories(notes, report, df).collect()] == ["s2"]
