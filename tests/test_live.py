import pytest
from pyspark.sql import functions as F

from shelfcheck.operators import lookup as L
from shelfcheck.operators import postqc as P
from shelfcheck.plans import quality as Q
from shelfcheck.sources.rules import SCHEMAS, RuleSet, small_table


def test_sku_and_country_from_links(spark):
    domains = [("shop.co.ke", "KE"), ("shop.com.ng", "NG")]
    lines = [
        "https://www.shop.co.ke/fancy-phone-12345678ab-GE840EA6C62GANAFAMZ.html?x=1", "GE840EA6C62GANAFAMZ-12", "  ",
        "http://x.org/some-item-1234567.html", "http://shop.com.ng/thing-500ML1234567A-abc123def456.html/", "ge840ea6c62ganafamz",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "_seq long, line string")
    got = [tuple(r) for r in P.parse_lookup_inputs(df, domains).orderBy("sku").collect()]
    assert {(r[1], r[3]) for r in got} == {
        ("GE840EA6C62GANAFAMZ", "KE"), ("1234567", None), ("ABC123DEF456", "NG"), ("ge840ea6c62ganafamz", None)}


def test_fuzzy_category(spark):
    cmap = spark.createDataFrame([
        (1, "Phones", "10", "Electronics / Phones"), (2, "Smart Phones", "11", "Electronics / Phones / Smart Phones"),
        (3, "Hats", "20.0", "Fashion / Hats"), (4, "Junk", "x", "Junk")], "seq long, name string, code string, path string")
    texts = ["electronics>phones", "Other > HATS", "Stuff > Cheap Smartphones", "Ph", "zzz", None, "Fashion | Hâts for men"]
    df = spark.createDataFrame([(t, "7") for t in texts], "CATEGORY string, CATEGORY_CODE string")
    got = {r["CATEGORY"]: r["CATEGORY_CODE"] for r in P.resolve_category_code_fuzzy(df, cmap).collect()}
    assert got == {"electronics>phones": "10", "Other > HATS": "20", "Stuff > Cheap Smartphones": "11", "Ph": "11", "zzz": "7",
                   None: "7", "Fashion | Hâts for men": "20"}
    assert {r[0] for r in P.unresolved_categories(df.withColumn("CATEGORY_CODE", F.lit("a"))).collect()} == set(texts) - {None}


def test_prices_variations_colors(spark):
    df = spark.createDataFrame([("", "KSh 1,500", "Red", "S", "None"), ("90", "x", "", "", "Blue")],
                               "GLOBAL_SALE_PRICE string, PRICE string, COLOR string, SIZES_AVAILABLE string, COLOR_IN_TITLE string")
    out = P.choose_prices(df).collect()
    assert [(r["GLOBAL_SALE_PRICE"], r["GLOBAL_PRICE"]) for r in out] == [("1500.0", "1500.0"), ("90", "90")]
    assert [r["LIST_VARIATIONS"] for r in P.build_variation_list(df).collect()] == ["Red | S", None]
    assert [r["COLOR"] for r in P.color_from_title(df).collect()] == ["None", "Blue"]


def test_prepare_and_report(spark):
    raw = spark.createDataFrame([
        (0, "1", "Acme Acme hat", "Acme", "Fashion > Hats", "50", "100", "Shop A", "4.5", "0", "x JMALL", None, "3"),
        (1, "1", "later row", "Acme", "Fashion > Hats", "1", "2", "Shop A", "4.5", "0", "", "d", "9"),
        (2, "2", "gun", "Acme", "Fashion > Hats", "1", "5000", "Shop B", "", "3", "", "same text", "9")],
        "_seq long, sku string, Name string, brand string, categories string, newprice string, oldprice string, sellername string,"
        "averagerating string, totalratings string, Tags string, description string, `No. of Images` string")
    cmap = spark.createDataFrame([(1, "Hats", "20", "Fashion / Hats")], "seq long, name string, code string, path string")
    ready = Q.prepare_post_qc(raw, "KE", cmap)
    rows = {r["PRODUCT_SET_SID"]: r for r in ready.collect()}
    assert rows["1"]["NAME"] == "Acme Acme hat" and rows["1"]["CATEGORY_CODE"] == "20" and rows["1"]["DISCOUNT"] == "50%"
    assert rows["1"]["_BRAND_IN_TITLE"] and rows["1"]["_RATING_NO_REVIEWS"] and rows["2"]["_OLD_PRICE_CORRUPTED"]
    assert rows["1"]["IS_OFFICIAL_STORE"] == "Yes"
    rules = RuleSet(spark, {"prohibited": small_table(spark, [(None, 1, "gun", [])], SCHEMAS["prohibited"])}, "Shop")
    report = {r["SKU"]: r for r in Q.quality_report(ready, rules, "KE").collect()}
    two = report["2"]
    assert len(two) == 41 and two["Prohibited Item"] == "YES" and two["Critical Issues"] == 1
    assert two["Top Issues"].startswith("[critical] Prohibited: gun | ") and two["Thin Description"] == "YES"
    assert two["Quality Score"] == 100 - 25 - 12 * two["High Issues"] - 6 * two["Medium Issues"] - 2 * two["Low Issues"]
    assert all(0 <= r["Quality Score"] <= 100 for r in report.values())


def test_enrichment(spark):
    df = spark.createDataFrame([("a-1", "", "x"), ("b", "nan", "y"), ("c", None, "")], "PRODUCT_SET_SID string, BRAND string, COLOR string")
    pages = spark.createDataFrame([("a", "Acme", "Red"), ("b", "Bee", "Blue"), ("z", "Z", "Z")], "PRODUCT_SET_SID string, BRAND string, COLOR string")
    out = P.fill_from_pages(df, pages, ["BRAND", "COLOR", "GTIN"])
    got = {r["PRODUCT_SET_SID"]: (r["BRAND"], r["COLOR"]) for r in out.collect()}
    assert got == {"a-1": ("Acme", "x"), "b": ("Bee", "y"), "c": (None, "")}
    summary = {r["column"]: r["filled"] for r in P.fill_summary(df, out, ["BRAND", "COLOR"]).collect()}
    assert summary == {"BRAND": 2, "COLOR": 0}


@pytest.mark.parametrize("row, want", [
    (("WATER/SPORTS", "MEN'S|X", "Our team made it well today. A light jacket for windy mountain days!", "blue|x", '"L".'),
     "• Water·Sports · Men\n• A light jacket for windy mountain days\n• Blue · Size L"),
    ((None, "no gender", "short", None, "no size"), ""), (("-", None, None, "red", "no size"), "• Colour: Red"),
    (("Run", "kids", "word " * 40, None, "XL"), "• Run · Kids\n• " + ("word " * 24).strip() + "\n• Size: XL"),
])
def test_short_description(spark, row, want):
    df = spark.createDataFrame([row], "department_label string, channable_gender string, designed_for string, color string, size string")
    assert df.select(L.short_description(df)).first()[0] == want


def test_attributes(spark):
    df = spark.createDataFrame([("New Sony Phone 64GB Dark-Blue, small", "Navy Wine", "Sony"), ("hat", None, "Generic"), (None, None, "Acme")],
                               "n string, c string, b string")
    got = [r[0] for r in df.select(L.product_attributes(F.col("n"), F.col("c"), F.col("b"))).collect()]
    assert got[0]["base_name"] == "sony phone dark" and got[0]["colors"] == ["blue", "red"]
    assert got[1]["base_name"] == "hat" and got[2]["base_name"] == "acme"


def test_fill_takes_one_page(spark):
    from shelfcheck.operators import postqc as P

    df = spark.createDataFrame([("A-1", None, None)], "PRODUCT_SET_SID string, COLOR string, MODEL string")
    pages = spark.createDataFrame([(2, "A-1", "Red", "m1"), (1, "A-1", "Blue", "z9")], "page_id long, PRODUCT_SET_SID string, COLOR string, MODEL string")
    assert [(r["COLOR"], r["MODEL"]) for r in P.fill_from_pages(df, pages, ["COLOR", "MODEL"]).collect()] == [("Blue", "z9")]


def _tables(spark, path):
    """Two listings of one model that has a description, one of a model without."""
    rows = {
        "part": ([(0, "red ring", "Brand#1", "LARGE", 1, 10.0), (1, "hot bolt", "Brand#2", "SMALL", 2, 20.0)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(0, "S0", 0), (1, "S1", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "lineitem": ([(1, 0, 0, 1, 1.0, 9.0, 0.0, "R", "O"), (2, 0, 1, 2, 1.0, 8.0, 0.0, "N", "F"), (3, 1, 1, 3, 1.0, 9.0, 0.0, "A", "O")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_returnflag string, l_linestatus string"),
        "events": ([(0, 250.0), (0, 100.0), (2, 400.0)], "user_id long, value double"),
        "documents": ([(0, "a text with an <IMG src=x>"), (5, "of no model")], "doc_id long, text string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_descriptions_join_after_everything_else(spark, tmp_path):
    from shelfcheck_queries.queries import live

    rows = live(spark, _tables(spark, tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # the outermost join brings the texts, so no join with the ratings or the rules shuffles them
    assert "doc_id" in plan[: plan.index("user_id")]
    got = sorted((r["PRODUCT_SET_SID"], r["DESCRIPTION"], r["RATING"], r["REVIEW_COUNT"]) for r in rows.collect())
    text = "a text with an <IMG src=x>"
    assert got == [("P0-0", text, 2.5, 0), ("P0-1", text, 2.5, 0), ("P1-1", None, None, None)]


def test_image_tags_are_found_in_either_case_and_null_is_no_text(spark):
    rules = RuleSet(spark, {})
    df = spark.createDataFrame([("a", "x <IMG y"), ("b", "x <b> y"), ("c", "plain"), ("d", None)], "PRODUCT_SET_SID string, DESCRIPTION string")
    from shelfcheck.operators import checks as C

    base = df.withColumns({c: F.lit("x") for c in ("NAME", "BRAND", "CATEGORY_CODE", "_name_lower", "_brand_lower", "_seller_lower", "_cat_clean")})
    hits = C.row_hits(base, rules, None, [P.description_checks]).filter("flag = 'Missing Images in Desc'")
    assert sorted(r["sid"] for r in hits.collect()) == ["b", "c"]


def test_a_shuffle_carries_no_texts_of_rows_out_of_scope(spark, products):
    from shelfcheck.operators import catalog as cat

    seen = []
    whole = cat.materialize
    cat.materialize = lambda df, name: seen.append(df) or whole(df, name)
    try:
        out = cat.prepare_catalog(products([{"PRODUCT_SET_SID": "a", "ACTIVE_STATUS_COUNTRY": "UG", "COLOR_FAMILY": "Blue"}, {"PRODUCT_SET_SID": "a"},
                                            {"PRODUCT_SET_SID": "b", "ACTIVE_STATUS_COUNTRY": "UG"}]), "KE").collect()
    finally:
        cat.materialize = whole
    assert [(r["PRODUCT_SET_SID"], r["COLOR_FAMILY"], r["COUNT_VARIATIONS"]) for r in out] == [("a", "Blue", 1)]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate"):].splitlines()
    assert "_row" in grouped[1] and "CASE WHEN" in grouped[1]  # made in the projection below the aggregate


def test_queries_of_few_columns_prepare_no_others(spark, monkeypatch):
    """The first row of a set is one struct, which column pruning does not reach, so colours must not be read at all."""
    from shelfcheck_queries import queries as Q

    class Seen(Exception):
        pass

    def seen(df, name):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(Q, "materialize", seen)
    for name in ("chk_country_ng", "wrong_category"):
        with pytest.raises(Seen) as plan:
            Q.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "Aggregate" in str(plan.value) and "THEN Red" not in str(plan.value) and "12 months" not in str(plan.value)


def test_quality_report_joins_texts_to_ids_alone(spark, tmp_path, monkeypatch):
    from shelfcheck_queries import queries as queries_

    path, given = _tables(spark, tmp_path), []
    spark.createDataFrame([(0, "short")], "doc_id long, text string").write.mode("append").parquet(f"{path}/documents.parquet")
    whole = queries_.with_descriptions
    monkeypatch.setattr(queries_, "with_descriptions", lambda s, d, rows: given.append(rows.columns) or whole(s, d, rows))
    report = queries_.QUERIES["quality_report"](spark, path)
    assert given == [["PRODUCT_SET_SID"]]
    got = sorted((r["SKU"], r["Empty Description"], r["Thin Description"], r["Missing Images in Desc"], r["Repeated Description"])
                 for r in report.collect())
    # a product has a row for each of its texts, with what that text gives
    assert got == [(f"P0-{i}", "NO", "YES", miss, "YES") for i in (0, 1) for miss in ("NO", "YES")] + [("P1-1", "YES", "NO", "NO", "NO")]
    assert "listings_" in report._jdf.queryExecution().optimizedPlan().toString()
    by_id = queries_.quality_listings(spark, path).groupBy("PRODUCT_SET_SID").count()
    assert "Exchange" not in by_id._jdf.queryExecution().executedPlan().toString()


def test_issues_of_one_column_and_text_count_once(spark):
    rows = spark.createDataFrame([("1", "gun", "x"), ("2", "a plain long name", "x")], "PRODUCT_SET_SID string, NAME string, BRAND string")
    df = rows.withColumns({"CATEGORY_CODE": F.lit("1"), "SELLER_NAME": F.lit("s")})
    extra = spark.createDataFrame([("2", "Prohibited products", "same"), ("2", "Restricted brands", "same"), ("2", "NG - Books Seller", "b"),
                                   ("2", "Wrong Category", "c"), ("2", "no such flag", "d")], "sid string, flag string, detail string").withColumns(
        {"reason": F.lit(None).cast("string"), "cv": F.lit(False)})
    got = {r["SKU"]: r for r in Q.quality_report(df, RuleSet(spark, {}), "NG", extra).collect()}
    assert got["2"]["Top Issues"] == "[critical] same | [high] c | [high] same | [high] b"
    assert (got["2"]["Critical Issues"], got["2"]["High Issues"], got["2"]["Total Issues"], got["2"]["Quality Score"]) == (1, 3, 4, 39)
    assert got["1"]["Top Issues"] == "[medium] 1 words, 3 chars" and got["1"]["Naming Issue"] == "YES"


def test_listing_lines_meet_the_part_texts_last(spark, tmp_path):
    from shelfcheck.adapter import catalog

    plan = catalog(spark, _tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" in next(line for line in plan.splitlines() if "Join" in line)


def test_occurs_is_the_bounded_pattern(spark):
    from shelfcheck.functions.text import bounded, occurs

    texts = ["old anvil", "cold anvils", "anvil", "", "caf\u00e9 ring", "cafe\u0301 ring", "\u017fale now", "sale-now", "a.b c", "axb c", "ring's"]
    words = ["anvil", "Anvil", "old anvil", "CAF\u00c9", "cafe", "sale", "a.b", "ring", "", "\\E", "s", None]
    df = spark.createDataFrame([(t, w) for t in texts for w in words], "t string, w string")
    rows = df.select("t", "w", occurs(F.col("t"), F.col("w")).alias("now"), F.rlike("t", bounded(F.col("w"))).alias("was")).collect()
    assert [r for r in rows if r["now"] != r["was"]] == [] and any(r["now"] for r in rows)


def test_attribute_words_go_in_few_passes(spark):
    import random

    from shelfcheck.constants import PROMO_WORDS
    from shelfcheck.functions.text import any_of, strip

    def one_by_one(c):
        text = F.lower(F.coalesce(c, F.lit("")))
        for word in [v for v, _ in L.VARIANTS]:
            text = F.regexp_replace(text, rf"(?U)\b{any_of([word])}\b", "")
        text = F.regexp_replace(F.regexp_replace(text, L.SIZE_WORDS, ""), L.CAPACITY_WORDS, "")
        for word in PROMO_WORDS:
            text = F.regexp_replace(text, rf"(?U)\b{word}\b", "")
        return strip(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))

    rng = random.Random(5)
    bits = [*[v for v, _ in L.VARIANTS], *PROMO_WORDS, "multi", "color", "redo", "gb", "64", "small", "\u0301", "caf\u00e9"]
    names = ["".join(rng.choice(bits) + rng.choice([" ", "-", "", ".", " ", "_"]) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    new = df.select(L.remove_attributes(F.col("n")).alias("n"))
    assert new.collect() == df.select(one_by_one(F.col("n")).alias("n")).collect()
    assert new._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace(") < 12


def test_attributes_prepare_no_other_columns(spark):
    from shelfcheck_queries import queries as queries_

    plan = queries_.QUERIES["product_attributes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "BUY NOW" in plan and "GLOBAL_PRICE" not in plan


def test_enrichment_prepares_no_other_columns(spark, monkeypatch):
    from shelfcheck_queries import queries as queries_

    class Seen(Exception):
        pass

    def seen(df, *args):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(queries_.P, "fill_from_pages", seen)
    with pytest.raises(Seen) as plan:
        queries_.QUERIES["enriched_listings"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" in str(plan.value) and "BUY NOW" not in str(plan.value)
