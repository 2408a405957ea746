from pyspark.sql import functions as F

from shelfcheck.plans import weekly as W
from shelfcheck.sources import files, rules, sinks
from shelfcheck.sources.flags import default_flags


def sheet(spark, header, rows):
    cols = header.split("|")
    data = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "rule_seq long, " + ", ".join(f"`{c}` string" for c in cols))


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_keyword_and_brand_sheets(spark):
    got = rules.load_prohibited(sheet(spark, "Keywords|Category", [("Gun ", "1.0, 2\n3"), ("keywords", ""), (None, "4"), ("Knife", None)]), "KE")
    assert rows_of(got, "keyword", "categories") == [("gun", ["1", "2", "3"]), ("knife", [])]
    brands = rules.load_restricted_brands(sheet(spark, "brand|approved sellers|categories|variations", [
        ("Nike", "A, b", "1.0", "air"), ("nike ", "C", "2", None), ("Puma", None, "3", None), ("PUMA", None, None, "pm"), ("nan", "x", "", "")]), "KE")
    assert rows_of(brands, "brand", "brand_raw", "sellers", "categories", "variations") == [
        ("nike", "Nike", ["a", "b", "c"], ["1", "2"], ["air"]), ("puma", "Puma", [], [], ["pm"])]


def test_program_sheets(spark):
    refurb = sheet(spark, "Phones|Laptops", [("phones", "Laptop"), ("S1", "s2 "), (None, "s3")]).drop("rule_seq")
    assert rows_of(rules.load_refurb_sellers(refurb, "KE"), "program", "seller") == [
        ("refurb_laptops", "s2"), ("refurb_laptops", "s3"), ("refurb_phones", "s1")]
    assert rows_of(rules.load_refurb_categories(refurb.select(F.lit("12.0").alias("a"), F.lit("Laptops").alias("b"))), "program", "code") == [
        ("refurb_phones", "12")]
    perfume = sheet(spark, "id|SellerName", [("1", "Seller"), ("2", " Good "), ("3", None)]).drop("rule_seq")
    assert rows_of(rules.load_seller_list(perfume, "KE", "perfume"), "seller") == [("good",)]
    assert rows_of(rules.load_keyword_list(sheet(spark, "Brand", [("Dior",), ("brand",)]).drop("rule_seq"), "perfume"), "keyword") == [("dior",)]
    assert rows_of(rules.load_category_list(sheet(spark, "Category", [("5.0",), ("categories",)]).drop("rule_seq"), "books"), "code") == [("5",)]


def test_fake_price_and_caps(spark):
    wide = sheet(spark, "Brand|Nike|Puma|Bad", [("Price", "50", "20.5", "x"), ("c", "1.0", "2", "3"), ("c", "4", None, "5")])
    assert rows_of(rules.load_fake_price(wide, "KE"), "brand", "category", "min_price") == [
        ("nike", "1", 50.0), ("nike", "4", 50.0), ("puma", "2", 20.5)]
    caps = spark.createDataFrame([("n", "007", "10", None), ("n", "code", "1", "1"), ("n", "8", "0", "x2")], "name string, category_code string, KE string, UG string")
    assert rows_of(rules.load_price_caps(caps, ["KE", "UG"]), "country", "code", "cap_local") == [("KE", "7", 10.0)]


def test_category_maps_and_weights(spark):
    raw = sheet(spark, "category_name|category_code|Category Path", [("Hats", "1.0", "Fashion / Hats"), ("Caps", "2", "Fashion / Top"), ("Hats", "3", "Other / Top")])
    assert rows_of(rules.load_category_map(raw), "code", "path") == [("1", "Fashion / Hats"), ("2", "Fashion / Top"), ("3", "Other / Top")]
    assert rows_of(rules.load_category_names(raw), "name", "code") == [("caps", "2"), ("hats", "3"), ("top", "2")]
    categories = rules.load_category_map(raw)
    listed = spark.createDataFrame([('[{"category_name":"Car","category_code":1,"positive":{"Wax":2,"polish":3}},{"category":"X","keywords":{"k":1}}]',)], "json string")
    assert rows_of(rules.load_keyword_weights(listed, categories), "category", "keyword", "weight") == [
        ("fashion / hats", "polish", 3.0), ("fashion / hats", "wax", 2.0), ("x", "k", 1.0)]
    mapped = spark.createDataFrame([('{"A > B":{"k":2.5}}',)], "json string")
    assert rows_of(rules.load_keyword_weights(mapped, categories), "category", "keyword", "weight") == [("a > b", "k", 2.5)]
    up = rules.ancestors(spark.createDataFrame([("1", "A > B > C", 1)], "code string, path string, seq long"))
    assert rows_of(up, "depth", "ancestor") == [(1, "A"), (2, "A > B")]


def test_country_rule_sheets(spark):
    books = rules.load_ng_books(sheet(spark, "Book|Seller", [("Big Book", None), ("Other", " S1 "), ("nan", "x")]))
    assert rows_of(books, "title", "seller") == [("big book", None), ("other", "s1")]
    codes, sellers = rules.load_ng_tvs(sheet(spark, "Category|LG|Sony", [("1.0", "lg", "a"), ("2", "B", None)]).drop("rule_seq"))
    assert rows_of(codes, "code") == [("1",), ("2",)] and rows_of(sellers, "brand", "seller") == [("lg", "b"), ("sony", "a")]
    rice = rules.load_ng_rice(sheet(spark, "Brand|Sellers|Cat", [("Mama", "A, b", "1.0"), ("mama", "c", "nan"), ("Cap", None, None)]).drop("rule_seq"))
    assert rows_of(rice, "brand", "sellers", "categories") == [("cap", [], []), ("mama", ["a", "b", "c"], ["1"])]
    restricted, prohibited = rules.load_ma_brands(sheet(spark, "Restricted Brand|Authorized Vendors", [("Adidas", "V1"), ("adidas", "none"), ("Zed", None), ("Brand", "x")]))
    assert rows_of(restricted, "brand", "sellers") == [("adidas", ["v1"])] and rows_of(prohibited, "brand") == [("zed",)]
    assert rows_of(rules.load_ma_keywords(sheet(spark, "kw", [("Arme",), ("keyword",)])), "keyword") == [("arme",)]


def test_flags_keep_country_defaults(spark):
    custom = spark.createDataFrame([("Missing COLOR", "1", "en text", None), ("NG - Apple Seller", "9", "mine", "x"), ("nan", "", "", "")],
                                   "flag string, reason string, comment string, french string")
    got = {r["flag"]: r for r in rules.load_flags(custom, default_flags(spark, "Shop")).collect()}
    assert got["Missing COLOR"]["fr"] == "en text" and got["NG - Apple Seller"]["reason"].startswith("1000003")
    assert len(got) == 1 + sum(k.startswith("NG - ") for k in got)


def test_reference_tables(spark):
    ref = rules.load_reference_categories(spark.createDataFrame([(" E1 ", "Hats", "Fashion / Big Hats"), ("", "x", "y")], "export_category string, category_name string, `Category Path` string"))
    assert rows_of(ref, "export_category", "category_name_lower", "path_tokens", "depth") == [("E1", "hats", ["fashion", "big", "hats"], 1)]
    brands = rules.load_reference_brands(spark.createDataFrame([("12 - Nike - Air",), ("Solo",)], "b string"))
    assert rows_of(brands, "brand_name_lower") == [("nike - air",), ("solo",)]


def test_catalog_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿cod_productset_sid;dsc_name;color\n1;Café;red\n2;donâ€™t;\n".encode())
    (tmp_path / "b.csv").write_bytes("PRODUCT_SET_SID,NAME,BRAND\n1,Zoë “x”,B\n".encode("cp1252"))
    out = files.read_many(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["PRODUCT_SET_SID"], r["NAME"], r["BRAND"], r["COLOR"], r["_file"]) for r in out.collect()) == [
        ("1", "Café", None, "red", 0), ("1", "Zoë “x”", "B", None, 1), ("2", "don’t", None, None, 0)]
    names = [r["NAME"] for r in out.orderBy("_seq").collect()]
    assert names == ["Café", "don’t", "Zoë “x”"]
    (tmp_path / "p.csv").write_text("sku|name\n1|a\n")
    assert files.read_pipe_csv(spark, str(tmp_path / "p.csv")).drop("_seq").collect() == [("1", "a")]
    (tmp_path / "s.csv").write_bytes("sku;name\n1;é\n".encode("latin-1"))
    assert files.read_csv_semicolon_fallback(spark, str(tmp_path / "s.csv")).first()["name"] == "é"
    (tmp_path / "w.txt").write_text(" Red \n\n blue\n")
    assert rows_of(files.read_word_list(spark, str(tmp_path / "w.txt"), "colors", lower=True), "word") == [("blue",), ("red",)]


def test_weekly_exports(spark, tmp_path):
    for name, body in {
        "KE_x_2024-03-04.csv": "ProductSetSid,Status,FLAG,SellerName\n1,Approved,,A\n2,Rejected,F1,A\n",
        "ke_y_2024-03-09.csv": "ProductSetSid,Status,FLAG,SellerName\n3,Rejected,F2,B\n4,Rejected,F2,A\n", "KE_nodate.csv": "ProductSetSid,Status,FLAG,SellerName\n9,Approved,,A\n",
    }.items():
        (tmp_path / name).write_text(body)
    df = files.read_export_files(spark, str(tmp_path))
    assert rows_of(df.select("ProductSetSid", "Day", "Week", "Country"), "ProductSetSid", "Day", "Week", "Country") == [
        ("1", "Monday", 10, "Kenya"), ("2", "Monday", 10, "Kenya"), ("3", "Saturday", 10, "Kenya"), ("4", "Saturday", 10, "Kenya")]
    daily = [tuple(r) for r in W.daily_summary(df).collect()]
    assert daily[0] == ("Monday", 1, 1, 2) and daily[5] == ("Saturday", 0, 2, 2) and daily[-1] == ("Weekly Total", 1, 3, 4) and len(daily) == 8
    row = W.insights(df).first()
    assert (row["busiest_day"], row["top_reason"], row["worst_seller"], row["rejection_rate"]) == ("Monday", "F2", "A", 75.0)
    sinks.write_executive({k: v for k, v in W.weekly_report(df.withColumn("CATEGORY", F.lit("c"))).items()}, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"cover", "daily_summary", "seller_stats", "reasons", "top_categories"}


def test_weekly_tables_read_the_rows_once(spark, tmp_path):
    spark.createDataFrame([("1", "Approved", "", "A", "Monday"), ("2", "Rejected", "F1", None, "Monday"), ("3", "Rejected", "F1", "B", "Friday"),
                           ("4", None, "F2", "B", "Friday"), ("5", "Rejected", "F2", "A", None)],
                          "ProductSetSid string, Status string, FLAG string, SellerName string, Day string").write.parquet(str(tmp_path / "week"))
    df = spark.read.parquet(str(tmp_path / "week"))
    one, daily = W.insights(df), W.daily_summary(df)
    assert not {f for t in (one, daily) for f in t.inputFiles() if f.startswith(f"file://{tmp_path}")}
    assert one.first().asDict() == {"total": 4, "approved": 1, "rejected": 3, "rejection_rate": 75.0, "verdict": "action required", "busiest_day": "Monday",
                                    "top_reason": "F1", "top_reason_count": 2, "top_reason_share": 200 / 3, "worst_seller": "A", "worst_seller_rejected": 1}
    assert [tuple(r) for r in daily.collect()][::4] == [("Monday", 1, 1, 2), ("Friday", 0, 1, 1)] and tuple(daily.collect()[-1]) == ("Weekly Total", 1, 2, 3)


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([("s1", "p", "Rejected", "r", "donâ€™t", "F", "S"), ("s2", "p", "Approved", "", "", "", "S")],
                                   "ProductSetSid string, ParentSKU string, Status string, Reason string, Comment string, FLAG string, SellerName string")
    assert sinks.export_report(report.drop("ParentSKU"), "rejected").first()[:5] == ("s1", None, "Rejected", "r", "don’t")
    parts = {r["i"]: r["part"] for r in sinks.split_parts(spark.range(25).withColumnRenamed("id", "i"), [F.asc("i")], 10).collect()}
    assert parts == {i: i // 10 + 1 for i in range(25)}
    sinks.write_split(spark.range(25).withColumnRenamed("id", "i"), [F.asc("i")], str(tmp_path / "split"), 10)
    assert {p.name for p in (tmp_path / "split").iterdir() if p.name.startswith("part=")} == {"part=1", "part=2", "part=3"}
    sinks.write_csv_bom(report.coalesce(1), str(tmp_path / "bom"))
    first = next((tmp_path / "bom").glob("*.csv")).read_bytes()
    assert first.startswith(b"\xef\xbb\xbfProductSetSid")
    live = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "PRODUCT_SET_SID string, _x int")
    out = {r["PRODUCT_SET_SID"]: (r["FINAL_FLAG"], r["FLAG_REASON"]) for r in sinks.export_post_qc(live, report).collect()}
    assert out == {"s1": ("F", "donâ€™t"), "s2": ("ok", "ok"), "s3": ("ok", "ok")}


def test_quoted_line_breaks(spark, tmp_path):
    from shelfcheck.sources.files import read_catalog_csv

    (tmp_path / "a.csv").write_text('PRODUCT_SET_SID,NAME\nx1,"first line\nline two"\nx2,"say ""hi"""\n', encoding="utf-8")
    rows = {r["PRODUCT_SET_SID"]: r["NAME"] for r in read_catalog_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {"x1": "first line\nline two", "x2": 'say "hi"'}


def test_records_over_many_splits(spark, tmp_path):
    import csv
    import random

    rng = random.Random(5)
    pieces = ["plain", 'say "hi"', "two\nlines", "\n\nblank", "a;b", "a,b", "tab\tin", '"', "é", "x" * 90, "long\n" * 60, "5\" wide", ""]
    rows = [[str(i), "".join(rng.choice(pieces) for _ in range(3)), rng.choice(pieces)] for i in range(900)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for sep, encoding in [(",", "utf-8"), (";", "cp1252"), ("\t", "utf-8")]:
            path = tmp_path / f"r{ord(sep)}.csv"
            with open(path, "w", encoding=encoding, newline="") as f:
                out = csv.writer(f, delimiter=sep, lineterminator="\n")
                out.writerow(["PRODUCT_SET_SID", "NAME", "BRAND"])
                out.writerows(rows)
                f.write(f'900{sep}7" screen{sep}unquoted\n\n901{sep}"end{sep}""\nlast"{sep}')
            df = files.read_catalog_csv(spark, str(path))
            assert df.select("_seq.block").distinct().count() > 20
            got = [[r["PRODUCT_SET_SID"], r["NAME"] or "", r["BRAND"] or ""] for r in df.orderBy("_seq").collect()]
            assert got == [*rows, ["900", '7" screen', "unquoted"], ["901", f'end{sep}"\nlast', ""]], (sep, encoding)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
