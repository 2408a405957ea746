import random


from shelfcheck.operators import catalog as C


def test_headers_and_kind(spark):
    df = spark.createDataFrame([("s1", "n", None, "c")], " cod_productset_sid string, DSC_NAME string, dsc_brand_name string, extra string")
    out = C.standardize_columns(df)
    assert out.columns == ["PRODUCT_SET_SID", "NAME", "BRAND", "EXTRA", "MAIN_IMAGE"]
    assert out.first()["BRAND"] == "nan" and out.first()["MAIN_IMAGE"] == ""
    assert {r[0] for r in C.validate_schema(out).collect()} == {"Missing: CATEGORY_CODE", "Missing: ACTIVE_STATUS_COUNTRY"}
    live = spark.createDataFrame([("1",) * 6], "SKU string, Name string, Brand string, Category string, Price string, Seller string")
    assert C.detect_file_kind(live) == "post_qc" and C.detect_file_kind(out) == "pre_qc"


def test_country_scope_and_multi(products):
    rows = products([{"ACTIVE_STATUS_COUNTRY": c} for c in ("shop-ng", "Multiple", "KE", " ng ", None)])
    got = {r["PRODUCT_SET_SID"]: r["_IS_MULTI_COUNTRY"] for r in C.filter_country(rows, "NG").collect()}
    assert got == {"s0": False, "s1": True, "s3": False}
    assert {r["name"] for r in C.detected_countries(rows).collect()} == {"Nigeria", "Kenya", "'MULTIPLE'"}


def brute_fill(rows, col):
    out = {}
    for sid in {r["PRODUCT_SET_SID"] for r in rows}:
        own = sorted((r for r in rows if r["PRODUCT_SET_SID"] == sid), key=lambda r: r["_seq"])
        known = [r[col] for r in own]
        for i, r in enumerate(own):
            back = [v for v in known[: i + 1] if v is not None]
            ahead = [v for v in known[i:] if v is not None]
            out[r["_seq"]] = back[-1] if back else (ahead[0] if ahead else None)
    return out


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        sid = "hot" if rng.random() < 0.4 else f"p{rng.randint(0, 60)}"
        rows.append({
            "PRODUCT_SET_SID": sid, "NAME": f"name {rng.randint(0, 9)}", "ACTIVE_STATUS_COUNTRY": rng.choice(["KE", "UG", "shop-ke"]),
            "COLOR_FAMILY": rng.choice([None, None, "red", "blue"]), "PRODUCT_WARRANTY": rng.choice([None, "yes"]),
            "COUNT_VARIATIONS": rng.choice([None, "7", "x"]),
        })
    return rows


def test_fill_metadata_with_a_hot_set(products):
    df = products(random_rows(1)).repartition(7)
    rows = [r.asDict() for r in df.collect()]
    got = {r["_seq"]: r["COLOR_FAMILY"] for r in C.fill_metadata(df, ["COLOR_FAMILY"]).collect()}
    assert got == brute_fill(rows, "COLOR_FAMILY")


def test_prepare_equals_fill_scope_keep_first(products):
    for seed in (2, 3):
        df = products(random_rows(seed))
        rows = [r.asDict() for r in df.collect()]
        fills = {c: brute_fill(rows, c) for c in ("COLOR_FAMILY", "PRODUCT_WARRANTY", "COUNT_VARIATIONS")}
        for country in (None, "KE"):
            scope = [r for r in rows if country is None or r["ACTIVE_STATUS_COUNTRY"] != "UG"]
            want = {}
            for r in sorted(scope, key=lambda r: r["_seq"]):
                if r["PRODUCT_SET_SID"] not in want:
                    n = sum(x["PRODUCT_SET_SID"] == r["PRODUCT_SET_SID"] for x in scope)
                    stated = fills["COUNT_VARIATIONS"][r["_seq"]]
                    want[r["PRODUCT_SET_SID"]] = (
                        r["_seq"], r["NAME"], fills["COLOR_FAMILY"][r["_seq"]], fills["PRODUCT_WARRANTY"][r["_seq"]],
                        max(n, 7 if stated == "7" else 1),
                    )
            got = {r["PRODUCT_SET_SID"]: (r["_seq"], r["NAME"], r["COLOR_FAMILY"], r["PRODUCT_WARRANTY"], r["COUNT_VARIATIONS"])
                   for r in C.prepare_catalog(df, country).collect()}
            assert got == want


def test_common_sids(products):
    df = products([{"PRODUCT_SET_SID": s, "NAME": f} for s, f in (("a", "f1"), ("a", "f2"), ("b", "f1"), ("a", "f1"))])
    assert [r[0] for r in C.common_sids(df, "NAME").collect()] == ["a"]
    assert C.common_sids(df.filter("NAME = 'f1'"), "NAME").count() == 0


def test_search_and_page(products):
    df = products([{"NAME": f"item {i:02d}", "BRAND": "Red" if i % 2 else "x"} for i in range(10)])
    assert C.search(df, "RED", ["NAME", "BRAND"]).count() == 5
    assert [r["NAME"] for r in C.page(df, 1, 4, ["NAME"]).collect()] == [f"item {i:02d}" for i in range(4, 8)]
    assert C.filter_values(df, "BRAND", []).count() == 10


def test_only_named_columns_are_carried(products):
    out = C.prepare_catalog(products([{"COLOR": "Red", "MAIN_IMAGE": "x"}]), columns=["COLOR"])
    assert "MAIN_IMAGE" not in out.columns and out.first()["COLOR"] == "Red"


def test_rows_out_of_scope_are_not_grouped(spark, products, monkeypatch):
    df = products([
        {"PRODUCT_SET_SID": "a", "ACTIVE_STATUS_COUNTRY": "UG", "COLOR_FAMILY": "old"}, {"PRODUCT_SET_SID": "a"},
        {"PRODUCT_SET_SID": "a", "COLOR_FAMILY": "new"}, {"PRODUCT_SET_SID": "b"}, {"PRODUCT_SET_SID": "b", "ACTIVE_STATUS_COUNTRY": "UG", "COLOR_FAMILY": "late"},
        {"PRODUCT_SET_SID": "b", "COLOR_FAMILY": "later"}, {"PRODUCT_SET_SID": "c"}, {"PRODUCT_SET_SID": "c", "COLOR_FAMILY": "own"},
        *[{"PRODUCT_SET_SID": f"u{i}", "ACTIVE_STATUS_COUNTRY": "UG", "COLOR_FAMILY": "x"} for i in range(50)],
    ])
    written = {}
    plain = C.materialize
    monkeypatch.setattr(C, "materialize", lambda t, name="step": written.setdefault(name, plain(t, name)))
    got = {r["PRODUCT_SET_SID"]: (r["COLOR_FAMILY"], r["COUNT_VARIATIONS"]) for r in C.prepare_catalog(df, "KE").collect()}
    assert got == {"a": ("old", 2), "b": ("late", 2), "c": ("own", 2)}
    assert written["outside"].count() < 10 and {r[0] for r in written["late"].select("PRODUCT_SET_SID").collect()} == {"a", "b"}
