import random
import re

import pytest

from shelfcheck.operators import checks as C
from shelfcheck.operators import duplicates as D
from shelfcheck.operators import keywords as K
from shelfcheck.operators.catalog import prepare_catalog
from shelfcheck.sources.rules import SCHEMAS, RuleSet, small_table


@pytest.fixture(scope="session")
def rules(spark):
    def build(**tables):
        return RuleSet(spark, {n: small_table(spark, rows, SCHEMAS[n]) for n, rows in tables.items()}, "Shop")

    return build


def run(df, rules, builder, country="KE"):
    rows = C.row_hits(prepare_catalog(df), rules, country, [builder]).collect()
    return {r["sid"]: (r["detail"], r["reason"]) for r in rows}


def test_single_word(products, rules):
    df = products([{"NAME": n} for n in ("one", "two words", "averyveryveryverylong name", "a b c d", "three good words here", " a  b  c ")])
    got = run(df, rules(), C.single_word_name)
    assert {k: v[0] for k, v in got.items()} == {
        "s0": "1 words, 3 chars", "s1": "2 words, 9 chars", "s2": "2 words", "s3": "7 chars", "s5": "7 chars"}
    assert set(run(df, rules(), lambda s: C.single_word_name(s, one_word_only=True))) == {"s0"}


def test_missing_color(products, rules):
    r = rules(code_list=[("color", "100")], word_list=[("colors", w) for w in ("red", "navy", "navy blue")])
    colors = [None, "Red", "random", "--", "dark navy", "navy", "x/red", "purple", "n/a", "Navy Blue and gold"]
    got = run(products([{"COLOR": c} for c in colors]), r, C.missing_color)
    assert set(got) == {"s0", "s2", "s3", "s4", "s7", "s8"}
    assert got["s7"][0] == "Invalid color value provided: 'purple'"
    assert got["s0"][0] == "Color missing in both NAME and COLOR attributes"
    assert run(products([{"NAME": "a RED shirt for men"}]), r, C.missing_color) == {}
    assert set(run(products([{"COLOR": c} for c in colors]), r, lambda s: C.missing_color(s, validate=False))) == {"s0", "s8"}


def test_weight_forms(products, rules):
    good = ["rice 1kg bag", "oil 500 ml", "pack of 6 cups", "a dozen eggs", "10's tabs", "5 µg pill", "price per kg", "24 pcs"]
    df = products([{"NAME": n} for n in good + ["plain rice", "kg of rice"]])
    assert set(run(df, rules(code_list=[("weight", "100.0")]), C.weight_in_name)) == {"s8", "s9"}


def test_warranty_needs_both_columns(products, rules):
    r = rules(code_list=[("warranty", "100")])
    rows = [{}, {"PRODUCT_WARRANTY": "yes"}, {"PRODUCT_WARRANTY": " none ", "WARRANTY_DURATION": "n/a"}, {"WARRANTY_DURATION": "None"}]
    assert set(run(products(rows), r, C.warranty)) == {"s0", "s2"}
    assert run(products(rows, drop=["WARRANTY_DURATION"]), r, C.warranty) == {}


def test_discounts(products, rules):
    prices = [("100", "49"), ("100", "48"), ("100", "3"), ("", "5"), ("100", "0"), ("2.5", "1")]
    df = products([{"GLOBAL_PRICE": p, "GLOBAL_SALE_PRICE": s} for p, s in prices])
    rows = C.row_hits(prepare_catalog(df), rules(), "KE", [C.discount]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["flag"], {})[r["sid"]] = r["detail"]
    assert set(by["Discount too high"]) == {"s1", "s2", "s5"}
    assert set(by["Suspicious Discount"]) == {"s0", "s1", "s5"}
    assert by["Discount too high"]["s1"] == "Discount too high: 52.0% (Price: USD 100.00 / KSh12,900 → Sale: USD 48.00 / KSh6,192)"


def test_fake_price_counts_missing_as_zero(products, rules):
    r = rules(fake_price=[("KE", "acme", "100", 50.0), ("UG", "acme", "100", 500.0)])
    rows = [{"GLOBAL_PRICE": "60"}, {"GLOBAL_PRICE": "60", "GLOBAL_SALE_PRICE": "40"}, {}, {"BRAND": "Other"}]
    assert set(run(products(rows), r, C.fake_price)) == {"s1", "s2"}


def test_price_cap_order(products, rules):
    r = rules(
        category=[("1", "A", 1), ("2", "A > B", 2), ("3", "A > B > C", 3), ("4", "Fashion > X", 4), ("5", "Zed", 5), ("6", "A > Q > R", 6)],
        price_cap=[("KE", "1", 1000.0), ("KE", "2", 2000.0), ("KE", "5", 0.5), ("UG", "3", 1.0)])
    rows = [{"CATEGORY_CODE": c, "GLOBAL_PRICE": "100"} for c in ("1", "2", "3", "4", "5", "6", "9")] + [{"CATEGORY_CODE": "4", "GLOBAL_PRICE": "501"}]
    got = {k: v[0] for k, v in run(products(rows), r, C.max_price).items()}
    assert set(got) == {"s0", "s1", "s2", "s4", "s5", "s7"}
    assert got["s2"].endswith("[ancestor 'A > B']") and got["s5"].endswith("[ancestor 'A']")
    assert got["s0"] == "Price (USD 100.00 → KSh12,900) exceeds category max (KSh1,000) [exact code 1]"
    assert got["s7"].endswith("[USD fallback for 'Fashion' ($500 × 129.0 rate)]")


def test_powerbank(products, rules):
    r = rules(powerbank_brand=[("anker",)], program_category=[("powerbank", "100")])
    rows = [
        {"NAME": "Power Bank 20,000 mAh", "BRAND": "Foo"}, {"NAME": "powerbank 19999mAh", "BRAND": "Foo"},
        {"NAME": "Power bank 30000mah", "CATEGORY_CODE": "7"}, {"NAME": "x 20000mAh", "BRAND": "Anker"},
    ]
    got = run(products(rows), r, C.powerbank)
    assert set(got) == {"s0", "s2"}
    assert got["s0"][0].startswith("Brand 'Foo' not approved for 20,000 mAh powerbanks.") and "Shop technical team" in got["s0"][1]
    assert got["s2"][1] == "1000007 - Wrong Category"


def test_sellers(products, rules):
    r = rules(
        seller_allow=[("KE", "books", "good"), ("KE", "refurb_phones", "good"), ("UG", "perfume", "good")],
        program_category=[("books", "1"), ("refurb_phones", "2"), ("refurb_laptops", "3"), ("perfume", "4"), ("jersey", "5")],
        program_keyword=[(None, "refurb", "renewed"), (None, "perfume", "chanel"), ("KE", "jersey", "arsenal")])
    one = lambda code, **k: products([{"CATEGORY_CODE": code, "SELLER_NAME": s, **k} for s in (" Good ", "bad")])
    assert set(run(one("1"), r, C.books_seller)) == {"s1"} and run(one("1"), r, C.books_seller, "UG") == {}
    got = run(one("2", NAME="iphone Renewed 64"), r, C.refurb)
    assert got == {"s1": ("Unapproved Phone refurb seller — keyword 'Renewed' in name (cat: 2)", None)}
    assert set(run(one("3", NAME="hp renewed"), r, C.refurb)) == {"s0", "s1"}
    assert set(run(one("4", BRAND="Chanel"), r, C.perfume_seller, "UG")) == {"s1"}
    assert run(one("4", BRAND="Chanel"), r, C.perfume_seller, "KE") == {}
    assert set(run(one("4", BRAND="Generic", NAME="like chanel no 5"), r, C.perfume_seller, "KE")) == {"s0", "s1"}
    assert set(run(one("5", NAME="ARSENAL home"), r, C.jerseys)) == {"s0", "s1"}
    assert run(one("5", NAME="arsenals home"), r, C.jerseys) == {}


def test_genuine_brand_longest_first(products, rules):
    r = rules(word_list=[("known_brands", b) for b in ("Sam", "Samsung", "L'Oreal", "HP")])
    names = ["Samsung TV", "Sam-TV", "samsungs tv", "l oreal cream", "HP", "the HP"]
    got = {k: v[0] for k, v in run(products([{"NAME": n, "BRAND": "generic"} for n in names]), r, C.genuine_brand).items()}
    assert got == {
        "s0": "Brand field 'Generic' but name starts with: Samsung", "s1": "Brand field 'Generic' but name starts with: Sam",
        "s3": "Brand field 'Generic' but name starts with: L'Oreal", "s4": "Brand field 'Generic' but name starts with: Hp"}
    assert run(products([{"NAME": "HP", "BRAND": "generic", "CATEGORY": "Phone Cases > case"}]), r, C.genuine_brand) == {}


def test_prohibited_keywords_and_texts(products, rules):
    r = rules(prohibited=[
        (None, 1, "gun", []), (None, 2, "gun oil", ["100"]), (None, 3, "oil", []), (None, 4, "c++", []), (None, 5, "é", ["9"])])
    names = ["Gun oil", "gunner", "learn C++ now", "oil and gun", "é"]
    got = {r_["sid"]: r_["detail"] for r_ in K.prohibited(prepare_catalog(products([{"NAME": n} for n in names])), r, "KE").collect()}
    assert got == {"s0": "Prohibited: gun, gun oil", "s2": "Prohibited: c++", "s3": "Prohibited: gun, oil"}


def brute_restricted(product, table):
    detail, comment = None, None
    for seq, brand, raw, sellers, cats, variations in table:
        name, own = product["NAME"].lower(), product["BRAND"].lower()
        hit = lambda w, t: re.search(r"(?<!\w)" + re.escape(w) + r"(?!\w)", t) is not None
        main = own == brand or hit(brand, name)
        longest = sorted(variations, key=lambda v: (-len(v), v))
        in_brand, in_name = any(hit(v, own) for v in longest), any(hit(v, name) for v in longest)
        if main:
            detail = ("main", raw)
        elif (in_brand or in_name) and detail is None:
            text = own if in_brand else name
            detail = ("var", f"{raw} (as '{next(v for v in longest if v in text)}')")
        if not (main or in_brand or in_name) or (cats and product["CATEGORY_CODE"] not in cats):
            continue
        if product["SELLER_NAME"].lower() not in sellers:
            comment = f"Restricted Brand: {detail[1]} - " + ("Seller not in approved list" if sellers else "No sellers approved")
    return comment


def test_restricted_brands_against_brute_force(products, rules):
    rng = random.Random(5)
    words = ["nike", "air", "max", "air max", "puma", "pu", "jordan"]
    table = []
    for seq in range(8):
        brand = rng.choice(words)
        table.append((seq, brand, brand.upper(), rng.sample(["seller", "s2"], rng.randint(0, 2)), rng.choice([[], ["100"], ["7"]]),
                      rng.sample(words, rng.randint(0, 3))))
    rows = [{"NAME": " ".join(rng.choice(words + ["x", "pumas"]) for _ in range(4)), "BRAND": rng.choice(words + ["Acme"]),
             "SELLER_NAME": rng.choice(["Seller", "S2", "S3"]), "CATEGORY_CODE": rng.choice(["100", "7"])} for _ in range(150)]
    got = {r["sid"]: r["detail"] for r in K.restricted_brands(
        prepare_catalog(products(rows)), rules(restricted_brand=[(None, *t) for t in table]), "KE").collect()}
    want = {f"s{i}": c for i, r in enumerate(rows) if (c := brute_restricted(r, table))}
    assert got == want and want


def test_substring_join_is_complete(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    hays = [(i, text(rng.randint(0, 14))) for i in range(80)]
    needles = [(i, text(rng.randint(1, 7))) for i in range(40)]
    got = K.contained(spark.createDataFrame(hays, "h int, hay string"), "hay", spark.createDataFrame(needles, "n int, needle string"), "needle")
    assert sorted((r["h"], r["n"]) for r in got.collect()) == sorted((h, n) for h, a in hays for n, b in needles if b in a)


def test_duplicates_with_hot_group(products, rules):
    rows = [{"NAME": "Best Hat!", "COLOR": "Red"}] * 30 + [{"NAME": "hat", "COLOR": "Red"}, {"NAME": "hat", "COLOR": "Blue"},
            {"NAME": "red hat", "COLOR": "Blue"}, {"NAME": "red hat", "COLOR": "Green"}, {"NAME": "hat", "COLOR": None, "COLOR_FAMILY": "red"}]
    r = rules(word_list=[("colors", "red")])
    df = prepare_catalog(products(rows))
    got = {x["sid"]: x["detail"] for x in D.duplicates(df, r).collect()}
    assert set(got) == {f"s{i}" for i in range(1, 31)} | {"s33", "s34"}
    assert got["s30"] == "Duplicate: 'Best Hat!'" and got["s33"] == "Duplicate: 'red hat'"
    assert "s31" in {x["sid"] for x in D.duplicates(df, r, by_color=False).collect()}


def test_long_lists_find_what_short_ones_do(products, rules):
    filler = [f"zzq{i}" for i in range(20_500)]
    words = {"unnecessary": ["buy now", "cheap"], "colors": ["red", "navy"], "sneaker_brands": ["nike"]}
    keys = {"refurb": ["renewed"], "perfume": ["chanel"], "jersey": ["arsenal"], "ng_xmas": ["xmas tree"]}
    codes = [(n, "100") for n in ("color", "sneakers", "perfume")]
    programs = [(n, "100") for n in ("refurb_phones", "jersey", "powerbank")]
    sellers = [(None, n, "other") for n in ("perfume", "ng_xmas")]
    build = lambda more: rules(
        word_list=[(n, w) for n, ws in words.items() for w in ws + more],
        program_keyword=[(None, n, w) for n, ws in keys.items() for w in ws + more],
        code_list=codes, program_category=programs, seller_allow=sellers,
        powerbank_brand=[("anker",)] + [(w,) for w in more], ma_brand=[("gucci",)] + [(w,) for w in more])
    rows = [{"NAME": n, "BRAND": b, "COLOR": c} for n, b, c in (
        ("Cheap hat BUY NOW", "Acme", "Red"), ("nike shoe for men", "Generic", "odd"), ("renewed phone", "Acme", None),
        ("chanel scent", "Generic", "navy"), ("arsenal shirt", "Acme", "red"), ("xmas tree big", "Acme", "red"),
        ("power 20000mAh bank", "noname", "red"), ("gucci bag", "Gucci", "red"))]
    df = prepare_catalog(products(rows))
    builders = [C.unnecessary_words, C.missing_color, C.sneakers, C.refurb, C.perfume_seller, C.jerseys, C.ng_xmas, C.powerbank, C.ma_brands]
    found = [sorted((r["sid"], r["flag"], r["detail"]) for r in C.row_hits(df, build(more), "KE", builders).collect()) for more in ([], filler)]
    assert found[0] == found[1] and {f for _, f, _ in found[0]} >= {"Unnecessary words in NAME", "Missing COLOR", "Counterfeit Sneakers"}
    assert len({f for _, f, _ in found[0]}) == len(builders)
    dup = [sorted(r["sid"] for r in D.duplicates(df, build(more)).collect()) for more in ([], filler)]
    assert dup[0] == dup[1]
