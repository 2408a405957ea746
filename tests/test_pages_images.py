import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcheck.operators import images as I
from shelfcheck.operators import pages as G
from shelfcheck.operators.catalog import prepare_catalog
from shelfcheck.sources.files import read_images

HTML = {
    "layer": '<script>var dataLayer = [{"ecommerce":{"detail":{"products":[{"price":"1,200","brand":"B","category":"C/D"}]}}}];</script>',
    "object": '<script type="application/ld+json">{"@type":"Product","image":["i1","i2"],"description":"a description that is long enough",'
              '"brand":"Plain","offers":[{"lowPrice":"5"}],"seller":{"name":"Vendor X"},"weight":{"value":"2","unitCode":"g"}}</script>',
    "options": '<h1>Midnight Black phone in Navy Blue and black</h1><form id="product_addtocart_form"><select><option value="">pick</option>'
               '<option value="1">XL</option><option value="2">Green</option><option disabled>no</option></select></form>',
    "spec list": '<ul class="-pvs"><li>Colour Red</li><li>Share</li><li>SKU: X1</li></ul><title>white cup</title>',
    "one pill": '<ul class="-pvs -mvs"><li><input value="Red, Blue, XL"/></li><li>Red/Blue/42</li></ul>',
    "stock": '<span class="bdg">x</span><p>Only 3 left!</p><p>(no ratings yet)</p><h3>Seller Information</h3><a href="/x">Good Shop</a>',
    "official": "<body><nav>Official Store</nav><p>shop</p></body>",
    "official badge": '<body><a href="/c/JMALL">mall</a></body>',
    "details": "<h2>Product details</h2><p>one</p><p>one</p><ul><li>two</li></ul><h2>Specifications</h2><p>three</p>",
    "box": "<b>What's in the box</b><div><ul><li>1 x phone</li><li>cable</li></ul></div>",
    "nested": '<div class="-prd-desc"><div>first <div>inner</div></div><p>second</p></div><p>after</p>'
              '<div class="x specs"><div><ul><li>Model: M1</li></ul></div><ul><li>Color: Red</li></ul></div><ul><li>Not: this</li></ul>',
    "nested details": '<h2>Product details</h2><div>a long first block <div>with more in it</div> and an end</div><div>short<p>kept</p></div>'
                      '<div class="promo-x"><p class="rate">text</p></div><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><h3>Delivery</h3><p>no</p>',
    "unclosed": '<div class="-prd-desc"><div>rest',
    "plain": "<p>nothing</p>",
}


@pytest.fixture(scope="module")
def fields(spark):
    df = spark.createDataFrame(list(HTML.items()), "url string, html string")
    return {r["url"]: r for r in G.extract_pages(df).collect()}


def test_structured_blocks(fields):
    assert (fields["layer"]["PRICE"], fields["layer"]["BRAND"], fields["layer"]["CATEGORY_PATH"]) == ("1200", "B", "C/D")
    one = fields["object"]
    assert (one["MAIN_IMAGE"], one["BRAND"], one["SELLER_NAME"], one["WEIGHT"]) == ("i1", "Plain", "Vendor X", "2 g")
    assert one["DESCRIPTION"].startswith("a description")


def test_variations(fields):
    opt = fields["options"]
    assert (opt["SIZES_AVAILABLE"], opt["COLOR"], opt["COUNT_VARIATIONS"]) == ("XL", "Green", "1")
    assert opt["COLOR_IN_TITLE"] == "Midnight Black, Navy Blue, Black"
    assert fields["spec list"]["COLOR"] == "White" and fields["spec list"]["COUNT_VARIATIONS"] == "1"
    assert (fields["one pill"]["SIZES_AVAILABLE"], fields["one pill"]["COLOR"]) == ("42", "Red, Blue")
    assert fields["plain"]["COLOR"] is None and fields["plain"]["COLOR_IN_TITLE"] == "None"


def test_texts(fields):
    assert fields["stock"]["STOCK_STATUS"] == "Only 3 left" and fields["stock"]["RATING"] == "0"
    assert fields["stock"]["SELLER_NAME"] == "Good Shop"
    assert [fields[k]["IS_OFFICIAL_STORE"] for k in ("official", "official badge", "plain")] == ["No", "Yes", "No"]
    assert fields["details"]["DESCRIPTION"] == "<p>one</p>\n<ul><li>two</li></ul>"
    assert fields["box"]["WHATS_IN_BOX"] == "1 x phone | cable"
    assert fields["plain"]["STOCK_STATUS"] == "In Stock"


def test_nested_blocks(fields):
    assert fields["nested"]["DESCRIPTION"] == '<div class="-prd-desc"><div>first <div>inner</div></div><p>second</p></div>'
    assert fields["nested"]["SPECIFICATIONS"] == "Model: M1 | Color: Red | SKU: M1"
    assert fields["nested details"]["DESCRIPTION"].split("\n") == [
        "<div>a long first block <div>with more in it</div> and an end</div>", "<p>kept</p>", '<p class="rate">text</p>',
        "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"]
    assert fields["unclosed"]["DESCRIPTION"] == '<div class="-prd-desc"><div>rest'


def test_listing(spark):
    html = '<nav class="breadcrumb"><span>Home</span><span>Phones</span></nav><a href="/l?page=3">3</a><b data-page="7"></b>'
    df = spark.createDataFrame([(html,), ("<p/>",)], "html string")
    assert [r[0] for r in df.select(G.listing_page_count(F.col("html"))).collect()] == [7, 1]
    assert [r[0] for r in df.select(G.listing_category(F.col("html"))).collect()] == ["Phones", ""]


def png(path, rgb):
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def square(size, share, color=(255, 0, 0)):
    img = np.full((size, size, 3), 255)
    side, at = int(size * share), int(size * (1 - share) / 2)
    img[at:at + side, at:at + side] = color
    return img


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("png")
    rng = np.random.default_rng(3)
    board = np.kron(np.indices((40, 40)).sum(axis=0) % 2, np.ones((10, 10)))[..., None] * np.array([255, 255, 255])
    smooth = np.kron(rng.integers(0, 200, (9, 9, 1)), np.ones((40, 40, 3)))
    pictures = {
        "white": np.full((400, 400, 3), 255), "black": np.zeros((400, 400, 3)), "red30": square(400, 0.3), "red65": square(400, 0.65),
        "red95": square(400, 0.95), "tall": square(400, 0.95)[:, :100], "wide": square(400, 0.95)[:100], "tiny": square(150, 0.95),
        "small": square(250, 0.95), "board": board, "grey": np.full((400, 400, 3), 128), "pic": smooth, "copy": np.clip(smooth + 4, 0, 255),
    }
    for name, rgb in pictures.items():
        png(folder / f"{name}.png", rgb)
    rows = I.image_features(read_images(spark, str(folder)))
    return rows.withColumn("origin", F.regexp_extract("origin", r"(\w+)\.png$", 1)).cache()


def test_features(features):
    got = {r["origin"]: r for r in features.collect()}
    assert got["white"]["coverage"] == 0 and got["white"]["bright"] == 1 and got["black"]["dark"] == 1
    assert got["red30"]["coverage"] == pytest.approx(0.09, abs=0.001) and got["red65"]["coverage"] == pytest.approx(0.4225, abs=0.001)
    assert got["red30"]["shares"]["red"] == 1.0 and got["red30"]["shares"]["blue"] == 0.0
    assert got["grey"]["sharpness"] == 0 and got["board"]["sharpness"] > 160
    assert (got["tall"]["width"], got["tall"]["height"]) == (100, 400)


def test_broken_images(spark, products, tmp_path):
    png(tmp_path / "good.png", square(400, 0.95))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG no picture")
    features = I.image_features(read_images(spark, str(tmp_path)))
    features = features.withColumn("origin", F.regexp_extract("origin", r"(\w+)\.png$", 1)).coalesce(1).cache()
    got = {r["origin"]: r for r in features.collect()}
    assert set(got) == {"good", "broken"} and got["broken"]["width"] is None and got["broken"]["signature"] is None
    one = I.image_features(read_images(spark, str(tmp_path / "good.png"))).first()
    assert got["good"]["width"] == 400 and got["good"]["signature"] == one["signature"]
    df = prepare_catalog(products([{"PRODUCT_SET_SID": n, "MAIN_IMAGE": n, "COLOR": "Blue", "SELLER_NAME": "s"} for n in got]))
    assert {r["sid"] for r in I.image_checks(df, features).collect()} == {"good"}
    assert [r["note"] for r in I.image_notes(df, features).collect() if r["sid"] == "broken"] == ["Broken Image"]
    assert {r["origin"]: r["warnings"] for r in I.size_warnings(features).collect()}["broken"] == ["Broken Image"]


def test_image_checks(products, features):
    names = ["white", "black", "red30", "red65", "red95", "tall", "wide", "tiny", "small", "board", "grey", "pic", "copy"]
    df = prepare_catalog(products([{"PRODUCT_SET_SID": n, "MAIN_IMAGE": n, "COLOR": "Blue" if n == "red95" else "Red",
                                    "SELLER_NAME": "s1" if n in ("pic", "copy") else n} for n in names]))
    hits = {}
    for r in I.image_checks(df, features).collect():
        hits.setdefault(r["flag"], {})[r["sid"]] = r["detail"]
    assert set(hits["Image Stretched"]) == {"tall", "wide"} and "Tall Aspect Ratio (100x400)" in hits["Image Stretched"]["tall"]
    assert hits["Image Blurry"] == {"tiny": "Image too small/blurry (150x150px) — below 200x200"}
    assert {"white", "red30", "red65"} <= set(hits["Image Product Coverage"]) and "red95" not in hits["Image Product Coverage"]
    assert {"white", "black"} <= set(hits["Image Exposure"]) and "red30" in hits["Image Exposure"]
    assert "red95" in hits["Image Color Mismatch"] and "red65" not in hits["Image Color Mismatch"]
    assert set(hits["Image Visual Duplicate"]) == {"pic", "copy"}
    assert {r["sid"] for r in I.sharpness_hits(df, features).collect()} >= {"grey", "white"}
    notes = {(r["sid"], r["note"][:16]) for r in I.image_notes(df, features).collect()}
    assert ("small", "Image resolution") in notes
    warns = {r["origin"]: r["warnings"] for r in I.size_warnings(features).collect()}
    assert warns["tall"] == ["Low Resolution", "Tall (Screenshot?)"] and warns["red95"] == []


def test_visual_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(400):
        sig = rng.choice(base)
        for b in rng.sample(range(64), rng.choice([0, 0, 3, 6, 10, 14])):
            sig ^= 1 << b
        rows.append((f"s{i:03d}", rng.choice(["hot", "hot", "hot", "a", "b"]), f"o{rng.randint(0, 250)}", sig - (1 << 64) if sig >> 63 else sig))
    rows += [(f"t{i:03d}", "hot", "same" if i < 20 else f"p{i}", 5) for i in range(60)]
    df = spark.createDataFrame(rows, "PRODUCT_SET_SID string, _seller_lower string, origin string, signature long")
    want = {}
    for sid, seller, origin, sig in rows:
        near = [(x, 1 - ((sig ^ y) & (1 << 64) - 1).bit_count() / 64) for x, s, o, y in rows if s == seller and o != origin]
        near = [n for n in near if n[1] >= 0.8]
        if near:
            want[sid] = min(near)
    got = {r["sid"]: (r["other"], r["similarity"]) for r in I.first_partners(df).collect()}
    assert got == want and len(got) > 100


def test_visual_duplicates_over_several_tiles(spark, monkeypatch):
    import random

    rng = random.Random(7)
    monkeypatch.setattr(I, "TILE", 8)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for i, sig in enumerate(base * 2):
        for b in rng.sample(range(64), 0 if i < 40 else rng.choice([1, 12, 13])):
            sig ^= 1 << b
        rows.append((f"s{i:02d}", 3, f"o{i}", sig - (1 << 64) if sig >> 63 else sig))
    df = spark.createDataFrame(rows, "PRODUCT_SET_SID string, _seller_lower int, origin string, signature long")
    near = I._near_classes(df.select("_seller_lower", "signature"))
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan  # no neighbours of a value are listed, so none are broadcast
    got = [tuple(r) for r in near.collect()]
    sigs = {s for *_, s in rows}
    want = {(3, a, b) for a in sigs for b in sigs if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 12}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_every_page_field_searches_the_page_once(spark):
    html = ('<ol class="breadcrumb"><a>Home</a><a>A</a><a>B</a></ol><script>dataLayer = [{"ecommerce":{"detail":{"products":[{"price":"1,500","brand":"Acme"}]}}}];'
            '__STORES__ = {"pdp":{"product":{"price":"9","image":"i.png"}}};</script>')
    out = G.extract_pages(spark.createDataFrame([(1, html)], "page_id long, html string"))
    row = out.first()
    assert (row["PRICE"], row["BRAND"], row["CATEGORY_PATH"], row["MAIN_IMAGE"]) == ("1500", "Acme", "A > B", "i.png")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("dataLayer") <= 4 and plan.count("aria-label") <= 2
