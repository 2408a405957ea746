"""Image features from the Spark image source, and predicates over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck.constants import EMPTY_COLORS
from shelfcheck.functions.text import clean_category_code, pystr, strip
from shelfcheck.session import materialize
from shelfcheck.sources.rules import RuleSet

SID = "PRODUCT_SET_SID"

# Color classes in (hue 0-180, saturation 0-255, value 0-255) boxes, first match names the class.
HSV_CLASSES = {
    "red": [((0, 70, 50), (10, 255, 255)), ((170, 70, 50), (180, 255, 255))],
    "orange": [((11, 70, 50), (25, 255, 255))],
    "yellow": [((26, 70, 50), (34, 255, 255))],
    "green": [((35, 40, 40), (85, 255, 255))],
    "blue": [((100, 60, 50), (130, 255, 255))],
    "purple": [((131, 50, 50), (160, 255, 255))],
    "pink": [((161, 50, 50), (169, 255, 255))],
    "white": [((0, 0, 200), (180, 30, 255))],
    "black": [((0, 0, 0), (180, 255, 40))],
    "grey": [((0, 0, 41), (180, 25, 200))],
    "gray": [((0, 0, 41), (180, 25, 200))],
    "brown": [((10, 60, 20), (20, 220, 160))],
    "silver": [((0, 0, 150), (180, 25, 220))],
    "gold": [((22, 80, 80), (32, 255, 255))],
}
BACKGROUND = ((0, 0, 200), (180, 30, 255))
MIN_COVERAGE, WARN_COVERAGE = 0.55, 0.75
MIN_COLOR_SHARE, MIN_COLOR_PIXELS = 0.05, 200
EXPOSURE_SHARE = 0.88
BLUR_SCORE = 80.0
SIMILARITY = 0.80
# Signatures of a tile, and of those compared with another tile at once.
TILE, ROWS_AT_ONCE = 4096, 256

FEATURES = (
    "origin string, width int, height int, coverage double, foreground long, bright double, dark double, "
    "sharpness double, shares map<string,double>, signature long"
)


def _hsv(bgr: np.ndarray) -> np.ndarray:
    """8-bit hue (half degrees), saturation and value."""
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    v, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = v - low
    safe = np.where(span == 0, 1, span)
    h = np.where(v == r, 60 * (g - b) / safe, np.where(v == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    h = np.where(span == 0, 0, np.where(h < 0, h + 360, h)) / 2
    s = np.where(v == 0, 0, 255 * span / np.where(v == 0, 1, v))
    return np.stack([np.rint(h) % 180, np.rint(s), v], axis=-1)


def _inside(hsv: np.ndarray, box: tuple) -> np.ndarray:
    return np.all((hsv >= np.array(box[0])) & (hsv <= np.array(box[1])), axis=-1)


def _features(bgr: np.ndarray) -> dict:
    """Numbers of one decoded image."""
    height, width = bgr.shape[:2]
    hsv = _hsv(bgr)
    product = ~_inside(hsv, BACKGROUND)
    rows, cols = np.flatnonzero(product.any(axis=1)), np.flatnonzero(product.any(axis=0))
    box = (rows[-1] - rows[0] + 1) * (cols[-1] - cols[0] + 1) if len(rows) else 0
    count = int(product.sum())
    gray = np.rint(0.114 * bgr[..., 0] + 0.587 * bgr[..., 1] + 0.299 * bgr[..., 2])
    edge = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    laplace = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * gray
    shares = {
        name: round(float((np.any([_inside(hsv, b) for b in boxes], axis=0) & product).sum()) / count, 4)
        for name, boxes in HSV_CLASSES.items()
    } if count else {}
    # Difference signature: an 8 x 9 grid of mean brightness, one bit per horizontal step.
    ys, xs = np.linspace(0, height, 9).astype(int), np.linspace(0, width, 10).astype(int)
    grid = np.array([[
        gray[ys[i]:max(ys[i + 1], ys[i] + 1), xs[j]:max(xs[j + 1], xs[j] + 1)].mean() for j in range(9)
    ] for i in range(8)])
    bits = (grid[:, 1:] > grid[:, :-1]).flatten()
    signature = int(np.packbits(bits).view(">u8")[0])
    return {
        "width": width, "height": height, "coverage": round(box / (height * width), 3), "foreground": count,
        "bright": float((gray >= 230).mean()), "dark": float((gray <= 25).mean()),
        "sharpness": round(float(laplace.var()), 2), "shares": shares,
        "signature": signature - (1 << 64) if signature >= 1 << 63 else signature,
    }


def image_features(images: DataFrame) -> DataFrame:
    """One feature row per image of the Spark image source; pixels stay in the tasks that decode them.

    Of an image that could not be decoded all features but the origin are null.
    """
    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, h, w, channels, data in batch.itertuples(index=False):
                if h < 1 or w < 1:
                    rows.append({"origin": origin})
                    continue
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(h, w, channels)
                bgr = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., :3]
                rows.append({"origin": origin, **_features(bgr)})
            # as objects, since a missing number would turn signatures into floats
            table = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in FEATURES.split(", ")], dtype=object)
            yield table.where(table.notna(), None)

    return flat.mapInPandas(run, FEATURES)


def attach_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """Products joined to the features of their image (``MAIN_IMAGE`` = ``origin``)."""
    return df.join(features, pystr("MAIN_IMAGE") == features["origin"])


def _hits(rows: DataFrame, flag: str, condition: Column, detail: Column, cv: bool) -> DataFrame:
    return rows.filter(condition).select(
        F.col(SID).alias("sid"), F.lit(flag).alias("flag"), detail.alias("detail"),
        F.lit(None).cast("string").alias("reason"), F.lit(cv).alias("cv"),
    )


def _size() -> Column:
    return F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))


def _percent(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 0), F.lit("%"))


def image_checks(df: DataFrame, features: DataFrame, rules: RuleSet | None = None,
                 visual_duplicates: bool = True) -> DataFrame:
    """Hits of every image check; ``df`` is a prepared catalog."""
    rows = attach_features(df, features)
    ratio = F.col("height") / F.col("width")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    parts = [
        _hits(rows, "Image Stretched", (ratio > 1.5) | (ratio < 0.6), text(
            "Image Stretched - ", F.when(ratio > 1.5, "Tall").otherwise("Wide"), " Aspect Ratio (", _size(), ")"), False),
        _hits(rows, "Image Blurry", (F.col("width") <= 200) & (F.col("height") <= 200), text(
            "Image too small/blurry (", _size(), "px) — below 200x200"), False),
        _hits(rows, "Image Product Coverage", F.col("coverage") < MIN_COVERAGE, text(
            "Product covers only ", _percent(F.col("coverage")), f" of image (minimum {MIN_COVERAGE * 100:.0f}% required)"), True),
        _hits(rows, "Image Exposure", (F.col("bright") >= EXPOSURE_SHARE) | (F.col("dark") >= EXPOSURE_SHARE), F.when(
            F.col("bright") >= EXPOSURE_SHARE,
            text("Overexposed — ", _percent(F.col("bright")), " of pixels at max brightness (washed out)"),
        ).otherwise(text("Underexposed — ", _percent(F.col("dark")), " of pixels at min brightness (too dark)")), True),
        color_mismatch(rows, rules),
    ]
    if visual_duplicates and "_seller_lower" in df.columns:
        parts.append(signature_duplicates(rows))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sharpness_hits(df: DataFrame, features: DataFrame) -> DataFrame:
    """Laplacian blur check; not part of the default run."""
    detail = F.concat(
        F.lit("Image blurry — sharpness score "), F.format_number("sharpness", 1), F.lit(f" (threshold {BLUR_SCORE:.0f})")
    )
    return _hits(attach_features(df, features), "Image Blurry", F.col("sharpness") < BLUR_SCORE, detail, True)


def color_class(c: Column) -> Column:
    """First color class whose name occurs in the declared color."""
    out = F.lit(None).cast("string")
    for name in reversed(list(HSV_CLASSES)):
        out = F.when(F.contains(c, F.lit(name)), name).otherwise(out)
    return out


def color_mismatch(rows: DataFrame, rules: RuleSet | None) -> DataFrame:
    declared = F.lower(strip(pystr("COLOR")))
    scoped = rows
    if rules is not None and rules.has("code_list") and "list:color" in rules.lists_with_codes():
        codes = rules.get("code_list").filter("list_name = 'color'").select(clean_category_code("code").alias("_code")).distinct()
        scoped = rows.join(codes, F.col("_cat_clean") == F.col("_code"), "left_semi")
    share = F.coalesce(F.element_at("shares", color_class(declared)), F.lit(0.0))
    mismatch = (
        ~declared.isin(*EMPTY_COLORS) & color_class(declared).isNotNull() & (F.col("foreground") >= MIN_COLOR_PIXELS)
        & (share < MIN_COLOR_SHARE)
    )
    detail = F.concat(
        F.lit("Color mismatch: declared '"), pystr("COLOR"), F.lit("' but only "), F.format_number(share * 100, 1),
        F.lit("% of product pixels match that hue"),
    )
    return _hits(scoped, "Image Color Mismatch", mismatch, detail, True)


def _near_pairs(batches):
    """Pairs of signatures of two tiles, packed as big-endian words, that agree in enough bits; both ways."""
    import pyarrow as pa

    most = max(d for d in range(65) if 1.0 - d / 64.0 >= SIMILARITY)
    for batch in batches:
        kind = batch.schema.field(0).type
        for seller, home, guest, same in zip(*(batch.column(i) for i in range(4)), strict=True):
            home, guest = np.frombuffer(home.as_buffer(), ">u8").astype(np.uint64), np.frombuffer(guest.as_buffer(), ">u8").astype(np.uint64)
            for at in range(0, len(home), ROWS_AT_ONCE):
                part = home[at : at + ROWS_AT_ONCE]
                differ = np.bitwise_count(part[:, None] ^ guest[None, :])
                i, j = np.nonzero((differ <= most) & (differ > 0))
                one, two = part[i].view(np.int64), guest[j].view(np.int64)
                if not same.as_py():
                    one, two = np.concatenate([one, two]), np.concatenate([two, one])
                yield pa.RecordBatch.from_arrays([pa.repeat(seller, len(one)).cast(kind), pa.array(one), pa.array(two)],
                                                 ["_seller_lower", "a", "b"])


def _near_classes(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different signatures of one seller that agree in at least 80 % of the bits, both ways.

    A seller's signatures are dealt over tiles of some ``TILE``, and every two tiles of a seller are compared in one
    task by exclusive-or and bit counts: comparisons grow with the square of a seller's different signatures, but only
    tiles and the pairs found are ever held or shuffled, and nothing is broadcast beyond Spark's own threshold.
    """
    key = ["_seller_lower"]
    chunks = classes.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_chunks"))
    dealt = classes.join(chunks, key).withColumn("_c", F.pmod(F.xxhash64("signature"), F.col("_chunks")).cast("int"))
    words = F.array_join(F.collect_list(F.lpad(F.hex("signature"), 16, "0")), "")
    tiles = materialize(dealt.groupBy(*key, "_c").agg(F.unhex(words).alias("home")), "tiles")
    guests = tiles.select(*key, F.col("_c").alias("_g"), F.col("home").alias("guest"))
    met = tiles.select(*key, "_c").join(guests.select(*key, "_g"), key).filter("_g >= _c").repartition(*key, "_c", "_g")
    pairs = met.join(tiles, [*key, "_c"]).join(guests, [*key, "_g"])
    return pairs.select(*key, "home", "guest", (F.col("_c") == F.col("_g")).alias("same")).mapInArrow(
        _near_pairs, f"_seller_lower {dict(classes.dtypes)['_seller_lower']}, a long, b long")


def first_partners(rows: DataFrame) -> DataFrame:
    """(sid, other, similarity): the smallest id of the same seller with a similar image at another address.

    Listings with equal signatures are one class, for which the smallest id and the smallest one at another
    address than that stand, so a picture listed many times costs one row in the comparison.
    """
    own = rows.filter(F.col("signature").isNotNull()).select(F.col(SID).alias("sid"), "_seller_lower", "origin", "signature")
    key = ["_seller_lower", "signature"]
    places = own.groupBy(*key, "origin").agg(F.min("sid").alias("sid"))
    firsts = places.groupBy(*key).agg(F.min(F.struct("sid", "origin")).alias("first"))
    seconds = places.join(firsts, key).filter(F.col("origin") != F.col("first.origin")).groupBy(*key).agg(
        F.min(F.struct("sid", "origin")).alias("second"))
    classes = materialize(firsts.join(seconds, key, "left"), "signatures")
    stands = classes.select("_seller_lower", F.col("signature").alias("b"), F.explode(F.array_compact(F.array("first", "second"))).alias("s"))
    near = _near_classes(classes).unionByName(classes.select("_seller_lower", F.col("signature").alias("a"), F.col("signature").alias("b")))
    agree = F.lit(1.0) - F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) / F.lit(64.0)
    offered = near.join(stands, ["_seller_lower", "b"]).select(
        "_seller_lower", F.col("a").alias("signature"), F.struct("s.sid", "s.origin", agree.alias("similarity")).alias("p"))
    best = offered.groupBy(*key).agg(F.min("p").alias("best"))
    other = offered.join(best, key).filter(F.col("p.origin") != F.col("best.origin")).groupBy(*key).agg(F.min("p").alias("other"))
    partner = F.when(F.col("best.origin") != F.col("origin"), F.col("best")).otherwise(F.col("other"))
    return own.join(best.join(other, key, "left"), key).select("sid", partner.alias("p")).filter("p IS NOT NULL").select(
        "sid", F.col("p.sid").alias("other"), F.col("p.similarity").alias("similarity"))


def signature_duplicates(rows: DataFrame) -> DataFrame:
    """Different images of one seller whose signatures agree in at least 80 % of the bits."""
    return first_partners(rows).select(
        "sid", F.lit("Image Visual Duplicate").alias("flag"),
        F.concat(F.lit("Visual duplicate detected ("), _percent(F.col("similarity")),
                 F.lit(" match) — same image as SID "), "other").alias("detail"),
        F.lit(None).cast("string").alias("reason"), F.lit(True).alias("cv"),
    )


def sign_signature(vector: str) -> Column:
    """64-bit signature of a vector: the signs of its first 64 values."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def image_notes(df: DataFrame, features: DataFrame) -> DataFrame:
    """Advisory notes (sid, note): not decodable, low resolution, low coverage, marginal sharpness."""
    rows = attach_features(df, features)
    small = (F.col("width") <= 200) & (F.col("height") <= 200)
    note = lambda cond, *p: F.when(cond, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p]))
    notes = F.array_compact(F.array(
        note(F.col("width").isNull(), "Broken Image"),
        note(~small & (F.col("width") < 300) & (F.col("height") < 300),
             "Image resolution low (", _size(), "px) — consider upgrading"),
        note(F.col("coverage").between(MIN_COVERAGE, WARN_COVERAGE) & (F.col("coverage") < WARN_COVERAGE),
             "Product coverage low (", _percent(F.col("coverage")), ") — consider reframing the photo"),
        note((F.col("sharpness") >= BLUR_SCORE) & (F.col("sharpness") < 2 * BLUR_SCORE),
             "Image sharpness marginal (score ", F.format_number("sharpness", 1), ") — consider re-shooting"),
    ))
    return rows.select(F.col(SID).alias("sid"), F.explode(notes).alias("note"))


def size_warnings(features: DataFrame) -> DataFrame:
    """Broken, low resolution, tall and wide warnings per image."""
    ratio = F.when(F.col("width") > 0, F.col("height") / F.col("width")).otherwise(1.0)
    return features.select("origin", F.array_compact(F.array(
        F.when(F.col("width").isNull(), "Broken Image"),
        F.when((F.col("width") < 300) | (F.col("height") < 300), "Low Resolution"),
        F.when(ratio > 1.5, "Tall (Screenshot?)").when(ratio < 0.6, "Wide Aspect"),
    )).alias("warnings"))
