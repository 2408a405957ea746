"""Live listings: value preparation, category codes, live-only checks and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck.constants import QUALITY_ALIASES
from shelfcheck.functions.prices import derive_discount, fmt, parse_price
from shelfcheck.functions.text import (
    alnum_key,
    blank,
    filled,
    group_key,
    normalize_path_separator,
    num,
    path_segments,
    pystr,
    strip,
)
from shelfcheck.operators.checks import Check, Scope
from shelfcheck.operators.keywords import contained
from shelfcheck.session import release

SID = "PRODUCT_SET_SID"
SEQ = "_seq"


# ---------------------------------------------------------------------------
# Category codes
# ---------------------------------------------------------------------------


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "_")


def resolve_category_code(df: DataFrame, names: DataFrame, out: str = "CATEGORY_CODE") -> DataFrame:
    """Code of the last path segment that names a category, else a slug of the leaf.

    Works on the distinct category texts and joins the result back.
    """
    raw = pystr("CATEGORY")
    texts = df.select(raw.alias("_text")).distinct().select("_text", path_segments("_text").alias("_segs"))
    places = texts.select("_text", F.posexplode(F.reverse("_segs")).alias("_pos", "_seg"))
    known = names.select(F.col("name").alias("_name"), F.col("code").alias("_found"))
    codes = places.join(known, F.lower("_seg") == F.col("_name")).groupBy("_text").agg(
        F.min_by("_found", "_pos").alias("_found")
    )
    leaf = F.when(F.size("_segs") > 0, F.element_at("_segs", -1)).otherwise(F.col("_text"))
    solved = texts.join(codes, "_text", "left").select(
        "_text",
        F.when(F.col("_text").isin("", "nan"), "").otherwise(F.coalesce("_found", slug(leaf))).alias("_code"),
    )
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.join(solved, raw == F.col("_text"), "left").select(*keep, F.col("_code").alias(out))


def resolve_category_code_fuzzy(df: DataFrame, cmap: DataFrame, out: str = "CATEGORY_CODE") -> DataFrame:
    """Path, then segment name, then the longest key inside or around a segment, else what is there.

    ``cmap`` has (seq, name, code, path).  Each stage sees only the texts the one
    before left open; substring pairs come from a gram join, not a full product.
    """
    valid = cmap.withColumn("code", F.substring_index(strip("code"), ".", 1)).filter(F.col("code").rlike(r"^\d+$"))
    word = lambda c: F.when(~F.lower(strip(c)).isin("nan", "none", ""), strip(c))
    raw = strip(pystr("CATEGORY"))
    texts = df.select(raw.alias("_text")).distinct().filter(~F.lower("_text").isin("nan", "none", ""))
    paths = valid.filter(word("path").isNotNull()).groupBy(
        normalize_path_separator("path").alias("_key")
    ).agg(F.max_by("code", "seq").alias("_code"))
    by_path = texts.join(paths, normalize_path_separator("_text") == F.col("_key")).select("_text", "_code")
    left = texts.join(by_path, "_text", "left_anti")

    places = left.select(
        "_text", F.posexplode(F.reverse(path_segments("_text", r"[>/|\\]"))).alias("_pos", "_seg")
    ).withColumn("_seg", F.lower("_seg"))
    names = valid.filter(word("name").isNotNull()).groupBy(F.lower(word("name")).alias("_seg")).agg(
        F.max_by("code", "seq").alias("_found")
    )
    by_name = places.join(names, "_seg").groupBy("_text").agg(F.min_by("_found", "_pos").alias("_code"))
    open_ = places.join(by_name, "_text", "left_anti")

    entries = F.concat(
        F.array(F.struct(word("name").alias("k"), F.lit(-1).alias("p"))),
        F.transform(F.split(F.coalesce(word("path"), F.lit("")), " / "), lambda s, i: F.struct(strip(s).alias("k"), i.alias("p"))),
    )
    keys = (
        valid.select("seq", "code", F.explode(entries).alias("e"))
        .filter(word("e.k").isNotNull())
        .groupBy(F.lower("e.k").alias("_k"))
        .agg(F.min_by("code", F.struct("seq", "e.p")).alias("_c"), F.min(F.struct("seq", "e.p")).alias("_o"))
        .withColumn("_kn", alnum_key("_k")).filter(F.length("_kn") >= 3)
    )
    segs = open_.withColumn("_sn", alnum_key("_seg")).filter("_sn <> ''")
    inside = contained(segs, "_sn", keys, "_kn")
    around = contained(keys, "_kn", segs, "_sn")
    pick = ["_text", "_pos", "_kn", "_k", "_c", "_o"]
    order = F.struct("_pos", -F.length("_kn"), -F.length("_k"), "_o")
    fuzzy = inside.select(*pick).unionByName(around.select(*pick)).groupBy("_text").agg(
        F.min_by("_c", order).alias("_code")
    )
    solved = by_path.unionByName(by_name).unionByName(fuzzy).select(F.col("_text").alias("_t"), F.col("_code").alias("_solved"))
    existing = strip(F.coalesce(F.col(out).cast("string"), F.lit(""))) if out in df.columns else F.lit("")
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.join(solved, raw == F.col("_t"), "left").select(*keep, F.coalesce("_solved", existing).alias(out))


def unresolved_categories(df: DataFrame) -> DataFrame:
    """Distinct category texts without a numeric code."""
    return df.filter(~F.coalesce(F.col("CATEGORY_CODE"), F.lit("")).rlike(r"^\d+$") & F.col("CATEGORY").isNotNull()).select(
        "CATEGORY"
    ).distinct()


def resolved_count(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.coalesce(F.col("CATEGORY_CODE"), F.lit("")).rlike(r"^\d+$")).alias("resolved"), F.count("*").alias("total")
    )


# ---------------------------------------------------------------------------
# Values
# ---------------------------------------------------------------------------


def normalize_post_qc(df: DataFrame, names: DataFrame) -> DataFrame:
    """Quality-report input: exact header names, defaults, category codes."""
    out = df.withColumnsRenamed({c: QUALITY_ALIASES[c.strip()] for c in df.columns if c.strip() in QUALITY_ALIASES})
    if "CATEGORY" in out.columns:
        out = resolve_category_code(out, names)
    has = set(out.columns)
    fixes = {
        "_IS_MULTI_COUNTRY": F.lit(False),
        "PARENTSKU": F.col(SID) if SID in has else F.lit(None).cast("string"),
        "COLOR_FAMILY": F.lit(""),
        "GLOBAL_SALE_PRICE": F.col("GLOBAL_PRICE") if "GLOBAL_PRICE" in has else F.lit(""),
    }
    for name, default in (("ACTIVE_STATUS_COUNTRY", "UNKNOWN"), ("COLOR", ""), ("COUNT_VARIATIONS", "1")):
        if name not in has:
            fixes[name] = F.lit(default)
    return out.withColumns(fixes)


def wholly_blank(df: DataFrame, column: str) -> bool:
    """Is a column absent or blank in every row?  One early-stopping probe."""
    return column not in df.columns or df.filter(filled(column, ("nan", "None")).isNotNull()).isEmpty()


def build_variation_list(df: DataFrame) -> DataFrame:
    parts = [c for c in ("COLOR", "SIZES_AVAILABLE") if c in df.columns]
    if not wholly_blank(df, "LIST_VARIATIONS"):
        return df
    if not parts:
        return df.withColumn("LIST_VARIATIONS", F.lit(""))
    joined = F.concat_ws(" | ", *[filled(c, ("nan", "None")) for c in parts])
    return df.withColumn("LIST_VARIATIONS", F.nullif(joined, F.lit("")))


def choose_prices(df: DataFrame) -> DataFrame:
    """Sale price from the first price column present, blanks from PRICE; regular = sale when wholly blank."""
    has = set(df.columns)
    first = next((c for c in ("GLOBAL_SALE_PRICE", "GLOBAL_PRICE", "SALE_PRICE") if c in has), None)
    if first is None:
        sale = F.lit("")
    else:
        sale = F.col(first).cast("string") if first == "GLOBAL_SALE_PRICE" else parse_price(first)
    if "PRICE" in has:
        sale = F.when(strip(F.coalesce(sale, F.lit("nan"))) == "", parse_price("PRICE")).otherwise(sale)
    out = df.withColumn("GLOBAL_SALE_PRICE", sale)
    if wholly_blank(df, "GLOBAL_PRICE"):
        out = out.withColumn("GLOBAL_PRICE", F.col("GLOBAL_SALE_PRICE"))
    return out


def category_fallback(df: DataFrame) -> DataFrame:
    if "CATEGORY_PATH" not in df.columns:
        return df
    if "CATEGORY" not in df.columns:
        return df.withColumn("CATEGORY", F.col("CATEGORY_PATH"))
    return df.withColumn("CATEGORY", F.when(F.col("CATEGORY") == "", F.col("CATEGORY_PATH")).otherwise(F.col("CATEGORY")))


def derive_official_store(df: DataFrame, tag: str = "JMALL") -> DataFrame:
    if "TAGS" not in df.columns or not wholly_blank(df, "IS_OFFICIAL_STORE"):
        return df
    hit = F.coalesce(F.col("TAGS"), F.lit("")).rlike(f"(?i){tag}")
    return df.withColumn("IS_OFFICIAL_STORE", F.when(hit, "Yes").otherwise("No"))


def color_from_title(df: DataFrame) -> DataFrame:
    if "COLOR_IN_TITLE" not in df.columns:
        return df
    title = blank("COLOR_IN_TITLE", ("nan", "None", "none"))
    real = (title != "") & (F.lower(title) != "none")
    return df.withColumn("COLOR", F.when(real, title).otherwise("None"))


def fill_discount(df: DataFrame) -> DataFrame:
    stated = F.col("DISCOUNT") if "DISCOUNT" in df.columns else F.lit("")
    return df.withColumn("DISCOUNT", derive_discount(stated, "GLOBAL_PRICE", "GLOBAL_SALE_PRICE"))


# ---------------------------------------------------------------------------
# Advisory columns
# ---------------------------------------------------------------------------


def advisory_columns(df: DataFrame) -> DataFrame:
    """Corrupted old price, discount mismatch, brand twice in title, rating without reviews."""
    has = set(df.columns)
    opt = lambda c: num(c) if c in has else F.lit(None).cast("double")
    old, sale = opt("GLOBAL_PRICE"), opt("GLOBAL_SALE_PRICE")
    corrupted = F.coalesce((old > 0) & (sale > 0) & (old > sale * 500), F.lit(False))
    stated = num(F.replace(pystr("DISCOUNT"), F.lit("%"), F.lit(""))) if "DISCOUNT" in has else F.lit(None).cast("double")
    computed = F.when((old > 0) & (sale < old), (old - sale) / old * 100)
    brand, name = F.lower(strip(pystr("BRAND"))), F.lower(pystr("NAME"))
    repeats = F.try_divide(F.length(name) - F.length(F.replace(name, brand, F.lit(""))), F.length(brand))
    rating, reviews = opt("RATING"), opt("REVIEW_COUNT")
    return df.withColumns({
        "_OLD_PRICE_CORRUPTED": corrupted,
        "_DISCOUNT_MISMATCH": F.coalesce(~corrupted & (F.abs(computed - stated) > 5), F.lit(False)),
        "_BRAND_IN_TITLE": F.coalesce((brand != "") & (repeats >= 2), F.lit(False)),
        "_RATING_NO_REVIEWS": F.coalesce(rating > 0, F.lit(False)) & (reviews.isNull() | (reviews == 0)),
    })


# ---------------------------------------------------------------------------
# Live-only checks
# ---------------------------------------------------------------------------


def fake_discount(s: Scope, times: float = 10.0):
    if not s.needs("GLOBAL_PRICE", "OLD_PRICE"):
        return []
    price, old = num("GLOBAL_PRICE"), num("OLD_PRICE")
    detail = F.concat(
        F.lit("Old price "), fmt(old, 0), F.lit(" is "), fmt(old / F.nullif(price, F.lit(0.0)), 0),
        F.lit("× current "), fmt(price, 0),
    )
    return [Check("Fake discount", (price > 0) & (old > price * times), detail)]


def low_rating(s: Scope, threshold: float = 3.0):
    if not s.needs("RATING"):
        return []
    rating = num("RATING")
    detail = F.concat(F.lit("Rating "), F.bround(rating, 1).cast("string"), F.lit(f" < {threshold}"))
    return [Check("Low rating", rating < threshold, detail)]


def no_ratings(s: Scope):
    if not s.needs("RATING"):
        return []
    return [Check("No ratings", num("RATING").isNull(), F.lit("No customer ratings"))]


IMAGES = "No. of Images"


def few_images(s: Scope, least: int = 5):
    if not s.needs(IMAGES):
        return []
    count = F.coalesce(num(f"`{IMAGES}`"), F.lit(1.0))
    detail = F.concat(
        F.lit("Product has only "), pystr(f"`{IMAGES}`"),
        F.lit(f" image(s), minimum recommended is {least}"),
    )
    return [Check("Few Images (<5)", count < least, detail)]


def description_checks(s: Scope):
    column = next((c for c in ("DESCRIPTION_HTML", "DESCRIPTION") if c in s.columns), None)
    if column is None:
        return []
    text, present = F.col(column), F.col(column).isNotNull()
    void = strip(pystr(column)).isin("", "nan", "None")
    return [
        Check("Empty Description", ~present | void, F.lit("Product has no description")),
        Check("Thin Description", present & ~void & (F.length(text) < 100), F.lit("Product description is too short")),
        Check(
            "Missing Images in Desc", present & ~(F.contains(text, F.lit("<")) & text.rlike("(?i)<img")),
            F.lit("Product description does not contain any images"),
        ),
    ]


def repeated_description(df: DataFrame) -> DataFrame:
    """Every product whose non-blank description occurs more than once.

    Descriptions are compared by a 128-bit key: counts combine before the shuffle
    and a text shared by very many products never meets in one task as text.
    """
    rows = df.filter(F.col("DESCRIPTION").isNotNull() & (strip("DESCRIPTION") != "")).select(
        F.col(SID).alias("sid"), group_key(F.col("DESCRIPTION")).alias("key")
    )
    repeated = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(repeated, "key", "left_semi").select(
        "sid", F.lit("Repeated Description").alias("flag"),
        F.lit("Description appears in multiple products").alias("detail"),
        F.lit(None).cast("string").alias("reason"), F.lit(False).alias("cv"),
    )


# ---------------------------------------------------------------------------
# Enrichment
# ---------------------------------------------------------------------------


def fill_rate(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of filled cells per column, one scan."""
    have = [c for c in cols if c in df.columns]
    row = df.agg(F.count("*").alias("_n"), *[F.count(filled(c)).alias(c) for c in have])
    wide = row.select(
        *[F.coalesce(F.try_divide(F.col(c), F.col("_n")), F.lit(0.0)).alias(c) for c in have]
    )
    return wide.unpivot([], have, "column", "fill_rate") if have else df.sparkSession.createDataFrame(
        [], "column string, fill_rate double"
    )


def fill_from_pages(df: DataFrame, pages: DataFrame, cols: list[str], key: str = SID, threshold: float = 0.5) -> DataFrame:
    """Fill blank cells from extracted page fields, only in columns filled below the threshold."""
    rates = {r["column"]: r["fill_rate"] for r in fill_rate(df, cols).collect()}
    release(df.sparkSession)
    wanted = [c for c in cols if c in pages.columns and rates.get(c, 0.0) < threshold]
    if not wanted:
        return df
    # all cells of a product come from one page: the first by page id, else by its own values
    cells = F.struct(*[filled(c).alias(f"_new_{c}") for c in wanted])
    first = F.struct(*(["page_id"] if "page_id" in pages.columns else []), cells.alias("c"))
    side = pages.groupBy(strip(F.substring_index(key, "-", 1)).alias("_sku")).agg(F.min(first).alias("_p")).select("_sku", "_p.c.*")
    joined = df.join(side, strip(F.substring_index(F.col(key), "-", 1)) == F.col("_sku"), "left")
    old = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    empty = ("nan", "none", "None", "NaN")
    value = lambda c: F.when(filled(old(c), empty).isNull(), F.coalesce(f"_new_{c}", old(c))).otherwise(old(c))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in wanted]
    return joined.select(*rest, *[value(c).alias(c) for c in wanted])


def fill_summary(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Filled cells per column before and after enrichment."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(*[
            (F.count(filled(c)) if c in df.columns else F.lit(0).cast("long")).alias(c) for c in cols
        ])
        return row.unpivot([], cols, "column", name)

    return counts(before, "before").join(counts(after, "after"), "column").select(
        "column", "before", "after", F.greatest(F.col("after") - F.col("before"), F.lit(0)).alias("filled")
    )


def fill_missing_image(df: DataFrame, enriched: DataFrame) -> DataFrame:
    """MAIN_IMAGE from the enriched table when the column is absent or wholly blank."""
    if not wholly_blank(df, "MAIN_IMAGE"):
        return df
    side = enriched.groupBy(F.col(SID).alias("_sid")).agg(F.max(filled("MAIN_IMAGE", ("nan", "None"))).alias("_img"))
    old = F.col("MAIN_IMAGE") if "MAIN_IMAGE" in df.columns else F.lit("")
    rest = [F.col(f"`{c}`") for c in df.columns if c != "MAIN_IMAGE"]
    return df.join(side, F.col(SID) == F.col("_sid"), "left").select(*rest, F.coalesce("_img", old).alias("MAIN_IMAGE"))


# ---------------------------------------------------------------------------
# Pasted ids and links
# ---------------------------------------------------------------------------

# Tokens that are measures, suffixes of known ids.
MEASURE = r"(?i)^[\dA-Z]*(ML|KG|GB|TB|CM|MM|GM|MG|PC|PCS|L)+[\dA-Z]*$"
SUFFIX = r"(?i)(NAFAMZ|GANAFAMZ|HANAFAMZ|FANAFAMZ)$"


def _url_slug(c: Column) -> Column:
    tail = F.element_at(F.split(F.regexp_replace(c, r"/+$", ""), "/"), -1)
    return F.regexp_replace(tail, r"\.html.*$", "")


def sku_from_url(c: Column) -> Column:
    """Last dash token that looks like an id; a known id suffix is preferred."""
    tokens = F.filter(
        F.reverse(F.split(_url_slug(c), "-")),
        lambda t: F.length(t).between(12, 30) & t.rlike("[A-Za-z]") & t.rlike("[0-9]") & ~t.rlike(MEASURE),
    )
    known = F.filter(tokens, lambda t: t.rlike(SUFFIX))
    return F.upper(F.coalesce(F.get(known, F.lit(0)), F.get(tokens, F.lit(0))))


def country_from_url(c: Column, domains: list[tuple[str, str]]) -> Column:
    """Country of the first listed (domain, code) that occurs in the link."""
    out = F.lit(None).cast("string")
    for domain, code in reversed(domains):
        out = F.when(F.contains(c, F.lit(domain)), code).otherwise(out)
    return out


def parse_lookup_inputs(df: DataFrame, domains: list[tuple[str, str]], line: str = "line", order: str = SEQ) -> DataFrame:
    """Pasted lines -> (input, sku, url, country_hint), first line per id."""
    text = strip(line)
    link = text.startswith("http")
    end = _url_slug(text)
    digits = F.regexp_extract(end, r"(\d{6,})$", 1)
    sku = F.when(
        link, F.coalesce(sku_from_url(text), F.when(digits != "", digits), F.substring(end, 1, 20))
    ).otherwise(strip(F.substring_index(text, "-", 1)))
    rows = df.filter(text != "").select(
        text.alias("input"), sku.alias("sku"), F.when(link, text).alias("url"),
        F.when(link, country_from_url(text, domains)).alias("country_hint"), F.col(order).alias("_o"),
    ).filter(F.col("sku") != "")
    return rows.groupBy("sku").agg(
        *[F.min_by(c, "_o").alias(c) for c in ("input", "url", "country_hint")]
    ).select("input", "sku", "url", "country_hint")
