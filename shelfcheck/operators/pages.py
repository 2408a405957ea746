"""Product fields from stored pages, as regular-expression and JSON expressions over ``html``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck.functions.text import py_title, strip
from shelfcheck.session import spread

# ---------------------------------------------------------------------------
# Color words, attribute labels, furniture words, markers
# ---------------------------------------------------------------------------

PLAIN_COLORS = (
    "black|white|silver|gold|blue|red|green|purple|pink|grey|gray|titanium|midnight|starlight|ivory|champagne|"
    "rose|copper|yellow|orange|violet|navy|cream|brown|coral|aqua|cyan|teal|lilac|maroon|beige|olive|turquoise"
)
TWO_WORD_COLORS = (
    r"titanium\s+silver|titanium\s+gold|midnight\s+black|midnight\s+blue|space\s+gray|space\s+grey|rose\s+gold|"
    r"sky\s+blue|navy\s+blue|forest\s+green|hot\s+pink|light\s+blue|dark\s+blue|dark\s+green|light\s+green|"
    r"deep\s+purple|bright\s+red|pearl\s+white|starlight\s+white|starlight\s+silver"
)
SPEC_LABELS = (
    r"(?i)^(colour|color|size|material|main\s+material|weight|model|gtin|sku|barcode|dimension|brand|style|gender|"
    r"age\s+group|compatible\s+with|connectivity|power\s+source|voltage|wattage|capacity|storage|memory|screen|"
    r"resolution|battery|warranty|type|quantity|number\s+of|set\s+includes|net\s+weight|unit\s+count|flavor|scent|"
    r"finish|texture|pattern|fit\s+type|closure\s+type|sleeve\s+length|collar\s+type|outer\s+material|sole\s+material|"
    r"upper\s+material|heel\s+type|toe\s+style|production|country|manufacturer|origin|made\s+in|from\s+the|"
    r"item\s+weight|package|box\s+contents|box\s+content|included|features?|specification|certified|certification|"
    r"standard)"
)
# Words of page furniture, which are no variation values.
FURNITURE_WORDS = [
    "share", "this", "product", "add", "cart", "wishlist", "compare", "buy", "now", "view", "more", "details",
    "description", "reviews", "rating", "sold", "by", "seller", "store", "official", "report", "incorrect",
    "information", "see", "all", "promotions", "delivery", "returns", "policy", "similar", "products", "from",
    "brand", "print", "email", "copy", "link", "tweet", "pin", "like", "follow", "followers", "score", "shipping",
    "express", "fulfilled", "verified", "in", "on", "at", "and", "or", "the", "a", "an", "with", "for", "of", "to",
    "is", "are", "get", "set", "go", "new", "top", "hot", "sale", "free",
]
SIZE_PATTERN = (
    r"(?i)^((EU|UK|US|EU/UK)\s*\d{1,3}(\.\d)?|\d{1,3}(\.\d)?|(XS|S|M|L|XL|XXL|XXXL|3XL|4XL|5XL)|"
    r"(ONE\s*SIZE|FREE\s*SIZE)|\d{1,3}\s*(cm|mm|in|inch|inches))$"
)
STOCK_PATTERN = (
    r"(?i)((?:some\s+)?variations?\s+with\s+low\s+stock|low\s+stock|only\s+\d+\s+left|hurry[,!]?\s+(?:only\s+)?\d+|"
    r"in\s+stock|out\s+of\s+stock|sold\s+out)"
)
WARRANTY_PATTERN = r"(?i)(\d+[\s\-]?(?:year|month|yr|mo)[s]?\s+(?:warranty|guarantee))"
SELLER_NOISE = r"(?i)seller|store|view|follow|score|performance|information|rating"
STOP_HEADS = (
    r"(?i)^(specifications?|customer\s+feedback|related\s+results|seller\s+info|promotions?|delivery|return\s+policy)"
)
# What marks a description, and blocks of page furniture inside one.
DESCRIPTION_CLASSES = [("-prd-desc", "div"), ("description", "div"), ("description", "section"), ("product-desc", "div"), ("-fs14", "div")]
FURNITURE_CLASSES = "nav|bread|cart|seller|rate|review|footer|header|sidebar|related|promo|banner"
TEXT_TAGS = "p|ul|ol|h2|h3|h4"
TITLE_COLORS = rf"(?iU)\b({TWO_WORD_COLORS}|{PLAIN_COLORS})\b"

PAGE_FIELDS = [
    "PRICE", "DISCOUNT", "STOCK_STATUS", "MODEL", "GTIN", "BRAND", "CATEGORY_PATH", "IS_OFFICIAL_STORE", "MAIN_IMAGE",
    "WEIGHT", "COLOR", "COLOR_IN_TITLE", "COUNT_VARIATIONS", "SIZES_AVAILABLE", "PRODUCT_WARRANTY",
    "WARRANTY_DURATION", "RATING", "REVIEW_COUNT", "SELLER_NAME", "DESCRIPTION", "KEY_FEATURES", "KEY_SPECS",
    "SPECIFICATIONS", "WHATS_IN_BOX",
]


# ---------------------------------------------------------------------------
# Markup helpers
# ---------------------------------------------------------------------------

#: Elements that cannot hold one of their own kind.
FLAT_TAGS = ("p", "h2", "h3", "h4")
_EDGE = "\x00"

ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def plain(markup: Column, glue: str = " ") -> Column:
    """Text of a fragment: tags replaced by ``glue``, entities decoded, space squeezed."""
    text = F.regexp_replace(markup, r"(?s)<[^>]*>", glue)
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def page_text(html: Column) -> Column:
    """Visible text of a page without scripts and styles."""
    return plain(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "))


def found(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_match(html: Column, pattern: str, group: int = 1) -> Column:
    return found(F.regexp_extract(html, pattern, group))


def by_class(html: Column, name: str, tags: str = r"\w+") -> Column:
    """Content of the first element with the class ``name`` (a pattern)."""
    return F.regexp_extract(
        html, rf"(?is)<({tags})\b[^>]*\bclass=[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1>", 2
    )


def class_text(html: Column, names: list[str], tags: str = r"\w+") -> Column:
    return F.coalesce(*[found(plain(by_class(html, n, tags), "")) for n in names])


def elements(markup: Column, tags: str, opening: str = "") -> Column:
    """Outermost elements of the kinds ``tags`` whose opening tag matches, each whole and with its own tags.

    The markup is cut before each opening and closing tag of these kinds; tags of the element's own name open and
    close levels, and it ends with the tag that closes the first one. Paragraphs and headings cannot nest, so they
    end at their first closing tag. An element that is never closed reaches to the end.
    """
    marked = F.transform(F.split(markup, rf"(?i)(?=</?(?:{tags})\b)"), lambda x: F.struct(
        x.alias("text"), F.lower(F.regexp_extract(x, rf"(?i)^</?({tags})\b", 1)).alias("tag"),
        x.startswith("</").alias("closes"), x.rlike(rf"(?is)^<(?:{tags})\b{opening}").alias("starts"),
    ))

    def step(acc: Column, x: Column) -> Column:
        inside = acc["depth"] > 0
        depth = F.when(~inside, x["starts"].cast("int")).when(x["tag"] != acc["tag"], acc["depth"]).when(
            x["closes"], acc["depth"] - 1).when(x["tag"].isin(*FLAT_TAGS), acc["depth"]).otherwise(acc["depth"] + 1)
        text = F.when(~inside, F.concat(F.lit(_EDGE), x["text"])).when(
            depth == 0, F.regexp_extract(x["text"], r"^</[^>]*>", 0)).otherwise(x["text"])
        return F.struct(
            depth.alias("depth"), F.when(inside, acc["tag"]).otherwise(x["tag"]).alias("tag"),
            F.when(inside | x["starts"], F.array_append(acc["out"], text)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("tag"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate(marked, start, step, lambda acc: F.array_join(acc["out"], ""))
    return F.filter(F.split(kept, _EDGE), lambda x: x != "")


def items(markup: Column) -> Column:
    """Texts of the list items of a fragment."""
    raw = F.regexp_extract_all(markup, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: plain(x)), lambda x: x != "")


# ---------------------------------------------------------------------------
# Structured blocks
# ---------------------------------------------------------------------------


def page_json_ld(html: Column) -> Column:
    """First JSON-LD object of type Product as JSON text, in object or list form."""
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )
    each = F.flatten(F.transform(blocks, lambda b: F.when(
        strip(b).startswith("["), F.coalesce(F.from_json(strip(b), "array<string>"), F.array().cast("array<string>"))
    ).otherwise(F.array(strip(b)))))
    return F.get(F.filter(each, lambda b: F.get_json_object(b, "$['@type']") == "Product"), F.lit(0))


def ld_fields(ld: Column) -> dict[str, Column]:
    at = lambda p: found(F.get_json_object(ld, p))
    image = F.coalesce(at("$.image[0]"), at("$.image"))
    description, stock = at("$.description"), F.coalesce(at("$.offers[0].availability"), at("$.offers.availability"))
    return {
        "MAIN_IMAGE": image,
        "DESCRIPTION": F.when(F.length(description) > 20, description),
        "BRAND": F.coalesce(at("$.brand.name"), F.when(~at("$.brand").startswith("{"), at("$.brand"))),
        "PRICE": F.replace(F.coalesce(
            at("$.offers[0].price"), at("$.offers[0].lowPrice"), at("$.offers.price"), at("$.offers.lowPrice")
        ), F.lit(","), F.lit("")),
        "STOCK": F.when(F.contains(stock, F.lit("InStock")), "In Stock").when(F.contains(stock, F.lit("OutOfStock")), "Out of Stock"),
        "RATING": at("$.aggregateRating.ratingValue"),
        "REVIEW_COUNT": F.coalesce(at("$.aggregateRating.reviewCount"), at("$.aggregateRating.ratingCount")),
        "MODEL": F.when(~at("$.model").startswith("{"), at("$.model")),
        "GTIN": F.coalesce(*[at(f"$.{k}") for k in ("gtin13", "gtin12", "gtin8", "gtin", "barcode")]),
        "WEIGHT": F.coalesce(
            F.concat(at("$.weight.value"), F.lit(" "), F.coalesce(at("$.weight.unitCode"), F.lit("kg"))),
            F.when(~at("$.weight").startswith("{"), at("$.weight")),
        ),
        "SELLER": F.coalesce(at("$.seller.name"), F.when(~at("$.seller").startswith("{"), at("$.seller"))),
    }


def page_embedded_json(staged: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Price, brand, category and image from a dataLayer or store object in a script.

    Every step down is a projection of its own: each text is searched and parsed once, however often the next step reads it.
    """
    html, layer, store = F.col("html"), F.col("_layer"), F.col("_store")
    inside = lambda j, k: F.coalesce(F.get_json_object(j, f"$.{k}"), j)
    staged = staged.withColumns({
        "_layer": F.coalesce(
            found(F.regexp_extract(html, r"(?s)dataLayer\s*=\s*(\[.*?\])\s*;", 1)),
            found(F.regexp_extract(html, r"(?s)dataLayer\.push\s*\((\{.*?\})\s*\)", 1)),
        ),
        "_store": found(F.regexp_extract(html, r"(?s)__STORES__\s*=\s*(\{.+?\})\s*;", 1)),
    })
    staged = staged.withColumns({
        "_layer": F.when(layer.startswith("["), F.get(F.from_json(layer, "array<string>"), F.lit(0))).otherwise(layer),
        "_store": inside(store, "pdp"),
    })
    staged = staged.withColumns({"_layer": inside(layer, "ecommerce"), "_store": inside(store, "product")})
    staged = staged.withColumn("_layer", inside(layer, "detail")).withColumn("_layer", inside(layer, "products[0]"))
    at = lambda j, k: found(F.get_json_object(j, f"$.{k}"))
    return staged, {
        "PRICE": F.replace(F.coalesce(at(layer, "price"), at(store, "price")), F.lit(","), F.lit("")),
        "BRAND": at(layer, "brand"), "CATEGORY_PATH": at(layer, "category"), "MAIN_IMAGE": at(store, "image"),
    }


# ---------------------------------------------------------------------------
# Plain markup
# ---------------------------------------------------------------------------


def page_price(html: Column, symbol: str = "KSh") -> Column:
    """First price element of at least 100, with thousands separators."""
    raw = F.array_compact(F.array(*[
        found(F.regexp_replace(by_class(html, n, tag), r"(?s)<[^>]*>|[^\d,.]", ""))
        for n, tag in ((r"-b -ltr -tal -fs24", "span"), ("prc", "span"), (r"-b -ltr -tal", "span"), (r"-prc-w", "div"))
    ]))
    numbers = F.transform(raw, lambda r: F.replace(r, F.lit(","), F.lit("")).try_cast("double"))
    value = F.get(F.filter(numbers, lambda v: v >= 100), F.lit(0))
    whole = value == F.floor(value)
    return F.concat(F.lit(symbol + " "), F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2)))


def page_html_fields(html: Column, text: Column) -> dict[str, Column]:
    no_rating = text.rlike(r"(?i)no\s+ratings?\s+(?:yet|available)")
    discount = class_text(html, [r"bdg _dsct _sm", "_dsct", r"[\w-]*discount[\w-]*"])
    stock = class_text(html, [r"[\w-]*stock[\w-]*", r"[\w-]*avail[\w-]*"], "span|div|p")
    stated = F.coalesce(F.when(F.length(stock) < 80, stock), first_match(text, STOCK_PATTERN))
    sold_out = html.rlike(r"(?i)class=[\"'][^\"']*(?:out-of-stock|sold-out)|<button[^>]*\bdisabled")
    return {
        "MAIN_IMAGE": F.coalesce(
            first_match(html, r"(?is)<meta[^>]*property=[\"']og:image[\"'][^>]*content=[\"']([^\"']+)"),
            first_match(html, r"(?is)<meta[^>]*content=[\"']([^\"']+)[\"'][^>]*property=[\"']og:image[\"']"),
            first_match(html, r"(?is)<img[^>]*class=[\"'][^\"']*-fw -fh[^\"']*[\"'][^>]*(?:data-src|\bsrc)=[\"']([^\"']+)"),
        ),
        "DISCOUNT": F.when(F.contains(discount, F.lit("%")), discount),
        "RATING": F.coalesce(
            first_match(class_text(html, [r"stars _s", r"[\w-]*stars[\w-]*"]), r"(\d+\.?\d*)"),
            first_match(html, r"(?i)<div[^>]*data-rating=[\"'](\d+\.?\d*)"), F.when(no_rating, "0"),
        ),
        "REVIEW_COUNT": F.coalesce(
            first_match(html, r"(?is)<a[^>]*href=[\"'][^\"']*#reviews[^\"']*[\"'][^>]*>[^<\d]*(\d+)"),
            first_match(class_text(html, [r"[\w-]*revw[\w-]*"], "span"), r"(\d+)"),
            first_match(text, r"(?i)(\d+)\s+verified\s+ratings?"), F.when(no_rating, "0"),
        ),
        "STOCK_STATUS": F.concat(F.upper(F.substring(stated, 1, 1)), F.lower(stated.substr(F.lit(2), F.length(stated)))),
        "SOLD_OUT": sold_out,
    }


def heading_text(html: Column) -> Column:
    """Text of the first <h1>, else of <title>."""
    return F.coalesce(
        found(plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))),
        found(plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))), F.lit(""),
    )


def page_title_colors(heading: Column) -> Column:
    """Distinct title-case colors of a heading in order, or 'None'."""
    colors = F.array_distinct(F.transform(
        F.regexp_extract_all(heading, F.lit(TITLE_COLORS), F.lit(1)), lambda c: py_title(c)
    ))
    return F.when(F.size(colors) > 0, F.array_join(colors, ", ")).otherwise("None")


def _keep_option(v: Column) -> Column:
    return (
        (v != "") & (F.length(v) < 50) & ~F.contains(v, F.lit(": ")) & ~F.contains(v, F.lit(","))
        & ~v.rlike(SPEC_LABELS) & ~F.lower(v).isin(*FURNITURE_WORDS)
    )


def page_variations(pages: DataFrame) -> DataFrame:
    """Option values split into sizes and colors, with the count of combinations.

    Option list first, then a drop-down inside the product form, then buttons,
    then color words of the heading.  Each step is its own projection, so later
    ones read its arrays instead of evaluating the patterns again.
    """
    html = F.col("html")
    block = F.regexp_extract(html, r"(?is)<ul\b[^>]*class=[\"'](?:[^\"']*\s)?-pvs(?:\s[^\"']*)?[\"'][^>]*>(.*?)</ul>", 1)
    rows = F.regexp_extract_all(block, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    value = lambda li: F.coalesce(
        first_match(li, r"(?is)<input[^>]*\bvalue=[\"']([^\"']*)[\"']"),
        found(plain(F.regexp_extract(li, r"(?is)^\s*<span\b[^>]*>(.*?)</span>", 1), "")), plain(li, ""),
    )
    form = F.regexp_extract(html, r"(?is)<form\b[^>]*(?:product_addtocart_form|checkout)[^>]*>(.*?)</form>", 1)
    options = F.regexp_extract_all(
        form, F.lit(r"(?is)<option\b(?![^>]*\bdisabled)(?![^>]*\bvalue=[\"'][\"'])[^>]*>(.*?)</option>"), F.lit(1)
    )
    buttons = F.regexp_extract_all(
        F.concat_ws("", F.regexp_extract_all(
            html, F.lit(r"(?is)<div\b[^>]*class=[\"'][^\"']*(?:var|size|color)[^\"']*[\"'][^>]*>(.*?)</div>"), F.lit(1)
        )), F.lit(r"(?is)<button\b[^>]*>(.*?)</button>"), F.lit(1),
    )
    is_size = lambda v: v.rlike(SIZE_PATTERN)
    is_other = lambda v: ~v.rlike(SIZE_PATTERN)
    size = F.size
    staged = pages.withColumns({
        "_pills": F.transform(rows, value),
        "_selects": F.filter(F.transform(options, lambda o: plain(o)), lambda v: (v != "") & (F.length(v) < 50)),
        "_buttons": F.transform(buttons, lambda b: plain(b)),
        "_named": F.array_distinct(F.transform(
            F.regexp_extract_all(F.col("_heading"), F.lit(rf"(?iU)\b({PLAIN_COLORS})\b"), F.lit(1)), lambda c: py_title(c)
        )),
    }).withColumns({"_pills": F.filter("_pills", _keep_option), "_buttons": F.filter("_buttons", _keep_option)})
    staged = staged.withColumn("_values", F.array_distinct(
        F.when(size("_pills") > 0, F.col("_pills")).when(size("_selects").between(1, 30), F.col("_selects"))
        .otherwise(F.col("_buttons"))
    )).withColumns({"_sizes": F.filter("_values", is_size), "_others": F.filter("_values", is_other)})
    # One value that names several options is split at separators or spaces.
    staged = staged.withColumn("_tokens", F.when(
        (size("_others") == 1) & (size("_sizes") == 0),
        F.filter(F.transform(F.split(F.get("_others", F.lit(0)), r"\s*[,|/]\s*|\s+"), lambda t: strip(t)), lambda t: t != ""),
    )).withColumns({
        "_sizes": F.when(size("_tokens") >= 2, F.filter("_tokens", is_size)).otherwise(F.col("_sizes")),
        "_others": F.when(size("_tokens") >= 2, F.filter("_tokens", is_other)).otherwise(F.col("_others")),
    })
    staged = staged.withColumn(
        "_others", F.when((size("_sizes") == 0) & (size("_others") == 0), F.col("_named")).otherwise(F.col("_others"))
    )
    n_sizes, n_colors = size("_sizes"), size("_others")
    count = F.when((n_sizes > 0) & (n_colors > 0), n_sizes * n_colors).otherwise(F.greatest(n_sizes, n_colors))
    return staged.withColumns({
        "SIZES_AVAILABLE": found(F.array_join("_sizes", ", ")), "COLOR": found(F.array_join("_others", ", ")),
        "COUNT_VARIATIONS": F.when(count > 0, count.cast("string")),
    }).drop("_pills", "_selects", "_buttons", "_named", "_values", "_sizes", "_others", "_tokens")


def spec_block(html: Column) -> Column:
    marked = r"[^>]*\bclass=[\"'][^\"']*spec"
    # Pages without such a block are not cut into pieces.
    return F.concat_ws(" ", F.when(html.rlike(rf"(?i)<\w+{marked}"), elements(html, "div|section|ul", marked)))


def page_specs(pages: DataFrame, ld: dict[str, Column]) -> DataFrame:
    """Key:value lines of the specification list and the fields read from them."""
    text = F.col("_text")
    staged = pages.withColumn("_lines", F.filter(items(spec_block(F.col("html"))), lambda t: F.contains(t, F.lit(":"))))
    staged = staged.withColumn("_pairs", F.transform("_lines", lambda t: F.struct(
        F.replace(F.lower(strip(F.substring_index(t, ":", 1))), F.lit(" "), F.lit("_")).alias("key"),
        strip(F.regexp_replace(t, r"(?s)^[^:]*:", "")).alias("value"),
    )))

    def at(*keys: str) -> Column:
        """Value of the first of several keys; the last line of a key counts."""
        last = lambda k: F.get(F.filter(F.reverse("_pairs"), lambda p: (p["key"] == k) & (p["value"] != "")), F.lit(0))["value"]
        return F.coalesce(*[last(k) for k in keys])

    staged = staged.withColumns({
        "MODEL": F.coalesce(
            ld["MODEL"], at("model", "model_name", "model_number"), first_match(text, r"(?i)\bModel\s*[:\-]\s*([^\n,]+)")
        ),
        "GTIN": F.coalesce(
            ld["GTIN"], at("gtin_barcode", "gtin", "barcode", "ean", "upc"),
            first_match(text, r"(?i)GTIN\s*(?:Barcode)?\s*[:\-]\s*(\d{8,14})"),
        ),
        "WEIGHT": F.coalesce(
            at("weight_(kg)", "weight_kg", "weight_(g)", "weight"), ld["WEIGHT"],
            first_match(text, r"(?i)Weight\s*(?:\(kg\))?\s*[:\-]\s*([\d\.]+\s*(?:kg|g)?)"),
        ),
        "_short": F.filter("_lines", lambda t: F.length(t) < 200),
        "_kg": at("weight_(kg)"), "_material": at("main_material"), "_size": at("size_(l_x_w_x_h_cm)"),
        "_sku": at("sku"), "_barcode": at("gtin_barcode"),
    })
    more = lambda label, v: F.when(
        F.col(v).isNotNull() & ~F.exists("_short", lambda x: F.contains(F.lower(x), F.lit(label.lower()))),
        F.concat(F.lit(label + ": "), v),
    )
    known = F.array_compact(F.array(
        more("SKU", "MODEL"), more("Weight (kg)", "WEIGHT"), more("Main Material", "_material"), more("Size (L x W H)", "_size"),
    ))
    put = lambda label, v: F.concat(F.lit(label + ": "), v)
    key_specs = F.concat_ws(
        " | ", F.coalesce(put("SKU", "_sku"), put("SKU", "MODEL")), put("Size", "_size"), put("Weight", "_kg"),
        put("Material", "_material"), put("GTIN", "_barcode"),
        F.when(F.col("_kg").isNull(), F.concat(F.lit("Weight: "), "WEIGHT", F.lit(" kg"))),
    )
    return staged.withColumns({
        "KEY_SPECS": found(key_specs), "SPECIFICATIONS": found(F.array_join(F.concat("_short", known), " | ")),
    }).drop("_lines", "_pairs", "_short", "_kg", "_material", "_size", "_sku", "_barcode")


def link_texts(markup: Column) -> Column:
    raw = F.regexp_extract_all(markup, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    return F.filter(F.transform(raw, lambda a: plain(a, "")), lambda t: t != "")


def category_links(html: Column) -> Column:
    """Texts of the breadcrumb links; else of the first short nav list."""
    marked = F.array_compact(F.array(*[
        found(F.regexp_extract(html, p, 1)) for p in (
            r"(?is)<ol\b[^>]*class=[\"'][^\"']*breadcrumb[^\"']*[\"'][^>]*>(.*?)</ol>",
            r"(?is)<nav\b[^>]*aria-label=[\"'][^\"']*breadcrumb[^\"']*[\"'][^>]*>(.*?)</nav>",
            r"(?is)<div\b[^>]*class=[\"'](?:[^\"']*\s)?-bre(?:\s[^\"']*)?[\"'][^>]*>(.*?)</div>",
            r"(?is)<div\b[^>]*class=[\"'][^\"']*breadcrumb[^\"']*[\"'][^>]*>(.*?)</div>",
        )
    ]))
    crumbs = F.get(F.filter(F.transform(marked, link_texts), lambda t: F.size(t) > 0), F.lit(0))
    lists = F.concat(*[
        F.regexp_extract_all(html, F.lit(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>"), F.lit(1)) for t in ("nav", "ol", "ul")
    ])
    plausible = F.filter(F.transform(lists, link_texts), lambda t: (
        F.size(t).between(3, 7) & (F.size(F.array_distinct(t)) == F.size(t)) & F.forall(t, lambda x: F.length(x) < 50)
    ))
    return F.coalesce(crumbs, F.get(plausible, F.lit(0)))


def page_category_path(html: Column, home: list[str] = ("home",), links: Column | None = None) -> Column:
    """Breadcrumb links joined by ' > ', home first link dropped; else the first short nav list."""
    path = category_links(html) if links is None else links
    path = F.when(F.lower(F.get(path, F.lit(0))).isin(*home), F.slice(path, 2, 1 << 20)).otherwise(path)
    last = F.get(path, F.size(path) - 1)
    path = F.when(F.length(last) > 60, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
    return found(F.array_join(path, " > "))


def page_seller(html: Column, ld: dict[str, Column]) -> Column:
    """Seller block link, link or text after the seller heading, JSON-LD seller."""
    linked = [
        rf"(?is)<(?:div|section)\b[^>]*class=[\"'][^\"']*seller(?:-info|-detail)?[^\"']*[\"'][^>]*>.*?<a\b[^>]*href[^>]*>(.*?)</a>",
        r"(?is)<a\b[^>]*class=[\"'][^\"']*(?:seller|store)-name[^\"']*[\"'][^>]*>(.*?)</a>",
        r"(?is)seller\s+information\s*<.*?<a\b[^>]*href[^>]*>(.*?)</a>",
    ]
    sibling = r"(?is)<(?:h2|h3|h4|b|strong)\b[^>]*>[^<]*seller\s+information[^<]*</(?:h2|h3|h4|b|strong)>\s*<(\w+)\b[^>]*>(.*?)</\1>"
    fits = lambda c: F.when(F.length(c).between(2, 60) & ~c.rlike(SELLER_NOISE), c)
    return F.coalesce(
        *[fits(found(plain(F.regexp_extract(html, p, 1), ""))) for p in linked],
        F.when(F.length(ld["SELLER"]) <= 60, ld["SELLER"]),
        fits(found(plain(F.regexp_extract(html, sibling, 2), ""))),
    )


def page_official_store(html: Column, tag: str = "JMALL") -> Column:
    body = F.regexp_replace(html, r"(?is)<(header|nav|head|script|style)\b[^>]*>.*?</\1>", " ")
    hit = (
        body.rlike(rf"(?is)<a\b[^>]*(?:href|tag)=[\"'][^\"']*{tag}") | plain(body).rlike(r"(?i)\bofficial\s+store\b")
        | body.rlike(r"(?is)<img\b[^>]*alt=[\"'][^\"']*\bofficial\s+store\b")
    )
    return F.when(hit, "Yes").otherwise("No")


def page_warranty(html: Column, text: Column) -> dict[str, Column]:
    stated = first_match(text, WARRANTY_PATTERN)
    rows = F.filter(items(html), lambda t: t.rlike("(?i)warranty"))
    row = F.get(F.filter(
        F.transform(rows, lambda t: strip(F.regexp_replace(t, r"[Ww]arranty\s*[:\-]?\s*", ""))),
        lambda v: (v != "") & (F.length(v) < 80),
    ), F.lit(0))
    value = F.coalesce(stated, row)
    return {"PRODUCT_WARRANTY": F.when(value.isNotNull(), "Yes"), "WARRANTY_DURATION": value}


def page_description(pages: DataFrame, out: str = "_description") -> DataFrame:
    """Parts between the details heading and the next stop heading, each once (by its first 120 characters).

    Parts are outermost elements: what lies in one is not repeated after it. Blocks of page furniture and blocks
    without image of at most 30 characters give only the paragraphs, lists and headings in them.
    """
    html = F.col("html")
    stop = STOP_HEADS[len("(?i)^"):]
    after = F.regexp_extract(html, r"(?is)<h[234]\b[^>]*>[^<]*product\s+details?[^<]*</h[234]>(.*)$", 1)
    cut = F.regexp_replace(after, rf"(?is)<h[234]\b[^>]*>\s*{stop}.*$", "")
    # Most pages have one of the two, so the pieces of the other are not made.
    alone = F.coalesce(*[F.when(html.rlike(rf"(?i){name}"), F.get(elements(html, tags, rf"[^>]*\bclass=[\"'][^\"']*{name}"), F.lit(0)))
                         for name, tags in DESCRIPTION_CLASSES])
    parts = elements(cut, f"{TEXT_TAGS}|div|figure", rf"(?:(?<!<div)|(?![^>]*\bclass=[\"'][^\"']*(?:{FURNITURE_CLASSES})))")
    short = lambda x: x.rlike(r"(?i)^<div\b") & ~x.rlike(r"(?i)<img\b") & (F.length(plain(x)) <= 30)
    staged = pages.withColumn("_parts", F.when(cut != "", parts).otherwise(F.array().cast("array<string>"))).withColumn(
        "_parts", F.flatten(F.transform("_parts", lambda x: F.when(short(x), elements(x, TEXT_TAGS)).otherwise(F.array(x))))
    ).withColumn("_alone", F.when(F.size("_parts") == 0, alone))
    part = lambda x: F.struct(
        F.substring(F.regexp_replace(x, r"\s+", " "), 1, 120).alias("key"), strip(x).alias("part")
    )
    staged = staged.withColumn("_parts", F.transform(
        F.when(F.col("_alone").isNotNull(), F.array("_alone")).otherwise(F.col("_parts")), part
    ))
    # A long description has few parts; each is compared with the ones before it by its short key.
    keys = F.transform("_parts", lambda p: p["key"])
    staged = staged.withColumn("_keys", keys)
    unique = F.filter("_parts", lambda p, i: F.array_position("_keys", p["key"]) == i + 1)
    return staged.withColumn(out, found(F.array_join(F.transform(unique, lambda p: p["part"]), "\n"))).drop(
        "_parts", "_alone", "_keys"
    )


def _list_under(html: Column, heading: str) -> Column:
    block = F.regexp_extract(
        html, rf"(?is)<(?:h2|h3|h4|b|strong)\b[^>]*>[^<]*{heading}[^<]*</(?:h2|h3|h4|b|strong)>(?:(?!<h[234]\b).)*?<ul\b[^>]*>(.*?)</ul>", 1
    )
    return found(F.array_join(items(block), " | "))


def page_features(html: Column) -> Column:
    return _list_under(html, r"key\s+features?")


def page_box_contents(html: Column) -> Column:
    return _list_under(html, r"what.{0,5}s?\s+in\s+the\s+box")


def extract_pages(pages: DataFrame, symbol: str = "KSh", tag: str = "JMALL") -> DataFrame:
    """Every product field of every page, NULL where a page has none."""
    html, text = F.col("html"), F.col("_text")
    staged = spread(pages).withColumns({
        "_text": page_text(html), "_ld": page_json_ld(html), "_heading": heading_text(html), "_links": category_links(html),
    })
    ld = ld_fields(F.col("_ld"))
    staged = page_description(page_variations(page_specs(staged, ld)))
    staged, embedded = page_embedded_json(staged)
    shown = page_html_fields(html, text)
    cells = {
        "PRICE": F.coalesce(page_price(html, symbol), embedded["PRICE"]),
        "DISCOUNT": shown["DISCOUNT"],
        "STOCK_STATUS": F.coalesce(
            shown["STOCK_STATUS"], F.when(shown["SOLD_OUT"], "Out of Stock"), ld["STOCK"], F.lit("In Stock")
        ),
        "BRAND": F.coalesce(ld["BRAND"], embedded["BRAND"]),
        "CATEGORY_PATH": F.coalesce(embedded["CATEGORY_PATH"], page_category_path(html, links=F.col("_links"))),
        "IS_OFFICIAL_STORE": page_official_store(html, tag),
        "MAIN_IMAGE": F.coalesce(ld["MAIN_IMAGE"], embedded["MAIN_IMAGE"], shown["MAIN_IMAGE"]),
        "RATING": F.coalesce(ld["RATING"], shown["RATING"]),
        "REVIEW_COUNT": F.coalesce(ld["REVIEW_COUNT"], shown["REVIEW_COUNT"]),
        "COLOR_IN_TITLE": page_title_colors(F.col("_heading")),
        "SELLER_NAME": page_seller(html, ld),
        "DESCRIPTION": F.coalesce(ld["DESCRIPTION"], F.col("_description")),
        "KEY_FEATURES": page_features(html), "WHATS_IN_BOX": page_box_contents(html),
        **page_warranty(html, text),
    }
    keys = [c for c in pages.columns if c != "html"]
    return staged.select(*keys, *[(cells[f] if f in cells else F.col(f)).alias(f) for f in PAGE_FIELDS])


# ---------------------------------------------------------------------------
# Listing pages
# ---------------------------------------------------------------------------


def listing_cards(pages: DataFrame, base_url: str = "") -> DataFrame:
    """One row per product card of a listing page."""
    cards = F.regexp_extract_all(
        F.col("html"), F.lit(r"(?is)(<article\b[^>]*class=[\"'](?:[^\"']*\s)?prd(?:\s[^\"']*)?[\"'][^>]*>.*?</article>)"), F.lit(1)
    )
    keys = [c for c in pages.columns if c != "html"]
    rows = spread(pages).select(*keys, F.posexplode(cards).alias("pos", "card"))
    card = F.col("card")
    attr = lambda n: first_match(card, rf"(?is)^<article\b[^>]*\b{n}=[\"']([^\"']*)")
    number = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("")), r"[^\d.]", "")
    href = F.coalesce(first_match(card, r"(?is)<a\b[^>]*class=[\"'](?:[^\"']*\s)?core(?:\s[^\"']*)?[\"'][^>]*href=[\"']([^\"']*)"),
                      first_match(card, r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*class=[\"'](?:[^\"']*\s)?core"), F.lit(""))
    absolute = lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(
        u.startswith("/"), F.concat(F.lit(base_url), u)).otherwise(u)
    url = F.when(href.startswith("/"), F.concat(F.lit(base_url), href)).otherwise(href)
    width = first_match(card, r"(?is)class=[\"'][^\"']*(?:stars _s|-rtg)[^\"']*[\"'][^>]*style=[\"'][^\"']*width:\s*([\d.]+)%")
    stars = F.coalesce(
        F.bround(width.try_cast("double") / 20, 1).cast("string"), class_text(card, [r"stars _s", r"-rtg"]), F.lit("")
    )
    image = F.coalesce(*[first_match(card, rf"(?is)<img\b[^>]*\b{a}=[\"']([^\"']+)") for a in ("data-src", "data-original", "src")], F.lit(""))
    yes = lambda p: F.when(card.rlike(rf"(?i)class=[\"'][^\"']*{p}"), "Yes").otherwise("No")
    text = lambda *n: F.coalesce(class_text(card, list(n)), F.lit(""))
    return rows.select(
        *keys, "pos",
        F.coalesce(attr("data-id"), attr("data-sku"), first_match(url, r"-(\d{6,12})\.html"),
                   F.concat(F.lit("UNK-"), F.col("pos").cast("string"))).alias("SKU"),
        text("name").alias("Name"), text("brand").alias("Brand"), number(class_text(card, ["prc"])).alias("Price"),
        number(class_text(card, ["old"])).alias("Old Price"), text("-dsc", "bdg _dsct").alias("Discount"),
        stars.alias("Rating"), F.regexp_replace(text("rev"), r"\D", "").alias("Total Ratings"),
        F.coalesce(attr("data-seller"), F.lit("")).alias("Seller"), yes(r"(?:-jump|xpr|express)").alias("Express"),
        yes(r"(?:-glb|global)").alias("Shop Global"), absolute(image).alias("Image URL"), url.alias("Product URL"),
        F.coalesce(class_text(card, ["-avl", r"[\w-]*stock[\w-]*"]), F.lit("In Stock")).alias("Stock"),
        text("tags", r"[\w-]*tag[\w-]*").alias("Tags"),
    )


def listing_page_count(html: Column) -> Column:
    """Largest page number among page attributes and page links, at least 1."""
    numbers = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?i)\bdata-page=[\"'](\d+)"), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*href=[\"'][^\"']*?page=(\d+)"), F.lit(1)),
    )
    return F.coalesce(F.array_max(F.transform(numbers, lambda n: n.try_cast("long"))), F.lit(1))


def listing_category(html: Column) -> Column:
    """Last breadcrumb text that is not the home entry."""
    block = F.coalesce(*[found(F.regexp_extract(html, p, 1)) for p in (
        r"(?is)<nav\b[^>]*class=[\"'][^\"']*breadcrumb[^\"']*[\"'][^>]*>(.*?)</nav>",
        r"(?is)<ol\b[^>]*class=[\"'][^\"']*breadcrumb[^\"']*[\"'][^>]*>(.*?)</ol>",
    )], F.lit(""))
    raw = F.regexp_extract_all(block, F.lit(r"(?is)<(?:span|li)\b[^>]*>(.*?)</(?:span|li)>"), F.lit(1))
    texts = F.filter(F.transform(raw, lambda t: plain(t, "")), lambda t: ~F.lower(t).isin("home", "accueil", ""))
    return F.coalesce(F.get(texts, F.size(texts) - 1), F.lit(""))
