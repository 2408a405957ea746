"""Row-local quality checks as column pairs (condition, detail).

All checks of a run are evaluated in one projection over one scan; see ``row_hits``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck import constants as K
from shelfcheck.functions.prices import fmt, rate_of, symbol_of
from shelfcheck.functions.text import (
    any_of,
    bounded_pattern,
    num,
    py_title,
    pystr,
    split_words,
    strip,
    word_pattern,
)
from shelfcheck.operators.facts import FACT_TYPES, approved, attach_facts, name_start, tagged
from shelfcheck.sources.rules import RuleSet

HIT_SCHEMA = "sid string, flag string, detail string, reason string, cv boolean"


@dataclass(frozen=True)
class Check:
    """A flag, the condition that raises it, and the texts that go with it."""

    flag: str
    hit: Column
    detail: Column | None = None
    reason: Column | None = None


class Scope:
    """Input columns and rules a check builder can look at."""

    def __init__(self, df: DataFrame, rules: RuleSet, country: str | None):
        self.types = dict(df.dtypes)
        self.columns = set(self.types)
        self.rules = rules
        self.country = country
        self.codes = rules.lists_with_codes()
        self.programs = rules.programs_with_sellers(country)

    def needs(self, *cols: str) -> bool:
        return self.columns.issuperset(cols)

    def code_scope(self, name: str) -> Column | None:
        """Program codes when the program has any, else the plain code list."""
        for tag in (f"program:{name}", f"list:{name}"):
            if tag in self.codes:
                return tagged(tag)
        return None

    def has_codes(self, *programs: str) -> bool:
        return any(f"program:{p}" in self.codes for p in programs)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _name() -> Column:
    return pystr("NAME")


def _found(pattern: str) -> Column:
    return F.regexp_extract(_name(), pattern, 0)


# ---------------------------------------------------------------------------
# Names
# ---------------------------------------------------------------------------


def unnecessary_words(s: Scope, list_name: str = "unnecessary", flag: str = "Unnecessary words in NAME"):
    pattern = word_pattern(s.rules.words(list_name))
    if pattern is None:
        return []
    hits = F.transform(F.regexp_extract_all(_name(), F.lit(pattern), F.lit(1)), lambda m: F.lower(m))
    detail = _text("Unnecessary: ", F.array_join(F.array_sort(F.array_distinct(hits)), ", "))
    return [Check(flag, F.col("_name_lower").rlike(pattern), detail)]


def single_word_name(s: Scope, one_word_only: bool = False):
    name = strip(_name())
    words, chars = F.size(split_words(name)), F.length(name)
    books = s.code_scope("books")
    in_scope = ~books if books is not None else F.lit(True)
    if one_word_only:
        return [Check("Single-word NAME", in_scope & (words == 1))]
    few, short = words <= 2, chars < 15
    detail = (
        F.when(few & short, _text(words.cast("string"), " words, ", chars.cast("string"), " chars"))
        .when(few, _text(words.cast("string"), " words"))
        .otherwise(_text(chars.cast("string"), " chars"))
    )
    return [Check("Single-word NAME", in_scope & (few | short), detail)]


def brand_in_name(s: Scope):
    brand = F.col("_brand_lower")
    return [Check(
        "BRAND name repeated in NAME",
        ~brand.isin("", "nan") & F.contains(F.col("_name_lower"), brand),
    )]


def weight_in_name(s: Scope):
    scope = s.code_scope("weight")
    if scope is None:
        return []
    return [Check("Missing Weight/Volume", scope & ~F.col("_name_lower").rlike("(?iU)" + K.QUANTITY_PATTERN))]


def smartphone_name(s: Scope):
    scope = s.code_scope("smartphones")
    if scope is None:
        return []
    return [Check(
        "Incomplete Smartphone Name",
        scope & ~F.col("_name_lower").rlike("(?iU)" + K.STORAGE_PATTERN),
        F.lit("Name missing Storage/Memory spec (e.g., 64GB)"),
    )]


def missing_color(s: Scope, validate: bool = True):
    scope, colors = s.code_scope("color"), s.rules.words("colors")
    pattern = word_pattern(colors)
    if scope is None or pattern is None:
        return []
    named = _name().rlike(pattern)
    missing = F.lit("Color missing in both NAME and COLOR attributes")
    if "COLOR" not in s.columns:
        return [Check("Missing COLOR", scope & ~named, missing)]
    value = F.lower(strip(pystr("COLOR")))
    given = ~value.isin(*K.EMPTY_COLORS)
    valid = given
    if validate:
        parts = F.transform(
            F.split(value, r"(?U)[,/&|\-]|\s+and\s+|\s+or\s+|\s+with\s+"), lambda p: strip(p)
        )
        plain = [c for c in colors if c not in K.COLOR_MODIFIERS]
        whole = F.exists(parts, lambda p: (p != "") & p.isin(*colors))
        token = F.exists(parts, lambda p: F.exists(split_words(p), lambda t: t.isin(*plain)))
        valid = given & ~value.isin(*K.JUNK_COLORS) & ~value.rlike(r"^[.\-_*]{1,5}$") & (whole | token)
    detail = F.when(
        given, _text("Invalid color value provided: '", strip(pystr("COLOR")), "'")
    ).otherwise(missing)
    return [Check("Missing COLOR", scope & ~valid & ~named, detail)]


# ---------------------------------------------------------------------------
# Brands and categories
# ---------------------------------------------------------------------------


def generic_brand(s: Scope):
    scope = s.code_scope("fashion")
    return [] if scope is None else [
        Check("Generic BRAND Issues", scope & (F.col("_brand_lower") == "generic"))
    ]


def fashion_brand(s: Scope, by_path: bool = True):
    listed = s.code_scope("fashion")
    listed = listed if listed is not None else F.lit(False)
    domain = listed
    if by_path:
        domain = F.when(
            F.coalesce(F.col("_path"), F.lit("")) != "",
            F.lower(strip("_path")).startswith("fashion"),
        ).otherwise(listed)
    return [Check(
        "Fashion brand issues", (F.col("_brand_lower") == "fashion") & ~domain,
        _text("Brand 'Fashion' used outside Fashion category: ", pystr("CATEGORY_CODE")),
    )]


def _path_says_fashion(s: Scope) -> Column:
    return pystr("CATEGORY").rlike(r"(?iU)\bfashion\b") if "CATEGORY" in s.columns else F.lit(False)


def generic_brand_by_path(s: Scope):
    scope = s.code_scope("fashion")
    scope = scope if scope is not None else F.lit(False)
    return [Check("Generic BRAND Issues", (F.lower(pystr("BRAND")) == "generic") & (scope | _path_says_fashion(s)))]


def fashion_brand_by_path(s: Scope):
    scope = s.code_scope("fashion")
    scope = scope if scope is not None else F.lit(False)
    return [Check(
        "Fashion brand issues", (F.col("_brand_lower") == "fashion") & ~scope & ~_path_says_fashion(s)
    )]


def genuine_brand(s: Scope):
    if not s.rules.has("word_list"):
        return []
    start = name_start(_name())
    fits = lambda b: start.startswith(b["clean"]) & ~F.substring(
        start, F.length(b["clean"]) + 1, F.lit(1)
    ).rlike(r"^[\p{L}\p{N}]")
    brand = F.get(F.filter("_starts", fits), F.lit(0))["brand"]
    case = F.lit(False)
    if "CATEGORY" in s.columns:
        case = F.lower(pystr("CATEGORY")).rlike("(?U)" + K.CASE_PATTERN)
    pseudo = F.col("_brand_lower").isin(*K.PSEUDO_BRANDS) & ~case & F.col("_starts").isNotNull()
    return [Check(
        "Generic branded products with genuine brands",
        pseudo & F.exists(F.coalesce("_starts", F.array().cast("array<struct<neg:int,brand:string,clean:string>>")), fits),
        _text("Brand field '", py_title("_brand_lower"), "' but name starts with: ", py_title(brand)),
    )]


def wrong_variation(s: Scope):
    count = F.lit(1)
    if "COUNT_VARIATIONS" in s.columns:
        stated = num("COUNT_VARIATIONS") if s.types["COUNT_VARIATIONS"] == "string" else F.col("COUNT_VARIATIONS")
        count = F.coalesce(stated, F.lit(1)).cast("long")
    allowed = tagged("list:variation") | tagged("list:fashion")
    return [Check(
        "Wrong Variation", (count >= 3) & ~allowed,
        _text("Variations: ", count.cast("string"), ", Category: ", F.col("_cat_clean")),
    )]


def warranty(s: Scope):
    scope = s.code_scope("warranty")
    if scope is None or not s.needs("PRODUCT_WARRANTY", "WARRANTY_DURATION"):
        return []
    empty = lambda c: strip(pystr(c)).isin(*K.EMPTY_WARRANTY)
    return [Check("Product Warranty", scope & empty("PRODUCT_WARRANTY") & empty("WARRANTY_DURATION"))]


def miscellaneous(s: Scope):
    if "CATEGORY" not in s.columns:
        return []
    return [Check(
        "Wrong Category", pystr("CATEGORY").rlike("(?i)miscellaneous"), F.lit("Category contains 'Miscellaneous'")
    )]


# ---------------------------------------------------------------------------
# Sellers
# ---------------------------------------------------------------------------


def refurb(s: Scope):
    pattern = word_pattern(s.rules.keywords("refurb", s.country))
    if pattern is None or not s.has_codes("refurb_phones", "refurb_laptops"):
        return []
    phone, laptop = tagged("program:refurb_phones"), tagged("program:refurb_laptops")
    open_ = (phone & ~approved("refurb_phones")) | (laptop & ~approved("refurb_laptops"))
    detail = _text(
        "Unapproved ", F.when(phone, "Phone").otherwise("Laptop"), " refurb seller — keyword '",
        _found(pattern), "' in name (cat: ", F.col("_cat_clean"), ")",
    )
    return [Check("Seller Not approved to sell Refurb", open_ & _name().rlike(pattern), detail)]


def books_seller(s: Scope):
    scope = s.code_scope("books")
    if scope is None or "books" not in s.programs:
        return []
    return [Check(
        "Seller Approve to sell books", scope & ~approved("books"),
        _text("Seller not approved to sell books: ", pystr("SELLER_NAME")),
    )]


def perfume_seller(s: Scope):
    scope, pattern = s.code_scope("perfume"), word_pattern(s.rules.keywords("perfume", s.country))
    if scope is None or pattern is None:
        return []
    placeholder = F.col("_brand_lower").isin(*K.PLACEHOLDER_BRANDS)
    flagged = placeholder & F.col("_name_lower").rlike(pattern)
    if "perfume" in s.programs:
        flagged = (flagged | F.col("_brand_lower").rlike(pattern)) & ~approved("perfume")
    brand = strip(pystr("BRAND"))
    detail = F.when(
        F.lower(brand).isin(*K.PLACEHOLDER_BRANDS),
        _text("Sneaky brand in name: '", F.substring(strip(_name()), 1, 40), "'"),
    ).otherwise(_text("Sensitive brand '", brand, "' — seller not approved"))
    return [Check("Seller Approved to Sell Perfume", scope & flagged, detail)]


def perfume_tester(s: Scope):
    scope = s.code_scope("perfume")
    if scope is None:
        return []
    return [Check(
        "Perfume Tester", scope & F.col("_name_lower").rlike(r"(?iU)\btester\b"),
        _text("Perfume tester listed for sale: ", F.substring(_name(), 1, 60)),
    )]


def sneakers(s: Scope):
    scope, words = s.code_scope("sneakers"), [w.lower() for w in s.rules.words("sneaker_brands")]
    if scope is None or not words:
        return []
    return [Check(
        "Counterfeit Sneakers",
        scope & F.col("_brand_lower").isin("generic", "fashion") & F.col("_name_lower").rlike(any_of(words)),
    )]


def jerseys(s: Scope):
    pattern = bounded_pattern(s.rules.keywords("jersey", s.country))
    if pattern is None or not s.has_codes("jersey"):
        return []
    detail = _text("Suspected counterfeit jersey — keyword '", _found(pattern), "' (cat: ", F.col("_cat_clean"), ")")
    return [Check(
        "Suspected counterfeit Jerseys",
        tagged("program:jersey") & ~approved("jersey_exempt") & _name().rlike(pattern), detail,
    )]


# ---------------------------------------------------------------------------
# Prices
# ---------------------------------------------------------------------------


def _money(usd: Column, country: str | None) -> Column:
    return _text("USD ", fmt(usd, 2), f" / {symbol_of(country)}", fmt(usd * F.lit(rate_of(country)), 0))


def fake_price(s: Scope):
    if not s.rules.has("fake_price"):
        return []
    price = F.coalesce(F.when(F.col("_sale") > 0, F.col("_sale")).otherwise(F.col("_price")), F.lit(0.0))
    return [Check("Suspected Fake product", price < F.col("_min_price"))]


def discount(s: Scope):
    both = (F.col("_price") > 0) & (F.col("_sale") > 0)
    ratio = F.when(both, F.lit(1.0) - F.col("_sale") / F.col("_price"))
    shown = fmt(ratio * 100, 1)
    prices = lambda first: _text(
        f"% ({first}: ", _money(F.col("_price"), s.country), " → Sale: ", _money(F.col("_sale"), s.country), ")"
    )
    low, high = K.SUSPICIOUS_DISCOUNT
    return [
        Check("Discount too high", ratio > K.MAX_DISCOUNT, _text("Discount too high: ", shown, prices("Price"))),
        Check(
            "Suspicious Discount", (F.col("_sale") < F.col("_price")) & (ratio > low) & (ratio <= high),
            _text("Suspicious discount of ", shown, prices("Regular")),
        ),
    ]


def max_price(s: Scope):
    rate, symbol = rate_of(s.country), symbol_of(s.country)
    price, sale = F.coalesce("_price", F.lit(0.0)), F.coalesce("_sale", F.lit(0.0))
    listed = F.greatest(price * F.lit(rate), sale * F.lit(rate))
    detail = _text(
        "Price (USD ", fmt(F.greatest(price, sale), 2), f" → {symbol}", fmt(listed, 0),
        f") exceeds category max ({symbol}", fmt(F.col("_cap"), 0), ") [", F.col("_cap_source"), "]",
    )
    return [Check("Category Max Price Exceeded", (listed > 0) & (listed > F.col("_cap")), detail)]


# ---------------------------------------------------------------------------
# Country rules
# ---------------------------------------------------------------------------


def ng_seller_lists(s: Scope):
    """Gift cards, HP toners, Apple: a scope and an approved list that must exist."""
    seller = pystr("SELLER_NAME")
    out = []
    if s.has_codes("ng_gift_card") and "ng_gift_card" in s.programs:
        out.append(Check(
            "NG - Gift Card Seller", tagged("program:ng_gift_card") & ~approved("ng_gift_card"),
            _text("Seller not authorised for Gift Card categories: ", seller),
        ))
    if s.has_codes("ng_hp_toner") and "ng_hp_toner" in s.programs:
        out.append(Check(
            "NG - HP Toners Seller",
            tagged("program:ng_hp_toner") & (F.col("_brand_lower") == "hp") & ~approved("ng_hp_toner"),
            _text("Seller not authorised for HP Ink/Toners: ", seller),
        ))
    if "ng_apple" in s.programs:
        out.append(Check(
            "NG - Apple Seller", (F.col("_brand_lower") == "apple") & ~approved("ng_apple"),
            _text("Seller not authorised to sell Apple products: ", seller),
        ))
    return out


def ng_xmas(s: Scope):
    pattern = bounded_pattern(s.rules.keywords("ng_xmas", s.country))
    if pattern is None or "ng_xmas" not in s.programs:
        return []
    detail = _text(
        "Seller not authorised for Xmas Tree products (keyword '", _found(pattern), "'): ", pystr("SELLER_NAME")
    )
    return [Check("NG - Xmas Tree Seller", _name().rlike(pattern) & ~approved("ng_xmas"), detail)]


def ng_tv(s: Scope):
    if not s.rules.has("ng_tv") or not s.has_codes("ng_tv"):
        return []
    listed = F.array_contains("_tv_sellers", F.col("_seller_lower"))
    return [Check(
        "NG - TV Brand Seller", tagged("program:ng_tv") & (F.size("_tv_sellers") > 0) & ~listed,
        _text("Seller not authorised for ", F.upper("_brand_lower"), " TVs: ", pystr("SELLER_NAME")),
    )]


def ng_rice(s: Scope):
    if not s.rules.has("ng_rice"):
        return []
    scope = (F.size("_rice.categories") == 0) | F.array_contains("_rice.categories", F.col("_cat_clean"))
    return [Check(
        "NG - Rice Brand Seller",
        F.col("_rice").isNotNull() & scope & ~F.array_contains("_rice.sellers", F.col("_seller_lower")),
        _text("Seller not authorised to sell ", py_title("_brand_lower"), " rice: ", pystr("SELLER_NAME")),
    )]


def powerbank(s: Scope):
    if not s.needs("CATEGORY_CODE", "NAME", "BRAND"):
        return []
    market = s.rules.marketplace
    scoped = s.has_codes("powerbank")
    inside = tagged("program:powerbank")
    brands = s.rules.values("powerbank_brand")
    wrong = (_name().rlike("(?iU)" + K.POWERBANK_PATTERN) & ~inside) if scoped else F.lit(False)
    sizes = F.transform(
        F.regexp_extract_all(_name(), F.lit("(?iU)" + K.MAH_PATTERN), F.lit(1)),
        lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("decimal(38,0)"),
    )
    large = F.exists(sizes, lambda v: v >= K.MIN_POWERBANK_MAH)
    fake = (
        (inside if scoped else F.lit(True)) & large & ~F.col("_brand_lower").isin(*brands)
        if brands else F.lit(False)
    )
    text = _text(
        "Brand '", pystr("BRAND"), "' not approved for ", _found("(?iU)" + K.MAH_PATTERN),
        K.POWERBANK_FAKE_TEXT.replace("{market}", market),
    )
    return [Check(
        K.POWERBANK_FLAG, wrong | fake,
        F.when(wrong, K.POWERBANK_CATEGORY_TEXT).otherwise(text),
        F.when(wrong, K.POWERBANK_CATEGORY_REASON)
        .otherwise(K.POWERBANK_FAKE_REASON.replace("{market}", market)),
    )]


def ma_brands(s: Scope):
    brands = s.rules.values("ma_brand")
    pattern = bounded_pattern(brands)
    if pattern is None:
        return []
    is_brand = F.col("_brand_lower").isin(*brands)
    detail = F.when(is_brand, _text("Marque interdite : ", pystr("BRAND"))).otherwise(
        _text("Marque interdite détectée dans le nom : ", py_title(F.regexp_extract("_name_lower", pattern, 0)))
    )
    return [Check(K.MA_BRAND_FLAG, is_brand | F.col("_name_lower").rlike(pattern), detail)]


# ---------------------------------------------------------------------------
# Runs
# ---------------------------------------------------------------------------

ROW_CHECKS = [
    miscellaneous, fake_price, refurb, warranty, books_seller, perfume_seller, perfume_tester, sneakers,
    jerseys, unnecessary_words, single_word_name, generic_brand, fashion_brand, brand_in_name,
    wrong_variation, genuine_brand, missing_color, weight_in_name, smartphone_name, discount, max_price,
]
NG_CHECKS = [ng_seller_lists, ng_xmas, ng_tv, ng_rice, powerbank]


def checks_for(country: str | None) -> list:
    extra = {"NG": NG_CHECKS, "KE": [powerbank], "UG": [powerbank], "MA": [ma_brands]}
    return ROW_CHECKS + extra.get(country, [])


def build_checks(scope: Scope, builders: list) -> list[Check]:
    return [check for b in builders for check in b(scope)]


def hits_of(df: DataFrame, checks: list[Check], keep: list[str] = ()) -> DataFrame:
    """Long hit table from one projection: null structs are dropped before the explode."""
    none = F.lit(None).cast("string")
    structs = [
        F.when(c.hit, F.struct(
            F.lit(c.flag).alias("flag"),
            (c.detail if c.detail is not None else none).alias("detail"),
            (c.reason if c.reason is not None else none).alias("reason"),
            F.lit(False).alias("cv"),
        ))
        for c in checks
    ]
    return (
        df.select(F.col("PRODUCT_SET_SID").alias("sid"), *keep, F.array_compact(F.array(*structs)).alias("hits"))
        .select("sid", *keep, F.inline("hits"))
    )


def row_hits(df: DataFrame, rules: RuleSet, country: str | None, builders: list | None = None,
             skip: list[str] = (), keep: list[str] = ()) -> DataFrame:
    scope = Scope(df, rules, country)
    checks = build_checks(scope, builders if builders is not None else checks_for(country))
    checks = [c for c in checks if c.flag not in skip]
    if not checks:
        return df.limit(0).select(
            F.col("PRODUCT_SET_SID").alias("sid"), *keep, F.lit("").alias("flag"),
            *[F.lit(None).cast("string").alias(c) for c in ("detail", "reason")], F.lit(False).alias("cv"),
        )
    text = " ".join(str(c) for check in checks for c in (check.hit, check.detail))
    needed = {fact for fact in FACT_TYPES if fact in text}
    return hits_of(attach_facts(df, rules, country, needed), checks, keep)
