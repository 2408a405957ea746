"""Names, word lists, formats and limits the results depend on."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# columns
# ---------------------------------------------------------------------------

REPORT_COLS = ["ProductSetSid", "ParentSKU", "Status", "Reason", "Comment", "FLAG", "SellerName"]
CV_COL = "CV_Detected"

FULL_DATA_COLS = [
    "PRODUCT_SET_SID", "ACTIVE_STATUS_COUNTRY", "NAME", "BRAND", "CATEGORY", "CATEGORY_CODE",
    "FULL_CATEGORY_PATH", "COLOR", "COLOR_FAMILY", "MAIN_IMAGE", "VARIATION", "PARENTSKU",
    "SELLER_NAME", "SELLER_SKU", "GLOBAL_PRICE", "GLOBAL_SALE_PRICE", "TAX_CLASS", "FLAG",
    "LISTING_STATUS", "PRODUCT_WARRANTY", "WARRANTY_DURATION", "WARRANTY_ADDRESS",
    "WARRANTY_TYPE", "COUNT_VARIATIONS", "LIST_VARIATIONS",
]

GRID_COLS = [
    "PRODUCT_SET_SID", "NAME", "BRAND", "CATEGORY", "SELLER_NAME", "MAIN_IMAGE",
    "GLOBAL_SALE_PRICE", "GLOBAL_PRICE", "COLOR",
]

REQUIRED_COLS = ["PRODUCT_SET_SID", "NAME", "BRAND", "CATEGORY_CODE", "ACTIVE_STATUS_COUNTRY"]

# Text columns where a missing value turns into the word 'nan' on ingestion.
TEXT_COLS = ["ACTIVE_STATUS_COUNTRY", "CATEGORY_CODE", "BRAND", "TAX_CLASS", "NAME", "SELLER_NAME"]

# Columns filled forwards, then backwards, inside one product set.
FILL_COLS = [
    "COLOR_FAMILY", "PRODUCT_WARRANTY", "WARRANTY_DURATION", "WARRANTY_ADDRESS",
    "WARRANTY_TYPE", "COUNT_VARIATIONS", "LIST_VARIATIONS",
]

POST_QC_SIGNATURE = ["sku", "name", "brand", "category", "price", "seller"]

HEADER_ALIASES = {
    "cod_productset_sid": "PRODUCT_SET_SID",
    "2qz3wx4ec5rv6b7hnj8kl;'[]": "PRODUCT_SET_SID",
    "dsc_name": "NAME",
    "dsc_brand_name": "BRAND",
    "cod_category_code": "CATEGORY_CODE",
    "dsc_category_name": "CATEGORY",
    "dsc_shop_seller_name": "SELLER_NAME",
    "dsc_shop_active_country": "ACTIVE_STATUS_COUNTRY",
    "cod_parent_sku": "PARENTSKU",
    "color": "COLOR",
    "colour": "COLOR",
    "color_family": "COLOR_FAMILY",
    "colour_family": "COLOR_FAMILY",
    "colour family": "COLOR_FAMILY",
    "color family": "COLOR_FAMILY",
    "list_seller_skus": "SELLER_SKU",
    "image1": "MAIN_IMAGE",
    "image_1": "MAIN_IMAGE",
    "main_image": "MAIN_IMAGE",
    "main image": "MAIN_IMAGE",
    "image": "MAIN_IMAGE",
    "img": "MAIN_IMAGE",
    "img_url": "MAIN_IMAGE",
    "image_url": "MAIN_IMAGE",
    "photo": "MAIN_IMAGE",
    "dsc_status": "LISTING_STATUS",
    "dsc_shop_email": "SELLER_EMAIL",
    "product_warranty": "PRODUCT_WARRANTY",
    "warranty_duration": "WARRANTY_DURATION",
    "warranty_address": "WARRANTY_ADDRESS",
    "warranty_type": "WARRANTY_TYPE",
    "count_variations": "COUNT_VARIATIONS",
    "count variations": "COUNT_VARIATIONS",
    "number of variations": "COUNT_VARIATIONS",
    "list_variations": "LIST_VARIATIONS",
    "list variations": "LIST_VARIATIONS",
}

# Second alias dictionary: live-listing exports.
POST_QC_ALIASES = {
    "sku": "PRODUCT_SET_SID",
    "name": "NAME",
    "brand": "BRAND",
    "category": "CATEGORY",
    "categories": "CATEGORY",
    "price": "GLOBAL_SALE_PRICE",
    "newprice": "GLOBAL_SALE_PRICE",
    "old price": "GLOBAL_PRICE",
    "oldprice": "GLOBAL_PRICE",
    "seller": "SELLER_NAME",
    "sellername": "SELLER_NAME",
    "seller name": "SELLER_NAME",
    "image url": "MAIN_IMAGE",
    "image": "MAIN_IMAGE",
    "main image": "MAIN_IMAGE",
    "url": "PRODUCT_URL",
    "product url": "PRODUCT_URL",
    "stock": "STOCK_STATUS",
    "stock status": "STOCK_STATUS",
    "rating": "RATING",
    "averagerating": "RATING",
    "average rating": "RATING",
    "total ratings": "REVIEW_COUNT",
    "totalratings": "REVIEW_COUNT",
    "review count": "REVIEW_COUNT",
    "discount": "DISCOUNT",
    "tags": "TAGS",
    "isexpress": "EXPRESS",
    "shop global": "SHOP_GLOBAL",
    "isglobal": "SHOP_GLOBAL",
    "color": "COLOR",
    "colour": "COLOR",
    "product warranty": "PRODUCT_WARRANTY",
    "warranty": "PRODUCT_WARRANTY",
    "warranty duration": "WARRANTY_DURATION",
    "count variations": "COUNT_VARIATIONS",
    "variations": "COUNT_VARIATIONS",
    "seller sku": "SELLER_SKU",
    "parentsku": "PARENTSKU",
    "parent sku": "PARENTSKU",
    "description": "DESCRIPTION",
}

# Third alias map: exact header names of the quality-report input.
QUALITY_ALIASES = {
    "SKU": "PRODUCT_SET_SID",
    "Name": "NAME",
    "Brand": "BRAND",
    "Category": "CATEGORY",
    "Price": "GLOBAL_PRICE",
    "Old Price": "OLD_PRICE",
    "Seller": "SELLER_NAME",
    "Image URL": "MAIN_IMAGE",
    "Product URL": "PRODUCT_URL",
    "Rating": "RATING",
    "Total Ratings": "TOTAL_RATINGS",
    "Discount": "DISCOUNT",
    "Stock": "STOCK",
    "Stock Status": "STOCK_STATUS",
}

# ---------------------------------------------------------------------------
# countries
# ---------------------------------------------------------------------------

# code -> (name, price-rule symbol, price-rule USD rate)
COUNTRIES = {
    "KE": ("Kenya", "KSh", 129.0),
    "UG": ("Uganda", "USh", 3700.0),
    "NG": ("Nigeria", "₦", 1550.0),
    "GH": ("Ghana", "GH₵", 15.5),
    "MA": ("Morocco", "MAD", 10.0),
    "EG": ("Egypt", "EGP", 48.5),
    "SN": ("Senegal", "XOF", 615.0),
    "IC": ("Ivory Coast", "XOF", 615.0),
}

# Countries with a validation profile; rates used for display when no live rate is given.
DISPLAY_RATES = {"KE": 128.0, "UG": 3750.0, "NG": 1550.0, "GH": 15.5, "MA": 10.1}
WHOLE_UNIT_COUNTRIES = ["KE", "UG", "NG"]
VALIDATED_COUNTRIES = ["KE", "UG", "NG", "GH", "MA"]
SKIP_CHECKS = {
    "UG": ["Counterfeit Sneakers", "Product Warranty"],
    "MA": ["Generic BRAND Issues"],
}
MULTI_COUNTRY_VALUES = ["MULTIPLE", "MULTI"]

# Weekly export file prefixes.
EXPORT_PREFIXES = {
    "KE": "Kenya", "UG": "Uganda", "NG": "Nigeria", "GH": "Ghana", "MA": "Morocco",
    "MO": "Morocco", "EG": "Egypt", "CI": "Ivory Coast", "SN": "Senegal", "ZA": "South Africa",
}

WEEK_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# ---------------------------------------------------------------------------
# limits
# ---------------------------------------------------------------------------

SPLIT_LIMIT = 9998
MAX_DISCOUNT = 0.51
SUSPICIOUS_DISCOUNT = (0.50, 0.95)
MIN_POWERBANK_MAH = 20000
SEVERITY_WEIGHTS = {"critical": 25, "high": 12, "medium": 6, "low": 2}
SEVERITY_ORDER = ["critical", "high", "medium", "low"]

LEVEL1_CAPS_USD = {
    "Automobile": 2000.0,
    "Computing": 5000.0,
    "Electronics": 5000.0,
    "Home & Office": 3000.0,
    "Industrial & Scientific": 2500.0,
    "Garden & Outdoors": 2000.0,
    "Musical Instruments": 2000.0,
    "Sporting Goods": 2000.0,
    "Gaming": 1200.0,
    "Baby Products": 600.0,
    "Toys & Games": 500.0,
    "Fashion": 500.0,
    "Health & Beauty": 500.0,
    "Grocery": 300.0,
    "Books, Movies & Music": 250.0,
    "Pet Supplies": 200.0,
}

# ---------------------------------------------------------------------------
# Words and patterns
# ---------------------------------------------------------------------------

NOISE_WORDS = [
    "new", "sale", "original", "genuine", "authentic", "official", "premium", "quality",
    "best", "hot", "2024", "2025",
]

PROMO_WORDS = [
    "new", "original", "genuine", "authentic", "official", "premium", "quality", "best",
    "hot", "sale", "promo", "deal",
]

BASE_COLORS = {
    "red": ["red", "crimson", "scarlet", "maroon", "burgundy", "wine", "ruby"],
    "blue": ["blue", "navy", "royal", "sky", "azure", "cobalt", "sapphire"],
    "green": ["green", "lime", "olive", "emerald", "mint", "forest", "jade"],
    "black": ["black", "onyx", "ebony", "jet", "charcoal", "midnight"],
    "white": ["white", "ivory", "cream", "pearl", "snow", "alabaster"],
    "gray": ["gray", "grey", "silver", "slate", "ash", "graphite"],
    "yellow": ["yellow", "gold", "golden", "amber", "lemon", "mustard"],
    "orange": ["orange", "tangerine", "peach", "coral", "apricot"],
    "pink": ["pink", "rose", "magenta", "fuchsia", "salmon", "blush"],
    "purple": ["purple", "violet", "lavender", "plum", "mauve", "lilac"],
    "brown": ["brown", "tan", "beige", "khaki", "chocolate", "coffee", "bronze"],
    "multicolor": ["multicolor", "multicolour", "multi-color", "rainbow", "mixed"],
}

JUNK_COLORS = [
    "random", "random color", "random colour", "assorted", "various",
    "as in the picture", "as in the pictures", "as the picture",
    "as per image", "as shown", "see image", "see photo",
    "all color available", "all color availble", "all colors available",
    "multicolour", "multicolored", "multicoloured", "multi colour",
    "multi color", "multi-colour", "multi-color", "multicolors", "mult", "multic",
]

COLOR_MODIFIERS = [
    "dark", "light", "bright", "deep", "pale", "soft", "matte", "matt",
    "glossy", "metallic", "neon", "pastel", "dusty", "warm", "cool",
    "royal", "navy", "olive", "mustard", "burnt", "forest", "sky",
    "baby", "hot", "ice", "mint", "rose", "coral", "nude", "tan",
    "charcoal", "ash", "sand", "cream", "ivory", "champagne", "coffee",
    "chocolate", "caramel", "wine", "burgundy", "nordic", "jungle",
    "emerald", "sapphire", "ruby", "amber", "teal", "aqua", "indigo",
    "violet", "lavender", "lilac", "magenta", "fuchsia", "maroon",
    "copper", "bronze", "gold", "silver", "platinum",
    "dominantly", "accent", "accents", "print", "stripe", "striped",
    "check", "checked", "pattern", "bead", "beaded", "ring", "with", "and", "or",
]

EMPTY_COLORS = ["nan", "", "none", "null", "n/a", "na", "-"]
EMPTY_WARRANTY = ["nan", "", "none", "nat", "n/a"]
PLACEHOLDER_BRANDS = ["designers collection", "smart collection", "generic", "original", "fashion"]
PSEUDO_BRANDS = ["generic", "fashion", "unbranded", "no brand", "original", "new"]

QUANTITY_PATTERN = (
    r"\b\d+(?:\.\d+)?\s*"
    r"(?:kg|kgs|g|gm|gms|grams|mg|mcg|ml|l|ltr|liter|litres|litre|cl|oz|ounces|lb|lbs"
    r"|tablets?|tabs?|capsules?|caps?|sachets?|count|ct|sticks?|iu"
    r"|tea\s*bags?|teabags?|bags?"
    r"|pieces?|pcs|pack|packs"
    r"|dozens?|pairs?|rolls?|sheets?|wipes?|pods?|softgels?|lozenges?|gummies|gummy"
    r"|units?|serves?|servings?|vegan\s+pieces?)"
    r"|\b\d+['’]?s\b"
    r"|\b(?:a\s+)?dozen\b"
    r"|\b(?:pack|box|set|bundle|lot)\s+of\s+\d+\b"
    r"|\bper\s+(?:kg|kgs?|g|gm|grams?|mg|mcg|ml|l|ltr|oz|lb)\b"
    r"|\d+\s*(?:Âµg|Î¼g|µg|μg|mcg)"
)
STORAGE_PATTERN = r"\b\d+\s*(gb|tb)\b"
POWERBANK_PATTERN = r"\bpower\s*bank\b"
MAH_PATTERN = r"\b(\d[\d,]*)\s*mah\b"
CASE_PATTERN = r"\b(case|cases|cover|covers)\b"
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# Ordered literal replacements for text that was decoded with the wrong code page.
ARTIFACTS = [
    ("â€“", "-"),
    ("â€”", "-"),
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", "\""),
    ("\u00e2\u20ac\u009d", "\""),
    ("Ã¬", "i"),
    ("Ã©", "e"),
    ("Ã¨", "e"),
    ("\u00c3\u00a0", "a"),
    ("Â", ""),
    ("â„¢", "TM"),
    ("â€¢", "*"),
    ("â€¦", "..."),
]

# ---------------------------------------------------------------------------
# Review decisions
# ---------------------------------------------------------------------------

DECISION_FLAGS = {
    "REJECT_POOR_IMAGE": "Poor images",
    "REJECT_IMG_STRETCHED": "Image Stretched",
    "REJECT_IMG_BLURRY": "Image Blurry",
    "REJECT_IMG_MISMATCH": "Image Mismatch",
    "REJECT_IMG_INFRINGING": "Image Infringing",
    "REJECT_IMG_TOO_MANY": "Image Too Many things displayed",
    "REJECT_WRONG_CAT": "Wrong Category",
    "REJECT_FAKE": "Suspected Fake product",
    "REJECT_BRAND": "Restricted brands",
    "REJECT_PROHIBITED": "Prohibited products",
    "REJECT_COLOR": "Missing COLOR",
    "REJECT_WRONG_BRAND": "Generic branded products with genuine brands",
    "REJECT_SUSP_DISCOUNT": "Discount too high",
    "OTHER_CUSTOM": "Other Reason (Custom)",
}
CUSTOM_PREFIX = "Other Reason (Custom): "
CUSTOM_FLAG = "Other Reason (Custom)"
OTHER_REASON = "1000007 - Other Reason"
CV_FLAGS = [
    "Image Product Coverage", "Image Visual Duplicate", "Image Color Mismatch",
    "Image Exposure", "Image Blurry",
]
REVIEW_IMAGE_FLAGS = ["Poor images", "Image Stretched", "Image Blurry"]

# ---------------------------------------------------------------------------
# Flag priority (first match wins)
# ---------------------------------------------------------------------------

BASE_PRIORITY = [
    "Wrong Category", "Restricted brands", "Suspected Fake product",
    "Seller Not approved to sell Refurb", "Product Warranty", "Seller Approve to sell books",
    "Seller Approved to Sell Perfume", "Perfume Tester", "Counterfeit Sneakers",
    "Suspected counterfeit Jerseys", "Prohibited products", "Unnecessary words in NAME",
    "Single-word NAME", "Generic BRAND Issues", "Fashion brand issues",
    "BRAND name repeated in NAME", "Wrong Variation",
    "Generic branded products with genuine brands", "Missing COLOR", "Missing Weight/Volume",
    "Incomplete Smartphone Name", "Duplicate product", "Image Stretched", "Image Blurry",
    "Image Mismatch", "Image Infringing", "Image Too Many things displayed",
    "Discount too high", "Category Max Price Exceeded", "Suspicious Discount",
    "Image Product Coverage", "Image Visual Duplicate", "Image Color Mismatch", "Image Exposure",
]
NG_PRIORITY = [
    "NG - Gift Card Seller", "NG - Books Seller", "NG - TV Brand Seller",
    "NG - HP Toners Seller", "NG - Apple Seller", "NG - Xmas Tree Seller",
    "NG - Rice Brand Seller",
]
POWERBANK_FLAG = "Powerbank Not Authorized"
MA_BRAND_FLAG = "MA - Marque Interdite"
MATCH_KEY_FLAGS = [
    "Seller Approve to sell books", "Seller Approved to Sell Perfume", "Counterfeit Sneakers",
    "Seller Not approved to sell Refurb", "Restricted brands",
]

# ---------------------------------------------------------------------------
# Powerbank texts ({market} is the marketplace name)
# ---------------------------------------------------------------------------

POWERBANK_FAKE_REASON = (
    "1000023 - Confirmation of counterfeit product by {market} technical team (Not Authorized)"
)
POWERBANK_FAKE_TEXT = (
    " powerbanks.Your listing has been rejected as {market}'s technical team has confirmed the "
    "product is counterfeit.As a result, this item cannot be sold on the platform."
    "Please ensure that all products listed are 100% authentic to comply with {market}'s policies "
    "and protect customer trust.If you believe this decision is incorrect or need further "
    "clarification, please contact the Seller Support team"
)
POWERBANK_CATEGORY_REASON = "1000007 - Wrong Category"
POWERBANK_CATEGORY_TEXT = (
    "Product name contains 'power bank' / 'powerbank' but is not listed under the correct "
    "Powerbank category. Please relist under the appropriate category."
)


def priority_of(country: str | None) -> list[str]:
    """Flags of one country in the order in which the first match wins."""
    order = list(BASE_PRIORITY)
    if country == "NG":
        order += NG_PRIORITY + [POWERBANK_FLAG]
    elif country in ("KE", "UG"):
        order += [POWERBANK_FLAG]
    elif country == "MA":
        order.remove("Prohibited products")
        order += ["Prohibited products", MA_BRAND_FLAG]
    return order
