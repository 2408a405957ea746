"""Default flag table: rejection reason and comment per flag.

Fixed values; ``{m}`` stands for the marketplace name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REASONS = {
    "license": "1000024 - Product does not have a license to be sold via {m} (Not Authorized)",
    "counterfeit": "1000023 - Confirmation of counterfeit product by {m} technical team (Not Authorized)",
    "contact": "1000028 - Kindly Contact {m} Seller Support To Confirm Possibility Of Sale Of This Product "
    "By Raising A Claim",
    "warranty": "1000013 - Kindly Provide Product Warranty Details",
    "other": "1000007 - Other Reason",
    "name": "1000008 - Kindly Improve Product Name Description",
    "color": "1000005 - Kindly confirm the actual product colour",
    "variation": "1000039 - Product Poorly Created. Each Variation Of This Product Should Be Created "
    "Uniquely (Not Authorized)",
    "category": "1000004 - Wrong Category",
    "image": "1000042 - Kindly follow our product image upload guideline.",
    "brand": "1000003 - Restricted Brand",
    "price": "1000031 - Kindly Review & Update This Product's Price or Confirm The Price Is Correct By "
    "Raising A Claim",
    "blacklist": "1000033 - Keywords in your content/ Product name / description has been blacklisted",
}

PRICE_EN = (
    "The current price of your product differs significantly from the market average.\n"
    "Please review and update the price accordingly, or if you believe the current price is correct, "
    "raise a claim with supporting justification.\n\n"
    "Also, keep in mind:\n"
    "- Promotional periods must not exceed 90 days.\n"
    "- Misleading promotions are strictly prohibited.\n"
    "- The original (pre-discount) price must be accurate and should not be inflated before applying a discount."
)
PRICE_FR = (
    "Le prix actuel de votre produit diffère fortement de la moyenne du marché.\n"
    "Veuillez le revoir et le mettre à jour en conséquence. Si vous estimez que le prix est justifié, vous "
    "pouvez soumettre une réclamation accompagnée de preuves.\n\n"
    "À noter également :\n"
    "- Les périodes promotionnelles ne doivent pas dépasser 90 jours.\n"
    "- Les promotions trompeuses sont strictement interdites.\n"
    "- Le prix d'origine (avant remise) doit être exact et ne doit pas être artificiellement gonflé avant "
    "l'application de la réduction."
)
PRICE_AR = (
    "سعر المنتج الحالي يختلف بشكل ملحوظ عن متوسط السوق.\n"
    "يرجى مراجعة السعر وتحديثه، أو في حال كنت ترى أن السعر صحيح، يمكنك تقديم طلب مراجعة (Claim) مع تقديم "
    "ما يثبت ذلك."
)

# flag -> (reason, English comment)
ENGLISH = [
    ("Restricted brands", "license", "Missing license for this item. Raise a claim via Vendor Center."),
    ("Suspected Fake product", "counterfeit", "Product confirmed counterfeit."),
    ("Seller Not approved to sell Refurb", "contact", "Contact Seller Support for Refurbished approval."),
    ("Product Warranty", "warranty", "Valid warranty required in Description/Warranty tabs."),
    ("Seller Approve to sell books", "contact", "Contact Seller Support for Book category approval."),
    ("Seller Approved to Sell Perfume", "contact", "Contact Seller Support for Perfume approval."),
    ("Counterfeit Sneakers", "counterfeit", "Sneaker confirmed counterfeit."),
    ("Suspected counterfeit Jerseys", "counterfeit", "Jersey confirmed counterfeit."),
    ("Prohibited products", "other", "Listing of this product is prohibited."),
    ("Unnecessary words in NAME", "name", "Avoid unnecessary words in title."),
    ("Single-word NAME", "name",
     "Product name is too short. Kindly update the product title using this format: Name – Type of the "
     "Products – Color. If available, please also add key details such as weight, capacity, type, and "
     "warranty to make the title clear and complete for customers."),
    ("Generic BRAND Issues", "other",
     "Use correct brand instead of Generic/Fashion. Apply for brand approval if needed."),
    ("Fashion brand issues", "other", "Use correct brand instead of Fashion. Apply for brand approval if needed."),
    ("BRAND name repeated in NAME", "other", "Brand name should not be repeated in product name."),
    ("Generic branded products with genuine brands", "other",
     "Use the displayed brand on the product instead of Generic."),
    ("Missing COLOR", "color", "Product color must be mentioned in title/color tab."),
    ("Duplicate product", "other", "This product is a duplicate."),
    ("Wrong Variation", "variation", "Create different SKUs instead of variations (variations only for sizes)."),
    ("Missing Weight/Volume", "name", "Include weight or volume (e.g., '1kg', '500ml')."),
    ("Incomplete Smartphone Name", "name", "Include memory/storage details (e.g., '128GB')."),
    ("Wrong Category", "category", "Assigned to Wrong Category. Please use correct category."),
    ("Poor images", "image", "Poor Image Quality"),
    ("Perfume Tester", "other", "Sale of perfume testers is not permitted on {m}."),
    ("NG - Gift Card Seller", "brand", "Seller not authorised to sell Gift Cards in these categories."),
    ("NG - Books Seller", "brand",
     "Seller not authorised to sell this book title, or no seller is approved for it."),
    ("NG - TV Brand Seller", "brand", "Seller not authorised to sell this TV brand."),
    ("NG - HP Toners Seller", "brand", "Seller not authorised to sell HP Ink/Toners in these categories."),
    ("NG - Apple Seller", "brand", "Seller not authorised to sell Apple products."),
    ("NG - Xmas Tree Seller", "brand", "Seller not authorised to sell Christmas Tree products."),
    ("NG - Rice Brand Seller", "brand", "Seller not authorised to sell this rice brand."),
    ("NG - Powerbank Capacity", "other",
     "Only approved brands may list powerbanks with 20,000mAh or above capacity."),
]

# flag -> (reason, English, French, Arabic comment)
TRANSLATED = [
    ("Wrong Price", "price", PRICE_EN, PRICE_FR, PRICE_AR),
    ("Category Max Price Exceeded", "price", PRICE_EN, PRICE_FR, PRICE_AR),
    ("MA - Marque Interdite", "contact",
     "Please contact {m} Seller Support and raise a claim to confirm whether this product is eligible for listing.",
     "Veuillez contacter le Support Vendeur de {m} et soumettre une réclamation afin de confirmer si ce produit "
     "est éligible à la mise en ligne.",
     "يرجى التواصل مع فريق دعم بائعين {m} وتقديم طلب مراجعة (Claim) للتأكد من إمكانية عرض هذا المنتج على المنصة."),
    ("MA - Produit Interdit", "blacklist",
     "Your product name or description includes unauthorized or blacklisted keywords.",
     "Le nom ou la description de votre produit contient des mots-clés non autorisés ou interdits.\n"
     "Veuillez relire attentivement le contenu et supprimer ou remplacer tout mot-clé interdit.",
     "اسم المنتج أو وصفه يحتوي على كلمات غير مصرح بها. يرجى مراجعة المحتوى بعناية."),
]


def flag_rows(marketplace: str) -> list[tuple[str, str, str, str, str]]:
    put = lambda text: text.replace("{m}", marketplace)
    rows = [(flag, put(REASONS[r]), put(en), put(en), put(en)) for flag, r, en in ENGLISH]
    rows += [(flag, put(REASONS[r]), put(en), put(fr), put(ar)) for flag, r, en, fr, ar in TRANSLATED]
    return rows


def default_flags(spark: SparkSession, marketplace: str = "Marketplace") -> DataFrame:
    from shelfcheck.sources.rules import SCHEMAS, small_table

    return small_table(spark, flag_rows(marketplace), SCHEMAS["flags"])
