"""Rule tables: schemas, loaders from raw sheets, and access to word lists."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfcheck.constants import LEVEL1_CAPS_USD
from shelfcheck.functions.text import clean_category_code, path_segments, strip

SCHEMAS = {
    "code_list": "list_name string, code string",
    "word_list": "list_name string, word string",
    "prohibited": "country string, rule_seq long, keyword string, categories array<string>",
    "restricted_brand": "country string, rule_seq long, brand string, brand_raw string, "
    "sellers array<string>, categories array<string>, variations array<string>",
    "seller_allow": "country string, program string, seller string",
    "program_category": "program string, code string",
    "program_keyword": "country string, program string, keyword string",
    "fake_price": "country string, brand string, category string, min_price double",
    "ng_book": "rule_seq long, title string, seller string",
    "ng_tv": "brand string, seller string",
    "ng_rice": "brand string, sellers array<string>, categories array<string>",
    "powerbank_brand": "brand string",
    "ma_brand": "brand string",
    "category": "code string, path string, seq long",
    "price_cap": "country string, code string, cap_local double",
    "level1_cap": "level1 string, cap_usd double",
    "flags": "flag string, reason string, en string, fr string, ar string",
    "keyword_weight": "category string, keyword string, weight double",
    "same_domain": "top string, leaf string",
    "cross_block": "block long, keyword string, forbidden_top string",
    "correction": "id long, name string, category string",
}


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows as a relation whose size Spark knows, so joins plan by size."""
    struct = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrow = to_arrow_schema(struct)
    table = pa.table(
        [pa.array(list(values), type=f.type) for values, f in zip(columns, arrow)],
        names=struct.names,
    )
    return spark.createDataFrame(table, schema=struct)


@dataclass
class RuleSet:
    """Rule tables by name.  A missing table makes its checks yield nothing."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    marketplace: str = "Marketplace"
    _lists: dict = field(default_factory=dict)

    def get(self, name: str) -> DataFrame:
        found = self.tables.get(name)
        if found is not None:
            return found
        if name == "level1_cap":
            return small_table(self.spark, list(LEVEL1_CAPS_USD.items()), SCHEMAS[name])
        if name == "flags":
            from shelfcheck.sources.flags import default_flags

            return default_flags(self.spark, self.marketplace)
        return small_table(self.spark, [], SCHEMAS[name])

    def has(self, name: str) -> bool:
        return name in self.tables

    def _values(self) -> dict[tuple, list[str]]:
        """Word lists, and the names of the other lists, by (kind, name, country), read in one job.

        Word lists are rule sheets, not listings: of any length, they go into one pattern or one set.
        """
        if "all" not in self._lists:
            null = F.lit(None).cast("string")
            sources = {
                "word_list": ("word", "list_name", null, "word"),
                "program_keyword": ("keyword", "program", F.col("country"), "keyword"),
                "seller_allow": ("seller", "program", F.col("country"), F.lit("x")),
                "code_list": ("list", "list_name", null, F.lit("x")),
                "program_category": ("program", "program", null, F.lit("x")),
                "powerbank_brand": ("powerbank_brand", null, null, "brand"),
                "ma_brand": ("ma_brand", null, null, "brand"),
                "ng_book": ("ng_book", null, null, "title"),
            }
            parts = [
                self.get(t).select(
                    F.lit(kind).alias("kind"), (F.col(name) if isinstance(name, str) else name).alias("name"),
                    country.alias("country"), (F.col(value) if isinstance(value, str) else value).alias("value"),
                )
                for t, (kind, name, country, value) in sources.items() if self.has(t)
            ]
            found: dict[tuple, list[str]] = {}
            if parts:
                union = parts[0]
                for p in parts[1:]:
                    union = union.unionByName(p)
                for kind, name, country, value in union.distinct().collect():
                    if value:
                        found.setdefault((kind, name, country), []).append(value)
            self._lists["all"] = found
        return self._lists["all"]

    def values(self, kind: str, name: str | None = None, country: str | None = None) -> list[str]:
        """Values of one list, longest first."""
        key = (kind, name, country)
        if key not in self._lists:
            self._lists[key] = _longest_first(
                v for (k, n, c), vs in self._values().items() for v in vs
                if k == kind and n == name and (c is None or c == country)
            )
        return self._lists[key]

    def words(self, list_name: str) -> list[str]:
        return self.values("word", list_name)

    def keywords(self, program: str, country: str | None) -> list[str]:
        return self.values("keyword", program, country)

    def _names(self, kind: str, country: str | None = None) -> set[str]:
        return {n for k, n, c in self._values() if k == kind and (country is None or c is None or c == country)}

    def programs_with_sellers(self, country: str | None) -> set[str]:
        """Programs that have at least one approved seller in the country."""
        return self._names("seller", country)

    def lists_with_codes(self) -> set[str]:
        """Non-empty code lists ('list:x') and programs with category codes ('program:x')."""
        return {f"list:{n}" for n in self._names("list")} | {
            f"program:{n}" for n in self._names("program")
        }

    def pin(self) -> RuleSet:
        """The same rules as written tables, for rule sets that are themselves computed."""
        from shelfcheck.session import materialize

        tables = {name: materialize(df, f"rule-{name}") for name, df in self.tables.items()}
        return RuleSet(self.spark, tables, self.marketplace)


def _longest_first(words) -> list[str]:
    return sorted(set(words), key=lambda w: (-len(w), w))


def in_scope(country: str | None) -> Column:
    """Rows of one country, or all rows when no country is given; NULL means any."""
    if country is None:
        return F.lit(True)
    return F.col("country").isNull() | (F.col("country") == country)


# ---------------------------------------------------------------------------
# Loaders: raw sheet (all text columns) -> rule table
# ---------------------------------------------------------------------------


def _lower(c: Column | str) -> Column:
    return F.lower(strip(F.col(c) if isinstance(c, str) else c))


def _kept(c: Column, header_words: list[str]) -> Column:
    return c.isNotNull() & ~c.isin("", "nan", *header_words)


def _split_list(c: Column, pattern: str = ",") -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def _find(df: DataFrame, *needles: str, default: int | None = 0, without: str | None = None) -> str | None:
    """First column whose lower-case name contains a needle."""
    for c in df.columns:
        low = c.strip().lower()
        if any(n in low for n in needles) and not (without and without in low):
            return c
    return None if default is None or default >= len(df.columns) else df.columns[default]


def load_prohibited(df: DataFrame, country: str, seq: str = "rule_seq") -> DataFrame:
    """Keyword rules; ``seq`` is the row order of the sheet."""
    data = df.drop(seq)
    word, cats = _find(data, "keyword", "prohibited", "name"), _find(data, "cat", default=None)
    keyword = _lower(word)
    raw = F.col(cats) if cats else F.lit(None).cast("string")
    raw = F.when(F.lower(strip(raw)) != "nan", raw)
    codes = F.transform(_split_list(raw, r"[,\n]+"), lambda x: clean_category_code(x))
    return df.filter(_kept(keyword, ["keywords"])).select(
        F.lit(country).alias("country"), F.col(seq).cast("long").alias("rule_seq"),
        keyword.alias("keyword"), F.array_distinct(codes).alias("categories"),
    )


def load_restricted_brands(df: DataFrame, country: str, seq: str = "rule_seq") -> DataFrame:
    """One rule per brand: unions over its rows; a blank category frees the rule from categories."""
    brand = strip("brand")
    opt = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    value = lambda n: F.when(F.lower(strip(opt(n))) != "nan", strip(opt(n)))
    rows = df.filter(_kept(F.lower(brand), [])).select(
        F.lower(brand).alias("brand"), brand.alias("raw"), F.col(seq).cast("long").alias("s"),
        _split_list(F.lower(value("approved sellers"))).alias("sellers"),
        F.transform(_split_list(value("categories")), lambda x: clean_category_code(x)).alias("cats"),
        (F.coalesce(value("categories"), F.lit("")) == "").alias("blank"),
        _split_list(F.lower(value("variations"))).alias("vars"),
    )
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    merged = rows.groupBy("brand").agg(
        F.min("s").alias("rule_seq"), F.min_by("raw", "s").alias("brand_raw"),
        union("sellers").alias("sellers"), F.bool_or("blank").alias("blank"),
        union("cats").alias("cats"), union("vars").alias("variations"),
    )
    none = F.array().cast("array<string>")
    return merged.select(
        F.lit(country).alias("country"), "rule_seq", "brand", "brand_raw", "sellers",
        F.when(F.col("blank"), none).otherwise(F.col("cats")).alias("categories"), "variations",
    )


def load_refurb_sellers(df: DataFrame, country: str) -> DataFrame:
    """Two columns of sellers: phones, laptops."""
    phones, laptops = df.columns[:2]
    return (
        df.select(
            F.explode(
                F.array(
                    F.struct(F.lit("refurb_phones").alias("program"), _lower(phones).alias("seller")),
                    F.struct(F.lit("refurb_laptops").alias("program"), _lower(laptops).alias("seller")),
                )
            ).alias("r")
        )
        .filter(
            F.when(F.col("r.program") == "refurb_phones", _kept(F.col("r.seller"), ["phones", "phone"]))
            .otherwise(_kept(F.col("r.seller"), ["laptops", "laptop"]))
        )
        .select(F.lit(country).alias("country"), "r.program", "r.seller")
        .distinct()
    )


def load_refurb_categories(df: DataFrame) -> DataFrame:
    phones, laptops = df.columns[:2]
    pair = lambda p, c: F.struct(
        F.lit(p).alias("program"), clean_category_code(c).alias("code"), _lower(c).alias("raw")
    )
    return (
        df.select(F.explode(F.array(pair("refurb_phones", phones), pair("refurb_laptops", laptops))).alias("r"))
        .filter(_kept(F.col("r.raw"), ["phones", "phone", "laptops", "laptop"]))
        .select("r.program", "r.code")
        .distinct()
    )


def load_seller_list(df: DataFrame, country: str, program: str) -> DataFrame:
    """Approved sellers of one program (perfume, books, jersey exemptions, gift cards, ...)."""
    needles = ("exempt", "seller") if program == "jersey_exempt" else ("seller",)
    name = _find(df, *needles, default=None if program == "jersey_exempt" else 0)
    if name is None:
        return small_table(df.sparkSession, [], SCHEMAS["seller_allow"])
    seller = _lower(name)
    header = ["sellername", "seller name", "seller", "exempted sellers"]
    return (
        df.select(F.lit(country).alias("country"), F.lit(program).alias("program"), seller.alias("seller"))
        .filter(_kept(F.col("seller"), header))
        .distinct()
    )


def load_keyword_list(df: DataFrame, program: str, country: str | None = None) -> DataFrame:
    needles = ("brand", "keyword") if program == "perfume" else ("keyword",)
    word = _lower(_find(df, *needles))
    header = ["name", "brand", "keyword", "keywords", "words"]
    return (
        df.select(F.lit(country).cast("string").alias("country"), F.lit(program).alias("program"),
                  word.alias("keyword"))
        .filter(_kept(F.col("keyword"), header))
        .distinct()
    )


def load_category_list(df: DataFrame, program: str, column: str | None = None) -> DataFrame:
    name = column or _find(df, "cat")
    code = clean_category_code(name)
    return (
        df.filter(F.col(name).isNotNull())
        .select(F.lit(program).alias("program"), code.alias("code"))
        .filter(_kept(F.lower(F.col("code")), ["categories", "category"]))
        .distinct()
    )


def load_fake_price(df: DataFrame, country: str, seq: str = "rule_seq") -> DataFrame:
    """Wide sheet: header = brand, first row = price, further rows = category codes."""
    brands = [c for c in df.columns if c not in (seq, "Unnamed: 0", "Brand", "Price")]
    cells = df.unpivot([seq], brands, "brand", "cell")
    first = df.agg(F.min(F.col(seq).cast("long"))).first()[0]
    cells = cells.withColumn("is_price", F.col(seq).cast("long") == F.lit(first))
    price = cells.filter("is_price").select(
        "brand", strip("cell").try_cast("double").alias("min_price")
    ).filter(F.col("min_price") > 0)
    codes = cells.filter(~F.col("is_price") & F.col("cell").isNotNull()).select(
        "brand", clean_category_code("cell").alias("category")
    ).filter(_kept(F.lower("category"), []))
    return codes.join(price, "brand").select(
        F.lit(country).alias("country"), _lower("brand").alias("brand"), "category", "min_price"
    ).distinct()


def load_category_map(df: DataFrame, seq: str = "rule_seq") -> DataFrame:
    """Category table (code, path, seq); the path may be missing."""
    data = df.drop(seq)
    path, code = _find(data, "path", default=None), _find(data, "code")
    text = strip(path) if path else F.lit(None).cast("string")
    cleaned = F.substring_index(strip(code), ".", 1)
    return df.filter(_kept(F.lower(cleaned), [])).select(
        cleaned.alias("code"), F.when(_kept(F.lower(text), []), text).alias("path"),
        F.col(seq).cast("long").alias("seq"),
    )


def load_category_names(df: DataFrame, seq: str = "rule_seq", sep: str = "/") -> DataFrame:
    """Lower-case name -> code (last row wins); a path's last segment adds a name not present."""
    data = df.drop(seq)
    name, code, path = _find(data, "name", without="path"), _find(data, "code"), _find(data, "path", default=None)
    cleaned = F.substring_index(strip(code), ".", 1)
    rows = df.select(
        _lower(name).alias("name"), cleaned.alias("code"), F.col(seq).cast("long").alias("s"),
        (_lower(F.element_at(F.split(F.col(path), sep), -1)) if path else F.lit(None).cast("string")).alias("last"),
    )
    named = rows.filter(_kept(F.col("name"), []) & _kept(F.lower("code"), [])).groupBy("name").agg(
        F.max_by("code", "s").alias("code"), F.min("s").alias("s")
    )
    segments = rows.filter(_kept(F.col("last"), [])).groupBy(F.col("last").alias("name")).agg(
        F.min_by("code", "s").alias("code"), F.min("s").alias("s")
    )
    return named.select("name", "code").unionByName(
        segments.join(named, "name", "left_anti").select("name", "code")
    )


def load_price_caps(df: DataFrame, countries: list[str], code_col: str = "category_code") -> DataFrame:
    caps = df.select(F.col(code_col), *[strip(F.col(c).cast("string")).alias(c) for c in countries])
    code = strip(F.col(code_col).cast("string"))
    return (
        caps.unpivot([code_col], countries, "country", "cap")
        .filter(code.rlike(r"^\d+$"))
        .select("country", code.cast("long").cast("string").alias("code"),
                F.col("cap").try_cast("double").alias("cap_local"))
        .filter(F.col("cap_local") > 0)
    )


def load_keyword_weights(df: DataFrame, categories: DataFrame, column: str = "json") -> DataFrame:
    """JSON rules -> (category, keyword, weight); a code resolves to its path, else the name is used.

    Accepts one JSON object per row with category name/code and a keyword map, or
    one object mapping categories to keyword maps.
    """
    record = (
        "category string, `Category Path` string, name string, category_name string, category_code string, "
        "keywords map<string,double>, weights map<string,double>, positive map<string,double>"
    )
    text = F.col(column)
    items = df.select(
        F.when(strip(text).startswith("["), F.from_json(text, f"array<struct<{_ddl(record)}>>"))
        .otherwise(F.array(F.from_json(text, record))).alias("items"), text.alias("t"),
    )
    listed = items.select(F.explode("items").alias("r")).select(
        F.coalesce("r.category", "r.`Category Path`", "r.name", "r.category_name").alias("named"),
        F.col("r.category_code").alias("code"),
        F.coalesce("r.keywords", "r.weights", "r.positive").alias("kw"),
    ).filter(F.col("kw").isNotNull() & (F.col("named").isNotNull() | F.col("code").isNotNull()))
    mapped = items.filter(~strip("t").startswith("[")).select(
        F.explode(F.from_json("t", "map<string,map<string,double>>")).alias("named", "kw")
    ).select("named", F.lit(None).cast("string").alias("code"), "kw").filter(
        (F.size("kw") > 0) & F.exists(F.map_values("kw"), lambda w: w.isNotNull())
    )
    rules = listed.unionByName(mapped)
    paths = categories.select(F.col("code"), F.col("path").alias("full"))
    return (
        rules.join(paths, "code", "left")
        .select(_lower(F.coalesce("full", "named")).alias("category"), F.explode("kw").alias("keyword", "weight"))
        .select("category", F.lower("keyword").alias("keyword"), "weight")
        .filter(F.col("weight").isNotNull() & (F.col("category") != ""))
    )


def _ddl(fields: str) -> str:
    """Column list in the form a struct type takes (name: type)."""
    return T.StructType.fromDDL(fields).simpleString()[len("struct<"):-1].replace(
        "Category Path:", "`Category Path`:"
    )


def load_ng_books(df: DataFrame, seq: str = "rule_seq") -> DataFrame:
    title, seller = [c for c in df.columns if c != seq][:2]
    name = _lower(title)
    return df.filter(_kept(name, [])).groupBy(name.alias("title")).agg(
        F.min(F.col(seq).cast("long")).alias("rule_seq"),
        F.max_by(F.when(_kept(_lower(seller), []), _lower(seller)), F.col(seq).cast("long")).alias("seller"),
    ).select("rule_seq", "title", "seller")


def load_ng_tvs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First column category codes, one further column of sellers per brand."""
    cat, *brands = df.columns
    codes = load_category_list(df.select(cat), "ng_tv", cat)
    sellers = df.select(*brands).unpivot([], brands, "brand", "seller").select(
        _lower("brand").alias("brand"), _lower("seller").alias("seller")
    ).filter(_kept(F.col("seller"), []) & (F.col("seller") != F.col("brand"))).distinct()
    return codes, sellers


def load_ng_rice(df: DataFrame) -> DataFrame:
    brand, sellers, *rest = df.columns
    cat = F.col(rest[0]) if rest else F.lit(None).cast("string")
    code = F.when(_kept(F.lower(strip(cat)), []), clean_category_code(cat))
    seller_text = F.when(_kept(_lower(sellers), []), _lower(sellers))
    rows = df.filter(_kept(_lower(brand), [])).select(
        _lower(brand).alias("brand"), _split_list(seller_text).alias("sellers"), code.alias("code")
    )
    return rows.groupBy("brand").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sellers")))).alias("sellers"),
        F.array_sort(F.collect_set("code")).alias("categories"),
    )


def load_brand_list(df: DataFrame) -> DataFrame:
    name = _lower(df.columns[0])
    return df.select(name.alias("brand")).filter(_kept(F.col("brand"), ["brand"])).distinct()


def load_ma_brands(df: DataFrame, seq: str = "rule_seq") -> tuple[DataFrame, DataFrame]:
    """Brands with a vendor are restricted; brands without one are prohibited."""
    data = df.drop(seq)
    brand = strip(_find(data, "brand"))
    vendor = _lower(_find(data, "vendor", "seller", "authorized", default=1))
    rows = df.filter(_kept(F.lower(brand), ["restricted brand", "brand"])).groupBy(
        F.lower(brand).alias("brand")
    ).agg(
        F.min(F.col(seq).cast("long")).alias("rule_seq"),
        F.min_by(brand, F.col(seq).cast("long")).alias("brand_raw"),
        F.array_sort(F.collect_set(F.when(_kept(vendor, ["none", "authorized vendors"]), vendor))).alias("sellers"),
    )
    none = F.array().cast("array<string>")
    restricted = rows.filter(F.size("sellers") > 0).select(
        F.lit("MA").alias("country"), "rule_seq", "brand", "brand_raw", "sellers",
        none.alias("categories"), none.alias("variations"),
    )
    return restricted, rows.filter(F.size("sellers") == 0).select("brand")


def load_ma_keywords(df: DataFrame, seq: str = "rule_seq") -> DataFrame:
    word = _lower([c for c in df.columns if c != seq][0])
    return df.filter(_kept(word, ["keyword", "keywords"])).select(
        F.lit("MA").alias("country"), F.col(seq).cast("long").alias("rule_seq"),
        word.alias("keyword"), F.array().cast("array<string>").alias("categories"),
    )


def load_flags(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """Custom flag table; the default ``NG - *`` rows stay and win."""
    text = lambda n: strip(F.col(n)) if n in df.columns else F.lit(None).cast("string")
    other = lambda n: F.coalesce(F.when(_kept(F.lower(text(n)), []), text(n)), text("comment"))
    custom = df.select(
        text("flag").alias("flag"), text("reason").alias("reason"), text("comment").alias("en"),
        other("french").alias("fr"), other("arabic").alias("ar"),
    ).filter(_kept(F.lower("flag"), []))
    country_rows = defaults.filter(F.col("flag").startswith("NG - "))
    return custom.join(country_rows, "flag", "left_anti").unionByName(country_rows)


def load_reference_categories(df: DataFrame) -> DataFrame:
    """Upload categories: export name, lower name and path, distinct path tokens, depth."""
    path = F.coalesce(F.lower("Category Path"), F.lit(""))
    return df.filter(strip("export_category") != "").select(
        strip("export_category").alias("export_category"), _lower("category_name").alias("category_name_lower"),
        F.col("Category Path").alias("path"), path.alias("path_lower"),
        F.array_distinct(F.regexp_extract_all(path, F.lit("([a-z]+)"), F.lit(1))).alias("path_tokens"),
        (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).alias("depth"),
    )


def load_reference_brands(df: DataFrame) -> DataFrame:
    """Brand entries 'id - name'; the lower name is what follows the first separator."""
    entry = strip(df.columns[0])
    after = F.regexp_replace(entry, r"^.*? - ", "")
    return df.filter(F.col(df.columns[0]).isNotNull()).select(
        entry.alias("brand_entry"), F.lower(strip(after)).alias("brand_name_lower")
    )


def ancestors(category: DataFrame, sep: str = ">") -> DataFrame:
    """Every category code with each proper ancestor path and its distance."""
    parts = path_segments("path", sep)
    return (
        category.filter(F.col("path").isNotNull())
        .select("code", parts.alias("parts"))
        .select("code", "parts", F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))).alias("depth"))
        .filter(F.col("depth") < F.size("parts"))
        .select("code", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), f" {sep} ").alias("ancestor"))
    )
