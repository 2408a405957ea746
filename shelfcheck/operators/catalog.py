"""Header and value normalisation, country scope, metadata fill and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcheck.constants import (
    COUNTRIES,
    FILL_COLS,
    HEADER_ALIASES,
    MULTI_COUNTRY_VALUES,
    POST_QC_ALIASES,
    POST_QC_SIGNATURE,
    REQUIRED_COLS,
    TEXT_COLS,
    VALIDATED_COUNTRIES,
)
from shelfcheck.functions.text import clean_category_code, num, pystr, strip
from shelfcheck.session import materialize

SID = "PRODUCT_SET_SID"
SEQ = "_seq"
MARKET_PREFIX = r"^[A-Z]+-"
MAP_CELLS = 1024


def rename_headers(df: DataFrame, aliases: dict[str, str], upper: bool) -> DataFrame:
    """Trim headers and rename by alias; the first of two equal targets is kept."""
    picked: dict[str, Column] = {}
    for name in df.columns:
        clean = name.strip()
        if clean.startswith("_"):
            target = clean
        else:
            target = aliases.get(clean.lower(), clean.upper() if upper else clean)
        picked.setdefault(target, df[f"`{name}`"].alias(target))
    return df.select(*picked.values())


def standardize_columns(df: DataFrame) -> DataFrame:
    out = rename_headers(df, HEADER_ALIASES, upper=True)
    fixes = {c: pystr(c) for c in TEXT_COLS if c in out.columns}
    if "MAIN_IMAGE" not in out.columns:
        fixes["MAIN_IMAGE"] = F.lit("")
    if SID in out.columns:
        fixes[SID] = strip(pystr(SID))
    return out.withColumns(fixes)


def standardize_post_qc(df: DataFrame, marketplace: str = "marketplace") -> DataFrame:
    aliases = {**POST_QC_ALIASES, f"{marketplace.lower()} express": "EXPRESS"}
    return rename_headers(df, aliases, upper=False)


def validate_schema(df: DataFrame) -> DataFrame:
    """One row per required column that is missing."""
    missing = [c for c in REQUIRED_COLS if c not in df.columns]
    return (
        df.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(f"Missing: {c}") for c in missing]).cast("array<string>"))
                .alias("error"))
    )


def detect_file_kind(df: DataFrame) -> str:
    names = {c.strip().lower() for c in df.columns}
    return "post_qc" if names.issuperset(POST_QC_SIGNATURE) else "pre_qc"


def derive_keys(df: DataFrame) -> DataFrame:
    """Lower-case keys, cleaned category code and numeric prices, computed once per row."""
    types = dict(df.dtypes)
    derived = {
        "_name_lower": F.lower(pystr("NAME")),
        "_brand_lower": strip(F.lower(pystr("BRAND"))),
        "_seller_lower": strip(F.lower(pystr("SELLER_NAME"))) if "SELLER_NAME" in types else F.lit("nan"),
        "_cat_clean": clean_category_code("CATEGORY_CODE"),
    }
    for source, target in (("GLOBAL_PRICE", "_price"), ("GLOBAL_SALE_PRICE", "_sale")):
        if source in types:
            derived[target] = num(source) if types[source] == "string" else F.col(source).cast("double")
    return df.withColumns(derived)


# ---------------------------------------------------------------------------
# Country scope
# ---------------------------------------------------------------------------


def country_code(c: Column | str, prefix: str = MARKET_PREFIX) -> Column:
    return F.regexp_replace(F.upper(strip(pystr(c))), prefix, "")


def in_country(c: Column, country: str) -> Column:
    wanted = [country] + (MULTI_COUNTRY_VALUES if country == "NG" else [])
    return c.isin(*wanted)


def filter_country(df: DataFrame, country: str, prefix: str = MARKET_PREFIX) -> DataFrame:
    code = country_code("ACTIVE_STATUS_COUNTRY", prefix)
    out = df.withColumn("ACTIVE_STATUS_COUNTRY", code)
    multi = F.lit(False)
    if country == "NG":
        multi = F.col("ACTIVE_STATUS_COUNTRY").isin(*MULTI_COUNTRY_VALUES)
    return out.filter(in_country(F.col("ACTIVE_STATUS_COUNTRY"), country)).withColumn(
        "_IS_MULTI_COUNTRY", multi
    )


def detected_countries(df: DataFrame, prefix: str = MARKET_PREFIX) -> DataFrame:
    """Distinct country values of a file, named where the country has a profile."""
    code = country_code("ACTIVE_STATUS_COUNTRY", prefix)
    named = F.lit(None).cast("string")
    for c in VALIDATED_COUNTRIES:
        named = F.when(F.col("code") == c, COUNTRIES[c][0]).otherwise(named)
    return (
        df.select(code.alias("code"))
        .distinct()
        .filter((strip("code") != "") & (F.lower(strip("code")) != "nan"))
        .select("code", F.coalesce(named, F.concat(F.lit("'"), F.col("code"), F.lit("'"))).alias("name"))
    )


# ---------------------------------------------------------------------------
# Metadata fill and keep-first
# ---------------------------------------------------------------------------


def fill_metadata(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fill every row from the nearest earlier, else nearest later, row of its set.

    Rows are range-partitioned by (set, order), so a set that holds a large share
    of all rows spans many tasks.  Each task fills inside its own stretch; what
    must cross a stretch boundary is one summary row per set and stretch.
    ``prepare_catalog`` keeps one row per set and does not need this form.
    """
    cols = cols or [c for c in FILL_COLS if c in df.columns]
    ranged = df.repartitionByRange(SID, SEQ).withColumn("_stretch", F.spark_partition_id())
    rows = materialize(ranged, "ranged")
    inside = Window.partitionBy(SID, "_stretch").orderBy(SEQ)
    back = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(SEQ))
    ends = rows.groupBy(SID, "_stretch").agg(
        *[F.max_by(c, known(c)).alias(f"_last_{c}") for c in cols],
        *[F.min_by(c, known(c)).alias(f"_first_{c}") for c in cols],
    )
    across = Window.partitionBy(SID).orderBy("_stretch")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    carried = (
        ends.withColumns(
            {
                "_n": F.count("*").over(Window.partitionBy(SID)),
                **{f"_in_{c}": F.last(f"_last_{c}", True).over(earlier) for c in cols},
                **{f"_out_{c}": F.first(f"_first_{c}", True).over(later) for c in cols},
            }
        )
        .filter(F.col("_n") > 1)
        .select(SID, "_stretch", *[f"_in_{c}" for c in cols], *[f"_out_{c}" for c in cols])
    )
    local = rows.withColumns(
        {
            **{f"_back_{c}": F.last(c, True).over(back) for c in cols},
            **{f"_ahead_{c}": F.first(c, True).over(ahead) for c in cols},
        }
    )
    return local.join(carried, [SID, "_stretch"], "left").select(
        *[
            F.coalesce(f"_back_{c}", f"_in_{c}", f"_ahead_{c}", f"_out_{c}").alias(c)
            if c in cols else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def keep_first(df: DataFrame, key: str = SID) -> DataFrame:
    """First row per key in file order, as one partial aggregate."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (key, SEQ)]
    return df.groupBy(key).agg(F.min(SEQ).alias(SEQ), F.min_by(F.struct(*rest), SEQ).alias("_row")).select(
        key, SEQ, "_row.*"
    )


# Columns the checks read; always carried by ``prepare_catalog``.
CORE_COLS = ["NAME", "BRAND", "CATEGORY_CODE", "ACTIVE_STATUS_COUNTRY", "SELLER_NAME", "GLOBAL_PRICE", "GLOBAL_SALE_PRICE"]


def prepare_catalog(df: DataFrame, country: str | None = None, prefix: str = MARKET_PREFIX,
                    columns: list[str] | None = None, core: list[str] | None = None) -> DataFrame:
    """Standardise, fill, scope to a country, count variations, keep one row per set.

    One shuffle of the rows in scope on the set id.  The first row of a set is one
    struct chosen by ``min_by``; the map-side combine leaves one row per set and
    task however often a set repeats.  ``columns`` limits what is carried through the shuffle
    besides the columns the checks read.  ``core`` names those to carry instead of these, for a
    reader that runs no checks; the derived keys of the checks are then left out.
    """
    base = standardize_columns(df)
    if columns is not None:
        scope = ["ACTIVE_STATUS_COUNTRY"] if country is not None else []
        kept = {SID, SEQ, *columns, *(CORE_COLS if core is None else core + scope)}
        base = base.select(*[F.col(f"`{c}`") for c in base.columns if c in kept])
    fills = [c for c in FILL_COLS if c in base.columns]
    if "ACTIVE_STATUS_COUNTRY" in base.columns or core is None:
        base = base.withColumn("ACTIVE_STATUS_COUNTRY", country_code("ACTIVE_STATUS_COUNTRY", prefix))
    code = F.col("ACTIVE_STATUS_COUNTRY")
    match = F.lit(True) if country is None else in_country(code, country)
    rest = [F.col(f"`{c}`") for c in base.columns if c not in (SID, SEQ)]
    # made before the aggregate, and read there twice so that it stays there
    base = base.withColumn("_row", F.when(match, F.struct(*rest)))
    aggs = [
        F.min(SEQ).alias(SEQ), F.count("_row").alias("_rows"), F.min_by("_row", SEQ).alias("_row"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(SEQ))).alias(f"_fill_{c}") for c in fills],
    ]
    helpers = ["_rows", *[f"_fill_{c}" for c in fills]]
    scoped = base if country is None else base.filter(match)
    one = scoped.groupBy(SID).agg(*aggs).select(SID, SEQ, *helpers, "_row.*")
    if country is not None:
        one = _fill_across_countries(base, match, materialize(one, "prepared"), fills)
    out = one.withColumns({c: F.coalesce(c, f"_fill_{c}") for c in fills})
    stated = F.coalesce(num("COUNT_VARIATIONS"), F.lit(1.0)) if "COUNT_VARIATIONS" in fills else F.lit(1.0)
    multi = code.isin(*MULTI_COUNTRY_VALUES) if country == "NG" else F.lit(False)
    out = out.withColumns(
        {
            "COUNT_VARIATIONS": F.greatest(F.col("_rows").cast("double"), stated).cast("long"),
            "_IS_MULTI_COUNTRY": multi,
        }
    ).drop(*helpers)
    return derive_keys(out) if core is None else out


def _among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is marked in a bit map of the keys: all that are among them, and few others.

    The map has ``MAP_CELLS`` cells of 32 768 bits, whatever the number of keys, so it is broadcast.
    """
    place = F.xxhash64(key)
    cell, at = F.shiftright(place, 15).bitwiseAND(MAP_CELLS - 1), place.bitwiseAND((1 << 15) - 1)
    maps = keys.groupBy(cell.alias("_cell")).agg(F.bitmap_construct_agg(at).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("_cell", cell).join(F.broadcast(materialize(maps, "map")), "_cell")
    return kept.filter(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def _fill_across_countries(base: DataFrame, match: Column, one: DataFrame, fills: list[str]) -> DataFrame:
    """Correct the fill of sets that have values in rows out of scope.

    There the nearest earlier value wins over the first later one.  Such sets are
    rare: only their ids are sought among the rows out of scope, and the pass over
    their rows runs only when there are any.
    """
    if not fills:
        return one
    given = F.coalesce(*[F.col(c).cast("string") for c in fills]).isNotNull()
    outside = materialize(_among(base.filter(~match & given).select(SID), one.select(SID), SID), "outside")
    late = materialize(one.select(SID, F.col(SEQ).alias("_from")).join(outside, SID, "left_semi"), "late")
    if late.isEmpty():
        return one
    rows = base.select(SID, SEQ, *fills).join(late, SID)
    known = lambda c, at=F.lit(True): F.when(F.col(c).isNotNull() & at, F.col(SEQ))
    before = lambda c: F.max_by(c, known(c, F.col(SEQ) < F.col("_from")))
    after = lambda c: F.min_by(c, known(c, F.col(SEQ) > F.col("_from")))
    earlier = F.min(SEQ) < F.min("_from")
    fixed = rows.groupBy(SID).agg(F.lit(True).alias("_late"), *[
        F.when(earlier, F.coalesce(before(c), after(c))).otherwise(F.min_by(c, known(c))).alias(f"_late_{c}") for c in fills
    ])
    return one.join(fixed, SID, "left").select(
        *[F.col(f"`{c}`") for c in one.columns if not c.startswith("_fill_")],
        *[F.when(F.col("_late"), F.col(f"_late_{c}")).otherwise(F.col(f"_fill_{c}")).alias(f"_fill_{c}") for c in fills],
    )


# ---------------------------------------------------------------------------
# Sets of ids over files
# ---------------------------------------------------------------------------


def common_sids(df: DataFrame, file_col: str) -> DataFrame:
    """Ids present in every one of at least two files."""
    files = df.select(file_col).distinct().count()
    if files < 2:
        return df.select(SID).limit(0)
    pairs = df.select(strip(pystr(SID)).alias(SID), file_col).distinct()
    return pairs.groupBy(SID).agg(F.count("*").alias("n")).filter(F.col("n") == files).select(SID)


# ---------------------------------------------------------------------------
# Search and paging
# ---------------------------------------------------------------------------


def search(df: DataFrame, term: str, cols: list[str]) -> DataFrame:
    """Rows where any column contains the term, ignoring case."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.contains(F.lower(pystr(c)), F.lit(term.lower()))
    return df.filter(hit)


def filter_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(column).isin(*values)) if values else df


def number_rows(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers under a total order without one global sort task.

    Rows are range-partitioned and written once; each partition numbers its own
    rows and adds the sizes of the partitions before it.
    """
    ranged = materialize(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(inside))
        .join(offsets, "_part")
        .select(*df.columns, (F.col("_row") + F.col("_ahead") - 1 + start).alias(name))
    )


def page(df: DataFrame, number: int, size: int, order: list) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows under a total order; deep pages cost what the first one does."""
    numbered = number_rows(df, [F.col(c) if isinstance(c, str) else c for c in order], "_number")
    first = number * size
    return numbered.filter(F.col("_number").between(first, first + size - 1)).orderBy("_number").drop("_number")
