"""SQL text the registered queries are compared with (DuckDB dialect)."""

from __future__ import annotations

from shelfcheck_queries import rules as R
from shelfcheck.constants import (
    COLOR_MODIFIERS,
    EMPTY_COLORS,
    EMPTY_WARRANTY,
    JUNK_COLORS,
    NOISE_WORDS,
    PLACEHOLDER_BRANDS,
    POWERBANK_CATEGORY_REASON,
    POWERBANK_CATEGORY_TEXT,
    POWERBANK_FAKE_REASON,
    POWERBANK_FAKE_TEXT,
    PSEUDO_BRANDS,
    QUANTITY_PATTERN,
    priority_of,
)
from shelfcheck.sources.flags import flag_rows


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({names})"


def esc(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-#&/ " and ch != " " else ch for ch in word)


def alternatives(words) -> str:
    return "|".join(esc(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def raw(description: bool = False) -> str:
    return f"""
raw AS (
SELECT
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS _seq,
  'P' || l_partkey || '-' || l_suppkey AS sid,
  'M' || l_partkey AS PARENTSKU,
  CASE WHEN p_partkey % 17 = 0 THEN p_name
       ELSE p_name || ' ' || lower(p_type)
         || CASE p_size % 5 WHEN 0 THEN ' ' || p_size || 'kg'
                            WHEN 1 THEN ' ' || (p_size * 4) || 'gb'
                            WHEN 2 THEN ' tester'
                            WHEN 3 THEN ' best price BUY NOW'
                            ELSE '' END
         || CASE WHEN p_partkey % 13 = 0 THEN ' ' || p_brand ELSE '' END
  END AS NAME,
  CASE WHEN p_partkey % 7 = 0 THEN 'Generic' WHEN p_partkey % 11 = 0 THEN 'Fashion' ELSE p_brand END AS BRAND,
  p_type || ' > ' || split_part(p_name, ' ', 2) || ' > ' || split_part(p_name, ' ', 1) AS CATEGORY,
  CAST(1000000
       + instr('ECONOMY,LARGE,MEDIUM,PROMO,SMALL,STANDARD', p_type) * 10000
       + instr('anvil,bolt,gear,gizmo,plate,ring,rod,widget', split_part(p_name, ' ', 2)) * 100
       + instr('blue,cold,hot,large,new,old,red,small', split_part(p_name, ' ', 1)) AS VARCHAR)
    || CASE WHEN l_linenumber % 2 = 0 THEN '.0' ELSE '' END AS CATEGORY_CODE,
  s_name AS SELLER_NAME,
  CASE WHEN l_linenumber % 3 = 0 THEN 'shop-' ELSE '' END
    || CASE s_nationkey % 6 WHEN 0 THEN 'ke' WHEN 1 THEN 'UG' WHEN 2 THEN 'NG'
                            WHEN 3 THEN 'GH' WHEN 4 THEN 'MA' ELSE 'Multiple' END AS ACTIVE_STATUS_COUNTRY,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE p_retailprice END AS price,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice * (1 - l_discount) / l_quantity END AS sale,
  CASE l_returnflag WHEN 'R' THEN 'Red' WHEN 'A' THEN 'n/a' ELSE NULL END AS COLOR,
  CASE WHEN l_linenumber = 1 THEN 'Blue' ELSE NULL END AS COLOR_FAMILY,
  CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE NULL END AS PRODUCT_WARRANTY,
  CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 1 THEN '12 months' ELSE NULL END AS WARRANTY_DURATION,
  CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE NULL END AS COUNT_VARIATIONS,
  'http://img.example.org/' || (l_partkey % 100) || '.png' AS MAIN_IMAGE,
  l_partkey AS partkey
  {", d.text AS DESCRIPTION" if description else ""}
FROM lineitem
JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey
{"LEFT JOIN documents d ON d.doc_id = l_partkey" if description else ""}
)"""


FILLS = ["COLOR_FAMILY", "PRODUCT_WARRANTY", "WARRANTY_DURATION", "COUNT_VARIATIONS"]
FILLED = f"""
filled AS (
SELECT * REPLACE ({", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER before, first_value({c} IGNORE NULLS) OVER after) AS {c}"
    for c in FILLS)},
  regexp_replace(upper(trim(ACTIVE_STATUS_COUNTRY)), '^[A-Z]+-', '') AS ACTIVE_STATUS_COUNTRY)
FROM raw
WINDOW before AS (PARTITION BY sid ORDER BY _seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       after AS (PARTITION BY sid ORDER BY _seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)"""


def prepared(country: str | None = None, description: bool = False) -> str:
    """CTE chain raw -> filled -> p (one row per product)."""
    scope = {
        None: "TRUE",
        "NG": "ACTIVE_STATUS_COUNTRY IN ('NG', 'MULTIPLE', 'MULTI')",
    }.get(country, f"ACTIVE_STATUS_COUNTRY = '{country}'")
    multi = "ACTIVE_STATUS_COUNTRY IN ('MULTIPLE', 'MULTI')" if country == "NG" else "FALSE"
    return f"""{raw(description)}, {FILLED},
p AS (
SELECT * REPLACE (CAST(greatest(n_rows, coalesce(TRY_CAST(COUNT_VARIATIONS AS DOUBLE), 1)) AS BIGINT) AS COUNT_VARIATIONS),
  lower(NAME) AS name_l, trim(lower(BRAND)) AS brand_l, trim(lower(SELLER_NAME)) AS seller_l,
  split_part(trim(CATEGORY_CODE), '.', 1) AS cat, {multi} AS is_multi
FROM (
  SELECT *, count(*) OVER (PARTITION BY sid) AS n_rows, row_number() OVER (PARTITION BY sid ORDER BY _seq) AS rn
  FROM filled WHERE {scope}
) WHERE rn = 1
)"""


CATEGORY = f"""
cat AS (
SELECT CAST(1000000
       + instr('ECONOMY,LARGE,MEDIUM,PROMO,SMALL,STANDARD', p_type) * 10000
       + instr('anvil,bolt,gear,gizmo,plate,ring,rod,widget', split_part(p_name, ' ', 2)) * 100
       + instr('blue,cold,hot,large,new,old,red,small', split_part(p_name, ' ', 1)) AS VARCHAR) AS code,
  min(p_type || ' > ' || split_part(p_name, ' ', 2) || ' > ' || split_part(p_name, ' ', 1)) AS path
FROM part GROUP BY 1
),
category AS (SELECT code, path, CAST(code AS BIGINT) AS seq FROM cat UNION ALL SELECT * FROM {values(R.PARENTS, "code, path, seq")})"""


def in_codes(name: str) -> str:
    cond = {**R.CODE_LISTS, **R.PROGRAM_CODES}[name]
    return f"cat IN (SELECT code FROM cat WHERE {cond})"


def seller_ok(program: str) -> str:
    return f"seller_l IN (SELECT lower(s_name) FROM supplier WHERE {R.SELLERS[program]})"


def word(words, flags: str = "(?i)") -> str:
    return f"{flags}\\b({alternatives(words)})\\b"


def bounded(words) -> str:
    return f"(?i)(?:^|[^\\w])({alternatives(words)})(?:$|[^\\w])"


def money(expr: str, rate: float, symbol: str) -> str:
    return f"'USD ' || format('{{:,.2f}}', {expr}) || ' / {symbol}' || format('{{:,.0f}}', {expr} * {rate})"


def squash(expr: str) -> str:
    noise = "|".join(NOISE_WORDS)
    return f"regexp_replace(regexp_replace({expr}, '\\b({noise})\\b', '', 'g'), '[^\\w\\s]|\\s+', '', 'g')"


RATES = {"KE": (129.0, "KSh"), "NG": (1550.0, "₦"), "MA": (10.0, "MAD"), "UG": (3700.0, "USh")}


def check_sql(country: str) -> dict[str, str]:
    """flag -> SELECT sid, detail, reason FROM p ..., every check over the CTEs p, cat, category."""
    rate, symbol = RATES[country]
    pct = "format('{:,.1f}', (1.0 - sale / price) * 100)"
    none = "CAST(NULL AS VARCHAR)"

    def simple(cond: str, detail: str = none, reason: str = none) -> str:
        return f"SELECT sid, {detail} AS detail, {reason} AS reason FROM p WHERE {cond}"

    unnecessary = word(R.WORDS["unnecessary"])
    refurb = word(R.KEYWORDS["refurb"])
    perfume = word(R.KEYWORDS["perfume"])
    jersey = word(R.KEYWORDS["jersey"])
    colors = word(R.WORDS["colors"])
    plain = [c for c in R.WORDS["colors"] if c not in COLOR_MODIFIERS]
    name = "NAME"
    w, n = "len(regexp_split_to_array(trim(NAME), '\\s+'))", "length(trim(NAME))"
    color = "lower(trim(coalesce(COLOR, 'nan')))"
    mah = r"(?i)\b(\d[\d,]*)\s*mah\b"
    out = {
        "Suspected Fake product": """
SELECT sid, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS VARCHAR) AS reason FROM p
JOIN (SELECT lower(p_brand) AS b, CAST(1000000
       + instr('ECONOMY,LARGE,MEDIUM,PROMO,SMALL,STANDARD', p_type) * 10000
       + instr('anvil,bolt,gear,gizmo,plate,ring,rod,widget', split_part(p_name, ' ', 2)) * 100
       + instr('blue,cold,hot,large,new,old,red,small', split_part(p_name, ' ', 1)) AS VARCHAR) AS c,
      max(p_retailprice) AS min_price FROM part WHERE p_partkey % 5 = 0 GROUP BY 1, 2) f
  ON brand_l = b AND cat = c
WHERE coalesce(CASE WHEN sale > 0 THEN sale ELSE price END, 0) < min_price""",
        "Seller Not approved to sell Refurb": simple(
            f"""(({in_codes('refurb_phones')} AND NOT {seller_ok('refurb_phones')})
              OR ({in_codes('refurb_laptops')} AND NOT {seller_ok('refurb_laptops')}))
              AND regexp_matches(NAME, '{refurb}')""",
            f"""'Unapproved ' || CASE WHEN {in_codes('refurb_phones')} THEN 'Phone' ELSE 'Laptop' END
              || ' refurb seller — keyword ''' || regexp_extract(NAME, '{refurb}', 0) || ''' in name (cat: ' || cat || ')'""",
        ),
        "Product Warranty": simple(
            f"""{in_codes('warranty')} AND trim(coalesce(PRODUCT_WARRANTY, 'nan')) IN {inlist(EMPTY_WARRANTY)}
              AND trim(coalesce(WARRANTY_DURATION, 'nan')) IN {inlist(EMPTY_WARRANTY)}"""
        ),
        "Seller Approve to sell books": simple(
            f"{in_codes('books')} AND NOT {seller_ok('books')}",
            "'Seller not approved to sell books: ' || SELLER_NAME",
        ),
        "Seller Approved to Sell Perfume": simple(
            f"""{in_codes('perfume')} AND NOT {seller_ok('perfume')}
              AND ((brand_l IN {inlist(PLACEHOLDER_BRANDS)} AND regexp_matches(name_l, '{perfume}'))
                   OR regexp_matches(brand_l, '{perfume}'))""",
            f"""CASE WHEN lower(trim(BRAND)) IN {inlist(PLACEHOLDER_BRANDS)}
                THEN 'Sneaky brand in name: ''' || substr(trim(NAME), 1, 40) || ''''
                ELSE 'Sensitive brand ''' || trim(BRAND) || ''' — seller not approved' END""",
        ),
        "Perfume Tester": simple(
            f"{in_codes('perfume')} AND regexp_matches(name_l, '\\btester\\b')",
            "'Perfume tester listed for sale: ' || substr(NAME, 1, 60)",
        ),
        "Counterfeit Sneakers": simple(
            f"{in_codes('sneakers')} AND brand_l IN ('generic', 'fashion') AND ("
            + " OR ".join(f"contains(name_l, {lit(b)})" for b in R.WORDS["sneaker_brands"]) + ")"
        ),
        "Suspected counterfeit Jerseys": simple(
            f"{in_codes('jersey')} AND NOT {seller_ok('jersey_exempt')} AND regexp_matches(NAME, '{jersey}')",
            f"'Suspected counterfeit jersey — keyword ''' || regexp_extract(NAME, '{jersey}', 0) || ''' (cat: ' || cat || ')'",
        ),
        "Unnecessary words in NAME": simple(
            f"regexp_matches(name_l, '{unnecessary}')",
            f"""'Unnecessary: ' || array_to_string(list_sort(list_distinct(
              list_transform(regexp_extract_all(NAME, '{unnecessary}', 1), lambda m: lower(m)))), ', ')""",
        ),
        "Single-word NAME": simple(
            f"NOT {in_codes('books')} AND ({w} <= 2 OR {n} < 15)",
            f"""CASE WHEN {w} <= 2 AND {n} < 15 THEN {w} || ' words, ' || {n} || ' chars'
                WHEN {w} <= 2 THEN {w} || ' words' ELSE {n} || ' chars' END""",
        ),
        "Generic BRAND Issues": simple(f"{in_codes('fashion')} AND brand_l = 'generic'"),
        "Fashion brand issues": simple(
            """brand_l = 'fashion' AND NOT CASE
              WHEN coalesce((SELECT c.path FROM category c WHERE c.code = p.cat), '') <> ''
              THEN starts_with(lower(trim((SELECT c.path FROM category c WHERE c.code = p.cat))), 'fashion')
              ELSE """ + in_codes("fashion") + " END",
            "'Brand ''Fashion'' used outside Fashion category: ' || CATEGORY_CODE",
        ),
        "BRAND name repeated in NAME": simple("brand_l NOT IN ('', 'nan') AND contains(name_l, brand_l)"),
        "Wrong Variation": simple(
            f"COUNT_VARIATIONS >= 3 AND NOT ({in_codes('variation')} OR {in_codes('fashion')})",
            "'Variations: ' || COUNT_VARIATIONS || ', Category: ' || cat",
        ),
        "Generic branded products with genuine brands": f"""
SELECT sid, 'Brand field ''' || upper(substr(brand_l, 1, 1)) || substr(brand_l, 2) || ''' but name starts with: ' || title AS detail,
  {none} AS reason
FROM (
  SELECT p.sid, brand_l, v.title, row_number() OVER (PARTITION BY p.sid ORDER BY length(v.b) DESC, v.b) AS rn
  FROM (SELECT *, trim(regexp_replace(regexp_replace(name_l, '[''.\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS nc FROM p) p
  JOIN {values([(b, b.replace("-", " "), b.title()) for b in R.WORDS["known_brands"]], "b, bc, title")}
    ON starts_with(nc, bc) AND NOT regexp_matches(substr(nc, length(bc) + 1, 1), '^[a-z0-9]')
  WHERE brand_l IN {inlist(PSEUDO_BRANDS)} AND NOT regexp_matches(lower(CATEGORY), '\\b(case|cases|cover|covers)\\b')
) WHERE rn = 1""",
        "Missing COLOR": simple(
            f"""{in_codes('color')} AND NOT regexp_matches(NAME, '{colors}')
              AND NOT (NOT {color} IN {inlist(EMPTY_COLORS)} AND NOT {color} IN {inlist(JUNK_COLORS)}
                AND NOT regexp_matches({color}, '^[.\\-_*]{{1,5}}$')
                AND len(list_filter(regexp_split_to_array({color}, '[,/&|\\-]|\\s+and\\s+|\\s+or\\s+|\\s+with\\s+'),
                  lambda x: trim(x) IN {inlist(R.WORDS['colors'])}
                    OR len(list_filter(regexp_split_to_array(trim(x), '\\s+'), lambda t: t IN {inlist(plain)})) > 0)) > 0)""",
            f"""CASE WHEN NOT {color} IN {inlist(EMPTY_COLORS)}
                THEN 'Invalid color value provided: ''' || trim(COLOR) || ''''
                ELSE 'Color missing in both NAME and COLOR attributes' END""",
        ),
        "Missing Weight/Volume": simple(
            f"{in_codes('weight')} AND NOT regexp_matches(name_l, {lit('(?i)' + QUANTITY_PATTERN)})"
        ),
        "Incomplete Smartphone Name": simple(
            f"{in_codes('smartphones')} AND NOT regexp_matches(name_l, '\\b\\d+\\s*(gb|tb)\\b')",
            "'Name missing Storage/Memory spec (e.g., 64GB)'",
        ),
        "Duplicate product": f"""
SELECT sid, 'Duplicate: ''' || substr(first_name, 1, 40) || '''' AS detail, {none} AS reason
FROM (
  SELECT sid, _seq, row_number() OVER k AS rn, first_value(NAME) OVER k AS first_name
  FROM (
    SELECT *, seller_l || '|' || brand_l || '|' || {squash('name_l')} || '|' ||
      CASE WHEN regexp_matches(name_l, '{colors}') THEN ''
           WHEN lower(trim(coalesce(COLOR, 'nan'))) NOT IN ('nan', 'none', '', 'n/a') THEN lower(trim(COLOR))
           WHEN lower(trim(coalesce(COLOR_FAMILY, 'nan'))) NOT IN ('nan', 'none', '', 'n/a') THEN lower(trim(COLOR_FAMILY))
           ELSE '' END AS dedup
    FROM p WHERE NOT {in_codes('duplicate_exempt')}
  ) WINDOW k AS (PARTITION BY dedup ORDER BY _seq)
) WHERE rn > 1""",
        "Discount too high": simple(
            "price > 0 AND sale > 0 AND 1.0 - sale / price > 0.51",
            f"""'Discount too high: ' || {pct} || '% (Price: ' || {money('price', rate, symbol)} || ' → Sale: '
              || {money('sale', rate, symbol)} || ')'""",
        ),
        "Suspicious Discount": simple(
            "price > 0 AND sale > 0 AND sale < price AND 1.0 - sale / price > 0.50 AND 1.0 - sale / price <= 0.95",
            f"""'Suspicious discount of ' || {pct} || '% (Regular: ' || {money('price', rate, symbol)} || ' → Sale: '
              || {money('sale', rate, symbol)} || ')'""",
        ),
        "Restricted brands": restricted_sql(),
        "Prohibited products": prohibited_sql(),
        "Category Max Price Exceeded": max_price_sql(country),
    }
    powerbank = simple(
        f"""(regexp_matches({name}, '(?i)\\bpower\\s*bank\\b') AND NOT {in_codes('powerbank')})
          OR ({in_codes('powerbank')} AND brand_l NOT IN {inlist(R.POWERBANK_BRANDS)} AND len(list_filter(
              regexp_extract_all({name}, '{mah}', 1), lambda v: TRY_CAST(replace(v, ',', '') AS HUGEINT) >= 20000)) > 0)""",
        f"""CASE WHEN regexp_matches({name}, '(?i)\\bpower\\s*bank\\b') AND NOT {in_codes('powerbank')}
            THEN {lit(POWERBANK_CATEGORY_TEXT)}
            ELSE 'Brand ''' || BRAND || ''' not approved for ' || regexp_extract({name}, '{mah}', 0)
              || {lit(POWERBANK_FAKE_TEXT.replace("{market}", R.MARKET))} END""",
        f"""CASE WHEN regexp_matches({name}, '(?i)\\bpower\\s*bank\\b') AND NOT {in_codes('powerbank')}
            THEN {lit(POWERBANK_CATEGORY_REASON)}
            ELSE {lit(POWERBANK_FAKE_REASON.replace("{market}", R.MARKET))} END""",
    )
    if country in ("KE", "UG", "NG"):
        out["Powerbank Not Authorized"] = powerbank
    if country == "NG":
        xmas = word(R.KEYWORDS["ng_xmas"])
        out |= {
            "NG - Gift Card Seller": simple(
                f"{in_codes('ng_gift_card')} AND NOT {seller_ok('ng_gift_card')}",
                "'Seller not authorised for Gift Card categories: ' || SELLER_NAME",
            ),
            "NG - HP Toners Seller": simple(
                f"{in_codes('ng_hp_toner')} AND brand_l = 'hp' AND NOT {seller_ok('ng_hp_toner')}",
                "'Seller not authorised for HP Ink/Toners: ' || SELLER_NAME",
            ),
            "NG - Apple Seller": simple(
                f"brand_l = 'apple' AND NOT {seller_ok('ng_apple')}",
                "'Seller not authorised to sell Apple products: ' || SELLER_NAME",
            ),
            "NG - Xmas Tree Seller": simple(
                f"regexp_matches(NAME, '{xmas}') AND NOT {seller_ok('ng_xmas')}",
                f"""'Seller not authorised for Xmas Tree products (keyword ''' || regexp_extract(NAME, '{xmas}', 0)
                  || '''): ' || SELLER_NAME""",
            ),
            "NG - TV Brand Seller": simple(
                f"""{in_codes('ng_tv')} AND brand_l IN {inlist({b for b, _ in R.NG_TV})}
                  AND (brand_l, seller_l) NOT IN (SELECT b, s FROM {values(R.NG_TV, "b, s")})""",
                "'Seller not authorised for ' || upper(brand_l) || ' TVs: ' || SELLER_NAME",
            ),
            "NG - Rice Brand Seller": f"""
SELECT sid, 'Seller not authorised to sell ' || upper(substr(brand_l, 1, 1)) || substr(brand_l, 2) || ' rice: '
  || SELLER_NAME AS detail, {none} AS reason
FROM p JOIN {values(R.NG_RICE, "b, sellers, cats")} ON brand_l = b
WHERE NOT list_contains(sellers, seller_l) AND (len(cats) = 0 OR list_contains(cats, cat))""",
            "NG - Books Seller": f"""
SELECT sid, CASE WHEN seller IS NULL THEN 'No seller authorised for book: ''' || substr(title, 1, 60) || ''''
    ELSE 'Only ''' || seller || ''' may sell ''' || substr(title, 1, 40) || '''' END AS detail, {none} AS reason
FROM (SELECT p.sid, seller_l, title, seller, row_number() OVER (PARTITION BY p.sid ORDER BY seq) AS rn
      FROM p JOIN {values(R.NG_BOOKS, "seq, title, seller")} ON contains(name_l, title))
WHERE rn = 1 AND (seller IS NULL OR seller <> seller_l)""",
        }
    if country == "MA":
        prohibited = bounded(R.MA_BRANDS)
        out["MA - Marque Interdite"] = simple(
            f"brand_l IN {inlist(R.MA_BRANDS)} OR regexp_matches(name_l, '{prohibited}')",
            f"""CASE WHEN brand_l IN {inlist(R.MA_BRANDS)} THEN 'Marque interdite : ' || BRAND
                ELSE 'Marque interdite détectée dans le nom : ' || array_to_string(list_transform(
                  string_split(regexp_extract(name_l, '{prohibited}', 1), ' '),
                  lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') END""",
        )
    return out


def hit(text: str, word_expr: str) -> str:
    # the pattern differs from row to row, so it is built only where the word occurs at all
    return f"CASE WHEN contains({text}, {word_expr}) THEN regexp_matches({text}, '(?:^|[^\\w])' || {word_expr} || '(?:$|[^\\w])') ELSE FALSE END"


def prohibited_sql() -> str:
    """Keywords in rule order; a keyword already contained in the text is not repeated."""
    step = "CASE WHEN contains(acc, x) THEN acc ELSE acc || ' ' || x || ',' END"
    return f"""
SELECT sid, rtrim(list_reduce(list_prepend('Prohibited:', kws), lambda acc, x: {step}), ',') AS detail,
  CAST(NULL AS VARCHAR) AS reason
FROM (
  SELECT sid, list(kw ORDER BY seq) AS kws
  FROM p JOIN {values(R.PROHIBITED, "seq, kw, cats")}
    ON {hit('name_l', 'kw')} AND (len(cats) = 0 OR list_contains(cats, cat))
  GROUP BY sid)"""


def restricted_sql() -> str:
    return f"""
SELECT sid, 'Restricted Brand: ' || coalesce(main_info, var_info) || ' - ' || status AS detail, CAST(NULL AS VARCHAR) AS reason
FROM (
  SELECT l.sid, any_value(l.status) AS status,
    max_by(m.info, m.seq) FILTER (WHERE m.main) AS main_info, min_by(m.info, m.seq) FILTER (WHERE NOT m.main) AS var_info
  FROM (SELECT sid, max(seq) AS seq, max_by(status, seq) AS status FROM restricted WHERE rejects GROUP BY sid) l
  JOIN restricted m ON m.sid = l.sid AND m.seq <= l.seq
  GROUP BY l.sid)"""


RESTRICTED = f"""
restricted AS (
SELECT sid, seq, main, CASE WHEN main THEN brand_raw ELSE brand_raw || ' (as ''' || var || ''')' END AS info,
  (len(cats) = 0 OR list_contains(cats, cat)) AND NOT list_contains(sellers, seller_l) AS rejects,
  CASE WHEN len(sellers) > 0 THEN 'Seller not in approved list' ELSE 'No sellers approved' END AS status
FROM (
  SELECT p.sid, p.cat, p.seller_l, v.*,
    (brand_l = v.brand OR {hit('name_l', 'v.brand')}) AS main,
    len(list_filter(vars, lambda x: {hit('brand_l', 'x')})) > 0 AS in_brand,
    len(list_filter(vars, lambda x: {hit('name_l', 'x')})) > 0 AS in_name,
    list_filter(vars, lambda x: contains(CASE WHEN len(list_filter(vars, lambda y: {hit('brand_l', 'y')})) > 0 THEN brand_l ELSE name_l END, x))[1] AS var
  FROM p CROSS JOIN {values([(*r[:5], sorted(r[5], key=lambda x: (-len(x), x))) for r in R.RESTRICTED],
                            "seq, brand, brand_raw, sellers, cats, vars")}
) WHERE main OR in_brand OR in_name
)"""


def max_price_sql(country: str) -> str:
    rate, symbol = RATES[country]
    caps = ", ".join(f"('{code}', {cap})" for c, code, cap in R.PARENT_CAPS if c == country)
    own = "SELECT code, 140000.0 AS cap FROM cat WHERE CAST(code AS BIGINT) % 3 = 0" if country == "KE" else (
        "SELECT '' AS code, 0.0 AS cap WHERE FALSE")
    extra = f"UNION ALL SELECT * FROM (VALUES {caps}) AS v(code, cap)" if caps else ""
    level1 = values(R.LEVEL1, "level1, usd")
    return f"""
SELECT sid, 'Price (USD ' || format('{{:,.2f}}', usd) || ' → {symbol}' || format('{{:,.0f}}', listed)
  || ') exceeds category max ({symbol}' || format('{{:,.0f}}', cap) || ') [' || source || ']' AS detail,
  CAST(NULL AS VARCHAR) AS reason
FROM (
  SELECT p.sid, greatest(coalesce(price, 0), coalesce(sale, 0)) AS usd,
    greatest(coalesce(price, 0) * {rate}, coalesce(sale, 0) * {rate}) AS listed, c.cap, c.source
  FROM p JOIN (
    SELECT code, arg_min(cap, k) AS cap, arg_min(source, k) AS source FROM (
      WITH caps AS ({own} {extra})
      SELECT code, 0 AS k, cap, 'exact code ' || code AS source FROM caps
      UNION ALL
      SELECT c.code, 100 - len(string_split(a.path, ' > ')), caps.cap, 'ancestor ''' || a.path || ''''
      FROM category c JOIN category a ON starts_with(c.path, a.path || ' > ') JOIN caps ON caps.code = a.code
      UNION ALL
      SELECT code, 1000, usd * {rate}, 'USD fallback for ''' || level1 || ''' ($' || format('{{:,.0f}}', usd) || ' × {rate} rate)'
      FROM category JOIN {level1} ON level1 = split_part(path, ' > ', 1)
    ) GROUP BY code
  ) c ON c.code = p.cat
) WHERE listed > 0 AND listed > cap"""


def single_check(flag: str, country: str = "KE", scope: str | None = None) -> str:
    """One check over the whole catalog (or one country's part of it)."""
    body = check_sql(country)[flag]
    extra = f", {RESTRICTED}" if flag == "Restricted brands" else ""
    return f"""WITH {prepared(scope)}, {CATEGORY}{extra}
SELECT sid, {lit(flag)} AS flag, detail, reason FROM ({body})"""


def many_checks(flags: list[str], country: str, scope: str | None = None, names: str = "") -> str:
    checks = check_sql(country)
    union = " UNION ALL ".join(f"SELECT sid, {lit(f)} AS flag, detail, reason FROM ({checks[f]})" for f in flags)
    return f"WITH {prepared(scope)}{names}, {CATEGORY} {union}"


def hits_cte(country: str, skip: tuple = ()) -> str:
    checks = {f: s for f, s in check_sql(country).items() if f not in skip}
    union = " UNION ALL ".join(f"SELECT sid, {lit(f)} AS flag, detail, reason FROM ({s})" for f, s in checks.items())
    return f"{RESTRICTED}, hits AS ({union})"


def report_ctes(country: str, skip: tuple = (), where: str = "TRUE") -> str:
    """CTE chain up to ``report`` with the columns of the final report."""
    ranks = [(f, i) for i, f in enumerate(priority_of(country))]
    lang = 3 if country == "MA" else 2
    flags = [(r[0], r[1], r[lang]) for r in flag_rows(R.MARKET)]
    match_flags = ("Seller Approve to sell books", "Seller Approved to Sell Perfume", "Counterfeit Sneakers",
                   "Seller Not approved to sell Refurb", "Restricted brands")
    key = "|| '|' ||".join(squash(f"trim(lower(coalesce({c}, '')))") for c in ("BRAND", "NAME", "COLOR"))
    same = "|| chr(1) ||".join(f"lower(trim(coalesce({c}, 'nan')))" for c in ("NAME", "BRAND", "SELLER_NAME", "COLOR"))
    scope = "" if where == "TRUE" else f", p_all AS (SELECT * FROM p0 WHERE {where})"
    prep = prepared(country)
    if scope:
        prep = prep.replace("\np AS (", "\np0 AS (") + f", p AS (SELECT * FROM p0 WHERE {where})"
    # read by several parts below, so made once
    prep = prep.replace("\np AS (", "\np AS MATERIALIZED (").replace(", p AS (SELECT * FROM p0", ", p AS MATERIALIZED (SELECT * FROM p0")
    hits = hits_cte(country, skip).replace(", hits AS (", ", hits AS MATERIALIZED (")
    return f"""WITH {prep}, {CATEGORY}, {hits},
keyed AS MATERIALIZED (SELECT sid, {same} AS dup_key, {key} AS match_key FROM p),
spread AS (
  SELECT DISTINCT k.sid, h.flag FROM (SELECT DISTINCT flag, dup_key FROM hits JOIN keyed USING (sid)) h JOIN keyed k USING (dup_key)
  UNION
  SELECT DISTINCT k.sid, h.flag FROM (SELECT DISTINCT flag, match_key FROM hits JOIN keyed USING (sid)
    WHERE flag IN {inlist(match_flags)}) h JOIN keyed k USING (match_key)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY rank, copy) AS rn FROM (
    SELECT sid, a.flag, detail, reason, copy, v.rank FROM (
      SELECT sid, flag, detail, reason, 0 AS copy FROM hits
      UNION ALL SELECT sid, flag, NULL, NULL, 1 FROM spread
    ) a JOIN {values(ranks, "flag, rank")} ON a.flag = v.flag)
),
report AS (
SELECT p.sid AS ProductSetSid, p.PARENTSKU AS ParentSKU,
  CASE WHEN r.flag IS NULL THEN 'Approved' ELSE 'Rejected' END AS Status,
  CASE WHEN r.flag IS NULL THEN '' ELSE coalesce(r.reason, f.reason, '1000007 - Other Reason') END AS Reason,
  CASE WHEN r.flag IS NULL THEN ''
       WHEN r.reason = {lit(POWERBANK_CATEGORY_REASON)} THEN r.detail
       WHEN coalesce(r.detail, '') = '' THEN coalesce(f.base, 'Flagged by ' || r.flag)
       WHEN length(r.detail) > 60 THEN r.detail
       ELSE coalesce(f.base, 'Flagged by ' || r.flag) || ' (' || r.detail || ')' END AS Comment,
  CASE WHEN r.reason = {lit(POWERBANK_CATEGORY_REASON)} THEN 'Wrong Category' ELSE coalesce(r.flag, '') END AS FLAG,
  p.SELLER_NAME AS SellerName, FALSE AS CV_Detected
FROM p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON r.sid = p.sid
LEFT JOIN {values(flags, "flag, reason, base").replace(" AS v(", " AS f(")} ON f.flag = r.flag
)"""
