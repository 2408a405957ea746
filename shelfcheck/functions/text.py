"""Column expressions over text.  Everything here stays inside the JVM."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcheck.constants import ARTIFACTS, CONTROL_CHARS, NOISE_WORDS

# Characters that count as white space when a value is trimmed.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)

# The 27 printable characters that code page 1252 puts on bytes 0x80-0x9F.
CP1252_SYMBOLS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "".join(
    chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
)

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def pystr(c: Column | str) -> Column:
    """Text of a value; a missing value reads 'nan'."""
    return F.coalesce(col(c).cast("string"), F.lit("nan"))


def num(c: Column | str) -> Column:
    """Number in a text value, NULL when the text is not a number."""
    text = strip(col(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def blank(c: Column | str, empties: Iterable[str] = ("nan", "None")) -> Column:
    """Trimmed text with missing-value words mapped to ''."""
    text = F.coalesce(strip(col(c).cast("string")), F.lit(""))
    return F.when(text.isin(*empties), F.lit("")).otherwise(text)


def filled(c: Column | str, empties: Iterable[str] = ("nan", "None", "NaN")) -> Column:
    """NULL for a blank value, else the trimmed text."""
    return F.nullif(blank(c, empties), F.lit(""))


# ---------------------------------------------------------------------------
# Patterns
# ---------------------------------------------------------------------------

_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}\-#&\s/])")


def quote(text: str) -> str:
    """Escape literal text for a Java pattern."""
    return _SPECIAL.sub(lambda m: "\\" + m.group(1), text)


def any_of(words: Iterable[str]) -> str:
    """One pattern matching any word, longest first at each position.

    Common prefixes are shared, so a thousand words cost a handful of
    comparisons per position instead of a thousand.
    """
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        branches = [quote(ch) + emit(node[ch]) for ch in sorted(node) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "|".join(branches)
        if "" in node:
            return f"(?:{body})?"
        return body if len(branches) == 1 else f"(?:{body})"

    return emit(root)


def word_pattern(words: Iterable[str]) -> str | None:
    """Whole-word, case-insensitive pattern; None for an empty list."""
    words = [w for w in words if w]
    return rf"(?iU)\b({any_of(words)})\b" if words else None


def bounded_pattern(words: Iterable[str]) -> str | None:
    """Like ``word_pattern`` but only forbids word characters next to a match."""
    words = [w for w in words if w]
    return rf"(?iU)(?<!\w)({any_of(words)})(?!\w)" if words else None


def bounded(c: Column) -> Column:
    """Column form of ``bounded_pattern`` for one literal held in a column."""
    literal = F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?iU)(?<!\\w)\\Q"), literal, F.lit("\\E(?!\\w)"))


def occurs(text: Column, literal: Column) -> Column:
    """Does lower-case text match ``bounded`` of a literal?  In plain ASCII the pattern, which each row compiles
    anew, is tried only where the text contains the literal at all."""
    plain = (F.octet_length(text) == F.length(text)) & (F.octet_length(literal) == F.length(literal))
    return (~plain | F.contains(text, F.lower(literal))) & F.rlike(text, bounded(literal))


def words_of(c: Column | str) -> Column:
    """Distinct runs of word characters, plus '' so that word-less rules can attach."""
    return F.array_union(
        F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"(?U)(\w+)"), F.lit(1))),
        F.array(F.lit("")),
    )


def anchor(c: Column | str) -> Column:
    """First run of word characters of a keyword ('' when there is none)."""
    return F.regexp_extract(col(c), r"(?U)(\w+)", 1)


def highlight(c: Column | str, pattern: str, mark: str) -> Column:
    return F.regexp_replace(col(c), pattern, f"{quote(mark)}$0{quote(mark)}")


# ---------------------------------------------------------------------------
# Cleaning
# ---------------------------------------------------------------------------


def clean_category_code(c: Column | str) -> Column:
    return F.coalesce(F.substring_index(strip(col(c).cast("string")), ".", 1), F.lit(""))


def squash(c: Column) -> Column:
    """Drop noise words, punctuation and white space."""
    text = F.regexp_replace(c, rf"(?U)\b({'|'.join(NOISE_WORDS)})\b", "")
    return F.regexp_replace(text, r"(?U)[^\w\s]|\s+", "")


def normalize_text(c: Column | str) -> Column:
    return F.coalesce(squash(strip(F.lower(col(c).cast("string")))), F.lit(""))


def match_key(brand: Column | str, name: Column | str, color: Column | str) -> Column:
    return F.concat_ws("|", normalize_text(brand), normalize_text(name), normalize_text(color))


def repair_mojibake(c: Column | str) -> Column:
    """Undo one wrong cp1252/latin-1 decoding of UTF-8 text, then drop control characters."""
    c = col(c)

    def attempt(text: Column) -> Column:
        raw = F.encode(text, "ISO-8859-1")
        return F.when(
            text.rlike(r"^[\x00-\xFF]*$") & text.rlike(r"[\x80-\xFF]"),
            F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")),
        )

    # A raw C1 control character has no cp1252 byte, except for the five unused ones.
    cp1252 = F.when(
        ~c.rlike(r"[\x80-\x9F]"), attempt(F.translate(c, CP1252_SYMBOLS, CP1252_BYTES))
    )
    latin1 = attempt(c)
    good = lambda x: F.when(~F.contains(x, F.lit("\ufffd")) & (x != c), x)
    fixed = F.coalesce(good(cp1252), good(latin1), c)
    return F.regexp_replace(fixed, CONTROL_CHARS, "")


def replace_artifacts(c: Column | str, pairs: list[tuple[str, str]] = ARTIFACTS) -> Column:
    text = col(c)
    for bad, good in pairs:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return strip(text)


def strip_html_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"<[^<]+?>", "")


def py_title(c: Column | str) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs, lambda t: F.concat(F.upper(t.substr(1, 1)), F.lower(F.substring(t, 2, 1 << 30)))
        ),
        "",
    )


def split_words(c: Column | str) -> Column:
    """Words between white space, without empty edge tokens."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda t: t != "")


def clean_text(c: Column | str) -> Column:
    """Lower case, non-alphanumerics to spaces, spaces squeezed."""
    text = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition has letters a-z or digits: to one of them, and to several."""
    one, more = {}, {}
    for ch in map(chr, range(0x80, 0x110000)):
        if unicodedata.decomposition(ch) or unicodedata.normalize("NFKD", ch) != ch:
            folded = re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", ch).lower())
            if folded:
                (one if len(folded) == 1 else more)[ch] = folded
    return one, more


_ONE, _MORE = _folds()
_MORE_CLASS = "[" + "".join(_MORE) + "]"


def alnum_key(c: Column | str) -> Column:
    """Compatibility decomposition in lower case, letters a-z and digits only."""
    text = F.translate(col(c).cast("string"), "".join(_ONE), "".join(_ONE.values()))
    table = F.from_json(F.lit(json.dumps(_MORE)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(text, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    text = F.when(text.rlike(_MORE_CLASS), spelled).otherwise(text)
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def normalize_path_separator(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"(?U)\s*[>/|\\]\s*", " / "))


def path_segments(c: Column | str, pattern: str = r"[>/]") -> Column:
    return F.filter(
        F.transform(F.split(col(c), pattern), lambda s: strip(s)), lambda s: s != ""
    )


def base_sku(c: Column | str) -> Column:
    return strip(F.substring_index(col(c), "-", 1))


def group_key(*cols: Column) -> Column:
    """128-bit fixed-width key of a text tuple, for joins on long text."""
    return F.struct(
        F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("2"), *cols).alias("h2")
    )
