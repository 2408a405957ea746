import random
import re

import pytest
from pyspark.sql import functions as F

from shelfcheck.functions import prices as P
from shelfcheck.functions import text as T


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_missing_text_reads_nan(spark):
    assert values(spark, [None, "", "a"], T.pystr) == ["nan", "", "a"]


def test_number_coercion(spark):
    got = values(spark, ["1", " 2.5 ", "1e3", "1,000", "", None, "12d", "nan", "-3", ".5", "abc"], T.num)
    assert got == [1.0, 2.5, 1000.0, None, None, None, None, None, -3.0, 0.5, None]


def test_category_code(spark):
    assert values(spark, ["1002282.0", " 12 ", None, "a.b.c", "nan"], T.clean_category_code) == ["1002282", "12", "", "a", "nan"]


def test_title_case_like_python(spark):
    texts = ["5kg", "nike-air", "o'neill", "RED hat", "", "été à paris"]
    assert values(spark, texts, T.py_title) == [t.title() for t in texts]


def test_mojibake(spark):
    bad = ["donâ€™t", "cafÃ©", "é", "plain", "a\x01b", None, "Ã©â€™"]
    assert values(spark, bad, T.repair_mojibake) == ["don’t", "café", "é", "plain", "ab", None, "é’"]


def test_artifacts_in_order(spark):
    assert values(spark, ["itâ€™s Ã© ", "â€¦"], T.replace_artifacts) == ["it's e", "..."]


def test_normalize_and_match_key(spark):
    assert values(spark, ["The NEW Red-Hat 2024!", None, "Été best"], T.normalize_text) == ["theredhat", "", "été"]
    df = spark.createDataFrame([("Acme", "New Hat", None)], "b string, n string, c string")
    assert df.select(T.match_key("b", "n", "c")).first()[0] == "acme|hat|"


def test_formats_round_half_even(spark):
    df = spark.createDataFrame([(2.5,), (1234.5,), (3.5,)], "x double")
    assert [r[0] for r in df.select(P.fmt(F.col("x"), 0)).collect()] == ["2", "1,234", "4"]


def test_split_words_drops_edges(spark):
    assert values(spark, ["  a  b\tc ", ""], T.split_words) == [["a", "b", "c"], []]


def test_unicode_word_boundaries(spark):
    assert values(spark, ["Café", "caf x"], lambda c: c.rlike(T.bounded_pattern(["caf"]))) == [False, True]


@pytest.mark.parametrize("seed", range(3))
def test_shared_prefix_pattern_equals_plain_alternation(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abc. +") for _ in range(rng.randint(1, 5))).strip() for _ in range(40)} - {""}
    texts = ["".join(rng.choice("abc. +x") for _ in range(30)) for _ in range(60)]
    plain = re.compile(r"\b(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")\b")
    got = values(spark, texts, lambda c: F.regexp_extract_all(c, F.lit(T.word_pattern(words)), F.lit(1)))
    assert got == [plain.findall(t) for t in texts]


def test_local_price_and_parse(spark):
    df = spark.createDataFrame([("10", "20"), ("", "2"), (None, "0"), ("x", "1")], "s string, p string")
    assert [r[0] for r in df.select(P.local_price("s", "p", "KE")).collect()] == ["KSh 1,280", "KSh 256", "", ""]
    assert values(spark, ["KSh 1,200.50", "-", "0", None], P.parse_price) == ["1200.5", "", "", ""]


def test_alnum_key_folds_accents(spark):
    assert values(spark, ["Électro-Ménager 2"], T.alnum_key) == ["electromenager2"]


def test_alnum_key_folds_by_compatibility(spark):
    import unicodedata

    texts = ["Điện thoại Thế ﬁne Ａ1", "Crème Brûlée ½ ㎏", "İstanbul ǅ ﬃ", "Ωmega ß", "e\u0301te\u0301", "plain 12", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.alnum_key("t")).collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFKD", t).lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789") for t in texts]
