import re

import pytest
from pyspark.sql import functions as F

from filecover.functions.patterns import java_pattern

PATTERNS = [
    r"(?P<n>ab)(?P=n)", r"\.tmp\Z", r"\w+é$", r"(?i)ÉCOLE", r"^\d{2}", r"\bfoo\b", r"\Boo", r"a.c", r"(?s)a.c", r"(?m)^x$", r"(?x) a b # c",
    r"[^\W\d]+_", r"[^a-z]", r"[\W]", r"(?i:x)Y", r"(?i)[a-f]{3}", r"(?a)\w\b$", r"(?<=a)b", r"(?<!a)b", r"(?>a+)b", r"a++b", r"a*?b", r"", r"x|",
    r"(a)|(b)\2", r"\s", r"[\s\d]x", r"(?i)k", r"\x41é", r"a{2,}", r"(a)(b)(c)(d)(e)(f)(g)(h)(i)(j)\10", r"[]a]", r"[&&a]", r"\$\^", r"(?i)ſ",
    r"(?i)[^k]", r"(?im)^É.*$", r"~[a[b]", r"\Aab\Z", r"(?:a|b)*c", r"(?i)ß", r"(?!a)b", r"[^\S ]", r"(?i)(é)\1", r"\d",
]
TEXTS = [
    "", "abab", "x.tmp", "x.tmp\n", "caféé", "café", "école", "ÉCOLE", "12 a", "٣٤", "a foo b", "foo", "food", "a\nc", "a\rc", "a c", "y\nx\nz",
    "ab", "ab # c", "a_b", "1_", "_", "É", "x y", "xy", "xY", "XY", "ABC", "FED", "fée", "aé", "bb", "cb", "aab", "b", "aaa", "abcdefghijj", "]", "&",
    "$^", "k", "K", "K", "s", "ſ", "S", "a[b", "~ab", "a\x1cb", "a\x85b", "a\xa0b", "a​b", "a　x", "١x", "²", "Ⅷ", "ß", "ẞ", "SS", "𝟘", "a😀c",
    "\n", "a\n", "é", "aXc", "éÉ",
]


def test_as_python_reads_them(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    found = texts.select("t", *[F.col("t").rlike(java_pattern(p)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).collect()
    wrong = [(p, r["t"]) for r in found for k, p in enumerate(PATTERNS) if r[f"p{k}"] != bool(re.search(p, r["t"]))]
    assert wrong == []


@pytest.mark.parametrize("pattern", ["(", "*a", r"(a)(?(1)b|c)", "a{3000000000}", "(?<=a+)b", "(?Z)"])
def test_refusals(pattern):
    with pytest.raises(ValueError, match="regular expression|counterpart"):
        java_pattern(pattern)
