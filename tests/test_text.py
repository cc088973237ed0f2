import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultfold.functions import jsontext, text
from faultfold.sources.tables import read_table

TOKEN = "eyJhbGciOi-made-up-head.made_up_claims_77.made-up~signature_0"


def expected(value: str) -> str:
    """The masks by Python's own regular expressions."""
    value = " ".join(value.split())
    for pattern, mask in [
        (text.JWT_PATTERN, text.JWT_MASK),
        (text.EMAIL_PATTERN, text.EMAIL_MASK),
        (text.CARD_PATTERN, text.CARD_MASK),
    ]:
        value = re.sub(pattern, mask, value)
    secret = re.compile(rf'({text.SECRET_KEYS}["\s]*)([:=])["\s]*{text.SECRET_VALUE}', re.IGNORECASE)
    return secret.sub(lambda m: f'{m[1]}: "{text.SECRET_MASK}"' if m[2] == ":" else text.SECRET_MASK, value)


def redact_all(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    column = text.redact(text.fold_space(F.col("t"))).alias("column")
    staged = text.redacted(rows, F.col("t"), "staged").select("i", "staged", column)
    got = {r["i"]: (r["staged"], r["column"]) for r in staged.collect()}
    return [got[i] for i in range(len(values))]


CASES = [
    (f"header {TOKEN}, twice {TOKEN}", "header [REDACTED_JWT], twice [REDACTED_JWT]"),
    ("two: a.b+c@mail.zone-3.org and x@y.io.", "two: [REDACTED_EMAIL] and [REDACTED_EMAIL]."),
    ("paid by 5500-0000-0000-0004 (twice)", "paid by [REDACTED_CREDIT_CARD] (twice)"),
    ("api-key : zone3-zone3-zone3-z", 'api-key : "[REDACTED_SECRET]"'),
    ("db password=correct-horse-battery;", "db [REDACTED_SECRET];"),
    ("token=secretsecretsecret:abcdefghijklmnop1234", None),
    ("\tfirst row\r\n \u3000second  row\u2009", "first row second row"),
    ("ſecret: zone3-zone3-zone3-z", None),
    ("toKen = zone3-zone3-zone3-z", None),
    ("\ufdd0token\ufdd1:\ufdd2 kept, token: zone3-zone3-zone3-z", None),
    ("auth=" + "z" * 70, "[REDACTED_SECRET]" + "z" * 6),
    ("", ""),
]


def test_masks(spark):
    got = redact_all(spark, [case for case, _ in CASES])
    for (case, known), (staged, column) in zip(CASES, got, strict=True):
        assert staged == column == (known if known is not None else expected(case)), case


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def test_cards_with_a_right_check_digit(spark):
    numbers = [f"{n}" for n in range(4999999999999990, 4999999999999990 + 40)] + ["0" * 13, "7992739871300", "12345678901234", "9" * 16]
    texts = [f"a {n[:4]} {n[4:]}-b {n}" for n in numbers] + ["none here", "", None, numbers[0], f"{numbers[3]}x", "5500-0000-0000-0004", "٣" * 14, "٠" * 13]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("t", text.mask_card(F.col("t"), luhn=True).alias("m"), text.mask_card(F.col("t")).alias("all")).collect()

    def want(value):
        judge = lambda m: text.CARD_MASK if luhn(re.sub("[ -]", "", m[0])) else m[0]
        return None if value is None else re.sub(text.CARD_PATTERN, judge, value)

    assert all(r["m"] == want(r["t"]) for r in found)
    assert any(r["m"] != r["all"] for r in found) and any(r["m"] != r["t"] for r in found)


def test_strict_takes_the_tail(spark):
    row = spark.createDataFrame([("auth=" + "z" * 70,)], "t string")
    assert row.select(text.mask_secret(F.col("t"), strict=True)).first()[0] == text.SECRET_MASK


def test_whole_documents_like_python(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("text")
    rows = text.redacted(docs, F.col("text"), "masked").collect()
    assert rows
    for row in rows:
        assert row["masked"] == expected(row["text"])


FRAGMENTS = st.sampled_from(
    ["token", "api-key", "=", ":", '"', " ", "\t", " ", " ", "a" * 16, "B9_-.~" * 3, "@", "x.com",
     "4111", " 1111", "-", "eyJhbGciOi", ".", "é", "日", "\x85", "\x1c", "secret", "_", "1" * 15, "apı", "ſecret", "K", "İ"]
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(FRAGMENTS, max_size=12).map("".join), min_size=40, max_size=60))
def test_random_texts_like_python(spark, values):
    for value, (staged, column) in zip(values, redact_all(spark, values), strict=True):
        assert staged == column == expected(value), repr(value)


def test_escaped_size_like_python(spark, sf_dir):
    texts = ["plain", "é", "日本", "😀 x", "\x7f", "a\x01\n\t\"\\/", "", "é日😀\x7f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").unionByName(
        read_table(spark, sf_dir, "documents").select(F.col("text").alias("t"))
    )
    sized = rows.select("t", jsontext.escaped_bytes(jsontext.compact_json(F.struct("t"))).alias("n"))
    for row in sized.collect():
        assert row["n"] == len(json.dumps({"t": row["t"]}, separators=(",", ":")))


@pytest.mark.parametrize(
    "given_text,value",
    [
        ('{"a":1}', '{"a":1}'), ('{"a":1} x', None), ('{"a":1}}', None), ('{"a":1}]', None),
        ('{"a":1},{"a":2}', None), ('{"a":1}],[{"b":2}', None), ("", None), (' {"a":[1]} ', '{"a":[1]}'),
    ],
)
def test_only_whole_json(spark, given_text, value):
    rows = spark.createDataFrame([(given_text,)], "t string")
    parsed = jsontext.parse_whole(rows, "t", "v").select(F.to_json("v")).first()[0]
    assert parsed == value


def test_sql_functions(spark):
    from faultfold.functions import register

    register(spark)
    assert spark.sql("SELECT normalize_impact('low to HIGH')").first()[0] == "HIGH"
    assert spark.sql("SELECT fold_space(' a \t b ')").first()[0] == "a b"
    values = [case for case, _ in CASES if "first row" not in case]
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    rows.createOrReplaceTempView("cases")
    for row in spark.sql("SELECT t, redact(t) AS r FROM cases").collect():
        assert row["r"] == expected(row["t"])
    one = spark.sql("SELECT fault_signature(map('b', '1', 'a', '2'), 'error', 'm') = "
                    "fault_signature(map('a', '2', 'b', '1'), 'ERROR', 'm')").first()[0]
    assert one is True
