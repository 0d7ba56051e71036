from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import patterns as R
from gaugeworks.functions import predicates as P
from gaugeworks.functions import validators as V
from gaugeworks.operators import frequencies as Q
from gaugeworks.plans.report import round_half_away


def column(spark, values, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.select(expression(F.col("v")).alias("x"), "k").orderBy("k").select("x").collect()]


def test_null_like(spark):
    values = [None, "", "  ", "\t\n", "null", " NULL ", "NaN", " nan ", "NA", "N/A", "-", "0", "none"]
    assert column(spark, values, P.is_null_like) == [v is None or v.strip().lower() in ("", "null", "nan") for v in values]


def test_numbers(spark):
    values = ["1", "+1", "-1", "1.", ".5", "1e5", "1E-2", "inf", "-Infinity", "nan", "1d", "1f", " 1", "0x1", "", ".", "e5", "1_0", "18446744073709551615", "18446744073709551616", "-9223372036854775808", "-9223372036854775809", "1\n"]
    floats = [True] * 10 + [False] * 8 + [True] * 4 + [False]
    assert column(spark, values, P.is_float) == floats
    whole = {"1", "+1", "-1", "18446744073709551615", "-9223372036854775808"}
    assert column(spark, values, P.is_integer) == [v in whole for v in values]
    got = column(spark, values, P.number)
    assert got[:7] == [1, 1, -1, 1, 0.5, 1e5, 0.01] and got[7:18] == [None] * 11 and got[22] is None


def test_booleans_and_classes(spark):
    values = ["true", " FALSE ", "yes", "1", "2024-01-05", "5/1/2024", "05.01.2024", "2024-01-05T10:00:00.5", "text", "null", "1e3"]
    assert column(spark, values, P.is_boolean) == [True, True] + [False] * 9
    assert column(spark, values, P.lexical_class) == ["Boolean", "Boolean", "Text", "Numeric", "Date", "Date", "Date", "Date", "Text", None, "Numeric"]


def test_moments(spark):
    cases = {
        "2024-02-29": "2024-02-29 00:00:00", "2023-02-29": None, "29/02/2024": "2024-02-29 00:00:00", "13/12/2024": "2024-12-13 00:00:00", "12/13/2024": "2024-12-13 00:00:00",
        "5.1.2024": "2024-01-05 00:00:00", "2024/01/05": "2024-01-05 00:00:00", "2024-01-05T10:11:12Z": "2024-01-05 10:11:12", "2024-01-05T10:11:12.25+02:00": "2024-01-05 10:11:12",
        "2024-01-05 10:11:12": "2024-01-05 10:11:12", "05/01/2024 10:11:12": "2024-01-05 10:11:12", "2024-13-45": None, "x2024-01-05": None, " 2024-01-05 ": "2024-01-05 00:00:00",
    }
    assert dict(zip(cases, column(spark, [*cases], lambda c: F.date_format(P.moment(c), "yyyy-MM-dd HH:mm:ss")), strict=True)) == cases
    raw = ["2024-01-05", " 2024-01-05", "5/1/2024", "05/01/2024", "2024-01/05"]
    assert column(spark, raw, lambda c: P.raw_moment(c).isNotNull()) == [True, False, False, True, False]


def test_decimal_scale(spark):
    cases = {"1": 0, "1.50": 1, "1.500e1": 0, "1.25e-2": 4, "0.000": 0, "12.": 0, "abc": None, "1e-3": 3}
    assert dict(zip(cases, column(spark, [*cases], P.decimal_scale), strict=True)) == cases


def test_rounding_is_that_of_the_driver(spark):
    r = random.Random(1)
    values = [0.575, 1.005, 2.675, -0.5, 0.125, 1e300, -2.5e-7, 0.0, 33.335] + [r.uniform(-1000, 1000) for _ in range(300)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for digits in (2, 4):
        got = [x[0] for x in df.orderBy("k").select(P.rounded(F.col("v"), digits)).collect()]
        assert got == [round_half_away(v, digits) for v in values]
    assert round_half_away(0.575, 2) == 0.57 and round_half_away(math.inf, 2) is None


def test_validators(spark):
    cases = [
        (V.credit_card, {"4111 1111 1111 1111": True, "4111111111111112": False, "5500-0000-0000-0004": True, "411111": False}),
        (V.iban, {"DE89370400440532013000": True, "DE89370400440532013001": False, "GB82WEST12345698765432": True, "XX": False}),
        (V.codice_fiscale, {"RSSMRA85T10A562S": True, "RSSMRA85T10A562T": False}),
        (V.piva_it, {"12345678903": True, "12345678901": False}),
        (V.cap_it, {"00010": True, "98168": True, "98169": False, "00009": False}),
        (V.ssn_us, {"123-45-6789": True, "000-12-3456": False, "666123456": False, "900-12-3456": False, "123-00-4567": False}),
        (V.ipv6, {"::1": True, "fe80::1:2": True, "1:2:3:4:5:6:7:8": True, "1::2::3": False, "1:2:3:4:5:6:7": False, "::ffff:1.2.3.4": True, "12345::": False, "::": True, "1:2:3:4:5:6:7:8::": False}),
        (V.coordinates, {"45.5, -120.25": True, "91, 10": False, "12.345,67": False, "12.345, 67": True}),
    ]
    for check, want in cases:
        assert dict(zip(want, column(spark, [*want], check), strict=True)) == want, check.__name__


PATTERN_CASES = {
    "Email": ("a.b@c.org", "a@b"), "Phone (US)": ("(212) 555-0100", "12"), "Phone (IT)": ("+39 0212345678", "0212345678"), "URL": ("https://x.org/a?b", "http:// x"), "UUID": ("123e4567-e89b-12d3-a456-426614174000", "123E4567-e89b-12d3-a456-426614174000"),
    "IPv4": ("10.0.255.1", "10.0.256.1"), "MAC Address": ("00:1A:2b:3c:4d:5e", "00:1A"), "Geographic Coordinates": ("45.5, -120.25", "95,1"), "ZIP Code (US)": ("12345-6789", "1234"), "File Path (Unix)": ("/usr/lib/", "usr/lib"),
    "File Path (Windows)": ("C:\\a\\b.txt", "C:/a"), "Hex Color": ("#a0B1c2", "#abc"), "SWIFT/BIC": ("DEUTDEFF500", "DEUT"), "Currency": ("€ 1.234,50", "1.234"), "Percentage": ("-3,5 %", "%"), "Alphanumeric Code": ("AB-12", "A-1"),
    "Scientific Notation": ("1.5e-3", "1.5"), "Labeled Identifier": ("item_12a", "12_item"), "UK Postcode": ("SW1A 1AA", "SW1A"), "Canadian Postal Code": ("K1A 0B1", "K1A"), "DateTime (ISO)": ("2024-01-05T10:00", "2024-01-05"), "Date (EU dot)": ("05.01.2024", "5.1.2024"),
    "Credit Card": ("4111 1111 1111 1111", "4111"), "P.IVA (IT)": ("12345678903", "1234"),
}


def test_patterns_match_what_they_should(spark):
    bit = {p.name: k for k, p in enumerate(R.CATALOGUE)}
    for name, (yes, no) in PATTERN_CASES.items():
        masks = column(spark, [yes, no, yes + "\n"], R.match_mask)
        assert [m >> bit[name] & 1 for m in masks] == [1, 0, 0 if not name.startswith(("DateTime", "File Path (Unix)")) else masks[2] >> bit[name] & 1], name


def bit_of(name):
    return 1 << next(k for k, p in enumerate(R.CATALOGUE) if p.name == name)


def test_detection():
    five = bit_of("CAP (IT)") | bit_of("ZIP Code (US)") | bit_of("German PLZ") | bit_of("French Code Postal")
    cap = [k for k, p in enumerate(R.CATALOGUE) if p.validator].index(next(k for k, p in enumerate(R.CATALOGUE) if p.name == "CAP (IT)")) + len(R.CATALOGUE)
    found = {p["name"]: p for p in R.detect({five | 1 << cap: 100})}
    # the more specific hide the less specific; two countries with the same rows share the confidence
    assert set(found) == {"CAP (IT)", "ZIP Code (US)"} and found["ZIP Code (US)"]["confidence"] == pytest.approx(0.35 * 0.75 / 2)
    home = R.detect({five | 1 << cap: 100}, "it-IT")
    assert [p["name"] for p in home] == ["CAP (IT)"] and home[0]["confidence"] == 0.5
    assert R.detect({}) == [] and R.detect({0: 10}) == []
    assert R.detect({bit_of("Email"): 3, 0: 97}) == []  # the threshold itself isn't enough
    assert R.detect({bit_of("Email"): 4, 0: 96})[0]["confidence"] == pytest.approx(0.8 * 4 / 50)
    assert R.detect({bit_of("IBAN"): 100}) == []  # no value passes the check


def test_locales():
    assert [R.parse_locale(x) for x in (None, " ", "it", "ITA", "it_IT", "en-US")] == [None, None, "IT", "IT", "IT", "US"]
    for bad in ("xx", "a-b-c"):
        with pytest.raises(ValueError):
            R.parse_locale(bad)
    assert len(R.list_patterns()) == 35 and all(p["locale"] in (None, "US") for p in R.list_patterns("US"))


def test_numbers_match_the_patterns_that_they_would_without_the_shortcut(spark):
    r = random.Random(6)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    values = [sign + digits(n) + (("." + digits(m)) if m else "") for sign in ("", "-") for n in range(1, 17) for m in (0, 1, 2, 4, 7)] + ["123.4567890", "0039061234567"]
    full = {}
    for k, p in enumerate(R.CATALOGUE):
        full[k] = column(spark, values, lambda c, p=p: c.rlike(p.java))
    masks = column(spark, values, R.match_mask)
    for k in full:
        assert [bool(m >> k & 1) for m in masks] == full[k], R.CATALOGUE[k].name


def test_moments_without_formatter(spark):
    df = spark.createDataFrame([(t,) for t in ("31/02/2024", "13/13/2024", "02/13/2024", "13-02-2024", "02-13-2024", "1.2.0001", "0000/2/29", "2024-1-2 24:00:00", "9/8/2024 7:06:5", "2024-01-02t3:4:5.123456789+02:00", "2024-1-2T03:04:05Z", "2024-01/02", " 29.02.2024\n")], "t string")
    got = df.select(F.date_format(P.moment(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("m"))
    day = lambda d, h="00:00:00": f"{d} {h}"
    assert [r["m"] for r in got.collect()] == [None, None, day("2024-02-13"), day("2024-02-13"), None, day("0001-02-01"), day("0000-02-29"), None, day("2024-08-09", "07:06:05"), day("2024-01-02", "03:04:05"), None, None, day("2024-02-29")]
    # texts are cast, not read by a formatter, which takes most of the time
    assert "gettimestamp" not in got._jdf.queryExecution().executedPlan().toString()


def test_types_ask_no_more(spark):
    df = spark.createDataFrame([(t,) for t in ("12", "0000000000000000000000000000000000000000007", "18446744073709551616", "1" * 18, "-9223372036854775809")], "c string")
    made = Q.lexical_profile(df).select("column", "integers", "data_type")
    assert [tuple(r) for r in made.collect()] == [("c", 3, "Float")]
    # neither decimals nor moments are looked for where nobody reads them
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "as timestamp" not in plan
