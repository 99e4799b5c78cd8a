"""Golden values for the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from cardmill.functions import phones as P
from cardmill.functions import scoring as S
from cardmill.functions import text as T
from cardmill.functions import vcard as V
from cardmill.functions import web as W


def values(spark, inputs, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_phone_spellings_of_one_number(spark):
    inputs = [
        "01711223344", "01711-223344", "017 1122 3344", "+8801711223344", "8801711223344",
        "008801711223344", "(017) 1122-3344", "০১৭১১২২৩৩৪৪",
    ]
    for got in values(spark, inputs, P.phone_struct):
        assert (got.e164, got.valid, got.kind) == ("+8801711223344", True, "mobile")


def test_phone_verdicts(spark):
    cases = {
        "01012233445": (False, "unknownOperator"),
        "01212233445": (False, "unknownOperator"),
        "0171122334": (True, None),
        "017112": (False, "unrecognizedFormat"),
        "12345": (False, "tooShort"),
        "1234567890123456": (False, "tooLong"),
        "+6561234567": (True, None),
    }
    got = values(spark, list(cases), P.phone_struct)
    # ten national digits starting with 1 is the only mobile shape; 9 starting with 1 is nothing
    assert (got[2].valid, got[2].issue) == (False, "unrecognizedFormat")
    cases.pop("0171122334")
    got = got[:2] + got[3:]
    assert [(g.valid, g.issue) for g in got] == list(cases.values())
    assert values(spark, ["Dhanmondi", "GOOD", "Books", "Sales", "", " "], P.phone_struct) == [None] * 6


def test_phone_repair_beats_short_landline(spark):
    got = values(spark, ["Ol711223344"], P.phone_struct)[0]
    assert (got.e164, got.valid, got.repaired) == ("+8801711223344", True, True)


@pytest.mark.parametrize("prefix", ["013", "014", "015", "016", "017", "018", "019"])
def test_allocated_prefixes(spark, prefix):
    got = values(spark, [prefix + "12233445"], P.phone_struct)[0]
    assert got.valid and got.kind == "mobile" and got.operator


def test_phones_in_text(spark):
    got = values(
        spark,
        ["Mob: 01711-223344, 01911-556677", "01711223344\n+880 1711-223344", "01711223344\n01911556677",
         "Ol711223344", "no number", "01711223344/01811223344"],
        P.phones,
    )
    assert [[p.e164 for p in row] for row in got] == [
        ["+8801711223344", "+8801911556677"],
        ["+8801711223344"],
        ["+8801711223344", "+8801911556677"],
        ["+880711223344"],
        [],
        ["+8801711223344", "+8801811223344"],
    ]


def test_national_format_and_mobile(spark):
    assert values(spark, ["+8801714066410", "+6561234567"], P.national_format) == ["01714066410", "+6561234567"]
    assert values(spark, ["+8801714066410", "+88021234567", "+8801214066410"], P.is_mobile) == [True, False, False]


def test_emails(spark):
    got = values(
        spark,
        ["Email: Info@MedicaBooks.com.bd", "info(a)medicabooks.com.bd", "A@b.com a@B.com", "info at medica.com",
         "x.y@a.com.d@e.com", "none", "a@..com", "me [AT] host.org", "me © host.org"],
        W.emails,
    )
    assert [[(e.normalized, e.repaired) for e in row] for row in got] == [
        [("info@medicabooks.com.bd", False)],
        [("info@medicabooks.com.bd", True)],
        [("a@b.com", False)],
        [("info@medica.com", True)],
        [("x.y@a.com", False), (".d@e.com", False)],
        [],
        [("a@..com", False)],
        [("me@host.org", True)],
        [("me@host.org", True)],
    ]
    assert got[6][0].issue == "malformed_domain" and not got[6][0].valid


def test_websites(spark):
    got = values(
        spark,
        ["www.medicabooks.com.bd", "http://medicabooks.com.bd", "https://medicabooks.com.bd", "medicabooks.com.bd",
         "Ver 2.1", "Tk 1500.00", "Dhanmondi 27.Dhaka", "facebook.com/medicabooks", "info@medica.com",
         "WWW.A.com/x see b.org and a.com", "info at medica.com"],
        W.websites,
    )
    assert [[s.domain for s in row] for row in got] == [
        ["medicabooks.com.bd"]] * 4 + [[], [], [], ["facebook.com"], [], ["a.com", "b.org"], ["medica.com"]]
    assert got[7][0].url == "https://facebook.com/medicabooks"


def test_names(spark):
    assert values(spark, ["Md. Rahman", "Rahman", "Mr.", "রহিম", None, "Engr. Abdul  Karim"], T.person_key) == [
        "rahman", "rahman", None, None, None, "abdul karim"]
    assert values(spark, ["Aquarius Pet Shop Ltd.", "aquarius pet-shop", "Ltd"], T.org_key) == [
        "aquarius pet shop", "aquarius pet shop", None]
    assert values(spark, ["Md. Abul Bashar Sarker", "Rahman", "Md.", "", None], T.initials) == [
        "AS", "R", "M", "?", "?"]


def test_address_and_words(spark):
    assert values(
        spark,
        ["House 42, Road 7", "Shop No:278", "The Coffee Shop", "Dhaka-1205", "Flat No. 5B", "Shop # 12", "Rahim Uddin"],
        T.looks_like_address,
    ) == [True, True, False, True, True, True, False]
    word = lambda c: T.contains_word(c, ["md", "co."])
    assert values(spark, ["MD", "Mdina Traders", "Rahim & Co.", "coX"], word) == [True, False, True, False]


def test_terms_and_folding(spark):
    assert values(spark, ["01711-223344", "t-shirt!", "--- ??? ***", "a  OR b"], T.terms) == [
        ["01711", "223344"], ["t", "shirt"], [], ["a", "or", "b"]]
    assert values(spark, ["Éauaux CAFÉ naïve ét"], T.index_terms) == [["eauaux", "cafe", "naive", "et"]]
    assert values(
        spark, ["Sonar Bangla Press, cheap rates"], lambda c: T.matched_terms(F.lit("cheap printing press cheap"), c)
    ) == [["cheap", "press"]]


def test_rect(spark):
    got = values(spark, ["1,2,3.5,4", "1,2,3", "a,b,c,d", " 1, 2 ,3,4"], T.parse_rect)
    assert tuple(got[0]) == (1.0, 2.0, 3.5, 4.0) and got[1] is None and got[2] is None and got[3].bottom == 4.0


def test_cer_and_scores(spark):
    pairs = [("kitten", "sitting"), ("", "abc"), ("", ""), ("a  b", "a b"), ("abc", ""), ("a", "abcd")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, h string")
    got = [r.c for r in df.select("i", S.cer(F.col("r"), F.col("h")).alias("c")).orderBy("i").collect()]
    assert got == [3 / 6, 1.0, 0.0, 0.0, 1.0, 3.0]
    row = spark.sql("select timestamp'2024-01-01' a, timestamp'2025-12-31' b").select(
        S.freshness(F.col("a"), F.col("b")).alias("f"),
        S.freshness(F.col("b"), F.col("a")).alias("g"),
        S.clamp01(F.lit(float("nan"))).alias("n"),
        S.clamp01(F.lit(1.5)).alias("c"),
        S.trust(F.lit(1), F.lit(0)).alias("t"),
        S.normalized_rrf(F.lit(2 / 61)).alias("r"),
        S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.6), F.lit(0.8))).alias("d"),
    ).first()
    assert row.f == 0.5 and row.g == 1.0 and row.n == 0.0 and row.c == 1.0
    assert abs(row.t - 2 / 3) < 1e-12 and row.r == 1.0 and row.d == 0.6


def test_vcard_text(spark):
    assert values(spark, ["Md. Abul Bashar Sarker", "Rahman"], V.structured_name) == [
        "Sarker;Md. Abul Bashar;;;", "Rahman;;;;"]
    assert values(spark, ["a\\b;c,d\r\ne\nf"], V.escape) == ["a\\\\b\\;c\\,d\\ne\\nf"]
    assert values(spark, ["Md. Rahman & Co", "***", "a  b"], V.safe_file_name) == ["Md_Rahman_Co", "contact", "a_b"]
    empty = F.array().cast("array<struct<kind:string,value:string,label:string>>")
    text = values(
        spark, ["Target Center"],
        lambda c: V.vcard(F.lit(""), c, F.lit(None).cast("string"), c, F.lit(""), F.lit("x\ny"), empty),
    )[0]
    assert text == (
        "BEGIN:VCARD\r\nVERSION:3.0\r\nFN:Target Center\r\nN:Center;Target;;;\r\nORG:Target Center\r\n"
        "ADR;TYPE=WORK:;;Target Center;;;;\r\nNOTE:x\\ny\r\nEND:VCARD\r\n"
    )


def test_spelled_phones_are_read_on_all_cores(spark, tmp_path):
    from cardmill.plans import text_queries

    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert text_queries.spelled_phones(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_trim_without_an_expression_equals_the_expression(spark):
    rng = random.Random(4)
    signs = [*T.SPACE_CHARS, "a", "​", "é", "\U0001F600"]
    assert len(T.SPACE_CHARS) == 26
    texts = [None, "", *["".join(rng.choice(signs) for _ in range(rng.randrange(9))) for _ in range(800)]]
    pattern = f"^[{T.SPACE}]+|[{T.SPACE}]+$"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~T.trim(F.col("t")).eqNullSafe(F.regexp_replace("t", pattern, ""))).isEmpty()
    assert "regexp" not in df.select(T.trim(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_parse_rect_reads_its_numbers_once(spark):
    df = spark.createDataFrame([("1, 2,3 ,4.5",), ("1,2,3",), ("1,2,x,4",), ("",), (None,), ("1,2,3,4,5",)], "t string")
    made = df.select(T.parse_rect(F.col("t")).alias("r"))
    assert [r.r and tuple(r.r) for r in made.collect()] == [(1.0, 2.0, 3.0, 4.5), None, None, None, None, None]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_words_by_common_beginnings(spark):
    """The tree of words and the guards in front of slow patterns find what the plain patterns find."""
    rng = random.Random(12)
    words = ["co", "co.", "co-founder", "corp", "house", "managing director", "rd."]
    parts = [*words, "CO", "House", "x", "7", "1205", "shop", "Shop No", " ", "\n", ".", "-", ":", "_", "\u00a0", "Dhaka", "é", "@", "at", "a.bd", "www.", "০১৭"]
    texts = [None, "", *["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(1500)]]
    units = "(?i)(?<![A-Za-z0-9_])(?:" + "|".join(T.fixed.UNIT_WORDS) + ")(?![A-Za-z0-9_])" + T.NUMBERED_UNIT.split("(?![A-Za-z0-9_])", 1)[1]
    plain = lambda c: F.lower(c).rlike(T.any_word_pattern(T.fixed.ADDRESS_WORDS)) | c.rlike(units) | c.rlike(T.POSTCODE)
    assert values(spark, texts, lambda c: T.contains_word(c, words)) == values(spark, texts, lambda c: F.lower(c).rlike(T.any_word_pattern(words)))
    assert values(spark, texts, T.looks_like_address) == values(spark, texts, plain)
    assert values(spark, texts, T.to_latin) == values(spark, texts, lambda c: F.translate(c, T.fixed.BENGALI_DIGITS, T.fixed.LATIN_DIGITS))
    assert T.word_tree(["co", "co.", "corp", "rd."]) == "(?:co(?:\\.|rp)?|rd\\.)"
