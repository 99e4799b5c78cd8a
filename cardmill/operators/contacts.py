"""Contact extraction and field validation over text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions.phones import phone_struct, phones
from cardmill.functions.text import looks_like_address, trim
from cardmill.functions.web import emails, websites


def _found(df: DataFrame, id_col: str, items: Column) -> DataFrame:
    return df.select(id_col, F.posexplode(items).alias("pos", "hit")).select(id_col, "pos", "hit.*")


def extract_phones(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return _found(df, id_col, phones(F.col(text)))


def extract_emails(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return _found(df, id_col, emails(F.col(text)))


def extract_websites(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return _found(df, id_col, websites(F.col(text)))


def _verdict(normalized: Column | None, issue: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (none if normalized is None else normalized).alias("normalized"), (none if issue is None else issue).alias("issue")
    )


def validation(key: Column, value: Column) -> Column:
    """{normalized, issue} of one value, by the same readers extraction uses."""
    text = trim(value)
    phone, email, site = F.col("_v.phone"), F.col("_v.email"), F.col("_v.site")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", _verdict(None, F.lit("empty")))
        .when(
            key == "phone",
            F.when(phone.isNull(), _verdict(None, F.lit("unrecognizedFormat")))
            .when(~phone["valid"], _verdict(None, F.coalesce(phone["issue"], F.lit("unrecognizedFormat"))))
            .otherwise(_verdict(phone["e164"], F.when(phone["repaired"], F.lit("ocr_repaired")))),
        )
        .when(
            key == "email",
            F.when(email.isNull(), _verdict(None, F.lit("not_an_email"))).otherwise(
                _verdict(
                    F.when(email["valid"], email["normalized"]),
                    F.coalesce(email["issue"], F.when(email["repaired"], F.lit("ocr_repaired"))),
                )
            ),
        )
        .when(
            key == "website",
            F.when(site.isNull(), _verdict(None, F.lit("not_a_website"))).otherwise(_verdict(site["domain"], None)),
        )
        .when(
            key == "person_name",
            _verdict(None, F.when(looks_like_address(text), F.lit("looks_like_address"))),
        )
        .otherwise(_verdict(None, None))
    )


def validate_fields(df: DataFrame, key: str = "field_key", value: str = "value") -> DataFrame:
    """Adds ``normalized`` and ``issue``; only the reader a key needs runs on its rows."""
    k, v = F.col(key), trim(F.col(value))
    readers = F.struct(
        F.when(k == "phone", phone_struct(v)).alias("phone"),
        F.when(k == "email", F.get(emails(v), F.lit(0))).alias("email"),
        F.when(k == "website", F.get(websites(v), F.lit(0))).alias("site"),
    )
    return (
        df.withColumn("_v", readers)
        .withColumn("_r", validation(k, F.col(value)))
        .withColumn("normalized", F.col("_r.normalized"))
        .withColumn("issue", F.col("_r.issue"))
        .drop("_v", "_r")
    )
