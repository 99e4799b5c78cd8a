"""Phone numbers: candidates in a text, and the reading of one candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.text import (
    LINE_SPACE,
    digit_ratio,
    digits_only,
    keep_first,
    let,
    repair_confusables,
    to_latin,
    trim,
)

PHONE_TYPE = (
    "struct<raw:string,e164:string,valid:boolean,kind:string,operator:string,issue:string,repaired:boolean>"
)

# What a number may look like in a text and what stands between two.
# One line of digits and separators. The newline is not a separator: each line is its own block.
CANDIDATE = rf"[+]?[0-9][0-9{LINE_SPACE}\-.()/]{{5,}}"
PIECES = rf"[,;/]|[{LINE_SPACE}]+(?:and|&|or)[{LINE_SPACE}]+"

_QUALITY = {"mobile": 3, "international": 2, "landline": 1}


def _outcome(raw, repaired, e164=None, valid=False, kind="unknown", operator=None, issue=None) -> Column:
    def text(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return F.struct(
        raw.alias("raw"),
        text(e164).alias("e164"),
        (valid if isinstance(valid, Column) else F.lit(valid)).alias("valid"),
        text(kind).alias("kind"),
        text(operator).alias("operator"),
        text(issue).alias("issue"),
        F.lit(repaired).alias("repaired"),
    )


def _operator(national: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in fixed.MOBILE_OPERATORS.items() for x in pair])
    return F.try_element_at(names, F.concat(F.lit("0"), F.substring(national, 1, 2)))


def _reading(cleaned: Column, raw: Column, repaired: bool) -> Column:
    def classify(digits: Column) -> Column:
        size = F.length(digits)
        national = (
            F.when(digits.startswith("00" + fixed.COUNTRY_CODE), F.substr(digits, F.lit(6)))
            .when(digits.startswith(fixed.COUNTRY_CODE) & (size > 11), F.substr(digits, F.lit(4)))
            .when(digits.startswith("0"), F.substr(digits, F.lit(2)))
            .otherwise(digits)
        )
        return (
            F.when(size == 0, F.lit(None).cast(PHONE_TYPE))
            .when(size < 6, _outcome(raw, repaired, issue="tooShort"))
            .when(size > 15, _outcome(raw, repaired, issue="tooLong"))
            .otherwise(let(national, lambda n: by_plan(n, digits)))
        )

    def by_plan(national: Column, digits: Column) -> Column:
        size = F.length(national)
        local = F.concat(F.lit("+" + fixed.COUNTRY_CODE), national)
        operator = _operator(national)
        dialled = F.length(digits) >= 8
        return (
            F.when(
                national.startswith("1") & (size == 10),
                _outcome(
                    raw, repaired, local, operator.isNotNull(), "mobile", operator,
                    F.when(operator.isNull(), F.lit("unknownOperator")),
                ),
            )
            .when(
                ~national.startswith("1") & size.between(7, 10),
                _outcome(raw, repaired, local, True, "landline"),
            )
            .when(
                F.ltrim(cleaned).startswith("+"),
                _outcome(
                    raw, repaired, F.concat(F.lit("+"), digits), dialled, "international", None,
                    F.when(~dialled, F.lit("tooShort")),
                ),
            )
            .otherwise(_outcome(raw, repaired, issue="unrecognizedFormat"))
        )

    return let(digits_only(cleaned), classify)


def _quality(reading: Column) -> Column:
    score = F.lit(0)
    for kind, value in _QUALITY.items():
        score = F.when(reading["kind"] == kind, F.lit(value)).otherwise(score)
    return F.when(reading["valid"], score).otherwise(0)


def phone_struct(candidate: Column) -> Column:
    """The better of the plain and the letter-repaired reading; null when not number-shaped."""

    def read(raw: Column) -> Column:
        return let(to_latin(raw), lambda latin: best(raw, latin))

    def best(raw: Column, latin: Column) -> Column:
        plain = _reading(latin, raw, repaired=False)
        fixed_up = F.when(repair_confusables(latin) != latin, _reading(repair_confusables(latin), raw, True))
        return F.when(
            digit_ratio(latin) >= 0.6, let(plain, lambda p: let(fixed_up, lambda f: choose(p, f)))
        )

    def choose(plain: Column, fixed_up: Column) -> Column:
        better = plain.isNull() | (fixed_up.isNotNull() & (_quality(fixed_up) > _quality(plain)))
        return F.when(better, fixed_up).otherwise(plain)

    return F.when(trim(candidate) != "", let(trim(candidate), read))


def phone_key(phone: Column) -> Column:
    return F.when(phone["valid"], phone["e164"]).otherwise(phone["raw"])


def phones(text: Column) -> Column:
    """All distinct numbers of a text in order of appearance."""
    found = F.regexp_extract_all(to_latin(text), F.lit(CANDIDATE), F.lit(0))
    numbered = F.when(~text.rlike(f"[0-9{fixed.BENGALI_DIGITS}]"), F.array().cast("array<string>")).otherwise(found)
    pieces = F.flatten(F.transform(numbered, lambda c: F.split(c, PIECES)))
    parsed = F.filter(F.transform(pieces, phone_struct), lambda p: p.isNotNull())
    return keep_first(parsed, phone_key, PHONE_TYPE)


def national_format(e164: Column) -> Column:
    """As dialled locally; foreign numbers unchanged."""
    return F.regexp_replace(e164, rf"^\+{fixed.COUNTRY_CODE}(.+)$", "0$1")


def is_mobile(e164: Column) -> Column:
    prefixes = "|".join(p[1:] for p in fixed.MOBILE_OPERATORS)
    return e164.rlike(rf"^\+{fixed.COUNTRY_CODE}(?:{prefixes})[0-9]{{8}}$")


def shown_phone(phone: Column) -> Column:
    """Dialable form when the number is known, otherwise what was read."""
    return F.when(phone["valid"] & phone["e164"].isNotNull(), national_format(phone["e164"])).otherwise(phone["raw"])
