"""E-mail addresses and websites in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.text import SPACE, keep_first, let, trim

EMAIL_TYPE = "struct<raw:string,normalized:string,valid:boolean,repaired:boolean,issue:string>"
SITE_TYPE = "struct<raw:string,url:string,domain:string>"

# The characters and shapes of addresses, sites and hosts.
_LOCAL = r"A-Za-z0-9._%+\-"
_HOST = r"[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
# A match can only begin at the start of a run of local-part characters or where the last one ended;
# saying so keeps the scan of long junk runs linear.
_RUN_START = rf"(?:\G|(?<![{_LOCAL}]))"

EMAIL = rf"{_RUN_START}[{_LOCAL}]++@{_HOST}"
MANGLED_EMAIL = (
    rf"(?i){_RUN_START}([{_LOCAL}]++)[{SPACE}]*(?:\(a\)|\[at\]|\{{at\}}|[{SPACE}]+at[{SPACE}]+|©|@)[{SPACE}]*({_HOST})"
)
URL = rf"(?i)(?:https?://|www\.){_HOST}(?:/[^{SPACE}]*)?"
BARE_HOST = (
    r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9_])(?=-))"
    rf"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?:/[^{SPACE}]*)?"
)
KNOWN_SUFFIX = r"\.(?:" + "|".join(s.replace(".", r"\.") for s in fixed.KNOWN_SUFFIXES) + ")$"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _email(raw: Column, address: Column, repaired: bool) -> Column:
    normalized = F.lower(address)
    bad_host = F.substring_index(normalized, "@", -1).startswith(".")
    return F.struct(
        raw.alias("raw"),
        normalized.alias("normalized"),
        (~bad_host).alias("valid"),
        F.lit(repaired).alias("repaired"),
        F.when(bad_host, F.lit("malformed_domain")).cast("string").alias("issue"),
    )


#: A dot inside a host: every host holds one, and sentences do not.
INNER_DOT = r"\.[A-Za-z0-9\-]"


def _may_be_misread(text: Column) -> Column:
    """Cheap test that spares most texts the slow pattern."""
    low = F.lower(text)
    sign = low.contains("(a)") | low.contains("[at]") | low.contains("{at}") | low.contains("©") | low.contains("@")
    return text.rlike(INNER_DOT) & (sign | low.rlike(f"[{SPACE}]at[{SPACE}]"))


def emails(text: Column) -> Column:
    """Clean addresses first, then those whose '@' was misread; one per normalized form."""
    found = F.when(text.contains("@"), _matches(text, EMAIL)).otherwise(F.array().cast("array<string>"))
    clean = F.transform(found, lambda raw: _email(raw, raw, False))
    none = F.array().cast("array<string>")
    misread = F.when(
        _may_be_misread(text), F.filter(_matches(text, MANGLED_EMAIL), lambda raw: ~raw.rlike(EMAIL))
    ).otherwise(none)
    rebuilt = F.transform(
        misread,
        lambda raw: _email(
            raw,
            F.concat(
                F.regexp_extract(raw, MANGLED_EMAIL, 1), F.lit("@"), F.regexp_extract(raw, MANGLED_EMAIL, 2)
            ),
            True,
        ),
    )
    return keep_first(F.concat(clean, rebuilt), lambda e: e["normalized"], EMAIL_TYPE)


def _site(raw: Column) -> Column:
    lowered = F.lower(trim(raw))
    url = F.when(lowered.rlike("^https?://"), lowered).otherwise(F.concat(F.lit("https://"), lowered))

    def build(full: Column) -> Column:
        host = F.regexp_extract(full, r"^https?://([^/?#:]*)", 1)
        return F.struct(
            raw.alias("raw"), full.alias("url"), F.regexp_replace(host, r"^www\.", "").alias("domain")
        )

    return let(url, build)


def websites(text: Column) -> Column:
    """Links, then bare hosts with a known suffix; e-mail hosts do not count. One per domain."""

    def without_mail(rest: Column) -> Column:
        links = _matches(rest, URL)
        bare = F.filter(
            _matches(F.regexp_replace(rest, URL, " "), BARE_HOST),
            lambda m: F.lower(F.substring_index(m, "/", 1)).rlike(KNOWN_SUFFIX),
        )
        sites = F.transform(F.concat(links, bare), _site)
        return keep_first(
            F.filter(sites, lambda s: s["domain"].contains(".")), lambda s: s["domain"], SITE_TYPE
        )

    rest = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    dotted = let(rest, without_mail)
    return F.when(text.rlike(INNER_DOT), dotted).otherwise(F.array().cast(f"array<{SITE_TYPE}>"))


def email_domain(email: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(email, r"^[^@]*@(.+)$", 1)), r"^www\.", "")
    return F.when(host.contains("."), host)
