"""vCard 3.0 text pieces as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill.functions.text import SPACE, let, trim


def escape(col: Column) -> Column:
    slashed = F.regexp_replace(col, r"([\\;,])", r"\\$1")
    return F.regexp_replace(slashed, r"\r\n|\n|\r", r"\\n")


def structured_name(col: Column) -> Column:
    """Last token is the family name, the others are given; a single token stays whole."""

    def build(parts: Column) -> Column:
        given = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " ")
        return F.when(F.size(parts) < 2, F.concat(escape(col), F.lit(";;;;"))).otherwise(
            F.concat(escape(F.element_at(parts, -1)), F.lit(";"), escape(given), F.lit(";;;"))
        )

    return let(F.filter(F.split(col, f"[{SPACE}]+"), lambda p: p != ""), build)


def tel_type(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(low.contains("mobile") | low.contains("cell"), "CELL")
        .when(low.contains("home"), "HOME")
        .when(low.contains("fax"), "FAX")
        .otherwise("WORK")
    )


def endpoint_line(kind: Column, value: Column, label: Column) -> Column:
    text = escape(trim(value))
    return F.when(
        trim(value) != "",
        F.when(kind.isin("phone", "whatsapp"), F.concat(F.lit("TEL;TYPE="), tel_type(label), F.lit(":"), text))
        .when(kind == "email", F.concat(F.lit("EMAIL;TYPE=INTERNET:"), text))
        .when(kind.isin("website", "social"), F.concat(F.lit("URL:"), text))
        .when(kind == "fax", F.concat(F.lit("TEL;TYPE=FAX:"), text)),
    )


def vcard(name, organization, title, address, website, note, endpoints) -> Column:
    """One contact; ``endpoints`` is array<struct<kind,value,label>>. Blank parts are left out."""

    def line(prefix: str, col: Column, suffix: str = "") -> Column:
        return F.when(trim(col) != "", F.concat(F.lit(prefix), escape(trim(col)), F.lit(suffix)))

    shown = F.coalesce(
        F.nullif(trim(name), F.lit("")), F.nullif(trim(organization), F.lit("")), F.lit("Unnamed contact")
    )

    def body(full_name: Column) -> Column:
        lines = F.concat(
            F.array(
                F.lit("BEGIN:VCARD"),
                F.lit("VERSION:3.0"),
                F.concat(F.lit("FN:"), escape(full_name)),
                F.concat(F.lit("N:"), structured_name(full_name)),
                line("ORG:", organization),
                line("TITLE:", title),
            ),
            F.transform(endpoints, lambda e: endpoint_line(e["kind"], e["value"], e["label"])),
            F.array(
                line("URL:", website),
                line("ADR;TYPE=WORK:;;", address, ";;;;"),
                line("NOTE:", note),
                F.lit("END:VCARD"),
            ),
        )
        return F.concat(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\r\n"), F.lit("\r\n"))

    return let(shown, body)


def safe_file_name(col: Column) -> Column:
    kept = F.regexp_replace(trim(col), "[^A-Za-z0-9 _-]", "")
    return F.coalesce(F.nullif(F.regexp_replace(kept, " +", "_"), F.lit("")), F.lit("contact"))
