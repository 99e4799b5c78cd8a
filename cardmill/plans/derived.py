"""Contact-memory tables derived from the input tables, in Spark and, next to it, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.sources.tables import read_input

# --- cards = customers, their fields = four per order ---------------------------------------------


def card_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    issue = (
        F.when(F.col("o_orderpriority").startswith("1"), "digit_restored")
        .when(F.col("o_orderpriority").startswith("2"), "ocr_repaired")
        .when(F.col("o_orderpriority").startswith("3"), "tooShort")
    )
    value = (
        F.when(k == 0, F.concat(F.lit("Firm "), F.pmod(F.floor("o_totalprice"), F.lit(50)).cast("string")))
        .when(k == 1, F.concat_ws(" ", "o_orderstatus", "o_orderpriority"))
        .when(k == 2, F.concat(F.lit("017"), F.lpad(F.pmod("o_orderkey", F.lit(5000)).cast("string"), 8, "0")))
        .otherwise(F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@x.com")))
    )
    return (
        read_input(spark, d, "orders")
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .select(
            (F.col("o_orderkey") * 4 + k).alias("id"),
            F.col("o_custkey").alias("card_id"),
            F.element_at(F.array(*[F.lit(x) for x in ("company", "person_name", "phone", "email")]), k + 1).alias("field_key"),
            value.alias("value"),
            F.when((k >= 2) & (F.col("o_orderstatus") != "P"), F.when(k == 2, F.concat(F.lit("+88"), value)).otherwise(value)).alias(
                "normalized_value"
            ),
            F.when(F.col("o_orderstatus") == "F", "printed").when(F.col("o_orderstatus") == "O", "user").otherwise("aiInferred").alias("source"),
            (F.col("o_totalprice") > 400000).alias("verified_by_user"),
            issue.alias("validation_issue"),
            F.lit("text").alias("value_kind"),
        )
    )


FIELDS = """(SELECT *, CASE WHEN k >= 2 AND o_orderstatus <> 'P' THEN CASE WHEN k = 2 THEN '+88' || value ELSE value END END AS normalized_value FROM (
  SELECT o_orderkey * 4 + k AS id, k, o_orderstatus, o_custkey AS card_id, ['company','person_name','phone','email'][k + 1] AS field_key,
    CASE k WHEN 0 THEN 'Firm ' || (floor(o_totalprice)::BIGINT % 50) WHEN 1 THEN o_orderstatus || ' ' || o_orderpriority
      WHEN 2 THEN '017' || lpad((o_orderkey % 5000)::VARCHAR, 8, '0') ELSE 'u' || o_custkey || '@x.com' END AS value,
    CASE o_orderstatus WHEN 'F' THEN 'printed' WHEN 'O' THEN 'user' ELSE 'aiInferred' END AS source,
    o_totalprice > 400000 AS verified_by_user,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'digit_restored' WHEN '2' THEN 'ocr_repaired' WHEN '3' THEN 'tooShort' END AS validation_issue
  FROM orders, range(4) r(k)))"""


def customer_cards(spark: SparkSession, d: str) -> DataFrame:
    """One card per customer: captured at its first order, deleted when its balance is negative."""
    first = read_input(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("captured_at"))
    return (
        read_input(spark, d, "customer")
        .withColumnRenamed("c_custkey", "id")
        .join(first, "id", "left")
        .select(
            "id",
            F.coalesce("captured_at", F.lit("1990-01-01").cast("timestamp")).alias("captured_at"),
            F.when(F.col("c_acctbal") < 0, F.lit("2002-01-01").cast("timestamp")).alias("deleted_at"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "failed").when(F.col("c_mktsegment") == "BUILDING", "partial").otherwise("complete").alias("extraction_status"),
            F.when(F.col("c_acctbal") > 5000, F.col("id")).alias("person_id"),
            F.when(F.col("c_acctbal") > 8000, F.col("c_nationkey").cast("long")).alias("org_id"),
        )
    )


CARDS = """(SELECT c_custkey AS id, coalesce(f, TIMESTAMP '1990-01-01') AS captured_at, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2002-01-01' END AS deleted_at,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'failed' WHEN 'BUILDING' THEN 'partial' ELSE 'complete' END AS extraction_status,
  CASE WHEN c_acctbal > 5000 THEN c_custkey END AS person_id, CASE WHEN c_acctbal > 8000 THEN c_nationkey END AS org_id
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    return read_input(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.lit("card").alias("subject_type"),
        F.col("conv_id").alias("subject_id"),
        F.when(F.col("role") == "user", F.col("text")).alias("body"),
        F.when(F.col("role") != "user", F.col("text")).alias("transcript"),
    )


# --- people = customers, organizations = nations, cards = orders ----------------------------------


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers in debt are merged into the first customer in credit of their nation and segment."""
    c = read_input(spark, d, "customer")
    first = c.filter("c_acctbal >= 0").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first_id"))
    return c.join(first, ["c_nationkey", "c_mktsegment"], "left").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("display_name"),
        F.when(F.col("c_acctbal") < 0, F.col("first_id")).alias("merged_into_id"),
    )


PEOPLE = """(SELECT c_custkey AS id, c_name AS display_name, CASE WHEN c_acctbal < 0 THEN first_id END AS merged_into_id FROM customer LEFT JOIN
  (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS first_id FROM customer WHERE c_acctbal >= 0 GROUP BY ALL) USING (c_nationkey, c_mktsegment))"""


def order_cards(spark: SparkSession, d: str) -> DataFrame:
    c = read_input(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return read_input(spark, d, "orders").join(c, "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("captured_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
        F.col("o_custkey").alias("person_id"),
        F.col("c_nationkey").cast("long").alias("org_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("role_id"),
    )


ORDER_CARDS = """(SELECT o_orderkey AS id, o_orderdate AS captured_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at,
  o_custkey AS person_id, c_nationkey AS org_id, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS role_id FROM orders JOIN customer ON c_custkey = o_custkey)"""


def organizations(spark: SparkSession, d: str) -> DataFrame:
    return read_input(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lower("n_name"), F.lit(".com")).alias("domain")
    )


def branches(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of their nations; nation 3 has none, its suppliers belong to no organization."""
    org = F.when(F.col("s_nationkey") != 3, F.col("s_nationkey").cast("long"))
    return read_input(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), org.alias("org_id"), F.col("s_name").alias("address"), (F.col("s_acctbal") > 5000).alias("is_primary")
    )


BRANCHES = "(SELECT s_suppkey AS id, CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS org_id, s_name AS address, s_acctbal > 5000 AS is_primary FROM supplier)"


def roles(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's role in its nation; those of one segment are nobody's."""
    return read_input(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_custkey")).alias("person_id"),
        F.col("c_nationkey").cast("long").alias("org_id"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.lower("c_mktsegment")).alias("title"),
        (F.col("c_acctbal") > 1000).alias("is_current"),
    )


ROLES = """(SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_custkey END AS person_id, c_nationkey AS org_id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN lower(c_mktsegment) END AS title,
  c_acctbal > 1000 AS is_current FROM customer)"""


def contact_points(spark: SparkSession, d: str) -> DataFrame:
    """The phone and e-mail rows of the card fields, owned by the customer."""
    return card_fields(spark, d).filter(F.col("field_key").isin("phone", "email")).select(
        F.lit("person").alias("owner_type"),
        F.col("card_id").alias("owner_id"),
        F.col("field_key").alias("kind"),
        "value",
        "normalized_value",
        F.lit(None).cast("string").alias("label"),
        F.when(F.col("source") == "user", F.col("card_id")).alias("role_id"),
        F.col("card_id").alias("source_card_id"),
        "source",
        F.col("id").alias("ord"),
        F.lit(0).cast("long").alias("field_id"),
    )


POINTS = f"(SELECT id AS ord, card_id AS owner_id, field_key AS kind, value, normalized_value, CASE WHEN source = 'user' THEN card_id END AS role_id, source FROM {FIELDS} WHERE field_key IN ('phone', 'email'))"



def office_points(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' numbers, owned by their nation; each is there twice, as the last of them reads."""
    s = read_input(spark, d, "supplier").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return s.select(
        F.lit("organization").alias("owner_type"),
        F.col("s_nationkey").cast("long").alias("owner_id"),
        F.lit("phone").alias("kind"),
        F.concat(F.lit("0"), (F.col("s_suppkey") - F.pmod("s_suppkey", F.lit(2))).cast("string")).alias("value"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("+"), F.col("s_suppkey").cast("string"))).alias("normalized_value"),
        F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("long").alias("role_id"),
        F.lit(None).cast("long").alias("source_card_id"),
        F.lit("user").alias("source"),
        (F.col("s_suppkey") * 2 + F.col("k")).alias("ord"),
        F.lit(0).cast("long").alias("field_id"),
    )


OFFICE_POINTS = """(SELECT s_nationkey AS owner_id, '0' || (s_suppkey - s_suppkey % 2) AS value, CASE WHEN s_acctbal > 0 THEN '+' || s_suppkey END AS normalized_value, s_suppkey * 2 + k AS ord
  FROM supplier, range(2) r(k))"""


def card_links(spark: SparkSession, d: str) -> DataFrame:
    """Every order's card with its turn, the person and organization it leads to (either may be missing), what it says of them."""
    c = read_input(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment", "c_acctbal")
    o = read_input(spark, d, "orders").join(c, "o_custkey")
    street = F.concat(F.lit(" House "), F.floor(F.col("c_acctbal") / 1000).cast("string"), F.lit(", Road  "))
    return o.select(
        F.col("o_orderkey").alias("card_id"),
        F.col("o_orderkey").alias("ord"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("person_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("c_nationkey").cast("long")).alias("org_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lower("o_orderpriority")).alias("designation"),
        F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, F.upper(street)).otherwise(street)).alias("address"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("role_id"),
    )


LINKS = """(SELECT *, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN upper(street) ELSE street END END AS address FROM (
  SELECT o_orderkey AS card_id, o_orderkey AS ord, o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS person_id,
  CASE WHEN o_orderpriority <> '5-LOW' THEN c_nationkey END AS org_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN lower(o_orderpriority) END AS designation,
  CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS role_id, ' House ' || floor(c_acctbal / 1000)::BIGINT || ', Road  ' AS street FROM orders JOIN customer ON c_custkey = o_custkey))"""

# --- scans: one card per order, for resolution ----------------------------------------------------


def scanned_cards(spark: SparkSession, d: str) -> DataFrame:
    return read_input(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("captured_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
    )


def scanned_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of every order's card: its customer's name, segment and nation, own and shared numbers.

    Half of a customer's orders carry its own number, urgent ones a mailbox shared by price band, and
    every customer of one segment and nation an office number: shared contacts of all sizes.
    """
    nation = read_input(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = (
        read_input(spark, d, "orders")
        .join(read_input(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, "c_nationkey")
    )
    none = F.lit(None).cast("string")
    cust = F.col("o_custkey").cast("string")
    own = F.concat(F.lit("+88017"), F.lpad(cust, 8, "0"))
    office = F.concat(F.lit("+8802"), F.lpad(F.hash("c_mktsegment", "c_nationkey").cast("string"), 7, "1"))
    mailbox = F.concat(F.lit("desk"), F.floor(F.col("o_totalprice") / 50).cast("string"), F.lit("@x.com"))
    firm = F.concat_ws(" ", F.initcap("c_mktsegment"), F.col("n_name"), F.when(F.col("o_orderstatus") == "F", "Ltd").otherwise("Traders"))

    def item(key: str, when, value, normalized=none):
        return F.when(when, F.struct(F.lit(key).alias("field_key"), value.alias("value"), normalized.alias("normalized_value")))

    items = F.array_compact(
        F.array(
            item("person_name", F.col("o_orderstatus") != "O", F.concat(F.lit("Md. "), F.col("c_name"))),
            item("company", F.col("o_orderpriority") != "5-LOW", firm),
            item("designation", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lower("o_orderpriority")),
            item("phone", F.pmod(F.floor("o_totalprice"), F.lit(2)) == 0, own, own),
            item("phone", F.col("o_orderpriority") == "3-MEDIUM", office, office),
            item("email", F.col("o_orderpriority") == "1-URGENT", mailbox, mailbox),
            item(
                "website", F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lower("n_name"), F.lit(".com")),
                F.concat(F.lower("c_mktsegment"), F.lit("."), F.lower("n_name"), F.lit(".com")),
            ),
            item("address", F.col("o_orderstatus") == "F", F.concat(F.lit("House "), F.col("c_nationkey"), F.lit(", Road "), F.lower("c_mktsegment"))),
        )
    )
    return rows.select("o_orderkey", F.posexplode(items).alias("k", "f")).select(
        (F.col("o_orderkey") * 16 + F.col("k")).alias("id"),
        F.col("o_orderkey").alias("card_id"),
        "f.*",
        F.lit("printed").alias("source"),
        F.lit("text").alias("value_kind"),
    )


# --- blocks: the lines of every document ----------------------------------------------------------


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a card whose blocks are its lines; type gets smaller from line to line, in turns."""
    lines = read_input(spark, d, "documents").select(
        F.col("doc_id").alias("card_id"), F.posexplode(F.split("text", "\n")).alias("order_index", "text")
    )
    size = 12.0 + 4.0 * F.pmod(F.length("text"), F.lit(8))
    return lines.select(
        "card_id",
        "order_index",
        "text",
        F.lit(10.0).alias("left"),
        (F.col("order_index") * 44.0).alias("top"),
        (F.lit(60.0) + 8.0 * F.length("text")).alias("right"),
        (F.col("order_index") * 44.0 + size).alias("bottom"),
        F.when(F.pmod("order_index", F.lit(5)) == 4, -1.0).otherwise(0.9).alias("confidence"),
    )
