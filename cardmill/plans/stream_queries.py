"""Registered queries whose result a stream has kept up to date, next to the SQL of computing it at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.operators import ranking
from cardmill.plans import card_queries as C
from cardmill.plans import derived as D
from cardmill.plans import search_queries as SQ
from cardmill.plans import sql as S
from cardmill.plans.text_queries import subjects
from cardmill.session import checkpoint_root, written
from cardmill.sources.tables import read_input
from cardmill.streaming import feedback, jobs, lists, promotion, search_index

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


#: Rows of a file of a stream: what one task reads does not grow with the table.
ROWS_PER_FILE = 100_000


def dealt(spark: SparkSession, table: DataFrame, where: str, files: int = 4) -> DataFrame:
    """The table as a stream of ``files`` files in no order of time, or of more if they grow large; half of them a batch."""
    files = max(files, 2 * -(-table.count() // (2 * ROWS_PER_FILE)))
    table.repartition(files, F.xxhash64(*table.columns)).write.parquet(where)
    return jobs.read_changes(spark, where, files_per_batch=files // 2)


def event_stream(spark: SparkSession, d: str, where: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return dealt(spark, events.select("event_id", "ts", "user_id", "event_type"), f"{where}/in")


@query(
    "stream_trust",
    """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS useful, count(*) FILTER (event_type = 'error') AS not_relevant,
      round((count(*) FILTER (event_type = 'purchase') + 1) / (count(*) FILTER (event_type IN ('purchase', 'error')) + 2), 6) AS trust FROM events GROUP BY user_id""",
)
def stream_trust(spark, d):
    """Purchases speak for a user, errors against; every third event comes twice, in whatever batches it falls."""
    verdict = F.when(F.col("event_type") == "purchase", "useful").when(F.col("event_type") == "error", "not_relevant")
    where = scratch(spark)
    events = read_input(spark, d, "events").select("event_id", "user_id", verdict.alias("verdict"), F.lit(0).alias("copy"))
    twice = events.unionByName(events.filter("event_id % 3 = 0").withColumn("copy", F.lit(1)))
    store = feedback.trust_store(spark, f"{where}/trust", "user_id")
    feedback.trust_stream(dealt(spark, twice, f"{where}/in"), "user_id", store, f"{where}/state").awaitTermination()
    return feedback.current_trust(store).select("user_id", "useful", "not_relevant", F.round("trust", 6).alias("trust"))


def card_versions(spark: SparkSession, d: str) -> DataFrame:
    """Every order's card twice: outdated, a month later and with its neighbour as the person, and as it is."""
    now = D.order_cards(spark, d).select("id", "captured_at", "deleted_at", "person_id", "org_id", F.lit(1).cast("long").alias("stamp"))
    old = now.select(
        "id",
        (F.col("captured_at") + F.expr("INTERVAL 30 DAYS")).alias("captured_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        (F.col("person_id") + 1).alias("person_id"),
        F.pmod(F.col("org_id") + 1, F.lit(25)).alias("org_id"),
        F.lit(0).cast("long").alias("stamp"),
    )
    return now.unionByName(old)


def _kept_lists(spark: SparkSession, d: str):
    where = scratch(spark)
    store = lists.list_store(spark, f"{where}/lists")
    lists.lists_stream(dealt(spark, card_versions(spark, d), f"{where}/in"), store, f"{where}/state").awaitTermination()
    return store


@query("stream_people_list", C.ORACLES["people_list"])
def stream_people_list(spark, d):
    return C._listed(lists.kept_people_list(_kept_lists(spark, d), D.people(spark, d)))


@query("stream_org_list", C.ORACLES["org_list"])
def stream_org_list(spark, d):
    return C._listed(lists.kept_org_list(_kept_lists(spark, d), D.organizations(spark, d), D.branches(spark, d)))


def text_versions(texts: DataFrame) -> DataFrame:
    """Every subject's texts twice, outdated ones before, and a subject that is gone by now."""
    now = texts.withColumn("stamp", F.lit(1).cast("long")).withColumn("gone", F.lit(False))
    old = now.withColumn("card_text", F.concat(F.lit("outdated "), "card_text")).withColumn("stamp", F.lit(0).cast("long"))
    negative = old.withColumn("subject_id", -F.col("subject_id") - 1)
    return now.unionByName(old).unionByName(negative).unionByName(
        negative.withColumn("stamp", F.lit(1).cast("long")).withColumn("gone", F.lit(True)).withColumn("card_text", F.lit(None).cast("string"))
    )


@query(
    "stream_index",
    f"SELECT subject_id, term, count(*) AS tf FROM (SELECT doc_id AS subject_id, unnest({S.index_terms('text')}) AS term FROM documents) GROUP BY ALL",
)
def stream_index(spark, d):
    """Every document comes as an outdated and as a current text, in any order; the current one is what is found."""
    where = scratch(spark)
    docs = read_input(spark, d, "documents").select(F.col("doc_id").alias("subject_id"), F.col("text").alias("card_text"))
    store = search_index.index_store(spark, f"{where}/index")
    changes = dealt(spark, text_versions(docs), f"{where}/in")
    search_index.index_stream(changes, store, f"{where}/state", columns=["card_text"]).awaitTermination()
    return store.read("postings").select("subject_id", "term", "tf")


@query("stream_search", SQ.ORACLES["rrf_fusion"])
def stream_search(spark, d):
    """Both arms of the search read the index and the vectors that a stream of changes has left in the store."""
    where = scratch(spark)
    store = search_index.index_store(spark, f"{where}/index")
    changes = dealt(spark, text_versions(subjects(spark, d)), f"{where}/in")
    tokens = SQ.token_table(spark, d)
    search_index.index_stream(changes, store, f"{where}/state", tokens, vector_text="card_text").awaitTermination()
    asks = SQ.query_set(spark, d)
    asked = search_index.query_vectors(asks, tokens)
    fused = ranking.rrf(search_index.stored_lexical_arm(asks, store), search_index.stored_vector_arm(asks, asked, store))
    return fused.select(
        "query_id", "subject_id", F.round("fused_score", 9).alias("fused_score"), "lexical_rank", "vector_rank", "found_by_both", "semantic_only"
    )


def numbered_scans(spark: SparkSession, d: str) -> DataFrame:
    """Fields of every order's card: its customer's name and number, and the site of its customer's segment and nation."""
    rows = read_input(spark, d, "orders").join(read_input(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    number = F.concat(F.lit("+88017"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    site = F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit(".com"))
    none = F.lit(None).cast("string")
    item = lambda key, value, normalized: F.struct(F.lit(key).alias("field_key"), value.alias("value"), normalized.alias("normalized_value"))
    items = F.array(item("person_name", F.col("c_name"), none), item("phone", number, number), item("website", site, site))
    return rows.select("o_orderkey", F.posexplode(items).alias("k", "f")).select(
        (F.col("o_orderkey") * 4 + F.col("k")).alias("id"), F.col("o_orderkey").alias("card_id"), "f.*",
        F.lit("printed").alias("source"), F.lit("text").alias("value_kind"),
    )


@query(
    "stream_promotion",
    """WITH c AS (SELECT o_orderkey AS card_id, o_orderstatus <> 'P' AS lives, c_custkey AS person, c_mktsegment || c_nationkey AS org
      FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT card_id, CASE WHEN lives THEN min(card_id) FILTER (lives) OVER (PARTITION BY person) END AS person_card,
      CASE WHEN lives THEN min(card_id) FILTER (lives) OVER (PARTITION BY org) END AS org_card,
      CASE WHEN lives THEN min(card_id) FILTER (lives) OVER (PARTITION BY person, org) END AS role_card,
      lives::INT AS n_points FROM c""",
)
def stream_promotion(spark, d):
    """Cards of all orders arrive in batches, one of which is sent twice; people, firms and roles are shown by their first cards."""
    where = scratch(spark)
    fields = written(numbered_scans(spark, d))
    store = promotion.graph_store(spark, f"{where}/graph")
    cards = D.scanned_cards(spark, d)
    promotion.promotion_stream(dealt(spark, cards, f"{where}/in"), fields, store, f"{where}/state").awaitTermination()
    promotion.promote_batch(store, cards.limit(100), fields, 1)  # a replay: without effect
    linked = written(promotion.stored_graph(store).cards)
    points = store.read("contact_points").groupBy(F.col("source_card_id").alias("id")).agg(F.count("*").cast("int").alias("n_points"))
    for owner in ("person", "org", "role"):
        first = linked.dropna(subset=[f"{owner}_id"]).groupBy(f"{owner}_id").agg(F.min("id").alias(f"{owner}_card"))
        linked = linked.join(first, f"{owner}_id", "left")
    return linked.join(points, "id", "left").select(
        F.col("id").alias("card_id"), "person_card", "org_card", "role_card", F.coalesce("n_points", F.lit(0)).alias("n_points")
    )


@query(
    "stream_final_deletes",
    """WITH e AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_type IN ('error', 'signup'))
    SELECT event_id AS delete_id, user_id AS subject FROM e WHERE event_type = 'error'
      AND ts + INTERVAL 6 HOUR < (SELECT max(ts) FROM e)
      AND NOT EXISTS (SELECT 1 FROM e r WHERE r.event_type = 'signup' AND r.user_id = e.user_id AND r.ts >= e.ts AND r.ts <= e.ts + INTERVAL 6 HOUR)""",
)
def stream_final_deletes(spark, d):
    """Errors as deletes, signups as restores, six hours to undo; deletes still open at the end are held back."""
    where = scratch(spark)
    action = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "restore")
    events = event_stream(spark, d, where).withColumn("action", action)
    jobs.final_delete_stream(events, "user_id", f"{where}/out", f"{where}/state", seconds=6 * 3600).awaitTermination()
    final = jobs.final_deletes_of(spark, "user_id", f"{where}/out", seconds=6 * 3600)
    return final.select("delete_id", F.col("user_id").alias("subject"))
