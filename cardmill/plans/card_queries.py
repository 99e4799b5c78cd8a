"""Registered queries over card, field, people and evaluation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.operators import evaluation as E
from cardmill.operators import fields as FL
from cardmill.operators import graph as G
from cardmill.operators import candidates, layout, lexical, lifecycle
from cardmill.operators.ordering import global_position
from cardmill.operators.resolve import card_facts, endpoint_keys, resolve_orgs, resolve_people
from cardmill.plans import derived as D
from cardmill.plans import sql as S
from cardmill.plans.text_queries import SUBJECTS, subjects
from cardmill.session import written
from cardmill.sources import contact_export
from cardmill.sources.tables import read_input, spread, validity

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def shown(ts: str):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# --- fields --------------------------------------------------------------------------------------


def _first_sql(key: str, value: str = "value", when: str = "TRUE") -> str:
    return f"arg_min({value}, id) FILTER (field_key = '{key}' AND {when})"


@query(
    "first_of_key_pivot",
    "SELECT card_id, " + ", ".join(f"{_first_sql(k)} AS {k}" for k in fixed.FIELD_KEYS) + f" FROM {D.FIELDS} GROUP BY card_id",
)
def first_of_key_pivot(spark, d):
    return FL.first_of_key(D.card_fields(spark, d))


@query(
    "card_summaries",
    f"""SELECT c.id AS subject_id, coalesce(company, person_name, phone) AS title, coalesce(person_name, phone) AS subtitle, note,
      strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at
    FROM {D.CARDS} c LEFT JOIN (SELECT card_id, {_first_sql('company')} AS company, {_first_sql('person_name')} AS person_name, {_first_sql('phone')} AS phone FROM {D.FIELDS} GROUP BY card_id) f ON f.card_id = c.id
    LEFT JOIN (SELECT conv_id, CASE WHEN arg_min(role, turn) = 'user' THEN arg_min(text, turn) END AS note FROM conversations GROUP BY conv_id) n ON conv_id = c.id
    WHERE deleted_at IS NULL""",
)
def card_summaries(spark, d):
    made = FL.card_summaries(D.customer_cards(spark, d), D.card_fields(spark, d), D.notes(spark, d))
    return made.withColumn("captured_at", shown("captured_at"))


@query(
    "index_text",
    f"""SELECT c.id AS subject_id, md5(coalesce(vals, '')) AS card_text_md5, md5(coalesce(note, '')) AS note_text_md5 FROM {D.CARDS} c
    LEFT JOIN (SELECT card_id, string_agg(value, chr(10) ORDER BY id) AS vals FROM {D.FIELDS} GROUP BY card_id) f ON f.card_id = c.id
    LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER ({S.trim('text')} <> '') AS note FROM conversations GROUP BY conv_id) n ON conv_id = c.id""",
)
def index_text(spark, d):
    cards = D.customer_cards(spark, d).withColumn("raw_ocr_text", F.lit(None).cast("string"))
    made = lexical.index_text(cards, D.card_fields(spark, d), D.notes(spark, d))
    return made.select("subject_id", F.md5("card_text").alias("card_text_md5"), F.md5("note_text").alias("note_text_md5"))


@query(
    "provenance_labels",
    f"""SELECT id, coalesce(validation_issue NOT IN ('digit_restored', 'ocr_repaired'), FALSE) AS needs_a_look,
      CASE WHEN validation_issue NOT IN ('digit_restored', 'ocr_repaired') THEN 'needs a look' WHEN verified_by_user THEN 'you confirmed'
        WHEN validation_issue = 'digit_restored' THEN 'digit restored' WHEN validation_issue = 'ocr_repaired' THEN 'OCR repaired'
        WHEN source = 'printed' THEN 'on the card' WHEN source = 'user' THEN 'you typed' ELSE 'guess' END AS label FROM {D.FIELDS}""",
)
def provenance_labels(spark, d):
    issue = F.col("validation_issue")
    return D.card_fields(spark, d).select(
        "id", FL.needs_a_look(issue).alias("needs_a_look"), FL.provenance_label(issue, F.col("verified_by_user"), F.col("source")).alias("label")
    )


@query(
    "useful_cards",
    f"""SELECT card_id, coalesce(bool_or(k = 'phone') OR bool_or(k = 'email') OR (bool_or(k = 'person_name') AND bool_or(k = 'company')), FALSE) AS is_useful
    FROM (SELECT card_id, CASE WHEN source = 'user' OR field_key = 'company' THEN field_key ELSE 'unknown' END AS k FROM {D.FIELDS}) GROUP BY card_id""",
)
def useful_cards(spark, d):
    """Of fields nobody typed all but the company are of an unknown kind."""
    known = F.when((F.col("source") == "user") | (F.col("field_key") == "company"), F.col("field_key")).otherwise("unknown")
    return FL.is_useful(D.card_fields(spark, d).withColumn("field_key", known))


@query(
    "endpoint_dedupe",
    f"""SELECT owner_id, kind, value, normalized_value, ord FROM {D.POINTS}
    QUALIFY row_number() OVER (PARTITION BY owner_id, kind, coalesce(normalized_value, value) ORDER BY ord) = 1""",
)
def endpoint_dedupe(spark, d):
    return G.distinct_endpoints(D.contact_points(spark, d), "owner_id").select("owner_id", "kind", "value", "normalized_value", "ord")


@query(
    "endpoint_overlap",
    f"""SELECT k.card_id, o.owner_id, sum(n) AS n FROM
      (SELECT DISTINCT card_id, normalized_value AS key FROM {D.FIELDS} WHERE field_key IN ('phone', 'email') AND normalized_value IS NOT NULL) k
      JOIN (SELECT normalized_value AS key, owner_id, count(*) AS n FROM {D.POINTS} WHERE normalized_value IS NOT NULL GROUP BY ALL) o USING (key) GROUP BY ALL""",
)
def endpoint_overlap(spark, d):
    return G.endpoint_overlap(endpoint_keys(D.card_fields(spark, d)), D.contact_points(spark, d))


@query(
    "card_facts",
    f"""SELECT card_id, {_first_sql('person_name')} AS name, {_first_sql('company')} AS company,
      count(*) FILTER (field_key IN ('phone', 'email') AND normalized_value IS NOT NULL) AS n_endpoints FROM {D.FIELDS} GROUP BY card_id""",
)
def facts(spark, d):
    return card_facts(D.card_fields(spark, d)).select("card_id", "name", "company", "n_endpoints")


_SOURCE_RANK = "CASE WHEN verified_by_user THEN 0 WHEN source = 'user' THEN 2 WHEN source = 'printed' THEN 3 ELSE 4 END"


@query(
    "winning_value",
    f"SELECT card_id, field_key, value FROM {D.FIELDS} QUALIFY row_number() OVER (PARTITION BY card_id, field_key ORDER BY {_SOURCE_RANK}, id) = 1",
)
def winning_value(spark, d):
    return lifecycle.winning_value(D.card_fields(spark, d))


@query(
    "attention_queue",
    f"""SELECT id, extraction_status, row_number() OVER (ORDER BY captured_at NULLS FIRST, id) - 1 AS position
    FROM {D.CARDS} WHERE deleted_at IS NULL AND extraction_status IN ('failed', 'partial')""",
)
def attention_queue(spark, d):
    waiting = FL.attention_queue(D.customer_cards(spark, d)).select("id", "extraction_status", "captured_at")
    return global_position(waiting, [F.asc("captured_at"), F.asc("id")], "position").drop("captured_at")


@query("trash", f"SELECT id FROM {D.CARDS} WHERE deleted_at IS NOT NULL")
def trash(spark, d):
    return FL.trash(D.customer_cards(spark, d)).select("id")


@query("contact_filter", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '42') OR contains(lower(c_mktsegment), '42')")
def contact_filter(spark, d):
    return FL.contains_ci(read_input(spark, d, "customer"), ["c_name", "c_mktsegment"], " 42").select("c_custkey", "c_name")


@query(
    "needs_indexing",
    f"SELECT id FROM {D.CARDS} WHERE deleted_at IS NULL AND id NOT IN (SELECT doc_id FROM labels)",
)
def needs_indexing(spark, d):
    return FL.needs_indexing(D.customer_cards(spark, d), read_input(spark, d, "labels").select(F.col("doc_id").alias("subject_id")))


@query(
    "needs_promotion",
    f"""SELECT id, person_id FROM {D.CARDS} WHERE deleted_at IS NULL AND ((person_id IS NULL AND org_id IS NULL)
      OR id IN (SELECT owner_id FROM {D.POINTS} WHERE normalized_value IS NULL))""",
)
def needs_promotion(spark, d):
    return FL.needs_promotion(D.customer_cards(spark, d), D.contact_points(spark, d)).select("id", "person_id")


@query("valid_people", "SELECT c_custkey AS id, length(c_name) BETWEEN 1 AND 200 AS valid FROM customer")
def valid_people(spark, d):
    return D.people(spark, d).select("id", validity("people").alias("valid"))


# --- lifecycle -----------------------------------------------------------------------------------


@query(
    "reextraction",
    f"""WITH f AS (SELECT *, id % 4 AS k2 FROM {D.FIELDS}), fresh AS (SELECT * FROM f WHERE source = 'user'), base AS (SELECT * FROM f WHERE source <> 'user')
    SELECT id FROM base WHERE verified_by_user OR card_id NOT IN (SELECT card_id FROM fresh)
    UNION ALL SELECT id FROM fresh x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.verified_by_user AND b.card_id = x.card_id AND b.field_key = x.field_key)""",
)
def reextraction(spark, d):
    """The fields users entered arrive as a fresh extraction over all the others."""
    f = D.card_fields(spark, d)
    return lifecycle.upsert_extraction(f.filter("source <> 'user'"), f.filter("source = 'user'")).select("id")


def edit_log(spark: SparkSession, d: str) -> DataFrame:
    """One edit per order line on the first field of its order; the line's date is when."""
    return read_input(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 4 + 2).alias("field_id"),
        F.col("l_shipdate").alias("at"),
        (F.col("l_partkey") * 100000 + F.floor("l_extendedprice")).alias("seq"),
        F.concat(F.lit("018"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("value"),
        F.lit(None).cast("string").alias("field_key"),
        (F.col("l_returnflag") == "R").alias("deleted"),
    )


@query(
    "field_corrections",
    f"""WITH e AS (SELECT l_orderkey * 4 + 2 AS id, '018' || lpad(l_partkey::VARCHAR, 8, '0') AS v, l_returnflag = 'R' AS gone FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey * 100000 + floor(l_extendedprice)::BIGINT DESC) = 1)
    SELECT f.id, coalesce(v, value) AS value, CASE WHEN e.id IS NULL THEN normalized_value ELSE '+88' || v END AS normalized_value,
      CASE WHEN e.id IS NULL THEN source ELSE 'user' END AS source, e.id IS NOT NULL OR verified_by_user AS verified_by_user,
      CASE WHEN e.id IS NULL THEN validation_issue END AS validation_issue
    FROM {D.FIELDS} f LEFT JOIN e ON e.id = f.id WHERE NOT coalesce(gone, FALSE)""",
)
def field_corrections(spark, d):
    return lifecycle.apply_edits(D.card_fields(spark, d), edit_log(spark, d)).select(
        "id", "value", "normalized_value", "source", "verified_by_user", "validation_issue"
    )


@query(
    "edit_interactions",
    "SELECT o_custkey AS subject_id, count(*) AS edits FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey",
)
def edit_interactions(spark, d):
    log = lifecycle.edit_interactions(D.card_fields(spark, d), edit_log(spark, d))
    return log.groupBy("subject_id").agg(F.count("*").alias("edits"))


@query(
    "soft_delete_restore",
    f"""WITH log AS (SELECT user_id AS id, event_type = 'error' AS del, ts FROM events WHERE event_type IN ('error', 'signup')
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) = 1)
    SELECT c.id, CASE WHEN log.id IS NULL THEN deleted_at IS NOT NULL ELSE del END AS deleted FROM {D.CARDS} c LEFT JOIN log ON log.id = c.id""",
)
def soft_delete_restore(spark, d):
    log = read_input(spark, d, "events").filter(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("restore").alias("action"), F.col("ts").alias("at")
    )
    made = lifecycle.apply_tombstones(D.customer_cards(spark, d), log)
    return made.select("id", F.col("deleted_at").isNotNull().alias("deleted"))


@query(
    "purge",
    f"""SELECT 'cards' AS tbl, count(*) AS n FROM {D.CARDS} WHERE deleted_at IS NULL
    UNION ALL SELECT 'fields', count(*) FROM {D.FIELDS} WHERE card_id NOT IN (SELECT id FROM {D.CARDS} WHERE deleted_at IS NOT NULL)
    UNION ALL SELECT 'notes', count(*) FROM conversations WHERE conv_id NOT IN (SELECT id FROM {D.CARDS} WHERE deleted_at IS NOT NULL)""",
)
def purge(spark, d):
    cards = D.customer_cards(spark, d)
    left = lifecycle.purge(
        {"cards": (cards, "id"), "fields": (D.card_fields(spark, d), "card_id"), "notes": (D.notes(spark, d), "subject_id")}, FL.trash(cards)
    )
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_GONE = f"(SELECT id FROM {D.CARDS} WHERE deleted_at IS NOT NULL)"


@query(
    "purge_cascade",
    f"""SELECT 'cards' AS tbl, id AS card_id, 1 AS n, 0 AS n_linked FROM {D.CARDS} WHERE deleted_at IS NULL
    UNION ALL SELECT 'card_fields', card_id, count(*), 0 FROM {D.FIELDS} WHERE card_id NOT IN {_GONE} GROUP BY card_id
    UNION ALL SELECT 'contact_points', owner_id, count(*), 0 FROM {D.POINTS} WHERE owner_id NOT IN {_GONE} GROUP BY owner_id
    UNION ALL SELECT 'notes', conv_id, count(*), 0 FROM conversations WHERE conv_id NOT IN {_GONE} GROUP BY conv_id
    UNION ALL SELECT 'ocr_blocks', doc_id, count(*), count(*) FILTER (doc_id * 4 NOT IN (SELECT id FROM {D.FIELDS} WHERE card_id IN {_GONE}))
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) WHERE doc_id NOT IN {_GONE} GROUP BY doc_id
    UNION ALL SELECT 'postings', doc_id, count(DISTINCT term), 0 FROM (SELECT doc_id, unnest({S.index_terms('text')}) AS term FROM documents) WHERE doc_id NOT IN {_GONE} GROUP BY doc_id
    UNION ALL SELECT 'vectors', vec_id, 1, 0 FROM embeddings WHERE vec_id NOT IN {_GONE}""",
)
def purge_cascade(spark, d):
    """What is left of every table, card by card, once the trash is emptied; blocks may lose fields of other cards."""
    cards = D.customer_cards(spark, d)
    texts = read_input(spark, d, "documents").select(F.col("doc_id").alias("subject_id"), F.col("text").alias("card_text"))
    tables = {
        "cards": cards,
        "card_fields": D.card_fields(spark, d),
        "contact_points": D.contact_points(spark, d),
        "notes": D.notes(spark, d),
        "ocr_blocks": D.line_blocks(spark, d).withColumn("field_id", F.col("card_id") * 4),
        "postings": lexical.build_postings(texts, ["card_text"]),
        "vectors": read_input(spark, d, "embeddings").select(F.col("vec_id").alias("subject_id"), F.col("embedding").alias("vector")),
    }
    left = lifecycle.purge_cascade(tables, {"cards": FL.trash(cards)})
    owner = {"cards": "id", "contact_points": "source_card_id", "notes": "subject_id", "postings": "subject_id", "vectors": "subject_id"}
    rows = None
    for name, df in left.items():
        linked = F.count("field_id") if name == "ocr_blocks" else F.lit(0)
        part = df.groupBy(F.col(owner.get(name, "card_id")).alias("card_id")).agg(F.count("*").alias("n"), linked.cast("long").alias("n_linked"))
        part = part.select(F.lit(name).alias("tbl"), "card_id", "n", "n_linked")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    "extraction_status",
    f"""SELECT c.id AS card_id, CASE WHEN coalesce(lines, 0) = 0 THEN CASE WHEN typed THEN 'manual' WHEN lines IS NULL THEN 'pending' ELSE 'failed' END
      WHEN useful THEN 'complete' ELSE 'partial' END AS extraction_status
    FROM {D.CARDS} c LEFT JOIN (SELECT card_id, bool_or(source = 'user') AS typed, bool_or(source <> 'printed' AND field_key IN ('phone', 'email')) OR (bool_or(source <> 'printed' AND field_key = 'person_name') AND bool_or(source <> 'printed' AND field_key = 'company')) AS useful FROM {D.FIELDS} GROUP BY card_id) f ON f.card_id = c.id
    LEFT JOIN (SELECT doc_id, count(*) FILTER ({S.trim('line')} <> '') AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id) b ON b.doc_id = c.id""",
)
def extraction_status(spark, d):
    known = F.when(F.col("source") != "printed", F.col("field_key")).otherwise("unknown")
    f = D.card_fields(spark, d).withColumn("field_key", known)
    return lifecycle.extraction_status(D.customer_cards(spark, d), f, D.line_blocks(spark, d))


@query(
    "index_refresh",
    f"""SELECT subject_id, count(*) AS n_terms FROM (
      SELECT doc_id AS subject_id, unnest(list_distinct({S.index_terms('text')})) AS term FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT subject_id, unnest(list_distinct({S.index_terms('note_text')})) FROM {SUBJECTS} WHERE subject_id IN (SELECT doc_id FROM labels)) GROUP BY subject_id""",
)
def index_refresh(spark, d):
    """Labelled documents are re-indexed by their notes, twice; the others keep their postings."""
    docs = subjects(spark, d)
    changed = read_input(spark, d, "labels").select(F.col("doc_id").alias("subject_id"))
    old = lexical.build_postings(docs, ["card_text"])
    new = lexical.build_postings(docs.join(changed, "subject_id", "left_semi"), ["note_text"])
    once = lifecycle.refresh_index(old, new, changed)
    twice = lifecycle.refresh_index(once, new, changed)
    return twice.groupBy("subject_id").agg(F.countDistinct("term").alias("n_terms"))


_UNDO = "INTERVAL 6 HOURS"


@query(
    "undo_window_purge",
    f"""SELECT event_id, user_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'signup'
      AND r.user_id = e.user_id AND r.ts >= e.ts AND r.ts <= e.ts + {_UNDO})""",
)
def undo_window_purge(spark, d):
    """Errors count as deletes and signups as restores; six hours to undo."""
    e = read_input(spark, d, "events")
    final = lifecycle.final_deletes(
        e.filter("event_type = 'error'"), e.filter("event_type = 'signup'"), "user_id", seconds=6 * 3600
    )
    return final.select("event_id", "user_id")


# --- evaluation ----------------------------------------------------------------------------------


def eval_results(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_input(spark, d, "lineitem")).select(
        F.col("l_orderkey").alias("image"),
        F.when(F.col("l_returnflag") == "R", "routed").otherwise(F.col("l_returnflag")).alias("engine"),
        F.floor(F.col("l_extendedprice") / 10).alias("duration_ms"),
        F.concat_ws(" ", "l_linestatus", "l_linenumber").alias("plain_text"),
        F.create_map(
            F.lit("flag"), F.col("l_linestatus"), F.lit("line"), F.pmod("l_linenumber", F.lit(3)).cast("string"), F.lit("extra"),
            F.when(F.col("l_linenumber") == 2, "x").otherwise(" "),
        ).alias("fields"),
        (F.col("l_linenumber") - 1).alias("block_count"),
    )


def eval_labels(spark: SparkSession, d: str) -> DataFrame:
    script = (
        F.when(F.col("o_orderpriority").startswith("1"), "latin").when(F.col("o_orderpriority").startswith("2"), "Bengali").when(F.col("o_orderpriority").startswith("3"), "mixed")
    )
    return read_input(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("image"),
        script.alias("script"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.col("o_orderstatus"), F.lit("  1"))).alias("raw_text"),
        F.create_map(
            F.lit("flag"), F.lower("o_orderstatus"), F.lit("line"), F.pmod("o_custkey", F.lit(3)).cast("string"), F.lit("wanted"), F.lit("y")
        ).alias("fields"),
    )


_RUNS = """(SELECT *, CASE WHEN priority = '1' OR priority = '4' THEN 'latin' ELSE 'bengali' END AS bucket FROM (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'routed' ELSE l_returnflag END AS engine, floor(l_extendedprice / 10)::BIGINT AS ms, l_linestatus || ' ' || l_linenumber AS got_text,
    l_linenumber, l_linestatus, o_orderstatus, o_custkey, left(o_orderpriority, 1) AS priority FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW'))"""
_PAIRS = f"""(SELECT engine, unnest(['all', bucket]) AS bucket, field_key, want, got FROM (
  SELECT engine, bucket, 'flag' AS field_key, lower(o_orderstatus) AS want, lower(l_linestatus) AS got FROM {_RUNS}
  UNION ALL SELECT engine, bucket, 'line', (o_custkey % 3)::VARCHAR, (l_linenumber % 3)::VARCHAR FROM {_RUNS}
  UNION ALL SELECT engine, bucket, 'wanted', 'y', NULL FROM {_RUNS}
  UNION ALL SELECT engine, bucket, 'extra', NULL, 'x' FROM {_RUNS} WHERE l_linenumber = 2))"""
_COUNTS = f"""(SELECT engine, bucket, field_key, count(*) FILTER (want = got) AS tp,
  count(*) FILTER (got IS NOT NULL AND want IS DISTINCT FROM got) AS fp, count(*) FILTER (want IS NOT NULL AND want IS DISTINCT FROM got) AS fn FROM {_PAIRS} GROUP BY ALL)"""
_PRF = f"""(SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, tp + fn AS support FROM {_COUNTS}))"""
_WF1 = f"(SELECT engine, bucket, CASE WHEN sum(support) = 0 THEN 0 ELSE sum(f1 * support) / sum(support) END AS weighted_f1, sum(support) AS support FROM {_PRF} GROUP BY ALL)"


@query("field_prf1", f"SELECT engine, bucket, field_key, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM {_PRF}")
def field_prf1(spark, d):
    scores = E.field_scores(eval_results(spark, d), eval_labels(spark, d))
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("weighted_f1", f"SELECT engine, bucket, round(weighted_f1, 6) AS weighted_f1, support::BIGINT AS support FROM {_WF1}")
def weighted_f1(spark, d):
    scores = E.field_scores(eval_results(spark, d), eval_labels(spark, d))
    return E.weighted_f1(scores, "engine", "bucket").withColumn("weighted_f1", F.round("weighted_f1", 6))


_CER = "CASE WHEN o_orderstatus <> 'P' THEN levenshtein(o_orderstatus || ' 1', got_text) / len(o_orderstatus || ' 1') END"
_P90 = "list_sort(list(ms))[floor((count(*) - 1) * 0.9 + 0.5)::BIGINT + 1]"


@query(
    "engine_report",
    f"""SELECT r.engine, cards, round(mean_cer, 6) AS mean_cer, round(mean_cer_labelled, 6) AS mean_cer_labelled, round(failure_rate, 6) AS failure_rate,
      round(mean_ms, 4) AS mean_ms, p90_ms::DOUBLE AS p90_ms, round(a.weighted_f1, 6) AS f1_all, round(l.weighted_f1, 6) AS f1_latin, round(b.weighted_f1, 6) AS f1_bengali
    FROM (SELECT engine, count(*) AS cards, avg(coalesce({_CER}, 0)) AS mean_cer, avg({_CER}) AS mean_cer_labelled, avg((l_linenumber = 1)::INT) AS failure_rate, avg(ms) AS mean_ms, {_P90} AS p90_ms FROM {_RUNS} GROUP BY engine) r
    JOIN {_WF1} a ON a.engine = r.engine AND a.bucket = 'all' JOIN {_WF1} l ON l.engine = r.engine AND l.bucket = 'latin' JOIN {_WF1} b ON b.engine = r.engine AND b.bucket = 'bengali'""",
)
def engine_report(spark, d):
    report = E.engine_report(eval_results(spark, d), eval_labels(spark, d))
    rounded = ("mean_cer", "mean_cer_labelled", "failure_rate", "f1_all", "f1_latin", "f1_bengali")
    return report.withColumns({c: F.round(c, 6) for c in rounded}).withColumn("mean_ms", F.round("mean_ms", 4))


@query("quality_gate", f"SELECT engine, round(weighted_f1, 6) AS score, weighted_f1 >= 0.6 AS passes FROM {_WF1} WHERE engine = 'routed' AND bucket = 'bengali'")
def quality_gate(spark, d):
    gate = E.quality_gate(E.engine_report(eval_results(spark, d), eval_labels(spark, d)))
    return gate.withColumn("score", F.round("score", 6))


@query("unlabelled_results", "SELECT DISTINCT l_orderkey AS image FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')")
def unlabelled_results(spark, d):
    return E.unlabelled(eval_results(spark, d), eval_labels(spark, d))


@query("p90_latency", "SELECT o_orderpriority, list_sort(list(o_totalprice))[floor((count(*) - 1) * 0.9 + 0.5)::BIGINT + 1] AS percentile FROM orders GROUP BY o_orderpriority")
def p90_latency(spark, d):
    return E.nearest_percentile(read_input(spark, d, "orders"), "o_orderpriority", "o_totalprice", 0.9)


@query(
    "predictions",
    f"""SELECT card_id, string_agg(field_key || '=' || v, ';' ORDER BY field_key) AS fields FROM
      (SELECT card_id, field_key, arg_min(coalesce(normalized_value, value), id) AS v FROM {D.FIELDS} GROUP BY ALL) GROUP BY card_id""",
)
def predictions(spark, d):
    made = E.predictions(D.card_fields(spark, d))
    pair = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return made.select("card_id", F.array_join(pair, ";").alias("fields"))


@query("correction_rate", f"SELECT field_key, count(*) AS fields, round(avg(verified_by_user::INT), 6) AS correction_rate FROM {D.FIELDS} GROUP BY field_key")
def correction_rate(spark, d):
    return E.correction_rate(D.card_fields(spark, d)).withColumn("correction_rate", F.round("correction_rate", 6))


@query(
    "attempt_report",
    """SELECT event_type AS engine, count(*) AS attempts, count(*) FILTER (value >= 50) AS success, count(*) FILTER (value >= 10 AND value < 50) AS partial,
      count(*) FILTER (value < 10) AS failed, round(avg(floor(value)), 6) AS mean_ms, sum((event_id % 7)::BIGINT)::BIGINT AS fields_found FROM events GROUP BY event_type""",
)
def attempt_report(spark, d):
    status = F.when(F.col("value") >= 50, "success").when(F.col("value") >= 10, "partial").otherwise("failed")
    attempts = read_input(spark, d, "events").select(
        F.col("event_type").alias("engine"), status.alias("status"), F.floor("value").alias("duration_ms"), F.pmod("event_id", F.lit(7)).alias("fields_found")
    )
    return E.attempt_report(attempts).withColumn("mean_ms", F.round("mean_ms", 6))


@query(
    "rescan_outcomes",
    """SELECT coalesce(b.k, a.k) AS card_id, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) > coalesce(b.n, 0) AS improved
    FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) b
    FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) a ON a.k = b.k""",
)
def rescan_outcomes(spark, d):
    lines = read_input(spark, d, "lineitem").select(F.col("l_orderkey").alias("card_id"), "l_linestatus")
    return E.rescan_outcomes(lines.filter("l_linestatus = 'O'"), lines.filter("l_linestatus = 'F'"))


# --- people and organizations --------------------------------------------------------------------


def _listed(made: DataFrame) -> DataFrame:
    """A list with each row's place in it."""
    placed = global_position(made, [F.desc_nulls_last("last_seen"), F.desc("id")], "position")
    return placed.withColumn("last_seen", shown("last_seen"))


@query(
    "people_list",
    f"""SELECT p.id, display_name, count(DISTINCT c.id) AS card_count, strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') AS last_seen,
      row_number() OVER (ORDER BY max(captured_at) DESC NULLS LAST, p.id DESC) - 1 AS position
    FROM {D.PEOPLE} p LEFT JOIN {D.ORDER_CARDS} c ON c.person_id = p.id AND c.deleted_at IS NULL WHERE merged_into_id IS NULL GROUP BY p.id, display_name""",
)
def people_list(spark, d):
    return _listed(G.people_list(D.people(spark, d), D.order_cards(spark, d)))


@query(
    "org_list",
    f"""SELECT n_nationkey AS id, n_name AS name, coalesce((SELECT address FROM {D.BRANCHES} b WHERE b.org_id = n_nationkey ORDER BY is_primary DESC, b.id LIMIT 1), lower(n_name) || '.com') AS subtitle,
      count(DISTINCT c.id) AS card_count, count(DISTINCT c.person_id) AS people_count, strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') AS last_seen,
      row_number() OVER (ORDER BY max(captured_at) DESC NULLS LAST, n_nationkey DESC) - 1 AS position
    FROM nation LEFT JOIN {D.ORDER_CARDS} c ON c.org_id = n_nationkey AND c.deleted_at IS NULL GROUP BY n_nationkey, n_name""",
)
def org_list(spark, d):
    return _listed(G.org_list(D.organizations(spark, d), D.order_cards(spark, d), D.branches(spark, d)))


@query("primary_branch", f"SELECT org_id, address FROM {D.BRANCHES} QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY is_primary DESC, id) = 1")
def primary_branch(spark, d):
    return FL.primary_branch(D.branches(spark, d))


@query("branch_numbers", f"SELECT id, CASE WHEN org_id IS NOT NULL THEN row_number() OVER (PARTITION BY org_id ORDER BY id) END AS branch_no FROM {D.BRANCHES}")
def branch_numbers(spark, d):
    return G.numbered_branches(D.branches(spark, d)).select("id", F.col("branch_no").cast("long").alias("branch_no"))


@query(
    "person_subtitles",
    f"""WITH p AS (SELECT * FROM {D.PEOPLE}), j AS (SELECT coalesce(p.merged_into_id, p.id) AS id, r.id AS rid, title, is_current, n_name AS org FROM {D.ROLES} r JOIN p ON p.id = r.person_id JOIN nation ON n_nationkey = r.org_id),
    h AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY is_current DESC, rid) = 1),
    e AS (SELECT owner_id AS id, arg_min(value, ord) AS endpoint FROM {D.POINTS} GROUP BY owner_id)
    SELECT p.id, CASE WHEN n > 1 THEN concat_ws(' · ', title, org) || '  +' || (n - 1) || ' more' WHEN n = 1 THEN concat_ws(' · ', title, org) ELSE endpoint END AS subtitle
    FROM p LEFT JOIN h ON h.id = p.id LEFT JOIN e ON e.id = p.id""",
)
def person_subtitles(spark, d):
    return G.person_subtitles(D.people(spark, d), D.roles(spark, d), D.organizations(spark, d), D.contact_points(spark, d))


def shaped_graph(spark: SparkSession, d: str) -> G.Graph:
    """Customers, nations and orders as a graph; only the latest cards have links, so parts of it are orphaned."""
    linked = F.col("captured_at") >= "2001-05-01"
    recent = D.order_cards(spark, d).withColumns({c: F.when(linked, F.col(c)) for c in ("person_id", "org_id", "role_id")})
    pairs = read_input(spark, d, "customer").select(
        F.col("c_custkey").alias("a_id"), (F.col("c_custkey") + 1).alias("b_id"), F.lit(1.0).alias("score")
    )
    guessed = F.col("source") == "aiInferred"
    points = D.contact_points(spark, d).withColumns({c: F.when(guessed, F.col(c)) for c in ("owner_id", "role_id")})
    return G.Graph(
        D.people(spark, d), D.organizations(spark, d), D.roles(spark, d), D.branches(spark, d), points, recent, pairs
    )


_RECENT = f"""(SELECT id, CASE WHEN l THEN person_id END AS person_id, CASE WHEN l THEN org_id END AS org_id, CASE WHEN l THEN role_id END AS role_id
  FROM (SELECT *, captured_at >= TIMESTAMP '2001-05-01' AS l FROM {D.ORDER_CARDS}))"""
_PTS = f"(SELECT CASE WHEN source = 'aiInferred' THEN owner_id END AS owner_id, CASE WHEN source = 'aiInferred' THEN role_id END AS role_id FROM {D.POINTS})"
_KEPT = f"""(SELECT id FROM {D.PEOPLE} WHERE merged_into_id IS NOT NULL OR id IN (SELECT person_id FROM {_RECENT}) OR id IN (SELECT owner_id FROM {_PTS})
  OR id IN (SELECT merged_into_id FROM {D.PEOPLE} WHERE merged_into_id IS NOT NULL))"""


@query(
    "orphan_gc",
    f"""SELECT 'roles' AS tbl, id FROM {D.ROLES} WHERE id IN (SELECT role_id FROM {_RECENT} WHERE role_id IS NOT NULL) OR id IN (SELECT role_id FROM {_PTS} WHERE role_id IS NOT NULL)
      OR person_id IN (SELECT id FROM {D.PEOPLE} WHERE merged_into_id IS NOT NULL)
    UNION ALL SELECT 'branches', id FROM {D.BRANCHES} WHERE org_id IN (SELECT org_id FROM {_RECENT})
    UNION ALL SELECT 'people', id FROM {_KEPT}
    UNION ALL SELECT 'organizations', n_nationkey FROM nation WHERE n_nationkey IN (SELECT org_id FROM {_RECENT})
    UNION ALL SELECT 'overlaps', c_custkey FROM customer WHERE c_custkey IN (SELECT id FROM {_KEPT}) AND c_custkey + 1 IN (SELECT id FROM {_KEPT})""",
)
def orphan_gc(spark, d):
    left = G.drop_orphans(shaped_graph(spark, d))
    rows = None
    for name, df, key in (
        ("roles", left.roles, "id"), ("branches", left.branches, "id"), ("people", left.people, "id"),
        ("organizations", left.organizations, "id"), ("overlaps", left.overlaps, "a_id"),
    ):
        part = df.select(F.lit(name).alias("tbl"), F.col(key).alias("id"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("survivors", f"SELECT id AS person_id, coalesce(merged_into_id, id) AS survivor_id FROM {D.PEOPLE}")
def survivors(spark, d):
    return G.survivor_map(D.people(spark, d))


#: Orders as rulings on neighbouring customers: some merge, some undo it, most keep two people apart.
RULINGS = """(SELECT o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'unmerge' ELSE 'separate' END AS action,
    o_custkey AS survivor_id, o_custkey + o_orderkey % 7 - 3 AS loser_id FROM orders)"""


def rulings_log(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read_input(spark, d, "orders").select(
        key.alias("seq"),
        F.when(key % 4 == 0, "merge").when(key % 4 == 1, "unmerge").otherwise("separate").alias("action"),
        F.col("o_custkey").alias("survivor_id"),
        (F.col("o_custkey") + key % 7 - 3).alias("loser_id"),
    )


@query(
    "merge_decisions",
    f"""WITH RECURSIVE acts AS (SELECT * FROM {RULINGS} WHERE action <> 'separate' AND survivor_id <> loser_id),
    merges AS (SELECT loser_id, survivor_id, seq, coalesce(lag(seq) OVER (PARTITION BY loser_id ORDER BY seq), -1) AS before FROM acts WHERE action = 'merge'),
    own AS (SELECT * FROM acts QUALIFY row_number() OVER (PARTITION BY loser_id ORDER BY seq DESC) = 1),
    walk AS (SELECT loser_id AS id, survivor_id AS t, seq FROM own WHERE action = 'merge'
      UNION ALL SELECT w.id, m.survivor_id, m.seq FROM walk w JOIN merges m ON m.loser_id = w.t AND m.before <= w.seq AND w.seq < m.seq),
    ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
    ptr AS (SELECT id, t FROM ends JOIN customer ON c_custkey = id WHERE id <> t),
    reach AS (SELECT id AS a, t AS b FROM ptr UNION SELECT r.a, p.t FROM reach r JOIN ptr p ON p.id = r.b),
    roots AS (SELECT a, b FROM reach WHERE b NOT IN (SELECT id FROM ptr)),
    circles AS (SELECT r.a, min(r.b) AS b FROM reach r JOIN reach c ON c.a = r.b AND c.b = r.b GROUP BY r.a)
    SELECT c_custkey AS person_id, ptr.t AS merged_into_id, coalesce(roots.b, circles.b, c_custkey) AS survivor_id
    FROM customer LEFT JOIN ptr ON ptr.id = c_custkey LEFT JOIN roots ON roots.a = c_custkey LEFT JOIN circles ON circles.a = c_custkey""",
)
def merge_decisions(spark, d):
    """A log of rulings becomes pointers, and pointers lead to the row that stands for a person."""
    log = rulings_log(spark, d)
    people = read_input(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("merged_into_id"))
    merged = written(G.apply_decisions(people, log))
    return G.survivor_map(merged).join(merged.withColumnRenamed("id", "person_id"), "person_id").select(
        "person_id", "merged_into_id", "survivor_id"
    )


@query(
    "survivor_policy",
    f"""WITH n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.n >= b.n THEN a.id ELSE b.id END AS survivor_id FROM n a JOIN n b ON b.id = a.id + 1""",
)
def survivor_policy(spark, d):
    n = read_input(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    a = n.select(F.col("o_custkey").alias("a_id"), F.col("n").alias("a_cards"), (F.col("o_custkey") + 1).alias("b_id"))
    pairs = a.join(n.select(F.col("o_custkey").alias("b_id"), F.col("n").alias("b_cards")), "b_id")
    return G.pick_survivor(pairs).select("a_id", "b_id", "survivor_id")


# --- duplicate candidates -------------------------------------------------------------------------

_PAIRS = """(SELECT least(a, b) AS a_id, greatest(a, b) AS b_id, min(score) AS score FROM (
    SELECT c_custkey AS a, c_custkey + 1 AS b, 1.0::DOUBLE AS score FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT x.c_custkey + 2, x.c_custkey, 0.6 FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 2 AND (x.c_mktsegment = y.c_mktsegment OR x.c_custkey % 3 = 1)
    UNION ALL SELECT x.c_custkey, x.c_custkey + 1, 0.6 FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 AND x.c_mktsegment = y.c_mktsegment
  ) GROUP BY ALL)"""
_CANDIDATES = f"""p1 AS (SELECT row_number() OVER (ORDER BY a_id, b_id) AS id, * FROM {_PAIRS}),
    p2 AS (SELECT (SELECT count(*) FROM p1) + row_number() OVER (ORDER BY c_custkey) AS id, c_custkey AS a_id, c_custkey + 1 AS b_id, 1.0::DOUBLE AS score
      FROM customer WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE a_id = c_custkey AND b_id = c_custkey + 1)),
    rulings AS (SELECT seq, seq % 2 AS late, least(survivor_id, loser_id) AS a_id, greatest(survivor_id, loser_id) AS b_id,
      CASE action WHEN 'merge' THEN 'linked' ELSE 'rejected' END AS ruled FROM {RULINGS} WHERE action <> 'unmerge'),
    said AS (SELECT a_id, b_id, max_by(ruled, seq) FILTER (late = 0) AS early, max_by(ruled, seq) FILTER (late = 1) AS late FROM rulings GROUP BY ALL),
    cand AS (SELECT p.id, p.a_id, p.b_id, p.score, CASE WHEN p.score < 1 THEN '["same name"]' ELSE '["shared contacts"]' END AS signals_json,
      coalesce(said.late, CASE WHEN first THEN said.early END, 'pending') AS status
      FROM (SELECT *, TRUE AS first FROM p1 UNION ALL SELECT *, FALSE FROM p2) p LEFT JOIN said ON said.a_id = p.a_id AND said.b_id = p.b_id)"""


def _ruled_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of proposals with rulings after each; the second round proposes all pairs of contacts again."""
    c = read_input(spark, d, "customer").select(F.col("c_custkey").alias("a_id"), F.col("c_mktsegment").alias("segment"))
    other = c.select(F.col("a_id").alias("b_id"), F.col("segment").alias("_segment"))
    contacts = c.select("a_id", (F.col("a_id") + 1).alias("b_id"))
    next_but_one = c.withColumn("b_id", F.col("a_id") + 2).join(other, "b_id").filter("segment = _segment OR a_id % 3 = 1")
    neighbours = c.withColumn("b_id", F.col("a_id") + 1).join(other, "b_id").filter("segment = _segment")
    names = next_but_one.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id")).unionByName(neighbours.select("a_id", "b_id"))
    first = candidates.shared_contact_proposals(contacts.filter("a_id % 3 <> 0")).unionByName(candidates.same_name_proposals(names))
    log = rulings_log(spark, d)
    made = candidates.propose(spark.createDataFrame([], candidates.SCHEMA), first)
    made = written(candidates.settle(made, log.filter("seq % 2 = 0")))
    made = candidates.propose(made, candidates.shared_contact_proposals(contacts))
    return candidates.settle(made, log.filter("seq % 2 = 1"))


@query("duplicate_candidates", f"WITH {_CANDIDATES} SELECT * FROM cand")
def duplicate_candidates(spark, d):
    return _ruled_candidates(spark, d)


@query(
    "pending_candidates",
    f"""WITH {_CANDIDATES}, sub AS ({ORACLES["person_subtitles"]}), st AS (SELECT id, display_name FROM {D.PEOPLE} WHERE merged_into_id IS NULL),
    n AS (SELECT person_id AS id, count(*) AS n FROM {D.ORDER_CARDS} WHERE deleted_at IS NULL GROUP BY ALL),
    half AS (SELECT st.id, display_name, coalesce(n, 0) AS n, subtitle FROM st LEFT JOIN n USING (id) LEFT JOIN sub USING (id))
    SELECT row_number() OVER (ORDER BY score DESC, cand.id) - 1 AS position, cand.id, a_id, b_id, score, signals_json, a.display_name AS a_name, a.n AS a_cards,
      a.subtitle AS a_subtitle, b.display_name AS b_name, b.n AS b_cards, b.subtitle AS b_subtitle
    FROM cand JOIN half a ON a.id = a_id JOIN half b ON b.id = b_id WHERE status = 'pending' QUALIFY position BETWEEN 10 AND 209""",
)
def pending_candidates(spark, d):
    """Two hundred of the pairs that wait for a ruling, after the first ten."""
    return candidates.pending_page(
        _ruled_candidates(spark, d), D.people(spark, d), D.order_cards(spark, d), D.roles(spark, d), D.organizations(spark, d),
        D.contact_points(spark, d), 10, 200,
    )


# --- resolution: the outcome depends on card order, so brute force on fixtures stands in for SQL ---


@query("resolve_people")
def people_of_cards(spark, d):
    fields = written(D.scanned_fields(spark, d))
    known = card_facts(fields).filter(~F.col("is_empty"))
    people, _ = resolve_people(known.select("card_id", F.col("card_id").alias("ord"), "name"), endpoint_keys(fields))
    return people.select("card_id", "person_id", "founded")


@query("resolve_orgs")
def orgs_of_cards(spark, d):
    known = card_facts(D.scanned_fields(spark, d)).filter(~F.col("is_empty"))
    orgs, _ = resolve_orgs(known.select("card_id", F.col("card_id").alias("ord"), "company", "domain"))
    return orgs.select("card_id", "org_id", "founded")


def promoted(spark: SparkSession, d: str) -> G.Graph:
    """The graph of all scanned cards."""
    made = G.promote_all(D.scanned_cards(spark, d), written(D.scanned_fields(spark, d)))
    return G.Graph(**{name: written(df) for name, df in made.tables().items()})


@query("graph_summary")
def graph_summary(spark, d):
    rows = None
    for name, df in promoted(spark, d).tables().items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows


# --- building the graph, details ------------------------------------------------------------------


@query(
    "roles_build",
    f"""SELECT min(ord) AS id, person_id, org_id, arg_min(designation, ord) FILTER (designation IS NOT NULL) AS title, TRUE AS is_current
    FROM {D.LINKS} WHERE person_id IS NOT NULL AND org_id IS NOT NULL GROUP BY person_id, org_id""",
)
def roles_build(spark, d):
    return G.build_roles(D.card_links(spark, d))


@query(
    "branches_build",
    f"""SELECT id, org_id, address, id = min(id) OVER (PARTITION BY org_id) AS is_primary FROM (
      SELECT min(ord) AS id, org_id, arg_min({S.trim("address")}, ord) AS address FROM {D.LINKS}
      WHERE org_id IS NOT NULL AND address IS NOT NULL GROUP BY org_id, lower({S.trim("address")}))""",
)
def branches_build(spark, d):
    return G.build_branches(D.card_links(spark, d))


_POINT_COLUMNS = ["owner_type", "owner_id", "kind", "value", "normalized_value", "role_id", "source_card_id", "source", "ord", "field_id"]


@query(
    "endpoints_build",
    f"""SELECT CASE WHEN person_id IS NOT NULL THEN 'person' ELSE 'organization' END AS owner_type, coalesce(person_id, org_id) AS owner_id, field_key AS kind,
      value, normalized_value, role_id, f.card_id AS source_card_id, source, ord, id AS field_id
    FROM {D.FIELDS} f JOIN {D.LINKS} l ON l.card_id = f.card_id
    WHERE field_key IN ('phone', 'email') AND normalized_value IS NOT NULL AND coalesce(person_id, org_id) IS NOT NULL""",
)
def endpoints_build(spark, d):
    return G.build_endpoints(D.card_links(spark, d), D.card_fields(spark, d)).select(*_POINT_COLUMNS)


def derived_graph(spark: SparkSession, d: str) -> G.Graph:
    """Customers, nations, suppliers and orders as the tables of a graph."""
    pairs = read_input(spark, d, "customer").select(F.col("c_custkey").alias("a_id"), (F.col("c_custkey") + 1).alias("b_id"), F.lit(1.0).alias("score"))
    points = D.contact_points(spark, d).unionByName(D.office_points(spark, d))
    return G.Graph(
        D.people(spark, d), D.organizations(spark, d), D.roles(spark, d), D.branches(spark, d), points, D.order_cards(spark, d), pairs
    )


@query(
    "person_details",
    f"""WITH s AS (SELECT id AS pid, coalesce(merged_into_id, id) AS id FROM {D.PEOPLE})
    SELECT s.id, 'role' AS section, r.id AS sort, concat_ws(' · ', title, n_name) AS value FROM {D.ROLES} r JOIN s ON s.pid = r.person_id JOIN nation ON n_nationkey = r.org_id
    UNION ALL SELECT id, 'endpoint', rid, value FROM (SELECT s.id, coalesce(role_id, -1) AS rid, value, kind, coalesce(normalized_value, value) AS k, ord
      FROM {D.POINTS} p JOIN s ON s.pid = p.owner_id QUALIFY row_number() OVER (PARTITION BY s.id, rid, kind, k ORDER BY ord) = 1)
    UNION ALL SELECT s.id, 'card', -epoch_us(captured_at), c.id::VARCHAR FROM {D.ORDER_CARDS} c JOIN s ON s.pid = c.person_id WHERE deleted_at IS NULL
    UNION ALL SELECT id, 'merged', pid, pid::VARCHAR FROM s WHERE pid <> id""",
)
def person_details(spark, d):
    return G.person_sections(derived_graph(spark, d))


@query(
    "org_details",
    f"""SELECT org_id AS id, 'branch' AS section, CASE WHEN is_primary THEN 0 ELSE id END AS sort, address AS value FROM {D.BRANCHES}
    UNION ALL SELECT owner_id, 'endpoint', ord, value FROM (SELECT * FROM {D.OFFICE_POINTS} QUALIFY row_number() OVER (PARTITION BY owner_id, coalesce(normalized_value, value) ORDER BY ord) = 1)
    UNION ALL SELECT DISTINCT r.org_id, 'person', r.person_id, concat_ws(' · ', display_name, title) FROM {D.ROLES} r JOIN {D.PEOPLE} p ON p.id = r.person_id
    UNION ALL SELECT org_id, 'card', -epoch_us(captured_at), id::VARCHAR FROM {D.ORDER_CARDS} WHERE deleted_at IS NULL AND org_id IS NOT NULL""",
)
def org_details(spark, d):
    return G.org_sections(derived_graph(spark, d))


_SETTLED = f"""(SELECT DISTINCT least(survivor_id, loser_id) AS a_id, greatest(survivor_id, loser_id) AS b_id FROM {RULINGS} WHERE action IN ('merge', 'separate'))"""


_WITHDRAWN = "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"
_STILL = f"""(SELECT id, CASE WHEN stays THEN person_id END AS person_id, CASE WHEN stays THEN org_id END AS org_id, CASE WHEN stays THEN role_id END AS role_id
  FROM (SELECT *, id NOT IN {_WITHDRAWN} AS stays FROM {D.ORDER_CARDS}))"""
_STILL_POINTS = f"(SELECT * FROM {D.POINTS} WHERE owner_id NOT IN {_WITHDRAWN})"
_STANDING = f"""(SELECT id FROM {D.PEOPLE} WHERE merged_into_id IS NOT NULL OR id IN (SELECT person_id FROM {_STILL}) OR id IN (SELECT owner_id FROM {_STILL_POINTS})
  OR id IN (SELECT merged_into_id FROM {D.PEOPLE} WHERE merged_into_id IS NOT NULL))"""


@query(
    "detached_cards",
    f"""SELECT 'cards' AS tbl, id FROM {_STILL} WHERE coalesce(person_id, org_id, role_id) IS NOT NULL
    UNION ALL SELECT 'contact_points', ord FROM {_STILL_POINTS} UNION ALL SELECT 'contact_points', -ord FROM {D.OFFICE_POINTS}
    UNION ALL SELECT 'roles', id FROM {D.ROLES} WHERE id IN (SELECT role_id FROM {_STILL}) OR id IN (SELECT role_id FROM {_STILL_POINTS})
      OR person_id IN (SELECT id FROM {D.PEOPLE} WHERE merged_into_id IS NOT NULL)
    UNION ALL SELECT 'branches', id FROM {D.BRANCHES} WHERE org_id IN (SELECT org_id FROM {_STILL})
    UNION ALL SELECT 'people', id FROM {_STANDING}
    UNION ALL SELECT 'organizations', n_nationkey FROM nation WHERE n_nationkey IN (SELECT org_id FROM {_STILL}) OR n_nationkey IN (SELECT owner_id FROM {D.OFFICE_POINTS})
    UNION ALL SELECT 'overlaps', c_custkey FROM customer WHERE c_custkey IN (SELECT id FROM {_STANDING}) AND c_custkey + 1 IN (SELECT id FROM {_STANDING})""",
)
def detached_cards(spark, d):
    """Cards of closed orders are taken out of the graph; what nothing points at any more goes with them."""
    gone = read_input(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    left = G.detach_cards(derived_graph(spark, d), gone)
    point = F.when(F.col("owner_type") == "organization", -F.col("ord")).otherwise(F.col("ord"))
    parts = [
        ("cards", left.cards.filter(F.coalesce("person_id", "org_id", "role_id").isNotNull()), F.col("id")),
        ("contact_points", left.contact_points, point),
        ("roles", left.roles, F.col("id")),
        ("branches", left.branches, F.col("id")),
        ("people", left.people, F.col("id")),
        ("organizations", left.organizations, F.col("id")),
        ("overlaps", left.overlaps, F.col("a_id")),
    ]
    rows = [df.select(F.lit(name).alias("tbl"), key.alias("id")) for name, df, key in parts]
    return reduce(DataFrame.unionByName, rows)


_LABEL = "CASE ord % 5 WHEN 0 THEN 'My Mobile' WHEN 1 THEN 'home' WHEN 2 THEN 'Fax, old' END"
_TEL = """CASE kind WHEN 'email' THEN 'EMAIL;TYPE=INTERNET:' ELSE 'TEL;TYPE=' || CASE WHEN label ILIKE '%mobile%' OR label ILIKE '%cell%' THEN 'CELL'
      WHEN label ILIKE '%home%' THEN 'HOME' WHEN label ILIKE '%fax%' THEN 'FAX' ELSE 'WORK' END || ':' END || value"""
_FULL_NAME = """'FN:' || name || chr(13) || chr(10) || 'N:' || CASE WHEN len(string_split(name, ' ')) < 2 THEN name || ';;;;'
      ELSE string_split(name, ' ')[-1] || ';' || array_to_string(string_split(name, ' ')[:-2], ' ') || ';;;' END"""


@query(
    "vcard_export",
    f"""WITH s AS (SELECT id AS pid, coalesce(merged_into_id, id) AS id, display_name, merged_into_id FROM {D.PEOPLE}),
    jobs AS (SELECT s.id, r.id AS role_id, n_name AS org, title, is_current FROM {D.ROLES} r JOIN s ON s.pid = r.person_id JOIN nation ON n_nationkey = r.org_id),
    job AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY is_current DESC, role_id) = 1),
    pts AS (SELECT s.id, kind, value, coalesce({_LABEL}, org) AS label, org IS NULL AS loose, NOT coalesce(is_current, FALSE) AS past, coalesce(p.role_id, 0) AS role, ord
      FROM {D.POINTS} p JOIN s ON s.pid = owner_id LEFT JOIN jobs ON jobs.role_id = p.role_id
      QUALIFY row_number() OVER (PARTITION BY s.id, kind, coalesce(normalized_value, value) ORDER BY loose, past, role, ord) = 1),
    lines AS (SELECT id, string_agg({_TEL} || chr(13) || chr(10), '' ORDER BY loose, past, role, ord) AS l FROM pts GROUP BY id),
    offices AS (SELECT owner_id AS id, string_agg({_TEL} || chr(13) || chr(10), '' ORDER BY ord) AS l FROM (
      SELECT *, 'phone' AS kind, {_LABEL} AS label FROM {D.OFFICE_POINTS} QUALIFY row_number() OVER (PARTITION BY owner_id, coalesce(normalized_value, value) ORDER BY ord) = 1) GROUP BY 1),
    branch AS (SELECT org_id AS id, address FROM {D.BRANCHES} QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY is_primary DESC, id) = 1),
    everyone AS (SELECT 'person' AS owner_type, s.id, s.display_name AS name, org, title, l, NULL AS url, NULL AS address FROM s LEFT JOIN job ON job.id = s.id LEFT JOIN lines ON lines.id = s.id WHERE merged_into_id IS NULL
      UNION ALL SELECT 'organization', n_nationkey, n_name, n_name, NULL, l, lower(n_name) || '.com', address FROM nation LEFT JOIN offices ON offices.id = n_nationkey LEFT JOIN branch ON branch.id = n_nationkey)
    SELECT owner_type, id, replace(replace(name, '#', ''), ' ', '_') AS file_name,
      concat_ws(chr(13) || chr(10), 'BEGIN:VCARD', 'VERSION:3.0', {_FULL_NAME}, 'ORG:' || org, 'TITLE:' || title, regexp_replace(l, '\r\n$', ''), 'URL:' || url,
        'ADR;TYPE=WORK:;;' || address || '\\, Road\\; 1\\\\2;;;;', 'END:VCARD') || chr(13) || chr(10) AS vcard
    FROM everyone""",
)
def vcard_export(spark, d):
    """Contact files of all listed people and organizations; labels, and addresses with signs that have to be escaped."""
    graph = derived_graph(spark, d)
    fifth = F.pmod("ord", F.lit(5))
    label = F.when(fifth == 0, "My Mobile").when(fifth == 1, "home").when(fifth == 2, "Fax, old")
    address = F.concat("address", F.lit(", Road; 1\\2"))
    graph = graph.with_(contact_points=graph.contact_points.withColumn("label", label), branches=graph.branches.withColumn("address", address))
    return contact_export.person_cards(graph).unionByName(contact_export.organization_cards(graph))


@query(
    "pending_overlaps",
    f"""WITH st AS (SELECT id, display_name FROM {D.PEOPLE} WHERE merged_into_id IS NULL),
    n AS (SELECT person_id AS id, count(*) AS n FROM {D.ORDER_CARDS} WHERE deleted_at IS NULL GROUP BY ALL)
    SELECT a.id AS a_id, b.id AS b_id, 1.0::DOUBLE AS score, a.display_name AS a_name, coalesce(na.n, 0) AS a_cards, b.display_name AS b_name, coalesce(nb.n, 0) AS b_cards
    FROM st a JOIN st b ON b.id = a.id + 1 LEFT JOIN n na ON na.id = a.id LEFT JOIN n nb ON nb.id = b.id
    WHERE NOT EXISTS (SELECT 1 FROM {_SETTLED} s WHERE s.a_id = a.id AND s.b_id = b.id)""",
)
def pending_overlaps(spark, d):
    return G.pending_overlaps(derived_graph(spark, d), G.settled_pairs(rulings_log(spark, d)))


# --- layout --------------------------------------------------------------------------------------


@query("extract_card_fields")
def extract_card_fields(spark, d):
    return layout.extract_card_fields(D.line_blocks(spark, d)).select(
        "card_id", "field_key", "value", "normalized_value", F.round("confidence", 6).alias("confidence"), "issue", "needs_review"
    )


@query("leftover_blocks")
def leftover_blocks(spark, d):
    blocks = D.line_blocks(spark, d)
    left = layout.leftover_blocks(blocks, layout.extract_card_fields(blocks))
    return left.groupBy("card_id").agg(F.count("*").alias("n_blocks"))


@query(
    "block_phones",
    f"SELECT id AS card_id, CASE WHEN valid THEN regexp_replace(e164, '^\\+880(.+)$', '0\\1') ELSE raw END AS value, e164 AS normalized_value FROM ({S.phones('(SELECT doc_id AS id, text FROM documents)')})",
)
def block_phones(spark, d):
    found = layout.extract_patterns(layout.measured(D.line_blocks(spark, d)))
    return found.filter("field_key = 'phone'").select("card_id", "value", "normalized_value")


def boxes(spark: SparkSession, d: str, status: str) -> DataFrame:
    return read_input(spark, d, "lineitem").filter(F.col("l_linestatus") == status).select(
        F.col("l_orderkey").alias("card_id"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("text"),
        (F.col("l_discount") * 1000).alias("left"),
        (F.col("l_tax") * 1000).alias("top"),
        (F.col("l_discount") * 1000 + F.col("l_quantity") * 4).alias("right"),
        (F.col("l_tax") * 1000 + F.col("l_quantity")).alias("bottom"),
    )


_BOXES = """(SELECT l_orderkey AS card_id, l_linestatus, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS text, l_discount * 1000 AS l, l_tax * 1000 AS t,
  l_discount * 1000 + l_quantity * 4 AS r, l_tax * 1000 + l_quantity AS b FROM lineitem)"""


@query(
    "spatial_block_dedupe",
    f"""SELECT card_id, text FROM {_BOXES} WHERE l_linestatus = 'O' UNION ALL SELECT card_id, text FROM {_BOXES} s WHERE l_linestatus = 'F' AND NOT EXISTS (
      SELECT 1 FROM {_BOXES} p WHERE p.l_linestatus = 'O' AND p.card_id = s.card_id AND least(s.r, p.r) > greatest(s.l, p.l) AND least(s.b, p.b) > greatest(s.t, p.t)
        AND (least(s.r, p.r) - greatest(s.l, p.l)) * (least(s.b, p.b) - greatest(s.t, p.t)) > 0.5 * ((s.r - s.l) * (s.b - s.t)))""",
)
def spatial_block_dedupe(spark, d):
    return layout.merge_passes(boxes(spark, d, "O"), boxes(spark, d, "F")).select("card_id", "text")


@query(
    "reading_order",
    f'SELECT card_id, text, row_number() OVER (PARTITION BY card_id ORDER BY t, l, text) - 1 AS order_index FROM {_BOXES}',
)
def reading_order(spark, d):
    return layout.reading_order(boxes(spark, d, "O").unionByName(boxes(spark, d, "F"))).select(
        "card_id", "text", F.col("order_index").cast("long").alias("order_index")
    )
