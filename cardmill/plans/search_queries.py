"""Registered queries of the search side: index, arms, fusion, utility, hybrid search, quantization."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.operators import cues, embedding, lexical, ranking, vectors
from cardmill.plans import search
from cardmill.plans import sql as S
from cardmill.plans.text_queries import SUBJECTS, subjects
from cardmill.session import written
from cardmill.sources.tables import read_input

QUERIES = {}
ORACLES = {}
AS_OF = "2001-06-30"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def query_set(spark: SparkSession, d: str) -> DataFrame:
    return read_input(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- index ---------------------------------------------------------------------------------------

_TOKENS = f"""tokens AS (
  SELECT subject_id, 'card_text' AS "column", unnest({S.index_terms('card_text')}) AS term FROM {SUBJECTS}
  UNION ALL SELECT subject_id, 'note_text', unnest({S.index_terms('note_text')}) FROM {SUBJECTS}),
lens AS (SELECT subject_id, len({S.index_terms('card_text')}) + len({S.index_terms('note_text')}) AS doc_len FROM {SUBJECTS})"""


@query(
    "index_postings",
    f"""WITH {_TOKENS} SELECT subject_id, "column", term, doc_len, count(*) AS tf FROM tokens JOIN lens USING (subject_id)
    GROUP BY ALL""",
)
def index_postings(spark, d):
    return lexical.build_postings(subjects(spark, d))


@query(
    "corpus_stats",
    f"WITH {_TOKENS} SELECT count(*) AS n_docs, round(avg(doc_len), 6) AS avg_len FROM lens",
)
def corpus_stats(spark, d):
    stats = lexical.corpus_stats(lexical.doc_stats(subjects(spark, d)))
    return stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(
    "term_stats",
    f"WITH {_TOKENS} SELECT term, count(DISTINCT subject_id) AS df, count(*) AS cf FROM tokens GROUP BY term",
)
def term_stats(spark, d):
    return lexical.text_term_stats(subjects(spark, d))


@query(
    "query_terms",
    f"SELECT query_id, query_term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({S.terms('text')}) AS query_term FROM benchmark) GROUP BY ALL",
)
def query_terms(spark, d):
    return lexical.query_terms(query_set(spark, d))


@query(
    "prefix_match",
    f"""WITH {_TOKENS}, v AS (SELECT DISTINCT term FROM tokens),
    q AS (SELECT DISTINCT unnest({S.terms('text')}) AS query_term FROM benchmark)
    SELECT query_term, term FROM q JOIN v ON starts_with(term, query_term)""",
)
def prefix_match(spark, d):
    vocabulary = lexical.build_postings(subjects(spark, d)).select("term").distinct()
    return lexical.prefix_matches(lexical.query_terms(query_set(spark, d)), vocabulary)


_BM25 = f"""{_TOKENS},
tf AS (SELECT subject_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
q AS (SELECT query_id, query_term, count(*) AS times FROM
      (SELECT item_id AS query_id, unnest({S.terms('text')}) AS query_term FROM benchmark) GROUP BY ALL),
ex AS (SELECT query_term, term FROM (SELECT DISTINCT query_term FROM q) JOIN (SELECT DISTINCT term FROM tf) ON starts_with(term, query_term)),
hit AS (SELECT query_term, subject_id, sum(tf) AS tf FROM ex JOIN tf USING (term) GROUP BY ALL),
dfs AS (SELECT query_term, count(*) AS df FROM hit GROUP BY ALL),
cs AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM lens),
idf AS (SELECT query_term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM dfs, cs),
bm AS (SELECT query_id, subject_id, sum(times * idf * 2.2 * (tf / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)))) AS score
       FROM hit JOIN idf USING (query_term) JOIN q USING (query_term) JOIN lens USING (subject_id), cs GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, subject_id) AS rank FROM bm QUALIFY rank <= 50)"""


@query("lexical_bm25_topk", f"WITH {_BM25} SELECT query_id, subject_id, round(score, 5) AS score, rank FROM lex")
def lexical_bm25_topk(spark, d):
    arm = search.lexical_arm(query_set(spark, d), subjects(spark, d))
    return arm.select("query_id", "subject_id", F.round("score", 5).alias("score"), "rank")


# --- token vectors -------------------------------------------------------------------------------
# The pretrained table is not at hand. This one is derived from the inputs: every word two documents
# share, every single character as a start and as a continuation, and the unknown token; each takes the
# stored embedding its name hashes to. Rare words therefore break into pieces.


def token_table(spark: SparkSession, d: str) -> DataFrame:
    docs = read_input(spark, d, "documents").select(
        F.explode(F.array_distinct(embedding.words(F.col("text")))).alias("word")
    )
    spread = written(docs.groupBy("word").agg(F.count("*").alias("n")))
    common = spread.filter((F.col("n") >= 2) & (F.length("word") <= embedding.LONGEST_WORD)).select("word")
    letters = spread.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").distinct()
    tokens = (
        common.union(letters)
        .union(letters.select(F.concat(F.lit("##"), F.col("letter"))))
        .union(spark.createDataFrame([("[UNK]",)], "word string"))
        .distinct()
    )
    stored = read_input(spark, d, "embeddings")
    count = stored.agg(F.count("*")).scalar()
    hashed = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long")
    return written(
        tokens.select(F.col("word").alias("token"))
        .withColumn("vec_id", F.pmod(hashed, count))
        .join(stored.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
        .select("token", "vector")
    )


def _words_sql(x: str) -> str:
    # The letters of the inputs fold by strip_accents alone.
    spaced = rf"regexp_replace({x}, '[\t\n\r\p{{Z}}]', ' ', 'g')"
    clean = rf"regexp_replace({spaced}, '[\p{{Cc}}\p{{Cf}}\p{{Co}}\x{{FFFD}}]', '', 'g')"
    apart = (
        rf"regexp_replace(strip_accents(lower({clean})), '([\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}\p{{P}}$+<=>^`|~])', ' \1 ', 'g')"
    )
    return f"list_filter(string_split({apart}, ' '), lambda w: w <> '')"


_TOKEN_TABLE = f"""dw AS (SELECT doc_id, unnest({_words_sql('text')}) AS word FROM documents),
qw AS (SELECT item_id, unnest({_words_sql('text')}) AS word FROM benchmark),
common AS (SELECT word FROM dw WHERE len(word) <= 100 GROUP BY word HAVING count(DISTINCT doc_id) >= 2),
letters AS (SELECT DISTINCT unnest(string_split(word, '')) AS letter FROM dw),
tok AS (SELECT word AS token FROM common UNION SELECT letter FROM letters UNION SELECT '##' || letter FROM letters UNION SELECT '[UNK]'),
tv AS (SELECT token, embedding FROM tok JOIN embeddings ON vec_id = ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)),
allw AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM qw)),
prefixes AS (SELECT word, max(i) AS n FROM (SELECT word, unnest(range(1, least(len(word), 100) + 1)) AS i FROM allw WHERE len(word) <= 100)
   WHERE left(word, i) IN (SELECT token FROM tok) GROUP BY word),
rest AS (SELECT word, generate_subscripts(string_split(substr(word, n + 1), ''), 1) AS pos, '##' || unnest(string_split(substr(word, n + 1), '')) AS token
   FROM prefixes WHERE n < len(word)),
broken AS (SELECT DISTINCT word FROM rest WHERE token NOT IN (SELECT token FROM tok)
   UNION SELECT word FROM allw WHERE word NOT IN (SELECT word FROM prefixes)),
piece AS (SELECT word, 0 AS pos, left(word, n) AS token FROM prefixes WHERE word NOT IN (SELECT word FROM broken)
   UNION ALL SELECT word, pos, token FROM rest WHERE word NOT IN (SELECT word FROM broken)
   UNION ALL SELECT word, 0, '[UNK]' FROM broken)"""

_VECTORS = f"""{_TOKEN_TABLE},
wsum AS (SELECT word, i, sum(embedding[i]::DOUBLE) AS v, count(*) AS pieces FROM piece JOIN tv USING (token), range(1, 65) r(i) GROUP BY ALL),
dsum AS (SELECT doc_id AS id, i, sum(n * v) AS v, sum(n * pieces) AS n_tokens FROM (SELECT doc_id, word, count(*) AS n FROM dw GROUP BY ALL) JOIN wsum USING (word) GROUP BY ALL),
qsum AS (SELECT item_id AS id, i, sum(n * v) AS v FROM (SELECT item_id, word, count(*) AS n FROM qw GROUP BY ALL) JOIN wsum USING (word) GROUP BY ALL),
dvec AS (SELECT id, n_tokens, list((v / norm)::FLOAT ORDER BY i) AS vec FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY id)) AS norm FROM dsum) GROUP BY ALL),
qvec AS (SELECT id, list((v / norm)::FLOAT ORDER BY i) AS vec FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY id)) AS norm FROM qsum) GROUP BY ALL)"""


@query(
    "word_pieces",
    f"WITH {_TOKEN_TABLE} SELECT word, pos, token FROM piece WHERE word IN (SELECT word FROM dw)",
)
def word_pieces(spark, d):
    words = read_input(spark, d, "documents").select(F.explode(embedding.words(F.col("text"))).alias("word")).distinct()
    return embedding.word_pieces(words, token_table(spark, d)).select("word", F.col("pos").cast("long").alias("pos"), "token")


@query(
    "token_mean_vectors",
    f"WITH {_VECTORS} SELECT id AS doc_id, n_tokens, array_to_string(list_transform(vec, lambda x: printf('%.3f', x + 0.0)), ' ') AS vector FROM dvec",
)
def token_mean_vectors(spark, d):
    docs = read_input(spark, d, "documents").select("doc_id", "text")
    made = embedding.token_mean_vectors(docs, token_table(spark, d), "doc_id")
    shown = F.array_join(F.transform("vector", lambda x: F.format_string("%.3f", x.cast("double"))), " ")
    return made.select("doc_id", "n_tokens", shown.alias("vector"))


@query(
    "token_table_check",
    f"""WITH {_TOKEN_TABLE} SELECT count(*) AS n_rows, count(DISTINCT token) AS n_tokens, min(len(embedding)) AS min_dim,
    max(len(embedding)) AS max_dim, bool_or(token = '[UNK]') AS has_unknown FROM tv""",
)
def token_table_check(spark, d):
    return embedding.check_token_table(token_table(spark, d))


# --- vector arm ----------------------------------------------------------------------------------


def label_prototypes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored vectors with their label as model, and per label one query: the label's mean direction."""
    stored = read_input(spark, d, "embeddings").select(
        F.col("vec_id").alias("subject_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("model")
    )
    mean = (
        stored.groupBy("model")
        .agg(vector_to_array(Summarizer.mean(array_to_vector(F.transform("vector", lambda x: x.cast("double"))))).alias("m"))
        .withColumn("norm", F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x)))
    )
    queries = mean.select(
        F.col("model").cast("long").alias("query_id"), F.transform("m", lambda x: x / F.col("norm")).alias("vector"), "model"
    )
    return queries, stored


@query(
    "vector_cosine_topk",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
    u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m),
    s AS (SELECT e.label AS query_id, vec_id AS subject_id, greatest(-1, least(1, sum(e.x * u.x))) AS score
          FROM e JOIN u ON e.label = u.label AND e.i = u.i GROUP BY ALL HAVING score >= 0.25)
    SELECT query_id, subject_id, round(score, 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, subject_id) AS rank FROM s QUALIFY rank <= 50""",
)
def vector_cosine_topk(spark, d):
    found = vectors.cosine_topk(*label_prototypes(spark, d))
    return found.select("query_id", "subject_id", F.round("score", 6).alias("score"), "rank")


def document_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Query and document vectors from one pass over the words of both, stored once for all that read them."""
    docs = read_input(spark, d, "documents").select(F.struct(F.lit("d").alias("side"), F.col("doc_id").alias("id")).alias("k"), "text")
    asks = read_input(spark, d, "benchmark").select(F.struct(F.lit("q").alias("side"), F.col("item_id").alias("id")).alias("k"), "text")
    made = embedding.token_mean_vectors(docs.unionByName(asks), token_table(spark, d), "k")
    both = written(made.withColumn("model", F.lit("token-mean")))
    of = lambda side, name: both.filter(F.col("k.side") == side).select(F.col("k.id").alias(name), "vector", "model")
    return of("q", "query_id"), of("d", "subject_id")


_COSINE = f"""{_VECTORS},
cosine AS (SELECT q.id AS query_id, v.id AS subject_id, greatest(-1, least(1, list_inner_product(q.vec::DOUBLE[], v.vec::DOUBLE[]))) AS score
  FROM qvec q, dvec v),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, subject_id) AS rank FROM cosine
  WHERE score >= 0.25 QUALIFY rank <= 50)"""


@query("document_vector_topk", f"WITH {_COSINE} SELECT query_id, subject_id, round(score, 4) AS score, rank FROM vec")
def document_vector_topk(spark, d):
    asked, stored = document_vectors(spark, d)
    found = search.vector_arm(query_set(spark, d), stored, asked)
    return found.select("query_id", "subject_id", F.round("score", 4).alias("score"), "rank")


# --- fusion and hybrid search --------------------------------------------------------------------


@query(
    "rrf_fusion",
    f"""WITH {_BM25}, {_COSINE}
    SELECT query_id, subject_id, round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0), 9) AS fused_score,
      l.rank AS lexical_rank, v.rank AS vector_rank, l.rank IS NOT NULL AND v.rank IS NOT NULL AS found_by_both,
      l.rank IS NULL AS semantic_only
    FROM lex l FULL JOIN vec v USING (query_id, subject_id)""",
)
def rrf_fusion(spark, d):
    asks = query_set(spark, d)
    asked, stored = document_vectors(spark, d)
    fused = ranking.rrf(search.lexical_arm(asks, subjects(spark, d)), search.vector_arm(asks, stored, asked))
    return fused.select(
        "query_id", "subject_id", F.round("fused_score", 9).alias("fused_score"), "lexical_rank", "vector_rank", "found_by_both", "semantic_only"
    )


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Live subjects: captured when the order of that number was placed, deleted if it is pending."""
    orders = read_input(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("captured_at"), (F.col("o_orderstatus") == "P").alias("gone")
    )
    first_note = (
        read_input(spark, d, "conversations")
        .filter(F.col("role") == "user")
        .groupBy(F.col("conv_id").alias("doc_id"))
        .agg(F.min_by("text", "turn").alias("note"))
    )
    return (
        read_input(spark, d, "documents")
        .join(orders, "doc_id")
        .filter(~F.col("gone"))
        .join(first_note, "doc_id", "left")
        .select(
            F.col("doc_id").alias("subject_id"), F.col("source").alias("title"), F.col("lang").alias("subtitle"), "note", "captured_at"
        )
    )


def _matched_sql(q: str, text: str) -> str:
    return (
        f"list_filter(list_transform(list_sort(list_transform(list_distinct({S.terms(q)}), lambda t: {{'p': list_position({S.terms(q)}, t), 't': t}})), lambda s: s.t), "
        f"lambda t: len(list_filter({S.terms(text)}, lambda w: starts_with(w, t))) > 0)"
    )


_HYBRID = f"""
fused AS (SELECT query_id, subject_id, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS fused,
     l.rank IS NULL AS semantic_only FROM lex l FULL JOIN vec v USING (query_id, subject_id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, subject_id) AS fr FROM fused QUALIFY fr <= 20),
hyd AS (SELECT kept.*, b.text AS q, d.source AS title, d.lang AS subtitle, c.note, o.o_orderdate AS captured_at
  FROM kept JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = subject_id
  JOIN orders o ON o.o_orderkey = subject_id AND o.o_orderstatus <> 'P'
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS note FROM conversations WHERE role = 'user' GROUP BY conv_id) c ON c.conv_id = subject_id),
sig AS (SELECT *, {_matched_sql('q', "concat_ws(' ', coalesce(title, ''), coalesce(subtitle, ''), coalesce(note, ''))")} AS matched,
  len({_matched_sql('q', "coalesce(note, '')")}) > 0 AS noted,
  least(1, fused / (2.0 / 61)) AS semantic,
  pow(0.5, greatest(0, epoch(TIMESTAMP '{AS_OF}') - epoch(captured_at)) / (730 * 86400.0)) AS fresh FROM hyd),
scored AS (SELECT *, least(1, 0.38 * semantic + 0.18 * noted::INT + 0.05 + 0.03 * fresh) AS utility FROM sig)"""


@query(
    "hybrid_search",
    f"""WITH {_BM25}, {_COSINE}, {_HYBRID}
    SELECT query_id, subject_id, row_number() OVER (PARTITION BY query_id ORDER BY round(utility, 12) DESC, subject_id) AS rank,
      round(utility, 6) AS utility, title,
      array_to_string(list_filter([CASE WHEN noted THEN 'your note' END, CASE WHEN len(matched) > 0 THEN array_to_string(matched[1:3], ', ') END,
        CASE WHEN semantic_only AND NOT noted AND len(matched) = 0 THEN 'similar meaning' END], lambda r: r IS NOT NULL), ' | ') AS reasons,
      semantic_only AS matched_on_meaning_only FROM scored""",
)
def hybrid_search(spark, d):
    asks, texts = query_set(spark, d), subjects(spark, d)
    asked, stored = document_vectors(spark, d)
    hits = search.hybrid_search(
        asks,
        search.lexical_arm(asks, texts),
        search.vector_arm(asks, stored, asked),
        summaries(spark, d),
        F.lit(AS_OF).cast("timestamp"),
    )
    return hits.select(
        "query_id", "subject_id", "rank", F.round("utility", 6).alias("utility"), "title",
        F.array_join("reasons", " | ").alias("reasons"), "matched_on_meaning_only",
    )


@query(
    "rank_ablation",
    f"""WITH {_BM25}, lower_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score / doc_len, 9) DESC, subject_id) AS rb
      FROM (SELECT bm.*, doc_len FROM bm JOIN lens USING (subject_id)) QUALIFY rb <= 50)
    SELECT query_id, subject_id, lex.rank AS rank_a, rb AS rank_b, lex.rank - rb AS moved FROM lex FULL JOIN lower_rank USING (query_id, subject_id)""",
)
def rank_ablation(spark, d):
    """The lexical run against a run that divides each score by the document's length."""
    rows, asks = written(lexical.texts_by_subject(subjects(spark, d))), query_set(spark, d)
    return ranking.rank_ablation(
        lexical.ranked_scan(asks, rows, rows, 50), lexical.ranked_scan(asks, rows, rows, 50, by_length=True)
    )


# --- signals and utility -------------------------------------------------------------------------


def feedback(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "outdated").when(F.col("quality") == 1, "useful").otherwise("not_relevant")
    return read_input(spark, d, "labels").select(F.col("doc_id").alias("subject_id"), verdict.alias("verdict"))


_FEEDBACK = "(SELECT doc_id, CASE WHEN toxic = 1 THEN 'outdated' WHEN quality = 1 THEN 'useful' ELSE 'not_relevant' END AS verdict FROM labels)"


@query(
    "trust_from_feedback",
    f"""SELECT source, count(*) FILTER (verdict = 'useful') AS useful, count(*) FILTER (verdict = 'not_relevant') AS not_relevant,
      round((count(*) FILTER (verdict = 'useful') + 1) / (count(*) FILTER (verdict IN ('useful', 'not_relevant')) + 2), 6) AS trust
    FROM {_FEEDBACK} JOIN documents USING (doc_id) GROUP BY source""",
)
def trust_from_feedback(spark, d):
    docs = read_input(spark, d, "documents").select(F.col("doc_id").alias("subject_id"), "source")
    said = ranking.trust_scores(feedback(spark, d).join(docs, "subject_id"), "source")
    return said.withColumn("trust", F.round("trust", 6))


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of every document: verdicts, purchases by the user of that number, verified order lines."""
    docs = read_input(spark, d, "documents").select(F.col("doc_id").alias("subject_id"))
    uses = read_input(spark, d, "events").select(
        F.col("user_id").alias("subject_id"), F.when(F.col("event_type") == "purchase", "used").otherwise("viewed").alias("kind")
    )
    lines = read_input(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("subject_id"), (F.col("l_returnflag") == "N").alias("verified_by_user")
    )
    made = ranking.ranking_signals(docs, feedback(spark, d), uses, lines)
    chars = read_input(spark, d, "documents").select(
        F.col("doc_id").alias("subject_id"), (F.col("n_chars") / 5000).alias("semantic"), (F.col("lang") == "en").cast("double").alias("category_match")
    )
    return made.join(chars, "subject_id")


_SIGNALS = f"""(SELECT d.doc_id AS subject_id, d.n_chars / 5000 AS semantic, (d.lang = 'en')::INT AS category_match,
  (coalesce(u, 0) + 1) / (coalesce(u, 0) + coalesce(n, 0) + 2) AS trust, coalesce(o, FALSE) AS is_outdated,
  coalesce(used, 0) AS previous_use, coalesce(ver, 0) AS verified FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) FILTER (verdict = 'useful') AS u, count(*) FILTER (verdict = 'not_relevant') AS n, bool_or(verdict = 'outdated') AS o FROM {_FEEDBACK} GROUP BY doc_id) f ON f.doc_id = d.doc_id
  LEFT JOIN (SELECT user_id, max((event_type = 'purchase')::INT) AS used FROM events GROUP BY user_id) e ON e.user_id = d.doc_id
  LEFT JOIN (SELECT l_orderkey, avg((l_returnflag = 'N')::INT) AS ver FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = d.doc_id)"""
_WEIGHTED = f"""(SELECT *, c1 + c2 + c3 + 0.03 * 0.5 + c5 + c6 - CASE WHEN is_outdated THEN 0.2 ELSE 0 END AS raw FROM (
  SELECT *, 0.38 * least(1, greatest(0, semantic)) AS c1, 0.12 * category_match AS c2, 0.10 * trust AS c3, 0.06 * previous_use AS c5, 0.05 * verified AS c6 FROM {_SIGNALS}))"""


@query(
    "ranking_signals",
    f"SELECT subject_id, round(trust, 6) AS trust, is_outdated, previous_use::DOUBLE AS previous_use, round(verified, 6) AS verified FROM {_SIGNALS}",
)
def ranking_signals(spark, d):
    return signals(spark, d).select(
        "subject_id", F.round("trust", 6).alias("trust"), "is_outdated", "previous_use", F.round("verified", 6).alias("verified")
    )


_ASKERS = """(SELECT c_custkey AS query_id, n_name || ' ' || c_custkey % 5 AS area, CASE WHEN c_custkey % 7 > 0 THEN n_name END AS city, r_name AS country
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_PLACES = """(SELECT s_suppkey AS subject_id, lower(n_name || ' ' || s_suppkey % 5) AS area, n_name AS city, r_name AS country
  FROM supplier JOIN nation ON n_nationkey = s_nationkey OR n_nationkey = (s_nationkey + s_suppkey) % 25 JOIN region ON r_regionkey = n_regionkey)"""
_ASKED_HITS = "(SELECT DISTINCT o_custkey AS query_id, l_suppkey AS subject_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_KINDS = f"(SELECT doc_id, {S.category('lower(text)')} AS category FROM documents)"


@query(
    "place_signals",
    f"""SELECT h.query_id, h.subject_id, coalesce(max(CASE WHEN lower(p.area) = lower(a.area) AND coalesce(p.city = a.city, TRUE) AND p.country = a.country THEN 1.0::DOUBLE
        WHEN p.city = a.city AND p.country = a.country THEN 0.6::DOUBLE WHEN p.country = a.country THEN 0.3::DOUBLE ELSE 0 END), 0) AS location,
      max(coalesce(x.category = y.category, FALSE)::INT)::DOUBLE AS category_match
    FROM {_ASKED_HITS} h JOIN {_ASKERS} a USING (query_id) LEFT JOIN {_PLACES} p ON p.subject_id = h.subject_id
    LEFT JOIN {_KINDS} x ON x.doc_id = h.query_id LEFT JOIN {_KINDS} y ON y.doc_id = h.subject_id GROUP BY ALL""",
)
def place_signals(spark, d):
    """Customers ask and the suppliers of their orders are found: how near these are, and whether their texts are of one kind."""
    orders = read_input(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id"))
    lines = read_input(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("subject_id"))
    hits = written(lines.join(orders, "o_orderkey").select("query_id", "subject_id").distinct())
    nations = read_input(spark, d, "nation").join(read_input(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("country"))
    area = lambda key: F.concat_ws(" ", "city", F.pmod(key, F.lit(5)).cast("string"))
    c = read_input(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    askers = c.select(
        F.col("c_custkey").alias("query_id"), area("c_custkey").alias("area"), F.when(F.col("c_custkey") % 7 > 0, F.col("city")).alias("city"), "country"
    )
    s = read_input(spark, d, "supplier")
    s = s.withColumn("n_nationkey", F.explode(F.array_distinct(F.array("s_nationkey", F.pmod(F.col("s_nationkey") + F.col("s_suppkey"), F.lit(25)).cast("int")))))
    places = s.join(nations, "n_nationkey").select(F.col("s_suppkey").alias("subject_id"), F.lower(area("s_suppkey")).alias("area"), "city", "country")
    kinds = written(cues.classify_cues(read_input(spark, d, "documents"), "doc_id", "text"))
    asked, offered = (kinds.withColumnRenamed("doc_id", key) for key in ("query_id", "subject_id"))
    return ranking.place_and_category(hits, askers, places, asked, offered)


@query("utility_rank", f"SELECT subject_id, round(least(1, greatest(0, raw)), 6) AS utility FROM {_WEIGHTED}")
def utility_rank(spark, d):
    return ranking.utility(signals(spark, d)).select("subject_id", F.round("utility", 6).alias("utility"))


@query(
    "utility_reasons",
    f"""SELECT subject_id, array_to_string(list_transform(list_sort(list_filter([
        {{'v': -c1, 'i': 0, 's': 'semantic'}}, {{'v': -c2, 'i': 2, 's': 'category_match'}}, {{'v': -c3, 'i': 3, 's': 'trust'}},
        {{'v': -c5, 'i': 5, 's': 'previous_use'}}, {{'v': -c6, 'i': 6, 's': 'verified'}}, {{'v': -0.03 * 0.5, 'i': 7, 's': 'freshness'}}],
        lambda x: x.v <= -0.02))[1:3], lambda x: x.s), ',') AS reasons FROM {_WEIGHTED}""",
)
def utility_reasons(spark, d):
    scored = ranking.utility(signals(spark, d))
    return scored.select("subject_id", F.array_join(ranking.top_reasons(F.col("contributions")), ",").alias("reasons"))


@query(
    "weights_row",
    """SELECT max(CASE WHEN key = 'semantic' THEN value END) AS semantic, 0.18::DOUBLE AS note_relevance, max(CASE WHEN key = 'trust' THEN value END) AS trust
    FROM (SELECT CASE WHEN p_size <= 25 THEN 'semantic' WHEN p_size <= 40 THEN 'trust' ELSE 'other' END AS key, p_size / 100 AS value FROM part)""",
)
def weights_row(spark, d):
    """A weights table derived from part sizes; a key it lacks keeps its default."""
    key = F.when(F.col("p_size") <= 25, "semantic").when(F.col("p_size") <= 40, "trust").otherwise("other")
    table = read_input(spark, d, "part").select(key.alias("key"), (F.col("p_size") / 100).alias("value"))
    return ranking.weights_row(table).select("semantic", "note_relevance", "trust")


# --- quantization --------------------------------------------------------------------------------

_QUANT = """q AS (SELECT vec_id, embedding, CASE WHEN m = 0 THEN 1::FLOAT ELSE (m::DOUBLE / 127)::FLOAT END AS scale
  FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x))) AS m FROM embeddings)),
q8 AS (SELECT *, list_transform(embedding, lambda x: greatest(-127, least(127, round_even((x::DOUBLE / scale::DOUBLE)::FLOAT, 0)::INT))) AS codes FROM q)"""


@query(
    "quantize_int8",
    f"WITH {_QUANT} SELECT vec_id, round(scale::DOUBLE, 8) AS scale, array_to_string(codes, ' ') AS codes FROM q8",
)
def quantize_int8(spark, d):
    made = vectors.quantize_int8(read_input(spark, d, "embeddings"), "embedding")
    return made.select(
        "vec_id", F.round(F.col("scale").cast("double"), 8).alias("scale"),
        F.array_join(F.transform("quantized", lambda x: x.cast("string")), " ").alias("codes"),
    )


@query(
    "quantize_quality",
    f"""WITH {_QUANT}, r AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (unnest(codes)::DOUBLE * scale::DOUBLE)::FLOAT::DOUBLE AS y FROM q8)
    SELECT round(max(gap), 6) AS max_abs_error, round(min(cos), 6) AS worst_cosine, min(cos) >= 0.999 AS passes FROM (
      SELECT vec_id, max(abs(x - y)) AS gap, sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)) AS cos FROM r GROUP BY vec_id)""",
)
def quantize_quality(spark, d):
    return vectors.quantize_quality(read_input(spark, d, "embeddings"), "embedding").select(
        F.round("max_abs_error", 6).alias("max_abs_error"), F.round("worst_cosine", 6).alias("worst_cosine"), "passes"
    )


@query(
    "vector_parity",
    f"""WITH {_QUANT}, r AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (unnest(codes)::DOUBLE * scale::DOUBLE)::FLOAT::DOUBLE AS y FROM q8)
    SELECT vec_id AS subject_id, round(max(abs(x - y)), 6) AS gap, max(abs(x - y)) <= 0.0015 AS same FROM r GROUP BY vec_id""",
)
def vector_parity(spark, d):
    stored = read_input(spark, d, "embeddings")
    back = vectors.dequantize(vectors.quantize_int8(stored, "embedding"))
    made = vectors.vector_parity(
        stored.select(F.col("vec_id").alias("subject_id"), F.col("embedding").alias("vector")),
        back.select(F.col("vec_id").alias("subject_id"), F.col("restored").alias("vector")),
        tolerance=0.0015,
    )
    return made.select("subject_id", F.round("gap", 6).alias("gap"), "same")

