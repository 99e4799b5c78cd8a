"""A search index that is replaced by subject: postings, lengths and vectors of changed texts, readable after every batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill.functions import fixed
from cardmill.functions.scoring import is_usable
from cardmill.operators.embedding import token_mean_vectors
from cardmill.operators.lexical import INDEX_COLUMNS, doc_stats, listed_postings, query_terms, ranked_scan, subject_postings, terms_of_subjects
from cardmill.operators.vectors import cosine_topk
from cardmill.session import written
from cardmill.sources.segments import Segments

STREAM = "texts"


class IndexStore(Segments):
    """Postings are stored in one row per subject and read one by one."""

    def stored(self, table: str, only: DataFrame | None = None) -> DataFrame:
        return super().read(table, only)

    def read(self, table: str, only: DataFrame | None = None) -> DataFrame:
        rows = self.stored(table, only)
        return listed_postings(rows) if table == "postings" else rows


def index_store(spark: SparkSession, path: str) -> IndexStore:
    """postings, lengths (with the stamp of the newest change, and whether it took the subject out) and vectors, all by subject."""
    return IndexStore(spark, path, {"postings": ["subject_id"], "lengths": ["subject_id"], "vectors": ["subject_id"]})


def index_changes(
    store: IndexStore,
    changes: DataFrame,
    batch_id: int,
    token_vectors: DataFrame | None = None,
    model: str = "token-mean",
    columns: Sequence[str] = INDEX_COLUMNS,
    vector_text: str | None = None,
    stream: str = STREAM,
) -> bool:
    """Indexes one batch of (subject_id, stamp, gone, text columns); False if the batch was applied before.

    Of a subject the latest stamp counts: an old change that comes late has no effect. ``gone`` takes the subject out of
    the index, its stamp stays known. Old postings and vectors of a changed subject end with the commit that brings the
    new ones, so text and vectors never disagree. ``vector_text`` names the column that vectors are made of, if not all.
    """
    if batch_id <= store.applied(stream):
        return False
    row = F.struct("stamp", "gone", *columns)
    newest = changes.dropna(subset=["subject_id", "stamp"]).groupBy("subject_id").agg(F.max_by(row, row).alias("c"))
    newest = newest.select("subject_id", "c.*")
    if store.has("lengths"):
        known = store.read("lengths", newest).select("subject_id", F.col("stamp").alias("_stamp"))
        newest = newest.join(known, "subject_id", "left").filter(F.col("_stamp").isNull() | (F.col("stamp") >= F.col("_stamp")))
    newest = written(newest.withColumn("gone", F.coalesce("gone", F.lit(False))).select("subject_id", "stamp", "gone", *columns))
    texts = newest.filter(~F.col("gone"))
    stamps = newest.select("subject_id", "stamp", "gone").join(doc_stats(texts, columns), "subject_id", "left")
    touched = newest.select("subject_id")
    changed = {"postings": (subject_postings(texts, columns), touched), "lengths": (stamps.select("subject_id", "doc_len", "stamp", "gone"), touched)}
    if token_vectors is not None:
        text = F.col(vector_text) if vector_text else F.concat_ws(" ", *columns)
        vectors = token_mean_vectors(texts.select("subject_id", text.alias("text")), token_vectors, "subject_id")
        vectors = vectors.filter(is_usable(F.col("vector"))).withColumn("model", F.lit(model))
        changed["vectors"] = (vectors.select("subject_id", "vector", "model"), touched)
    return store.commit(stream, batch_id, changed)


def index_stream(
    changes: DataFrame,
    store: IndexStore,
    checkpoint: str,
    token_vectors: DataFrame | None = None,
    columns: Sequence[str] = INDEX_COLUMNS,
    vector_text: str | None = None,
) -> StreamingQuery:
    """New and changed texts are searchable after their batch; segments are merged on the way."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        index_changes(store, batch, batch_id, token_vectors, columns=columns, vector_text=vector_text)
        store.compact()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def remove_subjects(store: IndexStore, ids: DataFrame, stream: str, batch_id: int) -> bool:
    """Takes subjects out for good: postings, lengths and vectors, the stamp included."""
    gone = ids.select("subject_id").distinct()
    tables = [t for t in store.keys if store.has(t)]
    return store.commit(stream, batch_id, {t: (store.stored(t, gone).limit(0), gone) for t in tables})


def stored_lexical_arm(queries: DataFrame, store: IndexStore, k: int | None = fixed.ARM_LIMIT) -> DataFrame:
    """BM25 over the stored postings; lengths of empty texts count, subjects that are gone do not."""
    lengths = store.read("lengths").filter(~F.col("gone")).select("subject_id", "doc_len")
    return ranked_scan(queries, written(terms_of_subjects(store.stored("postings"))), lengths, k)


def query_vectors(queries: DataFrame, token_vectors: DataFrame, model: str = "token-mean") -> DataFrame:
    return token_mean_vectors(queries.select("query_id", "text"), token_vectors, "query_id").withColumn("model", F.lit(model))


def stored_vector_arm(queries: DataFrame, query_vectors: DataFrame, store: IndexStore) -> DataFrame:
    """Cosine over the stored vectors, for queries with something searchable in them."""
    asked = query_terms(queries).select("query_id").distinct()
    return cosine_topk(query_vectors.join(asked, "query_id", "left_semi"), store.read("vectors"))
