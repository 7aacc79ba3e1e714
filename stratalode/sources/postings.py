"""A keyword index: postings sorted by term, written once and read by term.

``postings`` holds ``term, id, tf, dl`` in the order of term and id, so a query's
filter on its few terms skips nearly all row groups by their minimum and maximum;
``totals`` holds one row, ``n, avgdl``.  A term that occurs in every document fills
many files: rows are ranged by term and id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms, terms
from .generations import Store
from .shared import shared_folder

K1, B = 1.2, 0.75


def postings(docs: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """``term, id, tf, dl`` of every document with a text; counts are made inside the row."""
    src = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), terms(text).alias("t"))
    each = src.select("id", F.size("t").alias("dl"), F.explode(F.array_sort("t")).alias("term"))
    return each.groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def totals(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.size(terms(text))).alias("avgdl"))


def build(docs: DataFrame, store: Store, ident: str = "id", text: str = "text") -> int:
    """Writes the index as the store's next generation and returns its number."""
    expected = store.current()
    p = postings(docs, ident, text).repartitionByRange("term", "id").sortWithinPartitions("term", "id")
    written = store.write({"postings": p, "totals": totals(docs, text)})
    if not store.publish(written, expected):
        raise RuntimeError("another writer published first")
    return expected + 1


def fingerprint(spark: SparkSession, at: str) -> str:
    """Names, sizes and times of a table's files: changes when any of them does."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))
    return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(repr((at, files)))[:24]


def index_of(spark: SparkSession, folder: str, table: str, ident: str, text: str) -> Store:
    """The index of a table, beside the checkpoints; built if there is none for the files as they are."""
    at = f"{folder}/{table}.parquet"
    store = Store(spark, f"{shared_folder(spark)}/keywords/{table}-{text}-{fingerprint(spark, at)}")
    if not store.current():
        try:
            build(spark.read.parquet(at).select(ident, text), store, ident, text)
        except RuntimeError:
            if not store.current():
                raise
            # another session built the same index first: that one serves
    return store


def bm25(store: Store, query: str) -> DataFrame:
    """``id, score`` of every document that holds a query term; ln, k1 = 1.2, b = 0.75, idf at least 1e-6.

    Only the postings of the query's terms are read.  Terms are unstemmed and keep
    their accents; an unknown term counts nothing; a query without terms finds nothing.
    """
    asked = query_terms(query)
    p = store.read("postings").where(F.col("term").isin(*asked) if asked else F.lit(False))
    found = p.groupBy("term").agg(F.count("*").alias("df"))  # one row per query term
    n, df, tf = F.col("n").cast("double"), F.col("df"), F.col("tf").cast("double")
    idf = F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    one = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = p.join(F.broadcast(found.crossJoin(F.broadcast(store.read("totals")))), "term")  # at most 32 terms
    return rows.groupBy("id").agg(F.round(F.sum(one), 6).alias("score"))
