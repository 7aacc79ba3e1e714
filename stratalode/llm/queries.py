"""Queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from . import distinctive, handwritten, leaks, mixing, neighbors, parsecheck, pii, secrets, split


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.broken_paths(table(spark, d, "docs"))


def p1_rates(spark, d):
    return parsecheck.broken_rates(table(spark, d, "docs"), table(spark, d, "structural_files"))


def p2_found(spark, d):
    return handwritten.not_handwritten(table(spark, d, "docs"))


def p2_reasons(spark, d):
    return handwritten.classify(table(spark, d, "docs"))


#: Attribute files planted in every repository, by directory: generic ones at its root, one below that takes some back.
PLANTED = {"": "*_test.go linguist-generated\ncore/** linguist-vendored\napi/*/*.py linguist-generated=true\n/core/*/*.md -linguist-vendored\n", "core": "*.js -linguist-vendored\n*.ts linguist-generated\n"}


def p2_declared(spark, d):
    """What planted attribute files say of every path: the deepest directory, then the last line, wins."""
    paths = table(spark, d, "docs").where("path is not null").select("path").distinct()
    repositories = paths.select(F.substring_index("path", "/", 1).alias("repository")).distinct()
    rows = [(f"/{directory}/.gitattributes".replace("//", "/"), text) for directory, text in PLANTED.items()]
    planted = repositories.crossJoin(F.broadcast(spark.createDataFrame(rows, "at string, body string"))).select(F.concat("repository", "at").alias("path"), "body")  # two files per repository
    return handwritten.declarations(paths, planted)


def p3_found(spark, d):
    """Terms that mark their row more than the rest of the collection; the counts of the case are checked by the operator."""
    return distinctive.score_terms(table(spark, d, "docs"), least_tf=5, most_df=3).where("z > 0").select("id", "term")


def p3_scores(spark, d):
    return distinctive.score_terms(table(spark, d, "docs")).withColumn("z", F.round("z", 4))


def p4_found(spark, d):
    return secrets.secret_lines(table(spark, d, "docs"))


def p4_redacted(spark, d):
    return secrets.redacted(table(spark, d, "docs"))


def p6_found(spark, d):
    return split.split_oversized(table(spark, d, "docs")).where("piece_no = 1").select("id")


def p6_pieces(spark, d):
    return split.split_oversized(table(spark, d, "docs"))


def p6_reassembled(spark, d):
    """Pieces put together again: the body's digest, and whether every piece keeps the limit and begins with the end of the one before."""
    docs = table(spark, d, "docs")
    p = split.split_oversized(docs)
    raw = F.col("piece").cast("binary")
    w = Window.partitionBy("id").orderBy("piece_no")  # the pieces of one body
    p = p.select("id", "piece_no", raw.alias("raw"), F.octet_length(raw).alias("n"), "start_byte", "end_byte").withColumn("shared", F.coalesce(F.lag("end_byte").over(w) - F.col("start_byte"), F.lit(0)))
    fresh = F.expr("substring(raw, cast(shared as int) + 1, n)")
    p = p.withColumn("ok", (F.col("n") <= 8192) & (F.col("n") == F.col("end_byte") - F.col("start_byte")) & (F.col("piece_no") == 0) | (F.col("n") <= 8192) & F.col("shared").between(253, 256))
    whole = F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("part"))))
    out = p.groupBy("id").agg(whole.alias("parts"), F.min("ok").alias("kept"))
    return out.select("id", F.sha2(F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["part"])), 256).alias("digest"), "kept")


def p7_found(spark, d):
    return neighbors.similar_pairs(table(spark, d, "docs"))


def p7_neighbors(spark, d):
    """The five most similar rows of every row with a vector."""
    return neighbors.neighbors(table(spark, d, "docs")).select("id", "rank", "neighbor")


def p7_search(spark, d):
    """Every row whose id is divisible by 50, against all rows."""
    docs = table(spark, d, "docs")
    return neighbors.search(docs, docs.where("id % 50 = 0")).select("id", "rank", "neighbor")


def p8_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_passages(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark, d):
    """The chosen rows with their repeats, and beside each what its source reached."""
    chosen, report = mixing.mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))
    return chosen.join(F.broadcast(report.select("source", "target_share", "reached_share")), "source")  # one row per source


def p9_shares(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p10_found(spark, d):
    return pii.items(table(spark, d, "documents"), table(spark, d, "contributors")).select("doc_id", "start_char", "kind")


def p10_anonymised(spark, d):
    return pii.anonymised(table(spark, d, "documents"), table(spark, d, "contributors"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_reasons, p2_declared, p3_found, p3_scores, p4_found, p4_redacted, p6_found, p6_pieces, p6_reassembled, p7_found, p7_neighbors, p7_search, p8_found, p8_passages, p9_mix, p9_shares, p10_found, p10_anonymised)
}

_COUNTS = """
words AS (SELECT id, unnest(string_split_regex(lower(terms), '\\s+')) AS term FROM docs WHERE terms IS NOT NULL),
counts AS (SELECT id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY id, term),
stats AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM counts GROUP BY term)
"""

# brute force over all pairs of rows with a vector
_PAIRS = """
v AS (SELECT id, vector::DOUBLE[] AS v, sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) AS n FROM docs WHERE vector IS NOT NULL),
s AS (SELECT a.id, b.id AS neighbor, round(list_inner_product(a.v, b.v) / (a.n * b.n), 7) AS cosine FROM v a JOIN v b ON a.id <> b.id WHERE a.n > 0 AND b.n > 0 {where}),
r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbor) AS rank, neighbor, cosine FROM s QUALIFY rank <= 5)
"""

SQL: dict[str, str] = {
    "p2_declared": """WITH p AS (SELECT DISTINCT path FROM docs WHERE path IS NOT NULL), i AS (SELECT path, substr(path, instr(path, '/') + 1) AS q FROM p WHERE contains(path, '/')),
m AS (SELECT path, starts_with(q, 'core/') AS core, len(string_split(q, '/')) AS n, q FROM i),
s AS (SELECT path, CASE WHEN core AND q LIKE '%.ts' THEN true WHEN q LIKE '%\\_test.go' ESCAPE '\\' THEN true WHEN q LIKE 'api/%.py' AND n = 3 THEN true END AS generated,
  CASE WHEN core AND q LIKE '%.js' THEN false WHEN core AND q LIKE '%.md' AND n = 3 THEN false WHEN core THEN true END AS vendored FROM m)
SELECT path, CASE WHEN generated THEN 'generated' WHEN vendored THEN 'vendored' ELSE 'handwritten' END AS said FROM s WHERE generated IS NOT NULL OR vendored IS NOT NULL""",
    "p6_reassembled": "SELECT id, sha256(body) AS digest, true AS kept FROM docs WHERE octet_length(encode(body)) > 8192",
    "p7_found": f"WITH {_PAIRS.format(where='')} SELECT DISTINCT least(id, neighbor) AS id_a, greatest(id, neighbor) AS id_b FROM r WHERE cosine >= 0.9",
    "p7_neighbors": f"WITH {_PAIRS.format(where='')} SELECT id, rank, neighbor FROM r",
    "p7_search": f"WITH {_PAIRS.format(where='AND a.id % 50 = 0')} SELECT id, rank, neighbor FROM r",
    "p3_found": f"WITH {_COUNTS} SELECT id, term FROM counts JOIN stats USING (term) WHERE tf >= 5 AND df <= 3",
    "p3_scores": f"""WITH {_COUNTS},
rows AS (SELECT id, sum(tf)::DOUBLE AS n FROM counts GROUP BY id),
total AS (SELECT sum(tf)::DOUBLE AS total FROM counts),
v AS (SELECT id, term, tf, cf, df, n, total, 0.1::DOUBLE * cf AS a, total * 0.1::DOUBLE AS a0
      FROM counts JOIN stats USING (term) JOIN rows USING (id) CROSS JOIN total)
SELECT id, term, tf, cf, df,
  round((ln((tf + a) / (n + a0 - tf - a)) - ln((cf - tf + a) / (total - n + a0 - (cf - tf) - a)))
        / sqrt(1 / (tf + a) + 1 / (cf - tf + a)), 4) AS z
FROM v""",
    "p6_found": "SELECT id FROM docs WHERE octet_length(encode(body)) > 8192",
}
