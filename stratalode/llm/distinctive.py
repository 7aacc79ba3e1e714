"""How distinctive a term is per record (problem 3).

Log-odds ratio of a record against the rest of the collection with an
informative Dirichlet prior taken from the collection counts, divided by its
standard error.  With y a term's count in a record of n terms, c its count in
the collection of N terms, and the prior a = L * c of total A = L * N:

    delta = ln((y + a) / (n + A - y - a)) - ln((c - y + a) / (N - n + A - (c - y) - a))
    z     = delta / sqrt(1 / (y + a) + 1 / (c - y + a))

The prior is a fixed share L of the collection, so scores do not drift as the
collection grows, and a term seen in one record only still gets a finite error.

Terms are counted inside each record before anything is shuffled; collection
counts are combined per task, so a term that occurs in every record travels
once per task.  The scores join counts to records by term.  Where only counts of
some size can come out, one pass over the texts writes these and the combined
collection counts to the shared folder, and both are read back; where all come
out, counting again is cheaper than writing them.  A term of a third of all rows
makes a skewed join side, which is salted: rows spread over ``SALTS`` keys and the
(narrow, one row per term) statistics are repeated for them.

Defined results: null or blank terms give no rows; rows repeated in the table
count as rows; in a collection of one record there is no rest, and the score is
still finite, as the prior counts.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.rowmap import map_rows, to_batch
from ..sources.shared import cut
from ..sources.ship import ship

PRIOR_SHARE = 0.1
SALTS = 16
#: Terms whose counts a task holds before it passes them on.
HELD = 200_000


def _count():
    def row(ident, terms):
        counts = Counter(terms.lower().split())
        n = sum(counts.values())
        return [(ident, t, y, n) for t, y in counts.items()]

    return row


def term_counts(docs: DataFrame, ident: str = "id", terms: str = "terms") -> DataFrame:
    """``id, term, tf, n``: occurrences in the row and the row's number of terms."""
    src = docs.where(F.col(terms).isNotNull()).select(F.col(ident).alias("id"), F.col(terms).alias("terms"))
    return map_rows(src, _count, "id bigint, term string, tf bigint, n bigint")


def term_statistics(counts: DataFrame) -> DataFrame:
    """``term, cf, df`` over all rows."""
    # the filter that the join would add to one of the readers only: with it all of them share one exchange
    return counts.where("term is not null").groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def counted_once(docs: DataFrame, least_tf: int, ident: str = "id", terms: str = "terms") -> tuple[DataFrame, DataFrame]:
    """Counts of at least ``least_tf`` and the statistics of all terms, from one pass over the texts."""
    spec = T.StructType.fromDDL("id bigint, term string, tf bigint, n bigint, df bigint")
    arrow = to_arrow_schema(spec)
    ship(docs.sparkSession)

    def run(batches):
        held: dict[str, list[int]] = {}

        def pass_on():
            rows = [(None, t, c, None, d) for t, (c, d) in held.items()]
            held.clear()
            return to_batch(rows, arrow)

        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = Counter(text.lower().split())
                n = sum(counts.values())
                for t, y in counts.items():
                    h = held.get(t)
                    if h is None:
                        held[t] = [y, 1]
                    else:
                        h[0] += y
                        h[1] += 1
                    if y >= least_tf:
                        out.append((i, t, y, n, None))
            if out:
                yield to_batch(out, arrow)
            if len(held) >= HELD:
                yield pass_on()
        if held:
            yield pass_on()

    src = docs.where(F.col(terms).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(terms).alias("terms"))
    both = cut(src.mapInArrow(run, spec))
    stats = both.where("df is not null").groupBy("term").agg(F.sum("tf").alias("cf"), F.sum("df").alias("df"))
    return both.where("df is null").select("id", "term", "tf", "n"), stats


def score_terms(docs: DataFrame, ident: str = "id", terms: str = "terms", prior_share: float = PRIOR_SHARE, least_tf: int = 1, most_df: int | None = None) -> DataFrame:
    """``id, term, tf, cf, df, z`` for every term of every row.

    ``least_tf`` and ``most_df`` restrict which scores come out; counts and
    statistics are over everything either way.
    """
    if least_tf > 1:
        counts, stats = counted_once(docs, least_tf, ident, terms)
    else:
        counts = term_counts(docs, ident, terms)
        stats = term_statistics(counts)
    # one row; needing both columns, it reads the same exchange as the statistics
    total = stats.where("df > 0").agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total"))
    if most_df is not None:
        stats = stats.where(F.col("df") <= most_df)
    salts = 1 if most_df is not None else SALTS
    left = counts.withColumn("_salt", (F.abs(F.xxhash64("id")) % salts).cast("int"))
    right = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else stats.withColumn("_salt", F.lit(0))
    y, n, c, big = F.col("tf"), F.col("n"), F.col("cf"), F.col("total")
    a, a0 = c * F.lit(float(prior_share)), big * F.lit(float(prior_share))
    delta = F.ln((y + a) / (n + a0 - y - a)) - F.ln((c - y + a) / (big - n + a0 - (c - y) - a))
    z = delta / F.sqrt(1 / (y + a) + 1 / (c - y + a))
    return left.join(right, ["term", "_salt"]).crossJoin(F.broadcast(total)).select("id", "term", "tf", "cf", "df", z.alias("z"))
