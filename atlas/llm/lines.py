"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed.  A window that occurs more than once keeps its
first occurrence, by document id, then text hash, then position; the lines of all later ones are
covered, and covered lines leave their documents.  Covers that overlap merge, as a line is covered
once or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm.common import free_name

WINDOW = 3


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows removed from ``text``; ``n_lines`` and ``n_removed`` are added.

    A NULL text stays NULL with no lines; an empty text is one empty line.  Documents with fewer
    than ``window`` lines have no window and stay as they are, and windows of blank lines only
    don't count.  Rows with equal ``doc_id`` and text are one document and get the same result.
    All columns are kept; columns named ``n_lines`` or ``n_removed`` are replaced.  A document whose
    lines are all removed keeps its row with an empty text.  An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key, gone, covers = (free_name(docs, name) for name in ("_key", "_gone", "_covered"))
    lines = F.split("text", "\n", -1)
    # the key of a document: the hash parts texts that share an id
    keyed = docs.select(*kept, F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")).alias(key))
    hashed = keyed.select(key, F.transform(lines, lambda x: F.xxhash64(x)).alias("h"),
                          F.transform(lines, lambda x: F.trim(x) != "").alias("filled"))
    starts = F.when(F.size("h") >= window, F.sequence(F.lit(0), F.size("h") - window))
    windows = hashed.select(key, F.explode(F.transform(starts, lambda i: F.struct(
        i.alias("i"),
        F.xxhash64(*[F.get("h", i + k) for k in range(window)]).alias("w"),
        F.reduce(F.slice("filled", i + 1, window), F.lit(False), lambda a, b: a | b).alias("filled")))).alias("x"))
    windows = windows.where("x.filled").select(key, "x.i", "x.w")
    first = (windows.groupBy("w").agg(F.min(F.struct(key, "i")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    later = windows.join(first, "w").where(F.struct(key, "i") != F.col("first"))
    spans = F.transform(F.col("starts"), lambda i: F.sequence(i, i + window - 1))
    covered = (later.groupBy(key).agg(F.collect_set("i").alias("starts"))
               .select(F.col(key).alias(gone), F.array_distinct(F.flatten(spans)).alias(covers)))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covers))
    left = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    return (keyed.join(covered, F.col(key).eqNullSafe(F.col(gone)), "left")
            .select(*[F.when(F.col(covers).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else c
                      for c in kept],
                    count.alias("n_lines"), F.coalesce(F.size(covers), F.lit(0)).alias("n_removed"))
            .withColumn("n_removed", F.greatest("n_removed", F.lit(0))))
