"""Bounded samples of labelled rows, and the checksum that keeps rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: which rows a classifier may not learn from."""
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(n))


def sample_by_label(
    docs: DataFrame, labels: DataFrame, label: str, values: list, most: int, chars: int, id: str = "doc_id", text: str = "text",
) -> list[tuple[str, object]]:
    """At most `most` (text, label) of each listed label, with distinct texts of at most `chars` characters.

    The texts of smallest hash are chosen, so the choice depends on neither order nor copies.  Only ids and hashes meet
    the labels in a shuffle; what reaches the driver is bounded by values x most x chars.  A label of null counts for
    nothing; labels may be docs itself.
    """
    keyed = docs.where(F.col(text).isNotNull() & (F.length(text) <= chars) & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.xxhash64(text).alias("_hash"))
    meant = labels.where(F.col(label).isNotNull()).select(F.col(id).alias("_id"), F.col(label).alias("_label"))
    both = keyed.join(meant, "_id")
    chosen: dict[int, object] = {}
    for value in values:
        own = both.where(F.col("_label") == F.lit(value)).groupBy("_hash").agg(F.min("_id").alias("_id"))
        for r in own.orderBy("_hash").limit(most).collect():
            chosen.setdefault(r["_id"], value)
    if not chosen:
        return []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(int(i),) for i in chosen], "_id long")  # at most values x most ids
    found = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= chars).join(F.broadcast(ids), "_id").collect()
    return sorted({(r["_text"], chosen[r["_id"]]) for r in found})
