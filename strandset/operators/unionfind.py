"""Components kept up to date: stored labels into which batches of pairs are merged without labelling the rest anew.

``labels`` hold (id, component) as stored; what later batches changed lies beside them in one table of (root, now, fresh): the component
``root`` is now part of ``now``, and ``fresh`` roots are ids that came with a batch. A batch asks the labels of its own ids, joins
their components, and writes that table again: bytes written follow the changes, not the labels. A component is named by its smallest id, so
labels are the same however the pairs are split into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.operators.graph import components
from strandset.operators.lineage import delete, discard, tell, told, written

_CHANGES = "root long, now long, fresh boolean"


def store_components(labels: DataFrame, path: str) -> None:
    """Writes (id, component) of :func:`components`; to fold changes in, store :func:`labels` at another path."""
    labels.select(F.col("id").cast("long"), F.col("component").cast("long")).write.parquet(f"{path}/labels")


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The labels as stored, and the changes since."""
    last = max(told(spark, path), default=0)
    changes = spark.read.schema(_CHANGES).parquet(f"{path}/changes-{last}") if last else spark.createDataFrame([], _CHANGES)
    return spark.read.parquet(f"{path}/labels"), changes


def merge_pairs(spark: SparkSession, path: str, batch: str, pairs: DataFrame) -> None:
    """Joins the components of each pair (x, y); ids that were not there before are added, pairs with a null take no part.

    A batch is told last, so a stopped one does not count and can be run again; one that was told before is left as
    it is. Only one batch may be merged at a time.
    """
    done = told(spark, path)
    if batch in done.values():
        return
    whole = written(pairs.select(F.col("x").cast("long"), F.col("y").cast("long")).where("x IS NOT NULL AND y IS NOT NULL").distinct())
    labels_, changes = _stored(spark, path)
    ids = whole.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    asked = ids.join(labels_, "id", "left").select("id", F.coalesce("component", "id").alias("root"), F.col("component").isNull().alias("unheld"))
    found = written(asked.join(changes, "root", "left").select("id", F.coalesce("now", "root").alias("own"), (F.col("unheld") & F.col("now").isNull()).alias("fresh")))
    x, y = found.select(F.col("id").alias("x"), F.col("own").alias("a")), found.select(F.col("id").alias("y"), F.col("own").alias("b"))
    joined = written(components(whole.join(x, "x").join(y, "y").select(F.col("a").alias("x"), F.col("b").alias("y"))))
    news = joined.join(found.where("fresh").select("id", "fresh"), "id", "left").where("fresh OR id <> component")
    before = changes.join(joined.select(F.col("id").alias("now"), "component"), "now", "left").select("root", F.coalesce("component", "now").alias("now"), "fresh")
    after = before.unionByName(news.select(F.col("id").alias("root"), F.col("component").alias("now"), F.coalesce("fresh", F.lit(False)).alias("fresh")))
    last = max(done, default=0)
    after.write.mode("overwrite").parquet(f"{path}/changes-{last + 1}")
    tell(spark, path, last + 1, batch)
    discard(whole, found, joined)
    delete(spark, f"{path}/changes-{last - 1}")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, component): the labels of all ids by now."""
    stored, changes = _stored(spark, path)
    held = stored.join(changes.select(F.col("root").alias("component"), "now"), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return held.unionByName(changes.where("fresh").select(F.col("root").alias("id"), F.col("now").alias("component")))


def same(spark: SparkSession, path: str, pairs: DataFrame) -> DataFrame:
    """(x, y, same): whether both ids lie in one component; an id that was never named is alone, a null is in none."""
    own = labels(spark, path)
    out = pairs.select("x", "y")
    for name, label in (("x", "a"), ("y", "b")):
        out = out.join(own.select(F.col("id").alias(name), F.col("component").alias(label)), name, "left")
    return out.select("x", "y", F.coalesce(F.coalesce("a", "x") == F.coalesce("b", "y"), F.lit(False)).alias("same"))
