"""What the operators of this subpackage share: words, shared storage, unique column names, connected components."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill import storage
from textmill.storage import delete, shared_dir, shared_path

__all__ = ["col", "components", "delete", "fresh", "materialize", "shared_dir", "shared_path", "words_of", "written"]
_mine = threading.local()


def written() -> list[str]:
    """Paths of the tables that this thread has written and not yet deleted, in order."""
    if not hasattr(_mine, "paths"):
        _mine.paths = []
    return _mine.paths


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends, and a lost executor costs nothing."""
    return storage.keep(df, name, written())


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}{k}"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8. ``bytes.split`` splits at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)``, component being the smallest node reachable.

    Randomised contraction: in every round nodes are put in a new order by hash, each hooks to the first of itself and its
    neighbours, and the graph is contracted along these hooks. Whatever the shape of the graph, chains included, a round is
    expected to leave at most three quarters of the nodes, so the rounds grow with the logarithm of the largest component, and
    their number is not limited. Then the rounds' hooks are put together from the last to the first; tables of ever fewer
    rows in the shared folder cut the lineage. Only rows are shuffled. Nodes without an edge are not returned; an empty graph
    gives an empty table. Loops and repeated edges are harmless.
    """
    e = edges.select(F.least(col(a), col(b)).alias("a"), F.greatest(col(a), col(b)).alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges")
    hooks: list[DataFrame] = []
    while not e.isEmpty():
        turn = F.lit(len(hooks))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("h", F.xxhash64("b", turn))
        first = both.groupBy("a").agg(F.min("h").alias("h"), F.min_by("b", "h").alias("b"))
        hook = materialize(first.select("a", F.when(F.xxhash64("a", turn) <= F.col("h"), F.col("a")).otherwise(F.col("b")).alias("m")), "hooks")
        hooks.append(hook)
        left, right = hook.select("a", F.col("m").alias("x")), hook.select(F.col("a").alias("b"), F.col("m").alias("y"))
        e = e.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = materialize(e, "edges")
    if not hooks:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = hooks.pop()
    while hooks:
        later = labels.select(F.col("a").alias("m"), F.col("m").alias("r"))
        labels = materialize(hooks.pop().join(later, "m", "left").select("a", F.coalesce("r", "m").alias("m")), "labels")
    least = labels.groupBy("m").agg(F.min("a").alias("component"))
    return labels.join(least, "m").select(F.col("a").alias("node"), "component")
