"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, root)`` for every id in ``links(a, b)``; root is the smallest id
    of the component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each
    step hangs an id's neighbours on the smallest of them. Only minima are
    aggregated, so a component holding a third of all ids is never collected
    anywhere, and they are written before they are joined: a hub's links then
    come from a plain shuffle, which skew handling splits. The number of rounds
    grows with the logarithm of a component's size.
    """
    e = cut(_pairs(links), "links")
    for _ in range(max_rounds):
        nxt = cut(_small_star(cut(_large_star(e), "links")), "links")
        if _mark(nxt) == _mark(e):
            return e.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(
                e.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
        e = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _pairs(links: DataFrame) -> DataFrame:
    """Smaller id first, each pair once, no self links."""
    return (links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .filter("a < b").distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return r["n"], r["x"]


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of an id is linked to the id's smallest one
    (``e`` has the smaller id first)."""
    smallest = cut(e.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("m")), "smallest")
    x = e.join(smallest, "a", "left").select(F.coalesce("m", "a").alias("a"), "b")
    return x.filter("a < b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """An id's smaller neighbours are linked to the smallest of them."""
    smallest = cut(e.groupBy("b").agg(F.min("a").alias("m")), "smallest")
    x = e.join(smallest, "b")
    # (m, b) once per b, and (m, a) for the other smaller neighbours of b
    others = x.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return smallest.select(F.col("m").alias("a"), "b").unionByName(others).distinct()
