"""Fixpoints over the fragment-target graph: bundles and solvability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.operators.layout import HitLayout
from apportion.operators.ordinal import arrival_ordinal
from apportion.operators.skew import lookup_join
from apportion.session import cut, discard, hinted, passing


def star_links(layout: HitLayout) -> DataFrame:
    """Links (lo, hi) joining the smallest target of a fragment to its other targets, read
    straight from the layout; repeats are removed where the links are used."""
    rows = layout.hits.filter((F.col("n_targets") > 1) & ~F.col("lead"))
    return rows.select(F.col("first_target").alias("lo"), F.col("target_id").alias("hi"))


def connected_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) with component the smallest node id reachable.

    Each pass points every node at its smallest neighbour, jumps once to the pointer's own
    pointer, and rewrites the links between the nodes pointed at. Everything that is not
    pointed at vanishes, so the link table shrinks fast and long chains at least halve.
    Neighbour minima are pre-aggregated; the per-pass maps are applied to the nodes at the
    end. Lookups with hub keys go through the size-checked, salted join.
    """
    with passing(nodes.sparkSession) as keep:
        labels = _labels(links, nodes)
        return keep(labels) if labels.__dict__.get("_path") else labels


def _labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    links = cut(_canonical(links))
    maps: list[tuple[DataFrame, int]] = []
    while links.limit(1).count():
        both = links.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(
            links.select("hi", "lo")
        )
        tree = cut(
            both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up"))
        )
        before, pointed = links, tree
        size = tree.count()
        above = tree.select(F.col("node").alias("up"), F.col("up").alias("to"))
        tree = cut(lookup_join(tree, above, ["up"], size, ["node"]).select("node", "to"))
        discard(pointed)
        maps.append((tree, size))
        for end, spread in (("lo", "hi"), ("hi", "lo")):
            step = tree.select(F.col("node").alias(end), F.col("to").alias("_to"))
            links = lookup_join(links, step, [end], size, [spread]).drop(end).withColumnRenamed("_to", end)
        links = cut(_canonical(links))
        discard(before)
    labels = nodes.select("node", F.col("node").alias("component"))
    for tree, size in maps:
        step = tree.select(F.col("node").alias("component"), F.col("to").alias("_to"))
        labels = lookup_join(labels, step, ["component"], size, ["node"], how="left").select(
            "node", F.coalesce("_to", "component").alias("component")
        )
    return cut(labels) if maps else labels


def _canonical(links: DataFrame) -> DataFrame:
    pair = links.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    return pair.filter("lo < hi").distinct()


def bundles(layout: HitLayout, targets: DataFrame) -> DataFrame:
    """(target_id, component) for every target, isolated ones included."""
    nodes = targets.select(F.col("target_id").alias("node"))
    found = connected_components(star_links(layout), nodes)
    return found.select(F.col("node").alias("target_id"), "component")


def bundle_numbers(members: DataFrame) -> DataFrame:
    """Number bundles 1.. by their smallest target id, as a dense ordinal."""
    heads = members.filter(F.col("target_id") == F.col("component")).select("component")
    numbered = arrival_ordinal(heads, ["component"], "bundle_id")
    return members.join(numbered, "component")


def solvable_targets(layout: HitLayout) -> DataFrame:
    """Targets with a fragment of their own, closed under: a fragment whose other targets
    are all solvable makes its last target solvable.

    Solved targets leave the working table, so each pass handles only what is still open.
    """
    solved = cut(layout.hits.filter("n_targets = 1").select("target_id").distinct())
    fresh, total = solved, solved
    n_fresh = fresh.count()
    open_hits, left = layout.hits.filter("n_targets > 1").select("frag_id", "target_id"), None
    while n_fresh:
        before, left = left, cut(open_hits.join(hinted(fresh, n_fresh, 16), "target_id", "left_anti"))
        open_hits = left
        if before is not None:
            discard(before)
        last = open_hits.groupBy("frag_id").agg(F.count(F.lit(1)).alias("_k"), F.min("target_id").alias("target_id"))
        fresh = cut(last.filter("_k = 1").select("target_id").distinct())
        n_fresh = fresh.count()
        total = total.union(fresh)
    return total
