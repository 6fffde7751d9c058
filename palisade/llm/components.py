"""Clustering without pairs: links within buckets of similar sets through hubs, and connected components by alternating stars.

Nothing here gathers a bucket, a group or a component in one task: buckets and components are only ever aggregated to a minimum or
a count, or joined on a key, and every joined side may be split by Spark where a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Nodes of a bucket up to which all its pairs between components are tried.
SMALL = 16
#: Nodes of a bucket of differing elements beyond which it gets a hub of its own, up to DEPTH times over.
LARGE, DEPTH = 512, 6


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (a, b); comp is the least node that can be reached. Self-links and nulls are left out."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every greater neighbour moves to the least node around
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every node moves its lesser neighbours and itself to the least of them
        least = moved.groupBy("a").agg(F.min("b").alias("m"))
        moved = moved.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(old)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.groupBy("a").agg(F.min("b").alias("comp")).unionByName(edges.select(F.col("b").alias("a"), F.col("b").alias("comp")).distinct()).select(F.col("a").alias("node"), "comp")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("b", "a").cast("long")).alias("s")).first()
    return row["n"], row["x"], row["s"]


def side(table: DataFrame, s: str) -> DataFrame:
    """The table with its columns named for one side of a pair: node becomes s, any other column x_s."""
    return table.select(*(F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in table.columns))


def shared_buckets(members: DataFrame) -> DataFrame:
    """Written rows (bucket, node, size) of members (bucket, node) whose bucket has more than one row."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return written(members.join(sizes, "bucket").select("bucket", "node", "size"), "buckets")


def link_similar(members: DataFrame, infos: DataFrame, sets: DataFrame, percent: int, plausible: Callable[[str, str], Column], likely: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(node, comp) of the nodes that links within buckets connect; a link is a pair of sets with a Jaccard similarity of percent.

    members: written rows (bucket, node, size). infos: written rows (node, n, ...) with n the size of the set. sets: written rows
    (node, elements). plausible and likely: of the suffixes of two infos' columns, whether a link is possible at all.

    The components are those of all links within buckets, though few pairs are made. Each bucket has a hub, the node whose buckets
    are the fullest, and every node is tried with its hubs. In buckets whose nodes then still lie in several components, of up to
    SMALL nodes, pairs of different components are tried. Larger ones are left to `_relative`, which meets two nodes only where
    both differ from the hub in one and the same element, chosen so that no link is missed; where even that leaves a large bucket,
    it gets a hub in turn.
    """
    comp, depth = None, 0
    while True:
        starred = _starred(members)
        pairs = starred.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        links = _verified(pairs, infos, sets, percent, plausible, likely)
        comp = _joined(comp, links)
        rows = _open(starred, comp)
        more = None
        if rows.head(1):
            light = infos.select("node", "n", *(c for c in infos.columns if c == "bits"))
            small = rows.filter(f"size <= {SMALL} and node <> hub").select("bucket", "node", "comp").join(light, "node")
            a, b = side(small, "a"), side(small, "b")
            met = a.join(b, (F.col("bucket_a") == F.col("bucket_b")) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & plausible("a", "b"))
            found = _verified(met.select("a", "b").distinct(), infos, sets, percent, plausible, likely)
            large = rows.filter(f"size > {SMALL}")
            near, more = _relative(_referred(large), sets, percent, last=depth == DEPTH) if large.head(1) else (None, None)
            old, comp = comp, _joined(comp, found.unionByName(near) if near is not None else found)
            discard(old, links, found, *([near] if near is not None else []))
        discard(starred, rows)
        if more is None or not more.head(1):
            return comp
        members, depth = more, depth + 1


def _starred(members: DataFrame) -> DataFrame:
    """Written members with the hub of their bucket: the node whose buckets hold the most nodes, of those the least."""
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("less"))).alias("top"))
    return written(members.join(hubs, "bucket").select("bucket", "node", "size", (-F.col("top.less")).alias("hub")), "starred-buckets")


def _verified(pairs: DataFrame, infos: DataFrame, sets: DataFrame, percent: int, plausible: Callable[[str, str], Column], likely: Callable[[str, str], Column] | None) -> DataFrame:
    """Written rows (a, b) of the pairs that are links, by their full sets."""
    hopeful = pairs.join(side(infos, "b"), "b").join(side(infos, "a"), "a").filter(plausible("a", "b"))
    if likely:
        hopeful = hopeful.filter(likely("a", "b"))
    both = hopeful.select("a", "b").join(side(sets, "b"), "b").join(side(sets, "a"), "a")
    common = F.size(F.array_intersect("elements_a", "elements_b"))
    return written(both.filter(100 * common >= percent * (F.size("elements_a") + F.size("elements_b") - common)).select("a", "b"), "links")


def _joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Written components of comp and the links together."""
    if comp is None:
        return written(components(links), "components")
    of = lambda s: side(comp, s)
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    relabel = written(components(lifted).select(F.col("node").alias("comp"), F.col("comp").alias("new")), "relabel")
    added = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti").select("node", F.col("node").alias("comp"))
    out = written(comp.unionByName(added).join(relabel, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "components")
    discard(relabel)
    return out


def _open(starred: DataFrame, comp: DataFrame) -> DataFrame:
    """Written rows (bucket, node, size, hub, comp) of the buckets with more than one component."""
    rows = starred.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    return written(rows.join(several, "bucket").select("bucket", "node", "size", "hub", "comp"), "open-buckets")


def _referred(rows: DataFrame) -> DataFrame:
    """rows with the hub that serves a bucket as reference, which need not lie in it: of the hubs that serve each of its nodes' most
    rows, the commonest. So most buckets of a group of near copies have one reference, and a node is compared with few."""
    reach = rows.groupBy("hub").agg(F.count("*").alias("reach"))
    own = rows.join(reach, "hub").groupBy("node").agg(F.max(F.struct("reach", "hub"))["hub"].alias("own"))
    votes = rows.join(own, "node").groupBy("bucket", "own").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("bucket").agg(F.max(F.struct("votes", "own"))["own"].alias("hub"))
    return written(rows.drop("hub").join(chosen, "bucket"), "referred-buckets")


def _relative(rows: DataFrame, sets: DataFrame, percent: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(links, members of further buckets) for nodes that share a hub H, written.

    Let D(x) be the elements in which x differs from H. Two sets differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| elements, and are linked
    if that times (100 + p) is at most (|x| + |y|) (100 - p). So the links are worked out from the differences alone, and a pair of
    different components must share elements of D: if both were linked with H they would be in one component, so let x not be. With
    q = (100 - p) / (100 + p) it has an excess e = |D(x)| - q (|x| + |H|) > 0, and any y linked with x shares at least e / (1 + q)
    elements of D(x), and more than (|D(y)| - q (|y| - |H|)) / 2 of D(y), at least one. A node is therefore entered under all but so
    many less one of its differences, those that most nodes of the hub have being left out, and any link still meets.
    """
    q = (100 - percent) / (100 + percent)
    near = rows.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("hub")
    nodes = rows.select("hub", "node", "comp").distinct().join(near, "hub").filter("node <> hub")
    both = nodes.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("elements").alias("of_hub")), "hub")
    delta = F.concat(F.array_except("elements", "of_hub"), F.array_except("of_hub", "elements"))
    apart = written(both.select("hub", "node", "comp", F.size("elements").alias("n"), F.size("of_hub").alias("n_hub"), delta.alias("delta")), "differences")
    d, n, n_hub = F.size("delta"), F.col("n"), F.col("n_hub")
    linked = (100 + percent) * d <= (100 - percent) * (n + n_hub)
    # rounded so that no error of floating point asks for one more
    shared = F.when(linked, (d - q * (n - n_hub)) / 2).otherwise((d - q * (n + n_hub)) / (1 + q))
    apart = apart.withColumns({"linked": linked, "enter": F.greatest(F.lit(0), d + 1 - F.greatest(F.lit(1), F.ceil(shared - 1e-6).cast("int")))})
    each = apart.select("hub", "node", "comp", "enter", F.explode("delta").alias("e"))
    counts = each.groupBy("hub", "e").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    ordered = each.join(counts, ["hub", "e"]).groupBy("hub", "node", "enter").agg(F.array_sort(F.collect_list(F.struct("k", "e", (F.col("lo") < F.col("hi")).alias("mixed")))).alias("es"))
    entered = ordered.select("hub", "node", F.explode(F.slice("es", F.lit(1), F.col("enter"))).alias("x")).filter("x.mixed").select("hub", "node", "x.e")
    entered = written(entered.select("hub", "e", "node"), "entered")
    size = entered.groupBy("hub", "e").agg(F.count("*").alias("size")).filter("size > 1")
    entered_sized = entered.join(size, ["hub", "e"])
    direct = entered_sized if last else entered_sized.filter(f"size <= {LARGE}")
    full = direct.select("hub", "e", "node").join(apart, ["hub", "node"])
    a, b = side(full, "a"), side(full, "b")
    d_a, d_b = F.size("delta_a"), F.size("delta_b")
    room = (100 - percent) * (F.col("n_a") + F.col("n_b"))
    close = (100 + percent) * F.abs(d_a - d_b) <= room
    link = (100 + percent) * (d_a + d_b - 2 * F.size(F.array_intersect("delta_a", "delta_b"))) <= room
    met = a.join(b, (F.col("hub_a") == F.col("hub_b")) & (F.col("e_a") == F.col("e_b")) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & ~(F.col("linked_a") & F.col("linked_b")) & close & link)
    of_hub = apart.filter("linked").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = written(met.select("a", "b").distinct().unionByName(of_hub), "links")
    more = None if last else written(entered_sized.filter(f"size > {LARGE}").select(F.xxhash64("hub", "e").alias("bucket"), "node", "size"), "buckets")
    discard(entered)
    return links, more
