"""Shortest paths by block-synchronous relaxation, components by contraction, and what is built on them.

Vertices are dealt in blocks: of consecutive ids, or of places in space (``blocks_by_place``) where ids say nothing. In a
round every block with news runs Dijkstra on its own edges from its current values and proposes values to the neighbours
outside; the proposals are the news of the next round. A block is of bounded size, so no task holds a mesh, and a path costs
a round only where it leaves a block. A round writes only what it changed: values are kept as the changes of all rounds, blocks
without news are scanned past and not shuffled, and one aggregation at the end takes the least of each vertex.

Components contract: edges are reduced to a spanning forest where they lie, every vertex hooks to its least neighbour, chains of
hooks are halved until they are stars, and edges between stars go on. At least half of the vertices that still have edges go
in each round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.operators import nearest
from meshloom.operators.topology import both_ways, corner_rows, edge_incidence, numbered_along, renumbered
from meshloom.sources.store import materialise

BLOCK = 1 << 14
#: Edges that a task reduces to a forest at once.
FOREST = 1 << 20
#: Rounds after which the changes are brought together.
COMPACT = 16
_NEWS = "block long, vid long, d double, label long, own boolean"


def block_of(vid: str, block: int) -> Column:
    return F.floor(F.col(vid) / block).cast("long")


def blocks_by_place(vertices: DataFrame, block: int = BLOCK) -> DataFrame:
    """vid and block of ``vertices``: runs of ``block`` vertices along the curve that interleaves the bits of their coordinates."""
    ranked = numbered_along(vertices, [nearest.along_curve(vertices), F.col("vid")], "place")
    return ranked.select("vid", F.floor(F.col("place") / block).cast("long").alias("block"))


def _relax_block(key, edges: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Values of the block's vertices that changed in this round (own), and proposals to vertices outside it."""
    best: dict[int, tuple[float, int]] = {}
    for v, d, k in zip(state["vid"][state["known"]], state["d"][state["known"]], state["label"][state["known"]], strict=True):
        if v not in best or (d, k) < best[v]:
            best[v] = (d, k)
    changed: dict[int, tuple[float, int]] = {}
    heap = []
    for v, d, k in zip(state["vid"][~state["known"]], state["d"][~state["known"]], state["label"][~state["known"]], strict=True):
        if v not in best or (d, k) < best[v]:
            best[v] = changed[v] = (d, k)
            heap.append((d, k, v))
    heapq.heapify(heap)
    order = np.argsort(edges["u"].to_numpy(), kind="stable")
    u, w, length, there = (edges[c].to_numpy()[order] for c in ("u", "w", "len", "there"))
    firsts = np.flatnonzero(np.diff(u, prepend=-1))
    starts = {int(u[a]): (int(a), int(b)) for a, b in zip(firsts, [*firsts[1:], len(u)], strict=False)}
    block, out = key[0], {}
    while heap:
        d, k, v = heapq.heappop(heap)
        if best[v] != (d, k):
            continue
        a, b = starts.get(v, (0, 0))
        for j in range(a, b):
            x, new = int(w[j]), (d + float(length[j]), k)
            if there[j] != block:
                if x not in out or (*new, int(there[j])) < out[x]:
                    out[x] = (*new, int(there[j]))
            elif x not in best or new < best[x]:
                best[x] = changed[x] = new
                heapq.heappush(heap, (*new, x))
    rows = [(block, v, *x, True) for v, x in changed.items()] + [(b, v, d, k, False) for v, (d, k, b) in out.items()]
    return pd.DataFrame(rows, columns=["block", "vid", "d", "label", "own"]).astype({"block": "int64", "vid": "int64", "d": "float64", "label": "int64", "own": "bool"})


def dealt(vertices: DataFrame | None, block: int = BLOCK) -> DataFrame | None:
    """vid and block of ``vertices`` by place, written; None (ids deal them) without places or where one block holds all."""
    if vertices is None or vertices.count() <= block:
        return None
    return materialise(blocks_by_place(vertices, block), "blocks")


def relax(edges: DataFrame, seeds: DataFrame, block: int = BLOCK, placed: DataFrame | None = None, rounds: list | None = None) -> DataFrame:
    """vid, d, label: the least d of a seed (vid, d, label) plus a path over undirected ``edges`` (u, w, len), and that seed's label (the least of equals). Vertices that no seed reaches have no row. ``placed`` (vid, block) deals the vertices otherwise than by id. ``rounds`` gets the number of rounds appended."""
    arcs = edges.select(F.inline(F.array(F.struct("u", "w", "len"), F.struct(F.col("w").alias("u"), F.col("u").alias("w"), "len"))))
    if placed is None:
        arcs = arcs.withColumns({"block": block_of("u", block), "there": block_of("w", block)})
        news = seeds.withColumn("block", block_of("vid", block))
    else:
        for end, name in (("u", "block"), ("w", "there")):
            arcs = arcs.join(placed.select(F.col("vid").alias(end), F.col("block").alias(name)), end)
        news = seeds.join(placed, "vid")
    arcs = materialise(arcs.select("block", "u", "w", "len", "there"), "arcs")
    columns = ["block", "vid", "d", "label"]
    known, news, turns = [], materialise(news.select(*columns), "seeds"), 0
    while not news.isEmpty():
        turns += 1
        blocks = news.select("block").distinct()
        parts = [x.join(blocks, "block", "left_semi").withColumn("known", F.lit(True)) for x in known]
        state = reduce(DataFrame.unionByName, parts, news.withColumn("known", F.lit(False)))
        active = arcs.join(blocks, "block", "left_semi")
        step = materialise(active.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(_relax_block, _NEWS), "step")
        known.append(step.filter("own").select(*columns))
        if len(known) > COMPACT:
            known = [materialise(_least(known), "known")]
        news = step.filter("not own").select(*columns)
    if rounds is not None:
        rounds.append(turns)
    if not known:
        return seeds.select("vid", "d", "label")
    return materialise(_least(known), "known").select("vid", "d", "label")


def _least(parts: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("block", "vid").agg(F.min(F.struct("d", "label")).alias("s")).select("block", "vid", "s.d", "s.label")


def distances(edges: DataFrame, sources: DataFrame, vertices: DataFrame | None = None, block: int = BLOCK, placed: DataFrame | None = None, rounds: list | None = None) -> DataFrame:
    """K1, K3: vid, d and the nearest source's vid as label. ``vertices`` (vid, x, y, z) deals blocks by place, ``placed`` (vid, block) as it says."""
    seeds = sources.select("vid", F.lit(0.0).alias("d"), F.col("vid").alias("label"))
    return relax(edges, seeds, block, dealt(vertices, block) if placed is None else placed, rounds)


def _local_roots(u: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    """For each vertex of these edges the least vertex that they link it to, as an edge (u, w)."""
    ids, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    one, two = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(one):
        low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[one] != root[two]
        one, two = one[apart], two[apart]
    moved = root != np.arange(len(ids))
    return pd.DataFrame({"u": ids[root[moved]], "w": ids[moved]})


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of the edges of a task, up to FOREST edges at a time."""
    some, n = [], 0
    for f in frames:
        some.append(f)
        n += len(f)
        if n >= FOREST:
            yield _local_roots(*(np.concatenate([f[c] for f in some]) for c in "uw"))
            some, n = [], 0
    if n:
        yield _local_roots(*(np.concatenate([f[c] for f in some]) for c in "uw"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vid and ``root``, the least vid that it reaches."""
    left = materialise(edges.select("u", "w").filter("u <> w").mapInPandas(_forest, "u long, w long"), "forest")
    labels = vertices.select("vid", F.col("vid").alias("root"))
    while not left.isEmpty():
        hooks = materialise(both_ways(left).groupBy("u").agg(F.min("w").alias("w")).select(F.col("u").alias("v"), F.least("u", "w").alias("to")), "hooks")
        while True:
            beyond = hooks.select(F.col("v").alias("to"), F.col("to").alias("beyond"))
            halved = materialise(hooks.join(beyond, "to").select("v", "to", "beyond"), "hooks")
            hooks = halved.select("v", F.col("beyond").alias("to"))
            if halved.filter("to <> beyond").isEmpty():
                break
        labels = materialise(labels.join(hooks.withColumnRenamed("v", "root"), "root", "left").select("vid", F.coalesce("to", "root").alias("root")), "labels")
        moved = left
        for end in "uw":
            moved = moved.join(hooks.select(F.col("v").alias(end), F.col("to").alias(f"to_{end}")), end)
        left = materialise(moved.select(F.col("to_u").alias("u"), F.col("to_w").alias("w")).filter("u <> w").distinct(), "left")
    return labels


def face_components(faces: DataFrame) -> DataFrame:
    """The faces with the root of their corners' component."""
    roots = components(edge_incidence(faces), corner_rows(faces).select("vid").distinct())
    return faces.join(roots.select(F.col("vid").alias("a"), "root"), "a").select(*faces.columns, "root")


def largest(rows: DataFrame) -> DataFrame:
    """Rows of the root with the most rows (the least root of equals)."""
    best = rows.groupBy("root").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("root")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("root"))
    return rows.join(F.broadcast(best), "root")


def boundary_loops(boundary: DataFrame) -> DataFrame:
    """Vid and loop (0, 1, ... by least vid) of boundary edges (u, w)."""
    ends = both_ways(boundary).select(F.col("u").alias("vid")).distinct()
    roots = materialise(components(boundary, ends), "loops")
    numbered = renumbered(roots.select(F.col("root").alias("vid")).distinct())
    return roots.join(numbered.select(F.col("vid").alias("root"), F.col("new_vid").alias("loop")), "root").select("vid", "loop")


def from_both(edges: DataFrame, source: DataFrame, target: DataFrame, vertices: DataFrame | None = None, block: int = BLOCK, rounds: list | None = None) -> tuple[DataFrame, DataFrame]:
    """``distances`` from ``source`` and from ``target`` in the same rounds: the second on a copy of the graph with vids and blocks of its own."""
    placed = dealt(vertices, block)
    most = max(x or 0 for x in (*edges.agg(F.max("u"), F.max("w")).first(), source.agg(F.max("vid")).first()[0], target.agg(F.max("vid")).first()[0]))
    # a whole number of blocks, where ids deal them
    shift = (most // block + 1) * block
    moved = lambda rows, *ids: rows.withColumns({c: F.col(c) + shift for c in ids})
    if placed is not None:
        n = placed.agg(F.max("block")).first()[0] + 1
        placed = materialise(placed.unionByName(moved(placed, "vid").withColumn("block", F.col("block") + n)), "blocks")
    arcs = edges.select("u", "w", "len")
    found = distances(arcs.unionByName(moved(arcs, "u", "w")), source.select("vid").unionByName(moved(target.select("vid"), "vid")), block=block, placed=placed, rounds=rounds)
    back = found.filter(F.col("vid") >= shift).select(*((F.col(c) - shift).alias(c) if c in ("vid", "label") else F.col(c) for c in found.columns))
    return found.filter(F.col("vid") < shift), back


def on_shortest_path(edges: DataFrame, source: DataFrame, target: DataFrame, vertices: DataFrame | None = None, slack: float = 1e-9) -> DataFrame:
    """K2: vid, d (from the source) and length of every vertex on a shortest path between two vertices (one-row tables with vid)."""
    there, back = from_both(edges, source, target, vertices)
    there, back = there.select("vid", "d"), back.select("vid", F.col("d").alias("rest"))
    length = there.join(F.broadcast(target), "vid").select(F.col("d").alias("length"))
    return there.join(back, "vid").join(F.broadcast(length)).filter(F.col("d") + F.col("rest") <= F.col("length") + slack).select("vid", "d", "length")


def one_shortest_path(edges: DataFrame, source: DataFrame, target: DataFrame, vertices: DataFrame | None = None, slack: float = 1e-9) -> DataFrame:
    """K2: vid, d and length along one shortest path: from the target always to the least vid before.

    The chain from the target is found by doubling, so a path of n vertices takes log n rounds.
    """
    on = materialise(on_shortest_path(edges, source, target, vertices, slack), "on-path")
    d = lambda s: on.select(F.col("vid").alias(s), F.col("d").alias(f"d{s}"))
    arcs = edges.select(F.inline(F.array(F.struct("u", "w", "len"), F.struct(F.col("w").alias("u"), F.col("u").alias("w"), "len"))))
    tight = arcs.join(d("u"), "u").join(d("w"), "w").filter((F.abs(F.col("dw") + F.col("len") - F.col("du")) <= slack) & (F.col("dw") < F.col("du")))
    jumps = materialise(tight.groupBy(F.col("u").alias("vid")).agg(F.min("w").alias("to")), "jumps")
    reached = materialise(target.select("vid"), "reached")
    while not jumps.isEmpty():
        more = reached.join(jumps, "vid").select(F.col("to").alias("vid"))
        reached = materialise(reached.unionByName(more).distinct(), "reached")
        jumps = materialise(jumps.join(jumps.select(F.col("vid").alias("to"), F.col("to").alias("beyond")), "to").select("vid", F.col("beyond").alias("to")), "jumps")
    return on.join(reached, "vid", "left_semi")
