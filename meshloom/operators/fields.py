"""Fields over a mesh's vertices from its Laplacian: harmonic parameter and diffusion map.

The sparse matrix is a table (i, j, val). Vertices are dealt along a curve through space in leaves of LEAF and blocks of TOP, and
eliminated from the inside out (``Nested``): a task eliminates the vertices of its block all of whose neighbours lie in it, leaf
by leaf and pair of leaves by pair; what is left, the rims of blocks, is brought together group by group of blocks, and so on up.
So a task holds a block, or the rims of the groups that meet in it: on a surface of n vertices some multiple of the square root of n,
on a limb a few rings. A solution is a pass up and a pass down over the groups, and shuffles vectors only. Both methods use it as the
approximate inverse of an iteration that checks residuals, so what rounding takes comes back: a harmonic field takes a round or two.
Products with the whole matrix are a join and a sum by block, and a round has one set of scalar products.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.operators.graph import block_of, blocks_by_place
from meshloom.sources.store import bucketed, materialise

#: Vertices of a leaf.
LEAF = 64
#: Vertices of a block, which one task eliminates.
TOP = 8192
_FACTORS = "node long, tree binary, ids array<long>, levels array<int>, schur binary"
#: The inner equations of a node: places of what goes and of what stays, the inverse of the one, and that times what couples both.
Step = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def placed_in_blocks(vertices: DataFrame, by_place: bool, leaf: int = LEAF, top: int = TOP) -> DataFrame:
    """vid, leaf and block: runs of ``leaf`` vertices along a curve through space (x, y, z), or of ids, and runs of leaves with ``top`` vertices (one leaf at least)."""
    leaves = blocks_by_place(vertices, leaf).withColumnRenamed("block", "leaf") if by_place else vertices.select("vid", block_of("vid", leaf).alias("leaf"))
    return leaves.withColumn("block", F.floor(F.col("leaf") / max(1, top // leaf)).cast("long"))


def _eliminated(dense: np.ndarray, gone: np.ndarray) -> tuple[Step, np.ndarray]:
    """The step that takes the unknowns ``gone`` out of a symmetric matrix, and the matrix of the others. An unknown without equation keeps its right side, a singular part is shifted by a little."""
    e, r = np.flatnonzero(gone), np.flatnonzero(~gone)
    own = dense[np.ix_(e, e)]
    own[np.arange(len(e)), np.arange(len(e))] = np.where(np.abs(own.diagonal()) > 1e-300, own.diagonal(), 1.0)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    values = np.maximum(values, 1e-12 * np.abs(values).max(initial=1e-300))
    inverse = (vectors / values) @ vectors.T
    across = inverse @ dense[np.ix_(e, r)]
    return (e, r, inverse, across), dense[np.ix_(r, r)] - dense[np.ix_(e, r)].T @ across


def _pair_levels(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How often two numbers have to be halved until they are equal."""
    return np.frexp((one ^ two).astype(float))[1]


def _factored_block(entries: pd.DataFrame) -> pd.DataFrame:
    """The steps of a block, and its rim's matrix: vertices with level 0 go, those of a pair of leaves when these are brought together."""
    ids = np.unique(entries["i"])
    i, j = np.searchsorted(ids, entries["i"]), np.searchsorted(ids, entries["j"])
    val, leaf, level = entries["val"].to_numpy(), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32)
    leaf[i], level[i] = entries["fi"] - entries["fi"].min(), entries["li"]
    pair = _pair_levels(leaf[i], leaf[j])
    ready = np.zeros(len(ids), np.int64)
    np.maximum.at(ready, i, pair)
    ready[level > 0] = 1 << 30
    steps, rims, here = [], {}, 0
    while True:
        group = leaf >> here
        met = np.flatnonzero(pair == here)
        met = met[np.argsort(group[i[met]], kind="stable")]
        if here == 0:
            order = np.argsort(group, kind="stable")
            members = {int(g[0]): (order[a:b], []) for a, b in _runs(group[order]) for g in (group[order[a : a + 1]],)}
        else:
            members = {}
            for g, rim in rims.items():
                members.setdefault(g >> 1, []).append(rim)
            members = {g: (np.sort(np.concatenate([m for m, _ in found])), found) for g, found in members.items()}
        inside = {int(group[i[met[a]]]): met[a:b] for a, b in _runs(group[i[met]])}
        rims = {}
        for g, (m, found) in members.items():
            dense = np.zeros((len(m), len(m)))
            for n, matrix in found:
                at = np.searchsorted(m, n)
                dense[np.ix_(at, at)] += matrix
            k = inside.get(g, met[:0])
            np.add.at(dense, (np.searchsorted(m, i[k]), np.searchsorted(m, j[k])), val[k])
            gone = ready[m] == here
            (e, r, inverse, across), rest = _eliminated(dense, gone)
            steps.append((m[e], m[r], inverse, across))
            rims[g] = (m[r], rest)
        if len(rims) == 1 and (leaf >> here).max() == 0:
            break
        here += 1
    rim, matrix = next(iter(rims.values()))
    return _factors(entries["bi"].iloc[0], ids, steps, ids[rim], level[rim], matrix)


def _runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Where equal values of a sorted array begin and end."""
    if not len(sorted_):
        return []
    first = np.flatnonzero(np.diff(sorted_, prepend=sorted_[:1] - 1))
    return [(int(a), int(b)) for a, b in zip(first, [*first[1:], len(sorted_)], strict=True)]


def _factors(node: int, ids: np.ndarray, steps: list[Step], rim: np.ndarray, level: np.ndarray, matrix: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"node": [node], "tree": [pickle.dumps((ids, steps))], "ids": [rim], "levels": [level.astype(np.int32)], "schur": [matrix.tobytes()]})


def _factored_group(level: int):
    """The same for a group: the rims of its members and the entries between them."""

    def run(rims: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        node = (rims if len(rims) else entries)["node"].iloc[0]
        ids, levels = (np.concatenate([np.asarray(x, np.int64) for x in rims[c]]) if len(rims) else np.zeros(0, np.int64) for c in ("ids", "levels"))
        order = np.argsort(ids)
        ids, levels = ids[order], levels[order]
        dense = np.zeros((len(ids), len(ids)))
        for own, matrix in zip(rims["ids"], rims["schur"], strict=True):
            at = np.searchsorted(ids, np.asarray(own, np.int64))
            dense[np.ix_(at, at)] += np.frombuffer(matrix).reshape(len(at), len(at))
        np.add.at(dense, (np.searchsorted(ids, entries["i"]), np.searchsorted(ids, entries["j"])), entries["val"].to_numpy())
        step, rest = _eliminated(dense, levels == level)
        return _factors(node, ids, [step], ids[step[1]], levels[step[1]], rest)

    return run


def _passed(up: bool, down: bool, schema: T.StructType):
    """A pass over a node: up takes the part of what goes out of the right sides of what stays (``__rest``), down puts the solution of what stays (``__x``) into what went. Vertices without equation keep their right side."""

    def run(factors: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame(columns=schema.names)
        values, rest = np.stack(f["__y"]), np.zeros(len(f), bool)
        if len(factors):
            ids, steps = pickle.loads(factors["tree"].iloc[0])
            at = np.minimum(np.searchsorted(ids, f["vid"]), len(ids) - 1)
            there = ids[at] == f["vid"].to_numpy()
            whole = np.zeros((len(ids), values.shape[1]))
            whole[at[there]] = values[there]
            stays = np.ones(len(ids), bool)
            for e, *_ in steps:
                stays[e] = False
            if up:
                for e, r, inverse, across in steps:
                    whole[r] -= across.T @ whole[e]
                    whole[e] = inverse @ whole[e]
            else:
                known = np.flatnonzero(there & stays[at])
                if len(known):
                    whole[at[known]] = np.stack(f["__x"].iloc[known])
            if down:
                for e, r, _, across in reversed(steps):
                    whole[e] -= across @ whole[r]
            values[there], rest[there] = whole[at[there]], stays[at[there]]
        return f.assign(__y=list(values), __rest=rest)[schema.names]

    return run


class Nested:
    """The inverse of a symmetric sparse matrix by elimination in nested groups of vertices."""

    def __init__(self, entries: DataFrame):
        """entries: bi, bj, fi, fj (blocks and leaves of i and j), i, j, val."""
        blocks = (entries.agg(F.max("bi").alias("b")).first()["b"] or 0) + 1
        self.shifts = [0]
        while (blocks - 1) >> self.shifts[-1]:
            self.shifts.append(self.shifts[-1] + (2 if len(self.shifts) < 3 else 1))
        of = lambda c, s: F.shiftright(c, s)
        pair = F.lit(len(self.shifts) - 1)
        for level in reversed(range(len(self.shifts) - 1)):
            pair = F.when(of("bi", self.shifts[level]) == of("bj", self.shifts[level]), level).otherwise(pair)
        entries = materialise(entries.select("bi", "fi", "i", "j", "val", pair.cast("int").alias("pair")), "pairs")
        own = entries.filter("pair = 0")
        levels = entries.groupBy("i").agg(F.max("pair").alias("li"))
        found = own.join(levels, "i").groupBy("bi").applyInPandas(_factored_block, _FACTORS)
        self.factors = [materialise(found, "factors")]
        for level in range(1, len(self.shifts)):
            rims = self.factors[-1].select(of("node", self.shifts[level] - self.shifts[level - 1]).alias("node"), "ids", "levels", "schur")
            between = entries.filter(F.col("pair") == level).select(of("bi", self.shifts[level]).alias("node"), "i", "j", "val")
            found = rims.groupBy("node").cogroup(between.groupBy("node")).applyInPandas(_factored_group(level), _FACTORS)
            self.factors.append(materialise(found, "factors"))

    def solve(self, rows: DataFrame, right: str, out: str) -> DataFrame:
        """``rows`` (with vid, block and an array in the column ``right``) with the column ``out``: the inverse times ``right``, vector by vector."""
        trees = [f.select("node", "tree") for f in self.factors]
        last = len(trees) - 1

        def passed(level: int, given: DataFrame, up: bool, down: bool) -> DataFrame:
            schema = T.StructType.fromDDL("vid long, block long, __y array<double>, __rest boolean")
            key = F.shiftright("block", self.shifts[level]).alias("node")
            return trees[level].groupBy("node").cogroup(given.groupBy(key)).applyInPandas(_passed(up, down, schema), schema)

        given, ups = rows.select("vid", "block", F.col(right).alias("__y")), []
        for level in range(last):
            ups.append(materialise(passed(level, given, True, False), "up"))
            given = ups[-1].filter("__rest").select("vid", "block", "__y")
        solved = passed(last, given, True, True)
        for level in reversed(range(last)):
            known = ups[level].drop("__rest").join(solved.select("vid", F.col("__y").alias("__x")), "vid", "left")
            solved = passed(level, known, False, True)
        return rows.drop(out).join(solved.select("vid", F.col("__y").alias(out)), "vid")


def solve_harmonic(entries: DataFrame, fixed: DataFrame, vertices: DataFrame | None = None, tolerance: float = 1e-10, most: int = 500, leaf: int = LEAF, top: int = TOP, rounds: list | None = None) -> DataFrame:
    """L1: vid, t of a harmonic field with given values ``fixed`` (vid, value), rescaled to [0, 1]; not to converge is an error.

    Conjugate gradients on the free vertices, in the form with one set of scalar products a round. ``vertices`` (vid, x, y, z) deals blocks
    by place. A part of the mesh that has no fixed vertex gets the least value. ``rounds`` gets the number of rounds appended.
    """
    entries, fixed = materialise(entries, "entries"), materialise(fixed.select("vid", "value"), "fixed")
    rows = entries.join(fixed.select(F.col("vid").alias("i")), "i", "left_anti")
    vids = rows.select(F.col("i").alias("vid")).distinct()
    placed = materialise(placed_in_blocks(vids if vertices is None else vertices.join(vids, "vid", "left_semi"), vertices is not None, leaf, top), "blocks")
    right = rows.join(fixed.select(F.col("vid").alias("j"), "value"), "j").groupBy(F.col("i").alias("vid")).agg((-F.sum(F.col("val") * F.col("value"))).alias("b"))
    free = rows.join(fixed.select(F.col("vid").alias("j")), "j", "left_anti")
    for end in "ij":
        free = free.join(placed.select(F.col("vid").alias(end), F.col("block").alias(f"b{end}"), F.col("leaf").alias(f"f{end}")), end)
    free = bucketed(free.select("bi", "bj", "fi", "fj", "i", "j", "val"), "j", "free")
    inverse = Nested(free)
    none = F.lit(0.0)
    state = placed.join(right, "vid", "left").select("vid", "block", none.alias("x"), F.coalesce("b", none).alias("r"), none.alias("p"), none.alias("s"))
    state = materialise(state, "state")
    start, before, step = None, None, None
    for turn in range(most):
        worst = state.agg(F.max(F.abs("r")).alias("r")).first()["r"]
        start = start or worst
        if not worst or worst <= tolerance * start:
            break
        solved = inverse.solve(state.withColumn("right", F.array("r")), "right", "u").select("vid", "block", "x", "r", "p", "s", F.col("u")[0].alias("u"))
        solved = materialise(solved, "solved")
        product = free.join(solved.select(F.col("vid").alias("j"), "u"), "j").groupBy(F.col("i").alias("vid")).agg(F.sum(F.col("val") * F.col("u")).alias("w"))
        met = materialise(solved.join(product, "vid", "left").withColumn("w", F.coalesce("w", none)), "met")
        sums = met.agg(F.sum(F.col("r") * F.col("u")).alias("ru"), F.sum(F.col("w") * F.col("u")).alias("wu")).first()
        beta = sums["ru"] / before if before else 0.0
        step = sums["ru"] / (sums["wu"] - beta * sums["ru"] / step if beta else sums["wu"])
        before = sums["ru"]
        turned = met.select("vid", "block", "x", "r", (F.col("u") + beta * F.col("p")).alias("p"), (F.col("w") + beta * F.col("s")).alias("s"))
        state = turned.select("vid", "block", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("s")).alias("r"), "p", "s")
    else:
        raise RuntimeError(f"the harmonic field has not converged in {most} steps")
    if rounds is not None:
        rounds.append(turn)
    t = materialise(state.select("vid", F.col("x").alias("t")).unionByName(fixed.select("vid", F.col("value").alias("t"))), "field")
    ends = t.agg(F.min("t").alias("low"), F.max("t").alias("high"))
    span = F.col("high") - F.col("low")
    scaled = F.when(span > 1e-12, (F.col("t") - F.col("low")) / F.nullif(span, F.lit(0.0))).otherwise(F.col("t"))
    return t.join(F.broadcast(ends)).select("vid", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)).alias("t"))


def times(entries: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """vid and ``value``: the matrix (i, j, val) times a vector (vid, value)."""
    return entries.join(values.select(F.col("vid").alias("j"), F.col(value).alias("__v")), "j").groupBy(F.col("i").alias("vid")).agg(F.sum(F.col("val") * F.col("__v")).alias(value))


def _gram(columns: list[str], weight: str):
    """Sums of products of all pairs of the vectors in ``columns`` (arrays), for the rows of a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                left, right = (np.concatenate([np.stack(f[c]) for c in names], axis=1) for names in (columns, [f"a{c}" for c in columns]))
                part = np.stack([left.T @ right, left.T @ (left * f[weight].to_numpy()[:, None])])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"sums": [total.ravel()]})

    return run


def _summed(rows: DataFrame) -> np.ndarray:
    """The sum of the arrays ``sums``, place by place: as many numbers as one array has."""
    sums = rows.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    return np.array([r["s"] for r in sums])


def _residuals(values: np.ndarray):
    """The residuals of a block's vectors (x, with matrix times x in ax), and the sums of their squares."""

    def residuals(f: pd.DataFrame) -> np.ndarray:
        return np.stack(f["ax"]) - np.stack(f["x"]) * values[None, :] * f["mass"].to_numpy()[:, None]

    def squares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"sums": [(residuals(f) ** 2 / f["mass"].to_numpy()[:, None]).sum(axis=0)]})

    return squares


def _shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How much of each vector of x is in each of w, for the rows of a task."""
    for f in frames:
        if len(f):
            yield pd.DataFrame({"sums": [((np.stack(f["x"]) * f["mass"].to_numpy()[:, None]).T @ np.stack(f["w"])).ravel()]})


def _without(shares: np.ndarray):
    """Take these shares of x out of w: what is left is small beside them, and would be lost in sums of products of w itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["x"])
                yield f.assign(w=list(np.stack(f["w"]) - x @ shares.reshape(x.shape[1], -1)))

    return run


def diffusion_embedding(entries: DataFrame, mass: DataFrame, k: int, t: float, vertices: DataFrame | None = None, tolerance: float = 1e-9, most: int = 200, leaf: int = LEAF, top: int = TOP, guard: int = 8, rounds: list | None = None) -> DataFrame:
    """L2: vid and the k coordinates of the diffusion map: the k lowest vectors of ``entries`` x = value * ``mass`` x after the constant one, each times exp(-value t).

    Blocks of k + 1 + guard vectors are improved together (preconditioned, with the last direction kept, orthogonalised in the
    small space that the driver sees: a few dozen numbers squared), until residuals are small. Not to converge is an error.
    ``vertices`` (vid, x, y, z) deals blocks by place. ``rounds`` gets the number of rounds appended.
    """
    entries, mass = materialise(entries, "entries"), materialise(mass, "mass")
    n = mass.count()
    wanted = min(k + 1, n)
    m = min(wanted + guard, n)
    at = mass.select("vid") if vertices is None else vertices.join(mass.select("vid"), "vid", "left_semi")
    placed = materialise(placed_in_blocks(at, vertices is not None, leaf, top), "blocks")
    base = materialise(mass.select("vid", "mass").join(placed, "vid"), "base")
    diagonal = entries.filter("i = j").agg(F.avg(F.abs("val")).alias("d")).first()["d"] or 1.0
    average = base.agg(F.avg("mass").alias("m")).first()["m"]
    shift = 1e-3 * diagonal / average
    if vertices is not None:
        # about the lowest value of a strip as long as the mesh: beside a larger shift the values wanted would look alike
        box = at.agg(*(F.max(c) - F.min(c) for c in "xyz")).first()
        shift = max(min(shift, np.pi**2 / max(sum(x * x for x in box), 1e-300)), 1e-9 * diagonal / average)
    table = entries
    for end in "ij":
        table = table.join(placed.select(F.col("vid").alias(end), F.col("block").alias(f"b{end}"), F.col("leaf").alias(f"f{end}")), end)
    table = bucketed(table.select("bi", "bj", "fi", "fj", "i", "j", "val"), "j", "entries")
    shifted = base.select(F.col("block").alias("bi"), F.col("block").alias("bj"), F.col("leaf").alias("fi"), F.col("leaf").alias("fj"), F.col("vid").alias("i"), F.col("vid").alias("j"), (shift * F.col("mass")).alias("val"))
    inverse = Nested(table.unionByName(shifted))
    spread = lambda j: F.pmod(F.xxhash64("vid", F.lit(j)), F.lit(1 << 30)) / float(1 << 29) - 1
    empty = F.array().cast("array<double>")

    def product(rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the matrix times the vectors of a column."""
        def sums(f: pd.DataFrame) -> pd.DataFrame:
            ids, place = np.unique(f["i"], return_inverse=True)
            total = np.zeros((len(ids), len(f["__v"].iloc[0])))
            np.add.at(total, place, np.stack(f["__v"]) * f["val"].to_numpy()[:, None])
            return pd.DataFrame({"vid": ids, "__a": list(total)})

        terms = table.join(rows.select(F.col("vid").alias("j"), F.col(name).alias("__v")), "j").select("bi", "i", "val", "__v")
        found = terms.groupBy("bi").applyInPandas(sums, "vid long, __a array<double>")
        return rows.join(found, "vid", "left").withColumn(f"a{name}", F.coalesce("__a", F.transform(name, lambda _: F.lit(0.0)))).drop("__a")

    first = base.withColumn("x", F.array(F.lit(1.0), *(spread(j) for j in range(1, m))))
    rows = materialise(product(materialise(first, "first"), "x"), "start").withColumns({"p": empty, "ap": empty})
    schema = "vid long, mass double, block long, x array<double>, ax array<double>, p array<double>, ap array<double>, w array<double>"

    def space(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lowest values in the space of the columns, and how its vectors are put together; nearly dependent directions are left out."""
        sums = _summed(rows.select("mass", *columns, *(f"a{c}" for c in columns)).mapInPandas(_gram(columns, "mass"), "sums array<double>"))
        a, b = sums.reshape(2, -1, int(np.sqrt(len(sums) / 2)))
        scale = 1 / np.sqrt(np.maximum(np.diag(b), 1e-300))
        values, vectors = np.linalg.eigh(b * scale[:, None] * scale[None, :])
        fine = values > 1e-12 * values.max()
        basis = scale[:, None] * vectors[:, fine] / np.sqrt(values[fine])
        values, vectors = np.linalg.eigh(basis.T @ ((a + a.T) / 2) @ basis)
        return values[:m], basis @ vectors[:, :m]

    def combined(rows: DataFrame, columns: list[str], c: np.ndarray) -> DataFrame:
        c = c.astype(float)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    v, a = (np.concatenate([np.stack(f[s + x]) for x in columns], axis=1) for s in ("", "a"))
                    moved = c.copy()
                    moved[:m] = 0  # the part of the step that leaves the old vectors
                    yield f.assign(x=list(v @ c), ax=list(a @ c), p=list(v @ moved), ap=list(a @ moved), w=[[]] * len(f))[["vid", "mass", "block", "x", "ax", "p", "ap", "w"]]

        return rows.mapInPandas(run, schema)

    values, c = space(rows, ["x"])
    rows = materialise(combined(rows, ["x"], c), "vectors")
    for turn in range(most):
        norms = np.sqrt(_summed(rows.select("mass", "x", "ax").mapInPandas(_residuals(values), "sums array<double>")))
        if (norms[:wanted] <= tolerance * max(abs(values).max(), diagonal / average)).all():
            break
        parts = F.transform(F.arrays_zip("ax", "x", F.array(*(F.lit(float(v)) for v in values)).alias("of")), lambda z: z["ax"] - z["of"] * F.col("mass") * z["x"])
        solved = materialise(inverse.solve(rows.withColumn("residual", parts), "residual", "w").drop("residual"), "directions")
        solved = solved.mapInPandas(_without(_summed(solved.select("mass", "x", "w").mapInPandas(_shares, "sums array<double>"))), solved.schema)
        rows = materialise(product(solved, "w"), "space")
        columns = ["x", "w"] if turn == 0 else ["x", "w", "p"]
        values, c = space(rows, columns)
        rows = materialise(combined(rows, columns, c), "vectors")
    else:
        raise RuntimeError(f"the diffusion map has not converged in {most} steps")
    if rounds is not None:
        rounds.append(turn)
    weights = [float(np.exp(-v * t)) for v in values[1:wanted]]
    return rows.select("vid", F.array(*(F.col("x")[j + 1] * w for j, w in enumerate(weights))).alias("coordinates"))
