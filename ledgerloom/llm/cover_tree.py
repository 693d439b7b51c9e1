"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors, distance d = sqrt(2 - 2 cos), so a cosine of 0.9 or more is d <= t.

1. Equal vectors become one class with a count. The classes are dealt to at most MAX_CELLS
   pivots (chosen by hash) by the nearest pivot, large cells into blocks of about BLOCK classes.
2. Each block builds its cover tree in one task: nested levels of centres with radii 1, 1/2, 1/4, ...
   (every centre of a level is one of the next; centres of a level are more than its radius apart
   and cover all points within it), and the true covering radius of every node.
3. Dual traversal. Pairs of cells, then of blocks, are pruned by d > r_a + r_b + t. In each pair
   of blocks that is left, both trees are descended level by level: node pairs beyond the same bound
   are dropped, pairs with d + r_a + r_b <= t are linked as a whole, and at the points the cosine itself
   decides, in double precision. Nothing is approximate: the bounds are taken in single precision, with a margin
   of 1e-5, about a hundred times its error. Runs of blocks form groups, as many as the root of the number of blocks (more, if a
   group would weigh over GROUP_BYTES); a task has the pairs of two groups, so a block is sent once for each group, not for each pair.
4. A task returns a count of links per vector and a spanning forest of its links, never the pairs,
   so a group of copies costs rows in proportion to its size. Connected components join the forests.

In data of high intrinsic dimension the bounds prune little between unrelated blocks, and the work is then
the square of the number of distinct vectors, in dense blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with
nothing; vectors of different lengths never link; repeated rows count as vectors of their own; no rows
give no rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path import blocks as by_key
from .common import staged
from .components import components

COSINE, BLOCK, MAX_CELLS, MARGIN, LEVELS = 0.9, 2048, 1024, 1e-5, 6
#: Of the vectors that a task holds; block pairs whose list is broadcast.
GROUP_BYTES, MAX_SENT = 32 << 20, 1_000_000


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; first by the largest component, so that no square over- or underflows."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column, dim: int) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in column]).reshape(-1, dim))


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


def cover_tree(x: np.ndarray) -> dict:
    """Levels of a cover tree over unit vectors: ``order`` (centres of a level are a prefix of it), and per
    level the number of centres, each centre's parent in the level above, its covering radius and
    the ancestor of every point."""
    d = _distance(x @ x.T)
    n = len(x)
    centres, counts, radius = [0], [1], 1.0
    near = d[0].copy()
    for _ in range(LEVELS):
        if len(centres) == n:
            break
        far = np.flatnonzero(near > radius)
        while len(far):
            c = int(far[0])
            centres.append(c)
            near = np.minimum(near, d[c])
            near[c] = -1.0  # a centre; no other point may stand for it
            far = far[near[far] > radius]
        if len(centres) > counts[-1]:
            counts.append(len(centres))
        radius /= 2
    near[centres] = -1.0
    order = np.concatenate([np.array(centres), np.flatnonzero(near >= 0)[~np.isin(np.flatnonzero(near >= 0), centres)]]).astype(np.int64)
    if counts[-1] < n:
        counts.append(n)
    d = d[np.ix_(order, order)]
    parents = [np.zeros(1, dtype=np.int64)]
    for above, here in zip(counts[:-1], counts[1:], strict=True):
        parents.append(d[:here, :above].argmin(axis=1))
        parents[-1][:above] = np.arange(above)  # nested: a centre is its own parent
    ancestors = [np.arange(n)]
    for p in reversed(parents[1:]):
        ancestors.append(p[ancestors[-1]])
    ancestors.reverse()
    radii = []
    for c, a in zip(counts, ancestors, strict=True):
        r = np.zeros(c)
        np.maximum.at(r, a, d[np.arange(n), a])
        radii.append(r)
    small = lambda arrays: [x.astype(np.int32) for x in arrays]
    return {"order": order, "counts": counts, "parents": small(parents), "radii": radii, "ancestors": small(ancestors)}


def _merge(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of 0..n-1 reaches over the edges (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def traverse(a: dict, b: dict, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dual traversal of two blocks (``x`` in tree order, ``near`` the same in single precision, ``copies``, ``tree``); the same block twice
    for its own pairs. Returns the links of each point of a and of b (copies of the other side's points, a
    point itself included in its own block), and edges (u, v) between local numbers, b after a."""
    own, t = a is b, float(np.sqrt(2 - 2 * cosine))
    ta, tb, na, nb = a["tree"], b["tree"], len(a["x"]), len(b["x"])
    links_a, links_b = np.zeros(na, dtype=np.int64), np.zeros(nb, dtype=np.int64)
    us, vs = [], []
    ia = ib = np.zeros(1, dtype=np.int64)  # centres still met, and which pairs of them
    alive = np.ones((1, 1), dtype=bool)
    la, lb = len(ta["counts"]), len(tb["counts"])
    for level in range(max(la, lb)):
        ka, kb = min(level, la - 1), min(level, lb - 1)
        if level:  # children of the centres that are left
            ca = np.flatnonzero(np.isin(ta["parents"][ka], ia)) if level < la else ia
            cb = np.flatnonzero(np.isin(tb["parents"][kb], ib)) if level < lb else ib
            up_a = np.searchsorted(ia, ta["parents"][ka][ca]) if level < la else np.arange(len(ia))
            up_b = np.searchsorted(ib, tb["parents"][kb][cb]) if level < lb else np.arange(len(ib))
            alive = alive[up_a][:, up_b] if alive.size > 1 else np.ones((len(ca), len(cb)), dtype=bool)
            ia, ib = ca, cb
        if ka == la - 1 and kb == lb - 1:  # points
            cos = a["x"][ia] @ b["x"][ib].T
            hit = alive & (cos >= cosine)
            if own:
                hit |= alive & (ia[:, None] == ib[None])
            links_a[ia] += hit @ b["copies"][ib]
            links_b[ib] += a["copies"][ia] @ hit
            p, q = np.nonzero(hit)
            us.append(ia[p])
            vs.append(ib[q])
            break
        # bounds in single precision, with a margin above its error; a few rows at a time stay in cache
        ra, rb = (r.astype(np.float32) for r in (ta["radii"][ka][ia], tb["radii"][kb][ib]))
        near_a, near_b, ps, qs, cs = a["near"][ia], b["near"][ib].T, [], [], []
        for k in range(0, len(ia), 128):
            cos = near_a[k:k + 128] @ near_b
            bound = (np.float32(t) + ra[k:k + 128, None]) + rb[None]
            bound *= bound
            bound *= np.float32(-0.5)
            bound += np.float32(1 - MARGIN)
            mask = alive[k:k + 128]
            mask &= cos >= bound
            if mask.any():
                p, q = np.nonzero(mask)
                ps.append(p + k)
                qs.append(q)
                cs.append(cos[p, q])
        if not ps:
            break
        p, q, cos = np.concatenate(ps), np.concatenate(qs), np.concatenate(cs)
        room = t - ra[p] - rb[q]
        whole = (room > 0) & (cos >= 1 - np.maximum(room, 0) ** 2 / 2 + MARGIN)
        if whole.any():
            p, q = p[whole], q[whole]
            alive[p, q] = False
            aa, ab = ta["ancestors"][ka], tb["ancestors"][kb]
            size_a, size_b = np.bincount(aa, a["copies"], ta["counts"][ka]), np.bincount(ab, b["copies"], tb["counts"][kb])
            links_a += np.bincount(ia[p], size_b[ib[q]], ta["counts"][ka]).astype(np.int64)[aa]
            links_b += np.bincount(ib[q], size_a[ia[p]], tb["counts"][kb]).astype(np.int64)[ab]
            us.append(ia[p])
            vs.append(ib[q])
            # every point below joins the first centre of the other side that its node is linked with
            for anc, mine, other, side in ((aa, ia[p], ib[q], 0), (ab, ib[q], ia[p], 1)):
                first = np.full(max(len(ta["radii"][ka]), len(tb["radii"][kb])), -1)
                first[mine[::-1]] = other[::-1]
                points = np.flatnonzero(first[anc] >= 0)
                pair = (points, first[anc][points])
                us.append(pair[side])
                vs.append(pair[1 - side])
            if not alive.any():
                break
        keep_a, keep_b = alive.any(axis=1), alive.any(axis=0)
        ia, ib, alive = ia[keep_a], ib[keep_b], alive[np.ix_(keep_a, keep_b)]
    u = np.concatenate(us) if us else np.empty(0, dtype=np.int64)
    v = np.concatenate(vs) if vs else np.empty(0, dtype=np.int64)
    return links_a, links_b, u, v + (0 if own else na)


def _load(blob: bytes) -> dict:
    b = pickle.loads(blob)  # written by _build in this job
    x = _unit(b.pop("raw"))
    return b | {"x": x, "near": x.astype(np.float32)}


def _build(dim: int):
    def run(batches):
        for g in by_key(batches, "block"):
            raw = np.stack(g["vec"].to_numpy())
            tree = cover_tree(_unit(raw))
            order = tree.pop("order")
            blob = pickle.dumps({"raw": raw[order], "ids": g["class_id"].to_numpy()[order], "copies": g["copies"].to_numpy()[order], "tree": tree}, 5)
            yield pd.DataFrame({"block": [int(g["block"].iloc[0])], "cell": [int(g["cell"].iloc[0])], "radius": [float(g["far"].max())], "tree": [blob]})
    return run


def _traverse(batches):
    """Rows (tile, block, met, tree) sorted by tile and block: a block is held for later ones of its tile if it meets none, or itself."""
    at, held = None, {}
    for batch in batches:
        for tile, block, met, tree in zip(batch["tile"], batch["block"], batch["met"], batch["tree"], strict=True):
            if tile != at:
                at, held = tile, {}
            y, found = _load(tree), []
            if not len(met) or block in met:
                held[block] = y
            for a in met:
                x = held[a]
                links_x, links_y, u, v = traverse(x, y)
                ids = x["ids"] if x is y else np.concatenate([x["ids"], y["ids"]])
                links = links_x if x is y else np.concatenate([links_x, links_y])
                label = _merge(len(ids), u, v)
                some = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
                found.append(pd.DataFrame({"u": ids[some], "v": ids[label[some]], "links": links[some]}))
            if found:
                yield pd.concat(found)


def _join(classes: DataFrame, dim: int) -> DataFrame:
    """(u, v, links): per block pair, links of class u and an edge of the forest, for vectors of one length."""
    spark = classes.sparkSession
    n = classes.count()
    n_cells = max(1, min(MAX_CELLS, -(-n // BLOCK)))
    pivots = _vectors((r[0] for r in classes.orderBy(F.xxhash64("class_id"), "class_id").select("vec").limit(n_cells).collect()), dim)

    def deal(batches):
        for b in batches:
            if len(b):
                d = _distance(_vectors(b["vec"], dim) @ pivots.T)
                cell = d.argmin(axis=1)
                yield b.assign(cell=cell, far=d[np.arange(len(b)), cell])

    dealt = staged(classes.select("class_id", "copies", "vec").mapInPandas(deal, "class_id long, copies long, vec array<float>, cell long, far double"), "cells")
    # cells: one row per pivot
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).toPandas()
    parts = np.ones(len(pivots), dtype=np.int64)
    parts[cells["cell"]] = -(-cells["n"].to_numpy() // BLOCK)
    radius = np.zeros(len(pivots))
    radius[cells["cell"]] = cells["radius"]
    start = np.concatenate([[0], np.cumsum(parts)])
    look = F.array(*(F.lit(int(s)).cast("long") for s in start))
    at = F.col("cell").cast("int")
    block = F.get(look, at) + F.pmod(F.xxhash64("class_id"), F.get(look, at + 1) - F.get(look, at))
    keyed = dealt.withColumn("block", block).repartition("block").sortWithinPartitions("block")
    trees = staged(keyed.mapInPandas(_build(dim), "block long, cell long, radius double, tree binary"), "trees")

    t, present = float(np.sqrt(2 - 2 * COSINE)), sorted(cells["cell"])

    def cell_pairs(batches):
        for b in batches:
            for i in b["id"]:
                if i in present:
                    d = _distance(pivots[i:] @ pivots[i])
                    j = np.flatnonzero(d <= radius[i] + radius[i:] + t + MARGIN) + i
                    yield pd.DataFrame({"p": np.full(len(j), i), "q": j, "d": d[j - i]})

    pairs = spark.range(len(pivots)).mapInPandas(cell_pairs, "p long, q long, d double")
    small = trees.select("block", "cell", "radius")
    left, right = (small.select(*(F.col(c).alias(s + c) for c in small.columns)) for s in "ab")
    pairs = (pairs.join(left, F.col("p") == F.col("acell")).join(right, F.col("q") == F.col("bcell"))
             .filter((F.col("d") <= F.col("aradius") + F.col("bradius") + F.lit(t + MARGIN)) & ((F.col("p") < F.col("q")) | (F.col("ablock") <= F.col("bblock"))))
             .select(F.col("ablock").alias("a"), F.col("bblock").alias("b")))
    pairs = staged(pairs, "pairs")
    n_blocks = int(start[-1])
    n_groups = max(math.isqrt(n_blocks - 1) + 1, -(-n_blocks // max(1, GROUP_BYTES // (4 * dim * BLOCK))))
    n_tasks = min(100_000, n_groups * (n_groups + 1) // 2)
    ga, gb = (F.expr(f"{c} * {n_groups} div {n_blocks}") for c in "ab")  # a <= b
    ends = F.array(F.struct(F.col("a").alias("block"), F.lit(None).cast("long").alias("met")), F.struct(F.col("b").alias("block"), F.col("a").alias("met")))
    sent = (pairs.select((gb * (gb + 1) / 2 + ga).cast("long").alias("tile"), F.explode(ends).alias("end")).groupBy("tile", "end.block").agg(F.collect_list("end.met").alias("met"))
            .groupBy("block").agg(F.collect_list(F.struct("tile", "met")).alias("to")))
    work = (trees.select("block", "tree").join(F.broadcast(sent) if pairs.count() <= MAX_SENT else sent, "block")
            .select("block", "tree", F.explode("to").alias("to")).select("to.tile", "block", "to.met", "tree")
            .repartitionById(n_tasks, F.pmod("tile", F.lit(n_tasks)).cast("int")).sortWithinPartitions("tile", "block"))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row holds a block
    try:
        return staged(work.mapInPandas(_traverse, "u long, v long, links long"), "found")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    vec = F.col("vec")
    sound = (F.col("id").isNotNull() & vec.isNotNull() & (F.size("vec") > 0)
             & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<float>").alias("vec"))
    rows = rows.select("id", "vec", F.coalesce(sound, F.lit(False)).alias("sound"))
    marked = rows.withColumns({"h": F.when(F.col("sound"), F.xxhash64("vec")), "g": F.when(F.col("sound"), F.xxhash64(F.lit(1), "vec"))})
    classes = staged(marked.filter("sound").groupBy("h", "g").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
                     .withColumn("class_id", F.monotonically_increasing_id()), "classes")
    dims = [r[0] for r in classes.select(F.size("vec").alias("d")).distinct().collect()]
    found = None
    for d in dims:
        f = _join(classes.filter(F.size("vec") == d), d)
        found = f if found is None else found.unionByName(f)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.groupBy(F.col("u").alias("class_id")).agg((F.sum("links") - 1).alias("n_links"))  # without itself
    comp = components(found.select("u", "v")).withColumnRenamed("node", "class_id")
    named = (classes.select("class_id", "h", "g", "least").join(comp, "class_id", "left").withColumn("component", F.coalesce("component", "class_id")))
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = staged(named.join(smallest, "component").join(links, "class_id", "left").select("h", "g", "smallest", "n_links"), "named")
    out = marked.select("id", "h", "g").join(named, ["h", "g"], "left")
    own = F.coalesce("smallest", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def query(vectors: DataFrame) -> DataFrame:
    """One row per vector: its links at a cosine of 0.9 or more, the smallest id it reaches, and whether that is its own."""
    return near_duplicates(vectors).withColumnRenamed("id", "vec_id")


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        WHERE list_sum(list_transform(a.x, lambda q: q * q)) > 0 AND list_sum(list_transform(b.x, lambda q: q * q)) > 0
        AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS least FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least AS component_id, vec_id = least AS kept
FROM v JOIN g ON g.a = vec_id LEFT JOIN k ON k.a = vec_id
"""
