"""MinHash near-duplicates by a chosen-path set-similarity join (after Christiani, Pagh, Sivertsen).

1. ``sketch``: each whole text becomes the set of its hashed 5-word shingles, of which stay its
   size, a 128-bit fingerprint cut to a 64-bit class id, TOKENS minwise tokens for the paths and a one-permutation
   sketch of BINS bytes for comparisons. Texts with equal sets are one class and are joined as one record.
2. TREES trees branch the classes: a node picks two of the minwise tokens, and a record goes to one child per pick, named by
   the token's value. Nodes with the same members are one node; it picks two for each node that it stands for (up to TREES),
   as these would have. At a Jaccard similarity of 0.75 a pair then shares a path through all trees' levels but for a miss of
   2e-9 at the first, 5e-7 at the fourth, 1.5e-6 at the last (MAX_LEVELS + 1 picks) and 2e-6 at any depth, and of 3e-8 at 0.8
   (expectation over the binomial share of the 128 tokens that agree, which all trees use).
3. First a spanning forest of the likely pairs of each node is confirmed on the full sets: of a node of at most LIMIT
   records at once, of a larger one in blocks that each hold the node's first record too. Nodes with
   records of more than one component are then compared exhaustively on the sketches, all likely pairs between different components (a node
   of at most LIMIT records only if a pair of its forest was refuted: else all its likely pairs are in one component already); a block
   with more such pairs than records gets the full sets into its task, which confirms the pairs there and returns a spanning forest
   of the confirmed ones, so that refuted pairs never become rows:
   the records outside the node's largest component are compared, block against block, with each other and with that component, whose own
   pairs need no look. A node of more than EXHAUSTIVE records with more than LIMIT of them outside branches again instead. After MAX_LEVELS
   what is left is compared as well, so no node is dropped or cut. Hence a group of copies costs links in proportion to
   its size, and every pair is either confirmed, refuted, or inside one component already.
4. A pair is likely if its common bins reach the threshold less 4.5 standard deviations (sampling without
   replacement) and one percent; a miss has a probability below 4e-6.

Blocks are bounded; a hot node is many blocks and joins in which AQE splits the key. Equality of
shingles is equality of 64-bit hashes.

Defined cases: a null or empty text has no set, no link and is its own component; a text under five
words is one shingle; rows with a null id link with nothing and have a null component; repeated
rows have one component, and each row of the smallest id counts as kept; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, WORD, broadcast_up_to, staged
from .components import components
from .shingles import WIDTH, Signer, binned, mix, shingles, similar

PERCENT, TOKENS, BINS, TREES, BRANCHES, LIMIT, EXHAUSTIVE, MAX_LEVELS = 75, 128, 512, 8, 2, 128, 8192, 8
#: A side of the tiles that a large node is compared in, in LIMIT records; shared shingles of a block up to which it is multiplied out.
TILE, MOST_WIDE = 8, 200_000


def _class_id(hashes: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(hashes.tobytes())[:8], "little", signed=True)


def _sketch(batches):
    sign = Signer(TOKENS)
    for b in batches:
        sets = [shingles(t) for t in b["text"]]
        yield pd.DataFrame({"id": b["id"].astype("Int64"), "text_hash": b["text_hash"].astype("Int64"), "n": [len(s) for s in sets],
                            "class_id": [_class_id(s) for s in sets], "path": [sign(s).tobytes() for s in sets], "sig": [binned(s, BINS).tobytes() for s in sets]})


def _full_sets(batches):
    """Sets of the representatives: rows (id, class_id, text) whose text is of that class."""
    for b in batches:
        sets = [shingles(t) for t in b["text"]]
        right = [_class_id(s) == c for s, c in zip(sets, b["class_id"], strict=True)]
        yield pd.DataFrame({"class_id": b["class_id"], "hashes": [s.tobytes() for s in sets]})[right]


def _paths(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, TOKENS)


def _children(nodes: np.ndarray, paths: np.ndarray, branch: int) -> np.ndarray:
    """The child of each record's node along one picked token."""
    pick = mix(nodes + np.uint64(0x9E3779B97F4A7C15 * (branch + 1) % 2**64))
    token = paths[np.arange(len(paths)), (pick % np.uint64(TOKENS)).astype(np.int64)]
    return mix(pick ^ mix(token.astype(np.uint64) + np.uint64(1)))


def _roots(batches):
    for b in batches:
        if len(b):
            paths, ids = _paths(b["path"]), b["class_id"].to_numpy()
            for tree in range(TREES):
                node = np.full(len(ids), mix(np.array([tree + 1], dtype=np.uint64))[0])
                for k in range(BRANCHES):
                    yield pd.DataFrame({"node": _children(node, paths, k).view(np.int64), "id": ids})


def _branch(batches):
    for b in batches:
        if len(b):
            paths, ids, node = _paths(b["path"]), b["id"].to_numpy(), b["node"].to_numpy().view(np.uint64)
            picks = BRANCHES * b["m"].to_numpy()
            for k in range(int(picks.max())):
                goes = picks > k
                yield pd.DataFrame({"node": _children(node[goes], paths[goes], k).view(np.int64), "id": ids[goes]})


def blocks(batches, key: str = "key"):
    """Batches sorted by ``key`` -> the rows of one key at a time."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        keys = b[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            yield b.iloc[a:z]
        held = b.iloc[starts[-1]:]
    if held is not None and len(held):
        yield held


def _estimates(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Estimated similarity of each of the sketches x with each of y, -1 where the pair is not likely."""
    ex, ey = (x != 0).astype(np.float32), (y != 0).astype(np.float32)
    met = ex.sum(1)[:, None] + ey.sum(1)[None] - ex @ ey.T  # bins that are not empty in both
    common = np.stack([np.count_nonzero(y == s, axis=1) for s in x]) - (BINS - met)
    share = PERCENT / 100
    short, long = np.minimum(nx[:, None], ny[None]), np.maximum(nx[:, None], ny[None])
    union = (short + long) / (1 + share)
    spread = np.sqrt(share * (1 - share) * met * np.clip(1 - met / np.maximum(union, 1), 0, 1))
    likely = (common >= (share - 0.01) * met - 4.5 * spread - 1) & (100 * short >= PERCENT * long)
    return np.where(likely, common / np.maximum(met, 1), -1.0)


def _forest(est: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximal spanning forest over the likely pairs."""
    n, edges = len(est), []
    best, parent, out = np.full(n, -1.0), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for _ in range(n):
        at = int(np.argmax(np.where(out, best, -2.0)))
        if best[at] >= 0:
            edges.append((at, int(parent[at])))
        out[at] = False
        nearer = out & (est[at] > best)
        best[nearer], parent[nearer] = est[at][nearer], at
    return edges


def _across(g: pd.DataFrame, most: int) -> np.ndarray | None:
    """The likely pairs (places in the block) of different components; None once there are more than ``most``."""
    comp, side, size = (g[c].to_numpy() for c in ("comp", "side", "size"))
    sigs = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(-1, BINS)
    kinds, times = np.unique(comp, return_counts=True)
    # pairs inside the largest component need no look: one of two is outside it
    outside = np.flatnonzero(comp != kinds[np.argmax(times)])
    found, held = [np.empty((0, 2), dtype=np.int64)], 0
    for k in range(0, len(outside), 64):
        rows = outside[k:k + 64]
        ok = (_estimates(sigs[rows], size[rows], sigs, size) >= 0) & (comp[rows][:, None] != comp[None])
        if side.any():  # two blocks of one node: pairs inside a block belong to that block
            ok &= side[rows][:, None] != side[None]
        at = np.argwhere(ok)
        held += len(at)
        if held > most:
            return None
        found.append(np.stack([rows[at[:, 0]], at[:, 1]], axis=1))
    return np.concatenate(found)


def _members(batches):
    """The blocks with two records or more, each record once."""
    for g in blocks(batches):
        g = g.drop_duplicates(["id", "side"])
        if len(g) > 1:
            yield g


def _pairs(batches, forest: bool):
    """Likely pairs of each block: those of a spanning forest (with the block's key), or all that join different components; of a
    block with more of these than records only its key, as a dense one."""
    us, vs, dense, keys = [], [], [], []

    def out():
        made = pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "dense": np.concatenate(dense)})
        return made.assign(key=np.concatenate(keys)) if forest else made
    for g in _members(batches):
        ids = g["id"].to_numpy()
        if forest:
            size, sigs = g["size"].to_numpy(), np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(-1, BINS)
            found = np.array(_forest(_estimates(sigs, size, sigs, size)), dtype=np.int64).reshape(-1, 2)
        else:
            found = _across(g, len(ids))
        if found is None:
            us.append(g["key"].iloc[:1].to_numpy())
            vs.append(us[-1])
            dense.append(np.array([True]))
        else:
            pair = np.sort(ids[found], axis=1)
            us.append(pair[:, 1])
            vs.append(pair[:, 0])
            dense.append(np.zeros(len(pair), dtype=bool))
            keys.append(np.full(len(pair), g["key"].iloc[0]))
        if len(us) > 500:
            yield out()
            us, vs, dense, keys = [], [], [], []
    if us:
        yield out()


def _shared(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two sets or more of a block have, as numbers from 0, and the set of each."""
    size = np.array([len(s) // 8 for s in sets])
    _, column, times = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True, return_counts=True)
    owner, many = np.repeat(np.arange(len(sets)), size), times[column] > 1
    return np.unique(column[many], return_inverse=True)[1], owner[many]


def _similar_pairs(g: pd.DataFrame) -> np.ndarray:
    """The similar pairs (places) of different components of a block. Common shingles are counted for all pairs at once, by products of
    slices of the block's incidence matrix, unless looking at the likely pairs one by one is less work."""
    comp, side, sets = g["comp"].to_numpy(), g["side"].to_numpy(), g["hashes"].to_list()
    column, owner = _shared(sets)
    wide = int(column.max()) + 1 if len(column) else 0
    if wide > MOST_WIDE:
        found = _across(g, len(sets) ** 2)
        return found[[similar(sets[a], sets[b], PERCENT) for a, b in found.tolist()]] if len(found) else found
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for k in range(0, wide, 4096):
        a, z = np.searchsorted(column, [k, k + 4096])
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[owner[a:z], column[a:z] - k] = 1
        common += m @ m.T
    size = np.array([len(s) // 8 for s in sets], dtype=np.float32)
    ok = (100 * common >= PERCENT * (size[:, None] + size[None] - common)) & (comp[:, None] < comp[None])
    if side.any():
        ok &= side[:, None] != side[None]
    return np.argwhere(ok)


def _links_within(batches):
    """A spanning forest of the confirmed pairs between different components of each block."""
    for g in _members(batches):
        ids, found = g["id"].to_numpy(), _similar_pairs(g)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c
        comp, out = g["comp"].to_list(), []
        open_ = len(set(comp)) - 1
        for a, b in found.tolist():
            x, y = root(comp[a]), root(comp[b])
            if x != y:
                parent[x] = y
                open_ -= 1
                out.append((max(ids[a], ids[b]), min(ids[a], ids[b])))
                if not open_:
                    break
        if out:
            yield pd.DataFrame(out, columns=["u", "v"])


@F.pandas_udf(T.BooleanType())
def _confirmed(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([similar(a, b, PERCENT) for a, b in zip(x, y, strict=True)], dtype=bool)


class _Join:
    """The state of one join: signatures, full sets of the classes met so far, tested pairs, links."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes
        self.sets = self.tested = self.links = self.comp = None

    def confirm(self, pairs: DataFrame) -> None:
        """Tests pairs that were not tested before on their full sets; updates the components."""
        new = pairs.distinct()
        if self.tested is not None:
            new = new.join(self.tested, ["u", "v"], "left_anti")
        new = staged(new, "pairs")
        if new.isEmpty():
            return
        self._fetch(new.select(F.col("u").alias("class_id")).union(new.select("v")).distinct())
        both = (new.join(self.sets.select(F.col("class_id").alias("u"), F.col("hashes").alias("x")), "u")
                .join(self.sets.select(F.col("class_id").alias("v"), F.col("hashes").alias("y")), "v"))
        links = staged(both.filter(_confirmed("x", "y")).select("u", "v"), "links")
        self.tested = new if self.tested is None else self.tested.unionByName(new)
        self._add(links)

    def _add(self, links: DataFrame) -> None:
        if not links.isEmpty():
            self.links = links if self.links is None else self.links.unionByName(links)
            self.comp = staged(components(self.links), "components")

    def exhaust(self, keyed: DataFrame) -> None:
        """Confirms or refutes every likely pair between different components of the blocks ``keyed`` (key, id, side, comp)."""
        keyed = staged(keyed, "blocks")
        if keyed.isEmpty():
            return
        found = staged(self.pairs(keyed, False), "likely")
        before = self.comp
        dense = staged(keyed.drop("comp").join(broadcast_up_to(found.filter("dense").select(F.col("u").alias("key")).distinct(), 1_000_000), "key"), "dense")
        self.confirm(found.filter("NOT dense").select("u", "v"))
        if dense.isEmpty():
            return
        if before is not self.comp:     # fewer pairs are open now
            key = self.labelled(dense).groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("key")
            dense = staged(dense.join(key, "key"), "dense")
        self._fetch(dense.select(F.col("id").alias("class_id")).distinct())
        rows = self.signed(self.labelled(dense), "size", "sig").join(self.sets.withColumnRenamed("class_id", "id"), "id")
        rows = rows.repartition("key").sortWithinPartitions("key")
        self._add(staged(rows.mapInPandas(_links_within, "u long, v long"), "links"))

    def _fetch(self, ids: DataFrame) -> None:
        """The full sets of classes that were not fetched yet, from the texts of their representatives."""
        if self.sets is not None:
            ids = ids.join(self.sets.select("class_id"), "class_id", "left_anti")
        want = staged(self.classes.select("class_id", "id").join(ids, "class_id"), "wanted")
        if want.isEmpty():
            return
        got = (self.docs.join(broadcast_up_to(want, 2_000_000), "id").select("class_id", "text")
               .mapInPandas(_full_sets, "class_id long, hashes binary").dropDuplicates(["class_id"]))
        got = staged(got, "sets")
        self.sets = got if self.sets is None else self.sets.unionByName(got)

    def labelled(self, members: DataFrame) -> DataFrame:
        if self.comp is None:
            return members.withColumn("comp", F.col("id"))
        return (members.join(self.comp.withColumnRenamed("node", "id"), "id", "left")
                .select(*members.columns, F.coalesce("component", "id").alias("comp")))

    def signed(self, members: DataFrame, *columns: str) -> DataFrame:
        return members.join(self.classes.select(F.col("class_id").alias("id"), *columns), "id")

    def pairs(self, keyed: DataFrame, forest: bool) -> DataFrame:
        rows = self.signed(keyed, "size", "sig").repartition("key").sortWithinPartitions("key")
        return rows.mapInPandas(lambda it: _pairs(it, forest), "u long, v long, dense boolean" + ", key long" * forest)

    def unresolved(self, members: DataFrame, forest: DataFrame) -> DataFrame:
        """Members, with their components, of the nodes that may hold a likely pair of different components, after the pairs ``forest`` (key, u, v) of their blocks
        were tested: of one block if such a pair was refuted, as the forest spans all its likely pairs; of more if they hold several components."""
        refuted = forest.select("key", "u", "v")
        if self.comp is not None:
            side = lambda x: self.comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
            refuted = refuted.join(side("u"), "u", "left").join(side("v"), "v", "left").filter("NOT coalesce(cu, u) <=> coalesce(cv, v)")
        small = members.filter(F.col("n") <= LIMIT).withColumn("key", _key(F.lit(0)))
        small = small.join(refuted.select("key").distinct(), "key", "left_semi").drop("key")
        large = staged(self.labelled(members.filter(F.col("n") > LIMIT)), "labelled")
        open_ = large.groupBy("node").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("node")
        return self.labelled(small).unionByName(large.join(open_, "node").select(*large.columns))


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, id, n, m) of the nodes with two members or more, one node for each set of members, which stands for m nodes (TREES at most)."""
    nodes = (rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
             .filter("n > 1").groupBy("n", "x", "y").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("m"))
             .select("node", "n", F.least("m", F.lit(TREES)).alias("m")))
    return rows.join(nodes, "node")


def _key(block) -> Column:
    return F.xxhash64("node", block.cast("long"))


def _blocked(members: DataFrame) -> DataFrame:
    """Members with a block key: a small node is one block; of a larger one every block of about
    LIMIT members holds the node's first record too."""
    n_blocks = F.ceil(F.col("n") / F.lit(LIMIT)).cast("long")
    m = members.withColumn("k", n_blocks)
    key = lambda block: _key(block).alias("key")
    dealt = m.select(key(F.pmod(F.xxhash64("id", "node"), F.col("k"))), "id")
    first = (members.filter(F.col("n") > LIMIT).groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"))
             .select("node", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.lit(LIMIT)).cast("long") - 1)).alias("block")))
    return dealt.unionByName(first.select(key(F.col("block")), "id")).withColumn("side", F.lit(0))


def _tops(members: DataFrame) -> DataFrame:
    """Members with their node's size, the number of records outside its largest component, and whether this one is (``outside``)."""
    lab = staged(members.select("node", "id", "m", "comp").distinct(), "unresolved")
    per = lab.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("of"))
    top = (per.groupBy("node").agg(F.max(F.struct("of", "comp")).alias("top"), F.sum("of").alias("size"))
           .select("node", "size", F.col("top.comp").alias("top"), (F.col("size") - F.col("top.of")).alias("out")))
    return lab.join(top, "node").select("node", "id", "m", "comp", "size", "out", (F.col("comp") != F.col("top")).alias("outside"))


def _tiles(members: DataFrame) -> DataFrame:
    """The exhaustive comparison of the nodes of ``_tops``: each block of records outside the largest component with each other block, of
    these or of the largest component, whose records thus go to as many blocks as the others fill; a small node is one block."""
    side, small = F.lit(TILE * LIMIT), F.col("size") <= TILE * LIMIT
    n_out, n_top = F.ceil(F.col("out") / side).cast("long"), F.ceil((F.col("size") - F.col("out")) / side).cast("long")
    at = F.xxhash64("id", "node")
    block = F.when(small, 0).when(F.col("outside"), F.pmod(at, n_out)).otherwise(n_out + F.pmod(at, n_top))
    last = F.when(small, 0).when(F.col("outside"), n_out + n_top - 1).otherwise(n_out - 1)
    m = members.filter("out > 0").select("node", "id", "comp", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    return m.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "id", "comp",
                    F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))


def _links(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(node, component) of the classes that link with another one."""
    join = _Join(docs, classes)
    rows = classes.select("class_id", "path").mapInPandas(_roots, "node long, id long")
    for level in range(MAX_LEVELS + 1):
        members = staged(_nodes(staged(rows, "rows")), "members")
        if members.isEmpty():
            break
        forest = staged(join.pairs(_blocked(members), True), "forest")
        join.confirm(forest.select("u", "v"))
        open_ = staged(_tops(join.unresolved(members, forest)), "open")
        goes_on = (F.col("size") > EXHAUSTIVE) & (F.col("out") > LIMIT) & F.lit(level < MAX_LEVELS)
        join.exhaust(_tiles(open_.filter(~goes_on)))
        rest = open_.filter(goes_on)
        if rest.isEmpty():
            break
        rows = join.signed(rest.select("node", "id", "m"), "path").mapInPandas(_branch, "node long, id long")
    return join.comp


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n_shingles, class_id (equal sets), component_id, kept."""
    base = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").cast("binary").alias("text"))
    rows = staged(base.mapInPandas(_sketch, "id long, text_hash long, n long, class_id long, path binary, sig binary"), "sketches")
    classes = staged(rows.filter("n > 0 AND id IS NOT NULL").groupBy("class_id").agg(F.min("id").alias("id"), F.max("n").alias("size"), F.first("path").alias("path"), F.first("sig").alias("sig")), "classes")
    comp = _links(base.filter("id IS NOT NULL"), classes)
    named = classes.select("class_id", "id")
    if comp is not None:
        named = named.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left").select("class_id", "id", F.coalesce("component", "class_id").alias("component"))
        smallest = named.groupBy("component").agg(F.min("id").alias("least"))
        named = named.join(smallest, "component").select("class_id", F.col("least").alias("id"))
    named = staged(named.select("class_id", F.col("id").alias("least")), "named")
    found = rows.select("id", "text_hash", F.col("n").alias("n_shingles"), "class_id").join(named, "class_id", "left")
    alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    found = found.withColumn("component_id", F.when(alone, F.col("id")).otherwise(F.col("least")))
    return found.select("id", "text_hash", "n_shingles", "class_id", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less all rows of each component but one: that of its smallest id, and of several rows of that id
    one. Rows without words or without an id stay."""
    own = docs.columns
    rows = staged(near_duplicates(docs, key, text).filter("n_shingles > 0 AND id IS NOT NULL").select("id", "text_hash", "component_id"), "rows")
    first = rows.filter("id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("first"))
    losers = rows.join(first, "component_id").filter((F.col("id") != F.col("component_id")) | (F.col("text_hash") != F.col("first")))
    losers = staged(losers.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "losers")
    left = docs.join(broadcast_up_to(losers, 1_000_000), (F.col(f"`{key}`").cast("long") == F.col("__id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__hash")), "left_anti")
    again = staged(rows.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")), "repeated")
    if not again.isEmpty():  # rows that agree in id and text
        left = left.join(broadcast_up_to(again, 1_000_000), (F.col(f"`{key}`").cast("long") == F.col("__id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__hash")), "left")
        left = left.filter("__id IS NULL").unionByName(left.filter("__id IS NOT NULL").dropDuplicates(["__id", "__hash"]))
    return left.select(*(F.col(f"`{c}`") for c in own))


def query(docs: DataFrame) -> DataFrame:
    """One row per document: the size of its set, the smallest id it reaches by links, and whether that is its own."""
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < {WIDTH} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(generate_series(1, len(ws) - {WIDTH - 1}), lambda i: array_to_string(ws[i:i + {WIDTH - 1}], ' ')) END) AS tok FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.tok = b.tok AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= {PERCENT} * (x.n + y.n - m)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least AS component_id, w.doc_id = least AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN g ON g.a = w.doc_id
"""
