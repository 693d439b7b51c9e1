"""Vector code compression: product codes by member-resident Lloyd rounds.

Vectors of integers are cut into ``PARTS`` consecutive parts, each with a codebook of ``ENTRIES`` entries. Every part is a
member of an entry, and its owner is the partition of (position, entry, salt): an entry has one salt per ``rows per owner``
members, so one that holds a third of all parts has many owners. Members live in files, each written by one owner:

1. the first assignment deals every part to its owner, the only shuffle of all parts;
2. the owners add up their resident members (a row of sums per entry and task), and Spark adds the rows of an entry;
   the driver holds the codebooks, a number of entries that the parameters bound, and the tasks get them by broadcast;
3. each owner assigns its members anew. Members that keep their entry are written where they are, without a shuffle; those that
   change entry are the only rows of the next shuffle, to the files of their new owners;
4. after the last round the whole vectors are coded against the final codebooks in one pass, without a shuffle.

Distances are exact: in double precision where no partial sum can pass 2^53, otherwise in 64-bit integers.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped (the contract). Components beyond
+-``CLAMP`` after scaling count as that bound, which keeps distances within 64 bits. The commonest length (of equally common ones
the longest) is the length of the codebooks; rows of another length stay with a null code and error. A length that 4 does not divide is
cut at floor(k * length / 4). A null id is coded but gives no codebook entry; of repeated ids the smallest vector gives the entry, and
every row is coded. Fewer ids than entries give smaller codebooks, no id leaves all codes null; no row gives no rows; equal labels
share an error, nulls too; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, partitions, staged

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
CLAMP = 2**27
#: Members that one owner should hold at most; labels whose sums may be broadcast; rows compared with a codebook at a time.
OWNER_ROWS, MAX_LABELS, SLICE = 200_000, 100_000, 4096
_MEMBER = "position int, entry int, row long, part array<int>"


def integers(vectors: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec array<int>, row) of the rows that are kept, staged."""
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)), F.lit(False))
    bounded = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-float(CLAMP)), F.least(F.lit(float(CLAMP)), x * scale))).cast("int"))
    return staged(rows.filter(finite).select("vec_id", "label", bounded.alias("vec"), F.monotonically_increasing_id().alias("row")), "vectors")


def cuts(length: int, parts: int = PARTS) -> list[int]:
    return [k * length // parts for k in range(parts + 1)]


def seeds(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> list[np.ndarray]:
    """A codebook per position: that part of the vectors of the smallest ids."""
    named = rows.filter(F.col("vec_id").isNotNull())
    ids = named.select("vec_id").distinct().orderBy("vec_id").limit(entries)
    first = named.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("vec").alias("vec")).collect()  # ``entries`` rows
    if not first:
        return []
    whole = np.array([r.vec for r in sorted(first, key=lambda r: r.vec_id)], dtype=np.int64)
    edge = cuts(whole.shape[1], parts)
    return [whole[:, a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), width)


def first_members(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Every part with its entry in the first codebooks."""
    held, edge = rows.sparkSession.sparkContext.broadcast(books), np.cumsum([0, *(b.shape[1] for b in books)]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = _matrix(b.column("vec"), edge[-1])
            for position, book in enumerate(held.value):
                part = whole[:, edge[position]:edge[position + 1]]
                yield _members(np.full(len(part), position), nearest(part, book)[0], b.column("row"), part)
    return rows.select("row", "vec").mapInArrow(run, _MEMBER)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance; ties go to the lower index."""
    at, error = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = 4 * parts.shape[1] * most * most < 2**53
    kind = np.float64 if exact else np.int64
    b = book.astype(kind)
    size = (b * b).sum(axis=1)
    for k in range(0, len(parts), SLICE):
        p = parts[k:k + SLICE].astype(kind)
        if exact:
            d = (p * p).sum(axis=1)[:, None] - 2 * (p @ b.T) + size
        else:
            d = np.stack([((p - e) ** 2).sum(axis=1) for e in b], axis=1)
        low = d.argmin(axis=1)
        at[k:k + SLICE], error[k:k + SLICE] = low, d[np.arange(len(p)), low].astype(np.int64)
    return at, error


def _members(position: np.ndarray, entry: np.ndarray, row: pa.Array, part: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(np.ascontiguousarray(part, dtype=np.int32).ravel()))
    arrays = {"position": pa.array(position, pa.int32()), "entry": pa.array(entry, pa.int32()), "row": row, "part": lists} | {k: pa.array(v) for k, v in more.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def reassigned(members: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The members of owners with their entries in new codebooks, and whether that is another entry."""
    held = members.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            position, old = b.column("position").to_numpy(), b.column("entry").to_numpy()
            for p in np.unique(position).tolist():
                here = np.flatnonzero(position == p)
                part = _matrix(b.column("part").take(pa.array(here)), held.value[p].shape[1])
                entry = nearest(part, held.value[p])[0]
                yield _members(position[here], entry, b.column("row").take(pa.array(here)), part, moved=entry != old[here])
    return members.mapInArrow(run, _MEMBER + ", moved boolean")


def updated(members: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after the owners added up their members; an entry without members stays."""
    widths = [b.shape[1] for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for b in batches:
            position, entry = b.column("position").to_numpy(), b.column("entry").to_numpy()
            for p in np.unique(position).tolist():
                here = np.flatnonzero(position == p)
                np.add.at(total[p], entry[here], _matrix(b.column("part").take(pa.array(here)), widths[p]))
                count[p] += np.bincount(entry[here], minlength=len(count[p]))
        rows = [(p, e, int(count[p][e]), total[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(count[p]).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(("position", "entry", "n", "sums"), r, strict=True)) for r in rows],
                                         pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
    parts = members.mapInArrow(run, "position int, entry int, n long, sums array<long>")
    flat = parts.select("position", "entry", "n", F.posexplode(F.concat(F.array("n"), "sums")))
    out = [b.copy() for b in books]
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in flat.groupBy("position", "entry", "pos").agg(F.sum("col").alias("s")).collect():  # a number per codebook component
        found.setdefault((r.position, r.entry), {})[r.pos] = r.s
    for (p, e), sums in found.items():
        out[p][e] = [sums[k + 1] // sums[0] for k in range(widths[p])]
    return out


def sizes(members: DataFrame) -> dict[tuple[int, int], int]:
    """The members of each entry."""
    return {(r.position, r.entry): r.n for r in members.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per entry


def dealt(members: DataFrame, size: dict[tuple[int, int], int]) -> DataFrame:
    """Members in the partitions of their owners (position, entry, salt). Owners are numbered in a row and hold at most
    about an eighth of a partition's share, so every partition gets equally many."""
    n = partitions(members.sparkSession)
    each = min(OWNER_ROWS, max(1, math.ceil(sum(size.values()) / (8 * n))))
    begin, at = [], 0
    for (p, e), count in sorted(size.items()):
        begin.append((p, e, at, salts := math.ceil(count / each)))
        at += salts
    table = members.sparkSession.createDataFrame(begin, "position int, entry int, first long, salts long")  # a row per entry
    owner = members.join(F.broadcast(table), ["position", "entry"]).withColumn("owner", F.col("first") + F.pmod(F.xxhash64("row", "position"), F.col("salts")))
    return owner.repartitionById(n, F.pmod("owner", F.lit(n)).cast("int")).select("position", "entry", "row", "part")


def codebooks(rows: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after all rounds of assigning parts and averaging members."""
    if not rounds:
        return books
    first = first_members(rows, books)
    resident = staged(dealt(first, sizes(first)), "members")
    for k in range(1, rounds + 1):
        books = updated(resident, books)
        if k == rounds:
            break
        marked = staged(reassigned(resident, books), f"members-{k}")  # in the files of the same owners
        resident, gone = marked.filter(~F.col("moved")).drop("moved"), marked.filter("moved").drop("moved")
        if moving := sizes(gone):
            resident = resident.unionByName(staged(dealt(gone, moving), f"moved-{k}"))
    return books


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every row against the codebooks."""
    held, edge = rows.sparkSession.sparkContext.broadcast(books), np.cumsum([0, *(b.shape[1] for b in books)]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = _matrix(b.column("vec"), edge[-1])
            found = [nearest(whole[:, edge[p]:edge[p + 1]], book) for p, book in enumerate(held.value)]
            code = ["".join(f"{i:02x}" for i in index) for index in zip(*(f[0].tolist() for f in found), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(sum(f[1] for f in found))], ["vec_id", "label", "code", "error"])
    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by position, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row, and the codebooks."""
    rows = integers(vectors, key, vector, label)
    length = rows.groupBy(F.size("vec").alias("l")).count().orderBy(F.desc("count"), F.desc("l")).first()
    usual = rows.filter(F.size("vec") == (length.l if length else 0))
    books = seeds(usual)
    null = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "vec")
    if not books:
        return null.drop("vec"), books
    books = codebooks(usual, books)
    return coded(usual, books).unionByName(null.filter(F.size("vec") != length.l).drop("vec")), books


def query(vectors: DataFrame) -> DataFrame:
    """Every kept vector's code, its squared error, its label's error, and the codebooks' hash."""
    out, books = compress(vectors)
    out = staged(out, "codes")
    sums = staged(out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return (out.join(broadcast_up_to(sums, MAX_LABELS), F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


_ASSIGN = """
, assigned{r} AS MATERIALIZED (
  SELECT k, p, key % {n} AS e, key // {n} AS d FROM (
    SELECT k, p, min((list_inner_product(part, part) - 2 * list_inner_product(part, c) + list_inner_product(c, c))::BIGINT * {n} + e) AS key
    FROM parts JOIN book{r} USING (p) GROUP BY k, p)
)"""
_UPDATE = """
, book{s} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, list(x ORDER BY i) AS c FROM (
      SELECT p, e, i, floor(sum(x) / count(*)) AS x FROM (SELECT p, e, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM parts JOIN assigned{r} USING (k, p)) GROUP BY p, e, i
    ) GROUP BY p, e) m USING (p, e)
)"""
#: For vectors of one length that 4 divides.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v, row_number() OVER () AS k
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT k, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS part FROM kept, range({PARTS}) r(p)
), book0 AS MATERIALIZED (
  SELECT p, e, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS c
  FROM (SELECT min(v) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {ENTRIES}), range({PARTS}) r(p)
)""" + "".join((_ASSIGN + _UPDATE).format(r=r, s=r + 1, n=ENTRIES) for r in range(ROUNDS)) + _ASSIGN.format(r=ROUNDS, n=ENTRIES) + f"""
, final AS (
  SELECT vec_id, label, code, error FROM kept JOIN (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM assigned{ROUNDS} GROUP BY k) USING (k)
), hash AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM book{ROUNDS})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM final, hash
"""
