"""Near-duplicate embeddings by spherical-cap filters.

Filters are unit directions; a vector belongs to each filter whose direction it
exceeds by ``alpha`` (a cap of the sphere).  Close vectors share caps that
distant ones hardly ever share, so a join on filters brings close ones together
and every joined pair is then verified by its cosine.

The directions are random product codes, ``turns`` of them, each for a random
rotation of the space: it is cut into ``blocks`` blocks of equal width, each
block has ``codes`` random unit codewords, and a direction is any choice of one
codeword a block, divided by sqrt(blocks).  A vector's filters among the
codes**blocks directions of a rotation are found by list decoding, block by
block: a partial choice is given up when even the best of the remaining blocks
can't bring it to alpha.  So the cost follows the filters found, not the
directions.

Vectors of each width have filters of their own (a filter's number holds the
width), so they are joined among themselves.  Of a width that has no more
vectors than parts, all share one filter: a rotation would cost more.

Equal vectors are one from the start: only the one of the smallest id is compared.
A pair with several filters in common counts in the smallest of them.  A filter
with more than ``tile`` vectors is cut into tiles by a hash of the vector's id,
and each pair of tiles is a group of its own: no candidate is dropped and no
task holds more than two tiles.

Result of ``near_vectors``: one row for each id: class_id, the smallest id of its class
(vectors that are linked by close pairs, directly or through others); links, the
number of different vectors that its own is close to; and copies, the number of
other ids of an equal vector.  Groups give links and local classes, never pairs.
``near_pairs`` lists the pairs of different vectors instead (by their smallest ids), and
each set of equal ones as a star: its smallest id with each other id.

The search is approximate: with the default parameters a pair at the threshold
is found with a chance of more than 0.95, closer pairs more surely.  The share of
the sphere in a cap of a given alpha shrinks as vectors get wider, so unless it
is given, alpha follows the width: up to ``WIDTH`` it is ``ALPHA`` (with fewer
codewords), beyond, that of caps with the same share, so that vectors of any width
have about as many filters and pairs are found as surely.

Defined cases: rows with a null id are left out; a null vector, one that has a
null or non-finite part and one without length is a class of its own without
links; vectors of different widths are never paired; vectors are compared by
direction, so they needn't be of unit length; repeated rows add nothing, and no id
is paired with itself; an id with different vectors is one row, whose links and
copies are added up, and its pairs are given once, at the largest cosine; a pair
exactly at the threshold is found; with no rows there is no result; other columns
are dropped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, hang
from .session import beside, cut

THRESHOLD, ALPHA, BLOCKS, CODES, TURNS, SEED, TILE = 0.9, 0.4, 2, 48, 16, 5, 1024
WIDTH = 64
#: Numbers of vectors that are joined in one call.
BUCKET_VALUES = 2 << 20


def _caps(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles from 0 to pi, and the share of the sphere within each of them."""
    angles = np.linspace(0, np.pi, 20001)
    ring = np.sin(angles) ** (width - 2)
    share = np.concatenate(([0], np.cumsum(ring[1:] + ring[:-1])))
    return angles, share / share[-1]


def alpha_of(width: int) -> float:
    """The alpha that gives vectors of ``width`` about as many filters as ``ALPHA`` gives those of ``WIDTH``, and no larger than it."""
    if width <= WIDTH:
        return ALPHA
    angles, share = _caps(WIDTH)
    wanted = np.interp(np.arccos(ALPHA), angles, share)
    angles, share = _caps(width)
    return float(np.cos(np.interp(wanted, share, angles)))


def codes_of(width: int, turns: int = TURNS, blocks: int = BLOCKS) -> int:
    """Codewords of a block; fewer for narrow vectors, of which a cap holds more, so that they have about as many filters as those of ``WIDTH``."""
    if width >= WIDTH:
        return CODES
    angles, share = _caps(WIDTH)
    wanted = np.interp(np.arccos(ALPHA), angles, share) * CODES**blocks
    angles, share = _caps(max(width, 2))
    return max(2, round((wanted / np.interp(np.arccos(ALPHA), angles, share)) ** (1 / blocks)))


class Code:
    """The product codes of one width."""

    def __init__(self, width: int, alpha: float | None = None, blocks: int = BLOCKS, codes: int | None = None, turns: int = TURNS, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64([seed, width]))
        codes = codes_of(width, turns, blocks) if codes is None else codes
        self.blocks, self.codes, self.alpha, self.turns = blocks, codes, alpha_of(width) if alpha is None else alpha, []
        padded = -(-width // blocks) * blocks
        for _ in range(turns):
            turn, _ = np.linalg.qr(rng.standard_normal((padded, padded)))
            words = rng.standard_normal((blocks, codes, padded // blocks))
            words /= np.linalg.norm(words, axis=2, keepdims=True) * np.sqrt(blocks)
            # inner products with all codewords of all blocks are one product with this
            self.turns.append(np.concatenate([turn[:width, b * (padded // blocks) : (b + 1) * (padded // blocks)] @ words[b].T for b in range(blocks)], axis=1))

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and filters of unit vectors, by row and then filter."""
        rows, numbers = [], []
        for k, turn in enumerate(self.turns):
            gain = (vectors @ turn).reshape(len(vectors), self.blocks, self.codes)
            rest = np.zeros((len(vectors), self.blocks + 1))
            rest[:, :-1] = np.cumsum(gain.max(axis=2)[:, ::-1], axis=1)[:, ::-1]
            row = np.flatnonzero(rest[:, 0] >= self.alpha)
            total, number = np.zeros(len(row)), np.full(len(row), k, dtype=np.int64)
            for b in range(self.blocks):
                sums = total[:, None] + gain[row, b]
                at, code = np.nonzero(sums >= self.alpha - rest[row, b + 1][:, None])
                row, total, number = row[at], sums[at, code], number[at] * self.codes + code
            rows.append(row)
            numbers.append(number)
        row, number = np.concatenate(rows), np.concatenate(numbers)
        order = np.lexsort((number, row))
        return row[order], number[order]


@functools.lru_cache(maxsize=4)
def _code(*parameters) -> Code:
    """Kept by a worker, as the rotations of wide vectors take a while."""
    return Code(*parameters)


def _unit(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows of this width."""
    lists = batch.column(1)
    keep = np.flatnonzero(np.array(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)) == width)
    kept = lists.take(pa.array(keep))
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keep), width)
    size = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return keep[good], flat[good] / size[good, None]


def _sets(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (id, key, key2, vector); head and members of each set of equal vectors that can be compared; and the rows that are compared."""
    named = df.select(df[id_col].cast("bigint").alias("id"), df[vector_col].cast("array<float>").alias("vector")).where("id is not null")
    # equal parts have equal digests; 0.0 and -0.0 are told apart, but are found to be close
    rows = named.withColumn("key", F.xxhash64("vector")).withColumn("key2", F.xxhash64("vector", F.lit(1)))
    sound = F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vector is not null").where(F.coalesce(sound, F.lit(False)))
    sets = cut(rows.select("id", "key", "key2").distinct())
    heads = sets.groupBy("key", "key2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("members"))
    copies = cut(sets.join(heads.where("members > 1"), ["key", "key2"]).where("id <> head").select("id", "key"))
    compared = rows.join(beside(copies, copies.count(), 32), ["id", "key"], "left_anti") if copies.take(1) else rows
    return named, sets.join(heads, ["key", "key2"]), compared


def _grouped(rows: DataFrame, alpha: float | None, blocks: int, codes: int | None, turns: int, seed: int, tile: int) -> DataFrame:
    """The compared vectors in each of their filters and pairs of tiles."""
    counted = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    widths = counted.where("width > 0").collect()  # a row a width
    many, widest = {r.width for r in widths if r.n > r.width}, max((r.width for r in widths), default=1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                for width in part.column(1).value_lengths().unique().to_pylist():
                    places, unit = _unit(part, width) if width else ((), ())
                    if not len(places):
                        continue
                    if width in many:
                        row, number = _code(width, alpha, blocks, codes, turns, seed).decode(unit)
                    else:
                        row, number = np.arange(len(places)), np.zeros(len(places), dtype=np.int64)
                    if not len(row):
                        continue
                    number = number + width * turns * (codes or CODES) ** blocks
                    at = pa.array(places[row])
                    # the smaller filters of the same vector, to know where a pair counts
                    own = np.searchsorted(row, row)
                    before = np.arange(len(row)) - own
                    ends = np.cumsum(before)
                    flat = number[np.repeat(own, before) + np.arange(ends[-1]) - np.repeat(ends - before, before)]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(number), part.column(0).take(at), part.column(2).take(at), lists, part.column(1).take(at)], names=["filter", "id", "key", "filters", "vector"])

    members = rows.select("id", "vector", "key").mapInArrow(spread, "filter bigint, id bigint, key bigint, filters array<bigint>, vector array<float>")
    # only (filter, id) is counted, so that the sizes of filters cost no shuffle of vectors
    sizes = cut(members.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile)))
    filters, moved = sizes.agg(F.count(F.lit(1)), F.sum(F.col("n") * F.col("tiles"))).first()
    # several filters share a bucket, as most are small: a task calls Python once a bucket
    buckets = max(-(-(moved or 0) * widest // BUCKET_VALUES), min(filters, rows.sparkSession.sparkContext.defaultParallelism), 1)
    placed = members.join(beside(sizes.select("filter", "tiles"), filters, 40), "filter").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    other = F.explode(F.expr("sequence(0L, tiles - 1)"))
    spread_out = placed.withColumn("other", other).select("filter", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "id", "key", "filters", "vector")
    return spread_out.withColumn("bucket", F.pmod(F.xxhash64("filter", "low", "high"), F.lit(buckets)))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, alpha: float | None = None, blocks: int = BLOCKS, codes: int | None = None, turns: int = TURNS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """``id_col``, class_id, links and copies of each vector (see the module's text)."""
    named, sets, compared = _sets(df, id_col, vector_col)
    grouped = _grouped(compared, alpha, blocks, codes, turns, seed, tile)
    near = cut(grouped.groupBy("bucket").applyInArrow(lambda t: links_of_tiles(t, threshold), "id bigint, key bigint, links bigint, root bigint"))
    linked = near.groupBy("id", "key").agg(F.sum("links").alias("links")).withColumnRenamed("id", "head")
    edges = near.select(F.col("id").alias("a"), F.col("root").alias("b")).union(sets.where("id <> head").select("id", "head"))
    found = sets.join(linked, ["head", "key"], "left").groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0))).alias("links"), F.sum(F.col("members") - 1).alias("copies"))
    # rows without a vector that can be compared, too
    found = named.select("id").distinct().join(found, "id", "left").join(components(edges, "a", "b").withColumnRenamed("node", "id"), "id", "left")
    none = F.lit(0).cast("bigint")
    return found.select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("class_id"), F.coalesce("links", none).alias("links"), F.coalesce("copies", none).alias("copies"))


def near_pairs(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, alpha: float | None = None, blocks: int = BLOCKS, codes: int | None = None, turns: int = TURNS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """vec_a < vec_b and cosine (six decimals) of the pairs found (see the module's text)."""
    _, sets, compared = _sets(df, id_col, vector_col)
    grouped = _grouped(compared, alpha, blocks, codes, turns, seed, tile)
    found = grouped.groupBy("bucket").applyInArrow(lambda t: pairs_of_tiles(t, threshold), "vec_a bigint, vec_b bigint, cosine double")
    equal = sets.where("id <> head").select(F.col("head").alias("vec_a"), F.col("id").alias("vec_b"), F.lit(1.0).alias("cosine"))
    # different ids have one row a pair already, unless an id has several vectors
    return found.union(equal).groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))


def _close(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows x, y and cosine of the close pairs of each filter and pair of tiles, and whether the filter is the smallest of both."""
    number, low, high, tile, ids, keys = (table.column(c).to_numpy() for c in ("filter", "low", "high", "tile", "id", "key"))
    order = np.lexsort((keys, ids, tile, high, low, number))
    columns = [c[order] for c in (number, low, high, tile, ids, keys)]
    fresh = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    order = order[np.concatenate(([True], fresh))]  # without repeated rows
    number, low, high, tile = (c[order] for c in (number, low, high, tile))
    lists = table.column("vector").combine_chunks()
    starts, width = lists.offsets.to_numpy()[:-1][order] - lists.offsets[0].as_py(), lists.value_lengths().to_numpy(zero_copy_only=False)[order]
    values = lists.flatten().to_numpy(zero_copy_only=False)
    group = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
    edges = [*group.tolist(), len(order)]
    # a filter's vectors are of one width, and wider filters come later
    by_width = np.flatnonzero(np.concatenate(([True], width[1:] != width[:-1]))).tolist()
    base, units = 0, None
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(edges[:-1], edges[1:]):
        if by_width and a == by_width[0]:
            by_width.pop(0)
            stop = by_width[0] if by_width else len(order)
            base, units = a, values[starts[a:stop][:, None] + np.arange(width[a])].astype(np.float64)
            units /= np.linalg.norm(units, axis=1)[:, None]
        same = low[a] == high[a]
        middle = b if same else a + int(np.searchsorted(tile[a:b], high[a]))
        for x in range(a, middle, 256):
            end = min(x + 256, middle)
            from_y = x if same else middle
            close = units[x - base : end - base] @ units[from_y - base : b - base].T
            i, j = np.nonzero(close >= threshold - 1e-9)
            if same:
                once = i < j
                i, j = i[once], j[once]
            if len(i):
                hits.append((i + x, j + from_y, close[i, j]))
    if not hits:
        return
    x, y, cosine = (np.concatenate(h) for h in zip(*hits))
    x, y = order[x], order[y]
    apart = ids[x] != ids[y]
    x, y, cosine = x[apart], y[apart], cosine[apart]
    smaller_of = table.column("filters").combine_chunks()
    size, at = smaller_of.value_lengths().to_numpy(zero_copy_only=False), smaller_of.offsets.to_numpy() - smaller_of.offsets[0].as_py()
    flat = smaller_of.flatten().to_numpy(zero_copy_only=False)
    for k in range(0, len(x), 4096):
        p, q = x[k : k + 4096], y[k : k + 4096]
        padded = []
        for rows, none in ((p, -1), (q, -2)):
            wide = np.arange(max(1, int(size[rows].max())))
            there = wide < size[rows][:, None]
            out = np.full(there.shape, none, dtype=np.int64)
            out[there] = flat[(at[rows][:, None] + wide)[there]]
            padded.append(out)
        first = ~(padded[0][:, :, None] == padded[1][:, None, :]).any(axis=(1, 2))
        yield p, q, cosine[k : k + 4096], first


def links_of_tiles(table: pa.Table, threshold: float) -> pa.Table:
    """The vectors that are close to others here: how many whose smallest common filter is here, and the smallest id that they lead to."""
    pairs = np.column_stack((table.column("id").to_numpy(), table.column("key").to_numpy()))
    items, item = np.unique(pairs, axis=0, return_inverse=True)
    item, ids = item.ravel(), items[:, 0]
    links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for x, y, _, first in _close(table, threshold):
        np.add.at(links, item[x[first]], 1)
        np.add.at(links, item[y[first]], 1)
        hang(parent, item[x], item[y])
    root = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(root, parent, ids)
    root = root[parent]
    kept = np.flatnonzero((links > 0) | (root != ids))
    return pa.table([pa.array(x[kept]) for x in (ids, items[:, 1], links, root)], names=["id", "key", "links", "root"])


def pairs_of_tiles(table: pa.Table, threshold: float) -> pa.Table:
    """The close pairs whose smallest common filter is here."""
    ids = table.column("id").to_numpy()
    out: dict[tuple[int, int], float] = {}
    for x, y, cosine, first in _close(table, threshold):
        a, b = ids[x[first]], ids[y[first]]
        for key, c in zip(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()), np.round(cosine[first], 6).tolist()):
            out[key] = max(out.get(key, -2.0), c)
    keys = list(out)
    return pa.table([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([out[k] for k in keys], pa.float64())], names=["vec_a", "vec_b", "cosine"])


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """All pairs, by brute force."""
    return f"""
WITH RECURSIVE heads AS (SELECT min(vec_id) AS head, count(*) - 1 AS copies, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY embedding),
e AS (SELECT head, v::DOUBLE[] AS e FROM heads),
near AS (SELECT a.head AS a, b.head AS b FROM e a JOIN e b ON a.head < b.head AND list_cosine_similarity(a.e, b.e) >= {threshold} - 1e-9),
edge AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT head AS node, head AS root FROM heads UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node WHERE e.b > r.root),
class AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS links FROM edge GROUP BY a)
SELECT d.vec_id, coalesce(c.class_id, d.vec_id) AS class_id, coalesce(g.links, 0) AS links, coalesce(h.copies, 0) AS copies
FROM embeddings d LEFT JOIN heads h ON h.v = d.embedding LEFT JOIN class c ON c.node = h.head LEFT JOIN degree g ON g.a = h.head"""
