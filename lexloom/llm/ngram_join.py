"""N-gram Jaccard join: an exact metric-space join of texts under Jaccard distance.

A text is its set of word n-grams, and 1 - J is a metric on such sets.  The join
finds every pair with J >= threshold, that is, within eps = 1 - threshold.

Equal sets (distance 0) are one point from the start, found by two 64-bit sums over
their n-grams; leading digits of the first name the point (sets that happen to get
one name are compared at the end), so no text is looked up or moved before
candidates are known.

Regions.  At the scale of a corpus nearly all distances to any pivot are exactly
1, where the triangle inequality says nothing; what it does say is that a point
within eps of x shares at least ceil(t |x|) n-grams with x.  So the first
partition is by anchors: in any order of all n-grams, among the first
|x| - ceil(t |x|) + l of x and of y at least l = min(l_x, l_y) are common, where
l_x = 1 + |x| / L_SHARE.  Anchors are shuffled as sorted, delta-coded runs, many
texts to a row; pairs of fitting sizes that share an anchor are counted (and
shuffled as runs, too), and those that reach l are candidates.  The order is by hash, but n-grams that many
texts have (as in passages that documents repeat) come last, so crowds hardly
meet; which these are is read from mergeable counts, and affects speed alone.
Where more than CROWDED points share an anchor all the same, they are linked in stars
instead of pairs, so a crowd gives as many rows as it has points.
Candidates are linked to regions: points of different regions are more than eps
apart, so each point is in one region only.  A region of more than REGION_GRAMS
n-grams is dealt into tiles of about so many, and each pair of tiles is joined on
its own.

In a region points join exactly: pivots (farthest first) split them into Voronoi
cells, each cell takes in the boundary points y of other cells with
d(y, p_i) <= r_i + eps and d(y, p_i) <= d(y, p_own) + 2 eps (the triangle
inequality's windows), and cells are split again until they are small or don't
shrink, when the overlaps are counted.

Result of ``ngram_join``: one row for each document: class_id, the smallest id of its
class (documents that are linked by pairs, directly or through others); links, the
number of different sets that its own is near to; and copies, the number of other
documents of an equal set.  Each group of a region is joined and counted where it
is: only its points' numbers of links and local classes leave it, never its pairs.
``ngram_pairs`` lists pairs instead, doc_a < doc_b and jaccard: texts of equal sets are
given by a star, the smallest id of the set with each other id, at 1.0; two
different sets by one row of their smallest ids.

Defined cases: rows with a null id are left out; null and empty texts, and texts
without words, have no n-grams, so they are classes of their own without links; a
text of fewer than n words has one n-gram, all its words; a repeated row adds
nothing; rows of one id with different texts are one document, whose links and
copies are added up, but no id is paired with itself; texts are read whole; other
columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components, hang
from .session import BROADCAST_BYTES, beside, cut

N, THRESHOLD_PERCENT = 3, 60
#: One more common anchor is asked for every L_SHARE n-grams.
L_SHARE = 16
#: n-grams counted at once, the count in one run that is passed on, and anchors packed at once.
COUNT_GRAMS, RUN_COUNT, RUN_GRAMS = 4_000_000, 3, 1_500_000
#: n-grams that so many texts have come last in the order; at most LATE_GRAMS of them, the most frequent.
CROWD, LATE_GRAMS = 16, 2_000_000
#: Anchors of one group of the count, and n-grams of one region.
BUCKET_ANCHORS, REGION_GRAMS = 1_000_000, 1_000_000
#: Bytes of the table of points in regions that is sent to every executor; beyond, texts are joined with it.
PLACED_BYTES = 64 << 20
#: Points that share an anchor and are linked in a star instead of pairs, if there are more.
CROWDED = 256
#: Points of a region beyond which pivots part it, and points whose overlaps are counted at once.
LEAF, BLOCK = 64, 256
#: Counts for an anchor that decides alone.
_ENOUGH = 1 << 30

#: Bytes of sets in one Arrow batch.
BATCH_BYTES = 4 << 20

_U = np.uint64


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    grams, offs = tk.Words(column).grams(n)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        s = np.sort(grams[a:b])
        yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def need(size):
    """Common anchors that a text of ``size`` n-grams asks for."""
    return 1 + size // L_SHARE


def prefix_size(size: int, threshold_percent: int) -> int:
    return min(size, size + threshold_percent * -size // 100 + need(size)) if size else 0


def signature(grams: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        x = tk.mix(grams)
        return int(x.sum(dtype=_U).astype(np.int64)), int(tk.mix(grams ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).astype(np.int64))


def point_of(signed: int, digits: int) -> int:
    return (signed & (2**64 - 1)) >> (64 - digits)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, by planes of equal bytes, compressed."""
    planes = values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(data.slice(0, 8).to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(data.slice(8), 8 * n, "zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """id, s1, s2, size of each text with n-grams; besides, rows with a null id and a run's frequent n-grams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "s1", "s2", "size", "grams", "counts"]
        kept: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        held = 0

        def counted() -> pa.RecordBatch:
            grams = np.concatenate(kept)
            kept.clear()
            grams.sort()
            first = np.flatnonzero(grams[1:] != grams[:-1])
            first = np.concatenate(([0], first + 1))
            counts = np.diff(np.append(first, len(grams)))
            often = counts >= RUN_COUNT
            found = grams[first[often]].tobytes(), counts[often].astype(np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 4 + [pa.array([x], pa.binary()) for x in found], names=names)

        for batch in batches:
            for part in tk.slices(batch, "text"):
                ids = part.column(0).to_pylist()
                rows = []
                for i, grams in zip(ids, sets_of(part.column(1), n)):
                    if len(grams):
                        key = signature(grams)
                        rows.append((i, *key, len(grams)))
                        if key not in seen:
                            seen.add(key)
                            kept.append(grams)
                            held += len(grams)
                if rows:
                    none = pa.nulls(len(rows), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] + [none, none], names=names)
                if held >= COUNT_GRAMS:
                    yield counted()
                    seen.clear()
                    held = 0
        if kept:
            yield counted()

    return docs.mapInArrow(tk.tidy(run), "id bigint, s1 bigint, s2 bigint, size bigint, grams binary, counts binary")


def _late(signed: DataFrame) -> np.ndarray:
    """The n-grams that come last in the order, sorted."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(g, np.int64)), pa.array(np.frombuffer(c, np.int64))], names=["gram", "n"])

    counts = signed.where("id is null").select("grams", "counts").mapInArrow(tk.tidy(unfold), "gram bigint, n bigint")
    often = counts.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= CROWD).orderBy(F.desc("n"), "gram").limit(LATE_GRAMS).select("gram").toArrow()
    return np.sort(often.column(0).to_numpy().view(np.uint64))


def _is_in(grams: np.ndarray, members: np.ndarray) -> np.ndarray:
    if not len(members):
        return np.zeros(len(grams), bool)
    at = np.searchsorted(members, grams)
    at[at == len(members)] = 0
    return members[at] == grams


def _anchors(docs: DataFrame, n: int, threshold_percent: int, late, buckets: int, bits: int, digits: int) -> DataFrame:
    """Runs of anchors by bucket, those of a range of n-grams each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = late.value
        grams: list[np.ndarray] = []
        names: dict[int, int] = {}
        held = 0
        fine = min(bits, 30)
        bounds = np.array([-(-k * (1 << fine) // buckets) << (bits - fine) for k in range(buckets)] + [1 << bits], dtype=np.uint64)

        def runs() -> Iterator[pa.RecordBatch]:
            owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
            gram = np.concatenate(grams)
            grams.clear()
            order = np.argsort(gram)
            gram, owner = gram[order], owner[order]
            del order
            gram >>= _U(64 - bits)
            point = np.array([point_of(x, digits) for x in names], dtype=np.int64)
            size = np.array(list(names.values()), dtype=np.int64)
            names.clear()
            edges = np.searchsorted(gram, bounds).tolist()
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if a == b:
                    continue
                there, local = np.unique(owner[a:b], return_inverse=True)
                by = np.argsort(point[there])
                place = np.empty(len(by), dtype=np.int64)
                place[by] = np.arange(len(by))
                there = there[by]
                data = (np.diff(gram[a:b], prepend=_U(0)), place[local], np.diff(point[there], prepend=0), size[there])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())] + [pa.array([pack(x)], pa.binary()) for x in data], names=["bucket", "grams", "owners", "points", "sizes"])

        for batch in batches:
            for part in tk.slices(batch, "text"):
                for own in sets_of(part.column(1), n):
                    if not len(own):
                        continue
                    name = signature(own)[0]
                    if name in names:
                        continue
                    names[name] = len(own)
                    last = _is_in(own, members)
                    k = prefix_size(len(own), threshold_percent)
                    # copies, so that the whole sets can go
                    grams.append(own[np.argsort(last, kind="stable")[:k]] if last.any() else own[:k].copy())
                    held += k
                if held >= RUN_GRAMS:
                    yield from runs()
                    held = 0
        if held:
            yield from runs()

    return docs.mapInArrow(tk.tidy(run), "bucket int, grams binary, owners binary, points binary, sizes binary")


_PAIRS = "bucket int, a binary, b binary, c binary, need binary"


def count_pairs(table: pa.Table, threshold_percent: int, buckets: int, digits: int) -> pa.Table:
    """Runs of a < b, the anchors of this bucket that they share and how many they need in all, by ranges of a."""
    gram, point, size = [], [], []
    for k in range(table.num_rows):
        g, o, p, s = (unpack(table.column(c)[k].as_buffer()) for c in ("grams", "owners", "points", "sizes"))
        gram.append(np.cumsum(g, dtype=np.uint64))
        point.append(np.cumsum(p, dtype=np.uint64).astype(np.int64)[o.astype(np.int64)])
        size.append(s.astype(np.int32)[o.astype(np.int64)])
    gram, point, size = np.concatenate(gram), np.concatenate(point), np.concatenate(size)
    order = np.argsort(gram)
    ranked = gram[order]
    shared = np.zeros(len(gram), bool)
    same = ranked[1:] == ranked[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    del ranked
    order = order[np.lexsort((point[order], size[order], gram[order]))]
    gram, point, size = gram[order], point[order], size[order]
    fresh = np.ones(len(gram), bool)  # a repeated row gives its anchors again
    fresh[1:] = (gram[1:] != gram[:-1]) | (point[1:] != point[:-1])
    gram, point, size = gram[fresh], point[fresh], size[fresh]
    kept = [(np.zeros(0, np.int64),) * 4]
    held, step = 0, 1
    at = np.arange(len(gram))
    if len(gram):
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        many = np.repeat(np.diff(np.append(first, len(gram))), np.diff(np.append(first, len(gram)))) > CROWDED
        if many.any():
            # runs of fitting sizes within a gram: pairs that fit are in one run, as sizes are in order
            breaks = np.concatenate(([True], (gram[1:] != gram[:-1]) | (size[:-1].astype(np.int64) * 100 < threshold_percent * size[1:].astype(np.int64))))
            head = np.flatnonzero(breaks)[np.cumsum(breaks) - 1]
            linked = np.flatnonzero(many & (point[head] != point))
            x, y = point[head[linked]], point[linked]
            kept.append((np.minimum(x, y), np.maximum(x, y), np.full(len(x), _ENOUGH), np.ones(len(x), np.int64)))
            at = at[~many]

    def merged() -> tuple[np.ndarray, ...]:
        a, b, c, m = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((b, a))
        a, b, c, m = a[order], b[order], c[order], m[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
        return a[first], b[first], np.add.reduceat(c, first) if len(a) else c, m[first]

    while True:
        # by size within a gram: once a step is too far for the size, so are longer ones
        at = at[at + step < len(gram)]
        at = at[(gram[at] == gram[at + step]) & (size[at] * 100 >= threshold_percent * size[at + step])]
        if not len(at):
            break
        x, y = point[at], point[at + step]
        kept.append((np.minimum(x, y), np.maximum(x, y), np.ones(len(at), np.int64), size[at].astype(np.int64)))
        held += len(at)
        step += 1
        if held > 4_000_000:
            kept = [merged()]
            held = 0
    a, b, c, m = merged()
    edges = np.searchsorted(a, [-(-k * (1 << digits) // buckets) for k in range(buckets)] + [1 << digits]).tolist()
    rows = [(k, pack(np.diff(a[x:y], prepend=0)), pack(b[x:y]), pack(c[x:y]), pack(need(m[x:y]))) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if x < y]
    cols = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "a", "b", "c", "need"])


def sum_pairs(table: pa.Table) -> pa.Table:
    """a, b of the pairs whose counts from all buckets reach what they need."""
    a, b, c, m = ([unpack(table.column(x)[k].as_buffer()).astype(np.int64) for k in range(table.num_rows)] for x in ("a", "b", "c", "need"))
    a, b, c, m = np.concatenate([np.cumsum(x) for x in a]), np.concatenate(b), np.concatenate(c), np.concatenate(m)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    enough = np.add.reduceat(c[order], first) >= np.minimum.reduceat(m[order], first)
    return pa.table([pa.array(a[first][enough]), pa.array(b[first][enough])], names=["a", "b"])


def _bucket(function):
    """A function of one large group, then ``release``."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            if table.nbytes > 1 << 20:
                tk.release()

    return run


def _parted(docs: DataFrame, n: int, threshold_percent: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """The texts' signatures, the smallest id of each set, the members of all regions, and whether a region has several tiles."""
    spark = docs.sparkSession
    signed = cut(_signed(docs.where("text is not null"), n))
    ids = signed.where("id is not null").select("id", "s1", "s2", "size")
    heads = cut(ids.groupBy("s1", "s2").agg(F.min("id").alias("head"), F.max("size").alias("size")))
    count, grams = heads.agg(F.count(F.lit(1)), F.sum("size")).first()
    grams = grams or 0
    digits = min(62, max(20, count.bit_length() + 10))
    named = heads.select(F.shiftrightunsigned("s1", 64 - digits).alias("point"), "head", "size")
    late = spark.sparkContext.broadcast(_late(signed))
    anchors = max(1, (100 - threshold_percent) * grams // 100 + grams // L_SHARE)
    buckets = max(spark.sparkContext.defaultParallelism, -(-anchors // BUCKET_ANCHORS))
    bits = min(63, max(31, anchors.bit_length() + 10))
    runs = _anchors(docs, n, threshold_percent, late, buckets, bits, digits)
    pairs = runs.groupBy("bucket").applyInArrow(_bucket(lambda t: count_pairs(t, threshold_percent, buckets, digits)), _PAIRS)
    candidates = cut(pairs.groupBy("bucket").applyInArrow(_bucket(sum_pairs), "a bigint, b bigint"))
    placed = cut(_regions(candidates, named.groupBy("point").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("sets"))))
    tiled = placed.where("tiles > 0").limit(1).count() > 0
    return ids, heads, _members(docs.where("text is not null"), placed, named, n, digits), tiled


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("bigint").alias("id"), df[text_col].cast("string").alias("text")).where("id is not null")


def ngram_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_a, doc_b, jaccard (see the module's text); near copies of one text are as many pairs as they are."""
    ids, heads, members, _ = _parted(_documents(df, id_col, text_col), n, threshold_percent)
    equal = ids.join(heads.drop("size"), ["s1", "s2"]).where("id <> head").select(F.col("head").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard")).distinct()
    near = members.groupBy("region", "part").applyInArrow(_bucket(lambda t: pairs_of_region(t, threshold_percent)), "doc_a bigint, doc_b bigint, jaccard double")
    return equal.union(near)


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``id_col``, class_id, links and copies of each document (see the module's text)."""
    docs = _documents(df, id_col, text_col)
    ids, heads, members, tiled = _parted(docs, n, threshold_percent)
    near = cut(members.groupBy("region", "part").applyInArrow(_bucket(lambda t: links_of_region(t, threshold_percent)), "s1 bigint, s2 bigint, head bigint, links bigint, root bigint"))
    linked = near.groupBy("s1", "s2").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    sets = cut(ids.select("id", "s1", "s2").distinct())
    sized = sets.groupBy("s1", "s2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("members"))
    found = sets.join(sized, ["s1", "s2"]).join(linked, ["s1", "s2"], "left")
    found = found.select("id", "head", F.coalesce("root", "head").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), (F.col("members") - 1).alias("copies"))
    several = sets.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count() > 0
    if tiled or several:
        # classes go on through tiles and through documents of several texts
        edges = near.select(F.col("head").alias("a"), F.col("root").alias("b")).union(found.where("id <> head").select("id", "head"))
        of = components(edges, "a", "b")
        found = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
        found = found.join(of, found.id == of.node, "left").select("id", F.coalesce("root", "id").alias("class_id"), "links", "copies")
    wordless = docs.select("id").distinct().join(sets.select("id").distinct(), "id", "left_anti")
    rest = wordless.select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links"), F.lit(0).cast("bigint").alias("copies"))
    return found.select("id", "class_id", "links", "copies").union(rest).withColumnRenamed("id", id_col)


_MEMBER = "region bigint, part bigint, tile int, point bigint, id bigint, grams binary"
_TILE = 20


def _member_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Of rows (region, tiles, point, id, grams)."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ["region", "part", "tile", "point", "id", "grams"]
    held: list[tuple] = []
    size = 0
    for region, tiles, point, i, grams in rows:
        held.append((region, tiles & ((1 << 2 * _TILE) - 1), tiles >> 2 * _TILE, point, i, grams))
        size += len(grams)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _members(docs: DataFrame, placed: DataFrame, named: DataFrame, n: int, digits: int) -> DataFrame:
    """The sets of all points in regions, with the regions; texts of no region stay where they are."""
    count = placed.count()
    if count * 24 <= PLACED_BYTES:
        table = placed.orderBy("point").toArrow()
        columns = tuple(table.column(c).to_numpy() for c in ("point", "region", "tiles"))
        there = docs.sparkSession.sparkContext.broadcast(columns)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points, regions, tiles = there.value

            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for part in tk.slices(batch, "text"):
                        for i, own in zip(part.column(0).to_pylist(), sets_of(part.column(1), n)):
                            if len(own):
                                point = point_of(signature(own)[0], digits)
                                a, b = np.searchsorted(points, [point, point + 1])
                                for k in range(a, b):
                                    yield int(regions[k]), int(tiles[k]), point, i, own.tobytes()

            yield from _member_batches(rows())

        only = named.join(placed, "point", "left_semi").select(F.col("head").alias("id")).distinct()
        wanted = only.count()
        if wanted * 16 <= BROADCAST_BYTES:
            docs = docs.join(F.broadcast(only), "id", "left_semi")
        return docs.mapInArrow(tk.tidy(look_up), _MEMBER)
    by_point = placed.groupBy("point").agg(F.collect_list(F.struct("region", "tiles")).alias("regions"))
    listed = by_point.join(named.select("point", F.col("head").alias("id")).distinct(), "point")
    wanted = listed.groupBy("id").agg(F.collect_list(F.struct("point", "regions")).alias("points"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part in tk.slices(batch, "text"):
                    for i, points, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets_of(part.column(1), n)):
                        point = point_of(signature(own)[0], digits) if len(own) else None
                        for r in (r for p in points if p["point"] == point for r in p["regions"]):
                            yield r["region"], r["tiles"], point, i, own.tobytes()

        yield from _member_batches(rows())

    return docs.join(wanted.hint("shuffle_hash"), "id").select("id", "text", "points").mapInArrow(tk.tidy(spread), _MEMBER)


def _regions(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """point, region, tiles: the point's tile and a pair of tiles that is joined (one for each other tile)."""
    of = components(candidates, "a", "b")
    # sets of one name that are in no region yet are compared to each other
    alone = sizes.where("sets > 1").join(of, sizes.point == of.node, "left_anti").select(F.col("point").alias("node"), F.col("point").alias("root"))
    sized = of.union(alone).join(sizes.select(F.col("point").alias("node"), "size"), "node")
    weights = sized.groupBy("root").agg(F.ceil(F.sum("size") / REGION_GRAMS).alias("count"))
    dealt = sized.join(weights, "root").select("node", "root", "count", F.pmod(F.xxhash64("node"), F.col("count")).alias("tile"))
    pairs = dealt.select("node", "root", "tile", F.explode(F.expr("sequence(0L, count - 1)")).alias("other"))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    return pairs.select(F.col("node").alias("point"), F.col("root").alias("region"), (F.shiftleft("tile", 2 * _TILE) + F.shiftleft(low, _TILE) + high).alias("tiles"))


def _region(table: pa.Table, threshold_percent: int, listed: bool) -> tuple[Cells, list[tuple[int, int]], np.ndarray]:
    """The joined sets of a region's part, their signatures and the smallest ids."""
    low, high = divmod(table.column("part")[0].as_py(), 1 << _TILE)
    sets, heads, tiles = [], [], []
    at: dict[tuple[int, int], int] = {}
    for row, (tile, i) in enumerate(zip(table.column("tile").to_pylist(), table.column("id").to_pylist())):
        own = np.frombuffer(table.column("grams")[row].as_buffer(), dtype=np.uint64)
        k = at.setdefault(signature(own), len(sets))
        if k == len(sets):
            sets.append(own)
            heads.append(i)
            tiles.append(tile)
        heads[k] = min(heads[k], i)
    cells = Cells(sets, threshold_percent, np.array(heads, dtype=np.int64), listed)
    if low == high:
        cells.pairs()
    else:
        tile = np.array(tiles)
        cells._report(np.flatnonzero(tile == low), np.flatnonzero(tile == high), False)
    return cells, list(at), cells.heads


def pairs_of_region(table: pa.Table, threshold_percent: int) -> pa.Table:
    cells, _, heads = _region(table, threshold_percent, True)
    rows = [(min(heads[a], heads[b]), max(heads[a], heads[b]), j) for a, b, j in cells.found]
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["doc_a", "doc_b", "jaccard"])


def links_of_region(table: pa.Table, threshold_percent: int) -> pa.Table:
    """The sets that have links here: how many, and the smallest id that they lead to."""
    cells, keys, heads = _region(table, threshold_percent, False)
    linked = np.flatnonzero(cells.links)
    root = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(root, cells.parent, heads)
    s1, s2 = (np.array([k[c] for k in keys], dtype=np.int64)[linked] for c in (0, 1))
    return pa.table([pa.array(x) for x in (s1, s2, heads[linked], cells.links[linked], root[cells.parent[linked]])], names=["s1", "s2", "head", "links", "root"])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``df``, all columns, without the documents that are in a class with one of a smaller id; of repeated rows (one id) all stay, and those with a null id."""
    classes = ngram_join(df, id_col, text_col, n, threshold_percent)
    of = cut(classes.where(F.col(id_col) > F.col("class_id")).select(F.col(id_col).alias("node")))
    return df.join(beside(of, of.count(), 16), df[id_col].cast("bigint") == of["node"], "left_anti")


class Cells:
    """The exact self-join of some different sets, by recursive Voronoi cells and windows."""

    def __init__(self, sets: list[np.ndarray], threshold_percent: int, heads: np.ndarray | None = None, listed: bool = True):
        self.t, self.eps = threshold_percent, 1 - threshold_percent / 100 + 1e-9
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.size)
        shared = count[back] > 1
        number = np.cumsum(count > 1) - 1
        cell, owner = number[back[shared]], owner[shared]
        self.offs = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sets)))))
        self.cell = cell
        self.heads = np.arange(len(sets)) if heads is None else heads
        #: Pairs if they are listed; the links of each set and a set of its class if not.
        self.listed, self.found = listed, []
        self.links, self.parent = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets))
        self.parted = 0

    def pairs(self) -> list[tuple[int, int, float]]:
        self._join(np.arange(len(self.size)))
        return self.found

    def _overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common n-grams of each of a with each of b, by products of incidence blocks."""
        rows_a, cells_a = self._incidence(a)
        rows_b, cells_b = self._incidence(b)
        both = np.intersect1d(cells_a, cells_b)
        out = np.zeros((len(a), len(b)), dtype=np.float32)
        for start in range(0, len(both), 4096):
            block = both[start : start + 4096]
            sides = []
            for rows, cells, n in ((rows_a, cells_a, len(a)), (rows_b, cells_b, len(b))):
                at = np.searchsorted(block, cells)
                at[at == len(block)] = 0
                ok = block[at] == cells
                m = np.zeros((n, len(block)), dtype=np.float32)
                m[rows[ok], at[ok]] = 1
                sides.append(m)
            out += sides[0] @ sides[1].T
        return out.astype(np.int64)

    def _incidence(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.offs[a + 1] - self.offs[a]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offs[a], n)
        return np.repeat(np.arange(len(a)), n), self.cell[at]

    def _report(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for i in range(0, len(a), BLOCK):
            for j in range(i if same else 0, len(b), BLOCK):
                x, y = a[i : i + BLOCK], b[j : j + BLOCK]
                common = self._overlap(x, y)
                union = self.size[x][:, None] + self.size[y][None, :] - common
                hit = common * 100 >= self.t * union
                if same and i == j:
                    hit &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
                hit &= self.heads[x][:, None] != self.heads[y][None, :]
                p, q = np.nonzero(hit)
                if self.listed:
                    self.found += zip(x[p].tolist(), y[q].tolist(), (common[p, q] / union[p, q]).tolist())
                elif len(p):
                    self.links[x] += hit.sum(axis=1)
                    self.links[y] += hit.sum(axis=0)
                    hang(self.parent, x[p], y[q])

    def _distance(self, a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        common = self._overlap(a, pivots)
        return 1 - common / (self.size[a][:, None] + self.size[pivots][None, :] - common)

    def _join(self, members: np.ndarray) -> None:
        if len(members) < 2:
            return
        if len(members) <= LEAF:
            self._report(members, members, True)
            return
        chosen = [members[0]]
        far = self._distance(members, members[:1])
        while len(chosen) < 16 and far.min(axis=1).max() > 0:
            chosen.append(members[int(far.min(axis=1).argmax())])
            far = np.column_stack((far, self._distance(members, np.array(chosen[-1:]))))
        home = far.argmin(axis=1)
        nearest = far.min(axis=1)
        if np.bincount(home).max() > 0.9 * len(members):
            self._report(members, members, True)  # the pivots don't part these
            return
        self.parted += 1
        for i in range(far.shape[1]):
            core = home == i
            if not core.any():
                continue
            self._join(members[core])
            window = (home > i) & (far[:, i] <= nearest[core].max() + self.eps) & (far[:, i] <= nearest + 2 * self.eps)
            if window.any():
                self._report(members[core], members[window], False)


def oracle_sql(n: int = N, threshold_percent: int = THRESHOLD_PERCENT) -> str:
    gap = tk.WORD_GAP
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{gap}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END)) AS grams FROM w WHERE len(w) > 0),
heads AS (SELECT min(doc_id) AS head, count(*) - 1 AS copies, grams FROM s GROUP BY grams),
member AS (SELECT s.doc_id, h.head, h.copies FROM s JOIN heads h ON s.grams = h.grams),
g AS (SELECT head, len(grams) AS n, unnest(grams) AS gram FROM heads),
common AS (SELECT a.head AS doc_a, b.head AS doc_b, a.n AS na, b.n AS nb, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.head < b.head GROUP BY ALL),
near AS (SELECT doc_a, doc_b FROM common WHERE c * 100 >= {threshold_percent} * (na + nb - c)),
edge AS (SELECT doc_a AS a, doc_b AS b FROM near UNION SELECT doc_b, doc_a FROM near),
reach AS (SELECT head AS node, head AS root FROM heads UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node WHERE e.b > r.root),
class AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS links FROM edge GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(g.links, 0) AS links, coalesce(m.copies, 0) AS copies
FROM documents d LEFT JOIN member m USING (doc_id) LEFT JOIN class c ON c.node = m.head LEFT JOIN degree g ON g.a = m.head"""
