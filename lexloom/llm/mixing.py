"""Mixing sources to target weights by pivotal dependent rounding.

The size of a text is its characters.  A source of weight w gets the rate
w * budget / size, the mean number of copies of each of its texts, so that its
expected share of the mix is its weight; the budget is the size of the whole
corpus times ``scale``.  Without weights, a source's weight grows with the
power ``tempering`` of its size, which lifts small sources.

The whole part of a rate is copied for certain.  The fractional parts are
rounded dependently: two texts of parts a and b duel, and mass moves at random
from one to the other until one of them is 0 or 1 (with a + b < 1 the first
keeps a + b with chance a / (a + b); else the first becomes 1 with chance
(1 - b) / (2 - a - b)), so each text's expected copies are exactly its rate while
the number of copies of a source is its sum rounded down or up.  Mass is whole
numbers of 2**-40, so none is lost, and a duel's chance comes from a hash of the
two texts and ``seed``: the result doesn't depend on partitions or retries.

Duels are a reduction tree.  Texts are hashed to leaves of about ``leaf`` texts
of one source; each leaf is reduced to one undecided text, these by groups of
FAN_IN leaves to one again, up to one for each source; then the sources are
reduced likewise to the last, which alone is rounded on its own.  A level is one
shuffle of rows of a few numbers, FAN_IN times fewer than the level before.

Defined cases: a null source is a source of its own; null texts count as empty;
rows of one id in one source are one unit of their joint size, decided together
and listed once for each row; rows with a null id are units by their text; a
source without characters gets rate 1, as it adds nothing to any share; a source
that is missing in ``weights`` has weight 0 and no copies; with no rows there is
no result; texts are measured whole; other columns are kept or dropped as they
are, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import beside, cut, small

TEMPERING, LEAF, FAN_IN, SEED = 0.7, 4096, 64, 11
ONE = 1 << 40
_UNIT = "_mix_source string, _mix_unit bigint, mass bigint"


def _source(name: Column) -> Column:
    return F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), name.cast("string")))


def _unit(ident: Column, text: Column) -> Column:
    # a hash of null isn't null
    by_text = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.lit(1))
    return F.when(ident.cast("bigint").isNotNull(), F.xxhash64(ident.cast("bigint"))).otherwise(by_text)


def _mix_int(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def reduce_units(units: list[int], masses: list[int], seed: int = SEED) -> list[int]:
    """The masses after duels in order: all 0 or ONE but for at most one."""
    out = list(masses)
    order = sorted(range(len(units)), key=lambda k: (units[k] & 0xFFFFFFFFFFFFFFFF, masses[k]))
    held = -1
    for k in order:
        if out[k] in (0, ONE):
            continue
        if held < 0:
            held = k
            continue
        a, b = out[held], out[k]
        u = _mix_int((_mix_int(units[held] & 0xFFFFFFFFFFFFFFFF) + (units[k] & 0xFFFFFFFFFFFFFFFF) + seed) & 0xFFFFFFFFFFFFFFFF) >> 11
        total = a + b
        if total < ONE:
            first = u * total < (a << 53)
            out[held], out[k] = (total, 0) if first else (0, total)
            held = held if first else k
        else:
            first = u * (2 * ONE - total) < ((ONE - b) << 53)
            out[held], out[k] = (ONE, total - ONE) if first else (total - ONE, ONE)
            held = k if first else held
            if out[held] == 0:
                held = -1
        if held >= 0 and out[held] in (0, ONE):
            held = -1
    return out


def rates(units: DataFrame, weights: dict[str | None, float] | None, tempering: float, scale: float) -> DataFrame:
    """_mix_source, whole copies and mass (the fractional part) of each source's texts."""
    sizes = units.groupBy("_mix_source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(tempering))))
    else:
        rows = [("n" if k is None else f"s{k}", float(v)) for k, v in weights.items()]
        given = sizes.sparkSession.createDataFrame(rows, "_mix_source string, weight double")
        weighed = sizes.join(given, "_mix_source", "left").fillna(0.0, ["weight"])
    # decimals add up alike in any order, so a retried task sees the same rates
    weighed = cut(weighed.withColumn("weight", F.when(F.col("size") > 0, F.col("weight")).otherwise(0.0).cast("decimal(30,8)")))
    total = weighed.agg(F.sum("weight").alias("w"), F.sum("size").alias("s"))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("w") > 0, F.col("weight").cast("double") / F.col("w").cast("double") * F.col("s") * scale / F.col("size")).otherwise(0.0)
    whole = F.floor("rate")
    shares = weighed.crossJoin(F.broadcast(total)).withColumn("rate", rate)
    return shares.select("_mix_source", "texts", whole.alias("whole"), F.floor((F.col("rate") - whole) * ONE).alias("mass"))


def _level(rows: DataFrame, seed: int, last: bool = False) -> DataFrame:
    """The rows after the duels of each (node): at most one of a node stays undecided."""

    def run(table: pa.Table) -> pa.Table:
        units, masses = table.column("_mix_unit").to_pylist(), table.column("mass").to_pylist()
        out = reduce_units(units, masses, seed)
        if last:
            out = [m if m in (0, ONE) else ONE * ((_mix_int((u & 0xFFFFFFFFFFFFFFFF) ^ seed) >> 24) < m) for u, m in zip(units, out)]
        return table.select(["_mix_source", "_mix_unit"]).append_column("mass", pa.array(out, pa.int64()))

    return rows.groupBy("node").applyInArrow(run, _UNIT)


def decide(df: DataFrame, id_col: str, text_col: str, source_col: str, weights, tempering: float, scale: float, leaf: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rates (with whole) by source, and the units that get one copy more."""
    named = df.select(_source(df[source_col]).alias("_mix_source"), _unit(df[id_col], df[text_col]).alias("_mix_unit"), F.coalesce(F.length(df[text_col].cast("string")), F.lit(0)).alias("size"))
    units = cut(named.groupBy("_mix_source", "_mix_unit").agg(F.sum("size").alias("size")))
    by_source = cut(rates(units, weights, tempering, scale))
    sources, most = by_source.agg(F.count(F.lit(1)), F.max("texts")).first()
    depth = 0
    while leaf * FAN_IN**depth < (most or 0):
        depth += 1
    # leaves of each source: a power of FAN_IN that leaves about `leaf` texts in each
    leaves = sum((F.when(F.col("texts") > leaf * FAN_IN**k, FAN_IN**k * (FAN_IN - 1)).otherwise(0) for k in range(depth)), F.lit(1)).cast("bigint")
    share = small(by_source.withColumn("leaves", leaves), sources, 80)
    placed = units.join(share, "_mix_source").where("mass > 0")
    place = F.pmod(F.xxhash64("_mix_unit", F.lit(seed)), F.col("leaves"))
    rows = placed.select("_mix_source", "_mix_unit", "mass", place.alias("leaf"))
    won, undecided = [], (F.col("mass") > 0) & (F.col("mass") < ONE)
    level = cut(_level(rows.withColumn("node", F.struct("_mix_source", "leaf")), seed))
    won.append(level.where(F.col("mass") == ONE))
    sizes = [FAN_IN**k for k in range(depth)][::-1]
    for n in sizes:
        node = F.struct("_mix_source", F.pmod(F.xxhash64("_mix_unit", F.lit(seed)), F.lit(n)).alias("leaf"))
        level = cut(_level(level.where(undecided).withColumn("node", node), seed))
        won.append(level.where(F.col("mass") == ONE))
    top = 0
    while FAN_IN ** (top + 1) < (sources or 0):
        top += 1
    for k in range(top, -1, -1):
        node = F.struct(F.pmod(F.xxhash64("_mix_source", F.lit(seed)), F.lit(FAN_IN**k)).alias("leaf"))
        level = cut(_level(level.where(undecided).withColumn("node", node), seed, last=k == 0))
        won.append(level.where(F.col("mass") == ONE))
    extra = won[0]
    for more in won[1:]:
        extra = extra.union(more)
    return by_source.select("_mix_source", "whole"), extra.select("_mix_source", "_mix_unit", F.lit(1).cast("bigint").alias("_mix_more"))


def _copies(df: DataFrame, kept: list, id_col, text_col, source_col, weights, tempering, scale, leaf, seed) -> DataFrame:
    """row (a struct of ``kept``) and copies; the struct keeps names from clashing."""
    whole, extra = decide(df, id_col, text_col, source_col, weights, tempering, scale, leaf, seed)
    sources, more = whole.count(), extra.count()
    keyed = df.select(F.struct(*kept).alias("row"), _source(df[source_col]).alias("_mix_source"), _unit(df[id_col], df[text_col]).alias("_mix_unit"))
    joined = keyed.join(beside(whole, sources, 64), "_mix_source").join(beside(extra, more, 40), ["_mix_source", "_mix_unit"], "left")
    return joined.select("row", (F.col("whole") + F.coalesce("_mix_more", F.lit(0))).alias("copies"))


def mix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, tempering: float = TEMPERING, scale: float = 1.0, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """``id_col``, source and copies (0 or more) of each row."""
    kept = [df[id_col].cast("bigint").alias("id"), df[source_col].cast("string").alias("source")]
    out = _copies(df, kept, id_col, text_col, source_col, weights, tempering, scale, leaf, seed)
    return out.select(F.col("row.id").alias(id_col), F.col("row.source").alias("source"), "copies")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, tempering: float = TEMPERING, scale: float = 1.0, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """The rows of ``df``, all columns, each as often as it was given copies."""
    out = _copies(df, [df[f"`{c}`"] for c in df.columns], id_col, text_col, source_col, weights, tempering, scale, leaf, seed)
    return out.where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
