"""Sequences to training tensors: padding, labels, packing and alignment.

A sequence is a row; positions are made explicit where an order matters.  Padding
needs one number a batch (its longest sequence), found by a window over the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordspans import word_spans
from .models import Tokenizer

IGNORE = -100
#: Bytes of a bin by which spans are joined.
BIN = 256


def resolve_pad_id(model: Tokenizer, pad_token_id: int | None = None) -> int:
    """The one given, else the padding token's, else the end token's."""
    for found in (pad_token_id, model.pad_id(), model.eos_id()):
        if found is not None:
            return found
    raise ValueError("the tokenizer has no padding or end token: give pad_token_id")


def _padded(values: Column, to: Column, value: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(value), (to - F.size(values)).cast("int")))


def collate_padded_batch(df: DataFrame, pad_token_id: int, batch_cols: tuple[str, ...] = ("batch_id",), ids_col: str = "ids", type_col: str | None = None, special_col: str | None = None, pad_side: str = "right", pad_to_multiple_of: int | None = None) -> DataFrame:
    """``df`` with ids padded to the longest of the batch, attention_mask, token_type_ids, special_tokens_mask and sequence_length (before padding)."""
    if pad_side != "right":
        raise ValueError("only right padding is supported")
    if pad_to_multiple_of is not None and pad_to_multiple_of < 1:
        raise ValueError("pad_to_multiple_of must be positive")
    size = F.size(ids_col)
    longest = F.max(size).over(Window.partitionBy(*batch_cols))
    width = F.ceil(longest / pad_to_multiple_of) * pad_to_multiple_of if pad_to_multiple_of else longest
    rows = df.withColumns({"sequence_length": size, "_width": width})
    zeros = F.array_repeat(F.lit(0), size)
    types = F.col(type_col) if type_col else zeros
    special = F.col(special_col) if special_col else zeros
    fitting = F.when((F.size(types) == size) & (F.size(special) == size), F.lit(True)).otherwise(F.raise_error(F.lit("masks and ids differ in length")).cast("boolean"))
    filled = rows.where(fitting).withColumns(
        {
            "attention_mask": _padded(F.array_repeat(F.lit(1), size), F.col("_width"), 0),
            "token_type_ids": _padded(types, F.col("_width"), 0),
            "special_tokens_mask": _padded(special, F.col("_width"), 1),
        }
    )
    return filled.withColumn(ids_col, _padded(F.col(ids_col), F.col("_width"), pad_token_id)).drop("_width")


def causal_lm_labels(ids: Column, attention_mask: Column, ignore_index: int = IGNORE, zero_based: bool = False) -> Column:
    """Each id's label: the next id that isn't padding, as an array expression; the last one and padding have none."""
    shift = 1 if zero_based else 0

    # lambda variables hold what is evaluated once for a row, not once for each place in it
    def told(z: Column) -> Column:
        first = F.array_position(z["m"], 1)
        count = F.aggregate(z["m"], F.lit(0), lambda a, m: a + m)
        return F.struct(z["i"].alias("i"), z["m"].alias("m"), first.alias("first"), count.alias("count"))

    def labelled(z: Column) -> Column:
        # ids between paddings are looked up by their place, so that a long sequence costs no copying
        def label(x: Column, k: Column) -> Column:
            place = k + 1
            return F.when((place >= z["first"]) & (place < z["first"] + z["count"] - 1), (F.get(z["i"], place.cast("int")) - shift).cast("int")).otherwise(F.lit(ignore_index))

        inside = F.aggregate(F.slice(z["m"], F.greatest(z["first"], F.lit(1)).cast("int"), z["count"]), F.lit(0), lambda a, m: a + m)
        unbroken = (F.size(z["i"]) == F.size(z["m"])) & ((z["count"] == 0) | (inside == z["count"]))
        return F.when(unbroken, F.transform(z["i"], label)).otherwise(folded(z["i"], z["m"]))

    def step(acc: Column, x: Column) -> Column:
        # from the right: the label of x is the id seen last
        mine = F.when((x["m"] != 0) & acc["next"].isNotNull(), acc["next"] - shift).otherwise(F.lit(ignore_index))
        return F.struct(F.concat(F.array(mine), acc["out"]).alias("out"), F.when(x["m"] != 0, x["i"]).otherwise(acc["next"]).cast("int").alias("next"))

    def folded(i: Column, m: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("int").alias("next"))
        return F.aggregate(F.reverse(F.arrays_zip(i.alias("i"), m.alias("m"))), start, step, lambda acc: acc["out"])

    mask = F.transform(attention_mask, lambda m: (m != 0).cast("int"))
    row = F.array(F.struct(ids.alias("i"), mask.alias("m")))
    found = F.get(F.transform(F.transform(row, told), labelled), F.lit(0))
    return F.when(ids.isNotNull() & attention_mask.isNotNull(), found)


def causal_labels_long(tokens: DataFrame, sequence_cols: tuple[str, ...], pos_col: str = "pos", id_col: str = "token_id", mask_col: str | None = None, ignore_index: int = IGNORE, zero_based: bool = False) -> DataFrame:
    """Labels for a row a token: better than arrays for long sequences."""
    order = Window.partitionBy(*sequence_cols).orderBy(pos_col)
    valid = F.col(mask_col) != 0 if mask_col else F.lit(True)
    following = F.first(F.when(valid, F.col(id_col)), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)) if mask_col else F.lead(id_col).over(order)
    label = F.when(valid & following.isNotNull(), following - (1 if zero_based else 0)).otherwise(F.lit(ignore_index))
    return tokens.withColumn("label", label.cast("bigint"))


def quick_causal_lm_batch(model, df: DataFrame, text_col: str = "text", batch_cols: tuple[str, ...] = ("batch_id",), add_special_tokens: bool = True, pad_token_id: int | None = None, pad_to_multiple_of: int | None = None, ignore_index: int = IGNORE, zero_based: bool = False) -> DataFrame:
    """Texts to padded ids, masks and labels."""
    from .encode import quick_encode_batch, resolve

    model = resolve(model)
    encoded = quick_encode_batch(model, df, text_col, add_special_tokens).drop("sequence_length")
    flat = encoded.select("*", F.col("encoding.ids").alias("ids"), F.col("encoding.special_tokens_mask").alias("_special")).drop("encoding")
    batch = collate_padded_batch(flat, resolve_pad_id(model, pad_token_id), batch_cols, special_col="_special", pad_to_multiple_of=pad_to_multiple_of).drop("_special")
    return batch.withColumn("labels", causal_lm_labels(F.col("ids"), F.col("attention_mask"), ignore_index, zero_based))


def pack_blocks(df: DataFrame, block_size: int, order_col: str, size_col: str, group_cols: tuple[str, ...] = (), separator: int = 0) -> DataFrame:
    """``df`` with start (from 0), first_block and last_block of each sequence, all being put end to end.

    With ``group_cols`` each group is a stream of its own, and groups run in
    parallel.  A single stream is summed by ranges of its order: only one sum for
    each range meets in one place.
    """
    size = F.col(size_col) + separator
    if group_cols:
        order = Window.partitionBy(*group_cols).orderBy(order_col)
        placed = df.withColumn("start", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    else:
        from ..functions.session import cut

        ranged = cut(df.repartitionByRange(order_col).withColumn("_part", F.spark_partition_id()))
        sums = ranged.groupBy("_part").agg(F.sum(size).alias("_sum"))
        before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
        within = Window.partitionBy("_part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
        placed = ranged.join(F.broadcast(before), "_part").withColumn("start", F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("_part", "_before")
    last = F.greatest(F.col("start"), F.col("start") + F.col(size_col) - 1)
    return placed.withColumns({"start": F.col("start").cast("bigint"), "first_block": F.floor(F.col("start") / block_size), "last_block": F.floor(last / block_size)})


def packed_ids(df: DataFrame, block_size: int, order_col: str, ids_col: str, pad_token_id: int, group_cols: tuple[str, ...] = (), separator_id: int | None = None) -> DataFrame:
    """group_cols, block, ids, attention_mask: blocks of equal size, the last one of a stream padded."""
    sep = 0 if separator_id is None else 1
    sized = df.withColumn("_n", F.size(ids_col))
    placed = pack_blocks(sized, block_size, order_col, "_n", group_cols, sep)
    whole = placed.withColumn("_last", F.max(order_col).over(Window.partitionBy(*group_cols))) if sep and group_cols else placed.crossJoin(F.broadcast(sized.agg(F.max(order_col).alias("_last")))) if sep else placed
    ids = F.when(F.col(order_col) == F.col("_last"), F.col(ids_col)).otherwise(F.concat(F.col(ids_col), F.array(F.lit(separator_id)))) if sep else F.col(ids_col)
    # a row for each piece of a sequence in a block, not for each token
    sized = whole.select(*group_cols, "start", ids.alias("_ids")).withColumn("_stop", F.col("start") + F.size("_ids")).where("_stop > start")
    spread = F.explode(F.sequence(F.floor(F.col("start") / block_size), F.floor((F.col("_stop") - 1) / block_size))).alias("block")
    pieces = sized.select(*group_cols, "start", "_stop", "_ids", spread)
    low, high = F.greatest("start", F.col("block") * block_size), F.least("_stop", (F.col("block") + 1) * block_size)
    piece = F.slice("_ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    blocks = pieces.select(*group_cols, "block", low.alias("_at"), piece.alias("_id")).groupBy(*group_cols, "block").agg(F.sort_array(F.collect_list(F.struct("_at", "_id"))).alias("_c"))
    joined = blocks.withColumn("_v", F.flatten(F.transform("_c", lambda c: c["_id"]))).withColumn("_n", F.size("_v"))
    filled = joined.withColumn("ids", _padded(F.col("_v"), F.lit(block_size), pad_token_id))
    return filled.withColumn("attention_mask", _padded(F.array_repeat(F.lit(1), F.col("_n")), F.lit(block_size), 0)).drop("_c", "_n", "_v")


def _second_bytes(column: pa.Array, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a character starts at the byte after each start, or the text ends before it."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, body = text.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(text) + 1, offset=8 * text.offset)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = offs[row] + start
    ends = at >= offs[row + 1]
    out = np.ones(len(at), dtype=bool)
    out[~ends] = (data[at[~ends]] & 0xC0) != 0x80
    return out


def word_offsets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", boundaries: bool = False) -> DataFrame:
    """id_col, word_index (from 1), word, start, stop: words with their spans of bytes; with ``boundaries``
    also whether ``start`` + 1 is a valid boundary of the text (as by ``is_valid_string_boundary``).

    Row by row over Arrow buffers, without a shuffle and in time proportional to the
    texts, whatever their length; null and empty texts have no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                row, start, stop, words = word_spans(part.column(1))
                index = np.arange(len(row)) - np.searchsorted(row, row) + 1
                more = [pa.array(_second_bytes(part.column(1), row, start))] if boundaries else []
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(index.astype(np.int64)), words, pa.array(start), pa.array(stop), *more], names=[id_col, "word_index", "word", "start", "stop", *(["boundary"] if boundaries else [])])

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, word_index bigint, word string, start bigint, stop bigint{', boundary boolean' if boundaries else ''}")


def _binned(df: DataFrame, start: str, stop: str) -> DataFrame:
    return df.where(F.col(stop) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.col(stop) - 1) / BIN))))


def _overlapping(left: DataFrame, right: DataFrame, id_col: str, spans: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of rows of one id whose spans overlap: joined by bins of the text, and given in the bin where the overlap starts."""
    a, b, x, y = spans
    pairs = _binned(left, a, b).join(_binned(right.withColumnRenamed(id_col, "_id"), x, y).withColumnRenamed("_bin", "_other"), (F.col(id_col) == F.col("_id")) & (F.col("_bin") == F.col("_other")))
    both = (F.col(a) < F.col(y)) & (F.col(b) > F.col(x))
    return pairs.where(both & (F.col("_bin") == F.floor(F.greatest(a, x) / BIN))).drop("_id", "_bin", "_other")


def subword_to_word(tokens: DataFrame, words: DataFrame, id_col: str = "doc_id", pos_col: str = "pos") -> DataFrame:
    """id_col, pos_col, word_index: the word that contains a token, else the one it overlaps most, of equals the first."""
    w = words.select(id_col, F.col("word_index"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    pairs = _overlapping(tokens, w, id_col, ("start", "stop", "_a", "_b"))
    inside = (F.col("start") >= F.col("_a")) & (F.col("stop") <= F.col("_b"))
    overlap = F.least("stop", "_b") - F.greatest("start", "_a")
    # the largest of (contains, overlap, -index), combined before the shuffle
    best = pairs.groupBy(id_col, pos_col).agg(F.max(F.struct(inside.alias("i"), overlap.alias("o"), (-F.col("word_index")).alias("w"))).alias("_best"))
    return best.select(id_col, pos_col, (-F.col("_best.w")).alias("word_index"))


def span_to_tokens(tokens: DataFrame, spans: DataFrame, id_col: str = "doc_id", pos_col: str = "pos") -> DataFrame:
    """Each labelled span (id_col, span_id, span_start, span_stop) with the tokens it overlaps."""
    return _overlapping(tokens, spans, id_col, ("start", "stop", "span_start", "span_stop")).select(id_col, "span_id", pos_col)
