"""Vector bin packing of examples under limits on tokens, segments and loss tokens.

An example is a list of segments (the turns of a conversation; a document is one
segment), each with its tokens, which bear loss or don't.  A bin may hold at most
``max_tokens`` tokens, ``max_segments`` segments and ``max_loss`` loss-bearing
tokens, all at once.

An example beyond a limit is cut into pieces, in order: at ends of segments, and
within a segment only where it alone is beyond a limit.  Nothing is dropped.

Pieces are placed by the dot-product heuristic: the open bin takes the piece that
still fits and has the largest sum over dimensions of weight * piece * room left,
all measured as shares of the limits, with each dimension weighted by its mean
demand; when none fits, the bin is closed and the next opened.  A large piece thus
goes where its own shape meets the room that is left.  Equal products are taken
in the order of the ids.

Pieces are hashed to groups of about ``group`` pieces, which are packed each on
its own, in parallel: this costs at most one partly filled bin a group.  Every
group is a fixed amount of work, whatever the size of the table, and its bins
don't depend on partitions or retries.

Defined cases: documents and turns with a null id are examples of their own, those of
equal text (and turn and role) pieces of one; null and empty texts have no
tokens (a segment is counted all the same); turns are ordered by number, null
first, then role and text, and a turn that is repeated as it is counts once; rows
of one id (documents) are pieces of their own, numbered on in the order of their
texts' sizes; with no rows there are no bins; texts are counted whole; other
columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .chat_tree import encode, encoding
from .session import cut
from .token_counts import VOCABULARY

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS, GROUP = 4096, 64, 3072, 4096
LOSS_ROLES = ("assistant",)
_PIECES = "id bigint, key bigint, piece bigint, first_segment bigint, first_token bigint, tokens bigint, segments bigint, loss bigint"


def checked(limits: tuple[int, int, int]) -> tuple[int, int, int]:
    if min(limits) < 1:
        raise ValueError("every limit must be at least 1")
    return limits


def pieces(segments: list[tuple[int, bool]], limits: tuple[int, int, int]) -> list[tuple[int, int, int, int, int]]:
    """(first segment, first token in it, tokens, segments, loss tokens) of each piece of an example."""
    most, most_segments, most_loss = limits
    out: list[tuple[int, int, int, int, int]] = []
    start, offset, tokens, count, loss = 0, 0, 0, 0, 0
    for k, (n, bears) in enumerate(segments):
        done = 0
        while True:
            left = n - done
            if count < most_segments and tokens + left <= most and (not bears or loss + left <= most_loss):
                if not count:
                    start, offset = k, done
                tokens, count, loss = tokens + left, count + 1, loss + left * bears
                break
            if count:
                out.append((start, offset, tokens, count, loss))
                tokens = count = loss = 0
                continue
            # a segment beyond a limit: as much of it as one piece may have
            part = min(most, most_loss) if bears else most
            out.append((k, done, part, 1, part * bears))
            done += part
    if count or not out:
        out.append((start, offset, tokens, count, loss))
    return out


def pack(demand: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """The bin (from 0) of each row (tokens, segments, loss); every row fits an empty bin."""
    share = demand / np.array(limits, dtype=np.float64)
    weight = share.mean(axis=0) if len(share) else np.ones(3)
    weighted = share * weight
    bins = np.full(len(share), -1)
    left = np.arange(len(share))
    number = 0
    integer = demand.astype(np.int64)
    while len(left):
        room = np.array(limits, dtype=np.int64)
        scale = np.array(limits, dtype=np.float64)
        mine, now, shape = left, integer[left], weighted[left]
        taken = []
        while len(mine):
            fits = (now <= room).all(axis=1)
            if not fits.all():
                mine, now, shape = mine[fits], now[fits], shape[fits]
                if not len(mine):
                    break
            k = int(np.argmax(shape @ (room / scale)))
            taken.append(mine[k])
            room = room - now[k]
            keep = np.ones(len(mine), bool)
            keep[k] = False
            mine, now, shape = mine[keep], now[keep], shape[keep]
        bins[taken] = number
        number += 1
        left = left[bins[left] < 0]
    return bins


def pack_pieces(found: DataFrame, limits: tuple[int, int, int], group: int) -> DataFrame:
    """bin_group, bin, slot and the columns of the pieces."""
    found = cut(found)
    groups = max(1, -(-found.count() // group))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("key", "ascending"), ("piece", "ascending")])
        demand = np.column_stack([table.column(c).to_numpy() for c in ("tokens", "segments", "loss")])
        bins = pack(demand, limits)
        order = np.argsort(bins, kind="stable")
        first = np.searchsorted(bins[order], bins[order])
        table = table.take(pa.array(order))
        return table.append_column("bin", pa.array(bins[order].astype(np.int64))).append_column("slot", pa.array((np.arange(len(order)) - first).astype(np.int64)))

    placed = found.withColumn("bin_group", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)))
    return placed.groupBy("bin_group").applyInArrow(run, f"{_PIECES}, bin_group bigint, bin bigint, slot bigint")


def _tokens(df: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of ``df`` with n_tokens in place of text, by the encoder of the chat tree (the counts of ``token_counts``, sooner)."""
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(vocabulary)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                tokens = [len(encode(model, t)) if t else 0 for t in tk.column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([tk.column(part, c) for c in kept] + [pa.array(tokens, pa.int64())], names=[*kept, "n_tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.mapInArrow(tk.tidy(run), f"{schema}, n_tokens bigint")


def pack_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, loss_roles: tuple[str, ...] = LOSS_ROLES, group: int = GROUP, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece: bin_group and bin, slot in it, conv_id, piece, where it starts and what it takes."""
    limits = checked((max_tokens, max_segments, max_loss))
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[turn_col].cast("bigint").alias("turn"), df[role_col].cast("string").alias("role"), df[text_col].cast("string").alias("text"))
    counted = _tokens(rows.withColumn("digest", F.md5(F.coalesce("text", F.lit("")))).withColumn("key", F.coalesce("id", F.xxhash64("turn", "role", "digest"))), vocabulary)
    turn = F.struct("turn", "role", "digest", "n_tokens", F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("bears"))
    examples = counted.groupBy("id", "key").agg(F.sort_array(F.collect_set(turn)).alias("turns")).select("id", "key", F.expr("transform(turns, t -> struct(t.n_tokens, t.bears))").alias("turns"))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, key, turns in zip(*(batch.column(c).to_pylist() for c in range(3))):
                rows += [(i, key, k, *p) for k, p in enumerate(pieces([(t["n_tokens"], t["bears"]) for t in turns], limits))]
            if rows:
                yield _piece_batch(rows)

    packed = pack_pieces(examples.mapInArrow(tk.tidy(cutting), _PIECES), limits, group)
    return packed.select("bin_group", "bin", "slot", F.col("id").alias(id_col), "piece", "first_segment", "first_token", "tokens", "segments", "loss")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, group: int = GROUP, vocabulary: str = VOCABULARY) -> DataFrame:
    """As pack_conversations, for documents whose every token bears loss."""
    limits = checked((max_tokens, max_segments, max_loss))
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[text_col].cast("string").alias("text"))
    keyed = rows.withColumn("key", F.coalesce("id", F.xxhash64(F.coalesce("text", F.lit("")))))
    examples = _tokens(keyed, vocabulary).groupBy("id", "key").agg(F.sort_array(F.collect_list("n_tokens")).alias("sizes"))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, key, sizes in zip(*(batch.column(c).to_pylist() for c in range(3))):
                own = [p for n in sizes for p in pieces([(n, True)], limits)]
                rows += [(i, key, k, *p) for k, p in enumerate(own)]
            if rows:
                yield _piece_batch(rows)

    packed = pack_pieces(examples.mapInArrow(tk.tidy(cutting), _PIECES), limits, group)
    return packed.select("bin_group", "bin", "slot", F.col("id").alias(id_col), "piece", "first_segment", "first_token", "tokens", "segments", "loss")


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "key", "piece", "first_segment", "first_token", "tokens", "segments", "loss"])
