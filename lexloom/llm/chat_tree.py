"""Chat formatting as a prefix tree: turns that conversations share are emitted once.

A turn is made into the tokens of its role between the marks START and MIDDLE, the
tokens of its text and the mark END.  Marks are ids beyond the vocabulary (in this
order), so no text can forge one, and turns of different role or text have
different tokens.  Conversations that start with the same turns share these nodes of a tree;
a tree has all conversations of one first turn.  Its nodes are emitted depth-first,
each once, as one sequence.  A node comes with

* start: where its tokens are in the sequence of its tree,
* position: the position id of its first token, which is the number of tokens of
  its ancestors (the ids of a node run on from there),
* attends: the intervals [start, stop) of the sequence that hold its ancestors, in
  order, adjacent ones joined; its own tokens also attend to each other causally.

So each conversation reads exactly as if it were alone.

Trees aren't gathered.  Conversations are range-sorted by the digests of their
turns, which is a depth-first order of all trees at once, and every partition
walks its run with a stack of the current path.  A first walk gives each
partition's first and last path; from these few rows the driver works out the
stack with which each partition starts, and the second walk emits.  A tree of any
number of conversations, such as those of one common system turn, is spread over
partitions, still with every shared token once.  Only digests and sizes are sorted
and walked; tokens join the nodes at the end, and are moved once.

Result: a row for each node, with the conversation that emits it, and a row
without tokens for each conversation that is a copy of another, pointing at the
node where it ends.  A conversation ends at its row of largest depth.

Defined cases: rows with a null conversation are left out; a null role counts as an
empty one, a null text as empty; turns are ordered by number, null
first, then by role and digest, and a turn that is repeated as it is counts once;
two conversations are copies if roles and texts agree, whatever the numbers of
the turns; with no rows there are no nodes; texts are read whole; other
columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .session import cut
from .token_counts import PATTERN, VOCABULARY, load_ranks

_NODES = "tree bigint, conv bigint, depth bigint, role string, start bigint, position bigint, n_tokens bigint, attends array<struct<start:bigint,stop:bigint>>, digest binary, turn bigint"
_loaded: dict[str, object] = {}
#: Runs of white space that the encoder's pattern can't look ahead over: its stack ends at less than a million.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def encoding(path: str):
    """The vocabulary's encoder of this worker."""
    if path not in _loaded:
        import tiktoken

        _loaded[path] = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return _loaded[path]


def encode(model, text: str) -> list[int]:
    """The tokens of a text of any length; of a long run of white space, the pattern's piece is cut here: all of it but the last one before other text."""
    out: list[int] = []
    at = 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += model.encode_ordinary(text[at : run.start()])
        out += model._encode_single_piece(text[run.start() : stop])
        at = stop
    tail = model.encode_ordinary(text[at:])
    return out + tail if at else tail


def turn_tokens(model, role: str | None, text: str | None) -> list[int]:
    start = model.n_vocab
    return [start, *encode(model, role or ""), start + 1, *encode(model, text or ""), start + 2]


def common(a: list, b: list) -> int:
    """How many leading entries agree."""
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return k


class Walk:
    """The stack of one partition's depth-first walk.

    path: digests of the current conversation; starts, sizes: of its nodes; end:
    where the next node of the tree starts; tree: the conversation that emitted
    the root.
    """

    def __init__(self, path=(), starts=(), sizes=(), end=0, tree=None):
        self.path, self.starts, self.sizes, self.end, self.tree = list(path), list(starts), list(sizes), end, tree

    def enter(self, conv: int, path: list, sizes: list[int]) -> int:
        """Moves to a conversation; from the depth returned on, its nodes are new."""
        shared = common(self.path, path)
        if not shared:
            self.end, self.tree = 0, conv
        del self.starts[shared:], self.sizes[shared:]
        for n in sizes[shared:]:
            self.starts.append(self.end)
            self.sizes.append(n)
            self.end += n
        self.path = path
        return shared

    def attends(self, depth: int) -> list[dict]:
        out: list[list[int]] = []
        for start, n in zip(self.starts[:depth], self.sizes[:depth]):
            if out and out[-1][1] == start:
                out[-1][1] += n
            elif n:
                out.append([start, start + n])
        return [{"start": a, "stop": b} for a, b in out]


def boundaries(ends: list[dict]) -> dict[int, Walk]:
    """The walk with which each partition starts, from what each gives on its own.

    Alone, a partition takes its first conversation as new.  What it has in common
    with the last path of the partitions before is then taken off again.
    """
    out: dict[int, Walk] = {}
    before = Walk()
    for e in sorted(ends, key=lambda e: e["part"]):
        out[e["part"]] = Walk(before.path, before.starts, before.sizes, before.end, before.tree)
        shared = common(before.path, e["first"])
        same_tree = e["last"][0] == e["first"][0]
        if shared and same_tree:
            # the first conversation's shared nodes move to where they are; all others by what remains
            repeated = sum(e["first_sizes"][:shared])
            move = before.end - repeated
            kept = common(e["first"], e["last"])
            starts = [before.starts[d] if d < min(shared, kept) else s + move for d, s in enumerate(e["last_starts"])]
            before = Walk(e["last"], starts, e["last_sizes"], e["end"] + move, before.tree)
        else:
            before = Walk(e["last"], e["last_starts"], e["last_sizes"], e["end"], e["tree"])
    return out


def chat_tree(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """tree_id, conv_id, depth, role, start, position, n_tokens, attends and tokens (see the module's text)."""
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[turn_col].cast("bigint").alias("turn"), df[role_col].cast("string").alias("role"), df[text_col].cast("string").alias("text")).where("id is not null")

    # the length of the role keeps role and text apart
    role = F.coalesce("role", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.coalesce("text", F.lit("")))))
    keyed = rows.withColumn("digest", digest)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(vocabulary)
        kind = np.uint16 if model.n_vocab + 3 <= 1 << 16 else np.uint32
        for batch in batches:
            for part in tk.slices(batch, "text"):
                tokens = [turn_tokens(model, r, t) for r, t in zip(tk.column(part, "role").to_pylist(), tk.column(part, "text").to_pylist())]
                packed = pa.array([np.array(t, dtype=kind).tobytes() for t in tokens], pa.binary())
                sizes = pa.array([len(t) for t in tokens], pa.int64())
                yield pa.RecordBatch.from_arrays([tk.column(part, c) for c in ("id", "turn", "role", "digest")] + [sizes, packed], names=["id", "turn", "role", "digest", "n", "packed"])

    # kept, as it is read for the sizes and for the tokens
    encoded = cut(keyed.mapInArrow(tk.tidy(encode), "id bigint, turn bigint, role string, digest binary, n bigint, packed binary"))
    turns = encoded.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "digest", "n"))).alias("turns"))
    part = lambda c: F.transform("turns", lambda t: t[c]).alias(c)
    paths = turns.select("id", part("digest"), part("role"), part("turn"), part("n")).toDF("id", "path", "roles", "numbers", "sizes")
    # kept, so that both walks see the same partitions
    run = cut(paths.repartitionByRange(F.col("path"), F.col("id")).sortWithinPartitions("path", "id"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, first = Walk(), None
        for batch in batches:
            for conv, path, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                walk.enter(conv, path, sizes)
                first = first or (path, sizes)
        if first:
            values = [TaskContext.get().partitionId(), walk.tree, walk.end, first[0], first[1], walk.path, walk.starts, walk.sizes]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.binary()), pa.list_(pa.int64())] + [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["part", "tree", "end", "first", "first_sizes", "last", "last_starts", "last_sizes"])

    ends = run.select("id", "path", "sizes").mapInArrow(survey, "part bigint, tree bigint, end bigint, first array<binary>, first_sizes array<bigint>, last array<binary>, last_starts array<bigint>, last_sizes array<bigint>")
    # one row a partition, of one path's length
    starts = df.sparkSession.sparkContext.broadcast(boundaries([r.asDict() for r in ends.collect()]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = starts.value.get(TaskContext.get().partitionId(), Walk())
        walk = Walk(walk.path, walk.starts, walk.sizes, walk.end, walk.tree)
        for batch in batches:
            out: list[tuple] = []
            for conv, path, roles, numbers, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                new = walk.enter(conv, path, sizes)
                position = sum(walk.sizes[:new])
                if new == len(path):
                    last = new - 1
                    out.append((walk.tree, conv, last, roles[last], walk.starts[last], position - walk.sizes[last], 0, walk.attends(last), None, None))
                for d in range(new, len(path)):
                    out.append((walk.tree, conv, d, roles[d], walk.starts[d], position, walk.sizes[d], walk.attends(d), path[d], numbers[d]))
                    position += walk.sizes[d]
                if len(out) >= 2000:
                    yield _nodes(out)
                    out = []
            if out:
                yield _nodes(out)

    nodes = run.select("id", "path", "roles", "numbers", "sizes").mapInArrow(emit, _NODES)
    # a null number has a key, too; a repeated turn has one row
    number = lambda c: [F.col(c).isNull().alias("unnumbered"), F.coalesce(c, F.lit(0)).alias("number")]
    once = encoded.select("id", "digest", *number("turn"), "packed").dropDuplicates(["id", "digest", "unnumbered", "number"])
    found = nodes.select("*", *number("turn")).join(once.withColumnRenamed("id", "conv"), ["conv", "digest", "unnumbered", "number"], "left")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if encoding(vocabulary).n_vocab + 3 <= 1 << 16 else np.uint32
        for batch in batches:
            raw = [np.frombuffer(x or b"", dtype=kind) for x in batch.column(batch.num_columns - 1).to_pylist()]
            offs = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
            flat = np.concatenate(raw).astype(np.int32) if raw else np.zeros(0, np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], tokens], names=[*batch.schema.names[:-1], "tokens"])

    kept = ["tree_id", id_col, "depth", "role", "start", "position", "n_tokens", "attends"]
    named = found.select("tree", "conv", *kept[2:], "packed")
    schema = "tree bigint, conv bigint, depth bigint, role string, start bigint, position bigint, n_tokens bigint, attends array<struct<start:bigint,stop:bigint>>, tokens array<int>"
    return named.mapInArrow(tk.tidy(unpack), schema).toDF(*kept, "tokens")


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3 + [pa.list_(span), pa.binary(), pa.int64()]
    names = ["tree", "conv", "depth", "role", "start", "position", "n_tokens", "attends", "digest", "turn"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
