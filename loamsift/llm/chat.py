"""Chat formatting by a prefix tree.

Conversations that begin with the same turns share these turns' tokens: the
turns form a tree, each node of which is emitted once, depth first, with the
position ids of its tokens (as in every conversation through it) and the
intervals of the tree's token sequence that it may attend to: its ancestors'
and, causally, its own.

Conversations are sorted by the hashes of their turns, so that a tree is a
run of rows that one pass with a stack reads; no tree is held in memory.

Defined results: a conversation's turns are ordered by turn (nulls last), role
and text; equal rows of one conversation count once; rows without a conv_id
are left out; null roles are written as ``unknown`` and null texts as empty;
an empty table gives an empty result; long texts are encoded whole; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm.common import table
from loamsift.llm.token_blocks import VOCABULARY, encoding

SCHEMA = "tree_id long, node long, parent long, depth int, role string, start long, tokens array<int>, position_ids array<int>, attends array<struct<start:long,end:long>>, conv_ids array<long>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
NAMES = [c.split()[0] for c in SCHEMA.replace("struct<start:long,end:long>", "x").split(", ")]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}<|end|>\n"


class Tree:
    """The path from the root to the last conversation; finished nodes become rows."""

    def __init__(self, enc):
        self.enc, self.tree, self.path, self.rows = enc, None, [], []

    def pop_to(self, depth: int) -> None:
        while len(self.path) > depth:
            n = self.path.pop()
            self.rows.append((self.tree, n["node"], n["parent"], len(self.path), n["turn"][0], n["start"], n["tokens"], list(range(n["position"], n["position"] + len(n["tokens"]))), [{"start": s, "end": e} for s, e in n["attends"]], n["convs"]))

    def add(self, tree: int, conv: int, turns: list[tuple[str, str]]) -> None:
        if tree != self.tree or (self.path and turns[0] != self.path[0]["turn"]):
            self.pop_to(0)
            self.tree, self.count, self.size = tree, 0, 0
        common = 0
        while common < min(len(self.path), len(turns)) and self.path[common]["turn"] == turns[common]:
            common += 1
        self.pop_to(common)
        for turn in turns[common:]:
            up = self.path[-1] if self.path else None
            ids = self.enc.encode_ordinary(render(*turn))
            attends = [*(up["attends"] if up else []), (self.size, self.size + len(ids))]
            if len(attends) > 1 and attends[-2][1] == attends[-1][0]:
                attends[-2:] = [(attends[-2][0], attends[-1][1])]
            self.path.append({"turn": turn, "node": self.count, "parent": up["node"] if up else None, "start": self.size, "tokens": ids, "position": up["position"] + len(up["tokens"]) if up else 0, "attends": attends, "convs": []})
            self.count += 1
            self.size += len(ids)
        self.path[-1]["convs"].append(conv)

    def take(self) -> pa.RecordBatch:
        c = list(zip(*self.rows)) or [()] * len(NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, _TYPES)], NAMES)


def prefix_trees(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each node of the trees; ``conv_ids`` are the conversations that end there."""
    turn = F.struct(F.col("turn").isNull().alias("none"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    hashed = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))).withColumn("tree_id", F.col("path")[0])
    laid = hashed.repartition("tree_id").sortWithinPartitions("path", "conv_id").select("tree_id", "conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches):
        tree = Tree(encoding(vocabulary))
        for b in batches:
            for t, c, roles, texts in zip(*(b.column(k).to_pylist() for k in ("tree_id", "conv_id", "roles", "texts"))):
                tree.add(t, c, list(zip(roles, texts)))
                if len(tree.rows) >= 2000:
                    yield tree.take()
        tree.pop_to(0)
        yield tree.take()

    return laid.mapInArrow(run, SCHEMA)


def attention_mask(nodes: list) -> np.ndarray:
    """The boolean mask of one tree's token sequence, from its rows (for small trees and tests)."""
    total = sum(len(n.tokens) for n in nodes)
    mask = np.zeros((total, total), bool)
    for n in nodes:
        for k in range(len(n.tokens)):
            i = n.start + k
            for a in n.attends:
                mask[i, a.start : min(a.end, i + 1)] = True
    return mask


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trees(table(spark, sf_dir, "conversations"))
