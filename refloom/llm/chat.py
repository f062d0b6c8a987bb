"""Chat formatting as prefix trees.

Conversations that share their first turns share those turns' tokens: a sequence holds a
tree of turns in depth-first order, each turn's tokens once, each token with its position id
(as if its ancestors alone stood before it) and each turn with the intervals of the sequence
that it may attend to (its ancestors). A turn is tokenised by itself, by a byte-level
vocabulary, so its tokens give back its text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import stage, table

#: Fixed values of the template: a turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: Characters that begin control strings, and the escape itself.
_CONTROL = re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*) </turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: A sequence closes at the next conversation once it has so many tokens.
SEQUENCE_TOKENS = 1 << 18
#: Sequences of a written file, which a task that reads them holds at once.
FILE_SEQUENCES = 8
ASSISTANT = "assistant"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

NODES = "array<struct<start:long,length:long,position:long,parent:int,loss:boolean,content_start:long,content_length:long,attend:array<struct<start:long,end:long>>>>"
TREE_SCHEMA = f"sequence_id string, ids array<int>, position_ids array<int>, nodes {NODES}, leaves array<struct<conv_hash:string,node:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


class Vocabulary:
    """A byte-level vocabulary from a file of ranks: texts to ids and back, exactly."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self._encoding.decode_bytes(ids).decode("utf-8")


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role and text by turn, nulls empty) and conv_hash (of the turns). Ties in turn go by role and text; a row without conv_id is alone."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    conv = F.col("conv_id").cast("long").alias("conv_id")
    named = rows.where(conv.isNotNull()).groupBy(conv).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = rows.where(conv.isNull()).select(conv, F.array(turn).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return named.unionByName(alone).withColumn("turns", turns).withColumn("conv_hash", F.sha2(F.to_json("turns"), 256))


def path_key(turns: F.Column) -> F.Column:
    """Sorts conversations with a common beginning side by side: a hash of each turn in order."""
    return F.transform(turns, lambda t: F.xxhash64(t["role"], t["text"]))


class Tree:
    """Builds one sequence from conversations that arrive in path order."""

    def __init__(self, name: str, vocabulary: Vocabulary):
        self.name, self.vocabulary = name, vocabulary
        self.ids: list[int] = []
        self.positions: list[int] = []
        self.nodes: list[tuple] = []
        self.leaves: list[tuple[str, int]] = []
        #: (role, text, node) from the root to the last leaf.
        self.path: list[tuple[str, str, int]] = []

    def add(self, conv_hash: str, turns: list[dict]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and (turns[shared]["role"], turns[shared]["text"]) == self.path[shared][:2]:
            shared += 1
        del self.path[shared:]
        for t in turns[shared:]:
            before, content, close = (self.vocabulary.encode(x) for x in (OPEN + escape(t["role"]) + MIDDLE, escape(t["text"]), CLOSE))
            parent = self.path[-1][2] if self.path else -1
            attend, position = [], 0
            if parent >= 0:
                up = self.nodes[parent]
                position = up[2] + up[1]
                attend = [*up[7]]
                if attend and attend[-1][1] == up[0]:
                    attend[-1] = (attend[-1][0], up[0] + up[1])
                else:
                    attend.append((up[0], up[0] + up[1]))
            start, length = len(self.ids), len(before) + len(content) + len(close)
            self.nodes.append((start, length, position, parent, t["role"] == ASSISTANT, start + len(before), len(content), attend))
            self.ids += before + content + close
            self.positions += range(position, position + length)
            self.path.append((t["role"], t["text"], len(self.nodes) - 1))
        self.leaves.append((conv_hash, self.path[-1][2] if self.path else -1))


def _arrow(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


_LONG, _INT = pa.int64(), pa.int32()
_NODE = pa.struct(
    [("start", _LONG), ("length", _LONG), ("position", _LONG), ("parent", _INT), ("loss", pa.bool_()), ("content_start", _LONG), ("content_length", _LONG), ("attend", pa.list_(pa.struct([("start", _LONG), ("end", _LONG)])))]
)
_TREE = [("sequence_id", pa.string()), ("ids", pa.list_(_INT)), ("position_ids", pa.list_(_INT)), ("nodes", pa.list_(_NODE)), ("leaves", pa.list_(pa.struct([("conv_hash", pa.string()), ("node", _INT)])))]
_NODE_NAMES = [_NODE.field(k).name for k in range(_NODE.num_fields)]


def _as_row(tree: Tree) -> tuple:
    as_nodes = [dict(zip(_NODE_NAMES, n)) | {"attend": [{"start": a, "end": b} for a, b in n[7]]} for n in tree.nodes]
    return tree.name, np.array(tree.ids, np.int32), np.array(tree.positions, np.int32), as_nodes, [{"conv_hash": h, "node": k} for h, k in tree.leaves]


def format_trees(distinct: DataFrame, path: str, pattern: str) -> DataFrame:
    """Sequences (TREE_SCHEMA) from distinct conversations (conv_hash, turns).

    Conversations are dealt by ranges of their paths and sorted, so a range is a run of
    neighbouring subtrees: a first turn that a third of all conversations share is formatted
    once in each range (and sequence) it reaches, and no range holds more than its part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(path, pattern)
            for h, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tree is not None and len(tree.ids) >= SEQUENCE_TOKENS:
                    yield _arrow(_TREE, [_as_row(tree)])
                    tree = None
                tree = tree or Tree(h, vocabulary)
                tree.add(h, turns)
        if tree is not None:
            yield _arrow(_TREE, [_as_row(tree)])

    keyed = distinct.withColumn("ch_path", path_key(F.col("turns")))
    ranged = keyed.repartitionByRange("ch_path", "conv_hash").sortWithinPartitions("ch_path", "conv_hash")
    return ranged.select("conv_hash", "turns").mapInArrow(run, TREE_SCHEMA)


def read_back(trees: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per conversation, from the sequences' tokens alone: counts and digests of turns, of loss text and of the formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [("conv_hash", pa.string()), ("n_turns", _LONG), ("turns_sha256", pa.string()), ("loss_chars", _LONG), ("loss_sha256", pa.string()), ("formatted_chars", _LONG)]
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(path, pattern)
            for row in range(len(batch)):
                ids = batch.column(0)[row].values.to_numpy()
                nodes, leaves, rows = batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), []
                whole = [vocabulary.decode(ids[n["start"] : n["start"] + n["length"]].tolist()) for n in nodes]
                under = [unescape(vocabulary.decode(ids[n["content_start"] : n["content_start"] + n["content_length"]].tolist())) if n["loss"] else "" for n in nodes]
                for leaf in leaves:
                    line, k = [], leaf["node"]
                    while k >= 0:
                        line.append(k)
                        k = nodes[k]["parent"]
                    line.reverse()
                    formatted, loss = "".join(whole[k] for k in line), "".join(under[k] for k in line)
                    turns = parse(formatted)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    rows.append((leaf["conv_hash"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
                yield _arrow(names, rows)

    return trees.select("ids", "nodes", "leaves").mapInArrow(run, "conv_hash string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_format(rows: DataFrame, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(sequences, membership): TREE_SCHEMA rows, and (conv_id, conv_hash) naming each conversation's leaf.

    ``rows`` has conv_id, turn, role, text; ``path`` and ``pattern`` are a byte-level
    vocabulary's ranks and splitting pattern (see ``Vocabulary``). Starts, lengths, positions
    and intervals count tokens. A sequence is bounded, so a turn that very many conversations
    share is written once in each sequence that it reaches. Equal conversations are one leaf, found by an
    aggregate that combines before the shuffle.

    Defined cases: null text and role are empty; each row with null conv_id is a
    conversation of its own; null turns come first; repeated rows are turns of their own; an empty table
    gives empty tables; other columns are not carried. The template's control characters are
    escaped by a backslash, which reading back undoes.
    """
    found = stage(conversations_of(rows))
    # one row a distinct conversation; equal turns may come from any of its rows
    distinct = found.groupBy("conv_hash").agg(F.first("turns").alias("turns"))
    return format_trees(distinct, path, pattern), found.select("conv_id", "conv_hash")


#: The conversation added to every run: control strings inside texts.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    import public_tokenizers

    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    trees, members = chat_format(rows.unionByName(extra), path, pattern)
    digests = read_back(stage(trees, FILE_SEQUENCES), path, pattern)
    return members.join(digests, "conv_hash").drop("conv_hash").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
