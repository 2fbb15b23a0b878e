"""Chat formatting of reply trees.

Messages are rows (tree_id, msg_id, parent_id, role, text, score). Iterative
self-joins double the reach of every message's ancestor pointer and sum the
scores on the way, so a path of n messages takes log2(n) rounds. Leaves are
then ranked by the mean score of their root-to-leaf path, and the best paths
of each tree are expanded from the same pointers: for each power of two,
largest first, every message found so far adds the one that far above it.
Texts join only at the end; each path becomes one formatted conversation.

The template marks turns with control strings. Inside roles and texts ``<|``
gets a backslash (and ``<\\|`` another one, and so on), which is undone on
reading, so no text can end its turn. The loss mask lists the spans of the
assistants' texts in code points of the formatted string.

Defined results: null roles and texts are empty; a message without a known
parent is a root; of rows with one (tree, message) id the least is kept;
rows with a null tree or message id are dropped; messages on a cycle have no
root and are dropped; ties in score go to the smaller leaf id; an empty table gives
an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_FORMATTED = "tree_id long, leaf long, rank int, formatted string, mask array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role == LOSS_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((_plain_role(role), unescape(rest[: -len(END) - 1])))
    return out


def _doubled(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(every message with its path's depth and total score, pointers up by 1, 2, 4, ...)."""
    ids = messages.select("tree_id", "msg_id", "parent_id", "score")
    known = ids.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("p"))
    state = ids.join(known, (F.col("tree_id") == F.col("t")) & (F.col("parent_id") == F.col("p")), "left").select("tree_id", "msg_id", F.col("p").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    state = runtime.cut(state)
    bound = max(1, state.count()).bit_length() + 1
    jumps = []
    while not state.where("up is not null").isEmpty():
        if len(jumps) == bound:
            break  # what still has an ancestor runs in a cycle
        jumps.append(state.where("up is not null").select("tree_id", "msg_id", "up"))
        far = state.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("mid"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("depth").alias("deep"))
        # messages that reached their root keep their row and join no more
        going = state.where("up is not null").join(far, (F.col("tree_id") == F.col("t")) & (F.col("up") == F.col("mid")))
        state = runtime.cut(state.where("up is null").unionByName(going.select("tree_id", "msg_id", F.col("far").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("deep", F.lit(0))).alias("depth"))))
    return state.where("up is null").drop("up"), jumps


def best_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree_id, leaf, rank, msg_id, above): the messages of the best paths;
    ``above`` is the distance from the leaf."""
    scored, jumps = _doubled(messages)
    parents = messages.select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).where("p is not null")
    leaves = scored.join(parents, (F.col("tree_id") == F.col("t")) & (F.col("msg_id") == F.col("p")), "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc(F.col("total") / F.col("depth")), "msg_id")
    paths = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree).select("tree_id", F.col("msg_id").alias("leaf"), "rank", "msg_id", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        up = jumps[k].select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "up")
        met = paths.join(up, (F.col("tree_id") == F.col("t")) & (F.col("msg_id") == F.col("m")), "left")
        both = F.when(F.col("up").isNull(), F.array(F.struct("msg_id", "above"))).otherwise(F.array(F.struct("msg_id", "above"), F.struct(F.col("up").alias("msg_id"), (F.col("above") + (1 << k)).alias("above"))))
        paths = met.select("tree_id", "leaf", "rank", F.explode(both).alias("x")).select("tree_id", "leaf", "rank", "x.*")
        if k % 4 == 0:
            paths = runtime.cut(paths)
    return paths


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(3).to_pylist()]
        mask = pa.array([[{"start": a, "end": z} for a, z in m] for _, m in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([f for f, _ in done], pa.string()), mask], ["tree_id", "leaf", "rank", "formatted", "mask"])


def format_trees(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree_id, leaf, rank, formatted, mask): one row for each chosen path."""
    messages = runtime.bounded_batches(messages)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.struct(F.col("parent_id").cast("long").alias("parent_id"), text("role").alias("role"), text("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    messages = messages.where("tree_id is not null and msg_id is not null").groupBy(F.col("tree_id").cast("long").alias("tree_id"), F.col("msg_id").cast("long").alias("msg_id")).agg(F.min(body).alias("b")).select("tree_id", "msg_id", "b.*")
    messages = runtime.written(messages, "chat-messages")
    paths = best_paths(messages.drop("role", "text"), per_tree)
    told = messages.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "role", "text")
    rows = paths.join(told, (F.col("tree_id") == F.col("t")) & (F.col("msg_id") == F.col("m")))
    turns = rows.groupBy("tree_id", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("at"), "role", "text"))).alias("turns"))
    return turns.mapInArrow(_format, _FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        rows = []
        for tree, text, mask in zip(*(batch.column(c).to_pylist() for c in ("tree_id", "formatted", "mask"))):
            turns = read_turns(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            rows.append((tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""
    formatted = runtime.bounded_batches(formatted)
    return formatted.select("tree_id", "formatted", "mask").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as trees of one path.

    Rows of one turn follow each other by role and text; rows without a
    conversation are dropped, rows without a turn come first.
    """
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree_id"), "turn", "role", "text").withColumn("msg_id", F.row_number().over(order).cast("long") - 1)
    return rows.select("tree_id", "msg_id", F.expr("case when msg_id > 0 then msg_id - 1 end").alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


#: DuckDB SQL of the digest over ``conversations`` and conversation -1.
SQL = r"""
with extra(conv_id, turn, role, text) as (values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
t as (select conv_id, row_number() over (partition by conv_id order by turn, role nulls first, text nulls first) as n, coalesce(role, '') as role, coalesce(text, '') as text
  from (select conv_id, turn, role, text from conversations where conv_id is not null union all select * from extra)),
e as (select *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as body, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') as head from t)
select conv_id::bigint as conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(head) + length(body) + 24)::bigint as formatted_chars
from e group by conv_id
"""
