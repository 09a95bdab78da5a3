"""Chat formatting from reply trees.

Messages form trees by their parents. Iterative self-joins with pointer doubling give every message its depth and the sum
of scores from its root, so all root-to-leaf paths are known by their leaves after a logarithmic number of joins, however
deep a tree is. Leaves are ranked in their tree by mean path score, and only the chosen paths are written out, again by
doubling joins. Each path becomes one conversation string with marked turns, escaped texts and a loss mask.

Template: ``<|turn|>role\\ntext<|end|>\\n`` per turn. A backslash escapes: it stands before each backslash and inside each
control string of a text or role, after its first character, and before a line break in a role. So no text can pass for a
mark, and ``parse`` gives roles and texts back exactly.

Defined results: null text and null role are empty; a message whose parent is missing is a root; messages on a cycle, or
below one, have no root and are left out; equal scores fall back to the least leaf id; null tree ids are one tree of their
own; repeated message ids are one message (the least by role and text); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialize, table

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this and other chat templates; escaped wherever they stand in a text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n", re.S)
LOSS_ROLES = ("assistant",)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_string(role: str, text: str) -> tuple[str, int]:
    """A turn, and where its text starts in it."""
    head = f"{TURN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text in ``formatted``."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.index(END, head.end())
        yield unescape(head[1]), unescape(formatted[head.end() : end]), head.end(), end
        at = end + len(END) + 1


def path_ends(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and score sum of every message that has a root, and the pointers used.

    ``messages``: tree, id, parent, score. Gives (tree, id, depth, total) and for k = 0, 1, ... the table (tree, id, up) of
    messages and their ancestors 2^k levels above.
    """
    parents = messages.select(F.col("tree").alias("t"), F.col("id").alias("pid"))
    linked = messages.join(parents, messages["tree"].eqNullSafe(F.col("t")) & (messages["parent"] == F.col("pid")), "left")
    state = materialize(linked.select("tree", "id", F.col("pid").alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")), "jumps")
    rounds, limit, levels = 0, max(1, messages.count()).bit_length() + 1, []
    # more doublings than a path of all messages needs mean a cycle
    while rounds < limit and not state.where("up is not null").isEmpty():
        levels.append(state.where("up is not null").select("tree", "id", "up"))
        above = state.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2"))
        # only messages that have not reached their root are joined; a deep tree does not carry the shallow ones along
        active = state.where("up is not null")
        joined = active.join(above, active["tree"].eqNullSafe(F.col("t")) & (active["up"] == F.col("i")), "left")
        moved = joined.select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("s2", F.lit(0.0))).alias("total"))
        state = materialize(state.where("up is null").unionByName(moved), "jumps")
        rounds += 1
    return state.where("up is null").select("tree", "id", "depth", "total"), levels


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, path, depth, id): the messages of the ``branches`` best root-to-leaf paths of each tree.

    ``path`` is the rank of the path in its tree from 1, ``depth`` counts from 1 at the root.
    """
    rooted, levels = path_ends(messages)
    parents = messages.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(F.col("t")) & (rooted["id"] == F.col("p")), "left_anti")
    rank = Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), "id")
    chosen = leaves.withColumn("path", F.row_number().over(rank)).where(F.col("path") <= branches)
    paths = chosen.select("tree", "path", "depth", "id")
    # every distance above a leaf has one binary form, so each ancestor is added once
    for k in reversed(range(len(levels))):
        up = levels[k].select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        higher = paths.join(up, paths["tree"].eqNullSafe(F.col("t")) & (paths["id"] == F.col("i"))).select("tree", "path", (F.col("depth") - 2**k).alias("depth"), F.col("up").alias("id"))
        paths = materialize(paths.union(higher), "paths")
    return paths


def format_conversations(messages: DataFrame, branches: int = 1, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(tree, path, n_turns, formatted, loss_spans): one row for each chosen path.

    ``messages``: tree, id, parent, score, role, text. ``loss_spans`` holds start and end of the escaped texts under the
    loss mask, in code points. Turns are sorted by Spark and a task builds one string at a time, so that memory follows
    the longest conversation and not the number of turns in a partition.
    """
    once = Window.partitionBy("tree", "id").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    unique = materialize(messages.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n"), "messages")
    paths = reply_paths(unique.select("tree", "id", "parent", "score"), branches)
    m = unique.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(m, paths["tree"].eqNullSafe(F.col("t")) & (paths["id"] == F.col("i"))).select("tree", "path", "depth", "role", "text")
    kind = turns.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts, spans, at = None, [], [], 0
        for rows in batches:
            out = []
            trees = rows["tree"].astype(object).where(rows["tree"].notna(), None)
            for tree, path, role, text in zip(trees, rows["path"], rows["role"], rows["text"], strict=True):
                if (tree, path) != key:
                    if parts:
                        out.append((*key, len(parts), "".join(parts), spans))
                    key, parts, spans, at = (tree, path), [], [], 0
                turn, start = turn_string(role, text)
                if role in loss_roles:
                    spans.append([at + start, at + len(turn) - len(END) - 1])
                parts.append(turn)
                at += len(turn)
            if out:
                yield pd.DataFrame(out, columns=["tree", "path", "n_turns", "formatted", "loss_spans"])
        if parts:
            yield pd.DataFrame([(*key, len(parts), "".join(parts), spans)], columns=["tree", "path", "n_turns", "formatted", "loss_spans"])

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(n, "tree", "path").sortWithinPartitions("tree", "path", "depth")
    return ordered.mapInPandas(run, f"tree {kind}, path int, n_turns long, formatted string, loss_spans array<array<long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, path and the digests of what the formatted strings and their masks hold, by parsing them."""
    kind = formatted.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns, loss, count, n = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, own, _, _ in parse(text):
                    turns.update(f"{role}\n{own}\n".encode())
                    n += 1
                for start, end in spans:
                    own = unescape(text[start:end])
                    loss.update(own.encode())
                    count += len(own)
                out.append((n, turns.hexdigest(), count, loss.hexdigest(), len(text)))
            if out:
                names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("path"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], ["tree", "path", *names])

    return formatted.mapInArrow(run, f"tree {kind}, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text) rows: every row replies to the row before it; ties in turn by role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("id"), "role", "text")
    return numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose turns look like marks, read back from their formatted strings."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(linear_messages(rows))).drop("path").withColumnRenamed("tree", "conv_id")


_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text) + length(text) - length(replace(text, chr(92), ''))
  + (SELECT sum((length(text) - length(replace(text, k, ''))) // length(k)) FROM (VALUES ('<|'), ('<s>'), ('</s>'), ('[INST]'), ('[/INST]'), ('<<SYS>>'), ('<</SYS>>')) v(k)) + 17 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op1_chat_formatting": op1_chat_formatting}
SQL = {"op1_chat_formatting": _SQL}
