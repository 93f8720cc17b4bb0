"""Chat formatting: reply trees, their best root-to-leaf branches, and reversible templates."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, without


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn. Texts and roles are escaped so that no mark can arise from them.

    ``\\`` becomes ``\\\\`` and a backslash goes behind the first character of every
    control string, which is undone by dropping one backslash of each pair or lone one.
    """

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    #: Control strings of widespread templates, never left bare in a text.
    control: tuple[str, ...] = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learn: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        out = text.replace("\\", "\\\\")
        for c in self.control:
            if c in out:
                out = out.replace(c, f"{c[0]}\\{c[1:]}")
        return out

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\n")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The conversation as one string, and the (start, end) code points of what is learned from."""
        parts: list[str] = []
        mask: list[tuple[int, int]] = []
        at = 0
        for role, text in turns:
            head = self.before_role + self.escape_role(role) + self.after_role
            body = self.escape(text)
            if role in self.learn:
                mask.append((at + len(head), at + len(head) + len(body)))
            parts += (head, body, self.end)
            at += len(head) + len(body) + len(self.end)
        return "".join(parts), mask

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a rendered conversation."""
        out = []
        at = 0
        while at < len(formatted):
            start = at + len(self.before_role)
            mid = formatted.index(self.after_role, start)
            stop = formatted.index(self.end, mid + len(self.after_role))
            out.append((self.unescape_role(formatted[start:mid]), self.unescape(formatted[mid + len(self.after_role) : stop])))
            at = stop + len(self.end)
        return out


def chain_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", score: str | None = None) -> DataFrame:
    """(tree, node, parent, role, text, score): each row of a conversation replies to the one before it.

    Rows are ordered by turn, then role and text; equal rows follow each other.
    The order is one range-partitioned sort of the table, so a conversation with a
    third of all rows is dealt over many tasks: nodes are numbered along the sort,
    and a row's parent is the number before its own unless it begins its tree.
    Null ids are one conversation; null turns come first; null roles and texts are empty.
    """
    slim = rows.select(
        F.col(conv_id).alias("tree"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"), (F.col(score).cast("double") if score else F.lit(0.0)).alias("score"),
    )
    order = ["tree", "turn", "role", F.xxhash64("text"), "text"]
    placed = materialize(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    ends = placed.groupBy(F.shiftright("node", 33).alias("part")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
    before = F.lag("high").over(Window.orderBy("part"))  # one row per partition of the sort
    ends = ends.select("low", before.alias("last"))
    firsts = placed.groupBy("tree").agg(F.min("node").alias("root")).select("root")
    at = placed.join(F.broadcast(ends), placed.node == ends.low, "left").join(firsts, placed.node == firsts.root, "left")
    parent = F.when(F.col("root").isNull(), F.coalesce("last", F.col("node") - 1))
    return at.select("tree", "node", parent.alias("parent"), "role", "text", "score")


def reply_nodes(messages: DataFrame, tree: str, message_id: str, parent_id: str, role: str, text: str, score: str | None = None) -> DataFrame:
    """(tree, node, parent, role, text, score) of messages that name the message they reply to.

    A message whose parent is null or missing is a root. Of messages that share an
    id, the first one (by role and text) is the one replied to. Ids are unique in a tree.
    """
    slim = messages.select(
        F.col(tree).alias("tree"), F.col(message_id).alias("id"), F.col(parent_id).alias("up"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"), (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"),
    )
    placed = materialize(slim.withColumn("node", F.monotonically_increasing_id()))
    named = placed.groupBy(F.col("tree").alias("t"), F.col("id").alias("i")).agg(F.min_by("node", F.struct("role", "text", "node")).alias("parent"))
    joined = placed.join(named, placed.tree.eqNullSafe(named.t) & (placed.up == named.i), "left")
    return joined.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), "role", "text", "score")


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(leaf, node, depth) of the ``per_tree`` best root-to-leaf paths of each tree.

    Paths are found by self-joins that double their reach: after round k a node
    knows the ancestor 2 ** k above it and the score in between, so a path of n
    turns takes log2(n) joins of slim rows. A branch's rank is its mean score,
    ties by the smallest leaf. Nodes that lie on a cycle have no root and no path.
    ``depth`` counts from the leaf, 0.
    """
    slim = nodes.select("tree", "node", "parent", "score")
    level = materialize(slim.select("node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length")))
    levels = [level]
    while level.where("up is not null").limit(1).count() and len(levels) < 62:
        up = level.select(F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("length").alias("l2"))
        if len(levels) > 1 and not _moves(levels[-2], level):
            break  # what is left runs in cycles
        level = materialize(
            level.join(up, level.up == up.n2, "left").select(
                "node", F.col("up2").alias("up"), (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"), (F.col("length") + F.coalesce("l2", F.lit(0))).alias("length")
            )
        )
        levels.append(level)
    parents = slim.where("parent is not null").select(F.col("parent").alias("p")).distinct()
    whole = slim.join(level.where("up is null"), "node").join(parents, F.col("node") == F.col("p"), "left_anti")
    ranked = whole.select("tree", "node", (F.col("total") / F.col("length")).alias("rank"))
    chosen = _top(ranked, per_tree)
    found = materialize(chosen.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth")))
    for k, jump in enumerate(levels[:-1] if len(levels) > 1 else []):
        # found holds the nodes 0 to 2 ** k - 1 above each leaf
        jump = jump.where("up is not null").select(F.col("node").alias("n2"), F.col("up").alias("u2"))
        more = found.join(jump, found.node == jump.n2).select("leaf", F.col("u2").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        found = materialize(found.union(more))
    return found


def _moves(before: DataFrame, now: DataFrame) -> bool:
    """Whether fewer nodes than before still have an ancestor out of reach."""
    return before.where("up is not null").count() > now.where("up is not null").count()


def _top(ranked: DataFrame, n: int) -> DataFrame:
    """The n best leaves of each tree: partial top-n aggregates, so a tree of many leaves isn't gathered."""
    if n == 1:
        best = ranked.groupBy("tree").agg(F.max_by("node", F.struct("rank", -F.col("node"))).alias("node"))
        return best.select("node")
    order = Window.partitionBy("tree", "part").orderBy(F.col("rank").desc(), "node")
    cut = ranked.withColumn("part", F.pmod("node", F.lit(64))).withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    last = Window.partitionBy("tree").orderBy(F.col("rank").desc(), "node")
    return cut.withColumn("k", F.row_number().over(last)).where(F.col("k") <= n).select("node")


def format_conversations(nodes: DataFrame, template: ChatTemplate = ChatTemplate(), per_tree: int = 1) -> DataFrame:
    """(conv_id, leaf, formatted, loss_mask): one row per chosen path of each reply tree.

    ``nodes`` is what ``chain_turns`` or ``reply_nodes`` give. loss_mask holds the
    code-point ranges of the assistant turns. One conversation is one output value
    and so is put together in one place; nothing larger is. Empty texts stay as
    empty turns; an empty table gives no rows.
    """
    nodes = materialize(nodes)
    paths = best_paths(nodes, per_tree)
    turns = paths.join(nodes, "node").groupBy("leaf", "tree").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("at"), "role", "text"))).alias("turns")
    )

    def run(batch):
        made, masks = [], []
        for turns in batch.column(2):
            text, mask = template.render([(t["role"], t["text"]) for t in turns.as_py()])
            made.append(text)
            masks.append([{"start": a, "end": b} for a, b in mask])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(masks, kind)], names=["conv_id", "leaf", "formatted", "loss_mask"])

    kind = nodes.schema["tree"].dataType.simpleString()
    return map_arrow(turns.select("tree", "leaf", "turns"), run, f"conv_id {kind}, leaf long, formatted string, loss_mask array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of what formatted conversations hold, read from the strings and masks alone."""
    at = {c: formatted.columns.index(c) for c in ("conv_id", "formatted", "loss_mask")}

    def run(batch):
        rows: list[tuple] = []
        for text, mask in zip(batch.column(at["formatted"]), batch.column(at["loss_mask"])):
            whole = text.as_py()
            turns = template.read(whole)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
            learned = "".join(template.unescape(whole[m["start"] : m["end"]]) for m in mask.as_py())
            rows.append((len(turns), digest, len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(whole)))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(at["conv_id"]), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return map_arrow(formatted, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_table(rows: DataFrame, template: ChatTemplate = ChatTemplate(), **columns) -> DataFrame:
    """``format_conversations`` of a table of (conv_id, turn, role, text); other columns are left out."""
    return format_conversations(chain_turns(without(rows, "leaf"), **columns), template)
