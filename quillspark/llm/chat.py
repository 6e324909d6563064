"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share the nodes of these turns.
The nodes are laid out depth first in one stream: shared tokens occur once,
each node carries the position its first token has within its conversation and
the stream intervals of its ancestors, which are all that it may attend to
besides itself.  Tokens are code points here; a tokenizer's counts can be put
in their place.

To lay the tree out, different conversations are sorted by the digests of
their prefixes over the whole cluster.  In that order a conversation's new nodes
are those after the longest prefix shared with the one before, which is depth
first order.  Only the first conversation of each sorted partition, and where
its prefix lies, is settled on the driver.

The layout is made from digests and lengths alone.  A node's text is taken
from the conversation that brought it into the tree, in the one shuffle that
carries texts; a conversation is read back from the nodes it brought, which lie
in the same place, and the few that others did.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, keyed, written

#: A turn is ``<|role|>\n`` text ``</s>\n``; these never occur within a text.
OPEN, MID, END = "<|", "|>\n", "</s>\n"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    r"""Control strings broken by ``\.``; a backslash is doubled."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, r"<(?=\||/?s>)|\|(?=>)|\[(?=/?INST\])", r"$0\\.")
    return out


def unescaped(text: str) -> str:
    r"""The inverse of :func:`escaped`."""
    return "\\".join(part.replace("\\.", "") for part in text.split("\\\\"))


HEAD = 24  # characters of a text that order turns of one number and role


def _piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(MID), escaped(text), F.lit(END))


def _digest(piece: Column) -> Column:
    return F.unhex(F.left(F.sha2(piece, 256), F.lit(32)))


def _turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, own, turn, role, text)``; rows without a conversation are one each, named by what they say."""
    src = keyed(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).na.fill("", ["role", "text"])
    alone = F.concat(F.lit("n"), F.left(F.sha2(_piece(F.col("role"), F.col("text")), 256), F.lit(32)))
    return src.withColumn("own", F.when(F.col("conv_id").isNull(), alone).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string"))))


def _packed(turns: DataFrame) -> DataFrame:
    """``(conv_id, own, keys, tokens)``: digests and lengths of each conversation's turns in order."""
    piece = _piece(F.col("role"), F.col("text"))
    turn = F.struct("turn", "role", F.left("text", F.lit(HEAD)).alias("head"), _digest(piece).alias("key"), F.length(piece).alias("tokens"))
    held = turns.where("conv_id is not null").groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(turn)).alias("ts"))
    alone = turns.where("conv_id is null").select("conv_id", "own", F.array(turn).alias("ts"))
    return held.union(alone).select("conv_id", "own", F.col("ts.key").alias("keys"), F.col("ts.tokens").alias("tokens"))


def _chained(packed: DataFrame) -> DataFrame:
    """``(conv_id, own, chain, tokens)``, ``chain`` being the digest of each prefix."""

    def rows(batch):
        chains = []
        for keys in batch.column("keys").to_pylist():
            chain, above = [], b""
            for key in keys:
                above = hashlib.sha256(above + key).digest()[:16]
                chain.append(above)
            chains.append(chain)
        return {"conv_id": batch.column("conv_id"), "own": batch.column("own"), "chain": pa.array(chains, pa.list_(pa.binary())), "tokens": batch.column("tokens")}

    return arrow_map(packed, rows, f"conv_id {packed.schema['conv_id'].dataType.simpleString()}, own string, chain array<binary>, tokens array<int>")


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
NODE = "part int, at long, depth int, first boolean, node binary, parent binary, own string, tokens int, position long, ancestors array<struct<start:long,end:long>>"


def _laid_out(batches):
    """The new nodes of sorted conversations; positions count from the partition's start."""
    part, at, before, stack, first = TaskContext.get().partitionId(), 0, [], [], True
    for batch in batches:
        out = []
        for own, chain, tokens in zip(batch.column("own").to_pylist(), batch.column("chain").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            shared = 0
            while shared < min(len(before), len(chain)) and before[shared] == chain[shared]:
                shared += 1
            del stack[shared:]
            for depth in range(shared, len(chain)):
                position, spans = (stack[-1][1], stack[-1][2]) if stack else (0, [])
                out.append((part, at, depth, first, chain[depth], chain[depth - 1] if depth else None, own, tokens[depth], position, [{"start": s, "end": e} for s, e in spans]))
                end = at + tokens[depth]
                joined = [*spans[:-1], (spans[-1][0], end)] if spans and spans[-1][1] == at else [*spans, (at, end)]
                stack.append((at, position + tokens[depth], joined))
                at = end
            before, first = chain, False
        if out:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.list_(SPAN)]
            names = ["part", "at", "depth", "first", "node", "parent", "own", "tokens", "position", "ancestors"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def tree(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stream's layout, the pieces of its nodes, and each conversation's nodes.

    Layout: ``node, parent, depth, start, end`` (in the stream), ``position``
    (of the first token), ``ancestors`` (merged stream intervals in order),
    ``own`` (which conversation brought it).  Pieces: ``own, node, depth``,
    ``piece`` (formatted turn), ``loss_start, loss_end`` (within the piece;
    equal outside assistant turns).  Conversations: ``conv_id, chain`` (their
    nodes from the first turn on).  Layout and pieces have a row for each node.

    Turns are ordered by number, then role, then the first 24 characters, then
    digest; a null turn number comes first, null roles and texts are empty, a
    row with a null conversation is a conversation by itself, repeated rows are
    repeated turns.  Texts may be of any length; an empty table has no nodes.
    """
    turns = _turns(df, **columns)
    packed = written(_chained(_packed(turns)), "conversations")
    different = packed.withColumn("leaf", F.element_at("chain", -1)).dropDuplicates(["leaf"])
    raw = written(different.select("own", "chain", "tokens").orderBy("chain").mapInArrow(_laid_out, NODE), "layout")

    # what the first conversation of a partition shares with earlier ones is there already
    heads = written(raw.where("first").select("part", "node").withColumnRenamed("part", "head"), "heads")
    again = raw.select("part", "at", "node", "tokens").join(heads, "node").where("part <= head").groupBy("head", "node").agg(F.min(F.struct("part", "at", "tokens")).alias("was"), F.max(F.when(F.col("part") == F.col("head"), F.col("at"))).alias("at")).collect()
    total = {r["part"]: r["n"] for r in raw.groupBy("part").agg(F.sum("tokens").cast("long").alias("n")).collect()}
    moved: dict[int, list] = {p: [] for p in total}
    for r in again:
        if r["was"]["part"] < r["head"]:
            moved[r["head"]].append((r["at"], r["was"]["tokens"], r["was"]["part"], r["was"]["at"]))
    shift, offset = {}, 0
    for p in sorted(total):
        dropped = sum(t for _, t, _, _ in moved[p])
        shift[p] = offset - dropped
        offset += total[p] - dropped
    twice = {p: {at: (shift[q] + there, tokens) for at, tokens, q, there in m} for p, m in moved.items()}

    def placed(batches):
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out: dict[str, list] = {n: [] for n in ("node", "parent", "depth", "start", "end", "position", "ancestors", "own")}
            for i, (p, at) in enumerate(zip(cols["part"], cols["at"], strict=True)):
                if at in twice[p]:
                    continue
                spans: list[list[int]] = []
                for s in cols["ancestors"][i]:
                    here, end = s["start"], s["end"]
                    while here < end:  # what lies in earlier partitions comes piece by piece
                        there, tokens = twice[p].get(here, (here + shift[p], end - here))
                        if spans and spans[-1][1] == there:
                            spans[-1][1] = there + tokens
                        else:
                            spans.append([there, there + tokens])
                        here += tokens
                start = at + shift[p]
                values = cols["node"][i], cols["parent"][i], cols["depth"][i], start, start + cols["tokens"][i], cols["position"][i], [{"start": s, "end": e} for s, e in spans], cols["own"][i]
                for n, v in zip(out, values, strict=True):
                    out[n].append(v)
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(SPAN), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    layout = raw.mapInArrow(placed, "node binary, parent binary, depth int, start long, end long, position long, ancestors array<struct<start:long,end:long>>, own string")
    return layout, _pieces(turns, layout), packed.select("conv_id", "chain")


def _pieces(turns: DataFrame, layout: DataFrame) -> DataFrame:
    """``(own, node, depth, piece, loss_start, loss_end)`` of every node, from its conversation's turns."""
    alone = turns.where("conv_id is null").groupBy("own").agg(F.min("turn").alias("turn"), F.min("role").alias("role"), F.min("text").alias("text"))
    rows = turns.where("conv_id is not null").select("own", "turn", "role", "text").union(alone)
    order = lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.left(t["text"], F.lit(HEAD)).alias("head"), _digest(_piece(t["role"], t["text"])).alias("key"), t["text"].alias("text"))
    texts = rows.groupBy("own").agg(F.collect_list(F.struct("turn", "role", "text")).alias("ts")).select("own", F.array_sort(F.transform("ts", order)).alias("ts"))
    brought = layout.groupBy("own").agg(F.collect_list(F.struct("depth", "node")).alias("nodes"))
    each = texts.join(brought, "own").select("own", "ts", F.explode("nodes").alias("n"))
    turn = each.select("own", "n.node", "n.depth", F.expr("ts[n.depth]").alias("t")).select("own", "node", "depth", "t.role", "t.text")
    begin = F.length(escaped(F.col("role"))) + len(OPEN) + len(MID)
    learned = F.when(F.col("role") == LEARNED, F.length(escaped(F.col("text")))).otherwise(0)
    return turn.select("own", "node", "depth", _piece(F.col("role"), F.col("text")).alias("piece"), begin.alias("loss_start"), (begin + learned).alias("loss_end"))


def _read(pieces: list[dict]) -> tuple[list[dict], str, int]:
    """Turns, the text under the loss mask, and the length of one conversation's pieces."""
    turns, under, n = [], [], 0
    for p in pieces:
        role, _, rest = p["piece"][len(OPEN) :].partition(MID)
        turns.append({"role": unescaped(role), "text": unescaped(rest[: -len(END)])})
        under.append(unescaped(p["piece"][p["loss_start"] : p["loss_end"]]))
        n += len(p["piece"])
    return turns, "".join(under), n


def read_back(layout: DataFrame, pieces: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(leaf, turns, loss, formatted_chars)`` of each different conversation, from the tree alone.

    ``leaf`` is the last node of its chain.  ``turns`` are ``(role, text)``
    parsed from the pieces and unescaped; ``loss`` is what lies under the loss
    mask, unescaped and joined.  Ancestors that another conversation brought
    are fetched by node; all others lie where the conversation's own pieces are.
    """
    part = F.struct("depth", "node", "piece", "loss_start", "loss_end")
    chains = conversations.select(F.element_at("chain", -1).alias("leaf"), "chain").dropDuplicates(["leaf"])
    later = layout.groupBy("own").agg(F.max(F.struct("depth", "node"))["node"].alias("leaf"), F.min("depth").alias("lent")).where("lent > 0")
    lent = written(later.join(chains, "leaf").select("own", F.explode(F.slice("chain", F.lit(1), F.col("lent"))).alias("node")), "lent")
    fetched = lent.join(pieces.drop("own").join(lent.select("node").distinct(), "node", "left_semi"), "node").groupBy("own").agg(F.collect_list(part).alias("lent"))
    held = pieces.groupBy("own").agg(F.collect_list(part).alias("ps")).join(fetched, "own", "left")
    whole = held.select(F.array_sort(F.concat("ps", F.coalesce("lent", F.expr("slice(ps, 1, 0)")))).alias("ps"))

    def rows(batch):
        found = [_read(ps) for ps in batch.column("ps").to_pylist()]
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        leaves = [ps[-1]["node"] for ps in batch.column("ps").to_pylist()]
        return {"leaf": pa.array(leaves, pa.binary()), "turns": pa.array([f[0] for f in found], kind), "loss": pa.array([f[1] for f in found], pa.string()), "formatted_chars": pa.array([f[2] for f in found], pa.int64())}

    return arrow_map(whole, rows, "leaf binary, turns array<struct<role:string,text:string>>, loss string, formatted_chars long")


def told(conversations: DataFrame, read: DataFrame) -> DataFrame:
    """``read``'s columns for every conversation: ``(conv_id, ...)``."""
    return conversations.select("conv_id", F.element_at("chain", -1).alias("leaf")).join(read, "leaf").drop("leaf")
