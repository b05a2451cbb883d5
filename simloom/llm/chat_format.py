"""Chat formatting into prefix trees.

Conversations that share their first turns are merged into a tree whose node is a turn in its
place; each node's text is emitted once, depth first. A pack is the output row of up to `pack`
conversations with one first turn: its text, and for every node its span in the text, parent,
loss mask, position ids (a node's positions follow its parent's last one, so siblings share
them) and the text intervals it may attend to (its ancestors and itself, neighbours joined).
Positions and spans count code points, or tokens if an `encode` function is given.

First turns (prefixes, in general) that more than `pack` conversations share are hot. A hot prefix
has a row of its own, which holds its last turn alone: one node, no leaves. The conversations below
it are split by their next turn, again and again where that prefix is hot too, so a subtree that is
not hot stays whole in one pack; small subtrees of one hot prefix share packs. Only conversations
that end with a hot prefix, equal as a whole, are dealt by their ids. A pack names the rows of its
hot prefixes, first turn first, in `roots`, and its texts start behind them; `offset` is their
length. A turn of a tree is thus emitted once, in whatever packs its conversations are. A node in a
pack attends to all of the roots' texts besides its own intervals, and its position in the tree is
`offset` plus its position in the pack. A leaf of node -1 ends with the last root.

No task gathers a hot tree whole. Packs are formed from rows sorted inside partitions and written
as they fill: a worker holds one pack at a time.

The template marks each turn by its role. Control strings inside texts and roles are escaped by
a backslash after their first character, and backslashes are doubled, so reading back is exact.

Turns are ordered by turn, role, text, nulls first, so rows that tie in all three are equal; null
text or role reads as empty; repeated rows are turns of their own. Nothing says which rows without a
conversation id belong together: each is a conversation of its own turn, with a null id. Texts of
any length are whole nodes. Columns other than the four are not looked at. No rows, no packs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN>>", "<</TURN>>")
#: Role: before and after the text.
FRAMES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
#: Other roles: the role's name comes between the first two.
OTHER = ("<<TURN>>", "\n", "<</TURN>>")
#: Conversations that share a prefix without a row of its own; those of a pack on average below a hot prefix.
PACK = 32
#: Rows of hot prefixes, with their texts, that may be broadcast.
BROADCAST_ROOTS = 20_000

_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

PACK_SCHEMA = (
    "pack string, text string, nodes array<struct<parent:int, start:int, end:int, loss_start:int, loss_end:int, position:int, attends:array<struct<start:int, end:int>>>>, "
    "leaves array<struct<conv_id:{id}, node:int>>, tokens array<int>, roots array<string>, offset int"
)


def escape(text: str, line: bool = False) -> str:
    """Reversible: no control string is left, nor (with line) a bare line feed."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:  # none begins as another one ends, so they are found one by one
        if c in text:
            text = text.replace(c, c[0] + "\\" + c[1:])
    return text.replace("\n", "\\\n") if line else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def frame(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what stands after it."""
    if role in FRAMES:
        return FRAMES[role][0], escape(text), FRAMES[role][1]
    return OTHER[0] + escape(role, line=True) + OTHER[1], escape(text), OTHER[2]


def read_turn(segment: str) -> tuple[str, str]:
    """(role, text) of one turn's formatted text. As texts hold no control string, its ends tell the role."""
    if segment.startswith(OTHER[0]) and segment.endswith(OTHER[2]):
        head = _ROLE.match(segment, len(OTHER[0]))
        if head:
            return unescape(head[1]), unescape(segment[head.end() : -len(OTHER[2])])
    for role, (before, after) in FRAMES.items():
        if segment.startswith(before) and segment.endswith(after) and len(segment) >= len(before) + len(after):
            return role, unescape(segment[len(before) : -len(after)])
    raise ValueError("not a formatted turn")


def build_pack(
    name: str, conversations: list[tuple], encode: Callable[[str], list[int]] | None = None, roots: tuple[str, ...] = (), above: tuple[tuple[str, str], ...] = ()
) -> dict:
    """One pack from (conv_id, [(role, text), ...]).

    roots are the names of the rows of the hot prefixes above it, above their turns, which the conversations leave out.
    """
    size = len if encode is None else lambda x: len(encode(x))
    offset = sum(size(part) for turn in above for part in frame(*turn))
    children: list[dict] = [{}]  # of node i - 1; at 0 those of the root
    turns: list[tuple] = []
    ends: list[list] = [[]]
    for conv, own in conversations:
        at = 0
        for turn in own:
            if turn not in children[at]:
                children[at][turn] = len(children)
                children.append({})
                ends.append([])
                turns.append(turn)
            at = children[at][turn]
        ends[at].append(conv)
    text, nodes, leaves, tokens, length = [], [], [], [], 0
    stack = [(node, -1, 0, ()) for node in reversed(children[0].values())]
    leaves += [(conv, -1) for conv in ends[0]]
    while stack:
        node, parent, position, attends = stack.pop()
        before, body, after = frame(*turns[node - 1])
        if encode is None:
            sizes = [len(before), len(body), len(after)]
        else:
            parts = [encode(x) for x in (before, body, after)]
            sizes = [len(p) for p in parts]
            tokens += [t for p in parts for t in p]
        start, end = length, length + sum(sizes)
        attends = (*attends[:-1], (attends[-1][0], end)) if attends and attends[-1][1] == start else (*attends, (start, end))
        loss = turns[node - 1][0] == "assistant"
        loss_span = (start + sizes[0], start + sizes[0] + sizes[1]) if loss else (start, start)
        here = len(nodes)
        nodes.append((parent, start, end, *loss_span, position, [{"start": a, "end": b} for a, b in attends]))
        leaves += [(conv, here) for conv in ends[node]]
        text.append(before + body + after)
        length = end
        stack += [(child, here, position + end - start, attends) for child in reversed(children[node].values())]
    keys = ("parent", "start", "end", "loss_start", "loss_end", "position", "attends")
    return {"pack": name, "text": "".join(text), "nodes": [dict(zip(keys, n, strict=True)) for n in nodes], "leaves": [{"conv_id": c, "node": n} for c, n in leaves], "tokens": tokens, "roots": list(roots), "offset": offset}


def conversations_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): turns in order, nulls as empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))))
    own = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    return rows.groupBy(F.col(conv_col).alias("conv_id"), own.alias("own_")).agg(turns.alias("turns")).select("conv_id", "turns")


def _pack_type(id_type: pa.DataType) -> pa.Schema:
    """PACK_SCHEMA in Arrow's types."""
    span = [("start", pa.int32()), ("end", pa.int32())]
    node = pa.struct([("parent", pa.int32()), *span, ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(pa.struct(span)))])
    leaf = pa.struct([("conv_id", id_type), ("node", pa.int32())])
    return pa.schema(
        [("pack", pa.string()), ("text", pa.string()), ("nodes", pa.list_(node)), ("leaves", pa.list_(leaf)), ("tokens", pa.list_(pa.int32())), ("roots", pa.list_(pa.string())), ("offset", pa.int32())]
    )


def pack_conversations(conversations: DataFrame, pack: int = PACK, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """Packs (PACK_SCHEMA) of rows (conv_id, turns), a row a conversation."""
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    # A prefix is named by a hash of the name before it and its last turn; the role's length keeps role and text apart.
    names = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda so_far, t: F.concat(so_far, F.array(F.sha2(F.concat_ws("\n", F.get(so_far, F.size(so_far) - 1), F.char_length(t["role"]).cast("string"), t["role"], t["text"]), 256).substr(1, 32))),
    )
    rows = materialise(conversations.select(F.monotonically_increasing_id().alias("row_"), "conv_id", "turns", names.alias("names")), "conversations")
    prefixes = rows.select("row_", F.posexplode("names").alias("at", "prefix"), "names").withColumn("parent", F.get("names", F.col("at") - 1))
    # One slim row a prefix; counts are summed before the shuffle. The conversation of the least row writes the prefix's row.
    hot = prefixes.groupBy("prefix").agg(F.count("*").alias("n"), F.min("row_").alias("writer"), F.max("parent").alias("parent")).filter(F.col("n") > pack)
    hot = materialise(hot, "hot-prefixes")
    below = hot.groupBy(F.col("parent").alias("above")).agg(F.sum("n").alias("below"))
    hot = hot.join(below, hot["prefix"] == below["above"], "left")
    hot = hot.select(F.col("prefix").alias("hot"), "writer", F.ceil((F.col("n") - F.coalesce("below", F.lit(0))) / pack).cast("int").alias("packs"))
    # One row for every `pack` turns at most; broadcast once counted to be few.
    hot = bounded(materialise(hot, "hot-packs"))
    found = rows.select("row_", F.posexplode("names").alias("at", "prefix")).join(hot, F.col("prefix") == F.col("hot"))
    found = found.groupBy("row_").agg(
        F.count("*").cast("int").alias("depth"),
        F.max_by("packs", "at").alias("packs"),
        F.collect_list(F.when(F.col("writer") == F.col("row_"), F.col("at"))).alias("writes"),
    )
    rows = rows.join(bounded(materialise(found, "hot-rows")), "row_", "left")
    depth = F.coalesce("depth", F.lit(0))
    # Below a hot prefix, whole subtrees are dealt over as many packs as their conversations fill.
    following = F.get("names", depth)
    deal = F.pmod(F.when(following.isNull(), F.xxhash64("row_")).otherwise(F.xxhash64(following)), F.greatest("packs", F.lit(1)))
    deal = F.when(depth > 0, deal).otherwise(0).cast("string")
    head = F.get("names", F.greatest(depth - 1, F.lit(0)))
    writes = F.coalesce("writes", F.array().cast("array<int>"))
    rows = rows.select("conv_id", "turns", F.slice("names", F.lit(1), depth).alias("roots"), writes.alias("writes"), F.concat_ws("-", head, deal).alias("pack"), "row_")
    rows = rows.repartition("pack").sortWithinPartitions("pack", "conv_id", "row_").drop("row_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, above, roots, held, done, schema = None, (), (), [], [], None
        for batch in batches:
            schema = schema or _pack_type(batch.schema.field(0).type)
            for conv, turns, names_, writes, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != name and held:
                    done.append(build_pack(name, held, encode, roots, above))
                    held = []
                turns, roots, name = [(t["role"], t["text"]) for t in turns], tuple(names_), key
                above = tuple(turns[: len(roots)])
                held.append((conv, turns[len(roots) :]))
                done += [build_pack(roots[at], [(None, [turns[at]])], encode, roots[:at], above[:at]) | {"leaves": []} for at in writes]
                if len(done) >= 200:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
        if held:
            done.append(build_pack(name, held, encode, roots, above))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return rows.mapInArrow(run, PACK_SCHEMA.format(id=id_type))


def read_packs(packs: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) read back from packs made without `encode`; best stored, as they are read thrice.

    loss is the array of unescaped texts under the loss mask, formatted_chars the length of the
    conversation's path through its roots and its pack.
    """
    leafy = F.size("leaves") > 0
    roots = packs.filter(~leafy).select(F.col("pack").alias("root"), F.col("text").alias("root_text"))
    links = packs.filter(leafy).select("pack", F.posexplode("roots").alias("at", "root")).join(bounded(roots, BROADCAST_ROOTS), "root")
    links = links.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("at", "root_text"))).alias("above"))
    nodes = F.transform("nodes", lambda n: F.struct(n["parent"].alias("parent"), n["start"].alias("start"), n["end"].alias("end"), n["loss_start"].alias("loss_start"), n["loss_end"].alias("loss_end")))
    own = packs.filter(leafy).join(links, "pack", "left").select("text", nodes.alias("nodes"), "leaves", F.coalesce(F.col("above.root_text"), F.array().cast("array<string>")).alias("above"))
    id_type = packs.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.struct([("role", pa.string()), ("text", pa.string())])
        for batch in batches:
            leaf_type = batch.schema.field(2).type.value_type.field("conv_id").type
            schema = pa.schema([("conv_id", leaf_type), ("turns", pa.list_(turn)), ("loss", pa.list_(pa.string())), ("formatted_chars", pa.int64())])
            for row in range(batch.num_rows):  # a pack at a time
                text, nodes, leaves, above = (c[row].as_py() for c in batch.columns)
                out, read = [], {}
                shared = [{"role": role, "text": said} for role, said in map(read_turn, above)]
                shared_loss = [t["text"] for t in shared if t["role"] == "assistant"]
                shared_chars = sum(map(len, above))
                for leaf in leaves:
                    path, at = [], leaf["node"]
                    while at >= 0:
                        path.append(at)
                        at = nodes[at]["parent"]
                    turns, loss, chars = list(shared), list(shared_loss), shared_chars
                    for i in reversed(path):
                        node = nodes[i]
                        if i not in read:
                            role, said = read_turn(text[node["start"] : node["end"]])
                            masked = unescape(text[node["loss_start"] : node["loss_end"]]) if node["loss_end"] > node["loss_start"] else None
                            read[i] = {"role": role, "text": said}, masked
                        turns.append(read[i][0])
                        chars += node["end"] - node["start"]
                        if read[i][1] is not None:
                            loss.append(read[i][1])
                    out.append({"conv_id": leaf["conv_id"], "turns": turns, "loss": loss, "formatted_chars": chars})
                yield pa.RecordBatch.from_pylist(out, schema)

    return own.mapInArrow(run, f"conv_id {id_type}, turns array<struct<role:string, text:string>>, loss array<string>, formatted_chars long")
