"""A trie of conversations by their turns, built as a burst trie over the cluster.

Equal conversations are counted once. A container holds the suffixes of all conversations below one trie head;
the root starts as the only one. In each round the containers that hold more turns than a limit burst: their heads
become nodes, and their suffixes move to new containers by the next turn id (by the next 2, 4, ... of them in
later rounds, so that long shared openings take few rounds; the heads between become nodes too). Containers
within the limit remain; their suffixes are sorted and swept once with a stack into nodes. What a container
counts is then added to the heads above it.

Turns are known by 128 bits of the SHA-256 of role and text; texts themselves are read once and not shuffled.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshlight.operators.materialise import materialise, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a turn id, of a container's key and of a conversation's key.
KEY = 16
#: Turns that a container may hold without bursting.
LIMIT = 2048
#: Copies of a head's row in joins, over which the rows of its container are dealt.
SALTS = 32
#: Conversation ids of one chunk of a node's list.
CHUNK = 1024


def _key(col: Column) -> Column:
    return F.unhex(F.substring(F.sha2(col, 256), 1, 2 * KEY))


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's (turn, id, chars) by turn, null first, equal turns by id.

    Null role or text is empty. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    row = F.struct(F.col("turn"), F.substring(F.sha2(body.cast("binary"), 256), 1, 2 * KEY).alias("id"), F.length(text).alias("chars"))
    return turns.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def trie_nodes(paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie over ``paths``: (conv_id, turns: array of structs with id, 32 hex digits, and chars).

    One row per distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256. A conversation without turns ends at
    the root. Ids are distinct; a repeated or null one counts as another member, null last in no list. No rows, no root.
    A conversation is one row of 20 bytes a turn; a node may have any number of members and children.
    """
    conversations = materialise(
        paths.select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("path"),
            F.transform("turns", lambda t: t["chars"].cast("int")).alias("chars"),
        )
    )
    same = conversations.groupBy("path", "chars").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    live = materialise(
        same.withColumn("sid", _key(F.col("path"))).join(_ends(conversations), "sid").select(
            F.lit(b"").alias("box"), F.lit(None).cast("binary").alias("up"), F.array().cast("array<binary>").alias("above"), "path", "chars", "n", "first", "ends"
        )
    )
    release(conversations)
    written, heads, kept, depth, step = [live], [], [], 0, 1
    while True:
        marked, burst = _mark(live, depth, limit)
        kept.append(marked.where("not big").withColumn("depth", F.lit(depth).cast("long")))
        if not burst:
            break
        written.append(marked)
        broken = marked.where("big")
        heads.append(materialise(_heads(broken, depth, step)))
        live = materialise(_children(broken, depth, step))
        written.append(live)
        depth, step = depth + step, (step if depth == 0 else 2 * step)
    swept = materialise(_sweep(kept))
    release(*written)
    if not heads:
        return swept.select(*NODE)
    top = heads[0]
    for more in heads[1:]:
        top = top.unionByName(more)
    return _joined(top, swept)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _ends(conversations: DataFrame) -> DataFrame:
    """(sid, ends): digest of the ascending ids of the conversations of one sequence, comma-joined.

    Ids are put in order in chunks of neighbouring ids, and the chunks of a sequence stream through one digest.
    """
    ids = conversations.select(_key(F.col("path")).alias("sid"), "conv_id", F.floor(F.col("conv_id") / CHUNK).alias("part"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ids.groupBy("sid", "part").agg(listed.alias("ids"))
    return chunks.repartition("sid").sortWithinPartitions("sid", "part").mapInArrow(_digests, "sid binary, ends string")


def _digests(batches):
    sid, digest = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist()):
            if key != sid:
                if sid is not None:
                    out.append((sid, digest.hexdigest()))
                sid, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield _pairs(out)
    if sid is not None:
        yield _pairs([(sid, digest.hexdigest())])


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["sid", "ends"])


def _salted(rows: DataFrame, heads: DataFrame, key: str, by: str) -> DataFrame:
    """Left join of many rows to the few heads that they share: each head meets the rows of its key in ``SALTS`` parts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    many = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return many.join(heads.withColumn("salt", salts), [key, "salt"], "left").drop("salt")


def _mark(live: DataFrame, depth: int, limit: int) -> tuple[DataFrame, bool]:
    """``live`` with ``big``, whether its container bursts; and whether any does."""
    turns = F.sum(F.size("chars") - depth + 1)
    big = live.groupBy("box").agg(turns.alias("turns"), F.count(F.lit(1)).alias("paths")).where(F.expr(f"turns > {limit} and paths > 1"))
    big = materialise(big.select("box", F.lit(True).alias("big")))
    some = bool(big.head(1))
    marked = materialise(_salted(live, big, "box", "path").withColumn("big", F.coalesce("big", F.lit(False)))) if some else live.withColumn("big", F.lit(False))
    release(big)
    return marked, some


def _below(depth: int, turns: Column) -> Column:
    """Key of the head so many turns below the container's own."""
    return _key(F.concat(F.col("box"), F.substr(F.col("path"), F.lit(KEY * depth + 1), KEY * turns)))


def _heads(broken: DataFrame, depth: int, step: int) -> DataFrame:
    """The head of each container that burst, and those down to the new containers."""
    k = F.col("k")
    rows = broken.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.size("chars") - depth, F.lit(step - 1)))))
    between = F.when(k > 1, F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: _below(depth, i))).otherwise(F.array().cast("array<binary>"))
    own = F.when(k == 0, F.array().cast("array<binary>")).otherwise(F.concat(F.array("box"), between))
    rows = rows.select(
        F.when(k == 0, F.col("box")).otherwise(_below(depth, k)).alias("new_box"),  # a name of its own: lambdas below read the old one
        F.when(k == 0, F.col("up")).when(k == 1, F.col("box")).otherwise(_below(depth, k - 1)).alias("up"),
        F.concat("above", own).alias("above"),
        (k + depth).cast("long").alias("depth"),
        F.when(k + depth > 0, F.get("chars", k + depth - 1)).otherwise(0).cast("long").alias("chars"),
        "n", "first", F.when(F.size("chars") == k + depth, F.col("ends")).alias("ends"),
    )
    return rows.withColumnRenamed("new_box", "box").groupBy("box", "up", "above", "depth", "chars").agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.max("ends").alias("ends"))


def _children(broken: DataFrame, depth: int, step: int) -> DataFrame:
    """Suffixes of containers that burst, in their new ones."""
    last = _below(depth, F.lit(step - 1)) if step > 1 else F.col("box")
    path = [F.array("box"), *([F.transform(F.sequence(F.lit(1), F.lit(step - 1)), lambda i: _below(depth, i))] if step > 1 else [])]
    return broken.where(F.size("chars") >= depth + step).select(
        _below(depth, F.lit(step)).alias("new_box"), last.alias("up"), F.concat("above", *path).alias("above"), "path", "chars", "n", "first", "ends"
    ).withColumnRenamed("new_box", "box")


def _sweep(kept: list[DataFrame]) -> DataFrame:
    """Nodes of the remaining containers; those at the top of one have the key of the head above, and all heads above."""
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("box", "depth", "up", "above", "path", "chars", "n", "first", "ends").repartition("box").sortWithinPartitions("box", "path")
    return rows.mapInArrow(
        _sweeper, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up binary, above array<binary>"
    )


_NO_ENDS = hashlib.sha256(b"").hexdigest()


class _Open:
    """A node that the sweep is still inside of."""

    __slots__ = ("chars", "n", "conv", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, chars: int):
        self.chars, self.n, self.conv, self.children, self.leaves, self.saved, self.ends = chars, 0, None, 0, 0, 0, _NO_ENDS
        self.waiting: list[list] = []  # rows of children, complete but for this node's conv_id


def _sweeper(batches):
    """Reads suffixes by container and path; the stack has the nodes on the way to the last one."""
    out: list[list] = []
    stack: list[_Open] = []
    box = path = None
    top = up = above = None  # of the container

    def close() -> None:
        node = stack.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.chars
        for child in node.waiting:
            child[2] = node.conv
        out.extend(node.waiting)
        row = [node.conv, top + len(stack), None, node.n, node.children, node.leaves, node.saved, node.ends, None, None]
        if not stack:
            row[8:] = [up, above]
            out.append(row)
            return
        parent = stack[-1]
        parent.waiting.append(row)
        parent.n += node.n
        parent.children += 1
        parent.leaves += node.leaves
        parent.saved += node.saved
        if parent.conv is None or (node.conv is not None and node.conv < parent.conv):
            parent.conv = node.conv

    for batch in batches:
        columns = {c: batch.column(c) for c in ("box", "path", "chars", "n", "first", "ends")}
        n_rows = [columns[c].to_pylist() for c in ("box", "path", "n", "first", "ends")]
        for i, (key, now, n, first, ends) in enumerate(zip(*n_rows)):
            chars = columns["chars"][i].as_py()
            if key != box:
                while stack:
                    close()
                box, path = key, None
                top, up, above = (batch.column(c)[i].as_py() for c in ("depth", "up", "above"))
            agreed = top if path is None else _agreed(path, now)
            while len(stack) > agreed - top + 1:
                close()
            for d in range(top + len(stack), len(now) // KEY + 1):
                stack.append(_Open(chars[d - 1] if d else 0))
            node = stack[-1]
            node.n, node.ends = node.n + n, ends
            node.conv = first if node.conv is None else node.conv
            path = now
        if len(out) >= 4096:
            yield _rows(out)
            out.clear()
    while stack:
        close()
    if out:
        yield _rows(out)


def _agreed(a: bytes, b: bytes) -> int:
    """Leading turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // KEY
    if a[: high * KEY] == b[: high * KEY]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * KEY] == b[: middle * KEY] else (low, middle)
    return low


def _rows(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.list_(pa.binary())]
    names = [*NODE, "up", "above"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)


def _joined(heads: DataFrame, swept: DataFrame) -> DataFrame:
    """All nodes: the heads with what lies below them, and the swept ones with the heads above the containers."""
    heads = materialise(heads)
    tops = swept.where("above is not null")
    children = heads.select("up").unionByName(tops.select("up")).where("up is not null").groupBy(F.col("up").alias("box")).agg(F.count(F.lit(1)).alias("n_children"))
    own = heads.join(children, "box", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    own = materialise(own.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))
    parts = own.select(F.concat("above", F.array("box")).alias("at"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), "saved")
    parts = parts.unionByName(tops.select(F.col("above").alias("at"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    sums = parts.select(F.explode("at").alias("box"), "leaves", "saved").groupBy("box").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    conv = heads.select(F.col("box").alias("up"), F.col("conv_id").alias("parent"))
    whole = _salted(own.drop("saved").join(sums, "box"), conv, "up", "box").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256")
    )
    placed = _salted(tops, conv, "up", "conv_id").withColumn("parent_conv_id", F.col("parent"))
    return whole.unionByName(placed.select(*NODE)).unionByName(swept.where("above is null").select(*NODE))


def with_shared_openings(lists: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, turns) with the first h turns of each conversation c replaced by those of c - c % ``every``.

    h is crc32 of the decimal id modulo ``most`` + 1; fewer or none where that conversation has fewer or is absent.
    % takes the sign of c, as in SQL. A window holds fewer than 2 * ``every`` conversations, as ids are distinct.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most))
    met = lists.withColumn("base", base).withColumn("opening", F.max(own).over(Window.partitionBy("base")))
    rest = F.slice(F.col("turns"), h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    opening = F.coalesce(F.slice(F.col("opening"), F.lit(1), h), F.slice(F.col("turns"), 1, 0))
    return met.select("conv_id", F.concat(opening, rest).alias("turns"))
