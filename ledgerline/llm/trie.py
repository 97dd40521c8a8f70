"""Prefix trie of conversations by vertical bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.positions import rank_rows

from .common import stored
from .mixture import n_words

#: Conversations of a shard: bits of a bitmap.
SHARD = 2048
#: Positions that one piece of a conversation holds; a shard covers the pieces of one such level.
LEVEL = 64
#: Parents with more than one in so many of all heads of chains are broadcast: fewer than this.
HEAVY = 1 << 16

_NODE = ("k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, words long, "
         "path long, leaves long, shared long, rep_shared long, rep_from long, ends string")
_FIELDS = [f.split()[0] for f in _NODE.split(", ")]


class Shard:
    """Bitmaps of up to SHARD pieces: bit i is the i-th piece, in order of conversation.

    postings[t] has a bit for each piece that has item t, a (depth, turn) pair; items[i] are those
    of piece i. Sums over the members of a node are popcounts: of marked members, and of the
    members in each binary digit's plane of the number that is added.
    """

    def __init__(self, pieces: list[dict]):
        self.pieces = pieces
        numbers: dict[tuple, int] = {}
        self.turns, self.postings, self.items = [], [], []
        self.ended: dict[int, int] = {}
        self.marked, self.planes = 0, []
        self.roots: dict[tuple, int] = {}
        for i, piece in enumerate(pieces):
            bit, mine = 1 << i, []
            for turn in piece["turns"]:
                key = turn["depth"], turn["z1"], turn["z2"]
                at = numbers.setdefault(key, len(numbers))
                if at == len(self.turns):
                    self.turns.append(turn)
                    self.postings.append(0)
                self.postings[at] |= bit
                mine.append(at)
            self.items.append(mine)
            self.ended[piece["length"]] = self.ended.get(piece["length"], 0) | bit
            if piece["leaf"]:
                self.marked |= bit
            shared, plane = piece["shared"], 0
            while shared:
                if plane == len(self.planes):
                    self.planes.append(0)
                if shared & 1:
                    self.planes[plane] |= bit
                shared, plane = shared >> 1, plane + 1
            if mine:
                entry = piece["e1"], piece["e2"], piece["entry_words"]
                self.roots[entry] = self.roots.get(entry, 0) | bit

    def nodes(self) -> Iterator[tuple]:
        """Depth first: each parent's bitmap meets the posting of its least member's next turn,
        which gives a child; the child's members leave, until no member goes on."""
        pieces, items = self.pieces, self.items
        stack = [(members, 0, k1, k2, words) for (k1, k2, words), members in self.roots.items()]
        while stack:
            rest, step, k1, k2, path = stack.pop()
            while rest:
                low = rest & -rest
                least = low.bit_length() - 1
                if len(items[least]) <= step:
                    rest ^= low
                    continue
                at = items[least][step]
                child = rest & self.postings[at]
                rest ^= child
                turn, piece = self.turns[at], pieces[least]
                depth, words = turn["depth"], turn["words"]
                c1, c2 = k1 ^ turn["z1"], k2 ^ turn["z2"]
                done = child & self.ended.get(depth, 0)
                single = child == low
                shared = piece["shared"] if single else sum(
                    (child & p).bit_count() << j for j, p in enumerate(self.planes))
                yield (c1, c2, None if depth == 0 else k1, None if depth == 0 else k2, depth,
                       piece["conv_id"], child.bit_count(), words, path,
                       (child & self.marked).bit_count(), shared, piece["shared"],
                       piece["from"], self._listed(done) if done else None)
                if child != done:
                    stack.append((child, step + 1, c1, c2, path + words))

    def _listed(self, members: int) -> str:
        out = []
        while members:
            low = members & -members
            out.append(str(self.pieces[low.bit_length() - 1]["conv_id"]))
            members ^= low
        return ",".join(out)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (level, conv_id) to nodes of shards."""
    held: list[dict] = []

    def done() -> Iterator[pa.RecordBatch]:
        rows = list(Shard(held).nodes())
        held.clear()
        for start in range(0, len(rows), 1 << 14):
            columns = zip(*rows[start:start + (1 << 14)], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if n == "ends" else pa.int64())
                 for n, c in zip(_FIELDS, columns, strict=True)], _FIELDS)

    for batch in batches:
        for piece in batch.to_pylist():
            if held and (len(held) == SHARD or piece["level"] != held[0]["level"]):
                yield from done()
            held.append(piece)
    if held:
        yield from done()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, rank, digest, words) of conversations(conv_id, turn, role, text).

    Turns stand by turn number, null first, then by digest; rank counts from 0. Null role or text
    is empty; rows without a conv_id belong to no conversation and are left out. The digest is the
    SHA-256 of role and text; no text is shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
        n_words(text).alias("words"))
    return rank_rows(rows, "conv_id", ["turn", "digest"], "rank").drop("turn")


def _fingerprints() -> list[Column]:
    """Two 64-bit hashes of a position and its turn. The key of a prefix is their exclusive or, so
    it needs no order and no pass over the turns one after another."""
    return [F.xxhash64("position", "digest").alias("z1"),
            F.xxhash64("digest", F.lit("second"), "position").alias("z2")]


def _by_block(convs: DataFrame, length: str) -> DataFrame:
    """One row for each block of LEVEL turns of a conversation, so that a join with the turns has
    no key of more than LEVEL of them."""
    blocks = F.greatest(F.ceil(F.col(length) / LEVEL), F.lit(1)) - 1
    return convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Rows (conv_id, length, position, z1, z2, words) of conversations that begin like the first
    of their group; one row with position 0 and without a turn for each conversation.

    turns is a written table of `numbered_turns`. Conversation c has the first h turns of
    c - c % group (all if it has fewer, none if it is absent), then its own from the h-th on, with
    h = crc32 of c in decimal, modulo most.
    """
    heads = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % group).alias("base")))
    of_base = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = heads.join(of_base, "base", "left").select(
        "conv_id", "n", "h", "base", taken.alias("taken"),
        (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = stored(convs)
    own = turns.withColumn("block", F.floor(F.col("rank") / LEVEL)).join(
        _by_block(convs, "n"), ["conv_id", "block"]).filter(F.col("rank") >= F.col("h")).select(
        "conv_id", "length", (F.col("rank") - F.col("h") + F.col("taken") + 1).alias("position"),
        "digest", "words")
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("rank") < most)).select(
        F.col("conv_id").alias("base"), "rank", "digest", "words")
    lead = convs.join(first, "base").filter(F.col("rank") < F.col("taken")).select(
        "conv_id", "length", (F.col("rank") + 1).alias("position"), "digest", "words")
    root = convs.select("conv_id", "length", F.lit(0).cast("long").alias("position"),
                        F.lit(0).cast("long").alias("z1"), F.lit(0).cast("long").alias("z2"),
                        F.lit(0).cast("long").alias("words"))
    return own.unionByName(lead).select("conv_id", "length", "position", *_fingerprints(), "words")\
        .unionByName(root)


def whole(turns: DataFrame) -> DataFrame:
    """As `rebuilt`, of the conversations as they are."""
    convs = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")))
    rows = turns.withColumn("block", F.floor(F.col("rank") / LEVEL)).join(
        _by_block(convs, "length"), ["conv_id", "block"]).select(
        "conv_id", "length", (F.col("rank") + 1).alias("position"), "digest", "words")
    zero = [F.lit(0).cast("long").alias(c) for c in ("position", "z1", "z2", "words")]
    return rows.select("conv_id", "length", "position", *_fingerprints(), "words").unionByName(
        convs.select("conv_id", "length", *zero))


def pieces(rows: DataFrame) -> DataFrame:
    """Rows of conversations in pieces of LEVEL positions, each with the key and the words of the
    prefix before it; a written table."""
    level = F.floor(F.col("position") / LEVEL)
    cut = stored(rows.groupBy("conv_id", level.alias("level")).agg(
        F.first("length").alias("length"),
        F.sort_array(F.collect_list(F.struct(F.col("position").alias("depth"), "z1", "z2",
                                             "words"))).alias("turns"),
        F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.sum("words").alias("sum")))
    # Only conversations of several pieces have a prefix before one: one small row for LEVEL turns.
    before = "(partition by conv_id order by level rows between unbounded preceding and 1 preceding)"
    entries = cut.filter(F.col("length") >= LEVEL).select(
        "conv_id", "level", F.expr(f"bit_xor(x1) over {before}").alias("e1"),
        F.expr(f"bit_xor(x2) over {before}").alias("e2"),
        F.expr(f"sum(sum) over {before}").alias("entry_words"))
    return stored(cut.drop("x1", "x2").join(entries, ["conv_id", "level"], "left").fillna(
        0, ["e1", "e2", "entry_words"]))


def _shards(cut: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Nodes of each shard. weights(conv_id, shared, from, leaf) are summed over their members."""
    if weights is None:
        cut = cut.select("*", F.lit(0).cast("long").alias("shared"),
                         F.lit(0).cast("long").alias("from"), F.lit(False).alias("leaf"))
    else:
        last = F.floor(F.col("length") / LEVEL)
        spread = weights.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        cut = cut.join(spread.drop("length"), ["conv_id", "level"])
    return cut.drop("sum").repartitionByRange("level", "conv_id").sortWithinPartitions(
        "level", "conv_id").mapInArrow(_walk, _NODE)


def _merged(shards: DataFrame) -> DataFrame:
    """One row per node from its rows of shards."""
    least = F.min(F.struct("conv_id", "rep_shared", "rep_from"))
    return shards.groupBy("k1", "k2").agg(
        least.alias("rep"), F.sum("n_convs").alias("n_convs"), F.sum("leaves").alias("n_leaves"),
        F.sum("shared").alias("shared"),
        *[F.first(c).alias(c) for c in ("p1", "p2", "depth", "words", "path")]).select(
        "*", "rep.*").drop("rep")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of shards, sorted by node and conversation, to one digest per node."""
    last, digest = None, None
    out: list[tuple] = []
    for batch in batches:
        for k1, k2, ends in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "ends")),
                                strict=True):
            if (k1, k2) != last:
                if last is not None:
                    out.append((*last, digest.hexdigest()))
                last, digest = (k1, k2), hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        if out:
            yield _digests(out)
            out = []
    if last is not None:
        yield _digests([(*last, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    k1, k2, digests = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                       pa.array(digests)], ["k1", "k2", "ends_sha256"])


def trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of all prefixes of conversations, rows as of `rebuilt` or `whole`.

    Columns conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the node's key (k1, k2). Shards of SHARD
    conversations in order of conv_id are walked by bitmaps, and their rows of a node are merged
    by its key.

    A conversation's own nodes are those whose smallest member it is: all from some depth r on.
    Each conversation counts the words of its turns above r as shared (all, if r is beyond its
    end). With that number, what a subtree saves is a sum over the node's members,
        sum of shared - shared of the smallest member - (n_convs - 1) * words above the node,
    and its leaves are the members that are the smallest of a childless node: so both need no pass
    from level to level, and a second walk adds them up.

    No conversations give no rows. Equal conversations are members of the same nodes; a
    conversation of any length is dealt in pieces of LEVEL positions. A node's list of ends is
    streamed through one task in blocks of at most SHARD ids, since a digest has one order.
    """
    cut = pieces(rows)
    nodes = stored(_merged(_shards(cut)).drop("n_leaves", "shared", "rep_shared", "rep_from"))
    kids = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(kids, ["k1", "k2"], "left").fillna(0, ["n_children"]))
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("from"), F.min("path").alias("shared"),
        F.max(F.col("n_children") == 0).alias("leaf"))
    totals = cut.groupBy("conv_id").agg(F.first("length").alias("length"),
                                        F.sum("sum").alias("all_words"))
    weights = totals.join(owners, "conv_id", "left").select(
        "conv_id", "length", F.coalesce("shared", "all_words").alias("shared"),
        F.coalesce("from", F.col("length") + 1).alias("from"),
        F.coalesce("leaf", F.lit(False)).alias("leaf"))
    shards = stored(_shards(cut, weights))
    summed = stored(_merged(shards).join(nodes.select("k1", "k2", "n_children"), ["k1", "k2"]))
    lists = shards.filter("ends is not null").select("k1", "k2", "conv_id", "ends").repartition(
        "k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(
        _ends, "k1 long, k2 long, ends_sha256 string")
    inner = summed.filter("depth > rep_from").withColumn("parent_conv_id", F.col("conv_id"))
    found = inner.unionByName(_with_parents(summed.filter("depth = rep_from"), summed))
    saved = F.col("shared") - F.col("rep_shared") - (F.col("n_convs") - 1) * F.col("path")
    none = F.lit(hashlib.sha256().hexdigest())
    return found.join(lists, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
        "k1", "k2")


def _with_parents(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Heads of chains with parent_conv_id. Parents with more than a HEAVY-th of all heads, fewer
    than HEAVY, are broadcast; the others are joined by key, none with more heads than that."""
    total = heads.count()
    parents = nodes.filter("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = parents.filter(F.col("n_children") * HEAVY > total).drop("n_children")
    light = parents.filter(F.col("n_children") * HEAVY <= total).drop("n_children")
    near = heads.join(F.broadcast(heavy), ["p1", "p2"], "left")
    # The root has no parent; its key is no parent's.
    settled = F.col("parent_conv_id").isNotNull() | (F.col("depth") == 0)
    far = near.filter(~settled).drop("parent_conv_id").join(light, ["p1", "p2"], "left")
    return near.filter(settled).unionByName(far)
