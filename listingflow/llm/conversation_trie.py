"""The prefix trie of conversations, by union-find over sorted neighbours.

Conversations are sequences of turn digests. In sorted order the common prefix of two neighbours is an edge, and edges are
taken from the deepest up: the two components that an edge joins become one at that depth, and every such merge makes or widens a
branching node. Between merges a component is a chain of nodes, which are final once the chain is left.

A task does so block by block over its range of the order. Nodes that hold neither its first nor its last conversation
are final; what is left of the range is two paths with what hangs on each node. Such contracted forests are merged with
those of the ranges beside them, in rounds of a bounded number per task, until one is left. Children that were final before their
parent find its smallest member by a join with the nodes of such paths.

A conversation longer than ``SEGMENT`` turns goes on in further rows, each below the node where the row before it ends; the
tries of later segments are made first and hang what they sum up on that node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingflow.llm.common import stored, word_count

#: Turns that a row of digests holds at most.
SEGMENT = 1024
#: Turns that are merged at once, and contracted ranges that one task merges.
BLOCK = 100_000
FAN = 64
#: A conversation goes on from the one whose id is the next lower multiple.
FAMILY = 20
#: Member ids in a piece of a list that is hashed later.
PIECE = 1000

_DIGEST = 16
_TOP = bytes(_DIGEST)
_NODE, _PIECE, _PATH, _ROOT = range(4)
_STATS = ("n", "low", "kids", "leaves", "saved")
_SCHEMA = ("kind int, part long, place int, root binary, keys binary, words array<long>, next binary, depths array<int>, "
           + ", ".join(f"{c} array<long>" for c in _STATS)
           + ", id binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
             "n_leaves long, saved_tokens long, ends string, first long, members string")
_COLUMNS = pa.schema([
    ("kind", pa.int32()), ("part", pa.int64()), ("place", pa.int32()), ("root", pa.binary()), ("keys", pa.binary()),
    ("words", pa.list_(pa.int64())), ("next", pa.binary()), ("depths", pa.list_(pa.int32())),
    *((c, pa.list_(pa.int64())) for c in _STATS), ("id", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("first", pa.int64()), ("members", pa.string())])


# --- contraction ----------------------------------------------------------------------------------------

class _Node:
    """What is known of a node: members, the smallest, and sums over what hangs on it. ``shared``: known elsewhere too."""

    __slots__ = ("n", "low", "kids", "leaves", "saved", "ends", "final", "shared")

    def __init__(self, n=0, low=None, kids=0, leaves=0, saved=0, shared=False):
        self.n, self.low, self.kids, self.leaves, self.saved, self.shared = n, low, kids, leaves, saved, shared
        self.ends: list[int] = []
        self.final: list[dict] = []

    def count(self, n: int, low: int | None, kids: int, leaves: int, saved: int) -> None:
        self.n += n
        if low is not None and (self.low is None or low < self.low):
            self.low = low
        self.kids += kids
        self.leaves += leaves
        self.saved += saved

    def add(self, other: _Node) -> None:
        self.count(other.n, other.low, other.kids, other.leaves, other.saved)
        self.ends += other.ends
        self.final += other.final
        self.shared |= other.shared


class _Item:
    """A row of the order: a sequence of digests with the words of each turn, and what is known of nodes on it, by depth."""

    __slots__ = ("root", "keys", "words", "next", "known")

    def __init__(self, root: bytes, keys: bytes, words: list[int], next_: bytes | None, known: dict[int, _Node]):
        self.root, self.keys, self.words, self.next, self.known = root, keys, words, next_, known

    def id(self, depth: int) -> bytes:
        """What names the node of this depth in every task: a later segment starts from the name of its last node."""
        if depth == 0:
            return self.root
        if self.next is not None and depth == len(self.words):
            return self.next
        return hashlib.md5(self.root + self.keys[:depth * _DIGEST]).digest()


def _common(a: _Item, b: _Item) -> int:
    """The depth of the node where two neighbours part; -1 if they are in different tries."""
    if a.root != b.root:
        return -1
    short = min(len(a.keys), len(b.keys))
    if a.keys[:short] == b.keys[:short]:
        return short // _DIGEST
    at = 0
    while a.keys[at:at + _DIGEST] == b.keys[at:at + _DIGEST]:
        at += _DIGEST
    return at // _DIGEST


class _Component:
    """Neighbours that share a node of ``depth``; ``above`` has what is known of nodes nearer to the root."""

    __slots__ = ("depth", "node", "above", "item", "path")

    def __init__(self, item: _Item, path: dict[int, _Node] | None):
        self.item, self.path, self.above = item, path, dict(item.known)
        self.depth = len(item.words)
        self.node = self.above.pop(self.depth, None) or _Node()


def contract(items: list[_Item], segment: int, level: int, open_: bool) -> tuple[list[dict], list[dict], list[_Item]]:
    """(final nodes, pieces of member lists, what is left) of neighbours in sorted order.

    If ``open_``, more neighbours may follow on both sides, so nodes on the first and last row stay; they are left as one or two
    rows, where a node on both is known on the first only. Else every node is final.
    """
    nodes: list[dict] = []
    pieces: list[dict] = []
    paths: list[dict[int, _Node]] = [{}, {}]
    last = len(items) - 1
    components = [_Component(item, paths[0] if open_ and i == 0 else paths[1] if open_ and i == last else None)
                  for i, item in enumerate(items)]
    leader = list(range(len(items)))

    def find(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    def cut(ends: list[int], id_: bytes) -> None:
        for start in range(0, len(ends), PIECE):
            part = ends[start:start + PIECE]
            pieces.append({"kind": _PIECE, "id": id_, "first": part[0], "members": ",".join(map(str, part))})

    def leave(c: _Component) -> dict | None:
        """Ends the node a component is at: kept for later if on an open path, else final and returned."""
        node, depth = c.node, c.depth
        if c.path is not None:
            if node.n:
                id_ = c.item.id(depth)
                for row in node.final:
                    row["parent"] = id_
                if node.ends:
                    cut(node.ends, id_)
                node.ends, node.final, node.shared = [], [], True
                c.path[depth] = node
            return None
        if depth == 0 and level:
            for row in node.final:
                row["parent"] = c.item.root
            row = {"kind": _ROOT, "root": c.item.root, "conv_id": node.low, "n_children": node.kids, "n_leaves": node.leaves,
                   "saved_tokens": node.saved}
            nodes.append(row)
            return row
        words = c.item.words[depth - 1] if depth else 0
        named = node.shared or depth == segment
        row = {"kind": _NODE, "id": c.item.id(depth) if named else None, "depth": level * segment + depth, "conv_id": node.low,
               "n_convs": node.n, "n_children": node.kids, "n_leaves": node.leaves if node.kids else 1,
               "saved_tokens": node.saved + (node.n - 1) * words, "ends": None}
        if not node.shared:
            row["ends"] = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        elif node.ends:
            cut(node.ends, row["id"])
        for child in node.final:
            child["parent_conv_id"] = node.low
        nodes.append(row)
        return row

    def lift(c: _Component, depth: int) -> None:
        while c.depth > depth:
            row = leave(c)
            below, c.node = c.node, c.above.pop(c.depth - 1, None) or _Node()
            c.depth -= 1
            if row is not None:
                c.node.count(below.n, below.low, 1, row["n_leaves"], row["saved_tokens"])
                c.node.final.append(row)

    edges = [(_common(items[i - 1], items[i]), i) for i in range(1, len(items))]
    for depth, i in sorted((e for e in edges if e[0] >= 0), key=lambda e: (-e[0], e[1])):
        left, right = find(i - 1), find(i)
        a, b = components[left], components[right]
        lift(a, depth)
        lift(b, depth)
        leader[right] = left
        a.node.add(b.node)
        if len(a.above) < len(b.above):
            a.above, b.above = b.above, a.above
        for at, node in b.above.items():
            if at in a.above:
                a.above[at].add(node)
            else:
                a.above[at] = node
        if a.path is None:
            a.path, a.item = b.path, b.item
    for i in range(len(items)):
        if leader[i] == i:
            lift(components[i], 0)
            leave(components[i])
    if not open_ or not items:
        return nodes, pieces, []
    left = [_Item(item.root, item.keys, item.words, item.next, path)
            for item, path in ((items[0], paths[0]), (items[last], paths[1]))]
    return nodes, pieces, left[:1] if last == 0 else left


# --- tasks ----------------------------------------------------------------------------------------------

def _rows(found: Iterable[dict]) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in found], f.type) for f in _COLUMNS], schema=_COLUMNS)


def _path_row(item: _Item, part: int, place: int) -> dict:
    depths = sorted(item.known)
    row = {"kind": _PATH, "part": part, "place": place, "root": item.root, "keys": item.keys, "words": item.words,
           "next": item.next, "depths": depths}
    return row | {c: [getattr(item.known[d], c) for d in depths] for c in _STATS}


def _read_path(row: dict) -> _Item:
    known = {d: _Node(*stats, shared=True) for d, *stats in zip(row["depths"], *(row[c] for c in _STATS), strict=True)}
    return _Item(row["root"], row["keys"], row["words"], row["next"], known)


def _read_row(row: dict) -> _Item:
    node = _Node(1, row["conv_id"], row["kids"], row["leaves"], row["saved"])
    if row["ends"]:
        node.ends.append(row["conv_id"])
    return _Item(row["root"], row["keys"], row["words"], row["next"], {len(row["words"]): node})


def _over_ranges(segment: int, level: int, block: int):
    """The final nodes of a sorted range and its contracted forest, block by block."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        part, held, size, left = None, [], 0, []
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                for row in batch.slice(start, 1000).to_pylist():
                    part = row["part"]
                    held.append(_read_row(row))
                    size += 1 + len(row["words"])
                    if size >= block:
                        nodes, pieces, left = contract([*left, *held], segment, level, True)
                        yield _rows(nodes + pieces)
                        held, size = [], 0
        if held:
            nodes, pieces, left = contract([*left, *held], segment, level, True)
            yield _rows(nodes + pieces)
        if left:
            yield _rows(_path_row(item, part, i) for i, item in enumerate(left))

    return run


def _over_paths(segment: int, level: int, last: bool):
    """Contracted forests of neighbouring ranges merged; nothing is left open in the ``last`` round."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        def merged() -> pa.RecordBatch:
            nodes, pieces, left = contract(held, segment, level, not last)
            return _rows([*nodes, *pieces, *(_path_row(item, at, i) for i, item in enumerate(left))])

        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != at:
                    if held:
                        yield merged()
                    at, held = row["group"], []
                held.append(_read_path(row))
        if held:
            yield merged()

    return run


def _forest(rows: DataFrame, segment: int, level: int, block: int, fan: int) -> list[DataFrame]:
    """The written results of all rounds over root, keys, words, next, ends, conv_id, kids, leaves and saved."""
    order = ("root", "keys", "conv_id")
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    rounds = [stored(ranges.mapInArrow(_over_ranges(segment, level, block), _SCHEMA), "trie")]
    while True:
        paths = rounds[-1].where(F.col("kind") == _PATH)
        most = paths.agg(F.max("part").alias("most")).first()["most"]
        if most is None:
            return rounds
        last = most < fan
        grouped = paths.withColumn("group", F.floor(F.col("part") / fan).cast("long"))
        rounds.append(stored(grouped.repartition("group").sortWithinPartitions("group", "part", "place")
                             .mapInArrow(_over_paths(segment, level, last), _SCHEMA), "trie-merged"))
        if last:
            return rounds


def _member_hashes(pieces: DataFrame) -> DataFrame:
    """id and ``hash`` of the pieces of each id in order; a task streams them, and holds one at a time."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for id_, members in zip(batch.column("id").to_pylist(), batch.column("members").to_pylist(), strict=True):
                if id_ != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = id_, hashlib.sha256(members.encode())
                else:
                    digest.update(b"," + members.encode())
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())],
                                             names=["id", "hash"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=["id", "hash"])

    return pieces.select("id", "first", "members").repartition("id").sortWithinPartitions("id", "first") \
        .mapInArrow(run, "id binary, hash string")


# --- conversations ----------------------------------------------------------------------------------------

def _borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("long")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ``total`` turns, ``at`` (from 1), digest and words of every rebuilt turn; ``at`` is null for a turnless one.

    Turns go by ``turn`` (null first), then by digest. They are numbered by ranges of the order of all turns, each shifted by
    those before it, so that a conversation with much of the table is many tasks' work. Rows without a
    conv_id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _DIGEST)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"),
        word_count(text).alias("words"), F.monotonically_increasing_id().alias("tie"))
    order = ("turn", "digest", "tie")
    ranges = stored(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    pieces = ranges.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    lengths = stored(pieces.groupBy("conv_id").agg(F.sum("n").alias("length")), "lengths")
    first = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    sized = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY) \
        .withColumn("skip", _borrowed_turns(F.col("conv_id"))).join(first, "base", "left") \
        .withColumn("borrowed", F.least("skip", F.coalesce("base_length", F.lit(0)))) \
        .withColumn("total", F.col("borrowed") + F.greatest(F.col("length") - F.col("skip"), F.lit(0)))
    sized = stored(sized.select("conv_id", "base", "skip", "borrowed", "total"), "conversations")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n") \
        .join(sized.drop("base"), "conv_id")
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    placed = stored(ranges.withColumn("nth", F.row_number().over(inside)).join(shifted, ["conv_id", "part"]).select(
        "conv_id", "skip", "borrowed", "total", (F.col("before") + F.col("nth")).alias("place"), "digest", "words"), "placed")
    own = placed.where("place > skip").select(
        "conv_id", "total", (F.col("place") - F.col("skip") + F.col("borrowed")).alias("at"), "digest", "words")
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < 4)).select(
        F.col("conv_id").alias("base"), F.col("place").alias("at"), "digest", "words")
    taken = heads.join(sized, "base").where("at <= skip").select("conv_id", "total", "at", "digest", "words")
    turnless = sized.where("total = 0").select("conv_id", "total", F.lit(None).cast("long").alias("at"),
                                               F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("words"))
    return own.unionByName(taken).unionByName(turnless)


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, ``level``, root, keys, words, ``next`` and ``ends`` of every run of ``segment`` turns."""
    level = F.coalesce(F.floor((F.col("at") - 1) / segment), F.lit(0)).cast("int")
    turn = F.when(F.col("at").isNotNull(), F.struct("at", "digest", "words"))
    rows = turns.groupBy("conv_id", level.alias("level")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(turn)).alias("turns")).select(
        "conv_id", "level", "total", F.unhex(F.array_join("turns.digest", "")).alias("keys"), F.col("turns.words").alias("words"))
    rows = stored(rows, "segments")

    def name(over: Window) -> Column:
        parts = [F.bit_xor(F.xxhash64(F.lit(k), "level", "keys")).over(over) for k in (1, 2)]
        return F.concat(*[F.unhex(F.lpad(F.hex(x), 16, "0")) for x in parts])

    upto = Window.partitionBy("conv_id").orderBy("level")
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    top = F.lit(_TOP)
    short = rows.where(F.col("total") < segment).withColumns({"root": top, "next": F.lit(None).cast("binary")})
    long = rows.where(F.col("total") >= segment).withColumns({
        "root": F.when(F.col("level") == 0, top).otherwise(name(earlier)),
        "next": F.when(F.size("words") == segment, name(upto.rowsBetween(Window.unboundedPreceding, 0)))})
    return short.unionByName(long).select(
        "conv_id", "level", "root", "keys", "words", "next", (F.col("total") <= (F.col("level") + 1) * segment).alias("ends"))


def trie(conversations: DataFrame, segment: int = SEGMENT, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    Null roles and texts are empty. Rows that share conv_id and turn are turns one after the other, by their digest. Rows
    without a conv_id are left out; a conv_id below zero goes on from the next multiple of the family towards zero. A
    conversation that is left without a turn is a member of the root, which is there unless no row has a conv_id. Other columns
    are ignored. Digests have 128 bits. Texts are read once and not shuffled.

    A node that holds much of the table is summed up by range. Only the hash of its list of members has to be
    one task's, as the hash function goes through them in order: it streams pieces of ``PIECE`` ids.
    """
    rows = stored(segments(rebuilt(conversations), segment), "sequences")
    top = rows.agg(F.max("level").alias("top")).first()["top"]
    rounds: list[DataFrame] = []
    hanging = None
    for level in range(top if top is not None else -1, -1, -1):
        here = rows.where(F.col("level") == level)
        none = F.lit(0).cast("long")
        if hanging is None:
            here = here.withColumns({c: none for c in ("kids", "leaves", "saved")})
        else:
            # What goes on below a node is counted with its smallest member that goes on.
            here = here.join(hanging, "conv_id", "left").withColumns({c: F.coalesce(c, none) for c in ("kids", "leaves", "saved")})
        made = _forest(here, segment, level, block, fan)
        hanging = reduce(DataFrame.union, made).where(F.col("kind") == _ROOT).select(
            "conv_id", F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        rounds += made
    if not rounds:
        rounds = [conversations.sparkSession.createDataFrame([], _SCHEMA)]
    every = reduce(DataFrame.union, rounds)
    nodes = every.where(F.col("kind") == _NODE).select(
        "id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    named = nodes.where("id is not null").select(F.col("id").alias("parent"), F.col("conv_id").alias("found"))
    late = nodes.where("parent is not null").join(named, "parent").withColumn("parent_conv_id", F.col("found")).drop("found")
    nodes = nodes.where("parent is null").unionByName(late)
    hashes = _member_hashes(every.where(F.col("kind") == _PIECE))
    gathered = nodes.where("ends is null").join(hashes, "id", "left") \
        .withColumn("ends", F.coalesce("hash", F.sha2(F.lit("").cast("binary"), 256))).drop("hash")
    return nodes.where("ends is not null").unionByName(gathered).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
