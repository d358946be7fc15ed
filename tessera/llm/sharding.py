"""Sharding by a k-d tree over document metadata, with DataFrame operations alone."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tessera.llm.common import materialise, release, utf8

SHARDS = 16
#: Steps of a histogram by which a median is found, and how often a step is divided again.
STEPS, ROUNDS = 2048, 3
#: About how many rows of a shard one task numbers.
ROWS_PER_SLOT_GROUP = 200_000
#: Coordinates are whole numbers from -1 to below this, so that no difference of two overflows.
SPAN = 1 << 62


def coordinates(docs: DataFrame, dimensions: list[str]) -> list[Column]:
    """One whole number per dimension, null the lowest; whole numbers keep their order, all else its order as text.

    Whole numbers count from the least one on; if they span more than SPAN, four neighbours have one coordinate.

    A text counts by the seven bytes after what all texts of the dimension begin with, so a shared prefix
    (``https://www.``) takes no room. Texts that agree in those too have one coordinate.
    """
    whole = {d for d in dimensions if isinstance(docs.schema[d].dataType, (ByteType, ShortType, IntegerType, LongType))}
    texts = [d for d in dimensions if d not in whole]
    value = {d: F.col(d).cast("long") if d in whole else F.col(d).cast("string").cast("binary") for d in dimensions}
    r = docs.agg(*[f(value[d]).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))]).first()
    # What the least and the greatest text begin with, all between them do.
    shared = {d: len(os.path.commonprefix([bytes(r[f"lo_{d}"] or b""), bytes(r[f"hi_{d}"] or b"")])) for d in texts}

    def place(d: str) -> Column:
        if d in whole:
            low, high = r[f"lo_{d}"] or 0, r[f"hi_{d}"] or 0
            near = F.col(d).cast("long") - F.lit(low) if high - low < SPAN else F.shiftright(F.col(d).cast("long"), 2) + F.lit(SPAN // 2)
            return F.coalesce(near, F.lit(-1).cast("long"))
        head = F.rpad(F.hex(F.substring(F.col(d).cast("string").cast("binary"), shared[d] + 1, 7)), 14, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("long") + 1, F.lit(0).cast("long"))

    return [place(d) for d in dimensions]


@dataclass
class Node:
    """A box of the tree: the leaves below it, and where it is cut."""

    id: int
    leaves: int
    weight: int
    dimension: int = -1
    #: Coordinate and tie value of the last row that goes left.
    cut: tuple[int, int] = (0, 0)
    low: int = 0
    high: int = 0
    before: int = 0
    tie: bool = False
    children: list[Node] = field(default_factory=list)


def _pick(node: Node, values: list[Column]) -> Column:
    return values[node.dimension]


def _at(nodes: list[Node], make) -> Column:
    """make(node) for the node that a row is in."""
    return F.coalesce(*[F.when(F.col("node") == n.id, make(n)) for n in nodes])


def _choose(rows: DataFrame, nodes: list[Node], root: list[tuple[int, int]] | None, k: int) -> list[tuple[int, int]]:
    """Set each node's weight and its widest dimension, against the extent at the root."""
    extent = [f(f"x{d}").alias(f"{n}{d}") for d in range(k) for n, f in (("lo", F.min), ("hi", F.max))]
    found = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("weight"), *extent).collect()}
    if root is None:
        r = found.get(0)
        root = [(r[f"lo{d}"], r[f"hi{d}"]) if r else (0, 0) for d in range(k)]
    for n in nodes:
        r = found.get(n.id)
        n.weight = int(r.weight) if r else 0
        width = [(r[f"hi{d}"] - r[f"lo{d}"]) / max(1, root[d][1] - root[d][0]) if r else 0.0 for d in range(k)]
        n.dimension = max(range(k), key=lambda d: (width[d], -d))
        n.low, n.high = (r[f"lo{n.dimension}"], r[f"hi{n.dimension}"]) if r else (0, 0)
        n.before, n.tie = 0, False
    return root


def _descend(rows: DataFrame, nodes: list[Node], coords: list[Column], tie: Column) -> None:
    """Narrow each node's cut to one value of its dimension, and among the rows of that value to one tie value.

    A round sums sizes over STEPS steps between low and high for all nodes of the
    level at once, so that only STEPS sums a node reach the driver.
    """
    active = [n for n in nodes if n.weight > 0]
    while active:
        value = _at(active, lambda n: tie if n.tie else _pick(n, coords))
        inside = _at(active, lambda n: (_pick(n, coords) == n.cut[0]) & tie.between(n.low, n.high) if n.tie else _pick(n, coords).between(n.low, n.high))
        step = _at(active, lambda n: F.expr("1L") * F.floor(((tie if n.tie else _pick(n, coords)) - F.lit(n.low)) / F.lit(max(1, -(-(n.high - n.low + 1) // STEPS)))).cast("long"))
        sums = rows.where(inside).groupBy("node", step.alias("step")).agg(F.sum("size").alias("size"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        by_node: dict[int, list] = {}
        for r in sums.collect():
            by_node.setdefault(r.node, []).append(r)
        after = []
        for n in active:
            # The left child gets its share of the leaves; with two equal halves this is the weighted median.
            goal = n.weight * (n.leaves // 2) / n.leaves
            run = n.before
            for r in sorted(by_node[n.id], key=lambda r: r.step):
                last = r
                if run + r.size > goal:
                    break
                run += r.size
            if last.lo < last.hi:
                n.before, n.low, n.high = run, last.lo, last.hi
                after.append(n)
            elif n.tie:
                # One tie value: it goes where the sizes come nearer to the goal.
                n.cut = (n.cut[0], last.lo if run + last.size - goal < goal - run else last.lo - 1)
            else:
                n.before, n.cut, n.tie, n.low, n.high = run, (last.lo, 0), True, -(1 << 62), 1 << 62
                after.append(n)
        active = after


def kd_tree(docs: DataFrame, dimensions: list[str], leaves: int = SHARDS) -> DataFrame:
    """docs (doc_id, text and the dimensions) as rows (doc_id, size, text_crc32, tie, node), node in 0 to leaves - 1.

    A box is cut along the dimension in which it is widest, against the whole
    table, at the weighted median of that dimension; boxes are cut until each
    holds the target, an even share of all bytes.
    """
    body = utf8()
    narrow = docs.select(
        "doc_id",
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        # Rows of equal text follow each other; a shift keeps the value clear of overflow.
        F.shiftright(F.xxhash64(body), 2).alias("tie_text"),
        F.shiftright(F.xxhash64("doc_id", F.monotonically_increasing_id()), 2).alias("tie_row"),
        *[c.alias(f"x{k}") for k, c in enumerate(coordinates(docs, dimensions))],
        F.lit(0).alias("node"),
    )
    rows = materialise(narrow, "rows")
    # The high half of a tie value is the text's, the low half the row's.
    tie = F.shiftleft(F.shiftright(F.col("tie_text"), 31), 31) + F.col("tie_row").bitwiseAND(F.lit((1 << 31) - 1))
    k = len(dimensions)
    coords = [F.col(f"x{d}") for d in range(k)]
    nodes, root, place = [Node(0, leaves, 0)], None, F.lit(0)
    while any(n.leaves > 1 for n in nodes):
        placed = rows.withColumn("node", place)
        root = _choose(placed, nodes, root, k)
        open_ = [n for n in nodes if n.leaves > 1]
        _descend(placed, open_, coords, tie)
        after, branch = [], []
        for n in nodes:
            if n.leaves == 1:
                branch.append(F.when(place == n.id, F.lit(len(after))))
                after.append(Node(len(after), 1, 0))
                continue
            x = _pick(n, coords)
            left = (x < n.cut[0]) | ((x == n.cut[0]) & (tie <= n.cut[1]))
            branch.append(F.when(place == n.id, F.when(left, F.lit(len(after))).otherwise(F.lit(len(after) + 1))))
            after += [Node(len(after), n.leaves // 2, 0), Node(len(after) + 1, n.leaves - n.leaves // 2, 0)]
        before, rows = rows, materialise(rows.withColumn("node", F.coalesce(*branch)), "rows")
        release(before)
        nodes, place = after, F.col("node")
    return rows.select("doc_id", "size", "text_crc32", tie.alias("tie"), "node")


def shard_documents(docs: DataFrame, dimensions: list[str] | None = None, shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs.

    Law ``bytes``: the shards' sizes are as near to equal as whole documents allow.
    size counts the text's UTF-8 bytes and one more. Slots run from 0 without gaps
    within a shard. Dimensions are metadata columns of docs, by default source,
    lang and n_chars, as far as they exist.

    Null text has no bytes: size 1 and checksum 0, like an empty text. A null
    coordinate is the lowest. Rows that are equal in a cut's dimension are divided by
    a hash of the text and then of the row, so one value may hold all rows, and
    copies of one text mostly stay together. Equal rows are told apart by a number given on
    reading, so one row repeated many times is divided too. Other columns are ignored; an empty table gives no rows.
    """
    if dimensions is None:
        dimensions = [c for c in ("source", "lang", "n_chars") if c in docs.columns] or ["doc_id"]
    rows = kd_tree(docs, dimensions, shards)
    # Slots: rows are numbered in groups by tie value, and groups start where the ones before them end.
    groups = max(16, -(-rows.count() // (shards * ROWS_PER_SLOT_GROUP)))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("tie"), F.lit(groups)))
    counts = rows.groupBy("node", "group").agg(F.count("*").alias("n"))
    starts = counts.select("node", "group", (F.sum("n").over(Window.partitionBy("node").orderBy("group")) - F.col("n")).alias("start"))
    number = F.row_number().over(Window.partitionBy("node", "group").orderBy("tie", "doc_id", "size", "text_crc32")) - 1
    slots = rows.withColumn("number", number).join(starts, ["node", "group"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").alias("shard"),
        (F.col("start") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
