"""Parent-child links to full hierarchies, by bottom-up leaf peeling.

Each round takes off the nodes without remaining children (a layer); they send their subtree size and the rows of their
descendants to their parent, where sizes are added up (combined on the map side, so fan-out is no limit). What can
never be peeled is exactly the set of nodes on a cycle, since a node has one parent. Then the
layers are put back in reverse order, each node taking depth and root from its parent; of what is placed only nodes
with children still to be placed are read again.

While more nodes remain than ``local_rows`` a round is a distributed job over the remaining nodes
alone. The rest, which holds all ancestors of its own nodes, is peeled on in one task of that
bounded size. Where rounds take off less than one node in ``THIN`` (long chains), the rest is resolved by
doubling instead: nodes look 1, 2, 4 ... levels up, so a chain of n nodes costs log n rounds.

Rounds hold 64-bit numbers in place of ids, and no paths: these can be many times the size of the links. They are spelled
once, at the end, where the nodes of a tree come by depth, so a task holds two levels' paths. Trees of more than
``PIECE_ROWS`` nodes are taken apart: the subtrees of at most so many nodes, and above them the top. Paths are arrays of ids, so an id may hold any character.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.common import cut, present

LOCAL_ROWS = 20_000
THIN = 20
#: Nodes of a tree that one task spells.
PIECE_ROWS = 200_000
#: Ids of paths that a task holds at once.
IDS_AT_ONCE = 200_000
#: Depths of nodes on and below a cycle.
ON, BELOW = -1, -2


@dataclass
class Peeled:
    """Layers of peeled nodes (id, parent, size, lowest: the first round in which a child was peeled), lowest first, the labelled rest (root, depth besides), and the number of all nodes."""

    layers: list[DataFrame]
    core: DataFrame
    n: int


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peel the nodes of one task to the end and label them."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    table = pa.Table.from_batches(some)
    ids, parents, size, pending = (table.column(c).to_pylist() for c in ("id", "parent", "size", "pending"))
    at = {v: i for i, v in enumerate(ids)}
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    ready, order = [i for i, n in enumerate(pending) if n == 0], []
    while ready:
        i = ready.pop()
        order.append(i)
        p = up[i]
        if p >= 0:
            size[p] += size[i]
            pending[p] -= 1
            if pending[p] == 0:
                ready.append(p)
    root, depth = [None] * len(ids), [ON] * len(ids)
    for i in reversed(order):
        p = up[i]
        if p < 0:
            root[i], depth[i] = ids[i], 0
        elif depth[p] >= 0:
            root[i], depth[i] = root[p], depth[p] + 1
        else:
            depth[i] = BELOW
    kind = table.schema.field("id").type
    done = pa.table([table.column("id"), table.column("parent"), pa.array(size, pa.int64()), table.column("lowest"), pa.array(root, kind), pa.array(depth, pa.int32())], names=["id", "parent", "size", "lowest", "root", "depth"])
    yield from done.combine_chunks().to_batches()


def _label(rows: DataFrame, root: Column, depth: Column) -> DataFrame:
    return rows.select("id", "parent", "size", "lowest", root.alias("root"), depth.cast("int").alias("depth"))


def _tidy(spark: SparkSession) -> None:
    """Spark deletes shuffles and checkpoints of earlier rounds when the driver collects its garbage; a small driver seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _climb(live: DataFrame, n: int) -> DataFrame:
    """Look 1, 2, 4 ... levels up from each node, with log2 n rounds at most: ``up`` is the ancestor so many levels above or, when
    there is none, NULL and then ``far`` the topmost and ``hops`` its distance; ``size`` is the weight of all nodes less
    than that far below."""
    live = cut(live.select("id", "parent", "lowest", "size", F.col("parent").alias("up"), F.col("id").alias("far"), F.lit(0).cast("long").alias("hops")))
    for k in range(max(n, 1).bit_length()):
        told = live.filter("up IS NOT NULL").groupBy(F.col("up").alias("to")).agg(F.sum("size").alias("more"))
        above = live.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("far").alias("beyond"), F.col("hops").alias("further"))
        live = cut(
            live.join(told, live["id"] == told["to"], "left")
            .join(above, live["up"] == above["at"], "left")
            .select("id", "parent", "lowest", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.col("next").alias("up"), F.coalesce("beyond", "far").alias("far"), F.when(F.col("at").isNull(), F.col("hops")).otherwise(F.col("further") + 2**k).alias("hops"))
        )
        _tidy(live.sparkSession)
        if live.filter("up IS NOT NULL").isEmpty():
            break
    return live


def _double(live: DataFrame, n: int) -> DataFrame:
    """Label the nodes by climbing. Nodes that still have an ancestor when n levels are passed are on or below a cycle; those that are such ancestors are on it."""
    live = _climb(live, n)
    on = live.filter("up IS NOT NULL").select(F.col("up").alias("c")).distinct()
    looped = live.filter("up IS NOT NULL").join(on, F.col("id") == F.col("c"), "left")
    out = _label(looped, F.lit(None).cast(live.schema["id"].dataType), F.when(F.col("c").isNotNull(), ON).otherwise(BELOW))
    return out.unionByName(_label(live.filter("up IS NULL"), F.col("far"), F.col("hops")))


def latest_links(rows: DataFrame, node: str, parent: str, version: str) -> DataFrame:
    """(id, parent) of every present node id by its row of the greatest version; of equal versions the
    greatest parent counts. parent is NULL where it is absent or names no node."""
    last = rows.filter(present(rows[node])).groupBy(rows[node].alias("id")).agg(F.max(F.struct(rows[version].alias("v"), rows[parent].alias("p"))).alias("r")).select("id", F.when(present(F.col("r.p")), F.col("r.p")).alias("p"))
    known = last.select(F.col("id").alias("parent"))
    return last.join(known, last["p"] == known["parent"], "left").select("id", "parent")


def peel(links: DataFrame, *, local_rows: int = LOCAL_ROWS, thin: int = THIN) -> Peeled | None:
    """Take off layer after layer of nodes without remaining children, and label the rest. None where two rows have the same id."""
    kind = links.schema["id"].dataType.simpleString()
    children = links.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    live = cut(links.join(children, "id", "left").select("id", "parent", F.lit(1).cast("long").alias("size"), F.coalesce("n", F.lit(0)).cast("long").alias("pending"), F.lit(None).cast("int").alias("lowest")))
    if not live.groupBy("id").count().filter("count > 1").isEmpty():
        return None
    layers: list[DataFrame] = []
    n = None
    while True:
        left = live.agg(F.count("*").alias("n"), F.count_if(F.col("pending") == 0).alias("ready")).first()
        n = left.n if n is None else n
        if left.n <= local_rows or left.ready * thin < left.n:
            break
        # of the nodes before this round only the layer is kept
        layer = cut(live.filter(F.col("pending") == 0).drop("pending"))
        told = layer.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        live = cut(live.filter(F.col("pending") > 0).join(told, "id", "left").select("id", "parent", (F.col("size") + F.coalesce("s", F.lit(0))).alias("size"), (F.col("pending") - F.coalesce("n", F.lit(0))).alias("pending"), F.coalesce("lowest", F.when(F.col("n") > 0, len(layers))).alias("lowest")))
        layers.append(layer)
        _tidy(live.sparkSession)
    if left.n <= local_rows:
        core = live.coalesce(1).mapInArrow(_finish, f"id {kind}, parent {kind}, size long, lowest int, root {kind}, depth int")
    elif left.ready:
        core = _double(live.drop("pending"), left.n)
    else:
        core = _label(live, F.lit(None).cast(kind), F.lit(ON))
    return Peeled(layers, cut(core) if layers else core, n)


def _numbered(links: DataFrame, salt: int) -> DataFrame:
    return links.select(_number("id", salt).alias("id"), F.when(F.col("parent").isNotNull(), _number("parent", salt)).alias("parent"))


def _number(c: str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col(c))


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the nodes of whole pieces, which come by depth: a parent's path is one of the level before, or stands in ``head``.
    A node on or below a cycle has two rows, the first (without size) with its parent's name."""
    kind = None
    ats, names, parents, sizes, depths, flat, ends = [], [], [], [], [], [], [0]

    def told() -> pa.RecordBatch:
        text = pa.string()
        arrays = [pa.array(ats, kind), pa.array(names, text), pa.array(parents, text), pa.array(sizes, pa.int64()), pa.array(depths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, text))]
        for x in (ats, names, parents, sizes, depths, flat):
            x.clear()
        ends[:] = [0]
        return pa.RecordBatch.from_arrays(arrays, names=["at", "name", "parent", "size", "depth", "ids"])

    piece, level, above, here, held = None, None, {}, {}, None
    for b in batches:
        kind = b.schema.field("id").type
        for its, depth, i, up, size, name, head in zip(*(b.column(c).to_pylist() for c in ("piece", "depth", "id", "parent", "size", "name", "head"))):
            if size is None:
                held = name
                continue
            if depth < 0:
                path, parent = (), held
            else:
                if its != piece:
                    piece, level, above, here = its, depth, {}, {}
                elif depth != level:
                    level, above, here = depth, here, {}
                before = head if head is not None else above[up] if up is not None else []
                path, parent = [*before, name], before[-1] if before else None
                if size > 1:
                    here[i] = path
            for x, v in ((ats, i), (names, name), (parents, parent), (sizes, size), (depths, depth)):
                x.append(v)
            flat.extend(path)
            ends.append(len(flat))
            if len(flat) + len(ends) >= IDS_AT_ONCE:
                yield told()
    if ats:
        yield told()


def _spelled(rows: DataFrame) -> DataFrame:
    """(at, name, parent, size, depth, ids) of rows (piece, depth, id, parent, size, name, head)."""
    kind = rows.schema["id"].dataType.simpleString()
    return rows.repartition("piece").sortWithinPartitions("piece", "depth", F.col("size").asc_nulls_first()).mapInArrow(_spell, f"at {kind}, name string, parent string, size long, depth int, ids array<string>")


def _named(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Rows for ``_spelled``: nodes (piece, head besides) with their names, and the names of parents of those that aren't rooted."""
    asked = nodes.withColumn("at", F.col("id")).unionByName(nodes.filter("depth < 0").withColumns({"at": F.col("parent"), "size": F.lit(None).cast("long")}))
    return asked.join(names, "at").select("piece", "depth", "id", "parent", "size", "name", "head")


def resolve_hierarchy(rows: DataFrame, *, node: str = "id", parent: str = "parent_id", version: str = "updated_at", local_rows: int = LOCAL_ROWS, thin: int = THIN, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per node: id, parent, state (rooted, on_cycle, below_cycle), root, depth, n_below, path, ids (the path as an array).

    For nodes that aren't rooted root and path are '', ids is empty, depth and n_below -1. Repeated rows and older
    versions are dropped; NULL and '' ids are no nodes; an absent or unknown parent makes a root; a
    node that is its own parent is on a cycle. An empty table gives no rows. Ids may be of any length and hold '/'; only ``path``, which
    joins them by it, is then ambiguous. Jobs: one per layer while more than ``local_rows`` nodes remain and a layer takes off one
    in ``thin`` of them, then one task, or log n rounds.
    """
    links, salt = latest_links(rows, node, parent, version), 0
    # parents are matched as strings before they are numbered, so a number stands for one id as soon as no two nodes share it
    while (peeled := peel(_numbered(links, salt), local_rows=local_rows, thin=thin)) is None:
        salt += 1
    ids = rows.filter(present(rows[node])).select(rows[node].alias("id"))
    names = ids.select(_number("id", salt).alias("at"), F.col("id").alias("name")).groupBy("at").agg(F.min("name").alias("name"))
    nodes = placed(peeled).select("id", "parent", "size", "root", "depth").withColumns({"piece": F.coalesce("root", "id"), "head": F.lit(None).cast("array<string>")})
    tops = [x.filter("parent IS NULL").agg(F.max("size").alias("s")) for x in [*peeled.layers, peeled.core]] if peeled.n > piece_rows else []
    if any((t.first().s or 0) > piece_rows for t in tops):
        out = _spelled_by_pieces(cut(nodes), names, piece_rows, peeled.n)
    else:
        out = _spelled(_named(nodes, names))
    rooted = F.col("depth") >= 0
    return out.select(
        F.col("name").alias("id"),
        "parent",
        F.when(rooted, "rooted").when(F.col("depth") == ON, "on_cycle").otherwise("below_cycle").alias("state"),
        F.coalesce(F.get("ids", F.lit(0)), F.lit("")).alias("root"),
        F.when(rooted, F.col("depth")).otherwise(F.lit(-1)).cast("int").alias("depth"),
        F.when(rooted, F.col("size") - 1).otherwise(F.lit(-1)).cast("int").alias("n_below"),
        F.array_join("ids", "/").alias("path"),
        "ids",
    )


def _spelled_by_pieces(nodes: DataFrame, names: DataFrame, piece_rows: int, n: int) -> DataFrame:
    """Nodes with more than ``piece_rows`` below, the top of their trees, are spelled first; each subtree under them is a piece that takes its parent's path as head."""
    small = nodes.filter(f"depth < 0 OR size <= {piece_rows}")
    big = nodes.filter(f"depth >= 0 AND size > {piece_rows}")
    top = cut(_spelled(_named(big, names)))
    over = cut(big.select("root").distinct()).withColumnRenamed("root", "of")
    under = small.join(over, small["root"] == over["of"], "left_semi")
    ends = top.select(F.col("at").alias("end"), F.col("ids").alias("start"))
    stubs = under.join(ends.select("end"), under["parent"] == ends["end"], "left").select("id", F.when(F.col("end").isNull(), F.col("parent")).alias("parent"), F.lit(None).cast("int").alias("lowest"), F.lit(1).cast("long").alias("size"))
    of = _climb(stubs, n).select(F.col("id").alias("mine"), F.col("far"))
    pieces = under.drop("piece", "head").join(of, F.col("id") == F.col("mine"))
    # only the topmost node of a piece takes the path above it
    heads = pieces.filter("id = far").select("id", "parent").join(ends, F.col("parent") == F.col("end")).select(F.col("id").alias("first"), F.col("start").alias("head"))
    pieces = pieces.join(heads, F.col("id") == F.col("first"), "left").select("id", "parent", "size", "root", "depth", F.col("far").alias("piece"), "head")
    rest = small.join(over, small["root"] == over["of"], "left_anti")
    return top.unionByName(_spelled(_named(rest.unionByName(pieces), names)))


def placed(peeled: Peeled) -> DataFrame:
    """The layers put back on the labelled rest, in reverse order: id, parent, size, lowest, root, depth."""
    done, open_ = [peeled.core], peeled.core.filter("lowest IS NOT NULL")
    for number in range(len(peeled.layers) - 1, -1, -1):
        above = open_.select(F.col("id").alias("__up"), F.col("root").alias("r"), F.col("depth").alias("d"))
        layer = peeled.layers[number]
        joined = layer.join(above, layer["parent"] == above["__up"], "left")
        top = F.col("parent").isNull()
        some = _label(joined, F.when(top, F.col("id")).otherwise(F.col("r")), F.when(top, 0).when(F.col("d") >= 0, F.col("d") + 1).otherwise(F.lit(BELOW)))
        if number:
            some = cut(some)
            _tidy(some.sparkSession)
            # of what is placed, nodes whose first child was peeled in an earlier round than the next layer's still have some to come
            open_ = open_.unionByName(some.filter("lowest IS NOT NULL")).filter(F.col("lowest") < number)
        done.append(some)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def descendants(rows: DataFrame, *, node: str = "id", parent: str = "parent_id", version: str = "updated_at", local_rows: int = LOCAL_ROWS, thin: int = THIN) -> DataFrame:
    """(ancestor, descendant, distance) for every rooted node and each node above it, as the peel collects them.

    A layer's nodes send themselves and the rows of their descendants to their parents; what reaches the rest is spread over
    the paths in it. The nodes below another come as rows, never as one list, so a root over a third of all nodes is no
    large row. Nodes on and below cycles have no rows.
    """
    peeled = peel(latest_links(rows, node, parent, version), local_rows=local_rows, thin=thin)
    kept: list[DataFrame] = []
    carried = None  # rows of nodes not yet peeled
    for layer in peeled.layers:
        own = layer.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("ancestor"), F.col("id").alias("descendant"), F.lit(1).alias("distance"))
        if carried is None:
            carried = own
            continue
        here = layer.select(F.col("id").alias("ancestor"), F.col("parent").alias("__up"))
        split = cut(carried.join(here.withColumn("__peeled", F.lit(True)), "ancestor", "left"))
        kept.append(split.filter("__peeled").select("ancestor", "descendant", "distance"))
        sent = split.filter("__peeled AND __up IS NOT NULL").select(F.col("__up").alias("ancestor"), "descendant", (F.col("distance") + 1).alias("distance"))
        carried = split.filter("__peeled IS NULL").select("ancestor", "descendant", "distance").unionByName(sent).unionByName(own)
    core = peeled.core.filter("depth >= 0").select(F.col("root").alias("piece"), "depth", "id", "parent", "size", F.col("id").alias("name"), F.lit(None).cast("array<string>").alias("head"))
    steps = _spelled(core).select(F.col("at").alias("id"), "depth", F.posexplode("ids").alias("level", "ancestor")).select("ancestor", F.col("id").alias("holder"), (F.col("depth") - F.col("level")).alias("up"))
    kept.append(steps.filter("up > 0").select("ancestor", F.col("holder").alias("descendant"), F.col("up").alias("distance")))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    if carried is not None:
        reached = carried.withColumnRenamed("ancestor", "holder").join(steps, "holder").select("ancestor", "descendant", (F.col("distance") + F.col("up")).alias("distance"))
        loose = carried.join(peeled.core.filter("depth < 0").select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
        # subtrees that hang on a cycle are taken out of what was kept
        out = out.unionByName(reached)
        if not loose.isEmpty():
            below = cut(loose.select("descendant").distinct())
            out = out.join(below, "descendant", "left_anti").select("ancestor", "descendant", "distance")
    return out.withColumn("distance", F.col("distance").cast("int"))
