"""Parent-child rows of unknown depth as full hierarchies.

Connected components of the parent links (over hashes of the nodes; leaves are
left out, as each shares the component of its parent) bring every tree or cycle
together.  A task walks whole components by an iterative depth-first search
with node colours, which gives roots, depths, descendants and, by its back
edges, cycles; one stack holds the path of the node at hand, and rows leave in
batches of bounded size.  A component of more than ``max_component`` nodes is
never brought to one task: pointer doubling gives the same rows for its nodes.

Defined cases: repeated rows of a node are one node (of differing parents the
least counts); a null node is ignored; a parent without a row ends the chain,
so its child is a root; a node that is its own parent is a cycle of one;
nodes on a cycle, or whose chain runs into one, have no root, depth or path
and carry the least node of that cycle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.lineage import counted, cut, drop_path
from plaza.operators.components import connected_components
from plaza.operators.skew import collect_hot, lookup_join

#: Nodes of the largest component that one task walks.
MAX_COMPONENT = 250_000
#: Rows gathered before a task walks the whole components among them, and ids of paths in one batch of output.
WALK_ROWS, PATH_IDS = 50_000, 1_000_000
#: Fewer rows than this are joined without looking for hot keys first.
FEW_ROWS = 200_000


def _hot(df: DataFrame, keys: list[str], rows: int) -> list[tuple]:
    return collect_hot(df, keys) if rows > FEW_ROWS else []


def parent_links(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, parent): one row per node; the parent is null where it is null or has no row."""
    one = df.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent"))
    one, _, n = counted(one, "links", rows=F.count(F.lit(1)))
    known = one.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    joined = lookup_join(one, known, ["parent"], _hot(one, ["parent"], n["rows"]), ["node"])
    return joined.select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _double(state: DataFrame, fixed: DataFrame, rows: int) -> DataFrame:
    """One doubling: every open node of ``state`` (so many rows) jumps over the node it points at."""
    step = fixed.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("done").alias("_done"), F.col("low").alias("_low"), F.col("up").alias("_up"))
    out = lookup_join(state, step, ["ptr"], _hot(state, ["ptr"], rows), ["node"])
    return out.select(
        "node", F.col("_ptr").alias("ptr"), F.col("_done").alias("done"), F.least("low", "_low").alias("low"), F.concat("up", "_up").alias("up")
    )


def _rings(open_: DataFrame, rows: int) -> tuple[DataFrame, list[str]]:
    """(node, cycle) of nodes (so many) of which each is on a cycle or below one.

    They go on doubling until no least node seen changes: then every node has
    seen the whole of its cycle, and the node it points at lies on it.
    """
    paths = []
    state, changed = open_, 1
    while changed:
        step = _double(state, state, rows).join(state.select("node", F.col("low").alias("_was")), "node")
        state, path, n = counted(step, "cycle", rows=F.count(F.lit(1)), changed=F.count_if(F.col("low") != F.col("_was")))
        state = state.drop("_was")
        paths.append(path)
        changed = n["changed"]
    turn = state.select(F.col("node").alias("ptr"), F.col("low").alias("cycle"))
    return lookup_join(state.select("node", "ptr"), turn, ["ptr"], _hot(state, ["ptr"], rows), ["node"]).select("node", "cycle"), paths


def ancestors(links: DataFrame, paths: bool = False) -> DataFrame:
    """(node, root, cycle, up): the root of each node, or the least node of the cycle its chain runs into.

    ``up`` lists the ancestors from the parent to the root where ``paths`` is
    set, and is empty otherwise.  Each round halves the distance to the root;
    when a round closes no node, those left are on or below cycles.
    """
    kind = links.schema["node"].dataType.simpleString()
    empty = F.array().cast(f"array<{kind}>")
    up = F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(empty) if paths else empty
    not_done = F.count(F.when(~F.col("done"), 1))
    state, path, n = counted(
        links.select("node", F.coalesce("parent", "node").alias("ptr"), F.col("parent").isNull().alias("done"), F.col("node").alias("low"), up.alias("up")), "up", open=not_done
    )
    used, open_n = [path], n["open"]
    closed = [state.filter("done")]
    while open_n:
        fixed = state.filter("NOT done")
        for c in closed:
            fixed = fixed.unionByName(c)
        state, path, n = counted(_double(state.filter("NOT done"), fixed, open_n), "up", open=not_done)
        used.append(path)
        closed.append(state.filter("done"))
        if n["open"] == open_n:
            break
        open_n = n["open"]
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    out = out.select("node", F.col("ptr").alias("root"), F.lit(None).cast(kind).alias("cycle"), "up")
    if open_n:
        ring, more = _rings(state.filter("NOT done"), open_n)
        used += more
        out = out.unionByName(ring.select("node", F.lit(None).cast(kind).alias("root"), "cycle", empty.alias("up")))
    result = cut(out, "ancestors")
    for p in used:
        drop_path(links.sparkSession, p)
    return result


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def walk(up: list[int]) -> tuple[list[int], list[int], list[int], list[list[int]], list[int]]:
    """Depth-first walk of whole components with node colours; ``up`` is each node's parent, or -1.

    Returns the nodes below roots in the order in which they are entered, and
    for each node its depth (-1 without root) and number of descendants; the
    cycles, and for each node the number of the cycle it is on or runs into (-1
    for none).
    """
    n = len(up)
    white, grey, black = 0, 1, 2
    colour = bytearray(n)
    child, sibling = [-1] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        if up[i] >= 0:
            sibling[i] = child[up[i]]
            child[up[i]] = i
    order: list[int] = []
    depth, below = [-1] * n, [0] * n
    for root in range(n):
        if up[root] >= 0:
            continue
        at, d = root, 0
        while True:
            colour[at] = grey
            order.append(at)
            depth[at] = d
            if child[at] >= 0:
                at, d = child[at], d + 1
                continue
            while True:  # leave nodes until one has a sibling not yet entered
                colour[at] = black
                if at == root:
                    break
                below[up[at]] += below[at] + 1
                if sibling[at] >= 0:
                    break
                at, d = up[at], d - 1
            if at == root:
                break
            at = sibling[at]
    cycles: list[list[int]] = []
    cycle = [-1] * n
    for start in range(n):  # what no root reaches runs into a cycle: follow the parents until a grey node closes it
        chain, at = [], start
        while colour[at] == white:
            colour[at] = grey
            chain.append(at)
            at = up[at]
        if not chain:
            continue
        if colour[at] == grey:  # a back edge
            cycle[at] = len(cycles)
            cycles.append(chain[chain.index(at):])
        for i in chain:
            colour[i] = black
            cycle[i] = cycle[at]
    return order, depth, below, cycles, cycle


def _walked(schema: pa.Schema, table: pa.Table, paths: bool) -> Iterator[pa.RecordBatch]:
    node = table.column(1).combine_chunks()
    up = pc.fill_null(pc.index_in(table.column(2), value_set=node), -1).to_numpy().astype(np.int64)
    parent = node.take(pa.array(up, mask=up < 0))
    order, depth, below, cycles, cycle = walk(up.tolist())
    least = [min(ring, key=lambda i: node[i].as_py()) for ring in cycles]
    ring = np.array([*least, -1], np.int64)[np.array(cycle, np.int64)]
    cyclic = np.flatnonzero(ring >= 0)
    entered, deep = np.array(order, np.int64), np.array(depth, np.int64)
    ends = np.cumsum(deep[entered] + 1)
    stack = np.zeros(int(deep.max(initial=0)) + 1, np.int64)
    i = 0
    while i < len(entered):  # nodes below roots, in the order of the walk
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PATH_IDS, side="right"))) if paths else len(entered)
        own = entered[i:j]
        root, path = np.empty(len(own), np.int64), []
        for k, (at, d) in enumerate(zip(own.tolist(), deep[own].tolist(), strict=True)):
            stack[d] = at
            root[k] = stack[0]
            if paths:
                path.append(stack[: d + 1].copy())
        cols = [node.take(pa.array(own)), parent.take(pa.array(own)), node.take(pa.array(root))]
        none = pa.nulls(len(own), node.type)
        if paths:
            offsets = pa.array(np.concatenate([[0], np.cumsum(deep[own] + 1)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, node.take(pa.array(np.concatenate(path))))
            cols += [pa.array(deep[own].astype(np.int32)), lists, pa.array(np.array(below, np.int64)[own])]
        yield pa.RecordBatch.from_arrays([*cols, none], schema=schema)
        i = j
    if len(cyclic):
        own = pa.array(cyclic)
        empty = [pa.nulls(len(cyclic), schema.field(k).type) for k in range(2, len(schema) - 1)]
        yield pa.RecordBatch.from_arrays([node.take(own), parent.take(own), *empty, node.take(pa.array(ring[cyclic]))], schema=schema)


def _walk_batches(schema: pa.Schema, batches: Iterator[pa.RecordBatch], paths: bool) -> Iterator[pa.RecordBatch]:
    """Walks over whole components of rows (component, node, parent) sorted by component."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= WALK_ROWS:
            t = pa.Table.from_batches(held)
            comp = t.column(0).to_numpy()
            keep = int(np.searchsorted(comp, comp[-1]))
            if keep:
                yield from _walked(schema, t.slice(0, keep), paths)
            held = t.slice(keep).to_batches()
            rows = t.num_rows - keep
    if held:
        yield from _walked(schema, pa.Table.from_batches(held), paths)


def forests(parts: dict[str, tuple[DataFrame, str, str]], paths: bool = True, max_component: int = MAX_COMPONENT) -> dict[str, DataFrame]:
    """For each (table, node, parent) of ``parts``: (node, parent, root, depth, path, n_descendants, cycle), one row per node.

    ``path`` runs from the root to the node.  ``n_descendants`` is null on and
    below cycles.  Without ``paths``, depth, path and n_descendants are left
    out.  The components of all tables are found together.
    """
    placed: dict[str, tuple[DataFrame, int]] = {}
    edges = None
    for i, (name, (df, node, parent)) in enumerate(parts.items()):
        one = df.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent"))
        own, above = F.xxhash64(F.lit(i), "node"), F.when(F.col("parent") != F.col("node"), F.xxhash64(F.lit(i), "parent"))
        table, _, n = counted(one.withColumns({"h": own, "p": above}), "links", rows=F.count(F.lit(1)))
        placed[name] = table, n["rows"]
        part = table.filter("p IS NOT NULL").select("h", "p")
        edges = part if edges is None else edges.unionByName(part)
    inner = edges.join(edges.select(F.col("p").alias("h")).distinct(), "h", "left_semi")
    found = cut(connected_components(inner, "h", "p").select(F.col("node").alias("k"), "component"), "found")
    out = {}
    for name, (table, rows) in placed.items():
        keyed = table.select("node", "parent", F.coalesce("p", "h").alias("k"))
        known = lookup_join(keyed, found, ["k"], _hot(keyed, ["k"], rows), ["node"])
        known, _, n = counted(known.select(F.coalesce("component", "k").alias("component"), "node", "parent"), "components", rows=F.count(F.lit(1)))
        out[name] = _forest(known, n["rows"], paths, max_component)
    return out


def _forest(known: DataFrame, rows: int, paths: bool, max_component: int) -> DataFrame:
    kind = known.schema["node"].dataType.simpleString()
    large = None
    if rows > max_component:
        large = cut(known.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_component).select("component"), "large")
        large = None if large.isEmpty() else large
    small = known if large is None else known.join(large, "component", "left_anti")
    # The comparison of (component, node) sorts within a task only; no component is split by the hash of its id.
    small = small.select("component", "node", "parent").repartition("component").sortWithinPartitions("component", "node")
    more = f", depth int, path array<{kind}>, n_descendants long" if paths else ""
    one = _ARROW[kind]
    fields = [("node", one), ("parent", one), ("root", one), *([("depth", pa.int32()), ("path", pa.list_(one)), ("n_descendants", pa.int64())] if paths else []), ("cycle", one)]
    schema = pa.schema(fields)
    out = small.mapInArrow(lambda batches: _walk_batches(schema, batches, paths), f"node {kind}, parent {kind}, root {kind}{more}, cycle {kind}")
    if large is None:
        return out
    rest = cut(known.join(large, "component", "left_semi").select("node", "parent"), "large")
    return out.unionByName(_large(rest, kind, paths))


def hierarchy(df: DataFrame, node: str, parent: str, paths: bool = True, max_component: int = MAX_COMPONENT) -> DataFrame:
    """``forests`` of one table."""
    return forests({"": (df, node, parent)}, paths, max_component)[""]


def _large(rows: DataFrame, kind: str, paths: bool) -> DataFrame:
    """The rows of components too large for one task, by doubling alone."""
    links = cut(parent_links(rows, "node", "parent"), "links")
    up = ancestors(links, paths=paths)
    if not paths:
        return up.join(links, "node").select("node", "parent", "root", "cycle")
    below = up.select(F.explode("up").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    rows = up.join(links, "node").join(below, "node", "left")
    free = F.col("cycle").isNull()
    return rows.select(
        "node",
        "parent",
        "root",
        F.when(free, F.size("up")).alias("depth"),
        F.when(free, F.concat(F.reverse("up"), F.array("node"))).alias("path"),
        F.when(free, F.coalesce("n", F.lit(0))).cast("long").alias("n_descendants"),
        "cycle",
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): every pair of a hierarchy's rows in which one lies above the other."""
    up = tree.filter("depth > 0").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.filter("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
