"""Trees of any depth, given as rows with a parent: paths by pointer doubling, texts and JSON in one pass over them.

A node is (tree, ord, parent_ord, ...): `ord` is its number in its tree, children stand in the order of their numbers. In
each round every node learns what lies above the farthest ancestor that it knows, so that a tree of depth d takes about
log2(d) joins on (tree, ord), whatever its shape; ancestors with many descendants meet them in a join that Spark can
split. A node without a parent, or whose parent is not there, is a root. Nodes that lie on a circle of parents, or below
one, have no path and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.scratch import stored


def paths(nodes: DataFrame, tree: str, label: str) -> DataFrame:
    """`nodes` with `path`, the numbers of its ancestors and itself from the root down, and `labels`, theirs."""
    key = nodes.select(tree, "ord", "parent_ord", F.coalesce(F.col(label), F.lit("")).alias("_label"))
    there = key.select(F.col(tree).alias("_t"), F.col("ord").alias("_o"))
    known = key.join(there, (F.col(tree) == F.col("_t")) & (F.col("parent_ord") == F.col("_o")), "left")
    found = stored(known.select(tree, "ord", F.col("_o").alias("up"), F.array("ord").alias("path"), F.array("_label").alias("labels")), "paths")
    below = left = found.filter("up is not null").count()
    done, rounds = [found.filter("up is null")], 0
    while left and 1 << rounds <= below:  # chains longer than all nodes lead round a circle
        above = found.select(F.col(tree).alias("_t"), F.col("ord").alias("_o"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("labels").alias("_labels"))
        open_ = found.filter("up is not null").join(above, (F.col(tree) == F.col("_t")) & (F.col("up") == F.col("_o")))
        longer = open_.select(tree, "ord", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), F.concat("_labels", "labels").alias("labels"))
        longer = stored(longer, "paths")
        done.append(longer.filter("up is null"))
        found = found.filter("up is null").unionByName(longer)
        left, rounds = longer.filter("up is not null").count(), rounds + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return nodes.join(whole.select(tree, "ord", "path", "labels"), [tree, "ord"])


def in_order(pathed: DataFrame, tree: str, **texts: Column) -> DataFrame:
    """A row a tree: for each name an array of its strings in pre-order, and `depths`, those of the nodes (1: a root)."""
    row = F.struct("path", F.size("path").alias("depth"), *(c.alias(n) for n, c in texts.items()))
    listed = pathed.groupBy(tree).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    take = lambda name: F.transform("rows", lambda r: r[name]).alias(name if name != "depth" else "depths")
    return listed.select(tree, take("depth"), *(take(n) for n in texts))


def nested(opened: Column, depths: Column) -> Column:
    """JSON of a tree from its nodes in pre-order: `opened`, each an object without its last brace, go into the
    `subsections` of the one they hang below."""
    # before a node: as many ends as it stands higher than the one before, then a comma if that was no parent of it
    def one(o: Column, i: Column) -> Column:
        before, own = F.get(depths, i - 1), F.get(depths, i)
        close = F.when(i > 0, F.repeat(F.lit("]}"), F.greatest(before - own + 1, F.lit(0)).cast("int"))).otherwise(F.lit(""))
        comma = F.when((i > 0) & (before >= own), F.lit(",")).otherwise(F.lit(""))
        return F.concat(close, comma, o, F.lit(',"subsections":['))

    body = F.array_join(F.transform(opened, one), "")
    return F.concat(F.lit("["), body, F.repeat(F.lit("]}"), F.coalesce(F.element_at(depths, -1), F.lit(0)).cast("int")), F.lit("]"))
