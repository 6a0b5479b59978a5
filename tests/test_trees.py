"""Trees of any shape against recursion in Python."""

import json
import random

from pyspark.sql import functions as F

from lawframe.operators import trees


def test_paths_and_json_by_recursion(spark):
    rng = random.Random(1)
    rows = []
    for tree in range(3):
        for n in range(40):
            parent = None if n == 0 or rng.random() < 0.05 else n - 1 if tree == 0 else rng.randrange(n)
            rows.append((tree, n, parent, f"h{n}"))
    rows += [(9, n, n - 1 if n else None, f"h{n}") for n in range(33)]  # one above a power of two
    rows += [(7, 1, 2, "a"), (7, 2, 3, "b"), (7, 3, 1, "c"), (7, 4, 3, "d"), (7, 5, None, "e"), (7, 6, 99, "f"), (7, 8, 8, "g")]  # a circle, what hangs on it, a lost parent, a loop
    nodes = spark.createDataFrame(rows, "tree long, ord long, parent_ord long, header string")
    pathed = trees.paths(nodes, "tree", "header")
    by = {(t, o): (p, h) for t, o, p, h in rows}

    def path(t, o):
        made = []
        while o is not None and (t, o) in by:
            if o in made:
                return None
            made.append(o)
            o = by[t, o][0]
        return made[::-1]

    want = {(t, o): path(t, o) for t, o in by if path(t, o) is not None}
    got = {(r["tree"], r["ord"]): r for r in pathed.collect()}
    assert {k: r["path"] for k, r in got.items()} == want and (7, 4) not in want and want[7, 6] == [6]
    assert all(r["labels"] == [by[k[0], o][1] for o in r["path"]] for k, r in got.items())

    def nest(t, o):
        return {"id": o, "subsections": [nest(t, c) for c in sorted(x for (s, x), p in want.items() if s == t and len(p) > 1 and p[-2] == o)]}

    opened = F.concat(F.lit('{"id":'), F.col("ord"))
    made = trees.in_order(pathed, "tree", opened=opened).select("tree", trees.nested(F.col("opened"), F.col("depths")).alias("json")).collect()
    for r in made:
        roots = sorted(o for (t, o), p in want.items() if t == r["tree"] and len(p) == 1)
        assert json.loads(r["json"]) == [nest(r["tree"], o) for o in roots]
    assert trees.paths(nodes.limit(0), "tree", "header").count() == 0
