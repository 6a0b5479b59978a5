"""Odd tables and brute-force versions for the tests of this folder."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.7 else "") for _ in range(n))


def odd_documents(spark, empty: bool = False):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with ours."""
    base = prose(1, 300)
    rows = [
        (1, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (None, "only a few words", "de", "b", 1),
        (5, " \n ", "fr", "c", 3),
        (6, base[:1500] + " changed " + base[1500:], "en", "a", 5),
        (7, prose(2, 20_000), "en", None, 7),
        (8, "x" * 30_000, "es", "c", 9),
        (9, "Ünï©ode 日本語 🎉 e\u0301 \u2581 \t<s> <|endoftext|>", "es", "d", 9),
        (10, "one\n\ntwo  three\n", "es", "d", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([] if empty else rows, schema)
    # names that operators use inside
    for name in ("score", "key", "mark", "taken", "ids", "copy", "part", "n"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def texts_of(df) -> list[tuple]:
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def removed_by_brute_force(docs: list[tuple[object, bytes]], length: int = 400) -> list[tuple]:
    seen = defaultdict(list)
    for k, (_, t) in enumerate(docs):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((k, i))
    marks = [np.zeros(len(t) + 1, int) for _, t in docs]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                marks[k][i] += 1
                marks[k][i + length] -= 1
    found = []
    for (d, t), m in zip(docs, marks, strict=True):
        gone = m[:-1].cumsum() > 0
        edges = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        found.append((d, len(t), int(gone.sum()), edges, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return found


def classes_by_brute_force(docs: list[tuple[object, str]], words: int = 5, alike: float = 0.8) -> list[frozenset]:
    """Groups of row numbers: texts whose shingles are alike as sets or with counts."""
    def shingles(t: str) -> Counter:
        w = t.encode().split()
        return Counter(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else Counter()

    sets, up = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            both, shared = len(sets[i].keys() & sets[j].keys()), (sets[i] & sets[j]).total()
            if a == docs[j][1] or both and (both >= alike * len(sets[i].keys() | sets[j].keys()) or shared >= alike * (sets[i] | sets[j]).total()):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(set)
    for i in range(len(docs)):
        groups[root(i)].add(i)
    return sorted(map(frozenset, groups.values()), key=min)
