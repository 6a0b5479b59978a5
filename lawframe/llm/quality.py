"""Quality classifier: random-indexing word vectors, pooled per document, and a small numpy network.

Every word falls into one of SLOTS slots by its lower-cased letters and every word form (case and attached marks) into
one of SHAPES. Each slot has a fixed sparse random index vector; a word slot's vector is the sum of the index vectors
of its neighbours over the whole corpus, summed slot by slot in Spark and scaled to length one. A document pools the
mean of its words' vectors, the mean of its forms' index vectors and a few proportions. A two-layer network is fitted to
a bounded sample of labelled rows (`most_labels`, documented bound; everything else sees all rows), and a temperature
fitted on rows kept back calibrates its probabilities.

Edge cases: a null text is empty and pools to zeros, which the network scores like any other; labels that are null are
left out, of several labels of a document the lowest counts; rows repeat as given; with no labels, or labels of one
kind, every score is that kind's smoothed share (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import Words, claim, few_rows_a_batch, free, schema_of, slices, table, texts

SLOTS, SHAPES, DIM, NONZERO = 8192, 512, 32, 4
LETTERS, MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"[^\w]+")


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: NONZERO entries of 1 or -1 a row."""
    rng = np.random.default_rng(seed)
    at = rng.random((rows, DIM)).argsort(1)[:, :NONZERO]
    found = np.zeros((rows, DIM), np.float32)
    np.put_along_axis(found, at, rng.choice(np.array([-1, 1], np.float32), (rows, NONZERO)), 1)
    return found


def _slots(word: bytes) -> int:
    """A word's slot + SLOTS * its form's slot."""
    text = word.decode("utf-8", "replace")
    letters = "".join(LETTERS.findall(text))
    case = "A" if len(letters) > 1 and letters.isupper() else "Aa" if letters[:1].isupper() else "a" if letters else ""
    marks = "".join(MARKS.findall(text))
    form = f"{case}|{marks[:3]}|{min(len(letters), 12) // 4}|{any(c.isdigit() for c in text)}"
    return zlib.crc32(letters.lower().encode()) % SLOTS + SLOTS * (zlib.crc32(form.encode()) % SHAPES)


_words = Words(_slots)


def _begin() -> None:
    """What tasks start with; a function of the module, so that workers use the module's own cache."""
    claim(_words)


def slots_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word slots and form slots of a text, in order."""
    words = text.split()
    found = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    return found % SLOTS, found // SLOTS


def word_vectors(docs: DataFrame, seed: int = 1) -> np.ndarray:
    """SLOTS x DIM context sums over all documents, rows of length one (or zero)."""
    names = [f"v{i}" for i in range(DIM)]
    schema = "slot int, " + ", ".join(f"{n} double" for n in names)

    def scan(batches):
        import pyarrow as pa

        _begin()
        index, total = index_vectors(SLOTS, seed), np.zeros((SLOTS, DIM))
        for batch in slices(batches, 2 << 20):
            parts = [slots_of(t)[0] for t in batch.column("text").to_pylist()]
            parts = [p for p in parts if len(p) > 1]
            if not parts:
                continue
            words = np.concatenate(parts)
            starts = np.zeros(len(words), bool)
            starts[np.cumsum([0, *map(len, parts[:-1])])] = True
            near = np.zeros((len(words), DIM), np.float32)
            inner = ~starts[1:]
            near[1:][inner] += index[words[:-1][inner]]
            near[:-1][inner] += index[words[1:][inner]]
            order = words.argsort(kind="stable")
            ranked = words[order]
            heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            total[ranked[heads]] += np.add.reduceat(near[order], heads, 0)
        seen = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(total[seen, i]) for i in range(DIM))], ["slot", *names])

    sums = texts(docs).mapInArrow(scan, schema).groupBy("slot").agg(*(F.sum(n).alias(n) for n in names))
    found = np.zeros((SLOTS, DIM), np.float32)
    for r in sums.collect():  # SLOTS rows at most
        found[r[0]] = r[1:]
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def pooled(text: bytes, vectors: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """Features of a document."""
    words, shapes = slots_of(text)
    n = len(words)
    if not n:
        return np.zeros(2 * DIM + 5, np.float32)
    counts = np.bincount(words, minlength=1)
    some = np.flatnonzero(counts)
    share = counts[some] / n
    mean = share.astype(np.float32) @ vectors[some]
    form_counts = np.bincount(shapes, minlength=SHAPES)
    lines = text.split(b"\n")
    extra = [np.log1p(n) / 10, len(some) / n, float(share.max()), len(text) / n / 10, len(set(lines)) / len(lines)]
    return np.concatenate([mean, (form_counts / n).astype(np.float32) @ forms, np.array(extra, np.float32)])


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh units, one output divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def constant(share: float, width: int) -> Network:
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the cross entropy of nine tenths of the rows; the temperature from the rest."""
    width = x.shape[1]
    if len(y) < 20 or y.min() == y.max():
        return constant((float(y.sum()) + 1) / (len(y) + 2), width)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, own = order[: max(5, len(y) // 10)], order[max(5, len(y) // 10) :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z, t = np.clip((x[own] - mean) / scale, -8, 8), y[own].astype(float)
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        shuffled = rng.permutation(len(t))
        for at in range(0, len(t), 256):
            rows = shuffled[at : at + 256]
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -60, 60))) - t[rows]) / len(rows)
            gh = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[rows].T @ gh + decay * p[0], gh.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
            step += 1
            pace = rate * (1 - epoch / epochs)
            for q, a, b, d in zip(p, first, second, grads, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                q -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logit, kept = net.logits(x[back]), y[back].astype(float)

    def loss(temperature: float) -> float:
        s = np.clip(logit / temperature, -60, 60)
        return float(np.mean(np.logaddexp(0, s) - kept * s))

    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _features(df: DataFrame, keep: list[str], vectors: np.ndarray, seed: int) -> DataFrame:
    schema = schema_of(df, keep, "x array<float>")

    def scan(batches):
        import pyarrow as pa

        _begin()
        forms = index_vectors(SHAPES, seed + 1)
        for batch in slices(batches):
            x = [pooled(t, vectors, forms) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float32()))], schema.names)

    return df.mapInArrow(scan, schema)


def held_out(doc_id) -> F.Column:
    """Whether a document takes no part in learning: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, seed: int = 1) -> tuple[np.ndarray, Network]:
    """Word vectors of all of `docs`, and the network fitted to at most about `most_labels` labelled rows of them."""
    vectors = word_vectors(docs, seed)
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, most_labels / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    # a row a labelled document, however often it repeats: the least of its texts; bounded by most_labels
    wanted = texts(docs, "doc_id").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["quality"], r["x"]) for r in _features(wanted, ["doc_id", "quality"], vectors, seed).collect())
    if not rows:
        return vectors, constant(0.5, 2 * DIM + 5)
    return vectors, fit(np.array([r[2] for r in rows]), np.array([r[1] for r in rows]) == 1)


def score(docs: DataFrame, vectors: np.ndarray, net: Network, keep: list[str], seed: int = 1, name: str = "score") -> DataFrame:
    """`keep` columns of `docs` and the score of each text under `name`, which must not be one of them."""
    few_rows_a_batch(docs.sparkSession)
    raw = free(docs, "_text")
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(raw))
    schema = schema_of(df, keep, f"{name} double")

    def scan(batches):
        import pyarrow as pa

        _begin()
        forms = index_vectors(SHAPES, seed + 1)
        for batch in slices(batches):
            x = [pooled(t, vectors, forms) for t in batch.column(raw).to_pylist()]
            p = net.probability(np.array(x, float)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p)], schema.names)

    return df.mapInArrow(scan, schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors, net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, vectors, net, ["doc_id"]).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
