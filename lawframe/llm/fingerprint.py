"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Every non-empty paragraph (line) is hashed (128 bits) to a wide vector, and the vectors are added: 16 lanes modulo 2**64 decide
equality, whatever the order of paragraphs. Its pairs of adjacent words (overlapping) are hashed to sparse vectors of 12 x 64 lanes modulo 2**8,
pair by pair into the level that its trailing zero bits name (so level k holds about one in 2**(k+1)); lanes that differ
between two sums tell how many pairs do, at a level where not all lanes differ, and so give a likeness. Sums make
insertion and deletion of paragraphs an addition or subtraction.

Edge cases: a null text is empty and has the fingerprint of no paragraph; texts that differ only in empty lines or in
the order of lines have equal fingerprints; of rows with equal doc_id the lesser text (by bytes) goes first; null
doc_ids go first; the next document of a single one is itself; an empty table gives no rows; texts of any length are
taken whole; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import schema_of, slices, table, texts

LANES, LEVELS, CELLS, WORDS = 16, 12, 64, 2
U = np.uint64
SALTS = np.arange(1, LANES + 1, dtype=U) * U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Fingerprint:
    """Sums over the paragraphs of a text; `+` inserts another's paragraphs, `-` deletes them."""

    __slots__ = ("cells", "dense", "pairs")

    def __init__(self, dense: np.ndarray, cells: np.ndarray, pairs: int):
        self.dense, self.cells, self.pairs = dense, cells, pairs

    @classmethod
    def of(cls, text: bytes) -> Fingerprint:
        from xxhash import xxh3_64_intdigest as h64
        from xxhash import xxh3_128_digest as h128

        lines = [x for x in text.split(b"\n") if x]
        pieces: list[int] = []
        for line in lines:
            words = line.split(b" ")
            # overlapping, so that a word put in or taken out changes only the pairs around it
            pieces += [h64(b" ".join(pair)) for pair in zip(*(words[k:] for k in range(WORDS)), strict=False)] or [h64(line)]
        # both halves of a 128-bit hash go into every lane, so that lanes together tell as many paragraphs apart
        whole = np.frombuffer(b"".join([h128(x, 1) for x in lines]), "<u8").reshape(-1, 2).astype(U)
        dense = (_mix(whole[:, :1] ^ SALTS) + _mix(whole[:, 1:] + SALTS)).sum(0, dtype=U)
        found = np.array(pieces, U)
        level = np.zeros(len(found), np.int64)
        for bits in range(1, LEVELS):
            level += (found & U((1 << bits) - 1)) == 0
        cell = level * CELLS + (found >> U(16) & U(CELLS - 1)).astype(np.int64)
        value = (_mix(found) & U(0xFF)).astype(np.int64) | 1
        sums = np.bincount(cell, value, LEVELS * CELLS).astype(np.int64) & 0xFF
        return cls(dense, sums, len(found))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense + other.dense, (self.cells + other.cells) & 0xFF, self.pairs + other.pairs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense - other.dense, (self.cells - other.cells) & 0xFF, self.pairs - other.pairs)

    def __str__(self) -> str:
        raw = self.dense.astype("<u8").tobytes() + self.cells.astype("u1").tobytes() + self.pairs.to_bytes(8, "little")
        return base64.b64encode(raw).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        a, b = 8 * LANES, 8 * LANES + LEVELS * CELLS
        return cls(np.frombuffer(raw[:a], "<u8").astype(U), np.frombuffer(raw[a:b], "u1").astype(np.int64), int.from_bytes(raw[b:], "little"))

    def equals(self, other: Fingerprint) -> bool:
        return bool((self.dense == other.dense).all())

    def likeness(self, other: Fingerprint) -> float:
        """Estimated Jaccard likeness of the multisets of word pairs, 1 for equal fingerprints."""
        if self.equals(other):
            return 1.0
        both = self.pairs + other.pairs
        differing = (self.cells != other.cells).reshape(LEVELS, CELLS).sum(1)
        level = next((k for k in range(LEVELS) if differing[k] <= 0.85 * CELLS), LEVELS - 1)
        share = np.minimum(differing[level:], CELLS - 0.5) / CELLS
        apart = min(both, float(-CELLS * np.log1p(-share).sum()) * 2**level)
        return max(0.0, (both - apart) / (both + apart)) if both else 0.0


def edited(text: str, following: str) -> tuple[str, int]:
    """`text` with its last quarter replaced by the head of `following`; and where the first changed paragraph begins."""
    quarter = len(text) // 4
    kept = text[: len(text) - quarter]
    return kept + following[:quarter], kept.rfind("\n") + 1


def neighbours(docs: DataFrame, per_range: int = 2000, most_ranges: int = 20_000) -> DataFrame:
    """Rows (doc_id, key, range, halo, text) dealt so that a range holds consecutive documents, in order.

    Ranges are cut at documents found by an approximate percentile of doc_id. The first document of each range is
    also dealt to the range before it (the very first one to the last), as its `halo`.
    """
    keyed = texts(docs.withColumn("key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))), "doc_id", "key")
    ids = keyed.select("key")
    count, least = ids.agg(F.count("*"), F.min("key")).first()
    ranges = max(1, min(most_ranges, count // per_range))
    cuts = ids.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges + 1000)).first()[0] if ranges > 1 else []
    first = sorted({least, *cuts} - {None})
    schema = schema_of(keyed, ["doc_id", "key"], "range int, halo boolean, text binary")

    def deal(batches):
        import pyarrow as pa

        starts = np.array(first, np.int64)
        for batch in batches:
            key = batch.column("key").to_numpy()
            own = np.searchsorted(starts, key, "right") - 1
            heads = np.flatnonzero(starts[own] == key)
            rows = pa.array(np.concatenate([np.arange(len(key)), heads]))
            at = pa.array(np.concatenate([own, (own[heads] - 1) % len(starts)]).astype(np.int32))
            halo = pa.array(np.arange(len(rows)) >= len(key))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("key").take(rows), at, halo, batch.column("text").take(rows)], schema.names)

    dealt = keyed.mapInArrow(deal, schema)
    return dealt.repartition(max(1, len(first)), "range").sortWithinPartitions("range", "halo", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, its edited text's, and its likeness to that and to the next document."""
    dealt = neighbours(docs)
    schema = schema_of(dealt, ["doc_id"], "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def scan(batches):
        import pyarrow as pa

        before, kinds = None, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for batch in slices(batches):
            ids, rows = [], []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "range", "halo", "text"))
            for doc_id, at, halo, raw in zip(*columns, strict=True):
                if halo and (before is None or before[1] != at):
                    continue  # only the first halo of a range counts
                text, print_ = raw.decode(), Fingerprint.of(raw)
                if before is not None and before[1] == at:
                    ids.append(before[0])
                    rows.append(_row(before[2], before[3], text, print_))
                before = None if halo else (doc_id, at, text, print_)
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), *made], schema.names)

    return dealt.mapInArrow(scan, schema)


def _row(text: str, own: Fingerprint, following: str, its: Fingerprint) -> tuple:
    changed, at = edited(text, following)
    raw = changed.encode()
    # only the paragraphs from the first changed one on are taken out and put in
    new = own - Fingerprint.of(text[at:].encode()) + Fingerprint.of(changed[at:].encode()) if at else Fingerprint.of(raw)
    return len(text), hashlib.sha256(raw).hexdigest(), str(own), str(new), own.likeness(new), own.likeness(its)


def op5_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
