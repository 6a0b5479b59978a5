"""Packing by concatenating and cutting.

All documents of the table stand one behind the other, each as its token ids and a closing id, and the stream is cut
every `window` tokens. Two passes: the first tokenises once and writes, for each document, its ids and the number of
tokens before it in its partition; the partitions' totals (one number each) then give every partition its global
offset, and the second pass cuts each document where windows end. A piece is the boundary record of its window.
No row ever moves between partitions, so neither hot sources nor groups of copies matter; only the last window of the
whole table is padded.

Edge cases: a null text is empty (its closing id alone); repeated rows are packed each; an empty table gives no pieces;
texts are tokenised whole; only doc_id and text are read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import Memo, claim, schema_of, slices, stored, table, texts

#: Unit and word encodings that a worker keeps, and how many are encoded in one call.
KEPT, CALL = 400_000, 4096
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters, then marks that are neither letters, digits, spaces nor apostrophes.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Ids under a `tokenizers` model whose pre-tokens end at white space, one white-space-free unit at a time.

    The model's normaliser works character by character or within a unit, and no pre-token or special string holds
    ASCII white space, so units are encoded independently, and each distinct unit once while it is kept.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.units, self.words = Memo(KEPT), Memo(KEPT)
        self.marks: dict[bytes, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: set[bytes]) -> None:
        new = self.units.missing(units)
        # letters are one pre-token, the marks behind them another: many words go in one call, parted by the pieces
        # that end words
        stems, rest = {}, []
        for u in new:
            stem = u.rstrip(MARKS)
            if stem.isalpha():
                stems[u] = stem.lower()
            elif m := WORD.fullmatch(u.decode()):
                stems[u] = m[1].lower().encode()
            else:
                rest.append(u)
        words, known = self.words.missing(set(stems.values())), self.words.found
        for at in range(0, len(words), CALL):
            some = words[at : at + CALL]
            ids = self.ids([b" ".join(some).decode()])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("pieces that end words do not match the words")
            raw, edges = ids.tobytes(), [0, *(stops * 4).tolist()]
            known.update((w, raw[a:b]) for w, a, b in zip(some, edges, edges[1:], strict=False))
        tails = {u: u[len(stem) :] for u, stem in stems.items()}
        rest += {t for t in tails.values() if t not in self.marks}
        for at in range(0, len(rest), CALL):
            self.marks.update(zip(rest[at : at + CALL], (x.tobytes() for x in self.ids([u.decode() for u in rest[at : at + CALL]])), strict=True))
        marks, found = self.marks, self.units.found
        found.update({u: known[stem] + marks[tails[u]] if tails[u] else known[stem] for u, stem in stems.items()})
        found.update({u: marks[u] for u in rest})
        if len(marks) > KEPT:
            marks.clear()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text (UTF-8) its ids, little-endian unsigned 32-bit."""
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.units.found.__getitem__, parts)) for parts in split]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One per worker process and model."""
    claim(_encoders)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, path: str, closing_id: int) -> DataFrame:
    """First pass: doc_id, part, before (tokens earlier in this partition), n_tokens, ids (little-endian uint32)."""
    schema = schema_of(docs, ["doc_id"], "part int, before long, n_tokens long, ids binary")

    def scan(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, before, close = _encoder(path), TaskContext.get().partitionId(), 0, np.uint32(closing_id).tobytes()
        for batch in slices(batches):
            ids = [np.frombuffer(x + close, np.uint32).astype("<u4") for x in encoder.encode(batch.column("text").to_pylist())]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = before + sizes.cumsum() - sizes
            before += int(sizes.sum())
            columns = [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "part", "before", "n_tokens", "ids"])

    return texts(docs, "doc_id").mapInArrow(scan, schema)


def pack(docs: DataFrame, path: str, window: int = 4096, closing_id: int = 2) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of sequences of `window` tokens."""
    written = stored(tokenised(docs, path, closing_id), "ids")
    # one number per partition of the scan goes to the driver
    totals = dict(written.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    schema = schema_of(written, ["doc_id"], "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches):
            parts, before, sizes = (batch.column(c).to_numpy() for c in ("part", "before", "n_tokens"))
            first = before + np.array([base[p] for p in parts.tolist()], np.int64)
            pieces = (first + sizes - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(pieces)), pieces)
            nth = np.arange(len(row)) - np.repeat(pieces.cumsum() - pieces, pieces)
            sequence = first[row] // window + nth
            begin = np.maximum(first[row], sequence * window)
            end = np.minimum((first + sizes)[row], (sequence + 1) * window)
            start = begin - first[row]
            ids = batch.column("ids")
            held = [ids[r].as_py()[4 * a : 4 * b] for r, a, b in zip(row.tolist(), start.tolist(), (end - first[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(held, pa.binary()), pa.array(sizes[row]), pa.array(sequence), pa.array(begin - sequence * window)],
                schema.names,
            )

    return written.select("doc_id", "part", "before", "n_tokens", "ids").mapInArrow(cut, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in the place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
