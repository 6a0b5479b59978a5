"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The vocabulary is a byte-fallback BPE whose pieces hold the space mark only at their front, so a text falls apart into
units (a word with its leading mark, or what follows a line feed) that are encoded independently. Within a unit the
encoding of every prefix ends in exactly one piece: the suffix piece that stands after the encoding of the shorter
prefix without merging with its last piece. So count[i] = count[i - len(piece)] + 1, and one pass over a unit yields
the exact count at each of its prefixes. Unit tables are kept per worker (bounded) and strung together per text.

Edge cases: a null text is empty (0 tokens); rows repeat as given; an empty table gives no rows; texts of any length are
taken whole; only the named columns are read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
from pyspark.sql import DataFrame

from lawframe.llm.common import Memo, claim, schema_of, slices, table, texts

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Unit tables that a worker keeps.
KEPT = 800_000
UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")


class PrefixCounter:
    """Token counts of every prefix under a sentencepiece BPE model."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.rank = {lib.id_to_piece(i): -lib.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank) or any("\n" in p for p in self.rank):
            raise ValueError("pieces of this model cross the borders of units")
        self.longest: dict[str, int] = {}  # of pieces with the given last one or two characters
        for piece in self.rank:
            self.longest[piece[-2:]] = max(len(piece), self.longest.get(piece[-2:], 1))
        self.standing: dict[tuple[str, str], bool] = {}
        self.units = Memo(KEPT)

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: again and again merge the best ranked pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == np.inf:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: str, right: str) -> bool:
        """Whether `right` may follow `left` as pieces of one encoding."""
        key = (left, right)
        found = self.standing.get(key)
        if found is None:
            if len(self.standing) >= 1_000_000:
                self.standing.clear()
            found = self.standing[key] = self.merged(left + right) == [left, right]
        return found

    def tables(self, units: list[str]) -> list[bytes]:
        """For each unit, in sorted order: the changes of the count along its prefixes (int16 as bytes).

        A unit is encoded from its own first character on. Sorted units share the states of their common prefixes.
        """
        longest, standing, made = self.longest, self.standing, []
        counts, last, done = [0], [""], ""
        for unit in units:
            shared, most = 0, min(len(unit), len(done))
            while shared < most and unit[shared] == done[shared]:
                shared += 1
            del counts[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(unit) + 1):
                size = longest.get(unit[end - 2 : end] if end > 1 else unit[0], 1)
                for start in range(end - size if end > size else 0, end):
                    piece = unit[start:end]
                    if piece in self.rank:
                        before = last[start]
                        if not before or (yes := standing.get((before, piece))) or yes is None and self.stands(before, piece):
                            counts.append(counts[start] + 1)
                            last.append(piece)
                            break
                else:  # the last character is no piece: one token for each of its bytes, which merge with nothing
                    counts.append(counts[end - 1] + len(unit[end - 1].encode()))
                    last.append("")
            done = unit
            made.append(array("h", map(sub, counts[1:], counts)).tobytes())
        return made

    def learn(self, units: set[bytes]) -> None:
        """Make the tables of units that are not known yet."""
        new = sorted((u.decode(), u) for u in self.units.missing(units))
        plain, fed = [x for x in new if x[0][:1] != "\n"], [x for x in new if x[0][:1] == "\n"]
        for group, mark in ((plain, MARK), (fed, "")):
            self.units.found.update(zip((u for _, u in group), self.tables([mark + t for t, _ in group]), strict=True))

    def prefix_counts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """For each text (UTF-8) count[i]: the tokens of its first i code points, for i from 0 to its length."""
        split = [None if self.odd(t) else t.replace(b"\n", b" \n").split(b" ") for t in texts]
        self.learn(set().union(*(x for x in split if x)))
        for text, parts in zip(texts, split, strict=True):
            if not text:
                yield np.zeros(1, np.int64)
                continue
            if parts is None:
                units = UNIT.findall(MARK + text.decode().replace(" ", MARK))
                ranked = sorted(set(units))
                found = b"".join(map(dict(zip(ranked, self.tables(ranked), strict=True)).__getitem__, units))
            else:
                found = b"".join(map(self.units.found.__getitem__, parts))
            counts = np.frombuffer(found, np.int16).cumsum(dtype=np.int64)
            counts[0] = 0  # what stands before the first code point is the mark that the library puts there
            yield counts

    @staticmethod
    def odd(text: bytes) -> bool:
        """Whether marks may stand side by side in `text`, so that runs of them are units of their own."""
        return text[:1] in b" \n" or b"  " in text or MARK_BYTES in text

    def count(self, text: bytes) -> int:
        return int(next(self.prefix_counts([text]))[-1])

    def truncate(self, text: bytes, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens."""
        return int(np.flatnonzero(next(self.prefix_counts([text])) <= budget)[-1])


def count_tokens(docs: DataFrame, model: str, limit: int, key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: n_bytes, n_tokens, over_limit, and fit_chars, the longest prefix within the limit."""
    schema = schema_of(docs, [key], "n_bytes long, n_tokens long, over_limit boolean, fit_chars long")

    def scan(batches):
        import pyarrow as pa

        counter = _counter(model)
        for batch in slices(batches):
            rows = []
            encoded = batch.column("text").to_pylist()
            for text, counts in zip(encoded, counter.prefix_counts(encoded), strict=True):
                total = int(counts[-1])
                fit = len(counts) - 1 if counts.max() <= limit else int(np.flatnonzero(counts <= limit)[-1])
                rows.append((len(text), total, total > limit, fit))
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)] if rows else None
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(key), *made], [key, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return texts(docs, key).mapInArrow(scan, schema)


_counters: dict[str, PrefixCounter] = {}


def _counter(model: str) -> PrefixCounter:
    """One per worker process and model."""
    claim(_counters)
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
