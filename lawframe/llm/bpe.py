"""Byte-level BPE over a rank file, by longest matches and backtracking.

A text is split into units at white space that follows something else; no match of the splitting pattern crosses such a
place, so units are encoded on their own and kept per worker. Within a unit the pattern gives words. A word's bytes stand
as Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary (pyahocorasick) finds the longest token at
every byte in one pass. Encoding then walks forward by longest matches. A token may follow another only if the two
stand side by side in the merges of their joint bytes (asked once for each pair, and kept); where no token may follow,
the last one is taken back and a shorter one tried, and a byte from which nothing leads on is never tried again. So
every byte is tried with its tokens once at most, and the result is exactly that of the merges. Decoding strings the
tokens' bytes together.

Edge cases: a null text is empty (no tokens); bytes that are no UTF-8 stand as U+FFFD; rows repeat as given; an empty
table gives no rows; texts of any length are taken whole, in batches of bounded bytes, and a single word of any length
in linear time; only the named columns are read, and the key may have any name but those of the added columns.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from lawframe.llm.common import SHORT, claim, schema_of, slices, table, texts

#: White space of ASCII as spaces, and white space beyond ASCII.
SPACED = bytes(32 if 9 <= b <= 13 else b for b in range(256))
WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: What a worker keeps: pairs of tokens with their compatibility, words, and units with and without a space in front.
PAIRS, WORDS, SPACED_UNITS, UNITS = 1_000_000, 200_000, 600_000, 100_000
#: Later than any rank.
NEVER = 1 << 62
#: More than any token's number.
SPAN = 1 << 32


class Recent(dict):
    """Answers of `make` for what was asked for lately: a full table becomes the old one, and what is asked for again
    moves from the old table to the new. At most twice `most` answers stay; units over SHORT bytes are made anew."""

    def __init__(self, make: Callable[[bytes], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, unit: bytes) -> bytes:
        found = self.old.get(unit)
        if found is None:
            found = self.make(unit)
        if len(unit) <= SHORT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = found
        return found


class ByteBPE:
    """Encodes and decodes under `ranks` (token bytes to number; the least number merges first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        self.ranks = ranks
        self.rank = {token.decode("latin-1"): r for token, r in ranks.items()}
        self.token = {r: token for token, r in self.rank.items()}
        self.bytes = {r: token for token, r in ranks.items()}
        self.words = regex.compile(pattern)
        self.units = regex.compile(r"\s*\S+|\s+")
        self.automaton = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.automaton.add_word(token, (r, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        # by number: a token's bytes, and the longest token that is a proper prefix of it (-1: none)
        self.length = {r: len(token) for token, r in ranks.items()}
        self.shorter = {r: next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1) for token, r in ranks.items()}
        self.kept = Recent(self.word, WORDS)
        self.plain, self.spaced = Recent(self.unit, UNITS), Recent(lambda part: self.unit(b" " + part), SPACED_UNITS)

    def merged(self, word: str, least: int = 1) -> list[int]:
        """The merges themselves, for short strings: again and again the pair of least rank, the leftmost of equals,
        until so few parts are left."""
        parts = list(word)
        while len(parts) > least:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            at = ranks.index(min(ranks))
            if parts[at] + parts[at + 1] not in self.rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def edge(self, token: str, side: int) -> list[tuple[str, int]] | None:
        """What stands at the right (1) or left (0) edge of a token while it is being merged, whole token first, each
        with the rank at which it goes into the next larger; None if a part of it doesn't come before it in rank."""
        found = self.edges[side].get(token, ())
        if found == ():
            parts = self.merged(token, 2)
            if len(token) > 1 and (len(parts) != 2 or max(parts) > self.rank[token]):
                found = None
            elif len(token) == 1:
                found = [(token, NEVER)]
            else:
                below = self.edge(self.token[parts[side]], side)
                found = below and [(token, NEVER), (below[0][0], self.rank[token]), *below[1:]]
            self.edges[side][token] = found
        return found

    def stands(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left` (-1: the beginning) as tokens of one encoding.

        They may not if, while both are being merged, what stands at the right edge of the one joins what stands at the
        left edge of the other before either goes into something larger. The edges that meet at some time are walked
        from the last pair to the first.
        """
        found = self.pairs.get(left * SPAN + right)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            before, after = self.token.get(left, ""), self.token[right]
            ends, starts = self.edge(before, 1) if before else None, self.edge(after, 0)
            if not before:
                found = starts is not None or self.merged(after) == [right]
            elif ends is None or starts is None:
                found = self.merged(before + after) == [left, right]
            else:
                i, j, rank, found = 0, 0, self.rank, True
                while True:
                    (x, gone), (y, lost) = ends[i], starts[j]
                    joint = rank.get(x + y, NEVER)
                    if joint < gone and joint <= lost:  # of equal ranks the leftmost pair joins first
                        found = False
                        break
                    if len(x) == len(y) == 1:
                        break
                    if len(y) == 1 or len(x) > 1 and rank[x] > rank[y]:  # the one that was made later was not there before
                        i += 1
                    else:
                        j += 1
            self.pairs[left * SPAN + right] = found
        return found

    def word(self, word: bytes) -> bytes:
        """The tokens of one match of the pattern, as little-endian unsigned 32-bit numbers."""
        if (whole := self.ranks.get(word)) is not None:
            return self.packed([whole])
        shown, size = word.decode("latin-1"), len(word)
        pairs, stands, length, shorter = self.pairs, self.stands, self.length, self.shorter
        made, at, last = [], 0, -1
        for end, (number, _) in self.automaton.iter_long(shown):  # longest matches end to end; mostly nothing has to go back
            found = pairs.get(last * SPAN + number)
            if not found and (found is not None or not stands(last, number)):
                break
            made.append(number)
            last, at = number, end + 1
        else:
            return self.packed(made)
        longest = [0] * size
        for end, (number, long) in self.automaton.iter(shown):  # later ends are longer, so the longest stays
            longest[end - long + 1] = number
        dead = bytearray(size + 1)
        next_one = shorter[longest[at]]
        while True:
            while next_one >= 0:
                end = at + length[next_one]
                if not dead[end]:
                    found = pairs.get(last * SPAN + next_one)
                    if found or found is None and stands(last, next_one):
                        break
                next_one = shorter[next_one]
            if next_one >= 0:
                made.append(next_one)
                if end == size:
                    return self.packed(made)
                last, at = next_one, end
                next_one = longest[at]
            else:  # nothing leads on from here: take the last token back and try a shorter one
                dead[at] = 1
                at -= length[last]
                next_one = shorter[last]
                made.pop()
                last = made[-1] if made else -1

    @staticmethod
    def packed(numbers: list[int]) -> bytes:
        made = array("I", numbers)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def unit(self, unit: bytes) -> bytes:
        """The tokens of a unit, as little-endian unsigned 32-bit numbers."""
        kept = self.kept
        return b"".join([kept[word.encode()] for word in self.words.findall(unit.decode("utf-8", "replace"))])

    def encode(self, text: bytes) -> bytes:
        """Tokens of a whole text (UTF-8) as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        plain = self.plain
        if runs(text):
            return b"".join([plain[u.encode()] for u in self.units.findall(text.decode("utf-8", "replace"))])
        spaced = self.spaced
        first, *rest = text.replace(b"\n", b" \n").split(b" ")
        return b"".join([plain[first], *[plain[p] if p[:1] == b"\n" else spaced[p] for p in rest]])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def runs(text: bytes) -> bool:
    """Whether cutting before each space and line feed might cut a run of white space that one word takes: three in a
    row, two at the end, or white space beyond ASCII."""
    spaced = text.translate(SPACED)
    if b"   " in spaced or spaced.endswith(b"  "):
        return True
    return not text.isascii() and any(x in text for x in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")) and WIDE.search(text) is not None


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line holds a token in base 64 and its number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(number) for token, number in map(bytes.split, filter(bytes.strip, lines))}


_made: dict[tuple[str, str], ByteBPE] = {}


def _bpe(path: str, pattern: str) -> ByteBPE:
    """One per worker process, rank file and pattern."""
    claim(_made)
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _made[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: n_tokens and ids (little-endian unsigned 32-bit, one after the other)."""

    def scan(batches):
        import pyarrow as pa

        bpe = _bpe(ranks, pattern)
        for batch in slices(batches):
            made = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            counts = pa.array([len(x) // 4 for x in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key), counts, pa.array(made, pa.binary())], [key, "n_tokens", "ids"])

    return texts(docs, key).mapInArrow(scan, schema_of(docs, [key], "n_tokens long, ids binary"))


def decode(encoded: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, ids) to (key, text as bytes); null ids are none."""
    keep = [c for c in encoded.columns if c != "ids"]

    def scan(batches):
        import pyarrow as pa

        bpe = _bpe(ranks, pattern)
        for batch in slices(batches):
            made = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.binary())], [*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(scan, schema_of(encoded, keep, "text binary"))


def digests(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: n_tokens, ids_sha256, and decoded_sha256 of what the ids decode to; ids stay in the task."""

    def scan(batches):
        import pyarrow as pa

        bpe = _bpe(ranks, pattern)
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            if rows:
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key), *made], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, key).mapInArrow(scan, schema_of(docs, [key], "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
