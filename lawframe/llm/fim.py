"""Fill-in-middle: a table-driven byte automaton counts a text's units, a second pass over two blocks finds the cuts.

A unit is a word with the white space before it, or what white space a text ends in. The automaton's state is the class of
the last byte (none, white space, other) and how much of a sentinel (`<P>`, `<S>`, `<M>`) has been read. Each transition
emits counts: a code point where the byte is no UTF-8 continuation, a border of units where white space follows
something else, a sentinel where its last byte comes. Any state depends on the last two bytes alone, so a text is cut
into blocks of BLOCK bytes, each begun two bytes early, and all blocks of a batch take each step of the tables together.
The first scan gives code points, borders and sentinels of each block; from them follow a text's number of units and the
blocks in which its two cuts lie, and only these are read again, up to the border that is the cut.

Edge cases: a null text is empty (n 0, form plain); a null doc_id seeds like an empty string; white space alone is one
unit; bytes that are no UTF-8 count as they stand; rows repeat as given, each with the same cuts; an empty table gives no
rows; texts of any length are taken whole, in batches of bounded bytes; only the named columns are read, and the key may
have any name but those of the added columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import schema_of, slices, table, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a block, and those in front of it that settle its first state.
BLOCK, EARLY = 1024, 2
#: The symbol behind a text's end.
PAD = 256
#: Bits of a packed count: code points lie below the borders, these below the sentinels.
BITS = 20


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each state * 257 + symbol: the next state, and what the transition counts."""
    space = {*range(9, 14), 32}
    step, count = np.zeros(9 * 257, np.int64), np.zeros(9 * 257, np.int64)
    for last in range(3):  # nothing, white space, other
        for read in range(3):  # nothing of a sentinel, its first byte, its first two
            for byte in range(256):
                at = (last * 3 + read) * 257 + byte
                kind = 1 if byte in space else 2
                begun = 1 if byte == PREFIX[0] else 2 if read == 1 and byte in (PREFIX[1], SUFFIX[1], MIDDLE[1]) else 0
                step[at] = kind * 3 + begun
                count[at] = (byte & 0xC0 != 0x80) + ((last == 2 and kind == 1) << BITS) + ((read == 2 and byte == PREFIX[2]) << 2 * BITS)
            step[(last * 3 + read) * 257 + PAD] = last * 3 + read
    return step * 257, count


STEP, COUNT = tables()


class Blocks:
    """The blocks of several texts, side by side: `symbols[i, b]` is the i-th symbol of block b, EARLY ones included."""

    def __init__(self, found: list[bytes]):
        sizes = np.array([len(t) for t in found], np.int64)
        self.blocks = -(-sizes // BLOCK)  # of each text
        self.first = np.r_[0, self.blocks.cumsum()]
        total = int(self.first[-1])
        laid = np.full(EARLY + total * BLOCK, PAD, np.uint16)
        for text, at in zip(found, self.first[:-1].tolist(), strict=True):
            laid[EARLY + at * BLOCK : EARLY + at * BLOCK + len(text)] = np.frombuffer(text, np.uint8)
        rows = np.lib.stride_tricks.as_strided(laid, (total, EARLY + BLOCK), (BLOCK * laid.itemsize, laid.itemsize))
        self.symbols = np.ascontiguousarray(rows.T)
        self.symbols[:EARLY, self.first[:-1][self.blocks > 0]] = PAD  # nothing stands before a text

    def start(self, of=slice(None)) -> np.ndarray:
        """The states with which blocks begin."""
        state = np.zeros(self.symbols[0, of].shape[0], np.int64)
        for i in range(EARLY):
            state = STEP[state + self.symbols[i, of]]
        return state

    def scan(self) -> np.ndarray:
        """What each block counts, packed."""
        state, counted = self.start(), np.zeros(self.symbols.shape[1], np.int64)
        for i in range(EARLY, EARLY + BLOCK):
            at = state + self.symbols[i]
            counted += COUNT[at]
            state = STEP[at]
        return counted

    def find(self, blocks: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in each of `blocks` its `border`-th border (from 1) is: bytes and code points before it."""
        symbols = self.symbols[:, blocks]
        state, points = self.start(blocks), np.zeros(len(blocks), np.int64)
        left, place = border.copy(), np.full(len(blocks), -1)
        for i in range(BLOCK):
            at = state + symbols[EARLY + i]
            state, counted = STEP[at], COUNT[at]
            left -= counted >> BITS & 1
            place[(left == 0) & (place < 0)] = i
            points += (counted & 1) * (place < 0)
            if (place >= 0).all():
                break
        return place, points


def measured(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, Blocks, np.ndarray]:
    """For each text: its units, whether it holds a sentinel; and the blocks with their packed counts."""
    blocks = Blocks(found)
    counted = blocks.scan() if blocks.first[-1] else np.zeros(0, np.int64)
    low = (1 << BITS) - 1
    sums = [np.r_[0, part.cumsum()] for part in (counted >> BITS & low, counted >> 2 * BITS)]
    borders, sentinels = (s[blocks.first[1:]] - s[blocks.first[:-1]] for s in sums)
    return borders + (blocks.blocks > 0), sentinels > 0, blocks, counted


def cuts(found: list[bytes], blocks: Blocks, counted: np.ndarray, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and code points in the first units[i] units of text[i], for 0 < units[i] < all of them."""
    low = (1 << BITS) - 1
    borders, points = np.r_[0, (counted >> BITS & low).cumsum()], np.r_[0, (counted & low).cumsum()]
    first = blocks.first[text]
    target = borders[first] + units  # counting all texts' borders, this is the one
    block = np.searchsorted(borders, target, "left") - 1
    place, inside = blocks.find(block, target - borders[block])
    return (block - first) * BLOCK + place, points[block] - points[first] + inside


def draws(seed: int, key: object) -> tuple[int, ...]:
    """The first four 8-digit groups of sha256("seed:key") as numbers."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def restored(output: bytes, form: str) -> bytes:
    """The text from which an output of the given form was made."""
    if form == "plain":
        return output
    middle = output.index(MIDDLE)
    if form == "psm":
        suffix = output.index(SUFFIX)
        return output[len(PREFIX) : suffix] + output[middle + len(MIDDLE) :] + output[suffix + len(SUFFIX) : middle]
    prefix = output.index(PREFIX)
    return output[prefix + len(PREFIX) : middle] + output[middle + len(MIDDLE) :] + output[len(SUFFIX) : prefix]


def transformed(keys: list, found: list[bytes], seed: int, rate: int, spm: int) -> list[tuple]:
    """For each text: (units, form, code points of prefix and of middle or None, output)."""
    n, marked, blocks, counted = measured(found)
    drawn = [draws(seed, k) for k in keys]
    plain = [not t or bool(m) or h[2] % 100 >= rate for t, m, h in zip(found, marked, drawn, strict=True)]
    made = [i for i in range(len(found)) if not plain[i]]
    ends = [sorted((drawn[i][0] % (int(n[i]) + 1), drawn[i][1] % (int(n[i]) + 1))) for i in made]
    asked = [(i, u) for i, pair in zip(made, ends, strict=True) for u in pair if 0 < u < n[i]]
    places: dict[tuple[int, int], tuple[int, int]] = {}
    if asked:
        text, units = np.array(asked).T
        places = dict(zip(asked, zip(*(x.tolist() for x in cuts(found, blocks, counted, text, units)), strict=True), strict=True))
    low = (1 << BITS) - 1
    whole = np.r_[0, (counted & low).cumsum()]
    rows: list[tuple] = [(int(x), "plain", None, None, t) for x, t in zip(n, found, strict=True)]
    for i, pair in zip(made, ends, strict=True):
        text = found[i]
        total = int(whole[blocks.first[i + 1]] - whole[blocks.first[i]])
        (a, before), (b, until) = (places.get((i, u)) or ((0, 0) if u == 0 else (len(text), total)) for u in pair)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        form = "spm" if drawn[i][3] % 100 < spm else "psm"
        output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
        rows[i] = (int(n[i]), form, before, until - before, output)
    return rows


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: n, form, prefix_chars, middle_chars and output (UTF-8 bytes). Of 100 texts about `rate` are
    transformed, about `spm` of 100 of these with the suffix first; `seed` and the key settle which and where."""

    def scan(batches):
        import pyarrow as pa

        for batch in slices(batches):
            rows = transformed(batch.column(key).to_pylist(), batch.column("text").to_pylist(), seed, rate, spm)
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key), *made], [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts(docs, key).mapInArrow(scan, schema_of(docs, [key], "n long, form string, prefix_chars long, middle_chars long, output binary"))


def read_back(made: DataFrame) -> DataFrame:
    """The texts (bytes) again, from `output` and `form` alone."""
    keep = made.columns

    def scan(batches):
        import pyarrow as pa

        for batch in slices(batches):
            pairs = zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([restored(o, f) for o, f in pairs], pa.binary())], [*keep, "restored"])

    return made.mapInArrow(scan, schema_of(made, keep, "restored binary"))


def op13_fim(spark, sf_dir: str) -> DataFrame:
    made = read_back(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
  select *, regexp_extract_all(text, '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') as units,
    ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from t),
c as (
  select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from u),
p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix
  from c)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
