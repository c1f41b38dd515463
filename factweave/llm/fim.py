"""Fill-in-the-middle: cut texts into prefix, middle and suffix at units, and move the middle to the end.

A text is laid out in blocks of fixed size (bytes of UTF-8). A Fenwick tree over the blocks holds how many units end and how
many code points begin in each; a descent by binary lifting finds the block in which the k-th unit ends and the code points
before that block, and only that block is then searched for the place itself. Rows are judged one by one, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import SPACES, give_back, lean_worker, parts_of, texts_of

#: Bytes of text in a block.
BLOCK = 512
#: Fixed values of the output: the marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percentage of texts that are rearranged, and of those the percentage with the suffix first.
RATE, SUFFIX_FIRST = 50, 80

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True


class Fenwick:
    """Sums over blocks: column 0 counts units that end there, column 1 code points that begin there."""

    def __init__(self, counts: np.ndarray):
        at = np.arange(1, len(counts) + 1)
        sums = np.concatenate((np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, axis=0)))
        self.nodes = sums[at] - sums[at & (at - 1)]  # node i covers as many blocks up to i as its lowest bit says
        self.top = 1 << len(counts).bit_length() >> 1

    def descend(self, k: int) -> tuple[int, int, int]:
        """The block in which the k-th unit ends (k from 1), which of the block's units it is, and the code points before the block."""
        at, chars, step = 0, 0, self.top
        while step:
            if at + step <= len(self.nodes) and self.nodes[at + step - 1, 0] < k:
                at += step
                k -= int(self.nodes[at - 1, 0])
                chars += int(self.nodes[at - 1, 1])
            step >>= 1
        return at, k, chars


class Layout:
    """Where units end and code points begin in one text."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        space = _SPACE[data]
        self.ends = ~space
        self.ends[:-1] &= space[1:]
        self.ends[-1:] = True  # white space at the end of a text is a unit of its own
        self.begins = (data & 0xC0) != 0x80
        self.block = block
        starts = np.arange(0, len(data), block)
        counts = np.column_stack([np.add.reduceat(x.astype(np.int64), starts) for x in (self.ends, self.begins)]) if len(data) else np.zeros((0, 2), np.int64)
        self.units = int(counts[:, 0].sum())
        self.tree = Fenwick(counts)

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points up to the end of the k-th unit."""
        if not k:
            return 0, 0
        at, left, chars = self.tree.descend(k)
        low = at * self.block
        end = low + int(np.flatnonzero(self.ends[low : low + self.block])[left - 1]) + 1
        return end, chars + int(np.count_nonzero(self.begins[low:end]))


def _draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits drawn for a document."""
    made = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(made[k : k + 4], "big") for k in range(0, 16, 4)]


def rearrange(text: bytes, draws: list[int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of the prefix and of the middle, and the text as it goes out."""
    layout = Layout(np.frombuffer(text, np.uint8), block)
    n = layout.units
    if not text or draws[2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (a, chars_a), (b, chars_b) = layout.cut(first), layout.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < suffix_first:
        return n, "spm", chars_a, chars_b - chars_a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", chars_a, chars_b - chars_a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points, null if plain), output (the text).

    Cuts and form are drawn from seed and doc_id (null: an empty one), so a run that is repeated gives the same. A text that
    is null or empty, or holds one of the marks, stays plain. Each row is judged by itself, so rows that repeat a doc_id keep
    their own texts; an empty table stays empty; columns other than doc_id and text are ignored.
    """
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            for part in parts_of(batch):
                ids, texts = part.column("doc_id"), texts_of(part).cast(pa.binary())
                made = [rearrange(text.as_py(), _draws(doc_id, seed), rate, suffix_first) for doc_id, text in zip(ids.to_pylist(), texts, strict=True)]
                cells = list(zip(*made, strict=True)) if made else [[]] * 5
                arrays = [ids, *(pa.array(c, kind) for c, (_, kind) in zip(cells, fields[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])
        give_back()

    made = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged. No text with marks is, so the marks of the output are the only ones in it."""
    parts = F.split(output, "<[PSM]>", -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
