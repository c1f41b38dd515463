"""Token-id files: Simple-8b words in blocks, and a Spark job that writes a corpus in document order and reads it back.

A 64-bit word has a selector in its top four bits and 60 bits of data. Selector s from 1 to 14 means COUNTS[s] values
of 60 // COUNTS[s] bits, lowest first; selector 0 is an escape: the next word holds one value of any 64 bits; 15 is
unused. Values are packed greedily, as many to a word as fit. The stream is cut into blocks of BLOCK ids; each starts
at a word of its own, whose number is in the offsets, so any block can be decoded alone and all words of a kind at once.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.bpe import byte_chars
from factweave.llm.common import lean_worker, parts_of, scratch_path, texts_of
from factweave.llm.pretokens import PreTokens

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Values in a word by selector.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
BLOCK = 4096
#: Ids in one row of the file, about; a document is never split over rows.
SEGMENT = 1 << 18
#: Bytes of text that are cut into distinct words at once.
PART = 8 << 20
ESCAPE = 0


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of 64-bit values and, per block of BLOCK values, the number of its first word."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    bits = np.zeros((blocks, BLOCK + 60), np.int8)  # each block with as many zeros behind it as the fullest word may take
    flat = np.zeros(blocks * BLOCK, np.int8)
    flat[:n] = np.frexp(values.astype(np.float64))[1]  # rounding up near a power of two only asks for more room
    flat[:n][(flat[:n] > 60) & (values >> np.uint64(60) == 0)] = 60
    bits[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    pick, widest, have = np.zeros((blocks, BLOCK), np.int8), bits, 1  # widest: the most bits of a value in the next have places
    for s in range(14, 0, -1):  # where a fuller word fits, all less full ones do
        count = int(COUNTS[s])
        if count > have:
            widest, have = np.maximum(widest[:, : have - count], widest[:, count - have :]), count
        np.copyto(pick, s, where=widest[:, :BLOCK] <= 60 // count)
    pick = pick.reshape(-1)[:n]
    left = np.tile(np.arange(BLOCK, 0, -1), blocks)[:n]
    step = np.minimum(np.where(pick == ESCAPE, 1, COUNTS[pick]), np.minimum(left, n - np.arange(n))).astype(np.uint8).tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, dtype=np.int64)
    chosen = pick[starts]
    place = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.where(chosen == ESCAPE, 2, 1), out=place[1:])
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[mine] + 1] = values[starts[mine]]
            continue
        head, word = starts[mine], np.full(len(mine), int(s) << 60, np.uint64)
        ends = np.minimum((head // BLOCK + 1) * BLOCK, n)
        for k in range(COUNTS[s]):
            inside = head + k < ends
            word |= np.where(inside, values[np.minimum(head + k, n - 1)], np.uint64(0)) << np.uint64(k * (60 // COUNTS[s]))
        words[place[mine]] = word
    return words, place[:-1][np.searchsorted(starts, np.arange(0, n, BLOCK))]


def _decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of some words, with what fills up each block's last word; how many there are up to each word; which words are escaped values."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    escaped = np.zeros(len(words), bool)
    taken = -1
    for i in np.flatnonzero(kind == ESCAPE).tolist():  # a value word may look like an escape, so these few are walked in order
        if i != taken:
            taken = i + 1
            if taken >= len(words):
                raise ValueError("an escape without its value")
            escaped[taken] = True
    if (kind[~escaped] == 15).any():
        raise ValueError("unknown selector 15")
    kind[escaped] = -1
    held = np.where(kind == ESCAPE, 1, np.where(escaped, 0, COUNTS[kind]))
    ends = np.cumsum(held)
    out = np.zeros((ends[-1] if len(ends) else 0), np.uint64)
    for s in np.unique(kind[kind >= 0]).tolist():
        mine = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[ends[mine] - 1] = words[mine + 1]
            continue
        count = int(COUNTS[s])
        width = 60 // count
        shifts = (np.arange(count) * width).astype(np.uint64)
        out[(ends[mine] - count)[:, None] + np.arange(count)] = words[mine][:, None] >> shifts & np.uint64((1 << width) - 1)
    return out, ends, escaped


def unpack_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of one block. Raises ValueError on words that are no whole block of n values."""
    return unpack(words, np.zeros(min(n, 1), np.int64), n)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values from first to last (exclusive) of n; only the blocks that hold them are decoded, all at once."""
    last = n if last is None else last
    if first >= last:
        return np.empty(0, np.uint64)
    lo, hi = first // BLOCK, (last - 1) // BLOCK
    begin = offsets[lo : hi + 1] - offsets[lo]
    values, ends, escaped = _decode(words[offsets[lo] : np.append(offsets[1:], len(words))[hi]])
    bounds = np.append(np.insert(ends, 0, 0)[begin], len(values))
    stated = np.minimum(BLOCK, n - BLOCK * np.arange(lo, hi + 1))
    if (np.diff(bounds) < stated).any() or escaped[begin[begin < len(escaped)]].any():
        raise ValueError("words for fewer values than stated")
    return np.concatenate([values[a : a + c] for a, c in zip(bounds.tolist(), stated.tolist())])[first - lo * BLOCK : last - lo * BLOCK]


@lru_cache(maxsize=2)  # loading takes longer than a small task
def _load(path: str, added: bool) -> Tokenizer:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    return tokenizer


class IdEncoder:
    """Texts to ids by the tokenizers library, with no special tokens put around them.

    added: the file's added tokens get their ids where a text holds them, as in the library's own call; else they are text.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = tokenizer = _load(path, added)
        self._letters = isinstance(tokenizer.pre_tokenizer, ByteLevel) and tokenizer.normalizer is None
        self._to_chars = dict(enumerate(byte_chars()))
        self._plain = PreTokens(pattern, self._encode_tokens, self._encode_words if self._letters else None)
        known = tokenizer.get_added_tokens_decoder() if added else {}
        if any(t.single_word or t.lstrip or t.rstrip for t in known.values()):
            raise ValueError("added tokens that take more or less than their content")
        self._added = {t.content: np.array([i], "<u4") for i, t in known.items()}
        self._cut = re.compile(f"({'|'.join(map(re.escape, sorted(self._added, key=len, reverse=True)))})").split

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that are one pre-token each go straight to the library's model, in the characters that it knows bytes by."""
        tokenize = self._tokenizer.model.tokenize
        mapped = "\n".join(words).encode().decode("latin-1").translate(self._to_chars).split(self._to_chars[10]) if words else []
        ids, sizes = array("I"), array("q")
        for word in mapped:
            made = tokenize(word)
            sizes.append(len(made))
            ids.extend([t.id for t in made])
        return np.array(ids, "<u4"), np.array(sizes, np.int64)

    def _encode_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self._tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), "<u4", int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each."""
        held = [c for c in self._added if pc.any(pc.match_substring(texts, c)).as_py()]
        if not held:
            return self._plain.encode(texts)
        cuts = [self._cut(t) if any(c in t for c in held) else [t] for t in texts.to_pylist()]  # every second piece is an added token
        ids, counts = self._plain.encode(pa.array([piece for pieces in cuts for piece in pieces[::2]], pa.string()))
        made = iter(np.split(ids, np.cumsum(counts)[:-1]))
        whole = [np.concatenate([self._added[p] if k % 2 else next(made) for k, p in enumerate(pieces)]) for pieces in cuts]
        return np.concatenate(whole), np.array([len(w) for w in whole], np.int64)


FILE_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("offsets", pa.list_(pa.int64()))])
FILE_SCHEMA = "shard int, segment int, shard_start long, n_ids long, doc_ids array<long>, lengths array<long>, words binary, offsets array<long>"


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int, added: bool = False) -> None:
    """Encodes each text of docs (doc_id, text; null: empty), adds end_id, and writes the ids in ascending doc_id order.

    Shards are ranges of doc_id (null ids first; equal ids together, in order of text). A row of the Parquet files is a
    segment of whole documents: packed words as little-endian bytes, block offsets, the documents' ids and lengths, and
    the ids in its shard before it. No number needs another shard, so a lost task is done again alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        encoder = IdEncoder(tokenizer_path, pattern, added)
        shard, segment, before, doc_ids, lengths, held = TaskContext.get().partitionId(), 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            sizes = np.concatenate(lengths)
            words, offsets = pack(np.concatenate(held))
            cells = [[shard], [segment], [before], [int(sizes.sum())], [pa.concat_arrays(doc_ids)], [sizes], [words.astype("<u8").tobytes()], [offsets]]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cells, FILE_ARROW.types, strict=True)], schema=FILE_ARROW)

        def rows(part: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
            """The documents of a part and their ids, in pieces of about SEGMENT ids."""
            ids, counts = encoder.encode(texts_of(part))
            ends = np.cumsum(counts)
            ids, counts = np.insert(ids, ends, end_id), counts + 1
            ends += np.arange(1, len(ends) + 1)
            at = 0
            while at < len(counts):
                done = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + SEGMENT)))
                yield part.column("doc_id").slice(at, stop - at), counts[at:stop], ids[done : ends[stop - 1]]
                at = stop

        for batch in batches:
            for part in parts_of(batch, PART):
                for some, counts, ids in rows(part):
                    doc_ids.append(some)
                    lengths.append(counts)
                    held.append(ids)
                    if sum(map(len, held)) >= SEGMENT:
                        yield flush()
                        segment, before = segment + 1, before + int(sum(map(np.sum, lengths)))
                        doc_ids, lengths, held = [], [], []
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids_shard.

    Starts come from the number of ids per shard, one small row for each.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row] for name in batch.schema.names}
                counts, doc_ids = cell["lengths"].values.to_numpy(), cell["doc_ids"].values
                ids = unpack(np.frombuffer(cell["words"].as_buffer(), "<u8"), cell["offsets"].values.to_numpy(), cell["n_ids"].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                columns = [doc_ids, pa.array(cell["shard_start"].as_py() + ends - counts), pa.array(counts), pa.array(crc, pa.int64()), pa.array([cell["shard"].as_py()] * len(crc), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n_tokens", "ids_crc32", "shard"])

    documents = files.mapInArrow(run, "doc_id long, at long, n_tokens long, ids_crc32 long, shard int")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return documents.join(shards, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def id_file_report(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, added: bool = False) -> DataFrame:
    """The rows of read_ids() after write_ids() of docs to the shared folder. An empty table gives no rows. added: see IdEncoder."""
    spark = docs.sparkSession
    path = scratch_path(spark, "ids")
    write_ids(docs, path, tokenizer_path, pattern, end_id, added)
    return read_ids(spark, path)
