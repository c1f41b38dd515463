"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each byte is one printable character, each vocabulary entry a piece of such characters with score -rank, and the
normaliser changes nothing. sentencepiece merges the pair with the best score first, leftmost on ties, which is the
merge order of the ranks. Texts are split by a pattern first and each match is encoded alone; decoding maps the pieces'
characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.llm.common import per_part
from factweave.llm.pretokens import PreTokens


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is visible Latin-1, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: bytes as a length-delimited one, a float as fixed 32 bits, an int as a varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is tokens[i] in byte characters with score -i; the unknown piece comes last."""
    chars = byte_chars()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteCodec:
    """Encodes texts to ids and ids to bytes with a serialised model and a pre-token pattern."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor()
        self._model.LoadFromSerializedProto(model)
        chars = byte_chars()
        self._to_chars = dict(enumerate(chars))
        to_byte = {c: b for b, c in enumerate(chars)}
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size() - 1)]
        self._bytes = [bytes(map(to_byte.__getitem__, p)) for p in pieces]
        #: Entries that the merges never reach; a pre-token equal to one still takes its id.
        self._whole = {p: [i] for i, (p, got) in enumerate(zip(pieces, self._model.encode(pieces, num_threads=1), strict=True)) if got != [i]}
        self._texts = PreTokens(pattern, self._encode_tokens)

    def _encode_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        mapped = "\0".join(tokens).encode().decode("latin-1").translate(self._to_chars).split(self._to_chars[0]) if tokens else []
        if len(mapped) != len(tokens):  # a token holds the separator itself
            mapped = [t.encode().decode("latin-1").translate(self._to_chars) for t in tokens]
        made = [self._whole.get(m, ids) for m, ids in zip(mapped, self._model.encode(mapped, num_threads=1), strict=True)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), "<u4", int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, counts = self._texts.encode(texts)
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, and with keep_ids the ids themselves (as bytes).

    A null text counts as empty: no ids, the hashes of no bytes. Each row stands for itself, so repeated rows give
    repeated results and a null doc_id stays null. Other columns of docs are ignored, whatever their names.
    The model is about one MB (the size of the vocabulary) and goes to the workers with the function.
    """
    model = serialise_model(read_ranks(ranks_path))

    def setup() -> Callable[[pa.Array], list[pa.Array]]:
        codec = ByteCodec(model, pattern)

        def of(texts: pa.Array) -> list[pa.Array]:
            made = codec.encode(texts)
            counts, digests = [len(ids) // 4 for ids in made], [hashlib.sha256(ids).hexdigest() for ids in made]
            back = [hashlib.sha256(codec.decode(ids)).hexdigest() for ids in made]
            columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            return [*columns, pa.array(made, pa.binary())] if keep_ids else columns

        return of

    return per_part(docs, setup, n_tokens="long", ids_sha256="string", decoded_sha256="string", **{"ids": "binary"} if keep_ids else {})
