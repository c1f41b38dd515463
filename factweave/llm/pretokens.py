"""Encoding by distinct words: what a tokenizer does to a word is asked once for some texts, not at each occurrence."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of keys and ids that are remembered from one call to the next, about, and what a pre-token takes besides its characters.
ROOM, ENTRY = 32 << 20, 140

_MARKS = ".,;:!?|"
#: A line feed or nothing, and Latin letters: with a space or the line feed before it, such a word is one pre-token.
_LETTERS = r"^\n?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+$"


Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class PreTokens:
    """Ids of whole texts for a tokenizer that encodes each match of a pattern alone.

    With public_tokenizers.PATTERN a single space or line feed between two other characters always begins a pre-token. Texts
    whose white space is all such are cut there, in Arrow; a mark at the end of a word of letters is cut off too. What is left
    is looked up once for each distinct piece of the given texts, and the ids are gathered by piece. Other texts, and all
    texts of another pattern, are split by the pattern.
    encode_tokens gets distinct pre-tokens and returns their ids, one after the other, and the number of ids of each;
    encode_words, if given, does so for pre-tokens of a space and Latin letters.
    """

    def __init__(self, pattern: str, encode_tokens: Encode, encode_words: Encode | None = None):
        import regex

        self._split = regex.compile(pattern).findall
        self._encode_tokens = encode_tokens
        self._encode_words = encode_words or encode_tokens
        self._cuts = pattern == public_tokenizers.PATTERN
        self._forget()
        self._marks = encode_tokens(list(_MARKS))

    def _forget(self) -> None:
        self._keys = pa.array([], pa.string())  # a line feed and what follows it, or what follows a space
        self._pool, self._sizes = np.empty(0, "<u4"), np.empty(0, np.int64)  # the ids of all keys, and their number for each
        self._tokens: dict[str, bytes] = {}  # ids of other pre-tokens
        self._room = ROOM

    def _split_piece(self, piece: str) -> list[str]:
        return ["\n", *self._split(piece[1:])] if piece[0] == "\n" else self._split(f" {piece}")

    def _ids(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each list of pre-tokens."""
        tokens = self._tokens
        fresh = list(set().union(*lists).difference(tokens))
        ids, sizes = self._encode_tokens(fresh)
        data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(sizes)
        tokens.update((t, data[a:b]) for t, a, b in zip(fresh, (ends - 4 * sizes).tolist(), ends.tolist(), strict=True))
        self._room -= sum(map(len, fresh)) + ENTRY * len(fresh)
        made = [b"".join([tokens[t] for t in some]) for some in lists]
        return np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4

    def _learn(self, letters: pa.Array, others: pa.Array) -> None:
        """Adds keys that aren't known yet: those of letters only, then the others."""
        led = pc.invert(pc.starts_with(letters, "\n"))
        new = [letters.filter(led), letters.filter(pc.invert(led)), others]
        made = [self._encode_words([f" {w}" for w in new[0].to_pylist()])]
        made += [self._ids([self._split_piece(w) for w in some.to_pylist()]) for some in new[1:]]
        self._pool = np.concatenate([self._pool, *(ids for ids, _ in made)])
        self._sizes = np.concatenate([self._sizes, *(sizes for _, sizes in made)])
        self._keys = pa.concat_arrays([self._keys, *new])

    def _places(self, keys: pa.Array, lettered: np.ndarray) -> np.ndarray:
        """Where each of some distinct keys stands among the known ones; lettered says which are of letters only."""
        found = pc.index_in(keys, value_set=self._keys)
        if found.null_count:
            new, plain = keys.filter(pc.is_null(found)), pa.array(lettered[pc.is_null(found).to_numpy(zero_copy_only=False)])
            self._learn(new.filter(plain), new.filter(pc.invert(plain)))
            found = pc.index_in(keys, value_set=self._keys)
        return found.to_numpy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, none null), one after the other, and the number of ids of each text."""
        if self._room < self._keys.nbytes + self._pool.nbytes + self._sizes.nbytes:
            self._forget()
        if not len(texts) or not self._cuts:
            return self._ids([self._split(t) for t in texts.to_pylist()])
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        first, last = first[:-1] - first[0], first[1:] - first[0] - 1
        coded = lists.flatten().dictionary_encode()
        at, pieces = coded.indices.to_numpy(), coded.dictionary
        stems = pc.utf8_rtrim(pieces, _MARKS)
        cut = pc.subtract(pc.binary_length(pieces), pc.binary_length(stems)).to_numpy()
        plain = pc.and_(pc.match_substring_regex(stems, _LETTERS), pa.array(cut < 2))
        is_plain = plain.to_numpy(zero_copy_only=False)

        # pieces that aren't letters: where one is empty or has white space at an end, the text has other white space than single ones
        others = pieces.filter(pc.invert(plain)).to_pylist()
        bodies = [w[1:] if w[:1] == "\n" else w for w in others]
        edged = np.zeros(len(pieces), bool)
        edged[~is_plain] = [not b or b != b.strip() for b in bodies]
        bad = edged[at]
        bad[first] = False
        ends = np.flatnonzero(bad[last])
        bad[last[ends]] = [pieces[k].as_py() != "\n" for k in at[last[ends]].tolist()]
        uneven = np.logical_or.reduceat(bad, first)
        uneven |= np.fromiter((w != w.strip() for w in pieces.take(pa.array(at[first])).to_pylist()), bool, len(texts))

        keys = pc.if_else(plain, stems, pieces).dictionary_encode()
        names, key_of = keys.dictionary, keys.indices.to_numpy()
        inner = np.ones(len(at), bool)
        inner[first] = False
        if uneven.any():
            inner &= ~np.repeat(uneven, last - first + 1)
        key_at = key_of[at]
        needed = np.zeros(len(names), bool)
        needed[key_at[inner]] = True
        lettered = np.zeros(len(names), bool)
        lettered[key_of[is_plain]] = True
        places = self._places(names.filter(pa.array(needed)), lettered[needed])
        heads = [t if u else pieces[k].as_py() for t, u, k in zip(texts.to_pylist(), uneven.tolist(), at[first].tolist(), strict=True)]

        # known keys, each mark, each text's head (all of it, if uneven), and one without ids
        begun, begun_sizes = self._ids([self._split(h) for h in heads])
        data = np.concatenate([self._pool, self._marks[0], begun])
        sizes = np.concatenate([self._sizes, self._marks[1], begun_sizes, [0]])
        starts = np.cumsum(sizes) - sizes
        marks, nothing = len(self._sizes), len(sizes) - 1
        place = np.full(len(names), nothing, np.int32)
        place[needed] = places
        mark = np.full(len(pieces), nothing, np.int32)
        marked = np.flatnonzero(is_plain & (cut == 1))
        mark[marked] = marks + pc.index_in(pc.utf8_slice_codeunits(pieces.take(pa.array(marked)), -1), value_set=pa.array(list(_MARKS))).to_numpy()
        order = np.full((len(at), 2), nothing, np.int32)
        order[:, 0][inner] = place[key_at[inner]]
        order[:, 1][inner] = mark[at[inner]]
        order[first, 0] = marks + len(_MARKS) + np.arange(len(texts))
        lengths = sizes[order]
        counts = np.add.reduceat(lengths.sum(axis=1), first)
        order, lengths = order.reshape(-1), lengths.reshape(-1)
        order, lengths = order[lengths > 0], lengths[lengths > 0]
        stop = np.cumsum(lengths)
        source = np.repeat(starts[order] - (stop - lengths), lengths)
        source += np.arange(len(source))
        return data[source], counts
