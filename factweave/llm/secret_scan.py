"""Secret scan: pattern spans, and random strings found by how few characters their tokens hold.

A tokenizer's vocabulary has long entries for words and short ones for letters met at random. Runs of key-like characters
that the vocabulary spells with few characters per token are random; digests of known lengths, UUIDs and numbers are set
aside first, and compounds whose parts are all words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

from factweave.llm.bpe import read_ranks
from factweave.llm.common import per_text

#: Shortest run that the token test looks at, and the characters per token below which it is random.
MIN_RUN, MAX_RATIO = 16, 2.2

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
JOINT = re.compile(r"[+/_=-]+")
DIGITS = "0123456789"
KINDS = ("assign", "access", "hex", "random")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns, ordered."""
    low = text.casefold() if not text.isascii() else text.lower()
    found = []
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def of_words(parts: list[str], n_tokens) -> bool:
    """Whether all parts of a compound are words by the token test, with numbers behind or between them.

    Upper case is tested as lower case. Parts of one or two letters tell nothing; words must make up as many characters as they do.
    """
    words = short = 0
    for part in parts:
        stem = part.rstrip(DIGITS)
        if not stem or DIGEST.fullmatch(part):
            continue
        if len(stem) > MAX_RATIO * n_tokens(stem.lower() if stem.isupper() else stem):
            words += len(stem)
        elif len(stem) <= 2:
            short += len(stem)
        else:
            return False
    return words >= short


def outside(runs: Iterable[tuple[int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What spans of base leave of runs, which come in order and don't overlap; pieces of fewer than MIN_RUN characters tell nothing."""
    at, reach = 0, 0
    for start, end in runs:
        while at < len(base) and base[at][0] <= start:
            reach = max(reach, base[at][2])
            at += 1
        start, ahead = max(start, reach), at
        while ahead < len(base) and base[ahead][0] < end:
            if base[ahead][0] - start >= MIN_RUN:
                yield start, base[ahead][0]
            start = max(start, base[ahead][2])
            ahead += 1
        if end - start >= MIN_RUN:
            yield start, end


def random_spans(text: str, n_tokens, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs with letters and few characters per token, as a whole or in a long part; of a run that meets base spans, what they leave of it.

    Digests, UUIDs and runs without letters are set aside, and compounds of words for which the whole has few by its joints only.
    """
    found = []
    for start, end in outside((m.span() for m in RUN.finditer(text)), base):
        run = text[start:end]
        if not any(c.isalpha() for c in run) or DIGEST.fullmatch(run) or UUID.fullmatch(run):
            continue
        parts = [p for p in JOINT.split(run) if p]
        random = len(run) <= MAX_RATIO * n_tokens(run)
        if random and len(parts) > 1:
            random = not of_words(parts, n_tokens)
        elif len(parts) > 1:
            random = any(len(p) >= MIN_RUN and not p.isdigit() and not DIGEST.fullmatch(p) and len(p) <= MAX_RATIO * n_tokens(p) for p in parts)
        if random:
            found.append((start, 3, end))
    return found


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each whole text (null: empty).

    Spans are kind:start:end in code points, end exclusive, of whole matches. A text without any has counts of 0, the
    hash of the empty string and empty spans. Rows are judged one by one: repeated rows repeat, a null doc_id stays null,
    and other columns are ignored.
    """

    def setup() -> Callable[[list[str]], list[tuple]]:
        import tiktoken

        ranks = {token: rank for rank, token in enumerate(read_ranks(ranks_path))}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def one(text: str) -> tuple:
            base = base_spans(text)
            spans = base + random_spans(text, lambda s: len(encoding.encode_ordinary(s)), base)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            return (*counts, hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans))

        return lambda texts: [one(text) for text in texts]

    return per_text(docs, setup, n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string")
