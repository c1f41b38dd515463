"""The text operators against plain Python, exact round trips and held-out accuracy, with odd rows of every kind."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import bpe, decontam, idfile, langid, license_scan, linededup, minhash, pretokens, registry, secret_scan, toxicity, vptree

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en"), (2, "", None), (3, "  \n\n\t ", "en"), (4, "The same line of text that everybody has.\nown a", "en"), (5, "the same line of text that everybody has. \nown b", "en"),
    (6, "\x0bTHE SAME LINE OF TEXT THAT EVERYBODY HAS.", "en"), (7, "naïve café 东京 ǅ ſ  x  y z <|endoftext|> it's 12½", "fr"), (8, "word " * 6000, "en"), (9, "word " * 6000, "en"),
    (9, "word " * 6000, "en"), (None, "a text without an id\nThe same line of text that everybody has.", "de"), (10, "one two", "de"), (11, "ONE\ttwo", "de"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names operators use themselves."""
    names = ("key_a", "ids", "hub", "words", "norm", "kept_text", "component", "_text", "score")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(row):
    return [(x is not None, str(x)) for x in row]


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("source", ["odd", "documents", "empty"])
def test_bpe_is_that_of_the_library_and_decodes(source, request):
    docs = request.getfixturevalue(source)
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(MULTI))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text in texts(docs):
        ids = encoding.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    same(bpe.encode_documents(docs, MULTI, public_tokenizers.PATTERN).collect(), want)


@pytest.mark.parametrize("top", [1, 2, 50_000, 2**32, 2**60, 2**64])
def test_simple8b_gives_back_every_value(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 59, 61, idfile.BLOCK, idfile.BLOCK + 1, 3 * idfile.BLOCK - 5):
        values = rng.integers(0, top, n, dtype=np.uint64)
        values[: n // 3] = 0
        words, offsets = idfile.pack(values)
        assert (idfile.unpack(words, offsets, n) == values).all()
        assert (idfile.unpack(words, offsets, n, n // 2, n) == values[n // 2 :]).all()


@pytest.mark.parametrize("source", ["odd", "documents", "empty"])
def test_id_files_hold_what_the_tokenizer_gives(source, request):
    from tokenizers import Tokenizer

    docs, path = request.getfixturevalue(source), public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(idfile.id_file_report(docs, path, public_tokenizers.PATTERN, 2, added=True).collect(), want)


def test_registered_id_files_hold_what_the_untouched_tokenizer_gives(spark, tmp_path):
    from tokenizers import Tokenizer

    mark = "<|endoftext|>"
    held = ["a  b c", f"a {mark} b", mark, f"{mark}{mark}x  {mark}\n y", f"{mark[:-1]} <|{mark}|>", f"one two {mark}three  {mark} ", "", None, f"naïve 东京{mark}it's", "the last"]
    spark.createDataFrame(list(enumerate(held)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc_id, text in enumerate(held):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(registry.op2_simple8b_ids(spark, str(tmp_path)).collect(), want)


def test_encoders_agree_with_the_libraries_on_random_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    odd = " \n\t\x0b\x1c\u00a0\u2003\u3000'’.,;:!?|-_aAzZéß東ж12½²ªº\u0301\u200d😀\u1e9eǅ"
    words = ["the", "Word", "naïve", "it's", "x1", "42", "end.", "<|endoftext|>", "...", "Ünder", "straße"]
    made = ["".join(rng.choice(list(odd), rng.integers(0, 30))) for _ in range(1500)]
    made += [rng.choice([" ", "\n", "  ", " \n"]).join(rng.choice(words, rng.integers(1, 12))) for _ in range(1500)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    for added in (True, False):
        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = not added
        encoder = idfile.IdEncoder(path, public_tokenizers.PATTERN, added)
        ids, counts = encoder.encode(pa.array(made))
        want = [e.ids for e in plain.encode_batch(made, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    ranks = bpe.read_ranks(MULTI)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    codec = bpe.ByteCodec(bpe.serialise_model(ranks), public_tokenizers.PATTERN)
    got = codec.encode(pa.array(made))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [encoding.encode_ordinary(t) for t in made]
    assert [codec.decode(g) for g in got] == [t.encode() for t in made]


def test_encoders_agree_from_call_to_call_with_little_room(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for room in (0, 20_000, pretokens.ROOM):
        monkeypatch.setattr(pretokens, "ROOM", room)
        encoder = idfile.IdEncoder(path, public_tokenizers.PATTERN, True)
        for _ in range(6):
            made = [" ".join("".join(rng.choice(list("abé1.\n"), rng.integers(1, 4))) for _ in range(30)) for _ in range(20)] + ["", "\n"]
            ids, counts = encoder.encode(pa.array(made))
            want = [e.ids for e in plain.encode_batch(made, add_special_tokens=False)]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_damaged_words_are_refused():
    words, offsets = idfile.pack(np.arange(9000, dtype=np.uint64) << np.uint64(3))
    with pytest.raises(ValueError):
        idfile.unpack(words[:-1], offsets, 9000)
    with pytest.raises(ValueError):
        idfile.unpack_block(np.array([15 << 60], np.uint64), 1)
    with pytest.raises(ValueError):
        idfile.unpack_block(np.array([0], np.uint64), 1)


def test_other_patterns_split_whole_texts():
    import pyarrow as pa

    codec = bpe.ByteCodec(bpe.serialise_model(bpe.read_ranks(MULTI)), r"\S+|\s+")
    encoding = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(MULTI))}, special_tokens={})
    made = ["a plain text", "two  spaces\nand lines", ""]
    assert [np.frombuffer(g, "<u4").tolist() for g in codec.encode(pa.array(made))] == [encoding.encode_ordinary(t) for t in made]


def plain_lines(rows, shortest=20, enough=3):
    holders = {}
    for doc_id, text in rows:
        for k in {lower(line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n")}:
            if len(k) >= shortest:
                holders.setdefault(k, []).append(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(lower(line.strip(" \t\n\x0b\x0c\r")), [])
            known = [d for d in held if d is not None]
            gone = len(held) >= enough and known and (doc_id is None or doc_id < max(known))
            if not gone:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("source", ["odd", "documents", "empty"])
def test_repeated_lines_stay_in_the_last_document(source, request):
    docs = request.getfixturevalue(source)
    same(linededup.line_report(docs).collect(), plain_lines(texts(docs)))


def test_extra_columns_survive_line_dedup(odd):
    assert set(odd.columns) <= set(linededup.dedup_lines(odd).columns)


def plain_components(rows, width, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append(frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset())
    node = [d for d, _ in rows]
    parent = {d: d for d in node}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and None not in (node[i], node[j]) and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(node[i]), find(node[j])
                parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in zip(node, sets, strict=True)]


@pytest.mark.parametrize("source", ["odd", "documents", "empty"])
def test_near_duplicates_are_those_of_all_pairs(source, request):
    docs = request.getfixturevalue(source)
    for width in (4, 5):
        same(minhash.near_duplicates(docs, width, 80).collect(), plain_components(texts(docs), width, 80))


def test_links_that_hubs_do_not_see_are_found(spark, monkeypatch):
    """A chain of texts, each near its neighbours only, in blocks of a few texts."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    same(got, plain_components(rows, 4, 80))


def test_links_of_each_text_of_a_repeated_doc_id_count(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = lambda text: text + " end"
    rows = [(5, a), (5, b), (6, near(a)), (7, near(b)), (8, c), (9, c), (9, d), (4, near(d)), (9, None), (3, ""), (3, near(near(d))), (10, None), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(minhash.near_duplicates(docs, 4, 80).collect(), plain_components(rows, 4, 80))


def test_blocks_of_one_hub_are_compared_across(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.random()}" for w in words)) for i in range(120)]
    same(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect(), plain_components(rows, 4, 80))


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.concatenate((a[:300], np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))))
    estimate = (minhash.signature(a, 1024) == minhash.signature(b, 1024)).mean()
    assert abs(estimate - 0.6) < 0.06


def test_spaced_seeds_find_passages_with_substitutions(spark, empty):
    words = [f"term{i}" for i in range(30)]
    changed = [w if i % 7 else "other" for i, w in enumerate(words)]
    rows = [(1, "Before it. " + " ".join(words) + " and after."), (2, "x " + " ".join(changed)), (3, " ".join(reversed(words))), (4, None), (5, ""), (6, " ".join(words[:9])), (1, "Before it. " + " ".join(words) + " and after.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(7))
    items = spark.createDataFrame([(70, " ".join(words).upper()), (71, "too short to stand anywhere"), (72, None), (73, "...")], "item_id long, text string")
    same(decontam.contaminated(docs, items).select("doc_id", "item_id").collect(), [(1, 70), (2, 70)])
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0


def plain_leaks(docs, items):
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for doc_id, text in docs:
        words = norm(text)
        at = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        for item_id, item in items:
            item = norm(item)
            width = min(20, len(item))
            for shift in {i - j for j, w in enumerate(item) for i in at.get(w, ())}:
                hit = [0 <= j + shift < len(words) and words[j + shift] == w for j, w in enumerate(item)]
                if any(100 * sum(hit[s : s + width]) >= 80 * width for s in range(len(item) - width + 1)):
                    found.add((doc_id, item_id))
                    break
    return found


def test_leaks_are_those_of_all_alignments(spark, documents):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = decontam.contaminated(documents, items).select("doc_id", "item_id").collect()
    same(got, plain_leaks(texts(documents), [(r["item_id"], r["text"]) for r in items.collect()]))


def test_short_items_are_found_under_every_tolerated_substitution(spark):
    from itertools import combinations

    items, docs, want = [], [], set()
    for size, most in ((10, 2), (11, 2), (12, 2), (13, 2), (15, 3)):
        words = [f"w{size}x{i}" for i in range(size)]
        items.append((size, " ".join(words)))
        for hit in combinations(range(size), most):
            number = len(docs)
            docs.append((number, "before it " + " ".join("other" if i in hit else w for i, w in enumerate(words)) + " after it"))
            want.add((number, size))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= want
    for size, least in ((10, 1.0), (11, 1.0), (12, 1.0), (13, 0.97), (15, 0.95)):
        mine = {pair for pair in want if pair[1] == size}
        assert len(found & mine) >= least * len(mine), size


def test_items_of_a_few_words_are_those_of_all_alignments(spark, documents):
    question = "what is the boiling point of water at sea"
    docs = [(1, f"Asked: {question}?"), (2, question.replace("water", "wine")), (3, question.replace("water", "wine").replace("sea", "home")), (4, "a b c d"), (5, "a x c d and b c d e"), (6, "one"), (7, "b c d"), (8, None), (9, "One's")]
    items = [(10, question), (11, "b c d"), (12, "a b c d e"), (13, "one"), (14, "d e"), (15, "a b c d e f g"), (16, None), (17, "?")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = plain_leaks(docs, items)
    assert {(1, 10), (2, 10), (4, 11), (4, 12), (6, 13), (9, 13)} <= want and (3, 10) not in want
    same(got.select("doc_id", "item_id").collect(), want)
    first = [(r["item_id"], " ".join(r["text"].split()[3 : 3 + r["item_id"] % 9 + 1])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = decontam.contaminated(documents, spark.createDataFrame(first, "item_id long, text string"))
    same(got.select("doc_id", "item_id").collect(), plain_leaks(texts(documents), first))


@pytest.mark.parametrize("source", ["odd", "documents", "empty"])
def test_license_base_is_that_of_words(source, request):
    docs = request.getfixturevalue(source)
    want = []
    for doc_id, text in texts(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            parts = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            places += hits
            labels |= {label} if hits else set()
        want.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = license_scan.scan_licenses(docs)
    same(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), want)
    assert got.where("score < 0 OR score > 1").count() == 0


def test_license_index_adds_labels(spark):
    filler = [(i, f"plain words number {i} of the text in this and that") for i in range(40)]
    rows = [*filler, (100, "This work is licensed under the GNU General Public License, version 3."), (101, "The general public likes this work of the lesser kind")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "gpl" and got[101] == "" and not any(got[i] for i, _ in filler)


GPL = "This work is licensed under the GNU General Public License, version 3."


def test_license_index_labels_a_notice_that_most_documents_hold(spark):
    rows = [(i, f"{GPL} And text number {i}.") for i in range(6)] + [(9, "plain words"), (10, None)]
    for held in (rows, rows[:1]):
        got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(spark.createDataFrame(held, "doc_id long, text string")).collect()}
        assert all(got[i][0] == "gpl" and got[i][1] > 0 for i, text in held if text and GPL in text)
        assert all(got[i] == ("", 0.0) for i, text in held if not text or GPL not in text)


def test_license_variants_of_a_notice_are_told_apart(spark):
    whole = {label: notice for label, notice, _ in license_scan.TEMPLATES if len(notice.split()) > 40}
    assert len(whole) > 9
    changed = whole["bsd-3-clause"].replace("copyright holder or contributors", "copyright owner or contributors").replace("tort", "TORT,")
    files = [*((i, f"words before, {i} of them\n/* {whole[label]} */ and after") for i, label in enumerate(whole)), (50, f"{changed} and a tort of contract, exemplary negligence, interruption"), (51, " ".join(sorted(whole["isc"].split())))]
    filler = [(100 + i, f"clean words number {i} about the weather and the software of the day") for i in range(40)]
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in license_scan.scan_licenses(spark.createDataFrame([*files, *filler], "doc_id long, text string")).collect()}
    general = {"bsd", "gpl", "lgpl", "agpl"}
    assert [got[i] - general for i in range(len(whole))] == [{label} for label in whole]
    assert got[50] == {"bsd", "bsd-3-clause"} and got[51] == set() and not any(got[i] for i, _ in filler)


def test_license_index_finds_each_notice_of_a_file(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    long = "hereby neighboring compliance attribution redistribution noncommercial affero mozilla waived extent " + "plain words " * 3000
    rows = [(i, f"{GPL} And text number {i}.") for i in range(6)] + [(7, f"{GPL} {bsd}: and more."), (8, f"{long} {GPL} {long}"), (9, f"{bsd} and {long}"), (10, f"{long} the GNU of the public")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(6), "gpl") | {7: "bsd,gpl", 8: "gpl", 9: "bsd", 10: ""}


def plain_notices(rows):
    """labels and score by the rules: key phrase, the rarest words of the notice that the file holds, and how many agree on one shift."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or "")) for _, text in rows]
    total = len(rows)
    held = {w: sum(w in set(words) for words in split) for w in license_scan.VOCABULARY}
    idf = {w: np.log((total + 1.0) / max(n, 1)) for w, n in held.items()}
    out = []
    for (doc_id, _), words in zip(rows, split, strict=True):
        text, labels, best = f" {' '.join(words)} ", set(), 0.0
        base = {label for phrase, label in license_scan.PHRASES.items() if f" {phrase} " in text}
        for label, notice, key in license_scan.TEMPLATES:
            parts = notice.split()
            rare = [w for w in sorted(set(parts), key=lambda w: (-idf[w], w)) if w in words][: license_scan.RAREST]
            if f" {key} " not in text:
                continue
            shifts = {}
            for i, w in enumerate(words):
                for j, p in enumerate(parts):
                    if w == p and w in rare:
                        shifts.setdefault(i - j, []).append(idf[w])
            asked = sum(p in rare for p in parts)
            good = [sum(v) for v in shifts.values() if len(v) >= 2 and len(v) >= license_scan.AGREE * asked]
            if good:
                labels.add(label)
                best = max(best, max(good) / sum(idf[p] for p in parts))
        out.append((doc_id, ",".join(sorted(base | labels)), round(1.0 if base else min(1.0, best), 9)))
    return out


@pytest.mark.parametrize("source", ["odd", "documents", "empty"])
def test_license_labels_and_scores_are_those_of_the_rules(source, request):
    docs = request.getfixturevalue(source)
    got = [(r["doc_id"], r["labels"], round(r["score"], 9)) for r in license_scan.scan_licenses(docs).collect()]
    same(got, plain_notices(texts(docs)))


def plain_secrets(text):
    """Base spans by walking over the text, one kind after the other."""
    spans, run = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    names = ["password", "passwd", "secret", "token", "api_key", "apikey"]

    def reach(i, chars):
        while i < len(text) and text[i] in chars:
            i += 1
        return i

    i = 0
    while i < len(text):
        name = next((n for n in names if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i : i + len(n)]) == n), None)
        j = i + len(name or "")
        if name:
            j = reach(j, "\"'") if text[j : j + 1] in ("'", '"') and text[j : j + 1] else j
            j = min(j, i + len(name) + 1)
            j = reach(j, " ")
            if text[j : j + 1] in (":", "="):
                j = reach(j + 1, " ")
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                end = reach(j, run)
                if end > j:
                    if end - j >= 8:
                        spans.append((i, 0, end))
                    i = end
                    continue
        i += 1
    for kind, start, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", set("0123456789abcdef"), 32)):
        i = 0
        while i < len(text):
            if text.startswith(start, i) and (end := reach(i + len(start), chars)) > i + len(start):
                if end - i >= least:
                    spans.append((i, kind, end))
                i = end
            else:
                i += 1
    return sorted(spans)


@pytest.mark.parametrize("source", ["odd", "documents", "empty"])
def test_secret_base_columns_are_those_of_a_plain_walk(source, request):
    docs = request.getfixturevalue(source)
    want = []
    for doc_id, text in texts(docs):
        spans = plain_secrets(text or "")
        spelt = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want.append((doc_id, *[sum(k == kind for _, k, _ in spans) for kind in range(3)], hashlib.sha256(spelt.encode()).hexdigest()))
    got = secret_scan.scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect(), want)


def test_random_runs_are_told_from_words():
    """Recall on random strings and precision on names, of the token test as registered."""
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = lambda s: len(encoding.encode_ordinary(s))
    rng = np.random.default_rng(2)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    drawn = ["".join(rng.choice(letters, rng.integers(20, 41))) for _ in range(400)]
    common = ["value", "request", "handler", "default", "config", "user", "session", "number", "window", "buffer", "response", "message", "content", "update"]
    names = ["_".join(rng.choice(common, rng.integers(3, 6))) for _ in range(400)]
    assert np.mean([bool(secret_scan.random_spans(t, count, [])) for t in drawn]) > 0.97
    assert np.mean([bool(secret_scan.random_spans(t, count, [])) for t in names if len(t) >= secret_scan.MIN_RUN]) < 0.02


def test_secret_spans():
    text = 'x token = "abcdefgh12" AKIA' + "Q" * 12 + " é " + "0f" * 16 + " password=short PASSWD: longenough key"
    spans = secret_scan.base_spans(text)
    assert [(k, text[s:e]) for s, k, e in spans] == [(0, 'token = "abcdefgh12'), (1, "AKIA" + "Q" * 12), (2, "0f" * 16), (0, "PASSWD: longenough")]
    assert secret_scan.base_spans("AKIA123 deadbeef paſſword=aaaaaaaaaa") == []


def test_what_base_spans_leave_of_a_run_is_tested():
    rng = random.Random(3)
    for _ in range(3000):
        cuts = sorted(rng.sample(range(200), 2 * rng.randint(0, 4)))
        runs = list(zip(cuts[::2], cuts[1::2], strict=True))
        base = sorted((a, rng.randrange(3), a + rng.randint(1, 60)) for a in (rng.randrange(200) for _ in range(rng.randint(0, 5))))
        want = []
        for start, end in runs:
            free = [i for i in range(start, end) if not any(a <= i < b for a, _, b in base)]
            for i in free:
                if want and want[-1][1] == i and want[-1][0] >= start:
                    want[-1][1] = i + 1
                else:
                    want.append([i, i + 1])
        assert list(secret_scan.outside(runs, base)) == [(a, b) for a, b in want if b - a >= secret_scan.MIN_RUN]
    text = "q7Zk2XvB9mTr4LwPs8Jd_secret=abcdefgh1234,"
    base = secret_scan.base_spans(text)
    assert [(s, e) for s, _, e in base] == [(21, 40)]
    assert secret_scan.random_spans(text, len, base) == [(0, 3, 21)]


def test_secret_scan_finds_random_runs_and_leaves_digests(spark, odd, empty):
    rows = [(1, "see 9fK2xQ7LmZp4Vt8RbW3n and " + "ab12" * 8), (2, "a perfectly-plain identifier_with_parts and 123e4567-e89b-12d3-a456-426614174000")]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()}
    assert got[1]["spans"] == "random:4:24,hex:29:61" and got[1]["n_hex"] == 1 and got[2]["spans"] == ""
    assert secret_scan.scan_secrets(odd, path, public_tokenizers.PATTERN).count() == len(ODD) and secret_scan.scan_secrets(empty, path, public_tokenizers.PATTERN).count() == 0


def test_secret_scan_tests_compounds_by_part_and_runs_without_digits(spark):
    mail, letters = "key-3ax6xnjp29jd6fds4gc373sgvjxteol0", "kQzXvBnMwPrTyLhGfDsJ"
    rows = [
        (1, f"{mail} x"), (2, f"see https://host.example/v3/{mail}"), (3, f"a {letters} b"), (4, "KEEP_QZXVBNMWPRTYLHGFDSJ"), (5, f"a_long_name_of_many_other_common_words_before_the_{letters}"),
        (6, "test_v2_of_the_thing MAX_BUFFER_SIZE_LIMIT my_api_v2_endpoint_name release-2024-01-02-notes"), (7, "2024-01-02-2024-01-03 ==================== " + "A1B2C3D4" * 5 + " internationalization"),
    ]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()}
    assert got == {1: "random:0:36", 2: "random:17:64", 3: "random:2:22", 4: "random:0:24", 5: "random:0:70", 6: "", 7: ""}


def test_languages_on_held_out_documents(spark):
    found = registry.op4_ftrl_language(spark, DATA.replace("0.001", "0.01"))
    held = found.where("held_out").join(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_language_of_odd_rows(odd, empty):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, F.lit(True)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and langid.identify(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}


def test_chain_finds_toxic_documents_that_it_has_not_seen(spark):
    """Fitted on two thirds of the labelled rows, judged by the table's labels of the others."""
    d = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = toxicity.classify(docs, labels.where(~apart)).join(labels.where(apart).select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    hits = sum(r["toxic"] and r["truth"] == 1 for r in got)
    told, true = sum(r["toxic"] for r in got), sum(r["truth"] == 1 for r in got)
    assert true >= 5 and hits / max(1, told) >= 0.95 and hits / true >= 0.65, (hits, told, true)  # some labels of the table are noise, see README


def test_chain_on_very_long_texts_and_equal_rows(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    rows = [(i, ("you worthless idiot " if i % 2 else "a kind and calm note ") + f"number {i}") for i in range(80)] + [(100, "calm " * 200_000), (101, "worthless idiot " * 100_000), (102, "a calm and kind note"), (102, "a calm and kind note"), (None, "you worthless idiot")]
    got = {}
    for r in toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect():
        got.setdefault(r["doc_id"], []).append(r["toxic"])
    assert got[100] == [False] and got[101] == [True] and got[102] == [False, False] and got[None] == [True]


def test_chain_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r["toxic"] for r in toxicity.classify(odd, none).collect())
    assert toxicity.classify(empty, none).count() == 0 and toxicity.without_toxic(odd, none).columns == odd.columns


def test_nearest_in_exact_search_and_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 16))
    base[100:160] = base[100]  # one vector many times
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (None, [1.0] * 16), (720, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    exact = {}
    v = np.array([r[1] for r in rows[:600]])
    for q in range(0, 600, 20):
        scores = [(-(v[q] * v[i]).sum(), i) for i in range(600) if i != q]
        exact[q] = [i for _, i in sorted(scores)[:5]]
    for factor, least in ((1.0, 1.0), (vptree.FACTOR, 0.9)):
        got = {}
        for r in vptree.nearest(df, 20, 5, factor, shard=150, block=7).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert set(got) == set(exact)
        assert np.mean([len(set(got[q]) & set(exact[q])) / 5 for q in exact]) >= least
        assert factor < 1 or got == exact
    assert vptree.nearest(df.limit(0), 20, 5).count() == 0


def test_nearest_with_leaves_well_below_the_shard(spark):
    """Clusters of uneven norms, where search leaves out sides of its trees."""
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))) * rng.uniform(0.5, 1.5, (4000, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    scores = v[::20] @ v.T
    scores[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    exact = {20 * q: np.argsort(-row)[:20].tolist() for q, row in enumerate(scores)}
    for factor, shard, leaf in ((1.0, 2000, 32), (vptree.FACTOR, 2000, 32), (vptree.FACTOR, vptree.SHARD, vptree.LEAF)):
        got = {}
        for r in vptree.nearest(df, 20, 20, factor, shard=shard, leaf=leaf).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert factor < 1 or got == exact
        assert np.mean([len(set(got[q]) & set(exact[q])) / 20 for q in exact]) >= 0.95



@pytest.mark.parametrize("source", ["odd", "empty"])
def test_stages_take_odd_and_empty_tables(source, request, spark):
    docs = request.getfixturevalue(source).withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
    assert source == "empty" or None in {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_rows_that_repeat_an_id_with_other_texts_are_each_judged(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, "another text of its own with several words in it"), (2, " ".join(words)), (3, "another text of its own with several words in it"), (4, "something else that is like nothing of the rest here")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_pipeline_is_its_stages_in_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    after = {}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == docs.columns
        after[name] = dict(texts(kept))
    toxic = {r["doc_id"] for r in toxicity.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("toxic").collect()}
    rows = [(d, t) for d, t in texts(docs) if d not in toxic]
    assert after["toxicity"] == dict(rows)
    digests = {d: h for d, _, _, h in plain_lines(rows)}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in after["line dedup"].items()} == digests
    rows = list(after["line dedup"].items())
    rows = [(d, t) for (d, t), (*_, stays) in zip(rows, plain_components(rows, 5, 80), strict=True) if stays]
    assert after["near duplicates"] == dict(rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {d for d, _ in plain_leaks(rows, items)}
    assert after["decontamination"] == {d: t for d, t in rows if d not in leaks}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == set(after["decontamination"])
