"""License scan: base phrases by words, and a positional index of the rarest licence words, in DataFrame operations only.

The index holds each template's words with their places. For every template whose key phrase stands in a file, those of its
words that the file holds with the highest IDF over all documents are looked up, the postings are brought together by relative
position (place in the file less place in the template), and the template counts when enough of them agree on one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import ascii_lower, settle, small_enough

#: Phrases and labels of the contract: fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Parts of notices that several licences share: fixed values.
_AS_IS = "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
_SOURCE_AND_BINARY = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
    and or other materials provided with the distribution"""
_NO_ENDORSEMENT = """3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
    without specific prior written permission"""
_DISCLAIMER = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
    the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be
    liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
    services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
    including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""


def _gnu(kind: str, version: int) -> str:
    """The notice that files under a licence of this family bear."""
    return f"""this program is free software you can redistribute it and or modify it under the terms of the gnu {kind} as published by the free software foundation
        either version {version} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any
        warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind} for more details
        you should have received a copy of the gnu {kind} along with this program if not see http www gnu org licenses"""


#: Notices by label: words in their order, and the phrase that must be there. Short forms come first, then whole notices; where
#: these are variants of each other, the phrase is one that only one of them has.
TEMPLATES = [
    (label, " ".join(notice.split()), key)
    for label, notice, key in [
        ("mit", "released under the mit license", "mit license"),
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person obtaining"),
        ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
        ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
        ("gpl", "this work is licensed under the gnu general public license version", "gnu general public license"),
        ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
        ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
        ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
        ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
        ("mpl-2", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
        ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
        ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
        ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", "creative commons attribution sharealike"),
        ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related"),
        ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
        ("mit", f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
            in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of
            the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this
            permission notice shall be included in all copies or substantial portions of the software the software is provided as is {_AS_IS} noninfringement in no
            event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising
            from out of or in connection with the software or the use or other dealings in the software""", "copy modify merge publish distribute sublicense and or sell"),
        ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
            notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software
            including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential
            damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising
            out of or in connection with the use or performance of this software""", "for any purpose with or without fee is hereby granted"),
        ("bsd-2-clause", f"{_SOURCE_AND_BINARY} {_DISCLAIMER}", "materials provided with the distribution this software is provided by"),
        ("bsd-3-clause", f"{_SOURCE_AND_BINARY} {_NO_ENDORSEMENT} {_DISCLAIMER}", "to endorse or promote products derived from this software without specific prior written permission"),
        ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
            this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it
            freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original
            software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source
            versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any
            source distribution""", "altered source versions must be plainly marked as such"),
        ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the
            license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
            distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing
            permissions and limitations under the license""", "specific language governing permissions and limitations under the license"),
        ("gpl-2", _gnu("general public license", 2), "gnu general public license as published by the free software foundation either version 2"),
        ("gpl-3", _gnu("general public license", 3), "gnu general public license as published by the free software foundation either version 3"),
        ("lgpl-3", _gnu("lesser general public license", 3), "gnu lesser general public license as published by the free software foundation either version 3"),
        ("agpl-3", _gnu("affero general public license", 3), "gnu affero general public license as published by the free software foundation either version 3"),
        ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
            http mozilla org mpl 2 0""", "if a copy of the mpl was not distributed with this file"),
        ("unlicense", f"""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
            either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright
            laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the
            benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity
            of all present and future rights to this software under copyright law the software is provided as is {_AS_IS} noninfringement in no event shall the authors
            be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
            or the use or other dealings in the software""", "an overt act of relinquishment in perpetuity"),
    ]
]
VOCABULARY = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})

#: A template's words that are looked up in a file, the rarest first, and the part of them that must agree.
RAREST, AGREE = 8, 0.6


def spaced(text: Column) -> Column:
    """The text's words in lower case with one space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def words_of(norm: Column) -> Column:
    return F.array_remove(F.split(F.trim(norm), " "), "")


def _places(norm: Column, words: Column, phrase: str) -> Column:
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k in range(1, len(parts)):
            test = test & (F.get(words, i + k) == parts[k])
        return test

    return F.when(F.contains(norm, F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _listed(words: list[str]) -> Column:
    """The words as one constant array."""
    return F.split(F.lit(" ".join(words)), " ")


def bind(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value worked out once, however often of uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _index(spark: SparkSession) -> DataFrame:
    rows = [(number, place, word) for number, (_, notice, _) in enumerate(TEMPLATES) for place, word in enumerate(notice.split())]
    return spark.createDataFrame(rows, "template int, place int, word string")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text).

    Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased. Base columns count the places of
    PHRASES; first_word and last_word are null where there are none. labels adds those of the index; score is 1 where a base
    phrase stands, else the largest IDF share of a template's words that agree on one relative position (0 without any).
    Null and empty texts have no words. Rows are judged one by one and repeated rows repeat; a null doc_id stays null; other
    columns are ignored. The IDF of a word that no document has is that of a word which one has.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    norm = F.col("norm")
    vocabulary = _listed(VOCABULARY)
    words = words_of(norm)
    first = plain.select("doc_id", F.xxhash64("text").alias("file"), spaced(F.col("text")).alias("norm"))

    def cells(n: Column, w: Column) -> Column:
        base = F.array_compact(F.array(*(F.when(F.contains(n, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items())))
        places = F.flatten(F.array(*(_places(n, w, phrase) for phrase in PHRASES)))
        keys = F.array_compact(F.array(*(F.when(F.contains(n, F.lit(f" {key} ")), F.lit(number)) for number, (_, _, key) in enumerate(TEMPLATES))))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.array_intersect(w, vocabulary).alias("known"), keys.alias("keys"), places.alias("places"), base.alias("base"))

    once = bind(norm, lambda n: bind(words_of(n), lambda w: cells(n, w)))
    found = first.select("doc_id", "file", once.alias("it")).select("doc_id", "file", "it.*")
    rows = settle(found, "licence-rows")

    total = rows.count()
    counts = rows.select(F.explode("known").alias("word")).groupBy("word").count().collect()  # at most a row for each word of VOCABULARY
    idf = {w: 0.0 for w in VOCABULARY} | {r["word"]: float(r["count"]) for r in counts}
    weight = spark.createDataFrame(list(idf.items()), "word string, held double").select("word", F.log((F.lit(total) + 1.0) / (F.greatest("held", F.lit(1.0)))).alias("idf"))
    index = _index(spark).join(F.broadcast(weight), "word")
    share = index.groupBy("template").agg(F.sum("idf").alias("all_idf"), F.collect_list("word").alias("notice"))

    hopeful = rows.where(F.size("keys") > 0).select("doc_id", "file", "known", "keys").dropDuplicates(["doc_id", "file"])
    rarest = [sorted(set(notice.split()), key=lambda w: (-_idf(idf[w], total), w)) for _, notice, _ in TEMPLATES]
    chosen = [F.slice(F.filter(_listed(ws), lambda w: F.array_contains("known", w)), 1, RAREST) for ws in rarest]
    rare = F.array(*(F.when(F.array_contains("keys", F.lit(number)), held) for number, held in enumerate(chosen)))  # null without the key phrase
    asked = settle(hopeful.select(F.col("doc_id").alias("asked_id"), F.col("file").alias("asked_file"), rare.alias("rare")), "licence-rare")
    some = small_enough(asked)
    same = first["doc_id"].eqNullSafe(some["asked_id"]) & (first["file"] == some["asked_file"])
    opened = first.join(some, same).dropDuplicates(["doc_id", "file"]).select("doc_id", "file", "rare", words.alias("words"), F.array_distinct(F.flatten(F.array_compact("rare"))).alias("any_rare"))
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains("any_rare", x["word"]))
    looked = opened.select("doc_id", "file", "rare", F.explode(spots).alias("spot")).select("doc_id", "file", "rare", "spot.*")
    mine = looked.join(F.broadcast(index), "word").withColumn("rare", F.get("rare", F.col("template")))
    hits = mine.where(F.array_contains("rare", F.col("word"))).withColumn("shift", F.col("at") - F.col("place"))
    agreed = hits.groupBy("doc_id", "file", "template", "shift", "rare").agg(F.count(F.lit(1)).alias("n"), F.sum("idf").alias("idf"))
    asked_words = F.size(F.filter("notice", lambda w: F.array_contains("rare", w)))
    labels = F.array(*(F.lit(label) for label, _, _ in TEMPLATES))
    judged = agreed.where(F.col("n") >= 2).join(F.broadcast(share), "template").where(F.col("n") >= AGREE * asked_words)
    added = judged.groupBy(F.col("doc_id").alias("judged_id"), F.col("file").alias("judged_file")).agg(F.collect_set(F.get(labels, F.col("template"))).alias("added"), F.max(F.col("idf") / F.col("all_idf")).alias("part"))

    together = rows.join(added, rows["doc_id"].eqNullSafe(added["judged_id"]) & (rows["file"] == added["judged_file"]), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("added", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("part", F.lit(0.0))))
    return together.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def _idf(held: float, total: int) -> float:
    import math

    return math.log((total + 1.0) / max(held, 1.0))
