"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents are joined with the positions
of the same k-grams in license templates.  Matches on one diagonal (document
position minus template position) are counted; neighbouring diagonals, which
small insertions and deletions part, are merged; a span with enough votes is
verified on the words by its longest common subsequence with the template, in
windows of twice the template's length all along the span.

Beside that, fixed phrases are looked for, and give labels of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.llm.common import alnum_words, bound_batches, broadcast_small, chunks, lean, materialize
from lumenspan.llm.decontamination import gram_hashes, word_hashes

K = 3
#: Merge diagonals that lie so near; votes and similarity that make a span.
NEAR, LEAST_VOTES, LEAST_SHARE, LEAST_SIMILARITY = 8, 2, 0.4, 0.6

#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices and license texts by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd-2-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "mit-text": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
}


def template_words(templates: dict[str, list[str]]) -> list[tuple[str, list[bytes]]]:
    return [(label, alnum_words(text.encode())) for label in sorted(templates) for text in templates[label]]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("dkey"), text.alias("text"))


def _phrases(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    def run(batches):
        marks = [(b" " + b" ".join(alnum_words(p.encode())) + b" ", label) for p, label in phrases.items()]
        for batch, texts in chunks(batches):
            cols = [[], [], [], [], []]
            for text in texts:
                words = alnum_words(text)
                flat = b" " + b" ".join(words) + b" "
                starts, labels = [], set()
                for mark, label in marks:
                    at = flat.find(mark)
                    while at >= 0:
                        starts.append(flat.count(b" ", 0, at))
                        labels.add(label)
                        at = flat.find(mark, at + 1)
                for c, v in zip(cols, (len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.list_(pa.string()))], names=["doc_id", "dkey", "n_words", "n_base", "first_word", "last_word", "base"])

    return docs.mapInArrow(lean(run), "doc_id bigint, dkey bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>")


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, dkey, pos, gram) for every k consecutive words."""

    def run(batches):
        for batch, texts in chunks(batches):
            words = [alnum_words(x) for x in texts]
            length = np.array([len(w) for w in words], np.int64)
            g = gram_hashes(word_hashes([x for w in words for x in w]), k)
            if not len(g):
                continue
            owner = np.repeat(np.arange(len(length)), length)
            at = np.flatnonzero(owner[: len(g)] == owner[k - 1 :][: len(g)])
            first = np.cumsum(length) - length
            rows = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - first[owner[at]]).astype(np.int32)), pa.array(g[at].astype(np.int64))], names=["doc_id", "dkey", "pos", "gram"])

    return docs.mapInArrow(lean(run), "doc_id bigint, dkey bigint, pos int, gram bigint")


def votes(docs: DataFrame, templates: dict[str, list[str]], k: int = K) -> DataFrame:
    """Candidate spans: (doc_id, dkey, template, lo, hi, n), hi exclusive.  A
    place votes once for a diagonal, however often its row repeats."""
    spark = docs.sparkSession
    rows = [(int(g), no, i) for no, (_, words) in enumerate(template_words(templates)) for i, g in enumerate(gram_hashes(word_hashes(words), k).astype(np.int64).tolist())]
    places = spark.createDataFrame(rows, "gram bigint, template int, tpos int")
    hits = _grams(docs, k).join(F.broadcast(places), "gram")  # as many rows as the templates in the code have k-grams
    by = hits.groupBy("doc_id", "dkey", "template", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.count_distinct("pos").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = W.partitionBy("doc_id", "dkey", "template").orderBy("diag")
    fresh = F.coalesce((F.col("diag") - F.lag("diag").over(order) > NEAR).cast("int"), F.lit(1))
    merged = by.withColumn("new", fresh).withColumn("run", F.sum("new").over(order))
    return merged.groupBy("doc_id", "dkey", "template", "run").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), (F.max("hi") + k).alias("hi")).drop("run")


def similarity(span: list[bytes], template: list[bytes]) -> float:
    """Longest common subsequence over the template's length."""
    at: dict[bytes, int] = {}
    for i, t in enumerate(template):
        at[t] = at.get(t, 0) | 1 << i
    full = (1 << len(template)) - 1
    rest = full  # a zero for each step of the subsequence's length
    for w in span:
        if both := rest & at.get(w, 0):
            rest = (rest + both | rest - both) & full
    return (len(template) - rest.bit_count()) / max(1, len(template))


def best_window(words: list[bytes], lo: int, hi: int, template: list[bytes]) -> float:
    """Best similarity of a window inside a span; windows begin every ``NEAR``
    words, so any place of up to twice the template's length lies in one."""
    size, last = 2 * len(template) + 2 * NEAR, min(hi + NEAR, len(words))
    starts = range(max(0, lo - NEAR), max(last - size, 0, lo - NEAR) + NEAR, NEAR)
    return max(similarity(words[x : min(x + size, last)], template) for x in starts)


def scan(docs: DataFrame, *, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = K) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base (places of phrases),
    first_word and last_word (their smallest and largest start), base_labels,
    labels (also the templates' found) and score: the best similarity of a
    verified span, 1 with a phrase, else 0.

    NULL and empty texts have no words and no labels.  Texts are read whole.
    Rows that repeat id and text each get the same result; a NULL doc_id stays
    NULL; an empty table gives no row; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    src = _keyed(docs)
    known = template_words(templates)
    size = F.create_map(*[F.lit(x) for no, (_, words) in enumerate(known) for x in (no, max(1, len(words) - k + 1))])
    cand = votes(src, templates, k).where((F.col("n") >= LEAST_VOTES) & (F.col("n") >= LEAST_SHARE * size[F.col("template")]))
    lists = materialize(cand.groupBy("doc_id", "dkey").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("spans")), "spans")
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("dkey").alias("_key"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("dkey") == F.col("_key"))
    texts = src.join(broadcast_small(lists, 60 + 32 * F.size("spans")), same).select("doc_id", "dkey", "text", "spans")

    def verify(batches):
        for batch, rows in chunks(batches):
            labels, scores = [], []
            for text, spans in zip(rows, batch.column(3).to_pylist(), strict=True):
                words, got = alnum_words(text), {}
                for s in spans:
                    label, body = known[s["template"]]
                    x = best_window(words, s["lo"], s["hi"], body)
                    if x >= LEAST_SIMILARITY:
                        got[label] = max(x, got.get(label, 0.0))
                labels.append(sorted(got))
                scores.append(max(got.values(), default=0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())], names=["_id", "_key", "own", "similarity"])

    own = texts.mapInArrow(lean(verify), "_id bigint, _key bigint, own array<string>, similarity double").groupBy("_id", "_key").agg(F.first("own").alias("own"), F.max("similarity").alias("similarity"))
    own = materialize(own, "labels")
    out = _phrases(src, phrases).join(broadcast_small(own, 60 + 40 * F.size("own")), same, "left")
    found = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(found, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("score"),
    )
