"""Licence scan by diagonal voting, DataFrame functions only.

Every word gram of a document is joined to the places of equal grams in the templates. A gram at word p of the
document and word t of a template votes for the diagonal p - t; a copy of the template lies on one diagonal, and words put in
or left out shift it by a few. Votes are compared word by word before they count. A diagonal is merged with those that lie at most GAP
beyond it, so a span is at most GAP words longer than its template, and the span is then verified: its places must follow each other in the
template as they do in the text, and the longest such chain, as a share of the template's grams, decides.

The base phrases are templates as well: all their grams on one diagonal are one place.

Templates are constants of this module, so the broadcast table has a fixed size.

Defined results: a null text is empty and has no words; without base places first_word and last_word are null and base_labels is
empty; score is the greatest share of any template found (0 without votes, 1 with a base phrase); rows are told apart by
doc_id and text, so repeated rows get the same result each; an empty table gives an empty one; texts of any length are read whole.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key, words

#: Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Texts of public licences, their opening sentences, and the usual lines that refer to them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions "
        "and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ),
    (
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute "
        "and transmit the software and to prepare derivative works of the software",
    ),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
]
GRAM, GAP, SHARE = 3, 4, 0.7

#: (number, label, base or not, words in a gram, words) of all templates.
ALL = [(n, label, base, min(GRAM, len(text.split())), text) for n, (label, base, text) in enumerate([(label, True, text) for text, label in BASE.items()] + [(label, False, text) for label, text in TEMPLATES])]


def template_grams(spark) -> DataFrame:
    """tid, label, base, n_grams, tpos, g0, g1, g2 (null in a gram of two words) and the gram's hash."""
    rows = ", ".join(f"({n}, '{label}', {str(base).lower()}, {k}, split('{text}', ' '))" for n, label, base, k, text in ALL)
    t = spark.sql(f"SELECT * FROM VALUES {rows} AS t(tid, label, base, k, tw)")
    t = t.withColumn("n_grams", F.size("tw") - F.col("k") + 1).select("*", F.explode(F.sequence(F.lit(0), F.col("n_grams") - 1)).alias("tpos"))
    parts = [F.get("tw", F.col("tpos") + j).alias(f"g{j}") for j in range(2)] + [F.when(F.col("k") == 3, F.get("tw", F.col("tpos") + 2)).alias("g2")]
    return t.select("tid", "label", "base", "n_grams", "tpos", *parts).withColumn("gram", F.xxhash64("g0", "g1", F.coalesce("g2", F.lit(""))))


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, tid, label, base, n_grams, diagonal, places: the template places that vote for a diagonal.

    Every row of docs adds one line without template; rows is the number of such lines.
    """
    rows = docs.select("doc_id", text_key("text").alias("text_key"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    placed = rows.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("w") - 2))).alias("p"))
    word = lambda j: F.get("w", F.col("p") + j)
    pair = F.when(F.col("p") >= 0, F.xxhash64(word(0), word(1), F.lit("")))
    triple = F.when(F.col("p") >= 0, F.xxhash64(word(0), word(1), F.coalesce(word(2), F.lit(""))))
    hashed = placed.select("*", F.explode(F.array(pair, triple)).alias("own"))
    same = F.col("tid").isNotNull() & (word(0) == F.col("g0")) & (word(1) == F.col("g1")) & (F.col("g2").isNull() | (word(2) == F.col("g2")))
    found = hashed.join(F.broadcast(template_grams(docs.sparkSession)), F.col("own") == F.col("gram"), "left").filter((F.col("p") < 0) | same)
    keys = ["doc_id", "text_key", "n_words", "tid", "label", "base", "n_grams", (F.col("p") - F.col("tpos")).alias("diagonal")]
    return found.groupBy(*keys).agg(F.collect_set("tpos").alias("places"), F.count_if(F.col("p") < 0).alias("rows"))


def chain(near: Column, n_grams: Column) -> Column:
    """Length of the longest chain of votes that ascends in the text and in the template. near: structs of a diagonal and its places.

    Votes are taken in the order of their words in the text (of one word, the last place first); for each place the array holds the
    longest chain that ends there.
    """
    votes = F.array_sort(F.flatten(F.transform(near, lambda d: F.transform(d["places"], lambda t: F.struct((d["diagonal"] + t).alias("p"), (-t).alias("minus"))))))

    def step(best: Column, vote: Column) -> Column:
        t = -vote["minus"]
        longest = F.coalesce(F.array_max(F.slice(best, F.lit(1), t)), F.lit(0)) + 1
        return F.transform(best, lambda old, i: F.when(i == t, F.greatest(old, longest)).otherwise(old))

    chains = F.aggregate(votes, F.array_repeat(F.lit(0), n_grams), step)
    return F.when(F.size(near) == 1, F.size(F.get(near, F.lit(0))["places"])).otherwise(F.array_max(chains))  # one diagonal ascends as it is


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    beyond = Window.partitionBy("doc_id", "text_key", "tid").orderBy("diagonal").rangeBetween(0, GAP)
    one = F.struct("diagonal", "places")
    near = F.when(F.col("base"), F.array(one)).when(F.col("tid").isNotNull(), F.collect_list(one).over(beyond))
    spans = votes(docs).withColumn("near", near).withColumn("held", F.when(F.col("tid").isNotNull(), chain(F.col("near"), F.col("n_grams"))))
    spans = spans.withColumn("share", F.col("held") / F.col("n_grams"))
    place = F.coalesce(F.col("base") & (F.col("held") == F.col("n_grams")), F.lit(False))
    labelled = place | F.coalesce(~F.col("base") & (F.col("share") >= SHARE), F.lit(False))
    per_doc = spans.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(labelled, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(labelled | ~F.col("base"), F.col("share"))), F.lit(0.0)).alias("score"),
        (F.sum("rows") / 2).cast("int").alias("rows"),  # a line for the pair and one for the triple
    )
    return per_doc.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("nth")).drop("nth")


SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_TEMPLATES = ", ".join(f"({n}, '{label}', {str(base).lower()}, {k}, '{text}')" for n, label, base, k, text in ALL)
SQL = f"""
WITH RECURSIVE t AS (SELECT tid, label, base, k, string_split(tt, ' ') AS tw, len(string_split(tt, ' ')) - k + 1 AS n_grams FROM (VALUES {SQL_TEMPLATES}) AS v(tid, label, base, k, tt)),
tp AS (SELECT *, unnest(range(n_grams)) AS tpos FROM t),
tg AS (SELECT tid, label, base, k, n_grams, tpos, array_to_string(tw[tpos + 1:tpos + k], ' ') AS gram FROM tp),
d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
dp AS (SELECT doc_id, w, unnest(range(greatest(0, len(w) - 1))) AS p FROM d),
dg AS (SELECT doc_id, p, 2 AS k, array_to_string(w[p + 1:p + 2], ' ') AS gram FROM dp UNION ALL SELECT doc_id, p, 3, array_to_string(w[p + 1:p + 3], ' ') FROM dp WHERE p + 3 <= len(w)),
v AS (SELECT DISTINCT doc_id, tid, label, base, n_grams, p - tpos AS diagonal, tpos FROM dg JOIN tg USING (k, gram)),
g AS (SELECT doc_id, tid, any_value(label) AS label, any_value(base) AS base, any_value(n_grams) AS n_grams, diagonal, list(tpos) AS places FROM v GROUP BY doc_id, tid, diagonal),
m AS (SELECT a.doc_id, a.tid, a.diagonal, any_value(a.n_grams) AS n_grams, list({{'p': p, 't': t}} ORDER BY p, t DESC) AS votes
 FROM g a JOIN (SELECT doc_id, tid, base, diagonal, unnest(places) AS t, diagonal + unnest(places) AS p FROM g) b USING (doc_id, tid) WHERE NOT a.base AND b.diagonal BETWEEN a.diagonal AND a.diagonal + {GAP} GROUP BY 1, 2, 3),
z AS (SELECT doc_id, tid, diagonal, votes, 0 AS i, list_transform(range(n_grams), lambda x: 0) AS best FROM m
 UNION ALL SELECT doc_id, tid, diagonal, votes, i + 1, list_transform(best, lambda old, k: CASE WHEN k - 1 = votes[i + 1].t THEN greatest(old, 1 + coalesce(list_max(best[1:votes[i + 1].t]), 0)) ELSE old END) FROM z WHERE i < len(votes)),
h AS (SELECT doc_id, tid, diagonal, list_max(best) AS chain FROM z WHERE i = len(votes)),
s AS (SELECT doc_id, tid, label, base, n_grams, diagonal AS start, CASE WHEN base THEN len(places) ELSE chain END AS held FROM g LEFT JOIN h USING (doc_id, tid, diagonal)),
f AS (SELECT *, base AND held = n_grams AS place, (base AND held = n_grams) OR (NOT base AND held / n_grams >= {SHARE}) AS labelled FROM s),
r AS (SELECT doc_id, count(*) FILTER (place) AS n_base, min(start) FILTER (place) AS first_word, max(start) FILTER (place) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (labelled) AS labels, max(held / n_grams) FILTER (labelled OR NOT base) AS score FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (doc_id)
"""
