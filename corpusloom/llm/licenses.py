"""Operator 2: license scans by diagonal voting, in DataFrame operations only.

Every run of ``GRAM`` words of a text is hashed and joined to the positions of
the same runs in the license templates.  A match at word ``p`` of the text and
word ``q`` of a template lies on diagonal ``p - q``; votes are counted per
diagonal, neighbouring diagonals (a few words inserted or left out) are merged,
and a merged span is accepted if it covers enough of the template.  Hash
matches are verified word by word before they vote.  Texts are read once; only
the runs that some template has leave that pass.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, let, written

GRAM = 3
#: Diagonals so close together may belong to one place.
NEIGHBOUR = 3
#: Least share of a template's runs that a place must hold.
COVER = 0.6

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values of the contract: phrase, label.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Whole texts of short licenses and the notices that longer ones ask for, lowered and without punctuation (fixed values): text, label.
WHOLE = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
        " to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is"
        " provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no"
        " event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection"
        " with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the"
        " above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express"
        " or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or"
        " contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use"
        " data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way"
        " out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice"
        " appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action"
        " of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org"
        " licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of"
        " any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of"
        " the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of"
        " merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this"
        " program",
        "gpl-3",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as"
        " a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is"
        " granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "zlib",
    ),
]

#: Further templates: phrase, label.
TEMPLATES = [
    *WHOLE,
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("under the terms of the gnu general public license version 2", "gpl-2"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("under the creative commons attribution 4 0 international license", "cc-by"),
    ("under the creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
]


def templates(spark: SparkSession, base: list | None = None, more: list | None = None) -> DataFrame:
    """One row for each run of each template: template, label, is_base, n_runs, at, h, gram.  Its size is that of the given lists."""
    given = [(i, phrase, label, i < len(base or BASE)) for i, (phrase, label) in enumerate([*(base or BASE), *(TEMPLATES if more is None else more)])]
    words = spark.createDataFrame(given, "template int, phrase string, label string, is_base boolean").withColumn("w", F.split("phrase", " "))
    runs = words.withColumn("n_runs", F.size("w") - (GRAM - 1)).select("template", "label", "is_base", "n_runs", F.posexplode(_runs(F.col("w"))).alias("at", "gram"))
    return runs.withColumn("h", F.xxhash64("gram"))


def _runs(words):
    return F.when(F.size(words) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(GRAM)])))


def scan(docs: DataFrame, base: list | None = None, more: list | None = None) -> DataFrame:
    """License places of every text.

    Returns for each row doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_places.  A null or empty text has no words, no
    places, empty labels and score 0.  Whole texts are scanned, however long;
    equal texts are judged once and returned for each of their rows, ids may
    repeat or be null.  Of places that overlap, those that cover the largest
    share of their templates stay, several at a tie; base phrases stay always.
    An empty table gives an empty result; further columns of ``docs``, whatever
    their names, are ignored.
    """
    spark = docs.sparkSession
    table = templates(spark, base, more)
    wanted = sorted(r[0] for r in table.select("h").distinct().collect())  # of the templates, not of the texts
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORDS), F.lit(0))

    def hits_of(w):
        """Runs of the text that some template has, with their words for verification."""

        def run(i):
            return F.concat_ws(" ", *[F.get(w, i + j) for j in range(GRAM)])

        at = F.sequence(F.lit(0), F.size(w) - GRAM)
        hashed = F.filter(F.transform(at, lambda i: F.struct(i.alias("p"), F.xxhash64(run(i)).alias("h"))), lambda x: x["h"].isin(wanted))
        return F.when(F.size(w) >= GRAM, F.transform(hashed, lambda x: F.struct(x["p"].alias("p"), x["h"].alias("h"), run(x["p"]).alias("gram"))))

    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest")
    read = docs.select("doc_id", digest, let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hits_of(w).alias("hits"))).alias("x"))
    read = written(read.select("doc_id", "digest", "x.*"), "license-hits")
    # texts are told apart by their digest, so that copies are judged once
    found = read.where(F.size("hits") > 0).dropDuplicates(["digest"]).select("digest", F.explode("hits").alias("x"))
    # the templates are a constant list, so broadcasting them is bounded
    votes = found.select("digest", "x.*").join(F.broadcast(table), ["h", "gram"])
    diagonals = votes.groupBy("digest", "template", "label", "is_base", "n_runs", (F.col("p") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("p").alias("begin"), F.max("p").alias("end"), F.collect_list("at").alias("held"))

    along = Window.partitionBy("digest", "template").orderBy("diagonal")
    fresh = F.coalesce(((F.col("diagonal") - F.lag("diagonal").over(along)) > NEIGHBOUR) | (F.col("votes") == F.col("n_runs")) | (F.lag("votes").over(along) == F.col("n_runs")), F.lit(True))
    merged = diagonals.withColumn("place", F.sum(fresh.cast("int")).over(along)).groupBy("digest", "template", "label", "is_base", "n_runs", "place").agg(F.min("diagonal").alias("diagonal"), F.max("votes").alias("votes"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    merged = merged.withColumn("cover", F.size("held") / F.col("n_runs"))
    exact = F.col("is_base") & (F.col("votes") == F.col("n_runs"))
    accepted = F.when(F.col("is_base"), exact).otherwise(F.col("cover") >= COVER)
    # of places that overlap, those that cover most of their template stay; base phrases always do
    in_text = Window.partitionBy("digest").orderBy("begin", "end", "template")
    reach = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    places = merged.where(accepted).withColumn("apart", F.coalesce((F.col("begin") > reach + GRAM - 1).cast("int"), F.lit(1)))
    places = places.withColumn("group", F.sum("apart").over(in_text)).withColumn("best", F.max("cover").over(Window.partitionBy("digest", "group")))
    per_text = places.where(exact | (F.col("cover") == F.col("best"))).groupBy("digest").agg(
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(exact, F.col("diagonal"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(exact, F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.max("cover").alias("score"),
        F.count("*").alias("n_places"),
    )
    # texts without a hit, copies of each other among them, need no join
    has = F.coalesce(F.size("hits"), F.lit(0)) > 0
    plain = read.where(~has).select("doc_id", "digest", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in per_text.dtypes if c != "digest"])
    out = read.where(has).drop("hits").join(per_text, "digest", "left").unionByName(plain)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce(F.concat_ws(",", "base_labels"), F.lit("")).alias("base_labels"),
        F.coalesce(F.concat_ws(",", "labels"), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_places", F.lit(0)).cast("long").alias("n_places"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
