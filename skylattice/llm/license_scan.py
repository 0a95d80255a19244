"""License scans by diagonal voting.

Every rolling word 2-gram of a text is hashed and joined by Spark to the places where it stands in license templates. A hit
votes for the diagonal (place in the text less place in the template). Neighbouring diagonals of a template are merged,
so that a few inserted or lost words do no harm, and a merged diagonal is verified: it must hold enough of the
template's places, the words themselves being compared and not only their hashes. DataFrame functions throughout.

The templates are a fixed list of well under a thousand 2-grams, so broadcasting them is safe at any input size; the join
streams over the exploded 2-grams, of which only hits, and one row for each document, are ever written. No step gathers
more than one document's hits in one place.

Null and empty texts have no words and no labels; repeated rows give repeated results; extra columns are ignored. Time and
memory grow in proportion to a text's length: exploded rows hold a 2-gram, not the text that it stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, whole_text

# The phrases that count as mentions, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Opening sentences of public licenses, with their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mit", "released under the mit license"),
]

#: What splits words: every ASCII character that is neither a digit nor a letter (texts are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals of one template so far apart at most are merged.
MAX_SHIFT = 2
#: Share of a template's 2-grams that a merged diagonal must hold.
MIN_COVER = 0.75
#: Score of a text that only mentions a license by name.
MENTION = 0.5


def template_grams() -> list[tuple[int, str, int, int, int, str, str]]:
    """(template, label, 1 for a phrase, 2-grams in it, place, first word, second word)."""
    rows = []
    for t, (text, label, phrase) in enumerate([(p, k, 1) for p, k in PHRASES] + [(x, k, 0) for k, x in TEMPLATES]):
        words = text.split()
        rows += [(t, label, phrase, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def lowered(text: Column) -> Column:
    """Lower-cases so that exactly A-Z can become ASCII letters: the Kelvin sign, whose lower case is k, is set aside."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0439")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), GAP), "")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: its key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    spark = docs.sparkSession
    rows = template_grams()
    grams = spark.createDataFrame(rows, "tmpl int, label string, phrase int, size int, place int, t0 string, t1 string").withColumn("hash", F.xxhash64("t0", "t1"))

    words = F.col("words")
    # The first place is the document's own, without a 2-gram; 2-gram i stands at place i + 1. Rows carry two words, not their text's.
    gram = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1)).alias("hash"), F.get(words, i).alias("w0"), F.get(words, i + 1).alias("w1"))
    own = F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("w0"), F.lit(None).cast("string").alias("w1")))
    rolling = F.when(F.size(words) > 1, F.concat(own, F.transform(F.sequence(F.lit(0), F.size(words) - 2), gram))).otherwise(own)
    found = staged(
        docs.select(F.col(key).alias("key"), words_of(whole_text(text)).alias("words"))
        .select(F.monotonically_increasing_id().alias("row"), "key", F.size(words).cast("long").alias("n_words"), "words")
        .select("row", "key", "n_words", F.posexplode(rolling).alias("at", "gram"))
        .select("row", "key", "n_words", "at", "gram.*")
        .join(F.broadcast(grams), "hash", "left")
        .where((F.col("at") == 0) | ((F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))))
        .select("row", F.when(F.col("at") == 0, F.col("key")).alias("key"), F.when(F.col("at") == 0, F.col("n_words")).alias("n_words"), (F.col("at") - 1).alias("at"), "tmpl", "label", "phrase", "size", "place"),
        "license-hits",
    )
    votes = found.where("at >= 0").withColumn("diagonal", F.col("at") - F.col("place"))
    diagonals = votes.groupBy("row", "tmpl", "label", "phrase", "size", "diagonal").agg(
        F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("place").alias("places")
    )
    mentions = diagonals.where((F.col("phrase") == 1) & (F.col("n") == F.col("size")))

    # Long templates: neighbouring diagonals that also stand close together in the text make one span.
    near = Window.partitionBy("row", "tmpl").orderBy("diagonal", "lo")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > MAX_SHIFT) | (F.col("lo") - F.lag("hi").over(near) > F.col("size")), F.lit(True))
    spans = (
        diagonals.where(F.col("phrase") == 0)
        .withColumn("starts", apart.cast("int"))
        .withColumn("island", F.sum("starts").over(near))
        .groupBy("row", "tmpl", "label", "size", "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"))
        .withColumn("cover", F.col("held") / F.col("size"))
        .where(F.col("cover") >= MIN_COVER)
    )
    start = F.col("lo").cast("long")
    judged = mentions.select("row", "label", F.lit(1).alias("base"), start.alias("first"), (F.col("hi") + 2).cast("long").alias("end"), F.lit(MENTION).alias("cover")).unionByName(
        spans.select("row", "label", F.lit(0).alias("base"), start.alias("first"), (F.col("hi") + 2).cast("long").alias("end"), "cover")
    )
    base = F.col("base") == 1
    by_row = judged.groupBy("row").agg(
        F.sum("base").cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "end", "label", "cover"))).alias("spans"),
    )
    return (
        found.where("at < 0")
        .select("row", "key", "n_words")
        .join(by_row, "row", "left")
        .select(
            F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
        )
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def oracle() -> str:
    values = ", ".join(f"({t}, '{label}', {phrase}, {size}, {place}, '{a}', '{b}')" for t, label, phrase, size, place, a, b in template_grams())
    return f"""
with grams(tmpl, label, phrase, size, place, t0, t1) as (values {values}),
docs as (select doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), chr(1081))), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') words from documents),
placed as (select doc_id, unnest(words) w0, unnest(list_concat(words[2:], [null])) w1, unnest(range(len(words))) pos from docs),
diagonals as (select doc_id, tmpl, label, phrase, size, pos - place diagonal, count(*) n, min(pos) lo, max(pos) hi, list(place) places
  from placed join grams on w0 = t0 and w1 = t1 group by all),
marked as (select *, case when diagonal - lag(diagonal) over w > {MAX_SHIFT} or lo - lag(hi) over w > size or lag(diagonal) over w is null then 1 else 0 end starts
  from diagonals where phrase = 0 window w as (partition by doc_id, tmpl order by diagonal, lo)),
islands as (select *, sum(starts) over (partition by doc_id, tmpl order by diagonal, lo) island from marked),
spans as (select doc_id, tmpl, label, size, island, len(list_distinct(flatten(list(places)))) / size cover from islands group by doc_id, tmpl, label, size, island),
judged as (select doc_id, label, 1 base, lo first, {MENTION}::double cover from diagonals where phrase = 1 and n = size
  union all select doc_id, label, 0, null, cover from spans where cover >= {MIN_COVER}),
by_doc as (select doc_id, sum(base) n_base, min(first) filter (where base = 1) first_word, max(first) filter (where base = 1) last_word,
  string_agg(distinct label, ',' order by label) filter (where base = 1) base_labels, string_agg(distinct label, ',' order by label) labels, max(cover) score from judged group by doc_id)
select d.doc_id, len(words)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score
from docs d left join by_doc using (doc_id)
"""
