"""Line dedup by a suffix array over line ids.

Documents in id order are one long sequence of lines (blank ones aside). A run of lines that stands earlier in it, word
for word, is a later copy and is deleted if it has at least MIN_WORDS words; runs do not cross documents.

Lines that stand more than once get ids by the order of their hashes. Prefix doubling then ranks the suffixes at these
lines by their first 1, 2, 4, ... lines: the pair of ranks at a place and 2^k lines on is ranked in order (a range
partitioning, a sort and increasing ids; no task or driver sees them all), and only pairs that repeat go on. Suffixes
with equal ranks, or equal pairs of overlapping ranks for lengths between, share a longest common prefix of that
length: an interval of the suffix array. A repeated run is covered by the shortest stretches of at least MIN_WORDS words
that begin or end at each of its lines, so intervals at their depths, of at most MIN_WORDS lines, reveal every maximal
run. In each interval the place that comes first stays; the others are cut, and overlapping cuts merge into maximal runs.

Everything after the cutting of texts into lines is joins and aggregations over repeated lines only; lines and intervals
that hold any share of the rows go through lookup(). Texts stay where they are but for those that pass a Bloom filter of the
documents with cuts, which are shuffled to join them, at every size alike.

Words are what stands between ASCII white space; a line without any is blank. Null and empty texts stay as they are; null
ids come first; rows equal in id and text count as one and share its result. Extra columns pass by: dedup_lines replaces only
columns named n_lines or n_cut, the pipeline's stage none. A text of any length is one value of a row; it is cut into lines in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free_name, lookup, short_batches, sieve, staged, whole_text, without

MIN_WORDS = 50
LINES = "doc long, mark long, pos int, line int, hi long, lo long, ahead int, ahead_line int, back int, back_line int"
PLACE = ["doc", "mark", "pos"]


def stretches(words: list[int], least: int) -> tuple[list[int], list[int]]:
    """For each line the number of lines from it on, and up to it, that have at least `least` words; 0 if there are not so many."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ahead = np.searchsorted(total, total[:-1] + least, "left") - np.arange(n)
    ahead[total[:-1] + least > total[-1]] = 0
    back = np.arange(1, n + 1) - (np.searchsorted(total, total[1:] - least, "right") - 1)
    back[total[1:] < least] = 0
    return ahead.tolist(), back.tolist()


def to_lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    names = [f.split()[0] for f in LINES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part, out = batch.slice(start, 1000), []
                for doc, mark, whole in zip(*(c.to_pylist() for c in part.columns)):
                    lines = whole.split(b"\n")
                    counts = [len(x.split()) for x in lines]
                    at = [i for i, n in enumerate(counts) if n]
                    if not at:
                        continue
                    ahead, back = stretches([counts[i] for i in at], least)
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(lines[i]) for i in at), "<i8").reshape(-1, 2)
                    out.append((np.full(len(at), doc), np.full(len(at), mark), np.arange(len(at)), np.array(at), digests[:, 0], digests[:, 1],
                                np.array(ahead), np.array([at[i + max(n, 1) - 1] for i, n in enumerate(ahead)]), np.array(back), np.array([at[i - max(n, 1) + 1] for i, n in enumerate(back)])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select(order_key(key), mark_of(text), whole_text(text).cast("binary").alias("text")).mapInArrow(run, LINES)


def order_key(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc")


def mark_of(text: str):
    return F.xxhash64(whole_text(text)).alias("mark")


def ranked(keep: Scratch, classes: DataFrame, *by: str) -> DataFrame:
    """classes with ids that follow the order of `by`: the ranks of the suffixes that begin with them."""
    return keep.table(classes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_runs(keep: Scratch, lines: DataFrame, least: int) -> DataFrame:
    """(doc, mark, pos, len, from_line, to_line) of the stretches that are later copies."""
    ids = ranked(keep, lines.groupBy("hi", "lo").agg(F.count("*").alias("n")).where(F.col("n") > 1), "hi", "lo")
    # Rows equal in id and text leave one set of lines.
    live = lookup(lines, ids.drop("n"), ["hi", "lo"], ids).drop("hi", "lo").dropDuplicates(PLACE)
    live = keep.table(live, "repeated-lines")
    keep.drop(lines, ids)
    end = F.col("pos") + F.lit(0)
    asked = (
        live.where("ahead > 0").select("doc", "mark", "pos", F.col("ahead").alias("len"), F.col("line").alias("from_line"), F.col("ahead_line").alias("to_line"))
        .unionByName(live.where("back > 0").select("doc", "mark", (end - F.col("back") + 1).alias("pos"), F.col("back").alias("len"), F.col("back_line").alias("from_line"), F.col("line").alias("to_line")))
        .dropDuplicates([*PLACE, "len"])
    )
    asked = keep.table(asked, "stretches")
    longest = asked.agg(F.max("len")).first()[0] or 0
    suffixes, step, found = live.select(*PLACE, "rank"), 1, None
    while step <= longest:
        here = suffixes.withColumnRenamed("rank", "r0")
        level = asked.where(F.col("len").between(step, 2 * step - 1)).join(here.hint("merge"), PLACE)
        later = suffixes.select("doc", "mark", F.col("pos").alias("tail"), F.col("rank").alias("r1"))
        level = level.withColumn("tail", F.col("pos") + F.col("len") - step).join(later.hint("merge"), ["doc", "mark", "tail"]).select(*PLACE, "len", "from_line", "to_line", "r0", "r1")
        found = level if found is None else found.unionByName(level)
        if 2 * step > longest:
            break
        ahead = suffixes.select("doc", "mark", (F.col("pos") - step).alias("pos"), F.col("rank").alias("r1"))
        pairs = keep.table(here.join(ahead.hint("merge"), PLACE), "pairs-of-ranks")
        ranks = ranked(keep, pairs.groupBy("r0", "r1").agg(F.count("*").alias("n")).where(F.col("n") > 1), "r0", "r1")
        suffixes = keep.table(lookup(pairs, ranks.drop("n"), ["r0", "r1"], ranks).select(*PLACE, "rank"), "suffixes")
        keep.drop(pairs, ranks)
        step *= 2
    if found is None:
        return asked.select(*PLACE, "len", "from_line", "to_line")
    found = keep.table(found, "intervals")
    interval = ["len", "r0", "r1"]
    # The first place of each interval, found without sorting one: the least id, then mark, then place.
    sizes = keep.table(found.groupBy(*interval).agg(F.count("*").alias("n"), F.min("doc").alias("d")).where(F.col("n") > 1), "sizes-of-intervals")
    first = lookup(found, sizes.drop("n"), interval, sizes).where(F.col("doc") == F.col("d")).groupBy(*interval, "d", "mark").agg(F.min("pos").alias("p"))
    first = keep.table(first.groupBy(*interval, "d").agg(F.min("mark").alias("m"), F.min_by("p", "mark").alias("p")), "first-places")
    later = lookup(found, first, interval, sizes)
    return later.where((F.col("doc") != F.col("d")) | (F.col("mark") != F.col("m")) | (F.col("pos") != F.col("p"))).select(*PLACE, "len", "from_line", "to_line")


def cuts_of(runs: DataFrame) -> DataFrame:
    """(doc, mark, starts, ends): each document's merged cuts in order."""
    order = Window.partitionBy("doc", "mark").orderBy("pos", "len")
    reach = F.max(F.col("pos") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("new", (reach.isNull() | (F.col("pos") > reach)).cast("int")).withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy("doc", "mark", "island").agg(F.min("from_line").alias("from_line"), (F.max("to_line") + 1).alias("end"))
    return merged.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("from_line", "end"))).alias("cuts"))


def with_cuts(docs: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a struct of the text less its later copies, n_lines (before) and n_cut."""
    short_batches(docs.sparkSession)
    keep = Scratch(docs.sparkSession)
    lines = keep.table(to_lines(docs, key, text, least), "lines")
    doc, mark, cut, split, done = (free_name(docs, f"line_dedup_{x}") for x in ("doc", "mark", "cuts", "lines", "done"))
    cuts = staged(cuts_of(repeated_runs(keep, lines, least)), "cuts").toDF(doc, mark, cut)
    keep.clear()
    keyed = docs.withColumns({doc: order_key(key), mark: mark_of(text)})
    maybe = sieve(cuts.select(doc, mark))(doc, mark)
    whole = keyed.where(~maybe).withColumn(cut, F.lit(None).cast(cuts.schema[cut].dataType))
    rows = whole.unionByName(keyed.where(maybe).join(cuts.hint("merge"), [doc, mark], "left"))
    rows = rows.withColumn(split, F.when(F.col(cut).isNotNull(), F.split(text, "\n", -1)))
    full = whole_text(text)
    ends, starts = F.concat(F.array(F.lit(0)), F.col(f"{cut}.end")), F.concat(F.col(f"{cut}.from_line"), F.array(F.size(split)))
    keeps = F.zip_with(ends, starts, lambda a, b: F.slice(F.col(split), a + 1, b - a))
    result = F.struct(
        F.when(F.col(cut).isNotNull(), F.array_join(F.flatten(keeps), "\n")).otherwise(F.col(text)).alias("text"),
        (F.length(full) - F.length(F.replace(full, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(cut, F.lit(0), lambda a, c: a + c["end"] - c["from_line"]), F.lit(0)).cast("long").alias("n_cut"),
    )
    return rows.withColumn(done, result).drop(doc, mark, cut, split), done


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """docs with the text less its later copies, n_lines (before) and n_cut."""
    rows, done = with_cuts(without(docs, "n_lines", "n_cut"), key, text, least)
    return rows.withColumns({text: F.col(f"{done}.text"), "n_lines": F.col(f"{done}.n_lines"), "n_cut": F.col(f"{done}.n_cut")}).drop(done)


def deduped_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents of which nothing but blank lines remains are copies and go. n_chars, if there is one, follows the text."""
    rows, done = with_cuts(docs, "doc_id", "text", MIN_WORDS)
    cut, left = F.col(f"{done}.n_cut"), F.col(f"{done}.text")
    rows = rows.where((cut == 0) | left.rlike(r"[^\x20\x09-\x0D]"))
    columns = {"n_chars": F.when(cut > 0, F.char_length(left).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return rows.withColumns(columns | {"text": left}).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_lines", "n_cut", "text")


ORACLE = f"""
with docs as (select doc_id, text, string_split(text, chr(10)) ls from documents),
raw as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 line_no from docs),
counted as (select *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) words from raw),
seq as (select *, row_number() over (partition by doc_id order by line_no) - 1 pos, sum(words) over (partition by doc_id order by line_no) upto from counted where words > 0),
ahead as (select a.doc_id, a.pos s, min(b.pos) e from seq a join seq b on a.doc_id = b.doc_id and b.pos >= a.pos and b.upto - a.upto + a.words >= {MIN_WORDS} group by all),
back as (select a.doc_id, max(b.pos) s, a.pos e from seq a join seq b on a.doc_id = b.doc_id and b.pos <= a.pos and a.upto - b.upto + b.words >= {MIN_WORDS} group by a.doc_id, a.pos),
windows as (select * from ahead union select * from back),
content as (select w.doc_id, w.s, w.e, md5(string_agg(q.line, chr(10) order by q.pos)) c from windows w join seq q on q.doc_id = w.doc_id and q.pos between w.s and w.e group by all),
later as (select * from content qualify row_number() over (partition by c, e - s order by doc_id, s) > 1),
cut_seq as (select distinct q.doc_id, q.pos, q.line_no from seq q join later l on q.doc_id = l.doc_id and q.pos between l.s and l.e),
cut as (select doc_id, line_no from cut_seq union select r.doc_id, r.line_no from cut_seq a join cut_seq b on a.doc_id = b.doc_id and b.pos = a.pos + 1 join raw r on r.doc_id = a.doc_id and r.line_no > a.line_no and r.line_no < b.line_no),
kept as (select r.doc_id, string_agg(r.line, chr(10) order by r.line_no) filter (where c.line_no is null) text, count(c.line_no) n_cut from raw r left join cut c on r.doc_id = c.doc_id and r.line_no = c.line_no group by r.doc_id)
select d.doc_id, case when n_cut > 0 then coalesce(k.text, '') else d.text end text, coalesce(len(ls), 1)::bigint n_lines, coalesce(n_cut, 0)::bigint n_cut from docs d left join kept k using (doc_id)
"""
