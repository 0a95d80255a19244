"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target number of words. Whole epochs of it come first; what remains is drawn without replacement: each
document gets the exponential key -ln(u) / w, u a uniform number made from its id and w its quality weight, and the
documents with the smallest keys are taken until their summed sizes come nearest to what remains.

Sorting one source in one task would not scale, so the key at which a budget ends is closed in on: the interval of keys that
holds it, at first all of a source's, is cut into BINS bins, which are summed for all sources (a partial aggregation); the
bin in which the budget ends, from its least to its largest key, is the next interval. This ends when an interval holds
LEFT rows at most or one key only, whatever the weights, and only those rows are put in order. The plan is a row for each
source, which Spark broadcasts or joins by its size; taking documents is a map over them.

The quality weight of a document is its share of distinct words unless a column of weights is given. Null texts have size 0 and null sources are a source
of their own, the last. Rows with equal ids have equal keys and are taken together. Empty tables give empty results.
A text of any length is only counted. Extra columns pass by: mix_sources replaces only columns named as its results, the pipeline's stage none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, staged, whole_text, without

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096
#: Rows of a source that are put in order at most, those of equal keys counting as one.
LEFT = 4096
FLOOR = 0.01


def measured(docs: DataFrame, key: str, text: str, source: str, weight: str | None = None) -> DataFrame:
    """docs with a struct `mix_row`: size, mix_key and mix_source of each document."""
    words = F.array_remove(F.split(whole_text(text), r"[\x20\x09-\x0D]+"), "")
    uniform = (F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 1.0) / F.lit(2.0**52)
    cut = F.col("mix_words")
    share = F.when(F.size(cut) > 0, F.size(F.array_distinct(cut)) / F.size(cut)).otherwise(1.0)
    quality = F.greatest(F.lit(FLOOR), F.coalesce(F.col(weight).cast("double"), F.lit(FLOOR)) if weight else share)
    return (
        docs.withColumn("mix_words", words)
        .withColumn("mix_row", F.struct(F.size(cut).cast("long").alias("size"), (-F.log(uniform) / quality).alias("mix_key"), F.col(source).alias("mix_source")))
        .drop("mix_words")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """mix_source, source_size -> also target. One row for each source: water-filling in closed form over the sources in order of cap over weight."""
    order = Window.orderBy(F.col("mix_source").isNull(), "mix_source")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("mix_source").isNull(), "mix_source")
    earlier, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = F.col("source_size") * MOST
    level = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(rest)
    capped = F.col("capped")
    final = (F.col("total") - F.coalesce(F.sum(F.when(capped, F.col("cap"))).over(everything), F.lit(0))) / F.sum(F.when(~capped, F.col("weight"))).over(everything)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.col("ratio") < level)
        .withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * final))
        .select("mix_source", "source_size", "target")
    )


def same_source(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def close_in(rows: DataFrame, at: DataFrame) -> DataFrame:
    """One round: at (at_source, budget, lo, hi, before) -> the same for the bin of [lo, hi] in which the budget ends, and the rows n in it.
    before: the sizes of all keys below lo."""
    width = F.col("hi") - F.col("lo")
    bin_ = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("mix_key") - F.col("lo")) / width * BINS))).otherwise(0)
    inside = rows.join(at.drop("n"), same_source("mix_source", "at_source") & F.col("mix_key").between(F.col("lo"), F.col("hi")))
    bins = inside.withColumn("bin", bin_).groupBy("at_source", "budget", "before", "bin").agg(
        F.sum("size").alias("binned"), F.min("mix_key").alias("lo"), F.max("mix_key").alias("hi"), F.count("*").alias("n"))
    reached = F.col("before") + F.sum("binned").over(Window.partitionBy("at_source").orderBy("bin"))
    ends = bins.withColumn("reached", reached).where(F.col("reached") >= F.col("budget"))
    found = F.struct("bin", "budget", "lo", "hi", (F.col("reached") - F.col("binned")).alias("before"), "n")
    return ends.groupBy("at_source").agg(F.min_by(found, "bin").alias("end")).select("at_source", *[F.col(f"end.{c}").alias(c) for c in ("budget", "lo", "hi", "before", "n")])


def plan_mix(rows: DataFrame) -> DataFrame:
    """A row for each source: source_size, target, epochs and the cut, up to which keys are taken once more."""
    sums = rows.groupBy("mix_source").agg(F.sum("size").alias("source_size"), F.min("mix_key").alias("lo"), F.max("mix_key").alias("hi"))
    sums = staged(sums, "mix-sums")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = staged(targets(sums.select("mix_source", "source_size")).withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-budgets")
    at = budgets.select(F.col("mix_source").alias("at_source"), "budget").join(sums.drop("source_size"), same_source("at_source", "mix_source")).select("at_source", "budget", "lo", "hi", F.lit(0).cast("long").alias("before"))
    done = None
    while True:
        at = staged(close_in(rows, at), "mix-interval")
        small = (F.col("n") <= LEFT) | (F.col("lo") == F.col("hi"))
        done = at.where(small) if done is None else done.unionByName(at.where(small))
        at = at.where(~small)
        if at.isEmpty():
            break
    # The rows of each source's last interval, in key order; the prefix nearest to the budget, the empty one included.
    last = rows.join(done.drop("n"), same_source("mix_source", "at_source") & F.col("mix_key").between(F.col("lo"), F.col("hi")))
    steps = last.groupBy("at_source", "budget", "before", "mix_key").agg(F.sum("size").alias("n")).withColumn("reached", F.col("before") + F.sum("n").over(Window.partitionBy("at_source").orderBy("mix_key")))
    off = F.abs(F.col("reached") - F.col("budget"))
    choice = steps.groupBy("at_source").agg(F.min(F.struct(off.alias("off"), F.col("mix_key").alias("cut"))).alias("best"), F.first("before").alias("before"), F.first("budget").alias("budget"), F.min("mix_key").alias("lo"))
    # Where nothing of the interval is taken, the keys below it are: none of them is as large as lo.
    cut = F.when(F.col("best.off") < F.col("budget") - F.col("before"), F.col("best.cut"))
    cuts = choice.select(F.col("at_source").alias("cut_source"), cut.alias("cut"), F.col("lo").alias("below"))
    return staged(budgets.join(cuts, same_source("mix_source", "cut_source"), "left").select(F.col("mix_source").alias("plan_source"), "source_size", "target", "epochs", "cut", "below"), "mix-plan")


def once_more(key: str) -> Column:
    """Whether the row is among those that are taken once more than the whole epochs."""
    return F.coalesce(F.when(F.col("cut").isNull(), F.col(key) < F.col("below")).otherwise(F.col(key) <= F.col("cut")), F.lit(False))


def taken_rows(docs: DataFrame, key: str, text: str, source: str, weight: str | None = None) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a struct of size, source_size, target and copies."""
    out, names = free_name(docs, "mix_taken"), {c: free_name(docs, f"mix_{i}") for i, c in enumerate(docs.columns)}
    # The documents' columns step aside while the mix's own are there.
    rows = measured(docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]), names[key], names[text], names[source], names[weight] if weight else None)
    plan = plan_mix(staged(rows.select("mix_row.*"), "mix-sizes"))
    joined = rows.join(plan, same_source("mix_row.mix_source", "plan_source"))
    taken = F.struct("mix_row.size", "source_size", "target", (F.col("epochs") + once_more("mix_row.mix_key").cast("long")).alias("copies"))
    return joined.select(*[F.col(n).alias(c) for c, n in names.items()], taken.alias(out)), out


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each. weight: a column of quality weights."""
    rows, taken = taken_rows(without(docs, "size", "source_size", "target", "copies"), key, text, source, weight)
    return rows.select(*[c for c in rows.columns if c != taken], f"{taken}.*")


def mixed_documents(docs: DataFrame, weight: str | None = None) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only, that of the weights left out."""
    rows, taken = taken_rows(docs, "doc_id", "text", "source", weight)
    copy = free_name(docs, "mix_copy")
    copies = F.col(f"{taken}.copies")
    return rows.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*[c for c in docs.columns if c != weight])


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Sizes and keys are staged once: the result needs no texts.
    slim = staged(measured(docs.select("doc_id", "text", "source"), "doc_id", "text", "source").select("doc_id", "mix_row.*"), "mix-sizes")
    done = slim.join(plan_mix(slim), same_source("mix_source", "plan_source"))
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + once_more("mix_key").cast("long"))).alias("taken"))


ORACLE = f"""
with words as (select doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w,
    (('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 1) / 4503599627370496.0 u from documents),
sized as (select doc_id, source, len(w)::bigint size, -ln(u) / (case when len(w) > 0 then greatest({FLOOR}, len(list_distinct(w)) / len(w)) else 1.0 end) mix_key from words),
sizes as (select source, sum(size)::bigint source_size from sized group by source),
weighed as (select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end weight,
    3 * source_size cap, sum(source_size) over () total from sizes),
levels as (select *, cap / weight ratio, (total - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) lvl from weighed),
targets as (select source, source_size, case when ratio < lvl then cap::double else weight * ((total - coalesce(sum(case when ratio < lvl then cap end) over (), 0))
    / sum(case when ratio >= lvl then weight end) over ()) end target from levels),
budgets as (select *, case when source_size > 0 then floor(target / source_size) else 0 end epochs, target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size budget from targets),
steps as (select source, mix_key, sum(sum(size)) over (partition by source order by mix_key) reached from sized group by source, mix_key),
offs as (select s.source, s.mix_key, abs(s.reached - b.budget) off, b.budget from steps s join budgets b on s.source is not distinct from b.source),
cuts as (select source, arg_min(mix_key, (off, mix_key)) cut, min(off) least, any_value(budget) budget from offs group by source)
select d.doc_id, d.size, b.source_size, b.target::double target, (d.size * (b.epochs + case when c.least < c.budget and d.mix_key <= c.cut then 1 else 0 end))::bigint taken
from sized d join budgets b on d.source is not distinct from b.source join cuts c on d.source is not distinct from c.source
"""
