"""N-gram Jaccard join with token-combination prefixes; connected components of its links.

Documents are sets of word shingles, links join sets with 100 * intersection >= link * union: four words and 85 in op4,
five words and 80 in the pipeline's stage. All tokens (shingle hashes)
have one global order: rare ones before frequent ones, each class by hash. Let t be the most tokens of a set of n that a
linked set can lack (n - ceil(link n / 100)). Of the first t + 1 + e tokens of the linked set whose prefix ends first at most t
are missing in the other, so the two prefixes share e + 1 tokens at least, e being a twentieth of the set. Prefixes are
indexed by single rare tokens and, for small sets, by pairs of frequent ones, which are far more selective; a pair of
sets is a candidate if what its signatures tell leaves room for e + 1 shared tokens, and is then verified on whole sets.
The link is 80 at least: then two different linked sets share four tokens, which is e + 1 up to 20 tokens. It is a multiple
of 5: then t falls by one wherever e of a larger linked set is one more, so that either set's own e may be asked for.

Frequent tokens are those found often by counts over all documents (each task reports tokens that stand in several of
its documents); which tokens are in the class only decides the order, never which links are found, so the class may be
limited to the HOT_MOST most frequent and broadcast.

Equal sets of a task are one vertex, and signatures with equal lists of vertices one list with a weight: near copies share many. To
not make all pairs of a group of near copies, lists first link each vertex to a pivot or two of the list, and vertices that
these links show to be in one component are not compared again; what is left are lists that still hold several components: short ones
make their pairs, long ones are cut into tiles whose sets meet as matrices, so that only links come out. Links within a
component need not be found, links between components all are. A link that no short list shows lies in e + 1 signatures of long lists, so that
a vertex may leave its longest lists as long as these tell of fewer: the shortest list of the pair's still holds both.

Texts are read twice, to find the frequent class and to sign the sets, and once more for the sets that may have a link: these
are told apart by a Bloom filter of fixed size and only they are shuffled. Joins are shuffled at every size, nothing waits for
a count of rows; hot keys go through lookup() or are dealt to blocks. Staged tables are deleted as soon as they have been read.

Null and empty texts have no shingles and are linked with nothing; equal ids are separate documents; null ids stay null
and count as the largest; extra columns are ignored. A text of any length is one set, which a task holds whole: 8 bytes a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylattice.operators.components import components

from .common import Scratch, arrow_rows, free_name, lookup, sieve, staged, whole_text

WORDS, LINK = 4, 85
#: The words and the link of the pipeline's stage.
STAGE_WORDS, STAGE_LINK = 5, 80
#: A token found so often is frequent; tasks report tokens found so often in a chunk of so many; most frequent tokens kept.
HOT, HOT_IN_CHUNK, HOT_MOST, CHUNK = 40, 3, 1_000_000, 2_000_000
#: Sets of up to so many tokens index pairs of frequent tokens; those above (less what a link allows) index them singly.
PAIR_SETS = 100
#: Lists of more sets are compared tile by tile; sets and tokens of a tile, about; rows of two tiles in an Arrow batch.
TILE = 128
TILE_SETS, TILE_TOKENS, TILE_ROWS = 1024, 1 << 17, 8
#: Rows of an Arrow batch, and digests of texts or sets that a task remembers.
BATCH, SEEN = 500, 500_000
#: Partners of a pivot that one task streams behind its text.
BLOCK = 512
#: Each round's turns, by which lists choose pivots; the last round, without any, makes all pairs between components that are left.
PIVOTS = ((0, 0x2A6F0C5B37D1E948), ())
#: Stands for a null id inside.
NO_ID = 2**63 - 1
#: The stage's own key of rows.
ROW = "skylattice_row"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The hashes of each text's shingles in order: ASCII lower case, words split at ASCII white space. All texts are hashed in one go."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = pd.util.hash_array(np.array(list(chain.from_iterable(words)), dtype=object), categorize=False)
    x = h[: max(0, len(h) - size + 1)].copy()
    for i in range(1, size):
        x = mixed(x + MIX[0]) ^ h[i : i + len(x)]
    x = mixed(x).view(np.int64)
    out, start = [], 0
    for w, count in zip(words, n.tolist()):
        if 0 < count < size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\n".join(w), seed=count)], np.uint64).view(np.int64))
        else:
            out.append(x[start : start + max(0, count - size + 1)])
        start += count
    return out


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """A text's sorted distinct shingles."""
    return np.unique(shingles([text], size)[0])


def missing(n: int, link: int = LINK) -> int:
    """The most tokens of a set of n that a linked set can lack."""
    return n - -(-link * n // 100)


def extra(n: int) -> int:
    return -(-n // 20) + 2


SETS = "doc_id long, mark long, n int, hi long, lo long, kept boolean, singles array<long>, pairs array<long>"


def arrays(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


class _Seen(set):
    """What a task has met, up to SEEN things; then it starts anew."""

    def first(self, x: bytes) -> bool:
        if x in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(x)
        return True


def frequent_tokens(rows: DataFrame, words: int) -> np.ndarray:
    """The frequent class, sorted: tasks report the tokens that stand HOT_IN_CHUNK times in a chunk of documents or more, and those
    reported HOT times in all are frequent, the HOT_MOST most frequent ones at most. Texts that a task has met before do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, chunk = _Seen(), []

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(chunk), return_counts=True)
            often = counts >= HOT_IN_CHUNK
            return pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(counts[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                texts = [t for t in batch.column(0).slice(start, BATCH).to_pylist() if seen.first(xxhash.xxh3_128_digest(t))]
                chunk += shingles(texts, words)
                held = sum(map(len, chunk))
                if held >= CHUNK:
                    yield report()
                    chunk = []
        if chunk:
            yield report()

    counts = rows.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    return np.sort(counts.orderBy(F.desc("n"), "token").limit(HOT_MOST).select("token").toArrow().column(0).to_numpy())


def to_sets(rows: DataFrame, words: int, link: int, hot) -> DataFrame:
    """(doc_id, text, mark) -> sizes, 128-bit names and signatures of the sets. A set that a task has met before is not kept and has no signatures."""
    names = [f.split()[0] for f in SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, none, frequent = _Seen(), np.empty(0, np.int64), hot.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                ns, digests, kept, singles, pairs = [], [], [], [], []
                for found in shingles(part.column(1).to_pylist(), words):
                    tokens = np.unique(found)
                    digest = xxhash.xxh3_128_digest(tokens.tobytes())
                    new = len(tokens) > 0 and seen.first(digest)
                    one, two = signatures(tokens, frequent, link) if new else (none, none)
                    ns.append(len(tokens)), digests.append(digest), kept.append(new), singles.append(one), pairs.append(two)
                name = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = [part.column(0), part.column(2), pa.array(ns, pa.int32()), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(kept), arrays(singles), arrays(pairs)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("doc_id", "text", "mark").mapInArrow(run, SETS)


def signatures(tokens: np.ndarray, hot: np.ndarray, link: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Single and pair signatures of a set: its rare tokens come first, then the frequent ones, each class by hash."""
    n = len(tokens)
    need = missing(n, link) + 1 + extra(n)
    at = np.minimum(np.searchsorted(hot, tokens), max(0, len(hot) - 1))
    frequent = hot[at] == tokens if len(hot) else np.zeros(n, bool)
    singles, pairs = tokens[~frequent][:need], tokens[:0]
    often = tokens[frequent][: need - len(singles)]
    if n * link <= PAIR_SETS * 100 and n <= PAIR_SETS:
        i, j = np.triu_indices(len(often), 1)
        x = often.view(np.uint64)
        pairs = mixed(mixed(x[i] + MIX[0]) ^ x[j]).view(np.int64)
    if n * 100 >= PAIR_SETS * link or n > PAIR_SETS:
        singles = np.concatenate([singles, often])
    return singles, pairs


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (uid, doc_id, mark) with their texts. Only rows that pass a sieve of the wanted keys are shuffled."""
    found = rows.where(sieve(wanted.select("doc_id", "mark"))("doc_id", "mark")).dropDuplicates(["doc_id", "mark"])
    return found.join(wanted.select("uid", "doc_id", "mark").hint("merge"), ["doc_id", "mark"]).select("uid", "text")


def verified(keep: Scratch, texts: DataFrame, pairs: DataFrame, words: int, link: int) -> DataFrame:
    """The pairs (u, v) whose whole sets link. The partners u of a pivot v are dealt to blocks of BLOCK, so that a pivot with any
    share of all pairs is no single task; each block streams behind its pivot's text."""
    pairs = keep.table(pairs, "candidates")
    pivots = keep.table(pairs.groupBy("v").agg(F.count("*").alias("n")), "pivots")
    of = lambda name: texts.withColumnRenamed("uid", name).hint("merge")
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = lookup(pairs, pivots, ["v"], pivots).select("u", "v", F.pmod(F.xxhash64("u"), blocks).alias("block"))
    own = dealt.join(of("u"), "u").select("v", "block", "u", "text")
    heads = pivots.join(of("v"), "v").select("v", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(None).cast("long").alias("u"), "text")
    both = heads.unionByName(own).repartition("v", "block").sortWithinPartitions("v", "block", F.asc_nulls_first("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.empty(0, np.int64)
        for batch in batches:
            us, vs = [], []
            for v, u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens = shingle_set(text.as_py(), words)
                if u is None:
                    pivot = tokens
                    continue
                shared = len(np.intersect1d(pivot, tokens, assume_unique=True))
                if 100 * shared >= link * (len(pivot) + len(tokens) - shared):
                    us.append(u), vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    links = keep.table(both.select("v", "u", "text").mapInArrow(run, "u long, v long"), "links")
    keep.drop(pairs, pivots)
    return links


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b: products of 0/1 matrices over the shared tokens, some columns at a time."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    places = []
    for sets in (a, b):
        flat, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        held = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        places.append((rows[held], at[held]))
    for start in range(0, len(shared), 4096):
        width = min(4096, len(shared) - start)
        part = []
        for sets, (rows, at) in zip((a, b), places):
            here = (at >= start) & (at < start + width)
            m = np.zeros((len(sets), width), np.float32)
            m[rows[here], at[here] - start] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def told(ones: Column, twos: Column) -> Column:
    """How many shared tokens so many shared signatures tell of at most: p pairs of s frequent tokens, p = s (s - 1) / 2; without any, one may be."""
    return ones + F.when(twos > 0, (1 + F.sqrt(1 + 8 * twos)) / 2).otherwise(1)


def shares_enough(ones: str = "ones", twos: str = "twos") -> Column:
    """Whether signatures tell of as many shared tokens as a link of a set of n asks for."""
    return told(F.col(ones), F.col(twos)) >= F.ceil(F.col("n") / 20) + 3 - 1e-9


def without_longest(long: DataFrame) -> DataFrame:
    """long (u, n, sig, one, k, ones, twos) less the longest lists of each vertex that together tell of too little for a link."""
    upto = Window.partitionBy("u").orderBy(F.desc("k"), "sig", "one").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumns({"all_ones": F.sum("ones").over(upto), "all_twos": F.sum("twos").over(upto)}).where(shares_enough("all_ones", "all_twos")).drop("all_ones", "all_twos")


def tile_links(keep: Scratch, texts: DataFrame, long: DataFrame, words: int, link: int) -> DataFrame:
    """Links between components within long lists, without making their pairs: a list is dealt to tiles of about TILE sets,
    two tiles meet in a task as matrices, and only the links leave it."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays([shingle_set(t.as_py(), words) for t in batch.column(1)])], names=["u", "tokens"])

    sets = texts.withColumnRenamed("uid", "u").join(long.select("u").distinct().hint("merge"), "u").select("u", "text").mapInArrow(shingled, "u long, tokens array<long>")
    tiles = long.withColumn("tile", F.pmod(F.xxhash64("u"), F.greatest(F.ceil(F.col("k") / TILE_SETS), F.ceil(F.col("mass") / TILE_TOKENS))).cast("int"))
    tiles = tiles.join(sets.hint("merge"), "u").groupBy("sig", "one", "tile").agg(F.collect_list(F.struct("u", "label", "tokens")).alias("sets"))
    tiles = keep.table(tiles, "tiles")
    index = tiles.select("sig", "one", "tile")
    meets = index.join(index.withColumnRenamed("tile", "other").hint("merge"), ["sig", "one"]).where("tile < other")
    met = meets.join(tiles.hint("merge"), ["sig", "one", "tile"]).join(tiles.select("sig", "one", F.col("tile").alias("other"), F.col("sets").alias("others")).hint("merge"), ["sig", "one", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for c in (0, 1):
                    rows = batch.column(c)[i].values
                    column = rows.field("tokens")
                    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                    sides.append((rows.field("u").to_numpy(), rows.field("label").to_numpy(), [flat[x:y] for x, y in zip(offsets, offsets[1:])]))
                (u, own, a), (v, other, b) = sides
                both = overlaps(a, b)
                joined = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both
                x, y = np.nonzero((100 * both >= link * joined) & (own[:, None] != other[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(u[x]), pa.array(v[y])], names=["u", "v"])

    # A tile meets itself where it lies.
    met = tiles.select("sets", F.col("sets").alias("others")).unionByName(met.select("sets", "others"))
    with arrow_rows(texts.sparkSession, TILE_ROWS):
        links = keep.table(met.mapInArrow(run, "u long, v long").distinct(), "tile-links")
    keep.drop(tiles)
    return links


def hooked(keep: Scratch, links: DataFrame) -> DataFrame:
    """(u, label) of every vertex linked with a smaller one: the least vertex that its least one is linked with, or that one. Equal labels
    are in one component, not always the other way round: enough to not compare what is known to be together."""
    ends = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep.table(ends.groupBy("u").agg(F.min("v").alias("label")), "least-links")
    above = least.select(F.col("u").alias("label"), F.col("label").alias("above"))
    return keep.table(least.join(above.hint("merge"), "label", "left").select("u", F.coalesce("above", "label").alias("label")), "hooks")


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. words: of a shingle; link: the least likeness of linked sets, in percent."""
    if words < 1 or link not in (80, 85, 90, 95):
        raise ValueError(f"shingles of {words} words linked from {link} percent on: a word at least, and 80, 85, 90 or 95 percent")
    # All that runs Python is written inside; what is returned are joins of written tables.
    with arrow_rows(docs.sparkSession, BATCH):
        return _components_of(docs, key, text, words, link)


def _components_of(docs: DataFrame, key: str, text: str, words: int, link: int) -> DataFrame:
    spark = docs.sparkSession
    keep = Scratch(spark)
    given = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    rows = given.withColumn("mark", F.xxhash64("text"))
    hot = spark.sparkContext.broadcast(frequent_tokens(given, words))
    sets = keep.table(to_sets(rows, words, link, hot).withColumn("uid", F.monotonically_increasing_id()), "sets")

    # A task signs equal sets once; equal sets of several tasks link like any others. All take the label of the least uid.
    # Sets without tokens are linked with nothing.
    empty = keep.table(sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")), "empty-sets")
    named = keep.table(sets.where("n > 0").select("uid", "doc_id", "mark", "n", "hi", "lo", "kept"), "named-sets")
    vertices = keep.table(named.groupBy("hi", "lo").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "vertices")

    # Signatures that several sets have; those with the same list of sets are one list, which counts as often: copies share many.
    marks = sets.select(F.col("uid").alias("u"), F.explode("singles").alias("sig"), F.lit(1).alias("one")).unionByName(sets.select(F.col("uid").alias("u"), F.explode("pairs").alias("sig"), F.lit(0).alias("one")))
    marks = marks.repartition("sig", "one")
    whose = [F.bit_xor(F.xxhash64("u", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    kinds = marks.groupBy("sig", "one").agg(F.count("*").alias("k"), *whose).where("k > 1")
    kinds = kinds.groupBy("k", "h1", "h2").agg(F.min(F.struct("sig", "one")).alias("s"), F.sum("one").alias("ones"), F.sum(1 - F.col("one")).alias("twos")).select("s.sig", "s.one", "ones", "twos")
    lists = keep.table(marks.join(kinds.hint("shuffle_hash"), ["sig", "one"]), "kinds-of-lists")
    keep.drop(sets)

    # A vertex that shares too little with all others together can drop out.
    both = lists.groupBy("u").agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos"))
    enough = both.join(named.withColumnRenamed("uid", "u").hint("merge"), "u").where(shares_enough())
    enough = keep.table(enough.select("u", "n", "doc_id", "mark"), "sharing-vertices")
    texts = keep.table(texts_of(rows, enough.withColumnRenamed("u", "uid")), "texts")
    lists, raw = keep.table(lists.join(enough.select("u", "n").hint("merge"), "u"), "signature-lists"), lists
    keep.drop(raw)

    near = (F.col("n") * 100 >= F.col("m") * link) & (F.col("m") * 100 >= F.col("n") * link)
    least_extra = F.ceil(F.least("n", "m") / 20) + 2

    labels, found = None, []
    for turns in PIVOTS:
        now = lists.withColumn("label", F.col("u")) if labels is None else lists.join(labels.hint("merge"), "u", "left").withColumn("label", F.coalesce("label", "u"))
        now = keep.table(now, "labelled-lists")
        # The nearest to each turn by exclusive or: one vertex of each list, the same one in all lists that hold it and its like.
        nearest = [F.min_by(F.struct(F.col("u").alias("v"), F.col("n").alias("m"), F.col("label").alias("other")), F.col("u").bitwiseXOR(F.lit(t))).alias(f"p{i}") for i, t in enumerate(turns)]
        several = now.groupBy("sig", "one").agg(F.count("*").alias("k"), F.sum("n").alias("mass"), F.min("label").alias("a"), F.max("label").alias("b"), *nearest).where("a < b").drop("a", "b")
        links = []
        if turns:
            # Pivots only save work; a pair needs half of what a link would share to be looked at here.
            several = keep.table(several.select("sig", "one", "k", F.array_distinct(F.array(*[f"p{i}" for i in range(len(turns))])).alias("p")), "pivots-of-lists")
            met = lookup(now, several.select("sig", "one", F.explode("p").alias("p")).select("sig", "one", "p.*"), ["sig", "one"], several.withColumnRenamed("k", "n")).where("u <> v").where((F.col("label") != F.col("other")) & near)
            met = met.withColumns({"more_ones": F.lit(0), "more_twos": F.lit(0)})
            share = told(F.col("ones"), F.col("twos")) >= (least_extra + 1) / 2
        else:
            several = keep.table(several, "sizes-of-lists")
            now, raw = keep.table(lookup(now, several, ["sig", "one"], several.withColumnRenamed("k", "n")), "mixed-lists"), now
            keep.drop(raw)
            # Only these lists tell of links between components: again, what shares too little in them can drop out.
            enough = now.groupBy("u", "n").agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).where(shares_enough()).select("u")
            now, raw = keep.table(now.join(enough.hint("merge"), "u"), "sharing-lists"), now
            keep.drop(raw)
            long = now.where(F.col("k") > TILE)
            if not long.isEmpty():
                links = [tile_links(keep, texts, without_longest(long), words, link)]
            # What a pair shares in long lists besides is at most the lesser number of them that either stands in.
            seats = long.groupBy("u").agg(F.sum("ones").alias("o"), F.sum("twos").alias("t"))
            now = now.where(F.col("k") <= TILE).drop("k", "mass").join(seats.hint("merge"), "u", "left").fillna(0, ["o", "t"])
            other = now.select("sig", "one", *[F.col(c).alias(d) for c, d in (("u", "v"), ("n", "m"), ("label", "other"), ("o", "o2"), ("t", "t2"))])
            met = now.join(other.hint("merge"), ["sig", "one"]).where((F.col("u") < F.col("v")) & (F.col("label") != F.col("other")) & near)
            met = met.select("u", "v", "n", "m", "ones", "twos", F.least("o", "o2").alias("more_ones"), F.least("t", "t2").alias("more_twos"))
            share = told(F.col("ones"), F.col("twos")) >= least_extra + 1 - 1e-9
        pairs = met.groupBy("u", "v", "n", "m").agg((F.sum("ones") + F.max("more_ones")).alias("ones"), (F.sum("twos") + F.max("more_twos")).alias("twos")).where(share).select("u", "v")
        links.append(verified(keep, texts, pairs, words, link))
        found += links
        if turns:
            labels = hooked(keep, reduce(DataFrame.unionByName, found))
    labels = components(reduce(DataFrame.unionByName, found))

    final = vertices.join(labels.withColumnRenamed("u", "rep").hint("merge"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    final = keep.table(final, "labelled-vertices")
    least = keep.table(final.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least-documents")
    final = keep.table(lookup(final, least.drop("n"), ["label"], least).select("hi", "lo", "component_id", "n"), "component-of-vertices")
    linked = lookup(named, final.drop("n"), ["hi", "lo"], final).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    done = staged(linked.unionByName(empty).select(*[F.when(F.col(c) != NO_ID, F.col(c)).alias(c) if c != "n_shingles" else F.col(c) for c in linked.columns]), "components")
    keep.clear()
    return done


def representatives(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each component one row stays, the one with the least id (null ids count as the largest; of rows
    equal in id any one), and all that are linked with nothing. Rows have a key of their own: ids may repeat or be null."""
    keep = Scratch(docs.sparkSession)
    row = free_name(docs, ROW)
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-documents")
    rows = components_of(keyed, row, words=STAGE_WORDS, link=STAGE_LINK).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    ids = keyed.select(F.col(row).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    rows = keep.table(rows.join(ids.hint("merge"), "row"), "rows-of-components")
    groups = keep.table(rows.groupBy("component").agg(F.min(F.struct("id", "row"))["row"].alias("stays"), F.count("*").alias("n")), "groups")
    gone = staged(lookup(rows, groups, ["component"], groups).where("row <> stays").select(F.col("row").alias(row)), "copies")
    keep.clear()
    # Texts stay where they are but for those whose keys pass the sieve.
    maybe = sieve(gone)(row)
    kept = keyed.where(~maybe).unionByName(keyed.where(maybe).join(gone.hint("merge"), row, "left_anti"))
    return kept.select(*docs.columns)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, chr(10))]
  else list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], chr(10)))) end s from docs),
toks as (select doc_id, hash(unnest(s)) t from sets),
freq as (select t from toks group by t having count(*) > 1),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from toks a join freq using (t) join toks b on a.t = b.t and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join sets p on p.doc_id = x join sets q on q.doc_id = y where 100 * c >= {LINK} * (len(p.s) + len(q.s) - c)),
edges as (select x, y from links union select y, x from links),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, e.y from reach r join edges e on r.b = e.x)
select s.doc_id, len(s.s)::bigint n_shingles, min(r.b) component_id from sets s join reach r on r.a = s.doc_id group by s.doc_id, s.s
"""
