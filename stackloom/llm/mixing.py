"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are word counts.  Sources share a total by weight; a source's target
stops at `max_epochs` times its size and the excess goes to the others by
weight (water filling, solved in closed form over the table of sources).  A
source is taken in complete epochs first.  The rest of its target is a weighted
sample without replacement: each document gets the exponential key
-ln(u) / quality, u from a digest of its id and the seed, and documents are
taken in key order until their sizes add up to the rest.

A source may hold a third of all rows, so no window runs over a source.  Keys
fall into bins of equal ratios (their logarithm is cut evenly, so neither small
nor large keys crowd one bin); bins are summed (with partial sums before the
shuffle), the running sums of bins find the one bin of each source in which the
rest ends, and only that bin's rows are ordered, once they are split by a second
table of bins inside it and rows of one place are added up.  What is known of a
source is one row; that table is broadcast up to BROADCAST_SOURCES rows, and
dealt to SALTS tasks a source beyond.  The rows themselves never shuffle.

Rows that share an id share its key; ties go by id, then size, then text hash.
Rows alike in all of these have one place, and are taken alike.

Edge cases: a null or wordless text has size 0 and is never taken; a null source
is a source of its own, the last; a null id draws its key from the hash of the
text; a source of size 0 has target 0; repeated rows count as documents of
their own; a very long text is measured whole and taken whole or not; extra
columns pass through mix() untouched and may have any name;
an empty table gives an empty result.  The table of sources itself is ordered in
one task: a row of some 100 bytes a source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stackloom.llm import textkernels as K
from stackloom.llm.scratch import Scratch

BINS = 4096
BROADCAST_SOURCES = 100_000
SALTS = 32
MARKS = ("__mix_size", "__mix_quality", "__mix_hash")


def _measured(column: pa.Array):
    """For each chunk of texts: the chunk, and size, quality and text_hash of its texts."""
    for c in K.chunks(column):
        w = K.split_words(c)
        h = K.word_hashes(c, w)
        n = np.diff(w.first)
        # share of words that differ from the one before, a cheap sign of repetition
        fresh = np.ones(len(h), np.int64)
        fresh[1:] = h[1:] != h[:-1]
        fresh[w.first[:-1][n > 0]] = 1
        new = np.concatenate([[0], np.cumsum(fresh)])
        alpha = ((c.data | 32) >= 97) & ((c.data | 32) <= 122) | (c.data >= 128)
        solid = ~K.WHITE[c.data]
        letters, chars = np.concatenate([[0], np.cumsum(alpha, dtype=np.int64)]), np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
        per = lambda x, o: x[o[1:]] - x[o[:-1]]
        # quality in whole steps of 1/64, 1/64 at least, so that keys don't depend on rounding
        q = np.maximum(1, (64 * per(new, w.first) // np.maximum(n, 1)) * per(letters, c.offsets) // np.maximum(per(chars, c.offsets), 1))
        # the sum of a text's word hashes tells rows of one id apart
        digest = np.zeros(len(c), np.uint64)
        if len(h):
            digest[n > 0] = np.add.reduceat(h, w.first[:-1][n > 0])
        yield c, pa.array(n), pa.array(q), pa.array(K.as_long(digest))


def _facts(batches):
    for batch in batches:
        for c, *measures in _measured(batch.column(2)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, len(c)), batch.column(1).slice(c.lo, len(c)), *measures], ["doc_id", "source", "size", "quality", "text_hash"])


def _with_facts(at: int):
    """Rows with size, quality and text_hash of column `at` after their own columns."""

    def run(batches):
        for batch in batches:
            for c, *measures in _measured(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(c.lo, len(c)).columns, *measures], [*batch.schema.names, *MARKS])

    return run


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """sizes (source, source_size) with a target for each source; one row a source, so the windows over all of it are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    s = sizes.withColumn("weight", w).withColumn("cap", cap)
    everything = Window.partitionBy()
    # sources in the order in which a rising level fills them: cap / weight
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share)).withColumn("all_w", F.sum("weight").over(everything))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    # the first source that the level doesn't fill sets the level of all after it
    s = s.withColumn("open", level * F.col("weight") < F.col("cap")).withColumn("level", level)
    s = s.withColumn("level", F.min_by("level", F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(everything))
    first = F.min(F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(everything)
    target = F.when(first.isNotNull() & (F.col("cap") / F.col("weight") >= first), F.least(F.col("level") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap"))
    return s.select("source", "source_size", target.alias("target"))


def _key(seed: str) -> Column:
    """-ln(u) * 64 / quality, u being 52 bits of md5(seed:id) inside (0, 1)."""
    who = F.coalesce(F.col(f"{ROW}.doc_id").cast("string"), F.concat(F.lit("null:"), F.col(f"{ROW}.text_hash").cast("string")))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), who)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) * 64.0 / F.col(f"{ROW}.quality")


#: Binary logarithms of keys lie in between: u has 52 bits, quality is 1 to 64.
KEY_RANGE = (-60.0, 12.0)
ROW, SOURCE = "__mix_row", "__mix_source"


def _placed(rows: DataFrame, seed: str, bins: int) -> DataFrame:
    """rows with struct ROW (doc_id, source, size, quality, text_hash) extended by key, bin, and the bin inside the bin."""
    low, high = KEY_RANGE
    names = ("doc_id", "source", "size", "quality", "text_hash")
    rows = rows.withColumn(ROW, F.struct(*[F.col(f"{ROW}.{x}").alias(x) for x in names], _key(seed).alias("key")))
    at = F.greatest((F.log2(F.col(f"{ROW}.key")) - low) * (bins / (high - low)), F.lit(0.0))
    rows = rows.withColumn(ROW, F.struct(*[F.col(f"{ROW}.{x}").alias(x) for x in (*names, "key")], at.alias("at")))
    at = F.col(f"{ROW}.at")
    return rows.withColumn(ROW, F.struct(*[F.col(f"{ROW}.{x}").alias(x) for x in (*names, "key")], F.floor(at).cast("int").alias("bin"), F.floor((at - F.floor(at)) * bins).cast("int").alias("sub")))


def _with_source(rows: DataFrame, sources: DataFrame, salts: int | None) -> DataFrame:
    """rows with struct SOURCE, the row of `sources` that has their source."""
    names = [F.col(c) for c in sources.columns]
    same = F.col(f"{ROW}.source").eqNullSafe(F.col(f"{SOURCE}.source"))
    if salts is None:
        return rows.join(F.broadcast(sources.select(F.struct(*names).alias(SOURCE))), same)
    dealt = sources.select(F.struct(*names).alias(SOURCE), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__mix_salt"))
    salt = F.pmod(F.xxhash64(f"{ROW}.key", f"{ROW}.text_hash"), F.lit(salts)).cast("int")
    return rows.join(dealt, same & (salt == F.col("__mix_salt"))).drop("__mix_salt")


def _place(of: str = ROW) -> Column:
    none = F.col(f"{of}.doc_id").isNull()
    return F.struct(F.col(f"{of}.key").alias("key"), none.alias("none"), F.coalesce(f"{of}.doc_id", F.lit(0)).alias("d"), F.col(f"{of}.size").alias("size"), F.col(f"{of}.text_hash").alias("text_hash"))


def _copies() -> Column:
    """How often the mix takes a row with structs ROW and SOURCE."""
    row, own = (lambda x: F.col(f"{ROW}.{x}")), (lambda x: F.col(f"{SOURCE}.{x}"))
    last = (row("sub") < own("sub")) | ((row("sub") == own("sub")) & F.coalesce(_place() <= own("cut"), F.lit(False)))
    chosen = (own("rest") > 0) & ((row("bin") < own("bin")) | ((row("bin") == own("bin")) & last))
    return F.when(row("size") > 0, own("epochs") + F.coalesce(chosen, F.lit(False)).cast("long")).otherwise(F.lit(0).cast("long"))


def _source_plan(scratch: Scratch, facts: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, bins: int) -> tuple[DataFrame, int | None]:
    """(source, source_size, target, epochs, rest, bin, sub, cut), a row for each source, and its salts (None: to be broadcast)."""
    facts = facts.select(ROW)
    sizes = scratch.write(facts.groupBy(F.col(f"{ROW}.source").alias("source")).agg(F.sum(f"{ROW}.size").alias("source_size")), "sizes")
    salts = None if sizes.count() <= BROADCAST_SOURCES else SALTS
    plan = targets(sizes, weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = scratch.write(plan, "plan")
    sized = facts.filter(F.col(f"{ROW}.size") > 0)

    def boundary(rows: DataFrame, key: str, rest: DataFrame) -> DataFrame:
        """For each source: the bin in which the rest ends, and the rest inside it."""
        sums = rows.groupBy(F.col(f"{ROW}.source").alias("source"), F.col(f"{ROW}.{key}").alias(key)).agg(F.sum(f"{ROW}.size").alias("bin_size"))
        run = F.sum("bin_size").over(Window.partitionBy("source").orderBy(key)) - F.col("bin_size")
        p = rest.select(F.col("source").alias("p_source"), "rest")
        s = sums.withColumn("before", run).join(p, F.col("source").eqNullSafe(F.col("p_source")))
        s = s.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bin_size") >= F.col("rest")))
        return s.select("source", key, (F.col("rest") - F.col("before")).alias("rest"))

    first = scratch.write(boundary(sized, "bin", plan), "first")
    inside = _with_source(sized, first, salts).filter(F.col(f"{ROW}.bin") == F.col(f"{SOURCE}.bin")).select(ROW)
    second = scratch.write(boundary(inside, "sub", first), "second")
    edge = _with_source(inside, second, salts).filter(F.col(f"{ROW}.sub") == F.col(f"{SOURCE}.sub"))
    # rows of one place count together
    edge = edge.groupBy(F.col(f"{ROW}.source").alias("source"), _place().alias("place")).agg(F.sum(f"{ROW}.size").alias("words"), F.first(f"{SOURCE}.rest").alias("rest"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    # ends past the rest by no more than it would fall short without it
    edge = edge.withColumn("over", run - F.col("rest"))
    cut = edge.filter("over <= 0 or over <= words - over").groupBy("source").agg(F.max("place").alias("cut"))
    same = F.col("source").eqNullSafe(F.col("p_source"))
    for extra in (first.select("source", "bin"), second.select("source", "sub"), cut):
        plan = plan.join(extra.withColumnRenamed("source", "p_source"), same, "left").drop("p_source")
    return scratch.write(plan, "cuts"), salts


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bins: int = BINS
) -> DataFrame:
    """(doc_id, source, size, source_size, target, quality, text_hash, copies, taken), a row for each row of docs.

    copies whole documents of size words each are taken: taken = copies * size.
    The document in which the rest ends is taken if that brings the source
    nearer to its target.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    facts = rows.mapInArrow(_facts, "doc_id long, source string, size long, quality long, text_hash long")
    facts = scratch.write(_placed(facts.select(F.struct("*").alias(ROW)), seed, bins), "facts")
    plan, salts = _source_plan(scratch, facts, weights, share, max_epochs, bins)
    both = _with_source(facts, plan, salts)
    own = [F.col(f"{ROW}.{x}").alias(x) for x in ("doc_id", "source", "size")] + [F.col(f"{SOURCE}.{x}").alias(x) for x in ("source_size", "target")]
    both = both.select(*own, F.col(f"{ROW}.quality").alias("quality"), F.col(f"{ROW}.text_hash").alias("text_hash"), _copies().alias("copies"))
    out = scratch.write(both.withColumn("taken", F.col("copies") * F.col("size")), "result")
    scratch.drop("facts")
    return out


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bins: int = BINS
) -> DataFrame:
    """docs, each row as often as mix_plan takes it; a row's copies follow from itself and its source's row, so rows need no join with each other.

    Columns go under numbers on the way, so they may have any names.
    """
    names = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    id_col, text_col, source_col = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    scratch = Scratch(docs.sparkSession, "mix")
    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in MARKS]])
    marked = docs.mapInArrow(_with_facts(docs.columns.index(text_col)), schema)
    row = F.struct(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), *[F.col(c).alias(x) for c, x in zip(MARKS, ("size", "quality", "text_hash"), strict=True)])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    facts = rows.mapInArrow(_facts, "doc_id long, source string, size long, quality long, text_hash long")
    facts = scratch.write(_placed(facts.select(F.struct("*").alias(ROW)), seed, bins), "facts")
    plan, salts = _source_plan(scratch, facts, weights, share, max_epochs, bins)
    scratch.drop("facts")
    both = _with_source(_placed(marked.withColumn(ROW, row), seed, bins), plan, salts).withColumn("__mix_copies", _copies()).filter("__mix_copies > 0")
    return both.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*docs.columns).toDF(*names)
