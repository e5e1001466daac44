"""Inlined calls at an address: functions of debug information that contain it, from the outermost inwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.addresses import within, wrapping_sub
from stackloom.operators import intervals as I

_NAMES = "array<string>"


def enclosing(requests: DataFrame, functions: DataFrame) -> DataFrame:
    """Every pair of distinct requests (object, addr, base) and a function or inlined call (object, unit, die, until, depth, inlined, low, high, name, linkage) that contains the address."""
    f = I.bucketed(functions, F.col("low"), wrapping_sub(F.col("high"), F.col("low")))
    want = requests.select("object", "addr", "base").distinct()
    want = I.probed(want.join(I.levels_of(f, "object"), "object"), F.col("addr"))
    f = f.select(F.col("object").alias("f_object"), "unit", "die", "until", "depth", "inlined", "low", "high", "name", "linkage", "i_level", "i_bucket")
    on = (F.col("object") == F.col("f_object")) & (F.col("p_level") == F.col("i_level")) & (F.col("p_bucket") == F.col("i_bucket")) & within(F.col("low"), F.col("high"), F.col("addr"))
    # functions multiply behind the size that is known of their source, so they are never broadcast
    return want.join(f.hint("merge"), on).drop("f_object", "p_level", "p_bucket", "i_level", "i_bucket")


def _start(done: Column, any_: Column, x: Column) -> Column:
    some = lambda n: F.when(n.isNull(), F.array().cast(_NAMES)).otherwise(F.array(n))
    return F.struct(
        done.alias("done"), any_.alias("any"), some(x["name"]).alias("names"), some(x["linked"]).alias("linked"), x["name"].alias("root"),
        x["unit"].alias("unit"), x["until"].alias("root_until"), x["until"].alias("until"), F.lit(False).alias("inner"),
    )


def _done(s: Column, base: Column) -> Column:
    """The result so far, or the chain that ends here, if it says more than the symbol table."""
    says = (F.size(s["names"]) > 0) & (s["inner"] | F.coalesce(s["root"] != base, F.lit(False)))
    return F.coalesce(s["done"], F.when(says, s["names"]))


def chain(rows: Column, base: Column) -> Column:
    """(names, linked) from functions that contain one address, in the order of their entries.

    The first function whose chain has an inlined call, or whose name is not that of
    the symbol table (base), gives `names`; a function inside another that contains
    the address is not asked, and of calls beside each other the first is taken.
    linked: the chain of the first function, whatever the table says.  Both go from
    the outermost inwards; null where there is none.
    """
    none = F.lit(None).cast(_NAMES)
    long = lambda n: F.lit(n).cast("long")
    empty = F.array().cast(_NAMES)
    init = F.struct(
        none.alias("done"), none.alias("any"), empty.alias("names"), empty.alias("linked"), F.lit(None).cast("string").alias("root"),
        long(-1).alias("unit"), long(-1).alias("root_until"), long(-1).alias("until"), F.lit(False).alias("inner"),
    )
    first = lambda s: F.coalesce(s["any"], F.when(F.size(s["linked"]) > 0, s["linked"]))

    def step(s, x):
        within = (x["unit"] == s["unit"]) & (x["die"] < s["root_until"])
        inner = x["inlined"] & within & (x["die"] < s["until"])
        longer = F.struct(
            s["done"].alias("done"), s["any"].alias("any"), F.concat(s["names"], F.array(x["name"])).alias("names"), F.concat(s["linked"], F.array(x["linked"])).alias("linked"), s["root"].alias("root"),
            s["unit"].alias("unit"), s["root_until"].alias("root_until"), x["until"].alias("until"), F.lit(True).alias("inner"),
        )
        return F.when(inner, longer).when(~x["inlined"] & ~within, _start(_done(s, base), first(s), x)).otherwise(s)

    return F.aggregate(rows, init, step, lambda s: F.struct(_done(s, base).alias("names"), first(s).alias("linked")))


def inline_chains(requests: DataFrame, functions: DataFrame) -> DataFrame:
    """requests (object, addr, base) that functions contain, with `names` and `linked` of `chain`; functions' names are used as they stand.

    Calls without a name are no frames; what lies in them is.  At most as many rows
    as calls nest around an address meet in a group.
    """
    named = functions.filter(~F.col("inlined") | F.col("name").isNotNull())
    found = enclosing(requests, named)
    row = F.struct("unit", "die", "until", "inlined", "name", F.coalesce("linkage", "name").alias("linked"))
    # an entry with several ranges that meet in one bucket comes once
    lists = found.groupBy("object", "addr", "base").agg(F.sort_array(F.collect_set(row)).alias("rows"))
    return lists.select("object", "addr", "base", chain(F.col("rows"), F.col("base")).alias("c")).select("object", "addr", "base", "c.names", "c.linked")
