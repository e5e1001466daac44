from corpus import awkward, documents
from pyspark.sql import functions as F

from stackloom.llm.idfilter import IdFilter, free_names
from stackloom.llm.jaccard_join import near_duplicate_components
from stackloom.llm.mixing import mix
from stackloom.llm.scratch import Scratch


def test_free_names():
    assert free_names(["a", "B_"], "a", "b", "B") == ["a_", "b", "B__"]


def test_mix_keeps_columns_of_any_name(spark):
    plain = documents(spark, awkward(3))
    odd = plain
    names = ("__mix_row", "__mix_source", "__mix_copies", "__mix_copy", "__MIX_SIZE", "__mix_hash", "c0", "a.b", "`")
    for n in names:
        odd = odd.withColumn(n.replace("`", "tick"), F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    got = mix(odd)
    assert got.columns == odd.columns
    rows = [r.asDict() for r in got.collect()]
    assert all(r[n.replace("`", "tick")] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, rows)) == sorted(map(key, (r.asDict() for r in mix(plain).collect())))


def test_filter_keeps_columns_of_any_name(spark):
    rows = spark.range(1000).select("id", *[F.concat(F.lit("x"), F.col("id")).alias(c) for c in ("__ids_at", "__ids_bits", "__ids_block", "__IDS_AT_", "a.b")])
    some = IdFilter(Scratch(spark, "clash"), "bits", spark.range(0, 1000, 7).select(F.xxhash64("id").alias("h")))
    hit, rest = some.split(rows, F.xxhash64("id"))
    assert hit.columns == rest.columns == rows.columns
    both = hit.unionByName(rest).collect()
    assert len(both) == 1000 and all(r[c] == f"x{r['id']}" for r in both for c in rows.columns[1:])
    assert {r["id"] for r in hit.collect()} >= set(range(0, 1000, 7)) and hit.count() < 300


def test_a_full_filter_loses_nothing(spark):
    """More ids than bits: rows pass that are not among them, none is lost."""
    ids = spark.range(0, 2000, 2).select(F.xxhash64("id").alias("h"))
    hit, rest = IdFilter(Scratch(spark, "full"), "bits", ids, max_bits=1 << 9).split(spark.range(2000), F.xxhash64("id"))
    kept = {r["id"] for r in hit.collect()}
    assert kept >= set(range(0, 2000, 2)) and len(kept) + rest.count() == 2000


def test_a_text_column_with_a_dot(spark):
    docs = documents(spark, awkward(4))
    odd = docs.select("doc_id", F.col("text").alias("te.xt"))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, near_duplicate_components(odd, text_col="te.xt").collect())) == sorted(map(key, near_duplicate_components(docs).collect()))
