import random
from collections import Counter

import numpy as np
from corpus import awkward, documents, words
from pyspark.sql import functions as F
from test_operators import brute_components

import corpus_pipeline as P
from stackloom.llm.mixing import mix_plan
from stackloom.llm.quality_rules import quality_rules
from stackloom.llm.scratch import Scratch
from stackloom.llm.token_packing import encoder


def test_pipeline_by_brute_force(spark, sf_dir):
    """Each stage again by a plain way: rules by row, all pairs, substring search, the plan's counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: (r.quality.clean_text, r.source) for r in quality_rules(docs).collect() if r.quality.kept}
    rows = sorted((i, *v) for i, v in kept.items())
    rows = [r for r, c in zip(sorted(rows, key=lambda r: tuple(str(x) for x in (r[0],))), brute_components(rows, 5, 80, 100), strict=True) if c[0] == c[2] and r[0] == c[0]]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(b in r[1] for b in bench)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mix_plan(frame).collect()}
    want = Counter()
    for i, text, _ in rows:
        want[i] = copies[i] * (len(encoder().encode_ordinary(text)) + 1)
    got = Counter()
    for r in P.run(spark, sf_dir).collect():
        ends = np.array(r.cu_seqlens)
        for d, n in zip(r.doc_ids, np.diff(ends), strict=True):
            got[d] += int(n)
    assert +want == got


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality rules", "near duplicates", "decontamination", "source mixing", "token packing"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.names == docs.schema.names


def test_one_row_of_each_component_stays(spark, sf_dir):
    """Null and shared ids, repeated rows, extra columns of any name."""
    rng = random.Random(4)
    a, b, c, d = (" ".join(words(rng, 120)) for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(None, a, "s"), (None, a, "s"), (None, b, "s"), (5, near, "t"), (5, c, "s"), (5, c, "s"), (6, c, "s"), (7, d, "s"), (8, None, "s"), (9, "", "s")]
    docs = documents(spark, rows).repartition(3)
    for x in ("quality", "first", "tag", "stays", "__row", "node", "key"):
        docs = docs.withColumn(x, F.lit("x"))
    got = P.deduplicate(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = [(None, b), (5, near), (5, c), (7, d), (8, None), (9, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_stages_of_awkward_and_empty_tables(spark, sf_dir):
    docs = documents(spark, awkward() + [(500 + k, ". ".join(" ".join(words(random.Random(k), 9, 3000)) for _ in range(12)) + ".", "s") for k in range(6)]).withColumn("quality", F.lit("own")).withColumn("size", F.lit(1))
    empty = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = Scratch(spark, "stage").write(stage(spark, docs, sf_dir), "out")
        assert docs.columns[-2:] == ["quality", "size"] and docs.filter("quality <> 'own' or text is null").count() == 0
        assert stage(spark, empty, sf_dir).count() == 0
    assert docs.count() > 0 and P.pack(spark, docs, sf_dir).count() > 0 and P.pack(spark, empty, sf_dir).count() == 0


def test_stages_give_python_bounded_batches(spark, sf_dir):
    """40 MB of text in one partition: 8 MB and a row at most in a batch, also in a result that is written later."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    before = spark.conf.get(P.BATCH)
    try:
        found = P.bounded(lambda s, d, _: d.mapInArrow(sizes, "n long"))(spark, docs, sf_dir).collect()
    finally:
        spark.conf.set(P.BATCH, before)
    assert sum(r.n for r in found) >= 40_000_000 and max(r.n for r in found) < 9 << 20
