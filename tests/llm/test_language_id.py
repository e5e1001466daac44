import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackloom.llm import language_id as L
from stackloom.llm import textkernels as K
from stackloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def brute_profile(text):
    """Shares' roots of n-grams, one by one."""
    found = Counter()
    b = [x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in text.encode()]
    for n in L.ORDERS:
        for i in range(len(b) - n + 1):
            gram = b[i : i + n]
            if all(x == 32 for x in gram):
                continue
            h = n * 374761393 % 2**32
            for x, f in zip(gram, L._FACTORS, strict=False):
                h = (h ^ x) * f % 2**32
                h ^= h >> 15
            found[h % L.BUCKETS] += 1
    total = sum(found.values())
    return {k: math.sqrt(c / total) for k, c in found.items()}


def brute_score(model, text):
    x = brute_profile(text)
    odds = [sum(v * model.weight[k, j] for k, v in x.items()) + model.offset[j] for j in range(model.code.shape[1])]
    loss = [sum(model.trust[i, j] * math.log1p(math.exp(-model.code[i, j] * o)) for j, o in enumerate(odds)) for i in range(len(model.langs))]
    best = min(range(len(loss)), key=lambda i: (round(loss[i], 9), i))
    return model.langs[best], 1 / sum(math.exp(-len(odds) * (v - loss[best])) for v in loss)


STEMS = {"aa": "ka lo mi tu re", "bb": "stra glen brok drum", "cc": "éau çon ère ïeu", "dd": "日本 語で す", "ee": "ñiz xoc quz", "ff": "ψυχή λόγος", "gg": "vrk zrt"}


def corpus(seed=0, each=12, langs=tuple(STEMS)):
    rng = random.Random(seed)
    rows = [(100 * k + i, " ".join("".join(rng.choices(STEMS[lang].split(), k=rng.randrange(1, 4))) for _ in range(rng.choice([1, 4, 40]))), lang) for k, lang in enumerate(langs) for i in range(each)]
    return rows


def awkward():
    return [(9000, None, "aa"), (9001, "", "bb"), (9002, "12 ... !?\n", "cc"), (9003, "ka lo mi", None), (None, "glen brok", None), (None, None, None), (9004, "a", "zz"), (9004, "a", "zz"), (9005, "stra glen " * 30000, "bb"), (9006, "²", None), (9007, "Ⅷ ǅ", None)]


@pytest.mark.parametrize("langs", [("aa", "bb"), ("aa", "bb", "cc", "dd"), tuple(STEMS)])
def test_predictions_by_brute_force(spark, langs):
    df = spark.createDataFrame(corpus(1, langs=langs) + awkward(), SCHEMA).repartition(3)
    model = L.train(df)
    assert model.langs == sorted({*langs, "aa", "bb", "cc", "zz"} - ({"cc"} if "cc" not in langs else set()))
    rows = df.select("doc_id", "text").collect()
    got = L.predict_language(df, model).collect()
    want = []
    for r in rows:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        lang, score = brute_score(model, r["text"]) if r["text"] and any(ch.isalpha() for ch in r["text"]) else ("und", 0.0)
        want.append((str(r["doc_id"]), held, lang, round(score, 4)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 4)) for r in got) == sorted(want)


def test_codewords():
    for n in (2, 3, 4, 5, 6, 8, 40):
        code = L.codewords(n)
        assert (np.abs(code.sum(axis=0)) < n).all() and code.shape[0] == n
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        # an exhaustive code splits every pair in half of all splits and one more
        assert min(apart) == 2 ** (n - 2) if n <= 5 else min(apart) >= 5
    assert (L.codewords(40) == L.codewords(40)).all() and L.codewords(1).shape == (1, 0)


def test_wrong_bits_are_mended_and_near_codewords_flagged():
    code = L.codewords(5)
    model = L.Coder(list("abcde"), code, np.eye(code.shape[1]), np.zeros(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    x = 2.0 * code[2]
    x[:3] *= -1
    best, score, unsure = model.decode(np.stack([x, 2.0 * code[2], code[1] + code[2]]), 0.1)
    assert best.tolist()[:2] == [2, 2] and unsure.tolist() == [False, False, True] and score[0] < score[1]
    # a bit that is never right for a language has no say there
    model.trust = np.where(np.arange(code.shape[1]) < 3, 1e-9, 1.0) * np.ones((5, 1))
    assert model.decode(x[None], 0.1)[0].tolist() == [2]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op12_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right >= 0.98 * n


def test_what_is_held_out_teaches_nothing(spark):
    rows = corpus(2, langs=("aa", "bb"))
    other = [(i, t, "bb" if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows]
    a, b = (L.train(spark.createDataFrame(r, SCHEMA)) for r in (rows, other))
    assert (a.weight == b.weight).all()
    only = [(i, t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert L.train(spark.createDataFrame(only, SCHEMA)) is None


def test_empty_tables_one_language_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.train(empty) is None and L.predict_language(empty, None).count() == 0
    some = spark.createDataFrame(awkward(), SCHEMA)
    assert {r["lang_pred"] for r in L.predict_language(some, None).collect()} == {"und"}
    one = spark.createDataFrame([(1, "ka", "aa"), (2, "1", "bb")], SCHEMA)
    assert sorted(map(tuple, L.predict_language(one, L.train(one)).select("doc_id", "lang_pred", "score").collect())) == [(1, "aa", 1.0), (2, "und", 0.0)]
    odd = spark.createDataFrame(corpus(3), SCHEMA).select(F.col("doc_id").alias("i.d"), F.col("text").alias("t.x"), F.col("lang").alias("l g"), F.lit("x").alias("k"), F.lit("x").alias("lang"), F.lit(1).alias("digest"), F.lit(1).alias("place"), F.lit(1).alias("known"))
    model = L.train(odd, id_col="i.d", text_col="t.x", lang_col="l g")
    assert len(model.langs) == 7 and L.predict_language(odd, model, id_col="i.d", text_col="t.x").count() == odd.count()


def test_the_sample_has_as_many_of_each_language(spark):
    rows = [(i, "ka lo", "aa") for i in range(300)] + [(1000 + i, "glen", "bb") for i in range(9)]
    model = L.train(spark.createDataFrame(rows, SCHEMA), max_docs=12, salts=4)
    assert model.langs == ["aa", "bb"]
    assert L.train(spark.createDataFrame(rows, SCHEMA), max_docs=1).langs == ["aa"]


def test_profiles_do_not_depend_on_neighbours():
    texts = ["Ka lo", "", "x", "1 2", "é" * 50, "ab\ncd"]
    (whole,) = L._parts(pa.array(texts).cast(pa.binary()))
    x = L.profiles(whole)
    for t, row in zip(texts, x, strict=True):
        (c,) = K.chunks(pa.array([t]).cast(pa.binary()))
        assert (L.profiles(c)[0] == row).all()
        assert {k: round(v, 9) for k, v in brute_profile(t).items()} == {int(k): round(row[k], 9) for k in np.flatnonzero(row)}
