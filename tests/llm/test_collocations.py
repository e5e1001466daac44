import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import rows_equal_sql
from pyspark.sql import functions as F

from stackloom.llm.collocations import collocations, packed, phrase_counts, unpacked
from stackloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, least, top, longest=4):
    found = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    found[lang or "und"][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in found.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "γάμμα", "d", "new", "york", "city", "é", "\x00x", "日本"]
    rows = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            words += ["NEW", "York", "city"] * rng.randrange(4)
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\x0b", "\n"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    hot = "of the of the of the"
    rows += [(500 + i, hot, "en") for i in range(80)]
    rows += [(600, None, "en"), (601, "", "de"), (602, " \t\n", None), (603, "a b", None), rows[3], rows[3], (None, "new york", "en"), (604, "one two three four five six " * 3000, "fr")]
    return rows


@pytest.mark.parametrize(
    ("seed", "least", "top", "how"),
    [(1, 4, 2000, {}), (2, 3, 7, {"bytes_a_cell": 400, "run_bytes": 500, "held_cells": 50, "held_rows": 40, "bucket_bytes": 1000, "flags": 64}), (3, 2, 50, {"slice_cells": 7, "run_bytes": 3000}), (4, 30, 2000, {"bytes_a_cell": 10**9, "flags": 16})],
)
def test_collocations_by_brute_force(spark, seed, least, top, how):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = collocations(df, min_count=least, top=top, salts=3, **how)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, least, top)))


def test_three_words_at_most(spark):
    rows = corpus(9)
    got = collocations(spark.createDataFrame(rows, SCHEMA), min_count=3, max_words=3)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, 3, 2000, 3)))


def test_query_equals_sql(spark, sf_dir):
    rows_equal_sql(QUERIES["op13_phrase_collocations"](spark, sf_dir), ORACLE_SQL["op13_phrase_collocations"], sf_dir)


def test_scores_beyond_64_bits(spark):
    """2,000,000 * a and the sums of parts, as the operator computes them."""
    df = spark.createDataFrame([(9 * 10**17, 9 * 10**17, 9 * 10**17 + 1)], "a long, l long, r long")
    q = df.select(F.expr("cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))").alias("q"))
    assert q.first()["q"] == 2000000 * 9 * 10**17 // (18 * 10**17 + 1)


def test_empty_tables_and_clashing_columns(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, "en")], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "new york " * 40, "en", "x", 3, 4, 5)], "doc_id long, text string, lang string, phrase string, t long, grp long, `a.b` long")
    got = collocations(odd).collect()
    assert {r["phrase"] for r in got} and got[0]["n"] == 80
    named = odd.select(F.col("text").alias("te.xt"), F.col("lang").alias("la ng"))
    assert collocations(named, text_col="te.xt", lang_col="la ng").count() == len(got)


def test_cells_round_trip_and_only_frequent_phrases_shuffle(spark):
    import numpy as np

    x = np.array([0, 5, 2**39, 7, 255, 256])
    assert (unpacked(packed(x), len(x)) == x).all()
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(200)) + " . new york", "en") for i in range(40)]
    counts, _ = phrase_counts(spark.createDataFrame(rows, SCHEMA), 30)
    assert {r["phrase"]: r["f"] for r in counts.collect()} == {"new york": 40, "new": 40, "york": 40, "": 40 * 202}
