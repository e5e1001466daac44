"""Small inputs of every awkward kind."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def awkward(seed=0):
    """(id, text, source): nulls, empties, a very long text, copies, near copies, repeated rows, shared lines."""
    rng = random.Random(seed)
    rows, line = [], "this line stands in very many documents."
    for k in range(40):
        t = " ".join(words(rng, rng.choice([1, 3, 4, 5, 30, 60, 200])))
        rows.append((k, t + ("\n" + line if k % 3 == 0 else ""), f"s{k % 4}"))
    base = words(rng, 120)
    for k in range(40, 52):
        near = list(base)
        near[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(near), "s0"))
    rows += [(52, rows[6][1], "s1"), (53, rows[6][1], "s1"), rows[7], rows[7]]
    rows += [(54, None, None), (55, "", "s1"), (56, " \n\t", ""), (57, "één\r\ntwéé\x0bdrié", None), (None, "a b c d e f", "s2"), (None, None, None)]
    rows.append((58, "\n".join(" ".join(words(rng, 50)) + "." for _ in range(400)), "s3"))
    return rows
