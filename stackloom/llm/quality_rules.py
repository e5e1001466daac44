"""Line-first quality rules, built from DataFrame functions alone.

Every line is judged by itself first: symbol noise, navigation bars, shouting,
missing end punctuation, boilerplate.  Failing lines go; a document is then
rejected if too little of its text is left, or if it fails the base rules
(too few words, too many words inside repeated 3-word windows).  A plan of this
operator is one projection over the scan: nothing is shuffled, so no key can be
hot, and a lost executor repeats its own input splits only.

Repeated 3-word windows are found per document by sorting longs that hold a
window's hash above its position.  Where neighbours have equal hashes their words
are compared; a document in which equal hashes stand for different words (the
longer it is, the fewer bits are left for the hash) is counted again from the
windows themselves, so counts are exact at any length.

The verdict comes out of a generator with one row, which keeps filters on it above
the rules (pushed down, the whole chain of expressions would be copied into the
filter) while filters on other columns reach the scan.

Edge cases: null text counts as empty (0 words, rejected by the base rule, clean
text ''); a very long text is judged whole, as one row; repeated rows are judged
one by one, and ties play no part; extra columns pass through and may have any
name: working columns live in one struct, and it and the result take a name with
underscores behind it where that name is taken; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fixed phrases of site and licence boilerplate; a line fails where they take one of BOILERPLATE_SHARE characters.
BOILERPLATE = r"\b(" + "|".join(
    (
        "all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|subscribe to our|sign up for|click here to|enable javascript|skip to (main )?content",
        "alle rechte vorbehalten|lizenziert unter|nutzungsbedingungen|datenschutzerklärung|cookies akzeptieren|newsletter abonnieren|hier klicken|zum inhalt springen",
        "tous droits réservés|sous licence|conditions d.utilisation|politique de confidentialité|accepter (tous )?les cookies|abonnez-vous|cliquez ici|aller au contenu",
        "todos los derechos reservados|bajo la licencia|condiciones de uso|política de privacidad|aceptar (todas )?las cookies|suscríbete|haz clic aquí|saltar al contenido",
    )
) + ")"
BOILERPLATE_SHARE = 12
END_MARKS = [".", "!", "?", ":", ";", ",", "\"", "'", ")", "]", "}", "…", "。", "»", "”", "’"]


def _without(c: Column, chars: str) -> Column:
    return reduce(lambda x, ch: F.replace(x, F.lit(ch), F.lit("")), chars, c)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _line_fails(bare: Column, min_chars: int) -> Column:
    chars = F.length(bare)
    symbols = chars - F.length(_without(bare, SYMBOLS))
    pipes = chars - F.length(F.replace(bare, F.lit("|"), F.lit("")))
    noisy = (symbols >= 3) & (symbols * 20 > chars)
    navigation = (pipes >= 2) & (pipes * 25 > chars)
    shouting = (chars >= min_chars) & (F.upper(bare) == bare) & (F.lower(bare) != bare)
    # a line that cuts off after whole sentences is prose
    open_end = (chars >= min_chars) & ~F.right(bare, F.lit(1)).isin(END_MARKS) & ~bare.contains(". ") & ~bare.contains("! ") & ~bare.contains("? ")
    low = F.lower(bare)
    boilerplate = low.rlike(BOILERPLATE) & ((F.length(low) - F.length(F.regexp_replace(low, BOILERPLATE, ""))) * BOILERPLATE_SHARE >= F.length(low))
    return noisy | navigation | shouting | open_end | boilerplate


def quality_rules(
    docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_share: float = 0.5, min_kept_share: float = 0.6, min_line_chars: int = 20
) -> DataFrame:
    """docs with a struct column `quality`, the last one: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_lines_failed, kept, clean_text (failing lines removed)."""
    work, result = _free("__quality_rules", docs.columns), _free("quality", docs.columns)
    t = lambda name: F.col(f"{work}.{name}")
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    flat = reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit(" ")), SPACES, text)
    a = docs.select(*own, F.struct(text.alias("text"), F.array_remove(F.split(flat, " "), "").alias("w"), F.split(text, "\n", -1).alias("lines")).alias(work))
    n = F.size(t("w"))
    bits = F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1.0)).cast("int")
    shift = lambda x, by: F.call_function("shiftleft", x, by)
    window = lambda i: F.xxhash64(F.get(t("w"), i), F.get(t("w"), i + 1), F.get(t("w"), i + 2))
    keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: shift(window(i), bits).bitwiseOR(i.cast("long"))))
    keys = F.when(n >= 4, keys).otherwise(F.array().cast("array<long>"))
    # lines without white space at their ends are made once, and found by number
    bare = F.transform(t("lines"), lambda x: F.btrim(x, F.lit(" " + SPACES)))
    kept = F.get(F.transform(F.array(bare), lambda v: F.filter(t("lines"), lambda x, i: ~_line_fails(F.get(v, i), min_line_chars))), 0)
    b = a.select(*own, F.struct(*[t(x).alias(x) for x in ("text", "w", "lines")], bits.alias("bits"), keys.alias("keys"), kept.alias("kept")).alias(work))

    down = lambda x: F.call_function("shiftright", x, t("bits"))
    mask = shift(F.lit(1).cast("long"), t("bits")) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")
    same = lambda x, y: reduce(lambda p, q: p & q, [F.get(t("w"), place(x) + k) == F.get(t("w"), place(y) + k) for k in range(3)])
    near = lambda x, i, d: F.coalesce(down(F.get(t("keys"), i + d)) == down(x), F.lit(False))
    twins = F.filter(t("keys"), lambda x, i: near(x, i, -1) | near(x, i, 1))
    # equal hashes of different words
    mixed = lambda v: F.exists(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: F.coalesce((down(F.get(v, i)) == down(F.get(v, i - 1))) & ~same(F.get(v, i), F.get(v, i - 1)), F.lit(False)))
    n = F.size(t("w"))
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", *[F.get(t("w"), i + k) for k in range(3)]).alias("s"), i.cast("long").alias("at"))))
    twin = lambda v: lambda x, i: F.coalesce(F.get(v, i - 1)["s"] == x["s"], F.lit(False)) | F.coalesce(F.get(v, i + 1)["s"] == x["s"], F.lit(False))
    slow = F.sort_array(F.transform(F.filter(windows, twin(windows)), lambda x: x["at"]))
    # an array of one array binds the twins to a name, so they are found once
    fast = lambda v: F.sort_array(F.transform(v, lambda x: x.bitwiseAND(mask)))
    at = F.get(F.transform(F.array(twins), lambda v: F.when(F.size(v) == 0, F.array().cast("array<long>")).when(mixed(v), slow).otherwise(fast(v))), 0)
    solid = F.filter(t("lines"), lambda x: F.length(F.btrim(x, F.lit(" " + SPACES))) > 0)
    c = b.select(*own, F.struct(*[t(x).alias(x) for x in ("text", "w", "lines", "kept")], at.alias("at"), solid.alias("solid")).alias(work))

    covered = F.aggregate(
        t("at"),
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("total")),
        lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("total")),
        lambda acc: acc["total"],
    )
    clean = F.array_join(t("kept"), "\n")
    facts = {
        "n_words": F.size(t("w")).cast("long"),
        "word_chars": F.length(_without(t("text"), " " + SPACES)).cast("long"),
        "n_symbols": (F.length(t("text")) - F.length(_without(t("text"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size(t("solid")) - F.size(F.array_distinct(t("solid")))).cast("long"),
        "n_repeat_words": covered,
        "n_lines": F.size(t("lines")).cast("long"),
        "n_lines_failed": (F.size(t("lines")) - F.size(t("kept"))).cast("long"),
        "line_chars": F.length(F.replace(t("text"), F.lit("\n"), F.lit(""))).cast("long"),
        "kept_chars": F.length(F.replace(clean, F.lit("\n"), F.lit(""))).cast("long"),
        "clean_text": clean,
    }
    d = c.select(*own, F.struct(*[x.alias(k) for k, x in facts.items()]).alias(work))
    failed = (t("n_words") < min_words) | (t("n_repeat_words") * 100 > t("n_words") * F.lit(100 * max_repeat_share))
    good = ~failed & (t("kept_chars") * 100 >= t("line_chars") * F.lit(100 * min_kept_share))
    verdict = F.struct(*[t(k).alias(k) for k in facts], failed.alias("base_failed"), good.alias("kept"))
    return d.select(*own, F.explode(F.array(verdict)).alias(result))
