"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` names a ratio and its bounds; ``compiled`` turns the table into the
columns of one select. Ratios: length (words, mean word length), symbols per
word, stop words, repeated words in 3-word windows, and line ratios (repeated,
bulleted, cut off with an ellipsis). No user functions, no shuffle.

A null text has no words and fails the base rule. Empty texts likewise. Ratios
over nothing are 0. Repeated rows are judged alike, and an empty table gives an
empty one. Texts are judged whole; a very long one takes some hundred bytes of
memory for each of its words. Nothing is ordered, so there are no ties. ``judged``
replaces columns of the input with the names in ``ADDED`` and passes on all
others, whatever their names; ``kept`` passes on all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import unused

SEPARATORS = r"[\x20\x09-\x0D]+"
LETTERS = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it on for was with as be by this are at from or an not have had but "
    "der die das und ist nicht ein eine mit von zu den dem auf für im des sich auch "
    "le la les de des et un une que qui est en pour dans par sur au pas "
    "el los las y del se por con una su para es lo como"
).split()

#: (ratio, least, most); a text outside any bound is rejected.
RULES = [
    ("n_words", 50, None),
    ("mean_word_chars", 1.5, 25.0),
    ("symbol_ratio", None, 0.1),
    ("stop_ratio", 0.005, None),
    ("repeat_ratio", None, 0.5),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.95),
    ("ellipsis_line_ratio", None, 0.5),
]
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(name for name, _, _ in RULES[1:]))
BIG = 1 << 30


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with the counts that the ratios are made of, and how the names of these begin.

    Arrays that are read more than once stand in columns of their own; lambdas
    read nothing from outside, so none is made again for each element.
    """
    own, x = docs.columns, unused(docs.columns)
    words, lines, g, e, p = (f"{x}_{k}" for k in ("words", "lines", "g", "e", "p"))
    df = docs.withColumn(f"{x}_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(words, F.array_remove(F.split(f"{x}_t", SEPARATORS), ""))
    df = df.withColumn(lines, F.filter(F.split(f"{x}_t", "\n"), lambda y: y.rlike(LETTERS)))
    pairs = F.zip_with(words, F.slice(words, 2, BIG), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.zip_with(pairs, F.slice(words, 3, BIG), lambda a, b: F.concat(a, F.lit(" "), b))
    placed = F.transform(grams, lambda v, i: F.struct(v.alias("g"), i.alias("i")))
    df = df.withColumn(g, F.sort_array(F.slice(placed, 1, F.greatest(F.size(words) - 2, F.lit(0)))))
    # same as the next one in order; shifted by one, the same as the one before
    df = df.withColumn(e, F.zip_with(g, F.slice(g, 2, BIG), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))))
    twice = F.zip_with(e, F.concat(F.array(F.lit(False)), F.col(e)), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    marked = F.zip_with(g, twice, lambda v, d: F.when(d, v["i"]))
    df = df.withColumn(p, F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    spans = F.zip_with(p, F.slice(p, 2, BIG), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(f"{x}_t") - F.length(F.regexp_replace(f"{x}_t", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.aggregate(spans, F.lit(0).cast("long"), lambda s, y: s + y),
        "n_lines": F.size(lines),
        "stops": F.size(F.filter(words, lambda w: F.lower(w).isin(list(dict.fromkeys(STOP_WORDS))))),
        "bullets": F.size(F.filter(lines, lambda y: y.rlike(r"^[\x20\x09]*[-*•]"))),
        "cut": F.size(F.filter(lines, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))),
    }
    return df.select(*own, *[c.alias(f"{x}_{k}") for k, c in counts.items()]), x


def ratios(x: str) -> dict[str, Column]:
    of = lambda a, b: _ratio(F.col(f"{x}_{a}"), F.col(f"{x}_{b}"))
    return {
        "mean_word_chars": of("word_chars", "n_words"),
        "symbol_ratio": of("n_symbols", "n_words"),
        "stop_ratio": of("stops", "n_words"),
        "repeat_ratio": of("n_repeat_words", "n_words"),
        "dup_line_ratio": of("n_dup_lines", "n_lines"),
        "bullet_line_ratio": of("bullets", "n_lines"),
        "ellipsis_line_ratio": of("cut", "n_lines"),
    }


def base_failed(x: str) -> Column:
    return (F.col(f"{x}_n_words") < 50) | (100 * F.col(f"{x}_n_repeat_words") > 50 * F.col(f"{x}_n_words"))


def compiled(x: str, rules: list[tuple] = RULES) -> Column:
    """The table as one boolean column: true where every ratio is inside its bounds, the base rule included."""
    known = ratios(x) | {"n_words": F.col(f"{x}_n_words")}
    ok = ~base_failed(x)
    for name, least, most in rules:
        if least is not None:
            ok = ok & (known[name] >= least)
        if most is not None:
            ok = ok & (known[name] <= most)
    return ok


def judged(docs: DataFrame, rules: list[tuple] = RULES, text: str = "text") -> DataFrame:
    """The documents with counts, ratios, base_failed and kept."""
    df, x = measured(docs, text)
    own = [c for c in docs.columns if c.lower() not in ADDED]
    counts = [F.col(f"{x}_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return df.select(*own, *counts, *[c.alias(k) for k, c in ratios(x).items()], base_failed(x).alias("base_failed"), compiled(x, rules).alias("kept"))


def kept(docs: DataFrame, rules: list[tuple] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    df, x = measured(docs, text)
    # a generated column: a filter on it stays where it is, while one on the expression would be written into every use of it
    told = df.select(*docs.columns, F.explode(F.array(compiled(x, rules))).alias(f"{x}_kept"))
    return told.where(f"{x}_kept").select(*docs.columns)
