"""Quality rules with weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of the vote
patterns estimates how often each rule is right about good and about bad documents; the verdict
is the posterior probability that a document is good, in place of a must-pass-all filter.

Documents are scanned once: their measures (a few numbers a document) are written to the shared
folder, the vote patterns (a bounded number, whatever the input) are counted from them, and each
EM step is one small aggregate over the pattern table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import written

WHITE = " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_exclaim", "n_stops"]

#: The rules: name, condition of a bad vote, condition of a good vote; neither: it abstains.
RULES = [
    ("length", "n_words < 15", "n_words >= 40"),
    ("word_length", "word_chars < 2.2 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    ("symbols", "n_symbols > 0.15 * n_words", "n_symbols <= 0.02 * n_words"),
    ("symbol_rate", "n_symbols > 0.3 * n_words", "n_symbols <= 0.05 * n_words"),
    ("symbol_share", "n_symbols > 0.05 * word_chars", "n_symbols <= 0.01 * word_chars"),
    ("duplicate_lines", "n_dup_lines > 0.25 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    ("repeats", "n_repeat_words > 0.1 * n_words", "n_repeat_words <= 0.04 * n_words"),
    ("variety", "n_distinct_words < 0.15 * n_words", "n_distinct_words > 0.3 * n_words"),
    ("capitals", "n_upper > 0.25 * word_chars", "n_upper <= 0.08 * word_chars"),
    ("exclamation", "n_exclaim > 0.1 * n_words", "n_exclaim <= 0.02 * n_words"),
    ("sentences", "n_stops < 0.01 * n_words AND n_words >= 30", "n_stops BETWEEN 0.03 * n_words AND 0.5 * n_words"),
]
STEPS = 25


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def kept_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in the regex class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def repeated_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more (windows compared by 64-bit hash)."""

    def covered(found: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(0), F.size(found) - 1),
            lambda j: ((j > 0) & (F.get(found, j - 1)["h"] == F.get(found, j)["h"])) | ((j < F.size(found) - 1) & (F.get(found, j + 1)["h"] == F.get(found, j)["h"])),
        )
        places = F.sort_array(F.transform(at, lambda j: F.get(found, j)["i"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda s: s["n"])

    def count(hashes: Column) -> Column:
        found = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(found, covered))

    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 5)))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(windows, count))


def measured(text: Column) -> Column:
    """A struct of MEASURES for a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    of_marks = let(
        F.regexp_replace(text, r"[^#*$%&|<>!.?A-Z]+", ""),
        lambda x: F.struct(
            kept_chars(x, r"#*$%&|<>").cast("long").alias("n_symbols"),
            kept_chars(x, "A-Z").cast("long").alias("n_upper"),
            kept_chars(x, "!").cast("long").alias("n_exclaim"),
            kept_chars(x, ".?").cast("long").alias("n_stops"),
        ),
    )
    return F.struct(of_words.alias("w"), of_lines.alias("l"), of_marks.alias("m"))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns MEASURES (long), base_failed and one vote column a rule
    (``vote_<rule>``: 1 good, 0 bad, null abstains). Columns of these names are replaced."""
    own = [*MEASURES, "base_failed", *(f"vote_{name}" for name, _, _ in RULES)]
    df = df.drop(*[c for c in df.columns if c in own and c != text]).withColumn("_m", measured(F.col(text)))
    where = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_distinct_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    df = df.withColumns({m: F.col(f"_m.{where.get(m, 'm')}.{m}") for m in MEASURES}).drop("_m")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    votes = {f"vote_{name}": F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END") for name, bad, good in RULES}
    return df.withColumns({"base_failed": failed, **votes})


BAD, GOOD, ABSTAINS = 0, 1, 2


def probability(weights: list[float]) -> Column:
    """Posterior probability that a document is good, from its vote columns. weights: for each rule
    the log ratio of its bad, good and abstaining votes, then the log odds of the prior."""
    table = F.lit([float(w) for w in weights])
    outcome = lambda name: F.coalesce(F.col(f"vote_{name}"), F.lit(ABSTAINS))
    each = [F.get(table, outcome(name) + 3 * j) for j, (name, _, _) in enumerate(RULES)]
    return 1 / (1 + F.exp(-reduce(lambda x, y: x + y, each, F.get(table, F.lit(3 * len(RULES))))))


def weights_of(fit: dict) -> list[float]:
    """The log ratios of a fit. A vote never speaks for the side that it is against: a bad vote
    counts 0 at most, a good one 0 at least; abstaining speaks for neither."""
    out = []
    for j in range(len(RULES)):
        good, bad = fit["good"][j], fit["bad"][j]
        out += [min(0.0, math.log(good[BAD] / bad[BAD])), max(0.0, math.log(good[GOOD] / bad[GOOD])), 0.0]
    return [*out, math.log(fit["prior"] / (1 - fit["prior"]))]


def fit_votes(voted: DataFrame, steps: int = STEPS) -> dict:
    """The prior share of good documents and each rule's shares of bad, good and abstaining votes
    on good and on bad documents, by expectation-maximisation.

    Each step is one of expectation-maximisation with bounds: the prior stays within 0.5 to 0.98, no
    share falls below 0.002, and in the posterior a vote never speaks against its side nor an
    abstention for one (``weights_of``). So the classes can't swap and a rule that hardly speaks can't
    decide; a corpus with less than half good documents is fitted with a prior of a half.

    Of these shares accuracies follow: a rule is right about good documents in ``good[j][GOOD]`` of
    the cases in which it speaks, and about bad ones likewise. Base-failed documents count like
    others. Without documents the start values stay.
    """
    names = [name for name, _, _ in RULES]
    fit = {"prior": 0.85, "good": [[0.02, 0.78, 0.20]] * len(names), "bad": [[0.30, 0.60, 0.10]] * len(names)}
    counted = voted.groupBy(*(f"vote_{n}" for n in names)).agg(F.count("*").alias("n"))
    patterns = written(counted.coalesce(1), "vote-patterns")
    for _ in range(steps):
        p = patterns.withColumn("good", probability(weights_of(fit)) * F.col("n"))
        sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
        for j, name in enumerate(names):
            for k in (BAD, GOOD):
                hit = F.col(f"vote_{name}") == k
                sums += [F.sum(F.when(hit, F.col("n"))).alias(f"n_{j}_{k}"), F.sum(F.when(hit, F.col("good"))).alias(f"g_{j}_{k}")]
        row = p.agg(*sums).first()
        if not row["n"]:
            break
        good, bad = row["good"], row["n"] - row["good"]
        new = {"prior": min(0.98, max(0.5, good / row["n"])), "good": [], "bad": []}
        for j in range(len(names)):
            g = [row[f"g_{j}_{k}"] or 0.0 for k in (BAD, GOOD)]
            n = [row[f"n_{j}_{k}"] or 0 for k in (BAD, GOOD)]
            b = [max(0.0, n[k] - g[k]) for k in (BAD, GOOD)]
            share = lambda x, total, start: (x + start) / (total + 1)  # noqa: E731  one vote as a prior
            for side, x, total, start in (("good", g, good, fit["good"][j]), ("bad", b, bad, fit["bad"][j])):
                two = [min(0.98, max(0.002, share(x[k], total, start[k]))) for k in (BAD, GOOD)]
                new[side].append([*two, max(0.002, 1 - sum(two))])
        moved = max([abs(new["prior"] - fit["prior"]), *(abs(x - y) for side in ("good", "bad") for u, v in zip(new[side], fit[side]) for x, y in zip(u, v))])
        fit = new
        if moved < 1e-3:
            break
    return fit


def judge(df: DataFrame, text: str = "text", keep_from: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """``df`` (or its ``columns``) with MEASURES, base_failed, the votes, quality_probability and kept.

    A document is kept if it is not base_failed and its posterior probability of being good is
    ``keep_from`` or more. Null texts count as empty: no words, base_failed, not kept. Very long
    texts are measured whole. Repeated rows get equal results; an empty table stays empty; columns with clashing names are replaced.
    """
    voted = measures(df, text)
    if columns is not None:
        voted = voted.select(*columns, *(c for c in voted.columns if c not in df.columns))
    rows = written(voted, "quality-measures")
    fit = fit_votes(rows)
    rows = rows.withColumn("quality_probability", probability(weights_of(fit)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= keep_from))
