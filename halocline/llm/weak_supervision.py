"""Quality rules as weak supervision; DataFrame and SQL functions only.

Each rule votes good (1), bad (-1) or abstains (0). The counts of the vote patterns of all documents (at most 3 to the
number of rules, whatever the input) are all that expectation-maximisation needs: it estimates the share of good
documents and, for each rule and class, how often the rule votes which way. A document is kept if its posterior of being
good reaches `least`, so one failed rule of little accuracy doesn't reject it, unless the base rules fail.

Cases: null and empty texts have no words, so the base rules fail; equal texts get equal results; an empty table gives no
rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
LEAST = 0.5
ROUNDS = 60
#: Prior of a rule's votes (bad, abstain, good) in good and in bad documents, and its weight as a share of the documents.
#: No rule is taken to fail more than FALSE_ALARMS of the good documents.
FALSE_ALARMS = 0.001
PRIOR_GOOD, PRIOR_BAD, PRIOR_WEIGHT = (0.002, 0.499, 0.499), (0.3, 0.35, 0.35), 0.1

#: Rule: (measure x, bad if, good if); in between it abstains. Rules that only find faults never vote good.
RULES = {
    "few_words": ("n_words", "x < 5", "x >= 40"),
    "symbols": ("n_symbols / greatest(n_words, 1)", "x > 0.2", "FALSE"),
    "shouting": ("n_marks / greatest(n_words, 1)", "x > 0.5", "FALSE"),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", "x > 0.5", "FALSE"),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", "x > 0.3", "FALSE"),
    "word_length": ("word_chars / greatest(n_words, 1)", "x NOT BETWEEN 2 AND 20", "x BETWEEN 3 AND 14"),
    "punctuated": ("if(n_stops = 0 AND n_words < 40, 0.01, n_stops / greatest(n_words, 1))", "x = 0 OR x > 1.2", "x BETWEEN 0.02 AND 0.5"),
}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r").replace("\x0b", "\\u000b").replace("\x0c", "\\u000c") + "'"


#: Words of column t; every array that is used twice is bound to a lambda variable, so that it is made once.
WORDS = f"filter(split(translate(t, {_sql(SPACES[:-1])}, '     '), ' '), x -> x <> '')"
#: Hashes of the 8-word windows of the word array w.
WINDOWS = "transform(array(transform(w, x -> xxhash64(x))), v -> if(size(v) < 8, array(), transform(sequence(1, size(v) - 7), i -> xxhash64(slice(v, i, 8)))))[0]"
#: Of the window hashes h: the start of every window that the text has twice, in order.
TWICE = "array_sort(transform(transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s -> filter(s, (e, j) -> get(s, j - 1).x <=> e.x OR get(s, j + 1).x <=> e.x))[0], e -> e.i))"
COVERED = f"aggregate({TWICE}, struct(0L AS n, 0L AS upto), (a, p) -> struct(a.n + 8L - greatest(0L, a.upto - p) AS n, p + 8L AS upto), a -> a.n)"


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_marks, n_stops, n_lines, n_dup_lines, n_repeat_words) of whole texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    less = lambda chars: f"length(t) - length(translate(t, {_sql(chars)}, ''))"
    lines = f"transform(array(filter(split(t, '\\n'), x -> btrim(x, {_sql(SPACES)}) <> '')), l -> struct(size(l) AS n, size(l) - size(array_distinct(l)) AS dup))[0]"
    words = f"transform(array({WORDS}), w -> struct(size(w) AS n, transform(array({WINDOWS}), h -> if(size(array_distinct(h)) = size(h), 0L, {COVERED}))[0] AS rep))[0]"
    made = rows.select("doc_id", F.expr(f"length(translate(t, {_sql(SPACES)}, ''))").alias("word_chars"), F.expr(less(SYMBOLS)).alias("n_symbols"), F.expr(less("!")).alias("n_marks"), F.expr(less(".,")).alias("n_stops"), F.expr(lines).alias("l"), F.expr(words).alias("w"))
    columns = {"n_words": "w.n", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_marks": "n_marks", "n_stops": "n_stops", "n_lines": "l.n", "n_dup_lines": "l.dup", "n_repeat_words": "w.rep"}
    return made.select("doc_id", *[F.col(c).cast("long").alias(n) for n, c in columns.items()])


def votes(rows: DataFrame) -> list[Column]:
    """A column of 1, 0 or -1 for each rule."""
    say = lambda test, x: re.sub(r"\bx\b", f"({x})", test)
    return [F.expr(f"CASE WHEN {say(bad, x)} THEN -1 WHEN {say(good, x)} THEN 1 ELSE 0 END").cast("int").alias(name) for name, (x, bad, good) in RULES.items()]


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of good documents, for each rule: vote -> (probability if good, probability if bad)).

    It starts from one class for the patterns without a bad vote and one for the others; the prior keeps a small
    kind of bad documents, which one rule alone finds, from joining the good ones."""
    if not patterns:
        return 0.5, []
    k = len(patterns[0][0])
    post = [0.1 if -1 in v else 0.9 for v, _ in patterns]
    total = sum(n for _, n in patterns)
    weight = PRIOR_WEIGHT * total
    share, tables = 0.5, []
    for _ in range(rounds):
        good = sum(p * n for p, (_, n) in zip(post, patterns, strict=True))
        share = (good + 0.5) / (total + 1)
        tables = []
        for r in range(k):
            seen = {v: [a * weight, b * weight] for v, a, b in zip((-1, 0, 1), PRIOR_GOOD, PRIOR_BAD, strict=True)}
            for p, (v, n) in zip(post, patterns, strict=True):
                seen[v[r]][0] += p * n
                seen[v[r]][1] += (1 - p) * n
            alarms = (good + weight) * FALSE_ALARMS
            seen[-1][0] = min(seen[-1][0], alarms)
            tables.append({v: (a / (good + weight), b / (total - good + weight)) for v, (a, b) in seen.items()})
        odds = [math.log(share / (1 - share)) + sum(math.log(tables[r][v[r]][0] / tables[r][v[r]][1]) for r in range(k)) for v, _ in patterns]
        post = [1 / (1 + math.exp(-max(-500.0, min(500.0, o)))) for o in odds]
    return share, tables


def judge(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """A row for each row of docs (doc_id, text): the measures, the votes, quality (posterior), base_failed, kept."""
    rows = staged(measures(docs), "measures")  # a few numbers a document: texts are read once
    rows = rows.select("*", *votes(rows))
    names = list(RULES)
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in rows.groupBy(*names).count().collect()]  # at most 3 ** len(RULES) rows
    share, tables = expectation_maximisation(sorted(patterns))
    odds = F.lit(math.log(share / (1 - share)))
    for name, of in zip(names, tables, strict=False):
        vote = F.lit(0.0)
        for v, (a, b) in of.items():
            vote = F.when(F.col(name) == v, math.log(a / b)).otherwise(vote)
        odds = odds + vote
    rows = rows.withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
