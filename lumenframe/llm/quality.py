"""Operator 5: quality by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, materialize, row_key, table

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: name: the kind of fault, value, bad vote, good vote. A rule abstains between its two votes.
RULES: dict[str, tuple[str, str, str, str]] = {
    "length": ("short", "n_words", "v < 50", "v >= 200"),
    "symbols": ("symbols", "n_symbols / n_words", "v > 0.1", "v < 0.01"),
    "repeats": ("repetition", "n_repeat_words / n_words", "v > 0.5", "v < 0.1"),
    "dup_lines": ("repetition", "n_dup_lines / n_lines", "v > 0.5", "v < 0.1"),
    "variety": ("repetition", "n_distinct / n_words", "v < 0.2", "v > 0.4"),
    "capitals": ("capitals", "n_capitals / n_letters", "v > 0.4", "v < 0.1"),
    "shouting": ("capitals", "n_shouts / n_words", "v > 0.05", "v < 0.005"),
    "word_length": ("form", "word_chars / n_words", "v < 2 or v > 12", "v between 4 and 8"),
}


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three words that occur twice or more, overlaps counted once.

    Windows are compared by 64-bit hashes. Few repeated hashes are looked up one by one; for many, windows are
    sorted by hash. Either way the positions of repeated windows then give the covered words.
    """
    hashes = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def by_sort(h):
        rows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        hit = lambda s: F.filter(s, lambda e, k: same(e, F.get(s, k + 1)) | ((k > 0) & same(e, F.get(s, k - 1))))
        return F.sort_array(F.transform(_let(rows, hit), lambda e: e["i"]))

    def by_lookup(h, many):
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(many, x), i)), lambda i: i.isNotNull())

    def places(h):
        many = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(x == F.get(s, k + 1), F.lit(False)))))
        return _let(many, lambda m: F.when(F.size(m) <= 16, by_lookup(h, m)).otherwise(by_sort(h)))

    def covered(p):
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    any_twice = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(places(h), covered)).otherwise(F.lit(0).cast("bigint"))
    return F.when(F.size(words) > 3, _let(hashes, any_twice)).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key and the counts that the rules use, over whole texts; a null text counts as empty.

    Words are the runs of bytes other than space and \\t \\n \\v \\f \\r. n_dup_lines: lines with a word that equal
    an earlier one. n_shouts: words that end in two exclamation marks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.filter(F.split(text, WORD_BREAK), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.char_length(F.regexp_replace("text", pattern, ""))
    long = lambda c: c.cast("bigint")
    return cut.select(
        "doc_id",
        row_key("doc_id", "text").alias("row_key"),
        long(F.size("words")).alias("n_words"),
        long(F.char_length(F.array_join("words", ""))).alias("word_chars"),
        long(F.char_length("text") - without(r"[#*$%&|<>]+")).alias("n_symbols"),
        long(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        long(_let(F.col("words"), _repeat_words)).alias("n_repeat_words"),
        long(F.size(lines)).alias("n_lines"),
        long(F.char_length("text") - without(r"\p{Lu}+")).alias("n_capitals"),
        long(F.char_length("text") - without(r"\p{L}+")).alias("n_letters"),
        long(F.size(F.filter("words", lambda w: w.endswith("!!")))).alias("n_shouts"),
        long(F.size(F.array_distinct("words"))).alias("n_distinct"),
    )


def votes(found: DataFrame, rules: dict[str, tuple[str, str, str, str]] = RULES) -> DataFrame:
    """found with a column vote_<rule> for each rule: -1 bad, 1 good, 0 abstains (also where the value is undefined)."""
    for name, (_, value, bad, good) in rules.items():
        top, _, bottom = value.partition(" / ")
        v = F.try_divide(F.col(top), F.col(bottom)) if bottom else F.col(top)
        found = found.withColumn("v", v.cast("double"))
        found = found.withColumn(f"vote_{name}", F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("tinyint"))
    return found.drop("v")


def estimate(patterns: dict[tuple[int, ...], int], kinds: list[str], *, prior: float = 0.85, weight: float = 0.02, false_objections: float = 0.005, rounds: int = 500) -> tuple[list[str], list[float], list[list[float]]]:
    """Expectation-maximisation over vote patterns and their numbers: classes, their shares, and P(objects) by class and rule.

    A document is good or has one kind of fault (kinds: that of each rule). Given its class rules vote independently,
    each at its own rate of objecting among the votes it casts, which is one minus its accuracy on good documents and
    its accuracy on the kind it is about; abstentions say nothing. Without the kinds, rules that each find another
    fault would look wrong to each other; and where one rule alone sees a fault, no agreement tells its accuracy, so
    false_objections bounds how often any rule objects to good documents. weight: strength of priors that favour the
    truth, as a share of all documents.
    """
    classes = ["good", *dict.fromkeys(kinds)]
    total = sum(patterns.values())
    expected = [[0.9 if c == k else false_objections for k in kinds] for c in classes]
    shares = [prior] + [(1 - prior) / (len(classes) - 1)] * (len(classes) - 1)
    start, rates, strength = shares, expected, max(1.0, weight * total)
    for _ in range(rounds if total else 0):
        members = {p: posterior(p, shares, rates) for p in patterns}
        mass = [sum(members[p][c] * n for p, n in patterns.items()) for c in range(len(classes))]
        new = []
        for c in range(len(classes)):
            row = []
            for r in range(len(kinds)):
                cast = sum(members[p][c] * n for p, n in patterns.items() if p[r])
                against = sum(members[p][c] * n for p, n in patterns.items() if p[r] == -1)
                rate = (against + strength * expected[c][r]) / (cast + strength)
                row.append(min(rate, false_objections) if classes[c] == "good" else rate)
            new.append(row)
        change = max(abs(x - y) for a, b in zip(rates, new) for x, y in zip(a, b))
        rates, shares = new, [(m + strength * s) / (total + strength) for m, s in zip(mass, start)]
        if change < 1e-9:
            break
    return classes, shares, rates


def observed_rates(patterns: dict[tuple[int, ...], int], shares: list[float], rates: list[list[float]]) -> list[list[float]]:
    """P(objects) by class and rule as the votes alone have it under the estimate: without priors and bounds, nan where none vote.

    A good-class rate well above false_objections says that the bound decides about this rule, and not the data.
    """
    members = {p: posterior(p, shares, rates) for p in patterns}
    out = []
    for c in range(len(shares)):
        cast = [sum(members[p][c] * n for p, n in patterns.items() if p[r]) for r in range(len(rates[0]))]
        against = [sum(members[p][c] * n for p, n in patterns.items() if p[r] < 0) for r in range(len(rates[0]))]
        out.append([a / n if n else math.nan for a, n in zip(against, cast)])
    return out


def posterior(pattern: tuple[int, ...], shares: list[float], rates: list[list[float]]) -> list[float]:
    """Probability of each class given the votes."""
    logs = [math.log(s) + sum(math.log(q if v < 0 else 1 - q) for v, q in zip(pattern, row) if v) for s, row in zip(shares, rates)]
    top = max(logs)
    parts = [math.exp(x - top) for x in logs]
    return [x / sum(parts) for x in parts]


def score(found: DataFrame, rules: dict[str, tuple[str, str, str, str]] = RULES) -> DataFrame:
    """votes with quality, the posterior probability of a good document.

    The only thing that leaves the executors is the number of documents of each vote pattern, 3 ** rules at most.
    """
    names = [f"vote_{r}" for r in rules]
    voted = votes(found, rules)
    patterns = {tuple(r[n] for n in names): r["n"] for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    _, shares, rates = estimate(patterns, [kind for kind, *_ in rules.values()])
    likely = []
    for share, row in zip(shares, rates):
        logs = F.lit(math.log(share))
        for name, q in zip(names, row):
            logs = logs + F.when(F.col(name) == -1, F.lit(math.log(q))).when(F.col(name) == 1, F.lit(math.log(1 - q))).otherwise(F.lit(0.0))
        likely.append(logs)
    voted = voted.withColumn("logs", F.array(*likely))
    return voted.withColumn("quality", 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("logs")[0]))).drop("logs")


def judge(docs: DataFrame, *, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, the measures, the votes, quality, base_failed and kept for every document.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows of three. kept: not
    base_failed, and quality of at least least. Null, empty and blank texts have no words and fail; rows of one
    id are judged one by one; an empty table gives no rows.
    """
    found = score(materialize(measures(docs, id_col=id_col, text_col=text_col), "measures"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality verdict on every document."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept", "quality")
