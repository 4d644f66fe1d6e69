"""Quality rules as a learned decision list, with DataFrame functions only (operator 5).

Statistics of a text are Spark expressions over its words and lines. Sequential covering learns
rules from labelled documents: a rule grows by the threshold test of largest gain on two thirds of
the rows, is pruned on the last third, and the rows it covers are taken away before the next. The
list is emitted as one ordered CASE expression. The learner sees a sample of at most SAMPLE labelled
rows, the first by a hash of doc_id; nothing else is sampled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

SAMPLE = 20_000
LEXICON = 64  # words at most that tell toxic texts
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "symbols_per_word", "upper_share", "marks_per_word", "repeat_share", "dup_lines", "chars_per_word", "distinct_share", "digit_share", "lexicon_words")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count(text: Column, chars: str) -> Column:
    """Code points of text that are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def base(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, words and the base columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, each row for itself.

    n_repeat_words: words inside three-word windows that the text has twice or more, compared by
    64-bit hashes; window positions are sorted by hash once, so a text costs n log n.
    """
    d = docs.select(*more, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(BLANKS))
    d = d.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1)))
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, BLANKS, "") != ""))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("windows", F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), none).otherwise(F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = lambda x, j: (F.coalesce(F.get("sorted", j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get("sorted", j + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("at", F.array_sort(F.filter("sorted", again)["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate("at", start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")), lambda a: a["sum"])
    return d.select(
        *more, "doc_id", "text", "words", "n_words",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"), _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def plain_words(text: Column) -> Column:
    return F.split(F.lower(text), "[^\\p{L}]+", -1)


def statistics(lexicon: list[str]) -> dict[str, Column]:
    """The learner's statistics over base()'s columns."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    found = F.size(F.array_intersect(plain_words(F.col("text")), F.array(*map(F.lit, lexicon)))) if lexicon else F.lit(0)
    values = (F.col("n_words"), F.col("n_symbols") / words, _count(F.col("text"), _UPPER) / chars, _count(F.col("text"), "!") / words, F.col("n_repeat_words") / words, F.col("n_dup_lines"), F.col("word_chars") / words, F.size(F.array_distinct("words")) / words, _count(F.col("text"), "0123456789") / chars, found)
    return {name: v.cast("double") for name, v in zip(STATS, values)}


@dataclass(frozen=True)
class Test:
    stat: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.stat) > self.threshold if self.above else F.col(self.stat) <= self.threshold

    def holds(self, row: dict) -> bool:
        return (row[self.stat] > self.threshold) == self.above


@dataclass(frozen=True)
class Rule:
    """All tests hold: the document is bad."""

    tests: tuple[Test, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out

    def holds(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.tests)


def _thresholds(rows: list[dict], stat: str, most: int = 64) -> list[float]:
    """Midpoints of neighbouring values, at most so many, evenly by rank; for few distinct values all of them."""
    v = sorted(r[stat] for r in rows)
    distinct = sorted(set(v))
    if len(distinct) > most:
        distinct = sorted({v[i * (len(v) - 1) // most] for i in range(most + 1)})
    return [(a + b) / 2 for a, b in zip(distinct, distinct[1:])]


def _grow(rows: list[dict], longest: int) -> list[Test]:
    tests: list[Test] = []
    while len(tests) < longest:
        p0, n0 = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for stat in STATS:
            cuts = _thresholds(rows, stat)
            order, i, p, n = sorted(rows, key=lambda r: r[stat]), 0, 0, 0
            for cut in cuts:
                while i < len(order) and order[i][stat] <= cut:
                    p, n, i = p + order[i]["bad"], n + (not order[i]["bad"]), i + 1
                for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                    if q:
                        g = q * (math.log2(q / (q + m)) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Test(stat, above, cut), g
        if best is None:
            break
        tests.append(best)
        rows = [r for r in rows if best.holds(r)]
    return tests


def _prune(tests: list[Test], rows: list[dict]) -> list[Test]:
    """The prefix of the tests with the best (p - n) / (p + n) on rows held back."""
    best, worth = tests, -2.0
    for k in range(len(tests), 0, -1):
        some = [r for r in rows if Rule(tuple(tests[:k])).holds(r)]
        p = sum(r["bad"] for r in some)
        w = (2 * p - len(some)) / len(some) if some else -1.0
        if w >= worth:
            best, worth = tests[:k], w
    return best


def cover(rows: list[dict], precision: float = 0.9, longest: int = 4, most: int = 24) -> list[Rule]:
    """Ordered rules for bad rows. A rule stays only if it holds `precision` on all rows left, and covers five or more."""
    rules, rest = [], sorted(rows, key=lambda r: r["order"])
    while len(rules) < most:
        grown = [r for i, r in enumerate(rest) if i % 3]
        tests = _grow(grown, longest)
        if not tests:
            break
        rule = None
        for some in (_prune(tests, rest[::3]), tests):
            hit = [r for r in rest if all(t.holds(r) for t in some)]
            if len(hit) >= 5 and sum(r["bad"] for r in hit) >= precision * len(hit):
                rule = Rule(tuple(some))
                break
        if rule is None:
            break
        rules.append(rule)
        rest = [r for r in rest if not rule.holds(r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds decides, and good is what none covers."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row a doc_id: toxic, and bad (low quality or toxic); the first `most` by hash of doc_id."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.select("doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"), F.xxhash64("doc_id").alias("order")).orderBy("order").limit(most)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[Rule]]:
    """(lexicon, rules) from labelled documents. The lexicon: words of a twentieth of the toxic texts or more, nine in ten of whose texts are toxic."""
    sample = F.broadcast(labelled_sample(labels, most))  # at most `most` rows of four small columns
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    words = texts.select("toxic", F.explode(F.array_distinct(plain_words(F.col("text")))).alias("word")).where("word <> ''")
    toxic = texts.where("toxic").count()
    counted = words.groupBy("word").agg(F.count_if("toxic").alias("p"), F.count("*").alias("n"))
    chosen = counted.where((F.col("p") >= max(5, toxic / 20)) & (F.col("p") >= 0.9 * F.col("n"))).orderBy(F.desc("p"), "word").limit(LEXICON)
    lexicon = sorted(r.word for r in chosen.collect())
    stats = base(texts, "bad", "order").select("bad", "order", "doc_id", *(c.alias(n) for n, c in statistics(lexicon).items()))
    rows = [r.asDict() for r in stats.collect()]  # at most `most` documents' numbers
    return lexicon, cover(sorted(rows, key=lambda r: (r["order"], r["doc_id"])))


def judge(docs: DataFrame, lexicon: list[str], rules: list[Rule]) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail the base. kept is false where the base fails or a
    rule holds. Without labels there are no rules. Rows are taken each for itself; an empty table
    gives an empty result.
    """
    d = base(docs)
    d = d.select("doc_id", F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(c.alias(n) for n, c in statistics(lexicon).items() if n != "n_words")).alias("s"))
    # Through this a filter on the result isn't pushed down, where it would work the statistics out many times over.
    d = d.select("doc_id", F.explode(F.array("s")).alias("s")).select("doc_id", "s.*")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
