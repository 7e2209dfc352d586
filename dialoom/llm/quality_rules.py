"""Quality rules: an ordered list of threshold conjunctions, learned from labelled statistics, as Spark conditions.

Statistics of every text are column expressions over its words and lines. Labelled rows
(at most ``rows`` of them, drawn by a hash of their id) give a table of statistics. Copies
say a thing once: of texts whose windows have the same smallest hash, one counts. Words that
bad rows hold and hardly any other, by the lower bound of their share of bad rows, become
a list, and how many of them a text holds is one more statistic. On the table the
driver grows rules by sequential covering: the condition with the largest gain of
information is added until no good row is covered, the rule is cut back to where it is
best on a third of the rows that it was not grown on, and kept if there it is right
often enough; the rows it covers then go, and the next rule is grown. The rules become one
CASE expression, evaluated row by row: no Python, no shuffle, and no
row limit, wherever it is applied.

Defined cases: a null text has no words; without words all counts are 0. A text of fewer than
three words has no window. Words are equal if their characters are; windows are compared
by 64-bit hashes of their words, so two different ones of a text count as equal with a
chance below 1e-10 in a text of 60,000 words. Labels: null counts as no complaint, a row null
in both is not used, nor is one without a document; of several for one id a complaint
counts, and of documents that share an id the smallest text. Judged, repeated rows are
rows of their own.
Without labels, or where all labels are equal, there are no rules and every text that
passes the base is kept. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: White space between words, and characters that count as symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Fewest words of a text; share of words in repeated windows, in percent, that is too much.
LEAST_WORDS, REPEATED = 50, 50

#: Statistics that rules may use: name -> SQL over the counted columns.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "distinct_share": "n_distinct / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "words_per_line": "n_words / n_lines",
}
#: The statistic that depends on what was learned.
TELLING = "telling_words"


@dataclass(frozen=True)
class Condition:
    """``feature`` at least (or at most) ``threshold``."""

    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"_{self.feature}")
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A text that meets all conditions is rejected; ``right`` and ``wrong``: rows it was checked on."""

    conditions: tuple[Condition, ...]
    right: int
    wrong: int

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f"  [{self.right} right, {self.wrong} wrong]"


@dataclass(frozen=True)
class RuleList:
    """Rules in order, and the words that one of their statistics counts."""

    rules: tuple[Rule, ...] = ()
    words: tuple[str, ...] = ()


# --- statistics, in column functions only -----------------------------------


def _tail(values: str | Column, size: Column) -> Column:
    """All but the first value."""
    return F.slice(values, 2, F.greatest(size - 1, F.lit(0)))


def _step(df: DataFrame, *columns: Column | str) -> DataFrame:
    """A projection that is computed once a row: as rows of a generator, which the optimizer neither merges into what reads
    them nor pushes a filter through. Merged, an array would be made again for each element that reads it."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def repeated_windows(windows: str = "_windows") -> Column:
    """(hash, place) of all windows in order, if one occurs twice; else null, so that nothing is sorted."""
    placed = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed)


def repeated_words(placed: str = "_placed") -> Column:
    """How many words lie in windows of three that occur twice or more."""
    tail = F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(placed, tail, lambda a, b: F.when(a["h"] == b["h"], F.array(a["k"], b["k"]))), lambda x: x.isNotNull())
    begins = F.array_distinct(F.flatten(pairs))
    words = F.array_distinct(F.flatten(F.transform(begins, lambda k: F.array(k, k + 1, k + 2))))
    return F.coalesce(F.size(words), F.lit(0)).cast("long")


def whole_words(words: tuple[str, ...]) -> str:
    """A pattern for any of the words as a whole run of letters; by first letters, so that few are tried at a place."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word[1:])
    either = "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in by_first.items())
    return f"(?<!\\p{{L}})(?:{either})(?!\\p{{L}})"


def statistics(docs: DataFrame, words: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """Adds counts of each text (long), the features of rules as ``_<name>`` and the smallest hash of its windows as ``_sign``
    (null without one). ``words``: those that ``_telling_words`` counts, as whole runs of letters in any case."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    inner = F.trim(text, F.lit(SPACE))
    split = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    kept = [c for c in docs.columns if c != text_col]
    read = _step(docs, *kept, text.alias("_text"), split.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    telling = F.regexp_count(F.lower("_text"), F.lit(whole_words(words))) if words else F.lit(0)
    marks = F.length(F.regexp_replace("_text", "[\\p{L}\\p{M}\\p{N}\\x20\\x09-\\x0D]+", ""))
    counted = _step(
        read,
        *kept,
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(hashes).alias("_windows"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        marks.cast("long").alias("n_marks"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        telling.cast("double").alias(f"_{TELLING}"),
    )
    rest = [c for c in counted.columns if c != "_windows"]
    counted = _step(counted, *rest, repeated_windows().alias("_placed"), F.array_min("_windows").alias("_sign"))
    counted = _step(counted, *rest, "_sign", repeated_words().alias("n_repeat_words"))
    some = F.col("n_words") > 0
    return counted.select("*", *[F.when(some, F.expr(sql)).otherwise(0.0).alias(f"_{name}") for name, sql in FEATURES.items()])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)


# --- sequential covering ----------------------------------------------------


def telling_words(labelled: DataFrame, most: int, least_share: float, candidates: int = 4096) -> tuple[str, ...]:
    """Words whose share of bad rows, among the rows that hold them, is at least ``least_share`` at its lower bound (95 %);
    of those, best first, the ones that two bad rows hold that no word before them marks."""
    tokens = F.array_distinct(F.split(F.lower("_t"), "[^\\p{L}]+"))  # whole runs of letters of one text
    n, bad = F.col("n"), F.col("bad")
    z = 1.96
    share = bad / n
    bound = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    held = labelled.select("_bad", F.explode(tokens).alias("word")).where("word <> ''")
    counted = held.groupBy("word").agg(F.count("*").alias("n"), F.count_if("_bad").alias("bad"))
    best = counted.select("word", bound.alias("bound")).where(F.col("bound") >= least_share).orderBy(F.desc("bound"), "word").limit(candidates)
    ranked = [r.word for r in best.collect()]
    if not ranked:
        return ()
    marked = labelled.where("_bad").select(F.array_intersect(tokens, F.array(*map(F.lit, ranked))).alias("held")).where("size(held) > 0")
    rows = [set(r.held) for r in marked.collect()]
    chosen: list[str] = []
    for word in ranked:
        with_it = [held for held in rows if word in held]
        if len(with_it) >= 2 and len(chosen) < most:
            chosen.append(word)
            rows = [held for held in rows if word not in held]
    return tuple(chosen)


def literals(values: np.ndarray, names: list[str], cuts: int) -> tuple[list[Condition], np.ndarray]:
    """All conditions that rules may use, and which rows meet them: thresholds at quantiles and at the few smallest
    values, in both directions."""
    found, met = [], []
    for k, name in enumerate(names):
        column = values[:, k]
        for t in np.union1d(np.quantile(column, np.linspace(0, 1, cuts + 1), method="nearest"), np.unique(column)[:4]).tolist():
            for at_least in (True, False):
                found.append(Condition(name, at_least, t))
                met.append(column >= t if at_least else column <= t)
    return found, np.array(met, bool).T


def _counts(met: np.ndarray, bad: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    right = met[rows & bad].sum(0)
    return right, met[rows].sum(0) - right


def grow(met: np.ndarray, bad: np.ndarray, rows: np.ndarray, longest: int) -> list[int]:
    """Conditions, best first, until no good row is covered: each with the largest gain of information."""
    rule: list[int] = []
    p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
    while n and len(rule) < longest:
        right, wrong = _counts(met, bad, rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(right > 0, right * (np.log2(right / np.maximum(right + wrong, 1)) - np.log2(p / (p + n))), -np.inf)
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            break
        rule.append(best)
        rows = rows & met[:, best]
        p, n = int(right[best]), int(wrong[best])
    return rule


def cut_back(rule: list[int], met: np.ndarray, bad: np.ndarray, rows: np.ndarray) -> tuple[list[int], int, int]:
    """The rule's beginning that is best on rows that it was not grown on, with its right and wrong rows there."""
    best: tuple[float, list[int], int, int] = (-2.0, [], 0, 0)
    for k in range(1, len(rule) + 1):
        rows = rows & met[:, rule[k - 1]]
        right, wrong = int((rows & bad).sum()), int((rows & ~bad).sum())
        worth = (right - wrong) / (right + wrong) if right + wrong else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], right, wrong)
    return best[1:]


def cover(conditions: list[Condition], met: np.ndarray, bad: np.ndarray, checked: np.ndarray, least: int = 5, precision: float = 0.95, longest: int = 4, most: int = 64) -> list[Rule]:
    """Rules for the bad rows, one after the other. ``checked``: rows that rules are cut back and judged on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    usable = np.ones(len(conditions), bool)
    while len(rules) < most and (left & bad & ~checked).any() and usable.any():
        rule = grow(met & usable, bad, left & ~checked, longest)
        if not rule:
            break
        begun = rule[0]
        rule, right, wrong = cut_back(rule, met, bad, left & checked)
        if right < least or right < precision * (right + wrong):
            usable[begun] = False  # no good rule begins here
            continue
        rules.append(Rule(tuple(conditions[k] for k in rule), right, wrong))
        left &= ~met[:, rule].all(1)
    return rules


def fit(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = 20_000,
    words: int = 512,
    least_share: float = 0.7,
    cuts: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
    bad: Column | None = None,
) -> RuleList:
    """Rules from at most ``rows`` labelled rows, an equal chance for each id, and at most ``words`` telling words. ``bad``:
    what the rules look for, by default a row of low quality or a toxic one."""
    if bad is None:
        labels = labels.where("quality is not null or toxic is not null")
        bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    scratch = Scratch(docs.sparkSession, "rules")
    chosen = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(bad).alias("_bad"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id")
    texts = scratch.write(texts.groupBy("_id", "_bad").agg(F.min("_t").alias("_t")), "texts")
    # of texts that share their smallest window, and so probably most of them, one counts
    alike = statistics(texts, text_col="_t").where(~base_failed()).groupBy("_sign").agg(F.min("_id").alias("_id"))
    texts = scratch.write(texts.join(F.broadcast(alike.select("_id")), "_id", "left_semi").select("_id", "_bad", "_t"), "apart")
    telling = telling_words(texts, words, least_share)
    names = [*FEATURES, TELLING]
    table = statistics(texts, telling, "_t").select("_id", "_bad", *[f"_{name}" for name in names]).orderBy("_id").collect()
    if not table:
        return RuleList()
    conditions, met = literals(np.array([[r[f"_{name}"] for name in names] for r in table], float), names, cuts)
    # every third row, in the order of the ids, is kept to check rules on
    found = cover(conditions, met, np.array([r["_bad"] for r in table], bool), np.arange(len(table)) % 3 == 2)
    return RuleList(tuple(found), telling)


def rule_met(rules: RuleList) -> Column:
    """The list as one expression, over ``statistics`` with its words: the number of the first rule that is met, from 1;
    null where none is."""
    out = F.lit(None).cast("int")
    for k in range(len(rules.rules), 0, -1):
        out = F.when(reduce(and_, (c.column() for c in rules.rules[k - 1].conditions)), k).otherwise(out)
    return out


def judge(docs: DataFrame, rules: RuleList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) for each document;
    ``rule`` is the number of the first rule that a text meets, null for none: kept are those that pass the base and meet none."""
    counted = statistics(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), rules.words, "_t")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = counted.select("_id", *counts, base_failed().alias("base_failed"), rule_met(rules).alias("rule"))
    return judged.select(F.col("_id").alias(id_col), *counts, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
