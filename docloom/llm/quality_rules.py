"""Quality rules learned as a decision list.

Sequential covering: a rule is grown condition by condition on two thirds of the labelled
rows, pruned on the rest, kept if it is precise enough, and the rows it covers leave the
game.  All counting is aggregation; the rules come out as Spark conditions, in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.once import let
from docloom.llm.store import stored

#: The base rule.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"

#: Labelled rows that are learned from, at most about so many: chosen by a hash.
FIT_ROWS = 200_000
#: Thresholds tried for a feature, rules, and conditions of a rule.
THRESHOLDS, RULES, CONDITIONS = 32, 8, 3
#: A rule is kept if so many of the rows it rejects are labelled bad, and so many at least.
PRECISION, SUPPORT = 0.95, 10


def repeated_words(words: Column) -> Column:
    """Words inside a window of ``WINDOW`` words that the text has twice or more.

    Windows are compared by 64-bit hashes.  Only a text with equal windows pays for the
    sort that finds them; neighbours in order that are equal mark their places, and the
    marked places cover their words once.
    """

    def covered(windows: Column) -> Column:
        def marked(ordered: Column) -> Column:
            hits = F.filter(ordered, lambda x, k: x["h"].eqNullSafe(F.get(ordered, k - 1)["h"]) | x["h"].eqNullSafe(F.get(ordered, k + 1)["h"]))
            places = F.sort_array(F.transform(hits, lambda x: x["at"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        ordered = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ordered, marked))

    def windows(hashes: Column) -> Column:
        begins = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(begins, lambda at: F.xxhash64(*[F.get(hashes, at + k) for k in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(let(hashes, windows), covered))


def text_stats(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id and counts over every whole text: one pass, no shuffle."""
    whole = F.coalesce(F.col(text), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(whole, pattern, "")).cast("long")

    def facts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def line_facts(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(whole, SPACE, -1), "")
    found = docs.select(
        F.col(id_column).alias("doc_id"),
        let(words, facts).alias("w"),
        let(lines, line_facts).alias("l"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        left(r"[^A-Z]+").alias("n_upper"),
        left(r"[^0-9]+").alias("n_digits"),
    )
    return found.select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_digits")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def features() -> dict[str, Column]:
    """Name and value of everything a condition may test."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "duplicate_lines": _ratio("n_dup_lines", "n_lines"),
        "repeated_words": _ratio("n_repeat_words", "n_words"),
        "distinct_words": _ratio("n_distinct", "n_words"),
        "upper_share": _ratio("n_upper", "word_chars"),
        "digit_share": _ratio("n_digits", "word_chars"),
        "words_per_line": _ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, value: Column) -> Column:
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.holds(values[c.feature]) for c in rule], F.lit(True))


def rule_number(rules: list[Rule], values: dict[str, Column]) -> Column:
    """The decision list as one conditional: number of the first rule that covers a row, else null."""
    out = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(covers(rule, values), n).otherwise(out)
    return out


def _gain(p: int, n: int, before_p: int, before_n: int) -> float:
    return p * (log2(p / (p + n)) - log2(before_p / (before_p + before_n))) if p else 0.0


def _grow(rows: DataFrame, thresholds: dict[str, list[float]]) -> Rule:
    """Adds the condition of the greatest gain until no row labelled good is covered."""
    values = {f: F.col(f) for f in thresholds}
    bins = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), reduce(lambda a, b: a + b, [(F.col(f) > t).cast("int") for t in ts], F.lit(0)).alias("bin"))
            for f, ts in thresholds.items() if ts
        ]
    )
    rule: Rule = ()
    if not any(thresholds.values()):
        return rule
    for _ in range(CONDITIONS):
        covered = rows.filter(covers(rule, values)).select("bad", F.explode(bins).alias("b"))
        counted = covered.groupBy("b.feature", "b.bin").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n")).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counted:
            by.setdefault(r["feature"], {})[r["bin"]] = (r["p"], r["n"])
        if not by:
            break
        all_p, all_n = (sum(x[k] for x in next(iter(by.values())).values()) for k in (0, 1))
        if not all_p or not all_n:
            break
        best, condition = 1e-9, None
        for f in sorted(by):
            p = n = 0
            for bin_, t in enumerate(thresholds[f]):
                p, n = p + by[f].get(bin_, (0, 0))[0], n + by[f].get(bin_, (0, 0))[1]
                for above, pp, nn in ((False, p, n), (True, all_p - p, all_n - n)):
                    if (gain := _gain(pp, nn, all_p, all_n)) > best:
                        best, condition = gain, Condition(f, above, t)
        if condition is None:
            break
        rule += (condition,)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The shortest beginning of the rule that is best on rows it was not grown on."""
    values = {c.feature: F.col(c.feature) for c in rule}
    columns = []
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], values)
        columns += [F.sum((hit & F.col("bad")).cast("int")).alias(f"p{k}"), F.sum((hit & ~F.col("bad")).cast("int")).alias(f"n{k}")]
    row = rows.agg(*columns).first()
    worth = [((row[f"p{k}"] or 0) - (row[f"n{k}"] or 0)) / max(1, (row[f"p{k}"] or 0) + (row[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]
    return rule[: worth.index(max(worth)) + 1]


def learn_rules(
    labelled: DataFrame, precision: float = PRECISION, support: int = SUPPORT, rules: int = RULES, thresholds: int = THRESHOLDS
) -> list[Rule]:
    """The decision list from rows with the features, ``bad`` (boolean) and ``grow`` (boolean).

    Only counts by feature and threshold reach the driver.  Without rows of both labels
    there is no rule.  Equal gains go to the first feature by name and the lowest threshold.
    """
    names = [c for c in labelled.columns if c not in ("bad", "grow")]
    shares = [k / (thresholds + 1) for k in range(1, thresholds + 1)]
    cuts = labelled.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in names]).first()
    tried = {f: sorted(set(cuts[f] or [])) for f in names}
    values = {f: F.col(f) for f in names}
    found: list[Rule] = []
    rest = labelled
    while len(found) < rules:
        rule = _grow(rest.filter("grow"), tried)
        if not rule:
            break
        rule = _prune(rest.filter(~F.col("grow")), rule)
        hit = rest.filter(covers(rule, values)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("p")).first()
        if (hit["p"] or 0) < max(support, precision * hit["n"]):
            break
        found.append(rule)
        rest = rest.filter(~covers(rule, values))
    return found


def judge(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label_id: str = "doc_id", quality: str = "quality",
    fit_rows: int = FIT_ROWS, **options,
) -> tuple[DataFrame, list[Rule]]:
    """One row for each document: id, the counts, ``base_failed``, ``rule`` and ``kept``; and the rules.

    ``labels`` gives 1 or 0 for some ids; of several for one id the lowest holds, a null
    label is none.  Documents that fail the base rule are not learned from.  About
    ``fit_rows`` labelled documents are, chosen by a hash of the id.  Without usable labels
    only the base rule rejects.

    A null text counts as empty and fails the base rule.  Repeated rows and null ids stay
    as they are; other columns are ignored; an empty table gives no rows.
    """
    stats = stored(text_stats(docs, text, id_column), "stats").withColumn("base_failed", base_failed())
    marks = labels.filter(F.col(quality).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(F.min(quality).alias("quality"))
    usable = stats.filter(~F.col("base_failed")).join(marks, "doc_id")
    n = usable.count()
    rate = min(1.0, fit_rows / n) if n else 1.0
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    values = features()
    fit = usable.filter(draw < int(rate * (1 << 30))).select(
        *[v.alias(f) for f, v in values.items()], (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(3)) > 0).alias("grow")
    )
    rules = learn_rules(stored(fit, "labelled"), **options)
    judged = stats.withColumn("rule", F.when(~F.col("base_failed"), rule_number(rules, values)))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return judged.withColumnRenamed("doc_id", id_column), rules
