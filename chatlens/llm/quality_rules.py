"""Quality rules: counts of a text, and a learned decision list over them.

Counts (words are ``[^\\x20\\x09-\\x0D]+``; a null text counts as empty):
``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters
of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word that equal an earlier
line), ``n_repeat_words`` (words in windows of eight words that occur twice or
more in the text). A text fails the base rule with fewer than 20 words or with
more than 30 percent repeated words.

For the others, sequential covering learns an ordered list of rules from the
labelled rows. Features are whole numbers (shares per mille). Labelled rows
are reduced to a table of cells (interval of each feature, part) with counts
of good and bad rows; all learning reads that table by aggregation, and only
counts of (feature, interval) reach the driver. A rule grows on two thirds of
the rows, condition by condition, by information gain; then its last
conditions are cut as long as it does as well on the other third; it is taken
if it is precise there. Rows that a rule covers leave the table. What a failed rule
covers as grown is set aside: nothing more grows from it, but later rules are
still cut and judged on it, as they would reject there too. The list is
emitted as one ordered CASE expression: the first rule that holds rejects.

Only built-in functions. Everything but the labels' join and its small
aggregations is one narrow pass over whole texts.

Labels with a null id or quality teach nothing, nor do ids that are not among
the documents; a label's repeats count as often as they occur. Without labels
the list is empty and only the base rule rejects. A row in gives a row out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import SPACES, UPPER, keep_table, pin, word_array

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FEATURES = ("symbols_pm", "upper_pm", "repeat_pm", "dup_lines_pm", "word_length_pm", "n_words")
CUTS = 32               # thresholds of a feature, at quantiles of the labelled rows
MAX_RULES = 12
MAX_CONDITIONS = 3
PRECISION = 0.97        # share of bad rows that a rule must reach
SUPPORT = 8             # bad rows that it must cover in either part


def _repeats(spots: Column) -> Column:
    """Words under windows that share their hash with another; ``spots`` holds
    (hash, position), sorted."""
    twice = F.filter(F.sequence(F.lit(0), F.size(spots) - 1), lambda k: (
        F.get(spots, k)["h"] == F.get(spots, k - 1)["h"]) | (F.get(spots, k)["h"] == F.get(spots, k + 1)["h"]))
    at = F.array_sort(F.transform(twice, lambda k: F.get(spots, k)["at"]))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(at, none, lambda s, p: F.struct(
        (s["n"] + p + WINDOW - F.greatest(p, s["end"])).alias("n"), (p + WINDOW).alias("end")), lambda s: s["n"])


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts, with upper-case letters A-Z and lines with a word."""
    slim = docs.select(docs[id_col].alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))
    t = F.col("_t")
    without = lambda chars: F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    first = pin(slim, _words=word_array(t), _lines=lines, _size=F.length(t), word_chars=without(SPACES),
                _plain=without(SYMBOLS), _lower=without(UPPER)).drop("_t")
    hashes = F.when(F.size("_words") > WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    second = pin(first, _hashes=hashes, n_words=F.size("_words").cast("long"),
                 n_symbols=(F.col("_size") - F.col("_plain")).cast("long"),
                 n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                 n_lines=F.size("_lines").cast("long"),
                 n_upper=(F.col("_size") - F.col("_lower")).cast("long")).drop("_words", "_lines")
    spots = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.array_sort(
        F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    third = pin(second, _spots=spots).drop("_hashes")
    return third.select("doc_id", "n_words", F.col("word_chars").cast("long").alias("word_chars"), "n_symbols",
                        "n_dup_lines",
                        F.when(F.col("_spots").isNull(), 0).otherwise(_repeats(F.col("_spots")))
                        .cast("long").alias("n_repeat_words"), "n_lines", "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _per_mille(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(0).cast("long")


def with_features(counted: DataFrame) -> DataFrame:
    return (counted.withColumn("symbols_pm", _per_mille("n_symbols", "word_chars"))
            .withColumn("upper_pm", _per_mille("n_upper", "word_chars"))
            .withColumn("repeat_pm", _per_mille("n_repeat_words", "n_words"))
            .withColumn("dup_lines_pm", _per_mille("n_dup_lines", "n_lines"))
            .withColumn("word_length_pm", _per_mille("word_chars", "n_words")))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _cells(rows: DataFrame) -> tuple[DataFrame, dict[str, list[int]]]:
    """Labelled rows reduced to cells: each feature rounded down to the next
    cut, with the counts of bad and good rows of the two parts."""
    quantiles = rows.agg(*[F.percentile_approx(f, [k / CUTS for k in range(1, CUTS)], 10000).alias(f)
                           for f in FEATURES]).first()
    cuts = {f: sorted(set(quantiles[f] or [])) for f in FEATURES}

    def down(f: str) -> Column:
        return F.coalesce(F.array_max(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts[f]]),
                                               lambda c: c <= F.col(f))), F.lit(-1)).alias(f)

    if not all(cuts.values()):
        return rows.limit(0), cuts
    part = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, "prune").otherwise("grow").alias("part")
    return (rows.select(*[down(f) for f in FEATURES], part, "bad")
            .groupBy(*FEATURES, "part").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))), cuts


def _grow(cells: DataFrame, cuts: dict[str, list[int]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        seen = (cells.filter("part = 'grow'").filter(holds(rule))
                .select("bad", "good", F.explode(F.array(*[F.struct(
                    F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("x"))
                .groupBy("x.f", "x.v").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect())
        first = [r for r in seen if r["f"] == FEATURES[0]]
        bad, good = sum(r["bad"] for r in first), sum(r["good"] for r in first)
        if not bad or bad >= PRECISION * (bad + good) and rule:
            break
        best = (0.0, None)
        for f in FEATURES:
            for t in cuts[f]:
                for at_least in (True, False):
                    own = [r for r in seen if r["f"] == f and (r["v"] >= t) == at_least]
                    p, n = sum(r["bad"] for r in own), sum(r["good"] for r in own)
                    if p and p + n < bad + good:
                        gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(f, at_least, t))
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def _pruned(cells: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of ``rule`` that does best on the other part (the shorter
    of equals), and the bad and good rows that it covers there."""
    lengths = range(1, len(rule) + 1)
    r = cells.filter("part = 'prune'").agg(*[
        F.coalesce(F.sum(F.when(holds(rule[:k]), F.col(c))), F.lit(0)).alias(f"{c}{k}")
        for k in lengths for c in ("bad", "good")]).first()
    score = lambda k: (r[f"bad{k}"] - r[f"good{k}"]) / max(1, r[f"bad{k}"] + r[f"good{k}"])
    k = max(lengths, key=lambda k: (score(k), -k))
    return rule[:k], int(r[f"bad{k}"]), int(r[f"good{k}"])


def _bad_rows(cells: DataFrame, part: str) -> int:
    return cells.filter(F.col("part") == part).agg(F.sum("bad")).first()[0] or 0


def learn(featured: DataFrame, labels: DataFrame, id_col: str = "doc_id",
          label_col: str = "quality") -> list[Rule]:
    """The decision list: rules that reject, in order. ``featured`` has doc_id
    and FEATURES; ``labels`` has 0 for bad rows."""
    marks = labels.select(labels[id_col].alias("doc_id"), (labels[label_col] == 0).cast("int").alias("bad")) \
        .filter("bad is not null")
    rows = featured.select("doc_id", *FEATURES).join(marks, "doc_id")
    cells, cuts = _cells(keep_table(rows, "quality-rows"))
    cells = keep_table(cells, "quality-cells")
    rules: list[Rule] = []
    fresh = cells           # without what was set aside
    while len(rules) < MAX_RULES and all(cuts.values()):
        grown = _grow(fresh, cuts)
        if not grown:
            break
        rule, bad, good = _pruned(cells, grown)
        if bad >= SUPPORT and bad >= PRECISION * (bad + good):
            rules.append(rule)
            cells, fresh = cells.filter(~holds(rule)), fresh.filter(~holds(rule))
        else:
            fresh = fresh.filter(~holds(grown))
            if _bad_rows(fresh, "grow") < SUPPORT or _bad_rows(cells, "prune") < SUPPORT:
                break       # too few for any rule
    return rules


def first_rule(rules: list[Rule]) -> Column:
    """Text of the first rule that holds, or null: one ordered CASE."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(holds(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, counts, base_failed, kept and rule (the text of the rule that
    rejects, ``base`` for the base rule, null for kept rows)."""
    counted = keep_table(counts(docs, id_col, text_col), "quality-counts")
    featured = with_features(counted).withColumn("base_failed", base_failed())
    rules = learn(featured.filter(~F.col("base_failed")), labels, label_id_col, label_col)
    rule = F.when(F.col("base_failed"), F.lit("base")).otherwise(first_rule(rules))
    return (featured.withColumn("rule", rule)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", F.col("rule").isNull().alias("kept"), "rule"))
