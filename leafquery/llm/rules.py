"""Quality rules: text statistics, fixed base rules, and a learned decision list. DataFrame functions only.

The list is learned by sequential covering from labelled statistics and becomes one ordered conditional
expression over the statistic columns, which can be printed and read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from leafquery.llm.common import WHITE

TRAIN_ROWS = 6_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper",
              "n_marks", "n_lines", "n_chars")
#: What rules compare: name -> (numerator, denominator).
SHARES = {"n_words": ("n_words", None), "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
          "dup_lines": ("n_dup_lines", "n_lines"), "repeat_words": ("n_repeat_words", "n_words"),
          "distinct_words": ("n_distinct_words", "n_words"), "upper": ("n_upper", "n_chars"), "marks": ("n_marks", "n_chars"),
          "words_per_line": ("n_words", "n_lines")}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` as a lambda variable: computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows that occur twice: sort (hash, position), keep those equal to a neighbour, join overlaps."""
    def of(ordered: Column) -> Column:
        def place(i: Column) -> Column:
            own = F.get(ordered, i)
            twice = ((F.get(ordered, i - 1)["h"] == own["h"]) & (i > 0)) | (F.get(ordered, i + 1)["h"] == own["h"])
            return F.when(twice, own["i"])
        places = F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), place)))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(places, start, lambda acc, x: F.struct(
            x.alias("last"), (acc["n"] + F.least(F.lit(width), x - acc["last"])).alias("n")), lambda acc: acc["n"])

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # most texts repeat nothing; they are seen by a hash set and not sorted
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(bind(ordered, of))


def repeat_words(words: Column, width: int = 8) -> Column:
    """How many of ``words`` lie in ``width``-word windows found twice or more (by 64-bit window hashes)."""
    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - width + 1), lambda i: F.xxhash64(F.slice(hashes, i, width)))
    found = bind(bind(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda w: _covered(w, width))
    return F.when(F.size(words) < width, F.lit(0).cast("bigint")).otherwise(found)


def statistics(text: Column) -> Column:
    """struct of STATISTICS, all long. A null text is the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.btrim(text, F.lit(WHITE)), "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)

    def without(pattern: str) -> Column:
        return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("c"), repeat_words(w).alias("r"),
                        F.size(F.array_distinct(w)).alias("d"))

    dup = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return bind(F.struct(bind(words, of).alias("w"), dup.alias("l")), lambda x: F.struct(*[c.cast("long").alias(n) for n, c in {
        "n_words": x["w"]["n"], "word_chars": x["w"]["c"], "n_symbols": without("[#*$%&|<>]+"), "n_dup_lines": x["l"]["d"],
        "n_repeat_words": x["w"]["r"], "n_distinct_words": x["w"]["d"], "n_upper": without("[A-Z]+"),
        "n_marks": without("[!?]+"), "n_lines": x["l"]["n"], "n_chars": F.char_length(text)}.items()]))


def base_failed(s: Column, least_words: int = 20, repeat_percent: int = 30) -> Column:
    return (s["n_words"] < least_words) | (100 * s["n_repeat_words"] > repeat_percent * s["n_words"])


def share(s: Column, name: str) -> Column:
    top, below = SHARES[name]
    return s[top].cast("double") if below is None else s[top] / F.greatest(s[below], F.lit(1))


@dataclass(frozen=True)
class Condition:
    share: str
    above: bool
    threshold: float

    def of(self, s: Column) -> Column:
        return share(s, self.share) >= self.threshold if self.above else share(s, self.share) < self.threshold

    def __str__(self) -> str:
        return f"{self.share} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule], s: Column) -> Column:
    """The decision list as an ordered conditional expression: the first rule that holds rejects, else kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.of(s)
        out = F.when(holds, False).otherwise(out)
    return out


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= (x[c.share] >= c.threshold) == c.above
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Add the condition of the largest information gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            side = np.searchsorted(cuts[name], values[inside], "right")
            pos = np.bincount(side[bad[inside]], minlength=len(cuts[name]) + 1)
            neg = np.bincount(side[~bad[inside]], minlength=len(cuts[name]) + 1)
            for above in (True, False):
                pp = pos[::-1].cumsum()[::-1][1:] if above else pos.cumsum()[:-1]
                nn = neg[::-1].cumsum()[::-1][1:] if above else neg.cumsum()[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    got = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))), -1.0)
                k = int(np.argmax(got)) if len(got) else 0
                if len(got) and got[k] > gain:
                    best, gain = Condition(name, above, float(cuts[name][k])), got[k]
        if best is None:
            break
        rule += (best,)
        inside &= _holds((best,), x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last conditions where that doesn't hurt on rows that the rule was not grown on."""
    def worth(r: Rule) -> float:
        inside = _holds(r, x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, cuts: int = 64, most_conditions: int = 4, most_rules: int = 12,
          precision: float = 0.8) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on one third, keep a rule that is precise there, remove its rows."""
    edges = {n: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[1:-1])) if len(v) else np.zeros(0) for n, v in x.items()}
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 0
    rules: list[Rule] = []
    while len(rules) < most_rules and (left & bad).any():
        part = lambda rows: ({n: v[rows] for n, v in x.items()}, bad[rows])
        rule = _prune(_grow(*part(left & ~third), edges, most_conditions), *part(left & third))
        inside = _holds(rule, x) & left if rule else np.zeros(len(bad), bool)
        seen = inside & third
        if not rule or not (inside & bad).any() or (seen.any() and (seen & bad).sum() < precision * seen.sum()):
            break
        if (inside & bad).sum() < precision * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, *, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality", **options) -> list[Rule]:
    """Learn from at most ``train_rows`` labelled rows, chosen by a hash of their id; that many ids are broadcast."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y in (0, 1)")
              .orderBy(F.xxhash64("id"), "id", "y").limit(train_rows))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
            .select("id", "y", statistics(F.col("text")).alias("s"))
            .groupBy("id", "y").agg(F.min("s").alias("s")).collect())
    rows = sorted(rows, key=lambda r: (hash((r.id, 7)) & 0xFFFF, r.id, r.y) if isinstance(r.id, int) else (0, str(r.id), r.y))
    x = {n: np.array([r.s[a] / max(1, r.s[b]) if b else r.s[a] for r in rows], float) for n, (a, b) in SHARES.items()}
    return learn(x, np.array([r.y == 0 for r in rows], bool), **options)


def apply_rules(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """(row, stats, base_failed, kept): every document judged by the base rules, then by the list.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike; an empty
    list keeps all that the base rules keep.
    """
    s = F.col("stats")
    # the statistics stand below a projection that names them often, so they are computed once for each row
    return (docs.select(F.struct("*").alias("row"), statistics(F.col(text_col)).alias("stats"))
            .select("row", "stats", base_failed(s).alias("base_failed"), (~base_failed(s) & verdict(rules, s)).alias("kept")))
