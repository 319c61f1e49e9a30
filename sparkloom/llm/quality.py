"""Quality rules as weak supervision: each rule votes or abstains, and votes are weighed by what they prove to be worth.

A rule says *good*, *bad* or nothing about a text. Expectation-maximisation over the votes of all documents
estimates, without labels, how often each rule votes each way on good and on bad texts; the posterior
probability of *good* then decides, in place of the demand that all rules pass. Votes are counted by
pattern first, so the estimation reads at most 3**rules rows. Everything is DataFrame code.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm.common import SPACE_CHARS, WORD, free_name, require
from sparkloom.session import cut, stage

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_upper", "n_letters", "n_lines", "n_ended_lines", "n_distinct")


def measure(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a column per measure, and the names of these columns.

    Each step is a projection whose arrays the next one reads more than once, so the optimizer keeps the steps apart
    and every array is made once.
    """
    steps = ("t", "words", "lines", "h", "twos", "fours", "fives", "sorted", "linked", "places")
    at = {name: free_name(docs, f"_{name}") for name in (*MEASURES, *_MORE, *steps)}
    if len(set(at.values())) < len(at):
        raise ValueError("column names clash")
    keep = [F.col(x) for x in docs.columns]
    t, words, lines, h = at["t"], at["words"], at["lines"], at["h"]
    done: list[str] = []

    def step(df: DataFrame, carry: tuple[str, ...] = (), **columns: Column) -> DataFrame:
        made = [c.alias(at[name]) for name, c in columns.items()]
        out = df.select(*keep, *done, *[at[c] for c in carry], *made)
        done.extend(at[name] for name in columns if name in MEASURES or name in _MORE)
        return out

    def size(name: str) -> Column:
        return F.size(at[name])

    df = step(docs, t=F.coalesce(F.col(text), F.lit("")))
    df = step(
        df,
        ("t",),
        words=F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        lines=F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
    )
    df = step(
        df,
        n_words=F.size(words).cast("long"),
        word_chars=F.length(F.translate(t, SPACE_CHARS, "")).cast("long"),
        n_symbols=(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        n_upper=F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
        n_letters=F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
        n_lines=F.size(lines).cast("long"),
        n_ended_lines=F.size(
            F.filter(lines, lambda x: F.substring(F.rtrim(x), -1, 1).isin(*".!?\"':;"))
        ).cast("long"),
        h=F.transform(words, lambda w: F.xxhash64(w)),
    )

    def pairs(a: str, b: str, shift: int) -> Column:
        return F.zip_with(at[a], F.slice(at[b], F.lit(shift + 1), size(b)), lambda x, y: F.xxhash64(x, y))

    df = step(df, ("h",), n_distinct=F.size(F.array_distinct(h)).cast("long"), twos=pairs("h", "h", 1))
    df = step(df, ("h",), fours=pairs("twos", "twos", 2))
    df = step(df, fives=F.slice(pairs("fours", "h", 4), F.lit(1), F.greatest(size("h") - 4, F.lit(0))))
    # most texts repeat no window, and are done here
    fives = at["fives"]
    marked = F.sort_array(F.transform(fives, lambda x, i: F.struct(x.alias("key"), i.alias("at"))))
    df = step(df, sorted=F.when(F.size(F.array_distinct(fives)) < F.size(fives), marked))
    follows = F.zip_with(
        at["sorted"],
        F.slice(at["sorted"], F.lit(2), size("sorted")),
        lambda x, y: F.struct(x["at"].alias("at"), F.coalesce(x["key"] == y["key"], F.lit(False)).alias("more")),
    )
    df = step(df, linked=follows)
    either = F.zip_with(
        at["linked"],
        F.concat(F.array(F.lit(False)), F.transform(at["linked"], lambda x: x["more"])),
        lambda x, before: F.when(x["more"] | before, x["at"]),
    )
    df = step(df, places=F.sort_array(F.filter(either, lambda p: p.isNotNull())))
    places = at["places"]
    between = F.zip_with(
        places, F.slice(places, F.lit(2), F.size(places)), lambda p, q: F.least(F.lit(5), F.coalesce(q - p, F.lit(5)))
    )
    covered = F.aggregate(between, F.lit(0), lambda s, x: s + x)
    df = step(df, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"))
    return df, {name: at[name] for name in (*MEASURES, *_MORE)}


@dataclass(frozen=True)
class Rule:
    """Votes good or bad by two SQL conditions over the measures; else abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 50", "n_words < 10"),
    Rule("word_length", "word_chars BETWEEN 4 * n_words AND 7 * n_words", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("dup_lines", "n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    Rule("upper_case", "10 * n_upper <= n_letters", "10 * n_upper > 3 * n_letters"),
    Rule("letters", "10 * n_letters >= 9 * word_chars", "10 * n_letters < 8 * word_chars"),
    Rule("line_ends", "10 * n_ended_lines >= 8 * n_lines", "10 * n_ended_lines < 3 * n_lines"),
    Rule("distinct", "2 * n_distinct >= n_words", "10 * n_distinct < n_words"),
)

BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass
class QualityModel:
    """Logarithmic odds of good: of the prior, and of every rule for each of its votes 1, 0, -1."""

    prior: float
    odds: dict[str, dict[int, float]] = field(default_factory=dict)

    def posterior(self, vote: Callable[[str], Column] = lambda name: F.col(f"vote_{name}")) -> Column:
        """Probability of good from the votes, by the names of their rules."""
        total = F.lit(self.prior)
        for name, by_vote in self.odds.items():
            v = vote(name)
            total = total + F.when(v > 0, F.lit(by_vote[1])).when(v < 0, F.lit(by_vote[-1])).otherwise(F.lit(by_vote[0]))
        return 1 / (1 + F.exp(-total))


def _inside(condition: str, names: dict[str, str] | None) -> str:
    """A condition over measures whose columns have other names."""
    if names is None:
        return condition
    return re.sub(rf"\b({'|'.join(names)})\b", lambda m: f"`{names[m[1]]}`", condition)


def vote(rule: Rule, names: dict[str, str] | None = None) -> Column:
    """1, 0 or -1; ``names`` are those of the columns of the measures."""
    bad, good = _inside(rule.bad, names), _inside(rule.good, names)
    return F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")


def vote_columns(rules: tuple[Rule, ...] = RULES, names: dict[str, str] | None = None) -> list[Column]:
    return [vote(r, names).alias(f"vote_{r.name}") for r in rules]


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 25, prior: float = 0.8) -> QualityModel:
    """Expectation-maximisation over all votes; jobs run when this is called.

    At the start a vote against a text weighs as much as eight for it, the same for every rule: rules are written to
    pass ordinary texts, so what they object to says more. An empty table gives the start.
    """
    names = [f"vote_{r.name}" for r in rules]
    patterns = cut(voted.groupBy(*names).agg(F.count("*").alias("rows")).coalesce(1))
    model = QualityModel(math.log(prior / (1 - prior)), {r.name: {1: 0.5, 0: 0.0, -1: -4.0} for r in rules})
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"vote_{r.name}").alias("vote")) for r in rules]))
    for _ in range(rounds):
        weighed = patterns.select("rows", (F.col("rows") * model.posterior()).alias("good"), each.alias("of"))
        # three rows per rule
        found = weighed.groupBy("of.rule", "of.vote").agg(F.sum("good").alias("good"), F.sum("rows").alias("all")).collect()
        sums = {(r["rule"], r["vote"]): (r["good"], r["all"] - r["good"]) for r in found}
        if not sums:
            break
        ok, bad = (sum(sums.get((rules[0].name, v), (0.0, 0.0))[side] for v in (1, 0, -1)) for side in (0, 1))
        fresh = QualityModel(math.log((ok + 1) / (bad + 1)))
        for r in rules:
            fresh.odds[r.name] = {}
            for v in (1, 0, -1):
                of_good, of_bad = sums.get((r.name, v), (0.0, 0.0))
                fresh.odds[r.name][v] = math.log((of_good + 1) / (ok + 3)) - math.log((max(0.0, of_bad) + 1) / (bad + 3))
        moved = max(abs(fresh.odds[r.name][v] - model.odds[r.name][v]) for r in rules for v in (1, 0, -1))
        model = fresh
        if moved < 1e-3:
            break
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures and verdict of every document: (id, measures, base_failed, quality, kept).

    Defined results: a null text has no words and fails; rows that repeat an id are judged one by one; other columns
    are not read; an empty table gives no rows. Measures are staged, so each text is read once.
    """
    require(docs, id_col, text)
    measured, names = measure(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    columns = [F.col(own).alias(name) for name, own in names.items()]
    staged = stage(measured.select(F.col("id").alias("_id"), *columns), "measures")
    voted = staged.select("*", *vote_columns())
    model = fit(voted)
    failed = F.expr(BASE_FAILED)
    return voted.withColumn("quality", model.posterior()).select(
        F.col("_id").alias(id_col),
        *MEASURES,
        failed.alias("base_failed"),
        (~failed & (F.col("quality") >= threshold)).alias("kept"),
        "quality",
    )


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is kept; columns stay. The texts are measured twice, once for the votes."""
    require(docs, text)
    measured, names = measure(docs.select(F.col(text).alias("text")))
    model = fit(measured.select(*vote_columns(names=names)))
    again, names = measure(docs, text)
    by_name = {r.name: vote(r, names) for r in RULES}
    failed = F.expr(_inside(BASE_FAILED, names))
    # a filter is not moved below a row number, where each measure would be worked out wherever it is named
    row = free_name(docs, "_row")
    good = (F.col(row) >= 0) & ~failed & (model.posterior(by_name.get) >= threshold)
    return again.withColumn(row, F.monotonically_increasing_id()).filter(good).select(*docs.columns)
