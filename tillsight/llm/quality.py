"""Quality rules as weak supervision.

Each rule looks at a few counts of the whole text and votes good (1), bad (-1)
or abstains (0). A two-class latent model with one vote distribution per rule
and class is fitted by expectation-maximisation, and a document is kept when
its posterior probability of being good is at least ``threshold`` and the base
rules hold.

The fit reads only how often each vote pattern occurs: one distributed count
over all documents, with at most 3 ** len(RULES) rows whatever the corpus size.
The posterior is then a sum of one weight per vote: a plain column expression.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows get the same verdict each; an empty table gives an empty result;
ties at the threshold are kept; in the verdicts, columns of the input that clash with the names
made here are replaced by the new ones, while ``good_rows`` returns all input columns unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tillsight.llm.common import bound_batches, free_name, stage

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_caps", "n_marks", "n_distinct", "n_other")

#: ASCII characters that are no letters (white space among them).
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside a 3-word window that occurs at least twice (exact)."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:                       # keep the combined key inside 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The counts named in ``MEASURES`` for one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()                           # bytes.split() cuts at exactly the six white-space bytes
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    blanks = sum(raw.count(c) for c in b" \t\n\v\f\r")
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(text) - blanks, len(raw) - len(raw.translate(None, b"#*$%&|<>")),
            len(lines) - len(set(lines)), _repeat_words(ids, len(seen)), len(lines),
            sum(map(bytes.isupper, words)), raw.count(b"!") + raw.count(b"?"), len(seen),
            len(raw) - len(raw.translate(None, NOT_LETTERS)) - blanks)


@F.pandas_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=list(MEASURES))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""
    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 15 * n_words",
         "word_chars BETWEEN 3.5 * n_words AND 10 * n_words"),
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
    Rule("letters", "n_other > 0.25 * word_chars", "n_other <= 0.1 * word_chars"),
    Rule("lines", "n_dup_lines > 0.4 * n_lines", "n_dup_lines = 0"),
    Rule("repeats", "n_repeat_words > 0.4 * n_words", "n_repeat_words <= 0.05 * n_words"),
    Rule("capitals", "n_caps > 0.5 * n_words", "n_caps <= 0.1 * n_words"),
    Rule("marks", "n_marks > 0.3 * n_words", "n_marks <= 0.1 * n_words"),
    Rule("variety", "n_distinct < 0.1 * n_words", "n_distinct >= 0.2 * n_words"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    return [F.expr(f"CAST(CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS tinyint)")
            .alias(f"vote_{r.name}") for r in rules]


#: Prior vote shares (bad, abstain, good) of a rule in bad and in good documents:
#: a good document rarely gets a bad vote, while a bad one is caught by few rules.
PRIOR = np.array([[0.30, 0.20, 0.50], [0.003, 0.247, 0.75]])
#: Weight of that prior, as a share of the documents; it also fixes which class is which.
PRIOR_WEIGHT = 0.02


@dataclass(frozen=True)
class LabelModel:
    """``share_good`` and P(vote | class): ``tables[rule, class, vote + 1]`` (class 1 is good)."""
    share_good: float
    tables: np.ndarray

    def accuracies(self) -> np.ndarray:
        """Per rule: P(its vote is right | it votes)."""
        p = np.array([1 - self.share_good, self.share_good])
        right = p[0] * self.tables[:, 0, 0] + p[1] * self.tables[:, 1, 2]
        return right / (right + p[0] * self.tables[:, 0, 2] + p[1] * self.tables[:, 1, 0])

    def log_odds(self) -> np.ndarray:
        """Per rule and vote: what the vote adds to the log odds of good."""
        return np.log(self.tables[:, 1, :]) - np.log(self.tables[:, 0, :])


def fit_votes(patterns: np.ndarray, counts: np.ndarray, *, prior: np.ndarray = PRIOR, start: float = 0.5,
              tol: float = 1e-9, max_steps: int = 1000) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns (rows of -1/0/1) and their counts.

    ``start``: the share of class 1 to begin with; ``prior``: vote shares per class.

    ``max_steps`` bounds a numeric fit of a fixed number of parameters; the
    likelihood rises at every step, so a stop there is a usable fit.
    """
    total = float(counts.sum())
    if total == 0:
        return LabelModel(start, np.repeat(prior[None], patterns.shape[1], 0))
    hot = patterns[:, :, None] == np.array([-1, 0, 1])            # pattern, rule, vote
    base = prior * PRIOR_WEIGHT * total + 1e-3
    tables, share = np.repeat(prior[None], patterns.shape[1], 0), start
    for _ in range(max_steps):
        logit = np.log(share / (1 - share)) + np.einsum(
            "prv,rv->p", hot, np.log(tables[:, 1]) - np.log(tables[:, 0]))
        good = counts / (1 + np.exp(-np.clip(logit, -500, 500)))
        mass = np.stack([np.einsum("p,prv->rv", counts - good, hot),
                         np.einsum("p,prv->rv", good, hot)], 1) + base
        new = mass / mass.sum(2, keepdims=True)
        share = float((good.sum() + start * PRIOR_WEIGHT * total) / (total * (1 + PRIOR_WEIGHT)))
        moved = np.abs(new - tables).max()
        tables = new
        if moved < tol:
            break
    return LabelModel(share, tables)


def _posterior(model: LabelModel, rules: tuple[Rule, ...]) -> Column:
    odds = F.lit(float(np.log(model.share_good / (1 - model.share_good))))
    for rule, row in zip(rules, model.log_odds()):
        v = F.col(f"vote_{rule.name}")
        odds = odds + F.when(v < 0, float(row[0])).when(v > 0, float(row[2])).otherwise(float(row[1]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def quality_verdicts(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None,
                     rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``carry`` columns (default: all) with the measures, votes, ``p_good``, ``base_failed`` and ``kept``.

    The text is read once: measures and votes are written to the shared
    folder together with the carried columns, counted there and judged.
    """
    bound_batches(docs.sparkSession)
    made = {*MEASURES, *(f"vote_{r.name}" for r in rules), "p_good", "base_failed", "kept"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    found = free_name(docs, "measures")
    measured = (docs.select(*[F.col(c) for c in carry], measure(F.col(text)).alias(found))
                .select(*carry, f"{found}.*"))
    voted = stage(measured.select("*", *votes(rules)), "quality")
    names = [f"vote_{r.name}" for r in rules]
    histogram = voted.groupBy(*names).count().collect()           # at most 3 ** len(rules) rows
    patterns = np.array([[r[n] for n in names] for r in histogram], dtype=np.int8).reshape(-1, len(names))
    model = fit_votes(patterns, np.array([r["count"] for r in histogram], dtype=float))
    base = ((F.col("n_words") < MIN_WORDS)
            | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")))
    return (voted.withColumn("p_good", _posterior(model, rules)).withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)))


def good_rows(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES,
              threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("input"), F.col(text).alias("text"))
    return (quality_verdicts(rows, carry=["input"], rules=rules, threshold=threshold)
            .where("kept").select("input.*"))
