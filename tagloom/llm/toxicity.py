"""Toxicity scores from a weighted lexicon.

A text is folded: lower case, accents and homoglyphs (Greek, Cyrillic, full width) to
their Latin letters, digits and signs inside words to the letters they imitate, all
else to single spaces.  One Aho-Corasick automaton finds the lexicon's words and word
beginnings, and the exception phrases that take back the hits they cover.  The weights
of the hits are set against the text's length and a logistic curve makes the score.

The lexicon and the curve are learned from labelled rows that `train` keeps: at most
`sample` of them (those with the lowest hash of doc_id), their words and word
beginnings counted by label.  A word's weight is the logarithm of how much more often
toxic texts than others hold it.  The automaton has at most `entries` patterns, so it
may be broadcast; scores cover every row and the whole text.

Cases: null and empty texts get the score of a text without hits; repeated labels
count once per doc_id (the greatest label); a label of null counts as none; without
labels of both kinds there is no lexicon and every score is next to 0; repeated rows
score alike; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize, text_of

#: Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = dict(zip("абвгдезикмнопрстухьіјѕһԁαβγειικνορτυχωß", "a6brde3nkmhonpctyxbijshdabyeiikvoptuxwb"))
SIGNS = dict(zip("0134578@$!|", "oieastbasii"))
#: Phrases in which a lexicon word means no offence.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "idiot proof", "clown fish", "sore loser", "worthless check")

_SIGN = re.compile(r"(?<=[a-z0-9])[@$!|]+(?=[a-z0-9])")
_OTHER = re.compile("[^a-z0-9]+")
_NUMBER = re.compile(r"\b[0-9]+\b")
_FAR = re.compile("[^\x00-ſ -⁯]")


def _table() -> dict[int, str]:
    out = {}
    for c in map(chr, range(0x80, 0x180)):
        base = unicodedata.normalize("NFKD", c)[0]
        out[ord(c)] = base if base.isascii() else " "
    return out | {ord(a): b for a, b in HOMOGLYPHS.items()}


_FOLD = _table()
_DIGITS = str.maketrans({k: v for k, v in SIGNS.items() if k.isdigit()})


def fold(text: str) -> str:
    """The text's words in plain letters, each with a space on either side."""
    text = text.lower()
    if not text.isascii():
        if _FAR.search(text):
            text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
        text = text.translate(_FOLD)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    text = _OTHER.sub(" ", text)
    if any(d in text for d in "0134578"):
        text = _NUMBER.sub(" ", text).translate(_DIGITS)
    return f" {' '.join(text.split())} "


def features(folded: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """Words (with their end) and word beginnings, as patterns."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    curve: Sequence[float] = (0.0, 0.0, 0.0, 0.0, -50.0)  # for what measure() gives, and a constant
    exceptions: Sequence[str] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                made.add_word(pattern, (len(pattern), weight))
            for phrase in self.exceptions:
                pattern = fold(phrase)
                made.add_word(pattern, (len(pattern), 0.0))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def measure(self, text: str) -> tuple[float, float, float, float]:
        """The hits' weight per root of a hundred words, its sum's logarithm, whether
        there is any, and the greatest.  A word counts its greatest weight once."""
        folded = fold(text)
        hits: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        if self.weights:
            for end, (n, weight) in self.automaton().iter(folded):
                start = end - n + 1
                if weight:
                    hits[start] = max(weight, hits.get(start, 0.0))
                else:
                    excused.append((start, end))
        for a, b in excused:
            for start in [s for s in hits if a <= s < b]:
                del hits[start]
        total = sum(hits.values())
        words = folded.count(" ") - 1
        return total / math.sqrt(max(words, 1) / 100 + 1), math.log1p(total), float(bool(hits)), max(hits.values(), default=0.0)

    def score(self, text: str) -> float:
        *weights, constant = self.curve
        at = sum(w * x for w, x in zip(weights, self.measure(text))) + constant
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, at))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> list[float]:
    """Weights, the constant last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 20_000, entries: int = 2_000, least: int = 5, ratio: float = 12.0) -> Lexicon:
    """train: a condition on doc_id that labelled rows must meet to be learned from.
    An entry is held by `least` toxic texts or more, and by a `ratio` times larger
    share of toxic texts than of others."""
    known = labels.select("doc_id", "toxic").where(train & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", text_of().alias("text"), "__toxic"))
    sizes = {r["__toxic"]: r["n"] for r in rows.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["__toxic"]):
                (bad if label == 1 else good).update(features(fold(text)))
        # a task's counts of features that no toxic text of its own holds can still matter elsewhere
        names = list(bad.keys() | good.keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pd.DataFrame({"feature": part, "bad": [bad[f] for f in part], "good": [good[f] for f in part]})

    each = rows.select("text", "__toxic").mapInPandas(counted, "feature string, bad long, good long")
    sums = each.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= least)
    weight = F.log((F.col("bad") + 0.5) / toxic) - F.log((F.col("good") + 1.0) / clean)
    top = sums.withColumn("weight", weight).where(F.col("weight") >= math.log(ratio)).orderBy((F.col("weight") * F.col("bad")).desc(), "feature").limit(entries)
    found = Lexicon({r["feature"]: float(r["weight"]) for r in top.collect()})

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(list(map(found.measure, batch["text"])), columns=["rate", "amount", "any", "most"], dtype="float64")
            yield out.assign(toxic=batch["__toxic"].astype("int64").to_numpy())

    seen = rows.select("text", "__toxic").mapInPandas(measured, "rate double, amount double, any double, most double, toxic long").toPandas()  # `sample` rows of numbers
    found.curve = logistic(seen[["rate", "amount", "any", "most"]].to_numpy(float), seen["toxic"].to_numpy(float))
    return found


def scored(docs: DataFrame, lexicon: Lexicon, name: str = "__score") -> DataFrame:
    """docs with a column of that name, which they must not have."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs have a column {name}; give another name")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most `entries` patterns

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(shared.value.score).astype("float64")

    return docs.withColumn(name, score(text_of()))


def fold_of(column: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
