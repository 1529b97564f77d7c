"""Quality classifier from weak labels: overlapping heuristic labellers, EM over their votes, and a hashed linear scorer.

Each labeller votes good, bad or abstains. Votes of all documents are counted by pattern (at most 3 ** labellers rows), and
expectation-maximisation over those counts estimates the share of good documents and each labeller's accuracies, without any gold
label. Posteriors of the patterns label a bounded sample of documents, on which a linear scorer over hashed features is fitted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.session import materialize, ship_package


@dataclass(frozen=True)
class QualityParams:
    """``train_docs`` bounds the sample that the scorer is fitted on (by hashes of key and text); votes count over all documents."""

    train_docs: int = 6000
    dims: int = 1024
    em_rounds: int = 200
    ridge: float = 1e-3
    keep_from: float = 0.5


#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for as was with be by on are this from or an at not which "
    "le la les de des du un une et que qui en est pour dans pas par sur au avec ce il elle "
    "der die das und ist von zu den mit ein eine nicht auf für dem sich des im auch als es "
    "el los las y por con para su se no lo como más del una al".split()
)
LABELLERS = ("symbols", "shouting", "exclaiming", "separators", "stutter", "lines", "function_words", "letters", "vocabulary")
_RUN = re.compile(r"([^\w\s])\1\1")
_UPPER, _ALPHA = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[128:] = True


def statistics(text: str) -> tuple[list[str], dict[str, float]]:
    """(words, shares in 0..1 and the word count) of a text."""
    words = text.split()
    n = max(len(words), 1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    letters, upper = int(hist[_ALPHA].sum()), int(hist[_UPPER].sum())
    solid = max(int(len(raw) - hist[[9, 10, 11, 12, 13, 32]].sum()), 1)
    lines = [x for x in text.split("\n") if x]
    has_runs = any(c * 3 in text for c in "*$#%&=~^@+-_.!?<>|/")
    return words, {
        "n": len(words),
        "symbols": len(_RUN.findall(text)) / n if has_runs else 0.0,
        "shouting": upper / max(letters, 1),
        "exclaiming": text.count("!!") / n,
        "separators": text.count("|") / n,
        "stutter": sum(map(eq, words, words[1:])) / n,
        "lines": 1 - len(set(lines)) / max(len(lines), 1),
        "function_words": sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        "letters": letters / solid,
        "vocabulary": len(set(words)) / n,
    }


def votes(s: dict[str, float]) -> str:
    """One letter a labeller: g(ood), b(ad) or - (abstains)."""
    if not s["n"]:
        return "-" * len(LABELLERS)

    def low(name: str, good: float, bad: float) -> str:
        return "g" if s[name] <= good else "b" if s[name] >= bad else "-"

    long = s["n"] >= 30
    return "".join(
        (
            low("symbols", 0.01, 0.1), low("shouting", 0.1, 0.4), low("exclaiming", 0.01, 0.15), low("separators", 0.01, 0.15), low("stutter", 0.05, 0.25), low("lines", 0.2, 0.6),
            "g" if s["function_words"] >= 0.08 else "b" if long and s["function_words"] <= 0.02 else "-",
            "g" if s["letters"] >= 0.85 else "b" if s["letters"] <= 0.75 else "-",
            "b" if long and s["vocabulary"] <= 0.12 * min(1.0, 300 / s["n"]) else "g" if s["vocabulary"] >= 0.2 else "-",
        )
    )


def expectation_maximisation(counts: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """(share of good, P(vote | class) by labeller, class and vote, posterior of good by pattern). Starts from the majority vote."""
    patterns = sorted(counts)
    code = np.array([["gb-".index(c) for c in p] for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    post = np.array([0.9 if p.count("g") > 4 * p.count("b") else 0.1 for p in patterns])
    prior, like = 0.5, np.zeros((code.shape[1], 2, 3))
    for _ in range(rounds):
        mass = np.stack([post * weight, (1 - post) * weight])
        prior = float(np.clip(mass[0].sum() / weight.sum(), 1e-4, 1 - 1e-4))
        for k in range(code.shape[1]):
            for v in range(2):  # an abstention says nothing
                like[k, :, v] = mass[:, code[:, k] == v].sum(axis=1) + 0.5
            like[k, :, :2] /= like[k, :, :2].sum(axis=1, keepdims=True)
            like[k, :, 2] = 1.0
        logit = np.log(prior / (1 - prior)) + sum(np.log(like[k, 0, code[:, k]] / like[k, 1, code[:, k]]) for k in range(code.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        done, post = np.abs(new - post).max() < 1e-6, new
        if done:
            break
    return prior, like, dict(zip(patterns, post.tolist()))


# --- hashed linear scorer -----------------------------------------------------------------------------------------------------------
def _shape(word: str) -> str:
    """A word's outline: case, length class and its last characters that aren't letters."""
    bare = word.rstrip("".join(c for c in set(word) if not c.isalnum()))
    tail = word[len(bare) :][:4]
    case = "U" if bare.isupper() and len(bare) > 1 else "T" if bare[:1].isupper() else "l" if bare.isalpha() else "x"
    return f"{case}{min(len(bare) // 4, 4)}{tail}"


class Features:
    """Hashed features: shares of words and of word outlines, and levels of the document's statistics. A bounded cache maps words to
    places."""

    def __init__(self, dims: int, room: int = 200_000):
        self.dims, self.room, self.places = dims, room, {}

    def place(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.dims

    def of(self, words: list[str], s: dict[str, float]) -> tuple[list[int], list[float]]:
        if len(self.places) > self.room:
            self.places.clear()
        known, seen = self.places, Counter()
        for w, c in Counter(words).items():
            at = known.get(w)
            if at is None:
                at = self.place(_shape(w[:64])), self.place(f"w:{w[:64].lower()}")
                if len(w) <= 32:
                    known[w] = at
            seen[at[0]] += c
            seen[at[1]] += c
        n = max(len(words), 1)
        out = {at: c / n for at, c in seen.items()}
        for k in LABELLERS:
            at = self.place(f"{k}:{int(s[k] * 20)}")
            out[at] = out.get(at, 0.0) + 1.0
        return list(out), list(out.values())


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, dims: int, ridge: float, steps: int = 600) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the intercept. Accelerated gradient steps."""
    x = np.zeros((len(rows), dims + 1), np.float32)
    for i, (at, v) in enumerate(rows):
        x[i, at] = v
    x[:, -1] = 1
    wt = np.full(len(rows), 1 / max(len(rows), 1), np.float32)
    squares = [(wt[:, None] * part * part).sum(axis=0) for part in np.array_split(x, max(1, dims // 256), axis=1)]  # no second matrix
    step = 4.0 / float(np.concatenate(squares).sum() + 1e-9)
    w, v = np.zeros(dims + 1, np.float32), np.zeros(dims + 1, np.float32)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - step * (x.T @ (wt * (p - label)) + ridge * v)
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float
    accuracies: np.ndarray
    params: QualityParams

    def scores(self, at: np.ndarray, val: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of good of rows of features (their places and values, one row after the other; ``ends`` from 0); 0 where a row has
        none, so where there are no words. A row's sum is over that row alone, so equal rows score equally whatever stands beside them."""
        z, some = np.full(len(ends) - 1, float(self.weights[-1])), np.diff(ends) > 0
        if some.any():
            z[some] += np.add.reduceat(self.weights[at].astype(np.float64) * val.astype(np.float64), ends[:-1][some])
        return np.where(some, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)

    def score_texts(self, texts: list[str | None], features: Features) -> np.ndarray:
        rows = [features.of(*said) if said[0] else ([], []) for said in (statistics(t or "") for t in texts)]
        ends = np.cumsum([0, *(len(at) for at, _ in rows)])
        return self.scores(np.array([x for at, _ in rows for x in at], np.int32), np.array([x for _, val in rows for x in val], np.float32), ends)


def _unit() -> Column:
    """A number from 0 to 1 from the hash of key and text."""
    return F.shiftrightunsigned(F.xxhash64("h"), 11) / F.lit(float(1 << 53))


def _featured(docs: DataFrame, key: str, text: str, p: QualityParams, below: float | None = None, features: bool = True) -> DataFrame:
    """(k, h, votes, at, val) of every row, or of those whose ``_unit`` is ``below``: the key, a hash of key and text, the labellers' votes
    and the scorer's features (none where there are no words, nor without ``features``)."""
    ship_package(docs.sparkSession)
    kind, key_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(p.dims)
        for b in batches:
            v, at, val = [], [], []
            for t in b.column(2):
                words, s = statistics(t.as_py() or "")
                v.append(votes(s))
                a, x = f.of(words, s) if words and features else ([], [])
                at.append(a)
                val.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(key_type), b.column(1), pa.array(v, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["k", "h", "votes", "at", "val"])

    own = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("t"))
    own = own if below is None else own.where(_unit() < below)
    return own.mapInArrow(run, f"k {kind}, h long, votes string, at array<int>, val array<float>")


def _fitted(seen: DataFrame, sampled: Callable[[float], DataFrame], p: QualityParams) -> Model:
    """EM on the counts of ``seen``'s votes, and a scorer fitted on at most ``train_docs`` rows of ``sampled`` (the rows whose ``_unit`` is
    below a bound)."""
    counts = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.append(np.zeros(p.dims), 1.0).astype(np.float32), 1.0, np.zeros((len(LABELLERS), 2, 3)), p)
    prior, like, post = expectation_maximisation(counts, p.em_rounds)
    # about 1.5 times the bound pass the threshold, whatever the table's size, so that tasks send no more than that to the driver
    sample = sampled(1.5 * p.train_docs / sum(counts.values())).orderBy("h").limit(p.train_docs).select("votes", "at", "val").toArrow()
    if not sample.num_rows:
        return Model(np.append(np.zeros(p.dims), 1.0).astype(np.float32), prior, like, p)
    label = np.array([post[v] for v in sample.column("votes").to_pylist()], np.float32)
    rows = [(at.values.to_numpy(), val.values.to_numpy()) for at, val in zip(sample.column("at"), sample.column("val"))]
    return Model(fit_linear(rows, label, p.dims, p.ridge), prior, like, p)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", p: QualityParams = QualityParams()) -> Model:
    """Votes of all documents, EM on their counts, and the scorer. Features are made of the sample alone, and nothing is written. Empty
    table: a scorer that keeps every text with words."""
    return _fitted(_featured(docs, key, text, p, features=False), lambda bound: _featured(docs, key, text, p, bound), p)


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the model's probability of good quality, as ``classify`` gives it. Map-side; null and empty texts score 0."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Features(model.params.dims)
        for s in parts:
            yield pd.Series(model.score_texts(list(s), f), dtype="float64")

    return docs.withColumn(column, score(F.col(text)))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", p: QualityParams = QualityParams()) -> DataFrame:
    """(key, score, kept) of every row, scored from the features that the votes were counted with, so that each text is read once.

    Null and empty texts, and those of white space: score 0, not kept. Equal texts score equally; repeated rows stay; null keys are
    keys like any other. Empty table: no rows. Other columns are not read."""
    seen = materialize(_featured(docs, key, text, p), "quality-votes")
    model = _fitted(seen, lambda bound: seen.where(_unit() < bound), p)
    key_type = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, val = b.column(1), b.column(2)
            got = model.scores(at.flatten().to_numpy(), val.flatten().to_numpy(), at.offsets.to_numpy() - at.offsets[0].as_py())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(key_type), pa.array(got, pa.float64())], ["k", "score"])

    got = seen.select("k", "at", "val").mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, score double")
    return got.select(F.col("k").alias(key), "score", (F.col("score") >= p.keep_from).alias("kept"))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", p: QualityParams = QualityParams()) -> DataFrame:
    """``docs`` without what the classifier rejects, see ``classify``; their own columns, texts neither shuffled nor changed."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    return scored(docs, fit(docs, key, text, p), text, name).where(F.col(name) >= p.keep_from).drop(name)
