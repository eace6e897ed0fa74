"""Toxicity by weak supervision.

Many weak voters look at a text: one for each term of a lexicon (given, or found in the
training rows), and patterns. A generative label model, fitted by expectation-maximisation,
estimates how often each voter fires on toxic and on clean texts and how far voters are
correlated within a class; correlated voters are discounted, so that ten names for one
observation don't count tenfold. A given label is one more voter, not the truth. A linear
classifier over terms is then trained on the posterior labels and scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.llm.common import cut_lineage, free_name

#: The fit looks at no more rows than this, labelled ones first, in order of a hash of their ids.
SAMPLE_ROWS = 20_000
#: Terms of the classifier, and those of them that vote.
TERMS, LEXICON_VOTERS = 4096, 64
#: A term must be in this many sampled texts.
MIN_SUPPORT = 5
#: And its rates in the two classes must differ by so many standard errors; there are many terms to try.
LEAST_Z = 4.5

#: Plain insults, one voter.
INSULTS = frozenset(
    "idiot moron stupid scum trash clown loser pathetic worthless disgusting imbecile dumb filth".split()
)
BEGINNINGS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]{3,}")
_SECOND_PERSON = re.compile(r"\byou(?:'re| are) (?:an? |so |such )?\w+", re.IGNORECASE)
#: Shares of a text's words from which on lexicon words are dense.
DENSE, DENSER = 0.01, 0.02
PATTERNS = (
    "insult", "several_insults", "shouting", "exclaiming", "addressed", "lexicon_twice", "lexicon_dense", "lexicon_denser",
)


def terms_of(text: str) -> set[str]:
    """Words of three letters or more in lower case, and the first 4 to 7 letters of longer ones, as "x*"."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def patterns_of(text: str, insults: int, hits: int, words: int) -> list[int]:
    """Numbers of the pattern voters that fire; `hits` of the text's `words` are in the lexicon.

    A long text holds a lexicon word by chance, so how dense they lie counts beside which they are.
    """
    fired = []
    if insults:
        fired.append(0)
    if insults > 1:
        fired.append(1)
    if text.isupper() or ("!" in text and sum(map(str.isupper, text)) * 2 > len(text)):
        fired.append(2)
    if text.count("!!") > 2:
        fired.append(3)
    if "you" in text and _SECOND_PERSON.search(text):
        fired.append(4)
    if hits > 1:
        fired.append(5)
        if hits >= DENSE * words:
            fired.append(6)
        if hits >= DENSER * words:
            fired.append(7)
    return fired


class Model(NamedTuple):
    terms: dict[str, int]
    #: Numbers of the terms that speak for toxic.
    lexicon: frozenset[int]
    weights: np.ndarray
    bias: float

    def features(self, text: str | None) -> list[int]:
        """Numbers of the terms in a text, and of its patterns behind them."""
        text = text or ""
        words = Counter(_WORD.findall(text.lower()))
        get, found, hits = self.terms.get, set(), 0
        for w, times in words.items():
            own = [get(w), *[get(w[:n] + "*") for n in BEGINNINGS if len(w) > n]]
            found.update(own)
            if w in INSULTS or not self.lexicon.isdisjoint(own):
                hits += times
        found.discard(None)
        patterns = patterns_of(text, len(words.keys() & INSULTS), hits, words.total())
        return sorted(found) + [len(self.terms) + p for p in patterns]

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, dict]:
    """Posteriors of "toxic" for rows of 0/1 votes; labels are 1, 0, or -1 where not given.

    Returns them with what was estimated: rates of firing by class, the labels' accuracy, the
    voters' correlations within classes and the discounts that follow from them.
    """
    n, m = votes.shape
    if not n:
        return np.zeros(0), {}
    v = votes.astype(float)
    given = labels >= 0
    fired = v.sum(axis=1)  # where no label is given, voters on the whole are taken to be better than chance
    post = np.where(labels == 1, 0.9, np.where(labels == 0, 0.1, np.where(fired > fired.mean(), 0.7, 0.1)))
    discount = np.ones(m)
    info: dict = {}
    for step in range(rounds):
        weight = np.stack([1 - post, post])
        mass = weight.sum(axis=1) + 2
        rate = (weight @ v + np.array([[0.02], [0.2]])) / mass[:, None]
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        prior = np.clip((post.sum() + 1) / (n + 2), 1e-4, 1 - 1e-4)
        right = np.where(labels == 1, post, 1 - post)[given]
        accuracy = float(np.clip((right.sum() + 19) / (given.sum() + 20), 0.6, 0.99))
        if step >= 5 and step % 5 == 0:
            rho = np.zeros((m, m))
            for k in range(2):
                centred = (v - rate[k]) * np.sqrt(weight[k])[:, None]
                cov = centred.T @ centred / mass[k]
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                rho = np.maximum(rho, cov / np.outer(sd, sd) * (np.sqrt(mass[k]) > 5))
            np.fill_diagonal(rho, 0)
            discount = 1 / (1 + np.where(rho > 0.15, rho, 0).sum(axis=1))
            info["correlations"] = rho
        on = np.log(rate[1] / rate[0]) * discount
        off = np.log((1 - rate[1]) / (1 - rate[0])) * discount
        z = np.log(prior / (1 - prior)) + v @ (on - off) + off.sum()
        z += np.where(labels == 1, 1, np.where(labels == 0, -1, 0)) * np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - post).max() < 1e-4
        post = new
        if done and step > 11:
            break
    return post, info | {"rates": rate, "accuracy": accuracy, "discount": discount, "prior": prior}


def train_linear(rows: list[list[int]], targets: np.ndarray, size: int, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam; both classes weigh the same, so rare ones count."""
    w, bias = np.zeros(size), 0.0
    if not rows:
        return w, bias
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([c for r in rows for c in r], np.int64)
    share = np.clip(targets.mean(), 0.02, 0.98)
    weight = targets / share + (1 - targets) / (1 - share)
    weight /= weight.sum()
    state = np.zeros((2, size + 1))
    for step in range(1, steps + 1):
        z = bias + np.bincount(at, w[cols], len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets)
        grad = np.append(np.bincount(cols, g[at], size) + l2 * w, g.sum())
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(terms_of(t or "")) for t in texts], dtype=object)


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """The model, from rows of `docs` for which `usable` holds and their labels, at most SAMPLE_ROWS.

    Rows without a label take part in the label model. Several labels of an id count as the
    largest; repeated rows count once, rows of one id with other texts for themselves. What reaches the driver is bounded: TERMS terms and the sampled rows' term numbers.
    """
    given = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    narrow = docs.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keys = narrow.select("id", F.xxhash64("text").alias("h")).distinct().join(given, "id", "left")
    chosen = keys.orderBy(F.col("label").isNull(), F.xxhash64("id"), "id", "h").limit(SAMPLE_ROWS)
    picked = narrow.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "h"])  # at most SAMPLE_ROWS keys
    rows = cut_lineage(picked.groupBy("id", "h").agg(F.first("label").alias("label"), F.first("text").alias("text")))

    counted = rows.where("label is not null").select("label", F.explode(_terms("text")).alias("term"))
    sums = counted.groupBy("term").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = rows.agg(F.sum("label"), F.count("label")).first()
    pos_all, n_all = (totals[0] or 0), (totals[1] or 0)
    neg_all = n_all - pos_all
    # How far a term's rate in one class exceeds that in the other, weighed by its rate.
    p = (F.col("pos") + 0.5) / (pos_all + 1.0)
    q = (F.col("n") - F.col("pos") + 0.5) / (neg_all + 1.0)
    gain = (p - q) * F.log(p / q)
    both = (F.col("n") + 1.0) / (n_all + 2.0)
    z = (p - q) / F.sqrt(both * (1 - both) * (1.0 / (pos_all + 1.0) + 1.0 / (neg_all + 1.0)))
    best = (
        sums.where((F.col("n") >= MIN_SUPPORT) & (F.abs(z) >= LEAST_Z))
        .select("term", (gain * F.signum(p - q)).alias("toward"), gain.alias("gain"))
        .orderBy(F.desc("gain"), "term").limit(TERMS).collect()
    )
    terms = {r["term"]: i for i, r in enumerate(best)}
    voters = [i for i, r in enumerate(best) if r["toward"] > 0][:LEXICON_VOTERS]
    lexicon = frozenset(i for i, r in enumerate(best) if r["toward"] > 0)
    draft = Model(terms, lexicon, np.zeros(len(terms) + len(PATTERNS)), 0.0)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([draft.features(t) for t in texts], dtype=object)

    sample = rows.select("label", features("text").alias("f")).toPandas()  # at most SAMPLE_ROWS rows
    lists = [list(map(int, f)) for f in sample["f"]]
    marks = sample["label"].fillna(-1).to_numpy(int)
    columns = {c: k for k, c in enumerate([*voters, *range(len(terms), len(terms) + len(PATTERNS))])}
    votes = np.zeros((len(lists), len(columns)), bool)
    for i, row in enumerate(lists):
        for c in row:
            if c in columns:
                votes[i, columns[c]] = True
    posterior, _ = label_model(votes, marks)
    weights, bias = train_linear(lists, posterior, len(draft.weights))
    return Model(terms, lexicon, weights, bias)


def with_score(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """`docs` with the score of the whole text; null and empty texts have that of the bias."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # TERMS terms and weights

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        one = sent.value.score
        return pd.Series([one(t) for t in texts], dtype=float)

    return docs.withColumn(out, score(F.col(text_col)))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted), a row for each row; other columns are not read."""
    scored = with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, "text", "score")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that are predicted toxic; all columns stay."""
    name = free_name(docs, "toxicity")
    return with_score(docs, model, text_col, name).where(F.col(name) < 0.5).drop(name)
