"""Operator 4: toxicity of deobfuscated text.

Writing is seen as a noisy channel: the intended letters may be replaced by look-alikes (leetspeak), stretched by
repetition or spaced out. The lattice of all readings of a disguised word is decoded with the Viterbi algorithm under
a character language model, whose n-grams are counted over every document. Words that the channel cannot have changed
are their own only reading and are not decoded.

The restored text is then scored: a feature is a restored word or its beginning; its weight is the shrunken log-odds
of the label, from at most ``LABELLED_ROWS`` labelled rows. The strongest feature decides, as one insult is enough
and the many weak features that copies of a toxic text share are not evidence; its weight is mapped to a probability
by a logistic curve fitted on a third of these rows that the weights of that fit have not seen.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialised
from folioscope.llm.language_id import BITS, CharModel, gram_counts, kneser_ney

#: Labelled rows from which the classifier is fitted, at most about this number.
LABELLED_ROWS = 40_000
REMEMBERED = 300_000
#: Restored words, and n-grams of the decoder, that it remembers: these are larger.
RESTORED = 150_000
#: Features that a task adds up before it passes them on.
TALLIED = 200_000
ORDER = 4
#: States kept at each step of the decoder.
BEAM = 24

# Look-alikes and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "µ": "u",
}
SUBSTITUTION, STRETCH, DROP = 3.0, 1.0, 4.0
SPACED = re.compile(r"(?<!\S)(?:[^\W_][ ._*~-]){2,}[^\W_](?!\S)")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
STRETCHED = re.compile(r"(.)\1\1")
SEPARATORS = re.compile(r"[ ._*~-]+")


class Decoder:
    """Viterbi decoding of one disguised word. A state is the last ``order - 1`` letters."""

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def learn(self, grams: set[str]) -> None:
        """Look up all grams of one step at once."""
        fresh = [g for g in grams if g not in self.known]
        if not fresh:
            return
        if len(self.known) > RESTORED:
            self.known.clear()
            fresh = list(grams)
        codes = []
        for gram in fresh:
            code = 0
            for c in gram:
                point = ord(c)
                code = (code << BITS) | (point if point < 2048 else 2048 + point % 2048)
            codes.append(code)
        self.known.update(zip(fresh, self.model.costs(np.array(codes, np.int64))[:, 0].tolist(), strict=True))

    def __call__(self, word: str) -> str:
        order = self.model.order
        states = {" " * (order - 1): (0.0, "")}
        for i, c in enumerate(word):
            readings: list[tuple[str, float]] = []
            if c.isalpha():
                readings.append((c, 0.0))
            readings += [(letter, SUBSTITUTION) for letter in LOOKALIKES.get(c, "")]
            if not c.isalnum():
                readings.append(("", DROP if c in LOOKALIKES else 0.0))
            elif not readings:
                readings.append((c, 0.0))
            if i and word[i - 1] == c:
                readings.append(("", STRETCH))
            self.learn({context + letter for context in states for letter, _ in readings if letter})
            following: dict[str, tuple[float, str]] = {}
            for context, (total, path) in states.items():
                for letter, price in readings:
                    if letter:
                        state, value = (context + letter)[1:], total + price + self.known[context + letter]
                    else:
                        state, value = context, total + price
                    if state not in following or value < following[state][0]:
                        following[state] = (value, path + letter)
            states = dict(sorted(following.items(), key=lambda s: s[1][0])[:BEAM])
        self.learn({context + " " for context in states})
        return min((total + self.known[context + " "], path) for context, (total, path) in states.items())[1]


def features_of(word: str) -> tuple[str, str, str]:
    """A restored word and its two beginnings."""
    return word, word[:4] + "_", word[:5] + "__"


class Restorer(dict):
    """token -> the features of its restored form."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.decode = Decoder(model)

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > RESTORED:
            self.clear()
        found = self[token] = tuple(self.features(token))
        return found

    def restored(self, token: str) -> list[str]:
        word = token.lower()
        if word.isalpha() and not STRETCHED.search(word):
            return [word]
        core = EDGES.sub("", word)
        if not core:
            return []
        readings = [core]
        body = word.strip(".,;:?\"'()[]{}*#%&_~-")
        disguised = body if any(c in LOOKALIKES for c in body) else core
        plain = disguised.isalpha() and not STRETCHED.search(disguised)
        digits = sum(c.isdigit() for c in disguised)
        letters = sum(c.isalpha() for c in disguised)
        if not plain and letters and 2 * letters >= digits and len(disguised) <= 40:
            clipped = disguised if not re.search(r"([^\w])\1\1$", disguised) else core
            readings.append(self.decode(clipped))
        return readings

    def features(self, token: str) -> Iterator[str]:
        for word in dict.fromkeys(self.restored(token)):
            yield from features_of(word)

    def of(self, text: str) -> set[str]:
        out: set[str] = set()
        for token in set(text.split()):
            out.update(self[token])
        for run in SPACED.findall(text):
            out.update(self[SEPARATORS.sub("", run)])
        return out


class Strengths(dict):
    """token -> the largest weight among its features, 0 if it has none."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        super().__init__()
        self.restorer, self.weights = restorer, weights
        # All features of a plain word begin with its first four letters.
        self.roots = {f.rstrip("_")[:4] for f in weights}

    def __missing__(self, token: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        word, value = token.lower(), 0.0
        if not word.isalpha() or STRETCHED.search(word):
            value = max((self.weights.get(f, 0.0) for f in self.restorer[token]), default=0.0)
        elif word[:4] in self.roots:
            value = max(self.weights.get(f, 0.0) for f in features_of(word))
        self[token] = value
        return value

    def of(self, text: str) -> float:
        best = max(map(self.__getitem__, set(text.split())), default=0.0)
        for run in SPACED.findall(text):
            best = max(best, self[SEPARATORS.sub("", run)])
        return best


_RESTORERS: dict[str, Restorer] = {}
_STRENGTHS: dict[str, Strengths] = {}


def restorer_of(token: str, model: CharModel) -> Restorer:
    """One per Python worker and character model: what was decoded for one job serves the next."""
    if token not in _RESTORERS:
        _RESTORERS.clear()
        _RESTORERS[token] = Restorer(model)
    return _RESTORERS[token]


def strengths_of(token: str, restorer: Restorer, weights: dict[str, float]) -> Strengths:
    if token not in _STRENGTHS:
        _STRENGTHS.clear()
        _STRENGTHS[token] = Strengths(restorer, weights)
    return _STRENGTHS[token]


class ToxicityModel:
    """A fitted model. Its character model is broadcast once, for all that is fitted and scored with it."""

    def __init__(self, model: Broadcast, weights: dict[str, float], slope: float, base: float, token: str | None = None):
        self.model, self.weights, self.slope, self.base = model, weights, slope, base
        self.model_token, self.token = token or uuid.uuid4().hex, uuid.uuid4().hex

    def with_scores(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        """``rows`` with the column ``name``; a null or empty text has no features and gets the base rate."""
        model_token, token, slope, base = self.model_token, self.token, self.slope, self.base
        model, weights = self.model, rows.sparkSession.sparkContext.broadcast(self.weights)
        kept = [c for c in rows.columns if c != name]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            strengths = strengths_of(token, restorer_of(model_token, model.value), weights.value)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                total = base + slope * np.fromiter((strengths.of(t) if t else 0.0 for t in texts), float, len(texts))
                values = pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))
                yield pa.RecordBatch.from_arrays([batch.column(1), values], names=["_all", "_score"])

        # The columns travel as one, so their names don't matter.
        frame = rows.select(F.col(f"`{text}`").alias("_content"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_all"))
        scored = frame.mapInArrow(score, frame.select("_all").schema.add("_score", "double"))
        return scored.select(*[F.col("_all")[c].alias(c) for c in kept], F.col("_score").alias(name))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text",
    label: str = "toxic", labelled_rows: int = LABELLED_ROWS, shrink: float = 8.0, least: float = 1.5,
) -> ToxicityModel:
    """Fit on the labelled rows for which ``training`` holds (a condition on ``key``); a row with two labels has the
    larger one, rows without a label or an id are left out. Without labels every score is 0.5 or less."""
    spark = docs.sparkSession
    every = docs.select(F.lit("all").alias("group"), F.col(text).alias("content"))
    counts = materialised(gram_counts(every, ORDER), "toxicity_counts")
    model = CharModel.load(materialised(kneser_ney(counts, ORDER), "toxicity_model"), ORDER)
    if not model.groups:
        return ToxicityModel(spark.sparkContext.broadcast(CharModel(["all"], ORDER, {(n, c): (np.zeros(0, np.int32), np.zeros((0, 1), np.float32)) for n in range(1, ORDER + 1) for c in (0, 1)})), {}, 1.0, -1.0)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & training)
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    n = known.count()
    share = int(1_000_000 * min(1.0, labelled_rows / max(n, 1)))
    known = known.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < share)
    # At most about ``labelled_rows`` pairs of numbers.
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("content"))
    rows = texts.join(F.broadcast(known), "_key").select(
        "content", "_label", (F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(3)) == 0).alias("late")
    )
    token, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = restorer_of(token, shared.value)
        tally: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            names, numbers = list(tally), np.array(list(tally.values()), np.int64).reshape(-1, 4)
            tally.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array(numbers[:, j]) for j in range(4)]], names=["f", "a", "b", "c", "d"]
            )

        for batch in batches:
            for content, toxic, late in zip(*[batch.column(j).to_pylist() for j in range(3)], strict=True):
                at = 2 * bool(late) + int(bool(toxic))
                tally.setdefault("", [0, 0, 0, 0])[at] += 1
                for f in restorer.of(content or ""):
                    own = tally.get(f)
                    if own is None:
                        own = tally[f] = [0, 0, 0, 0]
                    own[at] += 1
            if len(tally) > TALLIED:
                yield out()
        yield out()

    features = rows.mapInArrow(count, "f string, a long, b long, c long, d long").groupBy("f").agg(
        *[F.sum(c).alias(c) for c in "abcd"]
    )
    features = materialised(features, "toxicity_features")
    totals = features.where("f = ''").first()
    if totals is None or not totals.b + totals.d or not totals.a + totals.c:
        return ToxicityModel(shared, {}, 1.0, -1.0)

    def weights(no: Column, yes: Column, n_no: int, n_yes: int) -> dict[str, float]:
        """Shrunken log-odds against the base rate, of the features that speak for the label by ``least`` or more."""
        rate = (n_yes + 1) / (n_yes + n_no + 2)
        p = (yes + shrink * rate) / (yes + no + shrink)
        lift = F.log(p / (1 - p)) - math.log(rate / (1 - rate))
        chosen = features.where("f <> ''").select("f", lift.alias("w")).where(F.col("w") >= least)
        return {r.f: r.w for r in chosen.collect()}

    early = weights(F.col("a"), F.col("b"), totals.a, totals.b)
    trial = ToxicityModel(shared, early, 1.0, 0.0, token).with_scores(rows.where("late"), "content", "_score")
    seen = trial.select("_label", F.round(F.log(F.col("_score") / (1 - F.col("_score"))), 2).alias("x"))
    seen = seen.groupBy("_label", "x").count().toPandas()
    slope, base = logistic(seen["x"].to_numpy(), seen["_label"].to_numpy(), seen["count"].to_numpy())
    both = weights(F.col("a") + F.col("c"), F.col("b") + F.col("d"), totals.a + totals.c, totals.b + totals.d)
    return ToxicityModel(shared, both, slope, base, token)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a slightly penalised logistic curve, by Newton's method."""
    if not len(x):
        return 1.0, -1.0
    features, w = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (n * (p - y)) + 0.1 * w
        curve = (features * (n * p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(2)
        w -= np.linalg.solve(curve, slope)
    return max(float(w[0]), 0.05), float(w[1])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text",
    label: str = "toxic", threshold: float = 0.3,
) -> DataFrame:
    """``key, score, predicted`` of every row."""
    model = fit_toxicity(docs, labels, training, key, text, label)
    scored = model.with_scores(docs.select(key, text), text, "score").select(key, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
