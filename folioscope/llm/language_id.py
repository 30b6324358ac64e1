"""Operator 1: language identification by interpolated Kneser-Ney character models.

Training counts the character n-grams of the words of every training text, per language; lower orders count distinct
left neighbours (continuation counts), all as Spark aggregations. A model is a sorted array of n-gram hashes per
order, with one column of discounted probabilities per language, and the same for the back-off weights of contexts.
Hashes are taken modulo a prime, so that the arrays, and what is broadcast, have a bound that does not depend on the
data: ``ORDER`` times ``SLOTS`` entries of one hash and one float per language; collisions add up.

A text gets the language of the lowest cross-entropy per symbol. An acceptance level per language, a quantile of the
entropies of its own training texts, calibrates the rejection of texts that look like none of the languages.

A word is a run of letters in lower case, between boundaries. Null and letterless texts get ``und``, score 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialised

ORDER = 4
#: A prime: the places of a hash array.
SLOTS = 4_194_301
#: Bits of a symbol: characters beyond this range share symbols.
BITS = 12
#: Words whose scores a worker remembers.
REMEMBERED = 300_000
BOUNDARY = 32
LETTERS = re.compile(r"[^\W\d_]+")


def symbols(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram codes of all words, one after the other, and the number of codes of each word.

    A word is preceded by ``order - 1`` boundaries and followed by one, and has one code for each of its letters and
    the closing boundary. A code holds the symbols of the n-gram, the last one in the lowest bits.
    """
    pad = " " * (order - 1)
    joined = pad + (" " + pad).join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(points < 2048, points, 2048 + points % 2048)
    codes = np.zeros(len(points) - order + 1, np.int64)
    for j in range(order):
        codes = (codes << BITS) | points[j : j + len(codes)]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    keep = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return codes[keep], sizes


def gram_counts(rows: DataFrame, order: int = ORDER, room: int = 200_000) -> DataFrame:
    """``group, gram, n`` of ``rows (group string, content string)``: n-grams of all words, counted over every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[str, Counter] = {}
        grams: dict[str, dict[int, int]] = {}

        def settle() -> None:
            for group, counter in tokens.items():
                words: dict[str, int] = {}
                for token, n in counter.items():
                    for word in LETTERS.findall(token.lower()):
                        words[word] = words.get(word, 0) + n
                counter.clear()
                if words:
                    codes, sizes = symbols(list(words), order)
                    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
                    own = grams.setdefault(group, {})
                    found, at = np.unique(codes, return_inverse=True)
                    for code, n in zip(found.tolist(), np.bincount(at, weight).tolist(), strict=True):
                        own[code] = own.get(code, 0) + int(n)

        def out() -> Iterator[pa.RecordBatch]:
            for group, own in grams.items():
                yield pa.RecordBatch.from_pydict({
                    "group": pa.array([group] * len(own), pa.string()),
                    "gram": pa.array(own.keys(), pa.int64()), "n": pa.array(own.values(), pa.int64()),
                })
            grams.clear()

        for batch in batches:
            for group, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counter = tokens.setdefault(group, Counter())
                counter.update(content.split())
                if len(counter) > room:
                    settle()
                    if sum(map(len, grams.values())) > room:
                        yield from out()
        settle()
        yield from out()

    content = F.col("content")
    partial = rows.where(content.isNotNull() & F.col("group").isNotNull()).select("group", "content")
    partial = partial.mapInArrow(count, "group string, gram long, n long")
    return partial.groupBy("group", "gram").agg(F.sum("n").alias("n"))


def slot(code: Column) -> Column:
    return F.pmod(code, F.lit(SLOTS)).cast("int")


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``group, order, context (0/1), slot, value``: discounted probabilities and back-off weights."""
    grams, parts = counts, []
    for n in range(order, 0, -1):
        context = F.shiftright("gram", BITS)
        total = grams.groupBy("group", context.alias("_context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("types")
        )
        discount = grams.groupBy("group").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        discount = discount.select(
            "group", F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5)).alias("d")
        ).select("group", F.least(F.greatest("d", F.lit(0.1)), F.lit(0.9)).alias("d"))
        total = total.join(discount, "group")
        here = grams.withColumn("_context", context).join(total, ["group", "_context"])
        parts.append(here.select(
            "group", F.lit(n).alias("order"), F.lit(0).alias("context"), slot(F.col("gram")).alias("slot"),
            ((F.col("n") - F.col("d")) / F.col("total")).alias("value"),
        ))
        parts.append(total.select(
            "group", F.lit(n).alias("order"), F.lit(1).alias("context"), slot(F.col("_context")).alias("slot"),
            (F.col("d") * F.col("types") / F.col("total")).alias("value"),
        ))
        mask = (1 << (BITS * (n - 1))) - 1
        if n > 1:
            lower = F.col("gram").bitwiseAND(F.lit(mask))
            grams = grams.groupBy("group", lower.alias("gram")).agg(F.count("*").alias("n"))
            grams = materialised(grams, "language_grams")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    merged = F.when(F.col("context") == 1, F.avg("value")).otherwise(F.sum("value"))
    return result.groupBy("group", "order", "context", "slot").agg(merged.alias("value"))


class CharModel:
    """Sorted hash arrays of all groups. ``scores(words)``: negative log2 probability of each word under each group."""

    def __init__(self, groups: list[str], order: int, arrays: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]):
        self.groups, self.order, self.arrays = groups, order, arrays

    @classmethod
    def load(cls, table: DataFrame, order: int = ORDER) -> CharModel:
        """Brings the arrays to the driver, order by order; their size is bounded by ``SLOTS``."""
        groups = sorted(r[0] for r in table.select("group").distinct().collect())
        arrays = {}
        for n in range(1, order + 1):
            for context in (0, 1):
                part = table.where((F.col("order") == n) & (F.col("context") == context))
                rows = part.select("slot", "group", F.col("value").cast("float")).toArrow()
                slots, at = np.unique(rows.column("slot").to_numpy(), return_inverse=True)
                values = np.full((len(slots), len(groups)), 1.0 if context else 0.0, np.float32)
                place = {g: i for i, g in enumerate(groups)}
                values[at, [place[g] for g in rows.column("group").to_pylist()]] = rows.column("value").to_numpy()
                arrays[n, context] = slots.astype(np.int32), values
        return cls(groups, order, arrays)

    def look(self, n: int, context: int, codes: np.ndarray) -> np.ndarray:
        slots, values = self.arrays[n, context]
        wanted = (codes % SLOTS).astype(np.int32)
        at = np.minimum(np.searchsorted(slots, wanted), max(len(slots) - 1, 0))
        hit = (slots[at] == wanted)[:, None] if len(slots) else np.zeros((len(codes), 1), bool)
        missing = np.float32(1.0 if context else 0.0)
        return np.where(hit, values[at], missing) if len(slots) else np.full((len(codes), len(self.groups)), missing)

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """-log2 P(last symbol | the others), a column per group."""
        p = np.full((len(codes), len(self.groups)), 1.0 / (1 << BITS), np.float32)
        for n in range(1, self.order + 1):
            own = codes & ((1 << (BITS * n)) - 1)
            p = self.look(n, 0, own) + self.look(n, 1, own >> BITS) * p
        return -np.log2(np.maximum(p, 1e-9))

    def scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.groups)))
        codes, sizes = symbols(words, self.order)
        kinds, at = np.unique(codes, return_inverse=True)
        costs = self.costs(kinds)[at]
        return np.add.reduceat(costs, np.cumsum(sizes) - sizes, axis=0)


class TextScorer:
    """Cross-entropy of texts. Remembers what white-space separated tokens cost: frequent ones are scored once."""

    def __init__(self, model: CharModel):
        self.model = model
        self.places: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.groups) + 1))

    def learn(self, tokens: set[str]) -> None:
        if len(self.places) + len(tokens) > REMEMBERED:
            self.places.clear()
        words, owner = [], []
        for token in tokens:
            place = self.places[token] = len(self.places)
            for word in LETTERS.findall(token.lower()):
                words.append(word)
                owner.append(place)
        while len(self.table) < len(self.places):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        fresh = [self.places[t] for t in tokens]
        self.table[fresh] = 0
        if words:
            cost = self.model.scores(words)
            size = np.fromiter(map(len, words), np.float64, len(words)) + 1
            np.add.at(self.table, np.array(owner), np.column_stack([cost, size]))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """For each text the total cost under each group and the number of symbols."""
        out = np.zeros((len(texts), self.table.shape[1]))
        tokens = [t.split() for t in texts]
        known = self.places.keys()
        fresh = {t for own in tokens for t in own} - known
        if fresh:
            if len(self.places) + len(fresh) > REMEMBERED:
                fresh = {t for own in tokens for t in own}
            self.learn(fresh)
        for i, own in enumerate(tokens):
            if own:
                at = np.fromiter(map(self.places.__getitem__, own), np.int64, len(own))
                out[i] = self.table[at].sum(axis=0)
        return out


_SCORERS: dict[str, TextScorer] = {}


def scorer_of(token: str, model: CharModel) -> TextScorer:
    """One per Python worker and model."""
    if token not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[token] = TextScorer(model)
    return _SCORERS[token]


def entropies(rows: DataFrame, model: CharModel, kept: list[str], text: str) -> DataFrame:
    """``rows[kept]`` with ``lang_pred, score, entropy, accepted``, every text with a letter being accepted."""
    import uuid

    spark = rows.sparkSession
    token, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(model)
    groups = model.groups

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(token, shared.value)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                some = batch.slice(part, 512)
                costs = scorer([t or "" for t in some.column(0).to_pylist()])
                size = costs[:, -1]
                per = costs[:, :-1] / np.maximum(size, 1)[:, None]
                if len(groups):
                    best = per.argmin(axis=1)
                    low = per[np.arange(len(per)), best]
                    weight = np.minimum(size, 64)[:, None]
                    share = 1 / np.exp2(np.minimum((low[:, None] - per) * weight, 0)).sum(axis=1)
                else:
                    best, low, share = np.zeros(len(per), int), np.zeros(len(per)), np.zeros(len(per))
                blank = (size == 0) | (not groups)
                names = ["und" if b else groups[i] for b, i in zip(blank, best, strict=True)]
                new = [
                    pa.array(names, pa.string()), pa.array(np.where(blank, 0.0, share)),
                    pa.array(np.where(blank, 0.0, low)), pa.array(~blank),
                ]
                yield pa.RecordBatch.from_arrays(some.columns[1:] + new, names=[*kept, "lang_pred", "score", "entropy", "accepted"])

    frame = rows.select(F.col(text).alias("_content"), *kept)
    schema = frame.select(*kept).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("entropy", "double"), ("accepted", "boolean")):
        schema = schema.add(name, kind)
    return frame.mapInArrow(predict, schema)


def identify_languages(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    quantile: float = 0.995,
) -> DataFrame:
    """``key, lang_pred, score, entropy, accepted`` of every row, learnt from the rows where ``training`` holds.

    ``score`` is the chosen language's share of the probability of 64 symbols of this entropy, halved for a text that
    its language does not accept. Every text is scored once; the acceptance levels come from all training rows.
    """
    known = F.when(training, F.col(lang))
    learnt = docs.where(known.isNotNull()).select(F.col(lang).alias("group"), F.col(text).alias("content"))
    counts = materialised(gram_counts(learnt), "language_counts")
    model = CharModel.load(materialised(kneser_ney(counts), "language_model"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), known.alias("_known"))
    scored = materialised(entropies(rows, model, ["_key", "_known"], "_text"), "language_entropies")
    own = scored.where((F.col("lang_pred") == F.col("_known")) & (F.col("score") > 0))
    levels = own.groupBy("lang_pred").agg((F.percentile_approx("entropy", quantile) * 1.02).alias("_level"))
    # One row per language.
    judged = scored.join(F.broadcast(levels), "lang_pred", "left")
    accepted = F.col("accepted") & F.coalesce(F.col("entropy") <= F.col("_level"), F.lit(True))
    return judged.select(
        F.col("_key").alias(key), "lang_pred", F.when(accepted, F.col("score")).otherwise(F.col("score") / 2).alias("score"),
        "entropy", accepted.alias("accepted"),
    )
