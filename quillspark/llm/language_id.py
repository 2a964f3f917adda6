"""Language identification by averaged hashed subword embeddings.

A text's words (runs of letters, made small) are cut into n-grams of bytes with
marks at both ends; each n-gram is hashed to a row of an embedding table, and the
average of all rows of the whole text goes through a linear softmax.  Both are
trained by stochastic gradient descent in numpy on a bounded sample of labelled
texts (``sample``; whole texts, dealt evenly over languages by a hash of the key).
A part of the sample, not trained on, sets the temperature that calibrates the
probabilities and the score below which a prediction is rejected.

A text that is null or holds no letter is ``und`` with score 0.  Texts of any
length are read whole.  Without any labelled row everything is ``und``; an empty table
gives none.  Repeated rows are each judged, alike, and columns whose names clash with
new ones are carried as ``<name>_in``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import make_room, slim_batches, trained_in_one_task

UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+").findall
_SIZES = (2, 3, 4, 5)


def subword_rows(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words' n-grams, one word after the other, and how many each word has."""
    marked = [b"<" + w + b">" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(data))
    word = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    with np.errstate(over="ignore"):
        code = np.full(len(data), 2166136261, np.uint32)
        for n in range(max(_SIZES)):
            code = code[: len(data) - n] if n else code
            code = (code ^ data[n:]) * np.uint32(16777619)
            if n + 1 in _SIZES:
                good = at[: len(code)] + n < ends[: len(code)]
                h = code[good] * np.uint32(2654435761)
                rows.append(((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - bits))
                owners.append(word[: len(code)][good])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order].astype(np.int64), np.bincount(owners, minlength=len(words))


def words_of(text: str) -> list[bytes]:
    return [w.encode() for w in _WORDS(text.lower())]


class Trained:
    """A trained model: per table row its share of each language's logit."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, bits: int, temperature: float = 1.0, reject_below: float = 0.0):
        self.langs, self.logits, self.bias, self.bits = langs, logits, bias, bits
        self.temperature, self.reject_below = temperature, reject_below


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], bits: int = 15, dim: int = 16, epochs: int = 12, rate: float = 2.0, seed: int = 11) -> Trained:
    """Trains on four fifths of the texts and calibrates on the rest."""
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs], np.int64)
    docs = []
    for text in texts:
        words = words_of(text)
        rows = subword_rows(words, bits)[0] if words else np.empty(0, np.int64)
        found, counts = np.unique(rows, return_counts=True)
        docs.append((found, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((1 << bits, dim)) / dim).astype(np.float32)
    out = np.zeros((dim, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    order = rng.permutation(len(docs))
    held = set(order[::5].tolist()) if len(docs) >= 20 else set()
    learn = np.array([i for i in range(len(docs)) if i not in held and len(docs[i][0])], np.int64)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            rows, share = docs[i]
            mean = share @ table[rows]
            p = softmax((mean @ out + bias)[None])[0]
            p[label[i]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            table[rows] -= (step * share)[:, None] * back[None, :] * 8
    model = Trained(names, (table @ out).astype(np.float32), bias, bits)
    check = [i for i in (sorted(held) or learn.tolist()) if len(docs[i][0])]
    if check and len(names) > 1:
        raw = np.array([docs[i][1] @ model.logits[docs[i][0]] + bias for i in check])
        grid = np.geomspace(0.05, 20, 120)
        # A little of each target goes to the other languages, so that a faultless check doesn't ask for endless confidence.
        goal = np.full(raw.shape, 1 / (len(check) + 2) / (len(names) - 1))
        goal[np.arange(len(check)), label[check]] = 1 - 1 / (len(check) + 2)
        loss = [-(goal * np.log(np.maximum(softmax(raw / t), 1e-12))).sum(1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        right = softmax(raw / model.temperature)
        right = right.max(1)[right.argmax(1) == label[check]]
        # A little below what all but one in a thousand of the rightly told texts reach, and below one half.
        model.reject_below = 0.999 * float(min(0.5, np.quantile(right, 0.001))) if len(right) else 0.0
    return model


class Scorer:
    """Scores texts; each word's sums are kept for words that come again, in bounded memory."""

    def __init__(self, model: Trained, most: int = 200_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.langs) + 1), np.float64)

    def learn(self, words: list[str]) -> None:
        if len(self.at) + len(words) > self.most:
            self.clear()
        rows, counts = subword_rows([w.encode() for w in words], self.model.bits)
        owner = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sums = np.add.reduceat(self.model.logits[rows].astype(np.float64), owner, axis=0)
        first = len(self.at)
        while len(self.sums) < first + len(words):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[first : first + len(words), :-1] = sums
        self.sums[first : first + len(words), -1] = counts
        self.at.update(zip(words, range(first, first + len(words))))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for text in texts:
            if not text or not self.model.langs or not any(map(str.isalpha, text)):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            words = _WORDS(text.lower())
            if fresh := set(words).difference(self.at):
                fresh = sorted(fresh)
                if len(self.at) + len(fresh) > self.most:
                    self.clear()
                    fresh = sorted(set(words))
                self.learn(fresh)
            total = self.sums[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0)
            p = softmax(((total[:-1] / max(total[-1], 1) + self.model.bias) / self.model.temperature)[None])[0]
            best = int(p.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(p[best]))
        return langs, scores


def fit(df: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 2000, sample_bytes: int = 64 << 20) -> Trained:
    """Trains on at most ``sample`` rows of those that ``learn_from`` picks, evenly over all languages; on one each, where there are more languages.

    Of their texts at most ``sample_bytes`` characters are read, whole texts in the order of a hash.
    """
    known = df.where(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"))
    n_langs = counts.count()
    if not n_langs:
        return Trained([], np.zeros((1, 0), np.float32), np.zeros(0, np.float32), 1)
    each = max(1, sample // n_langs)
    # A row for each language, as the model has; so few are sent to the rows.
    shares = counts.select("_lang", (F.least(F.lit(1.0), F.lit(1.5 * each) / F.col("_n")) * (1 << 32)).cast("long").alias("_share"))
    sampled = known.select(F.col(text).cast("string").alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h")).join(F.broadcast(shares), F.col("l") == F.col("_lang"))
    near = sampled.where(F.pmod("h", F.lit(1 << 32)) < F.col("_share")).select("t", "l", "h")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("r") <= each)
    return trained_in_one_task(ranked.select("t", "l", "h"), lambda texts, langs, _: train(texts, langs), sample_bytes)


def identify(df: DataFrame, model: Trained, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its calibrated probability; columns of these names are carried as ``<name>_in``.

    Only texts go to the workers and only these two come back: other columns, and the texts, stay in the JVM.
    """
    df, text = make_room(df, [*names, "_told"], text)
    slim_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def told(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for column in parts:
            langs, scores = scorer(column.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    # Not to be evaluated once for each use.
    found = df.withColumn("_told", told.asNondeterministic()(F.col(text).cast("string")))
    return found.select(*df.columns, F.col("_told.lang").alias(names[0]), F.col("_told.score").alias(names[1]))


def accepted(df: DataFrame, model: Trained, text: str = "text") -> DataFrame:
    """The rows whose language is told with a score that is not rejected; columns as they were."""
    found = identify(df, model, text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= model.reject_below))
    return found.select(*(F.col(c).alias(name) for c, name in zip(found.columns, df.columns)))
