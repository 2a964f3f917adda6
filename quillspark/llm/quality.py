"""Quality scores: random-indexing word vectors, pooled, then a small network.

A term is a token (between white space) in small letters, with runs of one
character shortened, or a mark of its shape: capitals, digits, symbols, length,
and whether it repeats the token before.  Random indexing gives each term a sparse
ternary index vector, fixed by a hash.  A term's context vector is the sum of the
index vectors of the terms beside it in the training texts; its word vector joins
both.  A text's vector is the mean over all its terms, of the whole text.

A network of two layers in numpy turns it into a probability; a part of the
training sample sets the temperature.  The sample is bounded (``sample`` labelled
rows and ``unlabelled`` more, up to ``sample_bytes``) and read in one task; all of its
terms have a context vector, other terms have their index vector alone.  Texts are
scored whole.

An empty or null text has the score that the network gives to the zero vector.
A label other than 0 or 1, or null, teaches nothing; of two labels of an id the
greater counts.  Without labels or documents all scores are one half.  Repeated rows
are each scored, alike; an empty table gives none; a column that is called like the
score is carried as ``<name>_in``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import batches, make_room, slim_batches, trained_in_one_task

DIM, _ONES, _SHAPE = 96, 8, 5
REPEAT = "\x00repeat"
_RUN = re.compile(r"(.)\1{2,}", re.S)


def shape_terms(token: str) -> list[str]:
    """Terms of one token: itself, and marks of its shape."""
    if token.isalpha():
        letters, marks, kind = len(token), "", "a"
    else:
        letters = sum(map(str.isalpha, token))
        marks = "".join(sorted({c for c in token if not c.isalnum()}))[:4]
        kind = "m" if letters else "d" if any(map(str.isdigit, token)) else "s"
    case = "u" if letters > 1 and token.isupper() else "t" if token[0].isupper() else "l"
    return [_RUN.sub(r"\1\1", token.lower()), f"\x00case {case}", f"\x00marks {marks}", f"\x00size {min(len(token), 24) // 3}", f"\x00kind {kind}"]


def index_vectors(terms: list[str]) -> np.ndarray:
    """Sparse ternary vectors, fixed by each term's hash."""
    import xxhash

    out = np.zeros((len(terms), DIM), np.float32)
    state = np.fromiter((xxhash.xxh3_64_intdigest(t.encode()) for t in terms), np.uint64, len(terms))
    at = np.arange(len(terms))
    with np.errstate(over="ignore"):
        for _ in range(_ONES):
            state = state * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
            out[at, ((state >> np.uint64(33)) % np.uint64(DIM)).astype(np.int64)] += np.where(state >> np.uint64(63), 1, -1)
    return out / np.float32(_ONES**0.5)


class Model:
    """The network; and of the sample's terms, what each adds to the hidden layer."""

    def __init__(self, names: list[str], table: np.ndarray, net: tuple[np.ndarray, ...], temperature: float):
        self.names, self.table, self.net, self.temperature = "\n".join(names), table, net, temperature  # terms hold no white space
        self.place: dict[str, int] | None = None

    def hidden_vectors(self, terms: list[str]) -> np.ndarray:
        """What each term adds to the hidden layer; as pooling is linear, means of these will do."""
        if self.place is None:
            self.place = {t: i for i, t in enumerate(self.names.split("\n"))} if self.names else {}
        at = np.fromiter((self.place.get(t, -1) for t in terms), np.int64, len(terms))
        _, scale, w1, *_ = self.net
        out = np.empty((len(terms), w1.shape[1]), np.float32)
        out[at >= 0] = self.table[at[at >= 0]]
        other = np.flatnonzero(at < 0)
        out[other] = index_vectors([terms[i] for i in other]) @ (w1 / scale[:, None])[:DIM].astype(np.float32)
        return out

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        """From means of :meth:`hidden_vectors`."""
        mean, scale, w1, b1, w2, b2 = self.net
        logits = np.tanh(pooled - mean / scale @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -500, 500)))


class Pooler:
    """Means of term vectors over whole texts; tokens that come again are kept, in bounded memory."""

    def __init__(self, vectors, most: int = 250_000):
        self.vectors, self.most = vectors, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, self.vectors([REPEAT]).shape[1]), np.float32)

    def learn(self, tokens: list[str]) -> None:
        terms = [t for token in tokens for t in shape_terms(token)]
        distinct = list(dict.fromkeys(terms))
        place = {t: i for i, t in enumerate(distinct)}
        found = self.vectors(distinct)
        rows = found[np.fromiter((place[t] for t in terms), np.int64, len(terms))].reshape(len(tokens), _SHAPE, -1).sum(1)
        first = len(self.at)
        while len(self.table) < first + len(tokens):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(tokens)] = rows
        self.at.update(zip(tokens, range(first, first + len(tokens))))

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.table.shape[1]), np.float64)
        again = self.vectors([REPEAT])[0]
        for i, text in enumerate(texts):
            tokens = text.split()
            if not tokens:
                continue
            if fresh := set(tokens).difference(self.at):
                if len(self.at) + len(fresh) > self.most:
                    self.clear()
                    fresh = set(tokens)
                self.learn(sorted(fresh))
            at = np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))
            found, counts = np.unique(at, return_counts=True)
            repeats = int((at[1:] == at[:-1]).sum())
            out[i] = (counts @ self.table[found] + repeats * again) / len(tokens)
        return out


def context_vectors(texts: list[str], span: int = 2) -> dict[str, np.ndarray]:
    """Random indexing over the texts: each term's sum of its neighbours' index vectors, to length one."""
    number: dict[str, int] = {}
    lists = [np.array([number.setdefault(token, len(number)) for token in text.split()], np.int64) for text in texts]
    tokens = list(number)
    shapes = [shape_terms(t) for t in tokens]
    first = index_vectors([x[0] for x in shapes])
    near = np.zeros((len(tokens), DIM), np.float32)
    codes = [np.zeros(0, np.int64)]
    for d in range(1, span + 1):
        codes += [x for at in lists for x in (at[d:] * len(tokens) + at[:-d], at[:-d] * len(tokens) + at[d:])]
    pairs, counts = np.unique(np.concatenate(codes), return_counts=True)
    for lo in range(0, len(pairs), 1 << 17):
        mine, beside = np.divmod(pairs[lo : lo + (1 << 17)], len(tokens))
        rows, starts = np.unique(mine, return_index=True)
        near[rows] += np.add.reduceat(first[beside] * counts[lo : lo + (1 << 17), None].astype(np.float32), starts)
    place: dict[str, int] = {}
    term = np.array([place.setdefault(t, len(place)) for x in shapes for t in x], np.int64)
    by = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by], np.arange(len(place)))
    out = np.zeros((len(place), DIM), np.float32)
    for lo in range(0, len(place), 1 << 14):
        hi = min(lo + (1 << 14), len(place))
        end = starts[hi] if hi < len(place) else len(by)
        out[lo:hi] = np.add.reduceat(near[by[starts[lo] : end] // _SHAPE], starts[lo:hi] - starts[lo])
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)
    return dict(zip(place, out))


def train(texts: list[str], labels: list[int | None], hidden: int = 32, epochs: int = 60, seed: int = 5) -> Model:
    """Learns context vectors from all texts, the network from four fifths of those with a label, and calibrates on the rest."""
    context = context_vectors(texts)

    def term_vectors(terms: list[str]) -> np.ndarray:
        nothing = np.zeros(DIM, np.float32)
        return np.concatenate([index_vectors(terms), np.array([context.get(t, nothing) for t in terms], np.float32).reshape(-1, DIM)], 1)

    known = [i for i, y in enumerate(labels) if y is not None]
    labels = [labels[i] for i in known]
    x = Pooler(term_vectors, most=60_000)([texts[i] for i in known])
    y = np.array(labels, np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    check, learn = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    mean, scale = x[learn].mean(0), x[learn].std(0) + 1e-3
    z = (x - mean) / scale
    d = z.shape[1]
    net = [rng.standard_normal((d, hidden)) / d**0.5, np.zeros(hidden), rng.standard_normal(hidden) / hidden**0.5, np.zeros(1)]
    moment, square = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    best, kept, t = np.inf, [p.copy() for p in net], 0
    loss_of = lambda at, temperature=1.0: float(np.mean(np.logaddexp(0, -(2 * y[at] - 1) * (np.tanh(z[at] @ net[0] + net[1]) @ net[2] + net[3]) / temperature)))
    for _ in range(epochs):
        for lo in range(0, len(learn), 64):
            at = rng.permutation(learn)[:64] if lo == 0 and len(learn) <= 64 else learn[lo : lo + 64]
            h = np.tanh(z[at] @ net[0] + net[1])
            g = (1 / (1 + np.exp(-(h @ net[2] + net[3]))) - y[at]) / len(at)
            back = np.outer(g, net[2]) * (1 - h * h)
            grads = [z[at].T @ back + 1e-3 * net[0], back.sum(0), h.T @ g + 1e-3 * net[2], np.array([g.sum()])]
            t += 1
            for p, q, m, v in zip(net, grads, moment, square):
                m += 0.1 * (q - m)
                v += 0.001 * (q * q - v)
                p -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        learn = rng.permutation(learn)
        if (now := loss_of(check)) < best:
            best, kept = now, [p.copy() for p in net]
    net = kept
    grid = np.geomspace(0.25, 8, 80)
    temperature = float(grid[int(np.argmin([loss_of(check, s) for s in grid]))])
    names = list(context)
    weights = (net[0] / scale[:, None]).astype(np.float32)
    # Half precision: the model is sent to all workers, and texts are means over many terms.
    table = np.concatenate([np.zeros((0, hidden), np.float16), *((term_vectors(names[lo : lo + 4096]) @ weights).astype(np.float16) for lo in range(0, len(names), 4096))])
    return Model(names, table, (mean, scale, *net), temperature)


def fit(df: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 2500, unlabelled: int = 500, sample_bytes: int = 64 << 20) -> Model | None:
    """Trains on about ``sample`` labelled rows that ``learn_from`` (over the key) picks, chosen by a hash of the key.

    Context vectors are learned from these and from ``unlabelled`` more rows that it picks.
    Of all their texts at most ``sample_bytes`` characters are read, labelled ones first.
    """
    known = labels.where(learn_from & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    n, rows = known.count(), df.count()
    if not n or not rows:
        return None
    by = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 32))
    picked = known.where(by < int(min(1.0, sample / n) * (1 << 32)))  # about ``sample`` rows of two numbers: safe to broadcast
    texts = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.col(key))
    ours = texts.join(F.broadcast(picked), key).select("t", "y", F.xxhash64(F.col(key).cast("string"), "t").alias("h")).limit(2 * sample)
    others = texts.where(learn_from & (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("more")), F.lit(1 << 32)) < int(min(1.0, unlabelled / rows) * (1 << 32))))
    others = others.select("t", F.lit(None).cast("int").alias("y"), F.xxhash64(F.col(key).cast("string"), "t").alias("h")).limit(unlabelled)
    rows = ours.unionByName(others).select("t", "y", "h", F.col("y").isNull().alias("more"))
    return trained_in_one_task(rows, lambda texts, y, *_: train(texts, y) if any(x is not None for x in y) else None, sample_bytes)


def score(df: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of a high quality, 0 to 1; a column of this name is carried as ``<name>_in``."""
    df, text = make_room(df, [name], text)
    if model is None:
        return df.withColumn(name, F.lit(0.5))
    slim_batches(df.sparkSession)
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        pool = Pooler(model.hidden_vectors)
        for batch in batches(rows):
            p = model.probabilities(pool([t or "" for t in batch.column(at).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
