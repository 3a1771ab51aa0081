"""Quality classifier from weak labels.

Heuristic labellers vote high, low or nothing on each text; none is right always, and they overlap. How often each is right is
estimated by expectation-maximisation (Dawid and Skene) without any true label: votes are counted by pattern in Spark - at most
3 ** labellers patterns - and the maximisation runs over these counts. The posterior of a text's pattern is its weak label.
A linear scorer over hashed features (byte trigrams and word events, as means over the whole text) is then trained on weak
labels, so it also rates what the labellers leave open.

The scorer is fitted on a bounded sample: about TRAIN_ROWS texts by hash, or as many as hold TRAIN_BYTES. Vote counts, posteriors and scores cover all rows and
whole texts.

Defined results: null, empty and wordless texts get no votes, posterior null, score 0 and are not kept; if no text has a vote,
the scorer is untrained and every other score is 0.5; repeated rows get equal results; input columns named like a result
column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.arrowmap import add_columns, only, text_of
from tracewise.llm.storage import written
from tracewise.llm.textops import SPACED, Words, buffers, mix, slices

TRAIN_ROWS = 4096
TRAIN_BYTES = 16 << 20
SLOTS = 1 << 16
EVENTS = 8

#: Labeller: (measure, low from this bound on, high up to this bound; None: no such vote). Alarms vote only low: that one kind
#: of junk is absent says nothing of the other kinds.
LABELLERS = {
    "symbol_words": ("symbol_words", 0.20, None),
    "pipes": ("pipes", 0.10, None),
    "repeated_words": ("repeated_words", 0.60, None),
    "adjacent_repeats": ("adjacent_repeats", 0.20, None),
    "capitals": ("capitals", 0.50, None),
    "long_words": ("long_words", 0.30, None),
    "not_letters": ("not_letters", 0.30, 0.12),
    "variety": ("sameness", 0.50, 0.10),
    "sentences": ("sentence_words", 120.0, 60.0),
}
FEW_WORDS = 10

FIELDS = [T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&!|<>{}[]=~^_\\@"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _per(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many flags are set in each range between cuts."""
    run = np.concatenate([[0], np.cumsum(flags)])
    return run[cuts[1:]] - run[cuts[:-1]]


class Texts:
    """Words and word events of a few MB of texts."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.off = buffers(column)
        self.words = Words(self.data, self.off, SPACED)
        w = self.words
        self.text = np.repeat(np.arange(len(self.off) - 1), np.diff(w.first))
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (self.text[1:] == self.text[:-1])
        self.same = same
        seen = np.ones(len(w.hash), bool)
        for d in range(len(self.off) - 1):
            a, b = w.first[d], w.first[d + 1]
            seen[a + np.unique(w.hash[a:b], return_index=True)[1]] = False
        self.seen = seen

    def measures(self) -> dict[str, np.ndarray]:
        w, first = self.words, self.words.first
        n = np.maximum(np.diff(first), 1)
        symbol = np.concatenate([[0], np.cumsum(_SYMBOL[self.data])])
        cut = lambda table: np.maximum(_per(table[self.data], self.off), 0)
        letters, capitals, small = cut(_LETTER), cut(_UPPER), cut(_LOWER)
        dense = _per(SPACED[self.data], self.off)
        repeated, adjacent = _per(self.seen, first) / n, _per(self.same, first) / n
        return {
            "words": np.diff(first),
            "symbol_words": _per(symbol[w.end] > symbol[w.start], first) / n,
            "pipes": cut(np.arange(256) == ord("|")) / n,
            "repeated_words": repeated,
            "adjacent_repeats": adjacent,
            "sameness": np.maximum(adjacent, repeated - 0.4),
            "capitals": capitals / np.maximum(capitals + small, 1),
            "not_letters": 1 - letters / np.maximum(dense, 1),
            "long_words": _per(w.end - w.start > 40, first) / n,
            "sentence_words": np.diff(first) / np.maximum(cut(_STOP), 1),
        }

    def votes(self) -> np.ndarray:
        """texts x labellers: 1 high, 0 low, -1 none."""
        m = self.measures()
        out = np.full((len(self.off) - 1, len(LABELLERS)), -1, np.int8)
        for k, (name, low, high) in enumerate(LABELLERS.values()):
            if high is not None:
                out[m[name] <= high, k] = 1
            out[m[name] >= low, k] = 0
        few = m["words"] < FEW_WORDS
        for k, name in enumerate(LABELLERS):
            if name in ("repeated_words", "adjacent_repeats", "variety"):
                out[few, k] = -1
        out[m["words"] == 0] = -1
        return out

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slots of the byte trigrams and of the words, and the n + 1 offsets by text of each."""
        d = np.concatenate([self.data, np.zeros(2, np.uint8)]).astype(np.uint64)
        last = self.off[1:][self.off[1:] > self.off[:-1]] - 1
        second, third = d[1:-1].copy(), d[2:].copy()
        second[last] = third[last] = third[last[last > 0] - 1] = 0  # nothing behind a text
        tri = (mix(d[:-2] << np.uint64(16) | second << np.uint64(8) | third, 3) >> np.uint64(48)).astype(np.int64)
        events = SLOTS + self.same.astype(np.int64) + 2 * self.seen
        return tri, self.off, events, self.words.first


def pattern(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1]))


def unpattern(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


class LabelModel:
    """Prior of high quality, and for each labeller the chances (labeller, class, vote + 1) of its votes; no vote is one of them."""

    def __init__(self, prior: float, chance: np.ndarray) -> None:
        self.prior, self.chance = prior, chance

    def accuracy(self) -> np.ndarray:
        """How often a vote of each labeller is right."""
        low, high = (1 - self.prior) * self.chance[:, 0], self.prior * self.chance[:, 1]
        return (low[:, 1] + high[:, 2]) / (low[:, 1:] + high[:, 1:]).sum(1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of high quality; nan without votes."""
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for k in range(votes.shape[1]):
            odds += np.log(self.chance[k, 1] / self.chance[k, 0])[votes[:, k] + 1]
        out = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        out[(votes < 0).all(1)] = np.nan
        return out


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts. It starts from the vote of the majority, with a vote for low
    weighing twice one for high, as labellers that see one kind of junk are outnumbered by those that don't."""
    some = (votes >= 0).any(1)
    votes, counts = votes[some], counts[some].astype(float)
    k = votes.shape[1]
    if not len(votes):
        return LabelModel(0.5, np.full((k, 2, 3), 1 / 3))
    p = np.where((votes == 1).sum(1) > 2 * (votes == 0).sum(1), 0.95, 0.05)
    model = None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        chance = np.stack([[[weight[c][votes[:, j] == v].sum() + 0.5 for v in (-1, 0, 1)] for c in (0, 1)] for j in range(k)])
        chance /= chance.sum(2, keepdims=True)
        prior = min(max((weight[1].sum() + 1) / (counts.sum() + 2), 0.01), 0.99)
        done = model is not None and np.abs(chance - model.chance).max() < 1e-6
        model = LabelModel(prior, chance)
        if done:
            break
        p = model.posterior(votes)
    return model


def _sparse(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and means of each text, for training."""
    tri, off, events, first = t.slots()
    out = []
    for d in range(len(off) - 1):
        s, c = np.unique(tri[off[d] : off[d + 1]], return_counts=True)
        e, ec = np.unique(events[first[d] : first[d + 1]], return_counts=True)
        out.append((np.concatenate([s, e]), np.concatenate([c / max(1, c.sum()), ec / max(1, ec.sum())])))
    return out


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 60, rate: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft targets (Adam over the whole sample); the last is the constant."""
    w = np.zeros(SLOTS + EVENTS + 1)
    if not rows:
        return w
    slot = np.concatenate([s for s, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[slot] * value, len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(slot, value * error[row], len(w)) / len(rows) + 1e-7 * w
        grad[-1] = error.mean()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


class Model:
    def __init__(self, labels: LabelModel, weights: np.ndarray) -> None:
        self.labels, self.weights = labels, weights

    def rate(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = Texts(column)
        tri, off, events, first = t.slots()
        mean = lambda s, cut: np.diff(np.concatenate([[0.0], np.cumsum(self.weights[s])])[cut]) / np.maximum(np.diff(cut), 1)
        z = mean(tri, off) + mean(events, first) + self.weights[-1]
        empty = np.diff(first) == 0
        score = np.where(empty, 0.0, np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6))
        return t, self.labels.posterior(t.votes()), score


def train(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """The scorer learns from about ``train_rows`` texts, fewer if they'd hold more than about ``train_bytes``; a byte makes one slot of
    12 bytes at most, and a text no more slots than there are. The label model counts the votes on all texts."""
    rows = only(docs, text)

    def count(batches):
        for batch in batches:
            for part in slices(batch, text):
                codes, n = np.unique(pattern(Texts(text_of(part, text)).votes()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["p", "n"])

    got = rows.mapInArrow(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    labels = fit_labels(unpattern(np.array([r.p for r in got], np.int64)), np.array([r.n for r in got], np.int64))
    total = sum(r.n for r in got)
    size = rows.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    every = max(1, total // train_rows, size // train_bytes)

    def sample(batches):
        for batch in batches:
            for part in slices(batch, text):
                t = Texts(text_of(part, text))
                p = labels.posterior(t.votes())
                s = _sparse(t)
                ok = [k for k in range(len(s)) if not np.isnan(p[k])]
                yield pa.RecordBatch.from_arrays([pa.array([s[k][0].astype(np.uint32).tobytes() for k in ok], pa.binary()), pa.array([s[k][1].astype(np.float32).tobytes() for k in ok], pa.binary()), pa.array(p[ok])], names=["s", "v", "p"])

    some = rows.where(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(every)) == 0).distinct()
    got = written(some.mapInArrow(sample, "s binary, v binary, p double"), "quality-sample").orderBy("s", "v").collect()
    weights = fit_scorer([(np.frombuffer(r.s, np.uint32).astype(np.int64), np.frombuffer(r.v, np.float32).astype(float)) for r in got], np.array([r.p for r in got]))
    return Model(labels, weights)


def rate(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with posterior (of the weak label), score (0 to 1) and keep (score at least ``least``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch):
            _, posterior, score = shared.value.rate(text_of(batch, text))
            return [pa.array(posterior, pa.float64(), mask=np.isnan(posterior)), score, (score >= least) & (score > 0)]

        return work

    return add_columns(docs, text, FIELDS, make)
