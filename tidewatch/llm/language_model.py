"""Language-model scoring: a gated recurrent network in numpy, trained by truncated backpropagation, with a class-factored softmax.

Tokens are words (bytes other than white space, A-Z lower-cased) and one end per text.  Counts over all training texts give the
unigram baseline, the classes and the distribution inside large classes.  A word's probability is that of its class, which the
network predicts, times that of the word in its class: predicted for classes of at most ``SMALL`` words, by counts for larger ones.
The vocabulary is the most frequent words that make up ``COVERED`` of all tokens, and classes and input vectors grow with it.  Words
beyond it are one class, whose words and one unseen word share it by count plus a half, so the whole is a distribution over the
same words as the baseline.  Texts run through lanes; the state is carried from window to
window to the end of a text, so that a long text's likelihood is that of the complete text.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .scratch import Scratch
from .words import as_bytes, distinct_words, slices

#: Share of the tokens that the vocabulary, which every task knows with its counts, makes up; and the words that it holds at most.
COVERED, MOST = 0.85, 1_000_000
#: Words of the vocabulary that a class may hold to be predicted word by word.
SMALL = 64
HIDDEN = 24
#: Tokens of a window in training; lanes of the start-up model, of training and of scoring.
WINDOW, FIRST_LANES, LANES, SCORE_LANES = 16, 64, 256, 256
#: Tokens, and texts at most, that the common starting point is trained on, in one task; from there every task learns from all of its texts.
WARM_UP, FIRST_TEXTS = 150_000, 1_000
#: Bytes of text whose lanes run at a time, in training and in scoring.
TOGETHER, SCORE_TOGETHER = 32 << 20, 8 << 20
#: Words that a counting task holds before it hands them on.
HELD = 500_000


class Vocabulary:
    """Ids of the frequent words, their classes by equal shares of the tokens, and what counts say inside each class."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int):
        if "" not in words:  # the end of a text is always known by name
            words, counts = [*words, ""], [*counts, 0]
        self.total, self.distinct = total, distinct
        self.denominator = total + 0.5 * (distinct + 1)
        self.id = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(words)}
        self.end = self.id[b""]
        c = np.array(counts, np.float64).reshape(-1) + 0.5
        self.count = c - 0.5
        n = self.n = len(words)
        wanted = max(64, round(5 * n**0.25))
        self.inputs = max(1_000, round(n ** (2 / 3)))  # words with an input vector of their own; others share their class's
        share = np.cumsum(c) / self.denominator
        cls = np.minimum((share * wanted).astype(int), wanted - 2)
        _, cls = np.unique(cls, return_inverse=True)
        self.tail = int(cls.max()) + 1  # the class of all other words
        self.classes = self.tail + 1
        self.cls = np.append(cls, self.tail).astype(np.int32)
        self.first = np.searchsorted(self.cls, np.arange(self.classes + 1)).astype(np.int64)
        size = np.diff(self.first)
        self.small = (size <= SMALL) & (np.arange(self.classes) < self.tail)
        mass = np.array([c[self.first[k] : self.first[k + 1]].sum() for k in range(self.tail)])
        self.tail_mass = max(self.denominator - c.sum(), 0.5)
        # log p(word | class) by counts; for the tail only its denominator, since a word's count is found elsewhere.
        self.inside = np.append(np.log(c / mass[cls]), -math.log(self.tail_mass))
        self.inside[:-1][self.small[cls]] = 0.0
        self.predicted = int(self.first[np.flatnonzero(self.small)[-1] + 1]) if self.small.any() else 0
        self.small[: len(self.small)] &= self.first[1:] <= self.predicted
        self.input = np.where(np.arange(n + 1) < self.inputs, np.arange(n + 1), self.inputs + self.cls).astype(np.int32)
        self.input[n] = self.inputs + self.tail

    def ids(self, texts: list[bytes], named: bool = False):
        """(each text's ids with its end, if ``named`` the others' texts, words and counts in order of the texts); words outside the vocabulary have the id n."""
        out, others, owner, times = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in slices(texts):
            words, which, first = distinct_words(texts[a:b])
            known = np.fromiter((self.id.get(w, self.n) for w in words), np.int32, len(words))
            which = which.astype(np.int64)
            ids = np.insert(known[which] if len(words) else np.zeros(0, np.int32), first[1:], self.end)
            out += np.split(ids, first[1:-1] + np.arange(1, b - a))
            if not named:
                continue
            rare = np.flatnonzero(known[which] == self.n) if len(words) else which
            text = np.searchsorted(first, rare, side="right") - 1
            pair, count = np.unique(text * len(words) + which[rare], return_counts=True)
            others += [words[k] for k in (pair % max(1, len(words))).tolist()]
            owner.append(a + pair // max(1, len(words)))
            times.append(count)
        return out, (np.concatenate(owner), others, np.concatenate(times))


class Network:
    """Gated recurrent units over lanes of tokens.  Parameters are float32 arrays, in one vector for averaging."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None):
        self.v, h = v, HIDDEN
        self.shapes = {"e": (v.inputs + v.classes + 1, 3 * h), "u": (h, 2 * h), "un": (h, h), "wc": (h, v.classes), "bc": (v.classes,), "ww": (v.predicted, h), "bw": (v.predicted,)}
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        fresh = flat is None
        if fresh:
            flat = (np.random.default_rng(3).standard_normal(size) * 0.1).astype(np.float32)
        self.flat = flat.astype(np.float32).copy()
        self.p = self.views(self.flat)
        if fresh:  # no opinion yet on top of the counts
            self.p["wc"][:], self.p["ww"][:] = 0, 0

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of a vector of all parameters."""
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    def start_from_counts(self) -> None:
        """Biases from counts, so that training begins at the unigram distribution."""
        v = self.v
        mass = np.array([(v.count[v.first[k] : v.first[k + 1]] + 0.5).sum() for k in range(v.tail)] + [v.tail_mass])
        self.p["bc"][:] = np.log(mass / mass.sum())
        self.p["bw"][:] = np.log(v.count[: v.predicted] + 0.5)

    def step(self, x: np.ndarray, h: np.ndarray):
        k = HIDDEN
        rz = h @ self.p["u"]
        rz += x[:, : 2 * k]
        np.maximum(rz, -60, out=rz)  # far beyond what is met; keeps the exponential finite
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        r, z = rz[:, :k], rz[:, k:]
        n = np.tanh(x[:, 2 * k :] + (r * h) @ self.p["un"])
        return n + z * (h - n), r, z, n

    def states(self, tokens: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States before each token of a (steps, lanes) window and the one after it.  ``fresh`` marks where a text begins."""
        x = self.p["e"][self.v.input[tokens]]
        hs = np.empty((*tokens.shape, HIDDEN), np.float32)
        parts = np.empty((3, *hs.shape), np.float32) if keep else None
        for t in range(len(tokens)):
            if fresh[t].any():
                h = h * ~fresh[t][:, None]
            hs[t] = h
            h, r, z, n = self.step(x[t], h)
            if keep:
                parts[0, t], parts[1, t], parts[2, t] = r, z, n
        return hs, h, parts

    def logits(self, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the classes' logits, 60 at most, so that their exponentials stay finite; the states with a one behind each, for the biases)."""
        one = np.empty((len(hs), HIDDEN + 1), np.float32)
        one[:, :HIDDEN], one[:, HIDDEN] = hs, 1
        weights = np.vstack((self.p["wc"], self.p["bc"]))
        out = one @ weights
        # States are within -1 and 1, so that weights that cannot reach the bound need no look at each logit.
        if np.abs(self.p["wc"]).sum(axis=0).max(initial=0) + self.p["bc"].max(initial=0) > 60:
            np.minimum(out, 60, out=out)
        return out, one

    def log_p(self, hs: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """log p of each token given the state before it (the tail's words up to their own count)."""
        v = self.v
        logits, one = self.logits(hs)
        cls = v.cls[tokens]
        out = logits[np.arange(len(tokens)), cls] + v.inside[tokens]
        out -= np.log(np.exp(logits, out=logits) @ np.ones(v.classes, np.float32))
        order, classes = self._by_class(cls)
        one, tok, add = one[order], tokens[order], np.empty(len(order), np.float32)
        weights, far = self.words()
        for a, b, k in classes:
            i, j = v.first[k], v.first[k + 1]
            q = self.within(one[a:b], weights[i:j], far)
            add[a:b] = np.log(q[np.arange(b - a), tok[a:b] - i] / (q @ np.ones(j - i, np.float32)))
        out[order] += add
        return out

    def words(self) -> tuple[np.ndarray, bool]:
        """(the predicted words' weights with their bias behind, whether states can bring a logit farther than 40 from its bias)."""
        ww = self.p["ww"]
        return np.hstack((ww, self.p["bw"][:, None])), bool(np.abs(ww).sum(axis=1).max(initial=0) > 40)

    @staticmethod
    def within(one: np.ndarray, weights: np.ndarray, far: bool) -> np.ndarray:
        """The words of a class given states with a one behind each, not summing up to 1 yet."""
        q = one @ weights.T
        q -= q.max(axis=1, keepdims=True) if far else weights[:, -1].max()  # either way the greatest exponential is far from 0 and finite
        return np.exp(q, out=q)

    def _by_class(self, cls):
        """(tokens in order of those small classes that hold several words, where each class begins and ends among them and its number)."""
        v = self.v
        order = np.argsort(cls.astype(np.uint16) if v.classes < 1 << 16 else cls, kind="stable")  # short numbers are sorted by radix
        edge = np.searchsorted(cls[order], np.arange(v.classes + 1))
        # A word that is a class of its own is certain in it, whatever the weights, and has no gradient there.
        several = np.flatnonzero(v.small & (np.diff(v.first) > 1) & (np.diff(edge) > 0))
        at = np.concatenate(([0], np.cumsum(np.diff(edge)[several])))
        order = np.concatenate([order[:0], *(order[edge[k] : edge[k + 1]] for k in several)])
        return order, list(zip(at[:-1].tolist(), at[1:].tolist(), several.tolist(), strict=True))

    def gradient(self, tokens: np.ndarray, fresh: np.ndarray, live: np.ndarray, h0: np.ndarray):
        """(gradient of the window's mean loss, state after it).  Nothing flows back beyond the window."""
        v, k = self.v, HIDDEN
        hs, after, parts = self.states(tokens, fresh, h0, keep=True)
        flat_h, tok, on = hs.reshape(-1, k), tokens.reshape(-1), live.reshape(-1)
        scale = np.float32(1 / max(1, on.sum()))
        grad = np.zeros_like(self.flat)
        g = self.views(grad)
        p, one = self.logits(flat_h)
        np.exp(p, out=p)
        cls, weight = v.cls[tok], on * scale
        p *= (weight / (p @ np.ones(v.classes, np.float32)))[:, None]
        p[np.arange(len(tok)), cls] -= weight
        both = one.T @ p
        g["wc"][:], g["bc"][:] = both[:-1], both[-1]
        dh_out = p @ self.p["wc"].T
        order, classes = self._by_class(np.where(on, cls, v.tail))
        one, words, back = one[order], tok[order], np.empty((len(order), k), np.float32)
        weights, far = self.words()
        for a, b, c in classes:
            i, j = v.first[c], v.first[c + 1]
            q = self.within(one[a:b], weights[i:j], far)
            q *= (scale / (q @ np.ones(j - i, np.float32)))[:, None]
            q[np.arange(b - a), words[a:b] - i] -= scale
            both = q.T @ one[a:b]
            g["ww"][i:j], g["bw"][i:j] = both[:, :-1], both[:, -1]
            np.matmul(q, self.p["ww"][i:j], out=back[a:b])
        dh_out[order] += back
        dh_out = dh_out.reshape(hs.shape)
        # All that needs no gradient is worked out for the whole window at once; the loop back in time does the rest.
        r, z, n = parts
        to_n, to_r, to_z = (1 - z) * (1 - n * n), hs * r * (1 - r), (hs - n) * z * (1 - z)
        dx = np.empty((*tokens.shape, 3 * k), np.float32)
        dh = np.zeros_like(h0)
        for t in range(len(tokens) - 1, -1, -1):
            d = dx[t]
            dn = np.multiply(dh, to_n[t], out=d[:, 2 * k :])
            drh = dn @ self.p["un"].T
            np.multiply(drh, to_r[t], out=d[:, :k])
            np.multiply(dh, to_z[t], out=d[:, k : 2 * k])
            dh = dh * z[t]
            dh += drh * r[t]
            dh += d[:, : 2 * k] @ self.p["u"].T
            dh += dh_out[t]
            if fresh[t].any():
                dh = dh * ~fresh[t][:, None]
        flat_dx = dx.reshape(-1, 3 * k)
        g["un"][:] = (r * hs).reshape(-1, k).T @ flat_dx[:, 2 * k :]
        g["u"][:] = flat_h.T @ flat_dx[:, : 2 * k]
        at = v.input[tok]
        order = np.argsort(at.astype(np.uint16) if len(self.p["e"]) < 1 << 16 else at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        g["e"][at[first]] = np.add.reduceat(flat_dx[order], first)
        return grad, after


def lanes(lengths: list[int], n: int) -> list[list[int]]:
    """Texts dealt to at most ``n`` lanes, longest first, always to the shortest lane."""
    heap = [(0, i) for i in range(max(1, min(n, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for t in sorted(range(len(lengths)), key=lambda t: -lengths[t]):
        size, i = heapq.heappop(heap)
        out[i].append(t)
        heapq.heappush(heap, (size + lengths[t], i))
    return out


class Lanes:
    """Texts dealt to lanes, end to end; windows of them are cut out as they are needed, so that a long text costs no padding."""

    def __init__(self, texts: list[np.ndarray], n: int):
        # The longest lane first: the live ones of a step are then the first so many.
        dealt = sorted(lanes([len(t) for t in texts], n), key=lambda lane: -sum(len(texts[t]) for t in lane))
        order = [t for lane in dealt for t in lane]
        size = np.array([len(texts[t]) for t in order], np.int64)
        self.token = np.concatenate([texts[t] for t in order]) if order else np.zeros(0, np.int32)
        self.owner = np.repeat(np.array(order, np.int32), size)
        self.begins = np.zeros(len(self.token), bool)
        self.begins[np.cumsum(size) - size] = True
        self.length = np.array([sum(len(texts[t]) for t in lane) for lane in dealt], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.steps = int(self.length[0]) if order else 0

    def windows(self, size: int) -> Iterator[tuple[int, int]]:
        """(first step, steps) of all windows: ``size`` steps, and more behind most lanes' ends, where a window of few lanes holds few tokens."""
        t = 0
        while t < self.steps:
            live = int(np.searchsorted(-self.length, -t, side="left"))
            steps = size * max(1, len(self.length) // (8 * live))
            yield t, steps
            t += steps

    def window(self, t: int, size: int):
        """(tokens, fresh, live, owner) of shape (steps, lanes) from step ``t`` on, for the lanes that reach it."""
        k = int(np.searchsorted(-self.length, -t, side="left"))
        step = t + np.arange(min(size, self.steps - t))[:, None]
        live = step < self.length[:k]
        at = np.where(live, self.offset[:k] + step, self.offset[:k])
        return self.token[at], self.begins[at] & live, live, self.owner[at]


class Adam:
    """Updates of a network's parameters; its averages outlast a call of ``learn``."""

    def __init__(self, net: Network):
        self.net, self.i = net, 0
        self.m, self.s, self.a = np.zeros_like(net.flat), np.zeros_like(net.flat), np.zeros_like(net.flat)

    def update(self, g: np.ndarray, pace: float) -> None:
        self.i += 1
        g *= min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-6))
        a = self.a  # in place: parameters are many, and new arrays cost as much as the sums
        self.m *= 0.9
        self.m += np.multiply(g, 0.1, out=a)
        self.s *= 0.99
        g *= g
        self.s += np.multiply(g, 0.01, out=a)
        np.sqrt(self.s, out=a)
        a *= 1 / math.sqrt(1 - 0.99**self.i)
        a += 1e-4
        np.divide(self.m, a, out=a)
        a *= pace / (1 - 0.9**self.i)
        self.net.flat -= a


def learn(adam: Adam, texts: list[np.ndarray], rate: float, n: int = LANES) -> None:
    """One pass over texts by windows, at a falling pace; the state, not the gradient, crosses from window to window."""
    dealt = Lanes(texts, n)
    h = np.zeros((len(dealt.length), HIDDEN), np.float32)
    for t, size in dealt.windows(WINDOW):
        tokens, fresh, live, _ = dealt.window(t, size)
        g, h = adam.net.gradient(tokens, fresh, live, h[: tokens.shape[1]])
        adam.update(g, rate * (1 - 0.9 * t / dealt.steps))


def score_texts(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural-log likelihood of each complete text."""
    dealt = Lanes(texts, SCORE_LANES)
    out = np.zeros(len(texts))
    h = np.zeros((len(dealt.length), HIDDEN), np.float32)
    for t, size in dealt.windows(32):
        tokens, fresh, on, who = dealt.window(t, size)
        hs, h, _ = net.states(tokens, fresh, h[: tokens.shape[1]])
        out += np.bincount(who[on], net.log_p(hs[on], tokens[on]), minlength=len(texts))
    return out


def word_counts(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(w, c): how often each token stands in all texts, the end as the empty word."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pd.DataFrame({"w": [w.decode("utf-8", "surrogatepass") for w in held], "c": list(held.values())})

        for pdf in batches:
            for t in pdf["text"]:
                held.update(as_bytes(t).split())
                if len(held) > HELD:
                    yield out()
                    held.clear()
            if len(pdf):
                held[b""] += len(pdf)
        if held:
            yield out()

    return scratch.save(documents.select("text").mapInPandas(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c")))


def vocabulary_of(counts: DataFrame, total: int, distinct: int, covered: float, most: int) -> Vocabulary:
    """The words that occur most often, as many as make up ``covered`` of the tokens but ``most`` at most, and the end.

    Counts are first summed up by steps of an eighth of a doubling, a few hundred rows; words of the same step come together.
    """
    step = F.floor(8 * F.log2("c"))
    have, words, least = 0, 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if have >= covered * total or words + r.n > most:
            break
        have, words, least = have + r.c, words + r.n, r.step
    wanted = (F.col("w") == "") if least is None else (F.col("w") == "") | (step >= least)
    top = sorted(((-r.c, r.w) for r in counts.where(wanted).collect()))
    return Vocabulary([w for _, w in top], [-c for c, _ in top], total, distinct)


def train(documents: DataFrame, vocabulary, scratch: Scratch) -> np.ndarray:
    """Weights from all texts of ``documents``.

    A start-up model is trained in one task on a few hundred different texts picked by their hash, whatever the corpus; from it each task learns
    from all of its own texts, and the results are averaged by the tokens behind them, sixteen at a time until few are left.  As ever with
    stochastic gradients, the order and partitioning of the texts has its part in the weights.
    """

    def start(batches):
        net, texts, size = Network(vocabulary.value), [], 0
        net.start_from_counts()
        for pdf in batches:
            for t in vocabulary.value.ids([as_bytes(t) for t in pdf["text"]])[0]:
                if size < WARM_UP:
                    texts.append(t)
                    size += len(t)
        if texts:
            learn(Adam(net), texts, 0.02, FIRST_LANES)
            yield pd.DataFrame({"w": [net.flat.tobytes()]})

    v = vocabulary.value
    share = min(1_000_000, -(-2_000_000 * FIRST_TEXTS // max(1, int(v.count[v.end]))))
    few = documents.where("text is not null").withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1_000_000)) < share)
    first = few.dropDuplicates(["h"]).orderBy("h").limit(FIRST_TEXTS).select("text").mapInPandas(start, "w binary").first()
    if first is None:
        net = Network(v)
        net.start_from_counts()
        first = [net.flat.tobytes()]
    begin = documents.sparkSession.sparkContext.broadcast(bytes(first[0]))

    def more(batches):
        net, size, part = Network(vocabulary.value, np.frombuffer(begin.value, np.float32)), 0, 0
        adam = Adam(net)
        for pdf in batches:
            raw = [as_bytes(t) for t in pdf["text"]]
            for a, b in slices(raw, TOGETHER):
                texts, _ = net.v.ids(raw[a:b])
                size += sum(map(len, texts))
                learn(adam, texts, 0.004)
                part = int(pdf["part"].iloc[0])
        if size:
            yield pd.DataFrame({"w": [net.flat.tobytes()], "n": [size], "part": [part]})

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        w = sum(np.frombuffer(w, np.float32).astype(np.float64) * (k / n) for w, k in zip(pdf["w"], pdf["n"], strict=True))
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "n": [n], "part": [int(pdf["part"].min())]})

    schema = "w binary, n long, part long"
    got = scratch.save(documents.select("text", F.spark_partition_id().cast("long").alias("part")).mapInPandas(more, schema))
    while (n := got.count()) > 16:
        got = scratch.save(got.groupBy(F.pmod(F.xxhash64("part"), F.lit(-(-n // 16))).alias("g")).applyInPandas(average, schema))
    parts = got.collect()
    if not parts:
        return np.frombuffer(begin.value, np.float32)
    total = sum(p.n for p in parts)
    return sum(np.frombuffer(p.w, np.float32) * (p.n / total) for p in parts).astype(np.float32)


def score(documents: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", covered: float = COVERED, most: int = MOST) -> DataFrame:
    """For each row of ``documents``: id, n_tokens, n_known, train_tokens, base_score and score (log10).

    Counts and the network come from all rows of ``training``.  Null and empty texts are one end token.  Rows stand for themselves,
    so repeated or null ids are scored row by row; with no training rows every token is
    unseen: base_score is 0, and score is that of a coin for each token, log10(0.5).
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "language-model")
    known = training.select(F.col(text_col).alias("text"))
    counts = word_counts(known, scratch)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    v = vocabulary_of(counts, total, distinct, covered, most)
    vocabulary = spark.sparkContext.broadcast(v)
    weights = spark.sparkContext.broadcast(train(known, vocabulary, scratch))

    def run(batches):
        v = vocabulary.value
        net = Network(v, weights.value)
        log_c = np.append(np.log10(v.count + 0.5), 0.0)
        for pdf in batches:
            raw = [as_bytes(t) for t in pdf["text"]]
            for a, b in slices(raw, SCORE_TOGETHER):
                texts, (owner, rare, times) = v.ids(raw[a:b], named=True)
                # Words hold no space, so that one string takes those of a text.
                edge, times = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist(), times.astype(np.int32)
                rare = [b" ".join(rare[i:j]).decode("utf-8", "surrogatepass") if i < j else None for i, j in zip(edge, edge[1:], strict=False)]
                times = [times[i:j] for i, j in zip(edge, edge[1:], strict=False)]
                yield pd.DataFrame(
                    {
                        "row": pdf["row"].to_numpy()[a:b],
                        "id": pdf["id"].to_numpy()[a:b],
                        "n_tokens": [len(t) for t in texts],
                        "n_top": [int((v.count[t[t < v.n]] > 0).sum()) for t in texts],
                        "base": [float(log_c[t].sum()) for t in texts],
                        "net": score_texts(net, texts),
                        "rare": rare,
                        "times": times,
                    }
                )

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    scored = scratch.save(rows.mapInPandas(run, f"row long, id {kind}, n_tokens long, n_top long, base double, net double, rare string, times array<int>"))
    each = scored.where("rare is not null").select("row", F.explode_outer(F.arrays_zip(F.split("rare", " ").alias("w"), F.col("times").alias("n"))).alias("x"))
    each = each.select("row", "x.w", "x.n").join(counts, "w", "left")
    rare = each.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"))
    out = scored.drop("rare", "times").join(rare, "row", "left").fillna(0, ["s", "k"])
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_top") + F.col("k")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("s") - F.col("n_tokens") * F.lit(math.log10(v.denominator))).alias("base_score"),
        (F.col("net") / F.lit(math.log(10)) + F.col("s")).alias("score"),
    )


def digest(documents: DataFrame) -> DataFrame:
    """The registered query: learn from texts outside the held-out fifth, score everything."""
    out = score(documents, documents.where(~held_out("doc_id", 5, 1)))
    return out.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
