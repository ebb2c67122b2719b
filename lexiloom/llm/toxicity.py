"""Toxic spans by a linear-chain conditional random field.

Labels mark documents; the field learns from labelled tokens. Words, and their
beginnings and ends, that a bounded sample of labelled documents shows to make a
document toxic say which tokens of toxic documents are labelled toxic; all other
tokens of the sample are labelled clean. The field has two states. Every token
emits: its score adds the weights of hashed features of the word (itself,
beginnings, ends, shape) and of the words before and after it. Emission,
transition and start weights are fitted by gradient ascent on the likelihood of
all lines of the sample.

Forward-backward runs over every token of every text. As there are two states,
a message is one ratio, and all texts of a batch pass side by side: they are cut
into parts of equal length, a part's transfer matrix takes the message at its
border to that at its other border, and with the borders known the parts are
independent. A logistic calibration turns a document's largest marginal, and its
expected number and share of toxic tokens, into its score; tokens of marginals
of a half and more are its spans.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm._shared import arrow_batches, beside

WORD = re.compile(r"[^\W_]+")
PIECE = 1 << 16  # words of a long text that are handled at once
LEAST_STRENGTH = 12.0
OWN, BESIDE = 1 << 16, 1 << 13  # hashed weights of a word's own features, and of a neighbour
STRIDE, CELLS = 512, 1 << 18  # tokens of a part, and of parts that pass side by side
MAX_WORDS = 400_000
APART, TWICE = 4, 2.0  # one in so many texts is kept for the calibration, and how often a toxic one counts there


@dataclass
class Field:
    own: np.ndarray = field(default_factory=lambda: np.zeros(OWN))  # weights for the toxic state; those of the other are zero
    before: np.ndarray = field(default_factory=lambda: np.zeros(BESIDE))
    after: np.ndarray = field(default_factory=lambda: np.zeros(BESIDE))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: float = 0.0
    line: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))  # of the score: constant, largest marginal, log count, root of the share
    learned: bool = False


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3, toxic: float | None = None) -> np.ndarray:
    """Weights with the constant first, by gradient ascent; a toxic row counts ``toxic`` times, or so often that both classes count alike."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    share = np.where(y > 0, (y == 0).sum() / max(1, (y > 0).sum()) if toxic is None else toxic, 1.0)
    share = share / share.sum()
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = x.T @ (share * (y - _sigmoid(x @ w))) - ridge * np.concatenate([[0], w[1:]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def tokens_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    """The word, its beginnings of 3 to 8 letters and its ends of 4 to 6."""
    n = len(word)
    return [word, *["^" + word[:k] for k in range(3, min(9, n))], *["$" + word[-k:] for k in range(4, min(7, n))]]


def _frequent(sets: list[frozenset[str]], least: float) -> dict[str, int]:
    """Features in at least ``least`` of the sets of words, with the number of sets.

    Counted by length: a longer beginning or end only where the one that is
    shorter by a letter is frequent, and a word only where its longest beginning
    is. So what is counted stays small, whatever the number of words.
    """
    frequent: dict[str, int] = {}
    for level in range(7):  # beginnings of 3 to 8 letters with ends of 4 to 6, then words
        counts: Counter = Counter()
        for words in sets:
            found = set()
            for w in words:
                n, k = len(w), 3 + level
                if level == 6:
                    if n <= 3 or "^" + w[: min(8, n - 1)] in frequent:
                        found.add(w)
                    continue
                if k < n and (level == 0 or "^" + w[: k - 1] in frequent):
                    found.add("^" + w[:k])
                if 4 <= k + 1 < min(7, n) and (level == 0 or "$" + w[-k:] in frequent):
                    found.add("$" + w[-k - 1 :])
            counts.update(found)
        frequent |= {f: c for f, c in counts.items() if c >= least}
    return frequent


def toxic_features(docs: list[tuple[str, int]], most: int = 1000) -> set[str]:
    """Features whose presence makes a document toxic."""
    seen: dict[str, int] = {}
    for text, label in docs:
        seen[text] = max(label, seen.get(text, 0))
    lines: set[bytes] = set()
    words, known = ([], []), {}
    for text, label in sorted(seen.items()):
        fresh = [(d, x) for x in text.lower().split("\n") if (d := hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()) not in lines]  # copies of a document count once
        lines.update(d for d, _ in fresh)
        words[label].append(frozenset([known.setdefault(w, w) for _, x in fresh for w in WORD.findall(x)]))
    del lines
    toxic = _frequent(words[1], max(3, 0.02 * len(words[1])))
    clean: Counter = Counter()
    for ws in words[0]:
        clean.update({f for w in ws for f in features_of(w) if f in toxic})
    n = [max(1, len(words[k])) for k in (0, 1)]
    rare = {f: c for f, c in toxic.items() if clean[f] / n[0] <= 0.2 * c / n[1]}
    total = n[0] + n[1]
    # Twice the log-likelihood ratio of a feature's counts against those of chance.
    strength = {f: 2 * (c * math.log(c * total / ((c + clean[f]) * n[1])) + (clean[f] * math.log(clean[f] * total / ((c + clean[f]) * n[0])) if clean[f] else 0)) for f, c in rare.items()}
    best = max(rare.values(), default=0)
    picked = sorted((f for f, c in rare.items() if c >= 0.1 * best and strength[f] >= LEAST_STRENGTH), key=lambda f: (-rare[f], f))[:most]
    if not picked:
        return set()
    number = {f: i for i, f in enumerate(picked)}
    sets = [ws for label in (0, 1) for ws in words[label]]
    x, y = np.zeros((len(sets), len(picked)), np.float32), np.repeat([0.0, 1.0], [len(words[0]), len(words[1])])
    for i, ws in enumerate(sets):
        x[i, [number[f] for w in ws for f in features_of(w) if f in number]] = 1
    weight = _logistic(x, y)[1:]
    return {f for f, s in zip(picked, weight) if s > 0}


def hashed(word: str) -> list[int]:
    """Places of a word's own weights: that of all words, its features and its shape."""
    n = len(word)
    shape = ("digits" if word.isdigit() else "mixed" if any(c.isdigit() for c in word) else "letters") + str(min(n, 12) // 3)
    return [0, *[1 + zlib.crc32(f.encode("utf-8", "surrogatepass")) % (OWN - 1) for f in (*features_of(word), "shape " + shape)]]


def neighbour(word: str) -> int:
    return zlib.crc32(b"beside " + word.encode("utf-8", "surrogatepass")) % BESIDE


class Vocabulary(dict):
    """word -> its number; numbers of words not met before are the next ones."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def read(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words, in order."""
        low = (text or "").lower()
        if len(low) <= PIECE:
            words = WORD.findall(low)
            return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        hits, parts = WORD.finditer(low), [np.zeros(0, np.int64)]
        while words := [hit[0] for hit in islice(hits, PIECE)]:
            parts.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        return np.concatenate(parts)


class Parts:
    """Sequences of tokens, one after another in one array, as parts of STRIDE tokens side by side, the longest first."""

    def __init__(self, lengths: np.ndarray):
        self.n = int(lengths.sum())
        many = -(-lengths // STRIDE)
        owner = np.repeat(np.arange(len(lengths)), many)
        at = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
        size = np.minimum(STRIDE, lengths[owner] - at * STRIDE)
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.size = size[order]
        self.start = ((np.cumsum(lengths) - lengths)[owner] + at * STRIDE)[order]
        self.opens = (at == 0)[order]
        # Parts by their number in the sequence, with the part before: borders are found one number after another.
        self.later = [(place[(here := np.flatnonzero(at == k))], place[here - 1]) for k in range(1, int(many.max(initial=0)))]
        # Parts that pass side by side: of about one length, CELLS cells at most.
        self.groups, i = [], 0
        while i < len(self.size):
            j = min(len(self.size), i + max(1, CELLS // int(self.size[i])))
            self.groups.append((i, j))
            i = j

    def steps(self, i: int, j: int) -> list[int]:
        """How many of the parts of a group have a token at each place."""
        size = self.size[i:j]
        return (j - i - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")).tolist()

    def lanes(self, e: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The emissions of a group's parts, a column for each; which places hold tokens; and where those stand."""
        place = np.arange(int(self.size[i]))
        on = place < self.size[i:j, None]
        cell = self.start[i:j, None] + place
        out = np.ones(on.shape)
        flat = cell[on]
        out[on] = e[flat]
        return np.ascontiguousarray(out.T), on, flat

    def borders(self, e: np.ndarray, m: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
        """The forward message into each part and the backward message at its end."""
        count = len(self.size)
        enter, leave = np.zeros(count), np.ones(count)
        if not self.later:
            return enter, leave
        # Transfer matrices: rows are the state before a part (of a sequence's first part: at its first token), columns its last one.
        t, out = np.broadcast_to(np.eye(2), (count, 2, 2)).copy(), np.ones((count, 2))
        for i, j in self.groups:
            lanes, opens = self.lanes(e, i, j)[0], self.opens[i:j]
            out[i:j, 1] = first * lanes[0]
            for k, n in enumerate(self.steps(i, j)):
                step = t[i : i + n] @ m
                step[:, :, 1] *= lanes[k, :n, None]
                if k == 0:
                    step[opens] = np.eye(2)
                t[i : i + n] = step / step.sum((1, 2), keepdims=True)
        out = np.einsum("ni,nij->nj", out, t)
        for here, prior in self.later:
            enter[here] = out[prior, 1] / out[prior, 0]
            out[here] = np.einsum("ni,nij->nj", np.stack([np.ones(len(here)), enter[here]], 1), t[here])
        ends = np.ones((count, 2))
        for here, prior in self.later[::-1]:
            got = np.einsum("nij,nj->ni", t[here], ends[here])
            ends[prior] = got / got[:, :1]
        return enter, ends[:, 1].copy()

    def ratios(self, e: np.ndarray, m: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the forward and the backward message: toxic over clean, emissions ``e`` being so too."""
        forward, backward = np.empty(self.n), np.empty(self.n)
        enter, leave = self.borders(e, m, first)
        for i, j in self.groups:
            lanes, on, flat = self.lanes(e, i, j)
            opens, r, b = self.opens[i:j], enter[i:j], leave[i:j]
            ahead, back, steps = np.empty(lanes.shape), np.empty(lanes.shape), self.steps(i, j)
            for k, n in enumerate(steps):
                r[:n] = lanes[k, :n] * (m[0, 1] + r[:n] * m[1, 1]) / (m[0, 0] + r[:n] * m[1, 0])
                if k == 0:
                    r[opens] = first * lanes[0, opens]
                ahead[k, :n] = r[:n]
            for k in range(len(steps) - 1, -1, -1):
                n = steps[k]
                back[k, :n] = b[:n]
                x = lanes[k, :n] * b[:n]
                b[:n] = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
            forward[flat], backward[flat] = ahead.T[on], back.T[on]
        return forward, backward


def scores(ids: np.ndarray, starts: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Emission scores of tokens: their own and what their neighbours in the same sequence add."""
    out = own[ids]
    if len(ids) > 1:
        inside = np.ones(len(ids), bool)
        inside[starts[starts < len(ids)]] = False
        out[1:] += np.where(inside[1:], before[ids[:-1]], 0.0)
        out[:-1] += np.where(inside[1:], after[ids[1:]], 0.0)
    return np.clip(out, -30, 30)


def train_field(lines: list[tuple[np.ndarray, np.ndarray]], words: list[str], rounds: int = 25, rate: float = 0.5, ridge: float = 0.02) -> Field:
    """Weights from lines of (numbers of words, labels of tokens), all of them and whole."""
    lines = [x for x in lines if len(x[0])]
    model = Field()
    if not lines:
        return model
    many = np.array([len(features_of(w)) + 2 for w in words])
    flat = np.fromiter((k for w in words for k in hashed(w)), np.int32, many.sum())
    owner = np.repeat(np.arange(len(words), dtype=np.int32), many)
    beside = np.array([neighbour(w) for w in words])
    ids, truth = np.concatenate([x for x, _ in lines]), np.concatenate([y for _, y in lines])
    lengths = np.array([len(x) for x, _ in lines])
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(ids), bool)
    inside[starts] = False
    parts, pair = Parts(lengths), np.flatnonzero(inside)
    real = np.zeros((2, 2))
    np.add.at(real, (truth[pair - 1].astype(int), truth[pair].astype(int)), 1.0)
    model.own[0] = -3.0
    params = [model.own, model.before, model.after, model.move, np.zeros(1)]
    moment, spread = [0.0] * 5, [0.0] * 5
    for t in range(1, rounds + 1):
        own, before, after, move, first = params
        e = np.exp(scores(ids, starts, np.bincount(owner, own[flat], len(words)), before[beside], after[beside]))
        m = np.exp(move)
        r, b = parts.ratios(e, m, float(np.exp(first[0])))
        p = r * b / (1 + r * b)
        off = truth - p
        expected = np.zeros(4)
        for k in range(0, len(pair), CELLS):
            at = pair[k : k + CELLS]
            a, x = r[at - 1], e[at] * b[at]
            cells = np.stack([np.full(len(at), m[0, 0]), m[0, 1] * x, a * m[1, 0], a * m[1, 1] * x])
            expected += (cells / cells.sum(0)).sum(1)
        expected = expected.reshape(2, 2)
        del r, b, e, p
        by_word = np.bincount(ids, off, len(words))
        grads = [
            np.bincount(flat, by_word[owner], OWN),
            np.bincount(beside[ids[pair - 1]], off[pair], BESIDE),
            np.bincount(beside[ids[pair]], off[pair - 1], BESIDE),
            real - expected,
            np.array([off[starts].sum()]),
        ]
        for i, g in enumerate(grads):
            g = g - ridge * params[i]
            moment[i], spread[i] = 0.9 * moment[i] + 0.1 * g, 0.99 * spread[i] + 0.01 * g * g
            params[i] = params[i] + rate * (moment[i] / (1 - 0.9**t)) / (np.sqrt(spread[i] / (1 - 0.99**t)) + 1.0)
    model.own, model.before, model.after, model.move, model.first, model.learned = *params[:4], float(params[4][0]), True
    return model


class Chain:
    """Forward-backward over texts, given the field."""

    def __init__(self, model: Field):
        self.model, self.known = model, Vocabulary()
        self.own, self.before, self.after = (np.zeros(0) for _ in range(3))
        self.m, self.first = np.exp(model.move), float(np.exp(model.first))

    def _learn(self) -> None:
        """Scores of the words met since."""
        if fresh := list(islice(self.known, len(self.own), None)):
            own = np.array([self.model.own[hashed(w)].sum() for w in fresh])
            beside = np.array([neighbour(w) for w in fresh])
            self.own, self.before, self.after = (np.concatenate(x) for x in ((self.own, own), (self.before, self.model.before[beside]), (self.after, self.model.after[beside])))

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of all tokens of the texts, one text after another, and the texts' numbers of tokens."""
        if len(self.known) > MAX_WORDS:
            self.__init__(self.model)
        read = [self.known.read(t) for t in texts]
        self._learn()
        lengths = np.array([len(x) for x in read], np.int64)
        ids = np.concatenate([np.zeros(0, np.int64), *read])
        if not self.model.learned:
            return np.zeros(len(ids)), lengths
        e = np.exp(scores(ids, np.cumsum(lengths) - lengths, self.own, self.before, self.after))
        r, b = Parts(lengths).ratios(e, self.m, self.first)
        return r * b / (1 + r * b), lengths

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Of each text, the largest marginal, the expected number and share of toxic tokens; and its spans, as offsets of the lower-cased text."""
        p, lengths = self.marginals(texts)
        ends = np.cumsum(lengths)
        numbers, spans = np.zeros((len(texts), 3)), []
        for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist())):
            own = p[end - n : end]
            if n:
                total = float(own.sum())
                numbers[i] = own.max(), total, total / n
            spans.append(spans_of(texts[i], own) if numbers[i, 0] >= 0.5 else [])
        return numbers, spans

    def score(self, numbers: np.ndarray) -> np.ndarray:
        return np.round(_sigmoid((calibration(numbers) * self.model.line[1:]).sum(1) + self.model.line[0]), 9)


def spans_of(text: str, marginals: np.ndarray) -> list[dict]:
    """Runs of tokens of marginals of a half or more."""
    spans, last = [], None
    for i, hit in enumerate(WORD.finditer(text.lower())):
        if (x := float(marginals[i])) < 0.5:
            continue
        if last == i - 1:
            spans[-1] |= {"end": hit.end(), "marginal": max(x, spans[-1]["marginal"])}
        else:
            spans.append({"start": hit.start(), "end": hit.end(), "marginal": x})
        last = i
    return spans


def calibration(numbers: np.ndarray) -> np.ndarray:
    return np.stack([numbers[:, 0], np.log1p(numbers[:, 1]), 3 * np.sqrt(numbers[:, 2])], 1)


def labelled_lines(docs: list[tuple[str, int]], marks: set[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Lines as (numbers of words, labels of tokens), equal ones once, and the words; tokens with one of ``marks`` are toxic if their document is."""
    known = Vocabulary()
    found = {(known.read(line).astype("<i4").tobytes(), label) for t, label in docs for line in t.split("\n")}
    words = list(known)
    marked = np.array([any(f in marks for f in features_of(w)) for w in words], bool)
    lines = set()
    for x, label in found:
        ids = np.frombuffer(x, "<i4")
        if len(ids):
            lines.add((x, bool(label and marked[ids].any())))
    del found
    return [(ids, marked[ids] & label) for x, label in sorted(lines) for ids in [np.frombuffer(x, "<i4")]], words


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = 1500, max_chars: int = 20_000) -> Field:
    """Learn from the rows of ``documents`` that ``labels`` (key, label), limited to training rows by the caller, names.

    About ``per_class`` labels of either kind are picked by a hash of ``key``; a
    key that is labelled both ways counts as toxic, and of several texts with a
    key, that of the least hash is read. These bounded ids are broadcast, so the
    texts are not shuffled, and the bounded sample is learned from in one task. Texts of more than ``max_chars`` characters are not
    learned from. The field is trained on all lines of three quarters of the
    texts that are left, equal lines with equal labels counting once; the score
    is calibrated on the other quarter (by a hash of the text; on all, if either
    part lacks one of the labels), where a toxic text counts twice.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Field(line=np.array([8.0 if 1 in sizes else -8.0, 0, 0, 0]))
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / sizes[1]))).otherwise(F.lit(min(1.0, per_class / sizes[0])))
    picked = rows.where(F.shiftrightunsigned(F.xxhash64("__key"), 11) / F.lit(float(1 << 53)) < share)
    picked = documents.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], picked.schema)
    whole = documents.select(F.col(key).alias("__key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    picked = whole.join(F.broadcast(picked), "__key").groupBy("__key").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [d for batch in batches for d in zip(*[c.to_pylist() for c in batch.columns])]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(docs))])], names=["model"])

    # The sample is bounded, so one task holds it; the driver sees the weights alone.
    found = picked.select("text", "label").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else learn([])


def learn(docs: list[tuple[str, int]]) -> Field:
    """A field of texts and their labels."""
    docs = sorted(docs)
    if len({x for _, x in docs}) < 2:
        return Field(line=np.array([8.0 if docs and docs[0][1] else -8.0, 0, 0, 0]))
    marks = toxic_features(docs)
    if not marks:
        return Field(line=np.array([-1.0, 0, 0, 0]))
    # What the field was trained on tells nothing about how sure it may be, so the score is calibrated on other texts.
    apart = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % APART == 0 for t, _ in docs]
    if len({(a, x) for a, (_, x) in zip(apart, docs)}) < 4:
        apart = [None] * len(docs)
    model = train_field(*labelled_lines([d for a, d in zip(apart, docs) if not a], marks))
    others, chain, numbers = [d for a, d in zip(apart, docs) if a or a is None], Chain(model), []
    for k in range(0, len(others), 256):
        numbers.append(chain.read([t for t, _ in others[k : k + 256]])[0])
    model.line = _logistic(calibration(np.concatenate(numbers)), np.array([x for _, x in others]), rounds=800, ridge=1e-4, toxic=TWICE)
    return model


def score(df: DataFrame, model: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with score, predicted and spans (start, end, marginal) for every row.

    A null or empty text has no token and gets the score of such texts. Spans
    count code points of the lower-cased text. Repeated rows stay, equal texts
    get equal results, an empty table gives an empty result, and other columns
    of the table are not read.
    """
    arrow_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*keep, F.col(text).alias(beside(keep)))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(shared.value)
        for batch in batches:
            numbers, spans = chain.read(batch.column(len(keep)).to_pylist())
            found = chain.score(numbers)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found), pa.array(found >= 0.5).cast(pa.int32()), pa.array(spans, kind)], names=[*keep, "score", "predicted", "spans"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + ["score double", "predicted int", "spans array<struct<start:bigint,end:bigint,marginal:double>>"])
    return source.mapInArrow(run, schema)
