"""Word-level language identification by a linear-chain conditional random field.

A word's features are its affixes (1 to 3 letters at either end), its letter trigrams and, if the lexicon has it, the
word itself. Emission weights and transitions are learned together by gradient steps on the
conditional likelihood of sequences spliced from spans of differently labelled documents, so that the model has seen
switches. Words are labelled by forward-backward over the whole text; a document takes the label with most expected
words, its score being that share.

Words are maximal runs of letters, lower-cased. Null text or no letter: `und`, score 0. Without labelled training rows
every document is `und`. Ties go to the first label in binary order. Repeated rows are labelled each, extra columns
are ignored. Training takes a bounded sample: SAMPLE_DOCS a language, spread by a hash of doc_id, and of these, in the order of a hash of their
text, whole texts until there are WORDS_A_LANGUAGE words. Both bounds are fixed, so the sample does not grow with the corpus. Texts of any
length are labelled whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SPAN, SEQUENCE, ROUNDS = 120, (8, 60), 400, 20
WORDS_A_LANGUAGE = 30_000
CACHE_WORDS, CELLS, PIECE = 500_000, 300_000, 512
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_features(w: str) -> list[str]:
    """The word itself, its affixes of up to three letters, and its letter trigrams; ^ and $ mark the ends."""
    s = f"^{w}$"
    return [w, s[:2], s[-2:], s[:4], s[-4:], *[s[i : i + 3] for i in range(len(s) - 2)]]


def forward_backward(emit, sizes, trans, start, pairs=False, entry=None, leave=None):
    """Posterior marginals (B, T, L) of sequences sorted by falling size, with emissions exp(score); and expected
    transitions if asked. entry, leave: the forward vector before and the backward vector after a sequence that is a
    piece of a longer one (nan in entry: a sequence that starts there)."""
    b, t, labels = emit.shape
    alpha, beta = np.ones_like(emit), np.ones_like(emit)
    live = np.searchsorted(-sizes, -np.arange(t), "left")  # sequences longer than step
    first = np.broadcast_to(start, (b, labels))
    if entry is not None:
        first = np.where(np.isnan(entry), first, entry @ trans)
    alpha[:, 0] = first * emit[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        k = live[i]
        a = (alpha[:k, i - 1] @ trans) * emit[:k, i]
        alpha[:k, i] = a / a.sum(1, keepdims=True)
    if leave is not None:
        beta[np.arange(b), sizes - 1] = leave
    for i in range(t - 2, -1, -1):
        k = live[i + 1]
        a = (beta[:k, i + 1] * emit[:k, i + 1]) @ trans.T
        beta[:k, i] = a / a.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    post[np.arange(t)[None, :] >= sizes[:, None]] = 0
    if not pairs:
        return post, None
    joint = alpha[:, :-1, :, None] * trans * (beta[:, 1:] * emit[:, 1:])[:, :, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return post, np.einsum("btij,bt->ij", joint, (np.arange(1, t)[None, :] < sizes[:, None]).astype(emit.dtype))


def borders(emit, sizes, of, trans, start):
    """Forward vectors before and backward vectors after each piece of long sequences, for forward_backward.

    emit: (pieces, PIECE, L), pieces in order, all but a sequence's last of full size; of: the sequence of each piece.
    A piece's product of transfer matrices, taken for all pieces together, carries a vector over it either way.
    """
    n, t, labels = emit.shape
    product = np.repeat(np.eye(labels, dtype=emit.dtype)[None], n, 0)
    for i in range(t):
        m = np.flatnonzero(sizes > i)
        p = (product[m].reshape(-1, labels) @ trans).reshape(-1, labels, labels) * emit[m, i, None, :]
        product[m] = p / p.sum((1, 2), keepdims=True)
    head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    v = start * emit[head, 0]
    for i in range(1, t):
        v = (v @ trans) * emit[head, i]
        v /= v.sum(1, keepdims=True)
    entry, leave = np.full((n, labels), np.nan, emit.dtype), np.ones((n, labels), emit.dtype)
    done = dict(zip(head.tolist(), v, strict=True))
    for k in range(1, n):
        if k not in done:
            entry[k] = done[k - 1] / done[k - 1].sum()
            done[k] = entry[k] @ product[k]
    for k in range(n - 2, -1, -1):
        if of[k] == of[k + 1]:
            x = product[k + 1] @ leave[k + 1]
            leave[k] = x / x.sum()
    return entry, leave


class Model:
    """Feature weights, transitions and the labels in binary order."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.labels, self.index, self.weights, self.trans, self.start = labels, index, weights, trans, start
        self._clear()

    def __getstate__(self):
        return self.labels, self.index, self.weights, self.trans, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.ones((1 << 12, max(1, len(self.labels))), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        missing = [w for w in dict.fromkeys(words) if w not in self.known]
        if missing:
            if self.known and len(self.known) + len(missing) > CACHE_WORDS:
                self._clear()
                missing = list(dict.fromkeys(words))
            get, ids, ends = self.index.get, [], []
            for w in missing:
                ids += [k for f in word_features(w) if (k := get(f)) is not None]
                ends.append(len(ids))
            total = np.vstack([np.zeros(len(self.labels)), np.cumsum(self.weights[np.array(ids, np.int64)], 0)]) if ids else np.zeros((1, len(self.labels)))
            ends = np.array(ends)
            score = total[ends] - total[np.r_[0, ends[:-1]]]
            n = len(self.known)
            while n + len(missing) > len(self.table):
                self.table = np.vstack([self.table, np.ones_like(self.table)])
            self.table[n : n + len(missing)] = np.exp(np.maximum(score - score.max(1, keepdims=True), -30))
            self.known.update(zip(missing, range(n, n + len(missing)), strict=True))
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | None]):
        """For each text its words' posteriors (words, labels); pieces are run together in blocks of bounded size."""
        count = len(self.labels)
        pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # (text, emissions, entry, leave)
        fresh, over = np.full(count, np.nan, np.float32), np.ones(count, np.float32)
        long_: list[tuple[int, np.ndarray]] = []

        def carry():
            if not long_:
                return
            sizes = np.array([len(e) for _, e in long_])
            block = np.ones((len(long_), PIECE, count), np.float32)
            for k, (_, e) in enumerate(long_):
                block[k, : len(e)] = e
            entry, leave = borders(block, sizes, np.array([i for i, _ in long_]), self.trans, self.start)
            pieces.extend((i, e, entry[k], leave[k]) for k, (i, e) in enumerate(long_))
            long_.clear()

        for i, text in enumerate(texts):
            if not self.labels or not (words := words_of(text)):
                continue
            emit = self.emissions(words)
            if len(emit) <= PIECE:
                pieces.append((i, emit, fresh, over))
            else:
                long_ += [(i, emit[a : a + PIECE]) for a in range(0, len(emit), PIECE)]
                if len(long_) * PIECE > CELLS:
                    carry()
        carry()
        found: list[np.ndarray | None] = [None] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k][1]))
        at = 0
        while at < len(order):
            longest = len(pieces[order[at]][1])
            some = order[at : at + max(1, CELLS // longest)]
            block = np.ones((len(some), longest, count), np.float32)
            sizes = np.array([len(pieces[k][1]) for k in some])
            for row, k in enumerate(some):
                block[row, : sizes[row]] = pieces[k][1]
            post, _ = forward_backward(block, sizes, self.trans, self.start, entry=np.stack([pieces[k][2] for k in some]), leave=np.stack([pieces[k][3] for k in some]))
            for row, k in enumerate(some):
                found[k] = post[row, : sizes[row]]
            at += len(some)
        out: list[np.ndarray | None] = [None] * len(texts)
        for (i, *_), post in zip(pieces, found, strict=True):
            out[i] = post if out[i] is None else np.concatenate([out[i], post])
        return out


def fit(samples: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Learn from (lang, text) samples."""
    labels = sorted({lang for lang, _ in samples})
    count = len(labels)
    if not count:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    streams = []
    for k, lang in enumerate(labels):
        stream: list[int] = []
        for text in sorted((t for own, t in samples if own == lang), key=lambda t: (zlib.crc32(t.encode()), t)):
            if len(stream) < WORDS_A_LANGUAGE:
                stream += [vocab.setdefault(w, len(vocab)) for w in words_of(text)]
        for at in range(0, len(stream), 50):
            streams.append((k, stream[at : at + 50]))
    spans = []
    for k, run in streams:
        at = 0
        while at < len(run):
            n = int(rng.integers(*SPAN))
            spans.append((k, run[at : at + n]))
            at += n
    rng.shuffle(spans)
    seqs: list[tuple[list[int], list[int]]] = [([], [])]
    for k, run in spans:
        if len(seqs[-1][0]) + len(run) > SEQUENCE:
            seqs.append(([], []))
        seqs[-1][0].extend(run)
        seqs[-1][1].extend([k] * len(run))
    seqs = sorted((s for s in seqs if s[0]), key=lambda s: -len(s[0]))
    if not seqs:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    sizes = np.array([len(s[0]) for s in seqs])
    word = np.zeros((len(seqs), sizes[0]), np.int64)
    gold = np.zeros((len(seqs), sizes[0]), np.int64)
    for i, (w, y) in enumerate(seqs):
        word[i, : sizes[i]], gold[i, : sizes[i]] = w, y
    mask = np.arange(sizes[0])[None, :] < sizes[:, None]
    seen: Counter[str] = Counter()
    lists = [word_features(w) for w in vocab]
    for fs in lists:
        seen.update(set(fs))
    used = Counter(word[mask].tolist())
    index: dict[str, int] = {}
    for i, (w, fs) in enumerate(zip(vocab, lists, strict=True)):
        for f in fs:
            if f not in index and (used[i] >= 3 if f == w else seen[f] >= 3):
                index[f] = len(index)
    rows = np.repeat(np.arange(len(lists)), [sum(f in index for f in fs) for fs in lists])
    cols = np.array([index[f] for fs in lists for f in fs if f in index], np.int64)
    observed = np.zeros((len(vocab), count))
    np.add.at(observed, (word[mask], gold[mask]), 1)
    moves = np.zeros((count, count))
    np.add.at(moves, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    first = np.bincount(gold[:, 0], minlength=count)
    weights, log_trans, log_start = np.zeros((len(index), count)), np.log(moves + 1) - np.log((moves + 1).sum(1, keepdims=True)), np.log((first + 1) / (first + 1).sum())
    m, v = [np.zeros_like(weights), np.zeros_like(log_trans)], [np.zeros_like(weights), np.zeros_like(log_trans)]
    total = mask.sum()
    for step in range(1, rounds + 1):
        score = np.zeros((len(vocab), count))
        for k in range(count):
            score[:, k] = np.bincount(rows, weights[cols, k], minlength=len(vocab))
        emit = np.exp(np.maximum(score - score.max(1, keepdims=True), -30)).astype(np.float32)[word]
        post, two = forward_backward(emit, sizes, np.exp(log_trans).astype(np.float32), np.exp(log_start).astype(np.float32), pairs=True)
        expected = np.zeros((len(vocab), count))
        for k in range(count):
            expected[:, k] = np.bincount(word[mask], post[..., k][mask], minlength=len(vocab))
        diff = observed - expected
        grad = np.stack([np.bincount(cols, diff[rows, k], minlength=len(index)) for k in range(count)], 1) / total * 100 - 1e-3 * weights
        for i, (x, g) in enumerate(((weights, grad), (log_trans, (moves - two) / total * 100))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            x += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
    return Model(labels, index, weights.astype(np.float32), np.exp(log_trans - log_trans.max()).astype(np.float32), np.exp(log_start).astype(np.float32))


def train(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    """A model from a bounded sample of labelled rows: about `per_language` documents of each language, chosen by hash."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return fit([])
    chance = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    return fit([(r["lang"], r["text"]) for r in known.where(drawn < chance[F.col("lang")]).select("lang", "text").collect()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for post in m.label(part["text"].to_pylist()):
                    if post is None:
                        rows.append(("und", 0.0, 0, 0))
                        continue
                    share = post.sum(0, dtype=np.float64)
                    best = int(share.argmax())
                    path = post.argmax(1)
                    rows.append((m.labels[best], min(1.0, float(share[best] / share.sum())), len(post), int((path[1:] != path[:-1]).sum())))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, n_switches long")
