"""Language-model scoring: word base score and a causal self-attention model on subword ids.

``read`` turns each text into the subword ids of its words, with a public tokenizer's vocabulary; all else reads ids. Each word
starts with the one id of its blank, so words can be told apart, and a word's ids spell the word: they are its name.

**Words.** ``count_words`` counts every distinct word of all texts (sorted arrays in tasks, one shuffle). A word of ``SHORT`` ids at most
that makes up a four-millionth of all words or more is *hot*: there are four million of them at most, whatever the corpus, so
their counts are broadcast and added up where the texts are. Other words leave as rows and meet their counts in an equi-join of
Spark, except that words which occur once in all texts need no count; a second shuffle adds the rows up by text.

**Model.** An id's embedding ``h`` and the mean ``u`` of the embeddings before it, weighted by one head of masked
self-attention with learned distances, give the logits of a class of ids and of an id within its class (runs of ids in order of
frequency, cut so that an id needs the fewest logits on average). Probabilities of ids sum to 1; ids that the training text lacks share
one place. It is trained in numpy by Adagrad, in steps that grow with the pass, on the whole training text, whose rows are dealt over rounds and tasks by hash: tasks of
about ``TASK_IDS`` ids in all rounds each train from the same parameters, what they learnt is averaged by Spark, and ``ROUNDS`` such rounds
follow; less than ``FLOOR`` ids are read several times. The driver holds one set of parameters, bounded by the vocabulary.

Texts are scored in windows of ``WINDOW`` ids that overlap by ``CONTEXT``: each id is scored once, with
``CONTEXT`` ids before it where they exist, in batches with a causal mask.

Defined results: null texts are empty texts, whose only token is the end; whole texts are read, however long;
repeated rows count each; columns other than the three named are not read, so names cannot clash; with no training rows every count is 0
and the model is uniform over ids. Words are compared as they are spelt, not as hashes.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How a word is cut before its bytes are merged (fixed value): letters, digits or marks, a blank before them.
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
VOCAB = 50_257  #: ids of the vocabulary and one end of text
END = VOCAB - 1
PIECE_CHARS = 256  #: longer words are merged in parts, which keeps the tokenizer's time in proportion
CACHE = 300_000
HOT_SHARE, SHORT = 4_000_000, 4
NO_ID = 0xFFFF  #: fills the names of words shorter than SHORT ids
KEPT = 2_000_000  #: distinct words that a counting task holds before it adds up
DIM, WINDOW, CONTEXT = 24, 32, 8
SHARE, FLOOR, TASK_IDS = 1.0, 3_000_000, 16_000_000
ROUNDS, RATE, EPOCHS = 4, 0.2, 5
BATCH, STEPS = (64, 512), 240  #: windows of a step: as many as leave so many steps in a pass, within these bounds
FAN = 256  #: parameter sets that one task adds up at most
BLOCK_ROWS = 4096
WINDOWS_AT_ONCE = 1024  #: enough that the calls for each class cost little beside their arithmetic

_encoders: dict = {}
_rooms: dict = {}


def encoder(path: str):
    """The tokenizer of a file of ranks and which ids begin with a blank, built once in each Python worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        local = SparkFiles.get(os.path.basename(path))
        with open(local if os.path.exists(local) else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        leads = np.zeros(VOCAB, bool)
        leads[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        _encoders[path] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), leads
    return _encoders[path]


def subword_ids(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, a blank before each, and how many each has."""
    enc, leads = encoder(path)
    texts = [" " + w.decode("utf-8", "replace") for w in words]
    # One call for all; words that are long or end in a blank of another script are cut on their own.
    if any(len(t) > PIECE_CHARS or t[-1:].isspace() for t in texts):
        parts = [[i for at in range(0, len(t), PIECE_CHARS) for i in enc.encode_ordinary(t[at:at + PIECE_CHARS])] for t in texts]
        return np.fromiter((i for p in parts for i in p), np.uint16), np.fromiter(map(len, parts), np.int64, len(parts))
    ids = np.array(enc.encode_ordinary("".join(texts)), np.uint16)
    return ids, np.diff(np.append(np.flatnonzero(leads[ids]), len(ids)))


class Lexicon(dict):
    """Numbers words in the order in which they are first met, and knows their ids."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.flat, self.start, self.length, self.used = np.zeros(1 << 16, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def learn(self) -> None:
        """Tokenize the words met since the last call."""
        if not self.new:
            return
        more, length = subword_ids(self.new, self.path)
        self.new = []
        while self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(more)] = more
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.used += len(more)

    def ids(self, w: np.ndarray) -> np.ndarray:
        """The ids of all words of a text at once."""
        n = self.length[w]
        to = np.cumsum(n)
        return self.flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(self.start[w] - (to - n), n)]


def read(rows: DataFrame, path: str) -> DataFrame:
    """(row, doc_id, train, n, ids) of each of ``rows(row, doc_id, text, train)``; n counts the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(path)
        for b in slices(batches, 250):
            if len(lex) > CACHE:
                lex.forget()
            texts = [(t or b"").lower().split() for t in b.column(2).cast(pa.binary()).to_pylist()]
            place = lex.__getitem__
            at = [np.fromiter(map(place, f), np.int64, len(f)) for f in texts]
            lex.learn()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([len(f) + 1 for f in texts], pa.int64()), pa.array([lex.ids(w).tobytes() for w in at], pa.binary())],
                                             ["row", "doc_id", "train", "n", "ids"])

    return rows.mapInArrow(run, "row long, doc_id long, train boolean, n long, ids binary")


class Words:
    """The words of several texts of ids: ``name`` of those of SHORT ids at most as one number each, ``of`` their texts, and the others."""

    def __init__(self, texts: list[bytes], leads: np.ndarray):
        flat = np.concatenate([*(np.frombuffer(x, np.uint16) for x in texts), np.full(SHORT, NO_ID, np.uint16)])
        size = np.fromiter((len(x) // 2 for x in texts), np.int64, len(texts))
        n = len(flat) - SHORT
        start = np.flatnonzero(leads[flat[:n]])
        length = np.diff(np.append(start, n))
        text = np.searchsorted(np.cumsum(size), start, side="right")
        short = length <= SHORT
        s, m = start[short], length[short]
        self.name, self.of = np.zeros(len(s), np.uint64), text[short]
        for k in range(SHORT):
            self.name |= np.where(k < m, flat[s + k], NO_ID).astype(np.uint64) << np.uint64(16 * k)
        self.long = [(int(t), flat[a:a + k].tobytes()) for a, k, t in zip(start[~short], length[~short], text[~short])]


def names(numbers: np.ndarray, others: list[bytes]) -> pa.Array:
    """Names of words as Arrow's binary: the eight bytes of each number, then the others."""
    data = numbers.astype("<u8").tobytes()
    short = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(np.arange(0, len(data) + 1, 8, dtype=np.int32)), pa.py_buffer(data)])
    return pa.concat_arrays([short, pa.array(others, pa.binary())])


def count_words(texts: DataFrame, path: str) -> DataFrame:
    """(word, n_all, n_train) of every distinct word of ``texts(train, ids)``."""
    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        name = np.concatenate([p[0] for p in parts])
        order = np.argsort(name)
        name = name[order]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        return name[first], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) if len(first) else np.zeros(0, np.int64) for i in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads, kept, held, longer = encoder(path)[1], [], 0, {}

        def flush() -> pa.RecordBatch:
            nonlocal kept, held
            name, n, m = added(kept) if kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            both = np.array(list(longer.values()), np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([names(name, list(longer)), pa.array(np.concatenate([n, both[:, 0]])), pa.array(np.concatenate([m, both[:, 1]]))], ["word", "n_all", "n_train"])
            kept, held = [], 0
            longer.clear()
            return out

        for b in slices(batches, 2000):
            train = np.array(b.column(0).to_pylist(), bool)
            w = Words(b.column(1).to_pylist(), leads)
            for own, learn in ((w.name[train[w.of]], 1), (w.name[~train[w.of]], 0)) if b.num_rows else ():
                name, n = np.unique(own, return_counts=True)
                kept.append((name, n, n * learn))
                held += len(name)
            for t, word in w.long:
                n = longer.setdefault(word, [0, 0])
                n[0] += 1
                n[1] += int(train[t])
            if held > KEPT:
                kept = [added(kept)]
                held = len(kept[0][0])
            if held + len(longer) > KEPT // 2:
                yield flush()
        yield flush()

    return texts.select("train", "ids").mapInArrow(run, "word binary, n_all long, n_train long").groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def word_scores(texts: DataFrame, words: DataFrame, every: int, mass: float, path: str) -> DataFrame:
    """(row, known, word_score) of every row of ``texts(row, train, ids)``: how many of its words the training text knows, and the log10 sum of all.

    ``words`` comes from ``count_words``, ``every`` is the sum of its counts.
    """
    # No more than HOT_SHARE words can each make up that part of all words.
    hot = (F.col("n_all") * HOT_SHARE >= F.lit(every)) & (F.octet_length("word") == 2 * SHORT)
    found = words.where(hot).select("word", "n_train").toArrow()
    name = np.array([int.from_bytes(w, "little") for w in found.column("word").to_pylist()], np.uint64)
    order = np.argsort(name)
    sent = texts.sparkSession.sparkContext.broadcast((name[order], found.column("n_train").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_name, count = sent.value
        leads, log10 = encoder(path)[1], np.log10((count + 0.5) / mass)
        for b in slices(batches, 500):
            if not b.num_rows:
                continue
            rows, train = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), bool)
            w = Words(b.column(2).to_pylist(), leads)
            at = np.minimum(np.searchsorted(hot_name, w.name), max(0, len(hot_name) - 1))
            is_hot = hot_name[at] == w.name if len(hot_name) else np.zeros(len(w.name), bool)
            of, at = w.of[is_hot], at[is_hot]
            known = np.bincount(of, weights=count[at] > 0, minlength=len(rows)).astype(np.int64)
            score = np.bincount(of, weights=log10[at], minlength=len(rows))
            others = np.concatenate([w.of[~is_hot], np.array([t for t, _ in w.long], np.int64)]).astype(np.int64)
            none = np.zeros(len(others))
            # A text's own row has a name that no word has.
            own = [b"row" + int(r).to_bytes(8, "little", signed=True) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rows[others], rows])), pa.array(np.concatenate([train[others], np.zeros(len(rows), bool)])), names(w.name[~is_hot], [x for _, x in w.long] + own),
                 pa.array(np.concatenate([np.full(len(others), -1, np.int64), known])), pa.array(np.concatenate([none, score]))], ["row", "train", "word", "known", "score"])

    pairs = texts.select("row", "train", "ids").mapInArrow(run, "row long, train boolean, word binary, known long, score double")
    # A word that is in no count occurs once in all texts: here.
    counted = pairs.join(words.where(~hot & (F.col("n_all") > 1)).select("word", "n_train"), "word", "left")
    c = F.coalesce(F.col("n_train"), F.col("train").cast("long"))
    return counted.groupBy("row").agg(F.sum(F.when(F.col("known") >= 0, F.col("known")).otherwise((c > 0).cast("long"))).alias("known"),
                                      F.sum(F.when(F.col("known") >= 0, F.col("score")).otherwise(F.log10((c + 0.5) / mass))).alias("word_score"))


def class_edges(share: np.ndarray) -> np.ndarray:
    """Edges of runs of ids, whose shares fall: a run is cut where that saves most logits, until no cut saves more than the one of its class.

    An id of a run costs a logit for each member, an id alone in its run none.
    """
    upto = np.concatenate([[0.0], np.cumsum(share)])

    def cut(lo: int, hi: int) -> tuple[float, int, int, int]:
        at = np.arange(lo + 1, hi)
        cost = lambda a, b: np.where(b - a > 1, (upto[b] - upto[a]) * (b - a), 0.0)
        saved = float(cost(np.array(lo), np.array(hi))) - cost(lo, at) - cost(at, hi)
        best = int(np.argmax(saved))
        return -float(saved[best]), lo, hi, int(at[best])

    edges = [0, len(share)]
    open_ = [cut(0, len(share))] if len(share) > 1 else []
    while open_ and -open_[0][0] > 1:
        _, lo, hi, at = heapq.heappop(open_)
        edges.append(at)
        for a, b in ((lo, at), (at, hi)):
            if b - a > 1:
                heapq.heappush(open_, cut(a, b))
    return np.array(sorted(edges))


class Attention:
    """One head of masked self-attention over id embeddings with a two-level softmax; ids are rows in order of frequency, class by class."""

    def __init__(self, counts: np.ndarray, seed: int = 11):
        seen = np.flatnonzero(counts)
        order = seen[np.argsort(-counts[seen], kind="stable")]
        n = len(order)
        self.row = np.full(len(counts), n, np.int32)  # the last row stands for all ids that the training text lacks
        self.row[order] = np.arange(n, dtype=np.int32)
        self.start = n + 1  # what stands before a text
        self.unseen = float(np.log(max(1, len(counts) - n)))
        mass = np.append(counts[order].astype(np.float64), 1.0)
        self.lo = class_edges(mass / mass.sum())
        self.n_cls = len(self.lo) - 1
        own = np.repeat(np.arange(self.n_cls), np.diff(self.lo))
        self.cls = own.astype(np.int32)
        self.several = np.flatnonzero(np.diff(self.lo) > 1).tolist()
        of_class = np.bincount(own, weights=mass)
        rng = np.random.default_rng(seed)
        g = lambda s, *d: (rng.standard_normal(d) * s).astype(np.float32)
        self.w = {"embed": g(0.3, n + 2, DIM), "match": g(0.05, DIM, DIM), "distance": np.zeros(WINDOW, np.float32),
                  "class": g(0.05, self.n_cls, 2 * DIM), "class_bias": np.log(of_class / of_class.sum()).astype(np.float32),
                  "inside": g(0.05, n + 1, 2 * DIM), "inside_bias": np.log(mass / of_class[own]).astype(np.float32)}
        self.s = {k: np.full_like(v, 1e-6) for k, v in self.w.items()}

    #: Distances from each place of a window back to each other place, and which of them are not ahead.
    back = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0, WINDOW - 1)
    sees = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def attend(self, x: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of windows ``x`` of rows, attention of the places from ``first`` on, and their means."""
        h = self.w["embed"].take(x, 0)
        u = np.empty((len(x), WINDOW - first, DIM), h.dtype)
        return h, self.attention(h, turned(h), h[:, first:] @ self.w["match"], first, u), u

    def attention(self, h: np.ndarray, h_turned: np.ndarray, asks: np.ndarray, first: int, u: np.ndarray) -> np.ndarray:
        """Attention of the places from ``first`` on that ask for ``asks``; their means go to ``u``."""
        a = np.matmul(asks, h_turned, out=room("a", (len(h), WINDOW - first, WINDOW), h.dtype))
        a += self.w["distance"][self.back][first:]
        if far(a):
            a -= np.where(self.sees[first:] > 0, a, -np.inf).max(-1, keepdims=True)
            np.minimum(a, 0, out=a)
        np.exp(a, out=a)
        a *= self.sees[first:]
        a /= (a @ np.ones(WINDOW, a.dtype))[..., None]
        np.matmul(a, h, out=u)
        return a

    def by_class(self, c: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, end row, places) of each class with several rows that ``c`` names."""
        order = np.argsort(c, kind="stable")
        at = np.searchsorted(c[order], np.arange(self.n_cls + 1))
        for k in range(self.n_cls):
            if self.lo[k + 1] - self.lo[k] > 1 and at[k + 1] > at[k]:
                yield int(self.lo[k]), int(self.lo[k + 1]), order[at[k]:at[k + 1]]

    def step(self, x: np.ndarray, y: np.ndarray, ok: np.ndarray, rate: float) -> None:
        """One step of Adagrad on windows ``x`` of rows, the rows ``y`` that follow and which places count."""
        w, at, n, kind = self.w, np.flatnonzero(ok), x.size, self.w["embed"].dtype
        h = w["embed"].take(x, 0, out=room("h", (*x.shape, DIM), kind), mode="clip")
        flat, h_turned = h.reshape(n, DIM), turned(h)
        # What is multiplied by attention and its gradient: the gradient of means, and what places ask for.
        right = room("right", (len(x), 2 * WINDOW, DIM), kind)
        asks = right[:, WINDOW:]
        asks[:] = (flat @ w["match"]).reshape(h.shape)
        mixes = room("mixes", (n, 2 * DIM), kind)
        u = mixes[:, :DIM]
        a = self.attention(h, h_turned, asks, 0, u.reshape(h.shape))
        mixes[:, DIM:] = flat
        # Places in order of their classes, so that each class is one slice.
        y = y.ravel()[at]
        c = self.cls[y].astype(np.uint16)
        order = np.argsort(c, kind="stable")
        at, y, c = at[order], y[order], c[order]
        mix = mixes.take(at, 0, out=room("mix", (len(at), 2 * DIM), kind), mode="clip")
        # A row of zeros at the end stands for places that do not count.
        d_mix = room("d_mix", (len(at) + 1, 2 * DIM), kind)
        d_mix[-1] = 0
        g = {"inside": np.zeros_like(w["inside"]), "inside_bias": np.zeros_like(w["inside_bias"])}
        d = self.less_own(mix, "class", slice(None), c)
        g["class"], g["class_bias"] = d.T @ mix, np.ones(len(d), kind) @ d
        np.matmul(d, w["class"], out=d_mix[:-1])
        edge = np.searchsorted(c, np.arange(self.n_cls + 1)).tolist()
        for k in self.several:
            if edge[k] < edge[k + 1]:
                i, own = slice(edge[k], edge[k + 1]), slice(self.lo[k], self.lo[k + 1])
                d = self.less_own(mix[i], "inside", own, y[i] - self.lo[k])
                d_mix[i] += d @ w["inside"][own]
                np.matmul(d.T, mix[i], out=g["inside"][own])
                np.matmul(np.ones(len(d), kind), d, out=g["inside_bias"][own])
        place = np.full(n, len(at))
        place[at] = np.arange(len(at))
        every = d_mix.take(place, 0, out=room("every", (n, 2 * DIM), kind), mode="clip")
        d_u, d_h = every[:, :DIM], every[:, DIM:]
        right[:, :WINDOW] = d_u.reshape(h.shape)
        left = room("left", (len(x), 2 * WINDOW, WINDOW), kind)
        left[:, :WINDOW], d_a = a, left[:, WINDOW:]
        np.matmul(right[:, :WINDOW], h_turned, out=d_a)
        d_a -= np.einsum("ij,ij->i", d_u, u).reshape(*x.shape, 1)
        d_a *= a
        g["distance"] = np.bincount(self.back.ravel(), weights=(d_a.sum(0) * self.sees).ravel(), minlength=WINDOW).astype(np.float32)
        matched = np.matmul(d_a, h, out=room("matched", h.shape, kind)).reshape(n, DIM)
        g["match"] = flat.T @ matched
        moved = np.matmul(left.transpose(0, 2, 1), right, out=room("moved", h.shape, kind)).reshape(n, DIM)
        moved += d_h
        moved += np.matmul(matched, w["match"].T, out=room("asked", (n, DIM), kind))
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        rows = x.ravel()[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        for name, grad in g.items():
            self._move(name, slice(None), grad, rate)
        self._move("embed", rows[first], np.add.reduceat(moved.take(order, 0, out=room("sorted", (n, DIM), kind), mode="clip"), first, axis=0), rate)

    def less_own(self, mix: np.ndarray, level: str, rows: slice, own: np.ndarray) -> np.ndarray:
        """The gradient of the loss by the logits of ``rows`` of a level of the softmax."""
        z = np.matmul(mix, self.w[level][rows].T, out=room(level, (len(mix), len(self.w[level][rows])), mix.dtype))
        z += self.w[level + "_bias"][rows]
        return softmax_less_own(z, own)

    def _move(self, name: str, i, grad: np.ndarray, rate: float) -> None:
        s = self.s[name][i] + grad * grad
        self.s[name][i] = s
        np.sqrt(s, out=s)
        np.divide(grad, s, out=s)
        s *= np.float32(rate)
        self.w[name][i] -= s

    def rows_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands before each id of a text and its end, and their own rows."""
        y = self.row[np.append(ids.astype(np.int64), END)]
        return np.append(np.int32(self.start), y[:-1]), y

    def fit(self, texts: list[np.ndarray], rates: tuple[float, float], seed: int) -> None:
        """One pass over texts of ids in windows without overlap, in shuffled order; the rate falls from one to the other."""
        xs, ys, oks = [], [], []
        for ids in texts:
            x, y = self.rows_of(ids)
            short = -len(y) % WINDOW
            xs.append(np.append(x, np.full(short, self.start, np.int32)))
            ys.append(np.append(y, np.zeros(short, np.int32)))
            oks.append(np.arange(len(y) + short) < len(y))
        x, y, ok = (np.concatenate(v).reshape(-1, WINDOW) for v in (xs, ys, oks))
        order = np.random.default_rng(seed).permutation(len(x))
        batch = int(np.clip(len(x) // STEPS, *BATCH))
        for i in range(0, len(x), batch):
            j = order[i:i + batch]
            self.step(x[j], y[j], ok[j], rates[0] + (rates[1] - rates[0]) * i / len(x))


class Scorer:
    """A trained model laid out for scoring: distances as factors; embeddings end in a 1, which carries the sum of attention and then the biases."""

    def __init__(self, model: Attention):
        w, self.model = model.w, model
        self.pull = (np.exp(w["distance"])[model.back] * model.sees)[CONTEXT:].astype(np.float32)
        self.embed = np.concatenate([w["embed"], np.ones((len(w["embed"]), 1), np.float32)], 1)
        self.match = np.zeros((DIM + 1, DIM + 1), np.float32)
        self.match[:DIM, :DIM] = w["match"]
        joined = lambda a, b: np.ascontiguousarray(np.concatenate([a[:, :DIM], b[:, None], a[:, DIM:]], 1).T)
        self.of_class = joined(w["class"], w["class_bias"])
        edges = list(zip(model.lo[:-1], model.lo[1:]))
        self.inside = [joined(w["inside"][lo:hi], w["inside_bias"][lo:hi]) if hi - lo > 1 else None for lo, hi in edges]
        self.cls = model.cls.astype(np.uint8) if model.n_cls <= 256 else model.cls
        # Where no logit can leave the range of single precision, nothing needs a look. u is a mean of embeddings.
        norm = lambda a: float(np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
        reach = norm(w["embed"])
        near = lambda a, b: np.sqrt(2) * reach * norm(a) + float(np.abs(b).max(initial=0.0)) < 60
        self.calm = near(w["class"], w["class_bias"]) and near(w["inside"], w["inside_bias"])
        self.calm_match = reach * norm(w["embed"] @ w["match"]) < 60

    def log_p(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log probabilities of the rows ``y`` at the places after CONTEXT of windows ``x``, window after window."""
        m, n = self.model, y.size
        h = self.embed.take(x, 0, out=room("h", (*x.shape, DIM + 1), np.float32), mode="clip")
        a = np.matmul(h[:, CONTEXT:] @ self.match, turned(h), out=room("a", (len(x), WINDOW - CONTEXT, WINDOW), np.float32))
        if not self.calm_match and far(a):
            a -= np.where(self.pull > 0, a, -np.inf).max(-1, keepdims=True)
            np.minimum(a, 0, out=a)
        np.exp(a, out=a)
        a *= self.pull
        mixes = room("mixes", (len(x), WINDOW - CONTEXT, 2 * DIM + 1), np.float32)
        u = np.matmul(a, h, out=mixes[..., :DIM + 1])
        u /= u[..., DIM:].copy()
        mixes[..., DIM + 1:] = h[:, CONTEXT:, :DIM]
        # Once in order of classes, so that each class is one slice.
        c = self.cls[y]
        order = np.argsort(c, kind="stable")
        c, y = c[order], y[order]
        edge = np.searchsorted(c, np.arange(m.n_cls + 1))
        mix = mixes.reshape(n, -1).take(order, 0, out=room("mix", (n, 2 * DIM + 1), np.float32), mode="clip")
        out = own_log_p(np.matmul(mix, self.of_class, out=room("class", (n, m.n_cls), np.float32)), c, self.calm)
        y = y - m.lo[c]  # places in their classes
        edge = edge.tolist()
        for k, inside in enumerate(self.inside):
            lo, hi = edge[k], edge[k + 1]
            if inside is not None and lo < hi:
                z = np.matmul(mix[lo:hi], inside, out=room("inside", (hi - lo, inside.shape[1]), np.float32))
                out[lo:hi] += own_log_p(z, y[lo:hi], self.calm)
        back = np.empty_like(out)
        back[order] = out
        return back

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text; ``WINDOWS_AT_ONCE`` windows are in memory at a time."""
        pairs, stride = [self.model.rows_of(t) for t in texts], WINDOW - CONTEXT
        size = np.array([len(x) for x, _ in pairs], np.int64)
        count = -(-size // stride)
        # Each text with CONTEXT starts before it and filled up to whole windows: window k scores ids [k*stride, (k+1)*stride), at its places from CONTEXT on.
        lead, xs, ys = np.full(CONTEXT, self.model.start, np.int32), [], []
        for (x, y), k in zip(pairs, count):
            fill = np.zeros(k * stride - len(x), np.int32)
            xs += [lead, x, fill]
            ys += [y, fill]
        x, y = np.concatenate(xs), np.concatenate(ys)
        text = np.repeat(np.arange(len(texts)), count)
        at = np.arange(len(text)) * stride + text * CONTEXT
        begin = np.cumsum(count) - count
        real = np.arange(len(y)) < np.repeat(begin * stride + size, count * stride)
        out, span = np.zeros(len(texts)), np.arange(WINDOW)
        for i in range(0, len(text), WINDOWS_AT_ONCE):
            t, j = text[i:i + WINDOWS_AT_ONCE], slice(i * stride, (i + WINDOWS_AT_ONCE) * stride)
            p = self.log_p(x[at[i:i + WINDOWS_AT_ONCE, None] + span], y[j])
            p[y[j] == self.model.start - 1] -= self.model.unseen
            out += np.bincount(t, weights=np.where(real[j], p, 0).reshape(-1, stride).sum(1, dtype=np.float64), minlength=len(texts))
        return out


def room(name: str, shape: tuple, kind: np.dtype) -> np.ndarray:
    """Memory for an array of a step: what the name had before, as fresh pages would cost as much as the arithmetic."""
    n, had = int(np.prod(shape)), _rooms.get((name, kind))
    if had is None or len(had) < n:
        had = _rooms[name, kind] = np.empty(n, kind)
    return had[:n].reshape(shape)


def turned(h: np.ndarray) -> np.ndarray:
    """Each matrix transposed, laid out as products read it fastest."""
    out = room("turned", (len(h), h.shape[2], h.shape[1]), h.dtype)
    out[:] = h.transpose(0, 2, 1)
    return out


def far(z: np.ndarray) -> bool:
    """Whether exponentials of single precision need a shift."""
    return bool(z.size) and (z.max() > 60 or z.min() < -60)


def own_log_p(z: np.ndarray, own: np.ndarray, calm: bool = False) -> np.ndarray:
    """Log of the softmax of each row of ``z`` at ``own``; ``z`` is used up. ``calm``: no value is far from 0."""
    if not calm and far(z):
        z -= z.max(1, keepdims=True)
    mine = z[np.arange(len(z)), own]
    np.exp(z, out=z)
    return mine - np.log(z @ np.ones(z.shape[1], z.dtype))


def softmax_less_own(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Softmax of each row less 1 at ``own``: the gradient of its loss; ``z`` is used up."""
    if far(z):
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    z[np.arange(len(z)), own] -= 1
    return z


def id_counts(texts: DataFrame) -> np.ndarray:
    """How often each id occurs in ``texts(ids)``, ends included; tasks add up before a row for each id is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCAB, np.int64)
        for b in slices(batches):
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, np.uint16), minlength=VOCAB)
                total[END] += 1
        at = np.flatnonzero(total).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = texts.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(VOCAB, np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


PARAMETERS = "name string, at int, part int, touched binary, dw binary, ds binary"


def learnt(before: Attention, after: Attention, part: int) -> pa.Table:
    """What a task changed, in blocks of rows: changes of parameters and of their sums of squares, and which rows changed."""
    out = []
    for name, w in before.w.items():
        for at in range(0, len(w), BLOCK_ROWS):
            dw, ds = (new[name][at:at + BLOCK_ROWS] - old[name][at:at + BLOCK_ROWS] for new, old in ((after.w, before.w), (after.s, before.s)))
            touched = (ds.reshape(len(ds), -1).max(1) > 0).astype(np.int64)
            out.append((name, at, part, touched.tobytes(), dw.astype(np.float64).tobytes(), ds.astype(np.float64).tobytes()))
    return parameter_rows(out)


def parameter_rows(out: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["name", "at", "part", "touched", "dw", "ds"])


def added(t: pa.Table) -> pa.Table:
    """The sum of the blocks of one name and place."""
    rows = t.sort_by("part").to_pylist()
    sums = [sum(np.frombuffer(r[k], d) for r in rows) for k, d in (("touched", np.int64), ("dw", np.float64), ("ds", np.float64))]
    return parameter_rows([(rows[0]["name"], rows[0]["at"], rows[0]["part"] // FAN, *[v.tobytes() for v in sums])])


def averaged(model: Attention, changes: DataFrame, parts: int) -> None:
    """Move ``model`` by the mean of the changes of the tasks that touched a row; FAN sets are added up in a task, then FAN sums."""
    while parts > FAN:
        changes = changes.groupBy("name", "at", F.floor(F.col("part") / FAN).alias("fan")).applyInArrow(added, PARAMETERS)
        parts = -(-parts // FAN)
    for r in changes.groupBy("name", "at").applyInArrow(added, PARAMETERS).toArrow().to_pylist():
        w, s = (v[r["name"]][r["at"]:r["at"] + BLOCK_ROWS] for v in (model.w, model.s))
        n = np.maximum(1, np.frombuffer(r["touched"], np.int64)).reshape(-1, *[1] * (w.ndim - 1))
        w += (np.frombuffer(r["dw"], np.float64).reshape(w.shape) / n).astype(np.float32)
        s += (np.frombuffer(r["ds"], np.float64).reshape(w.shape) / n).astype(np.float32)


def train_attention(texts: DataFrame, share: float = SHARE, floor: int = FLOOR, task_ids: int = TASK_IDS, rounds: int = ROUNDS) -> Attention:
    """The model of ``texts(row, ids)``, counts and parameters: each row is in one task of one round of each epoch; a ``share`` below 1 takes rows by hash."""
    spark = texts.sparkSession
    counts = id_counts(texts)
    model, total = Attention(counts), int(counts.sum())
    if not total:
        return model
    want = min(total, floor + share * total)
    parts = max(1, -(-int(want) // task_ids))
    epochs = int(np.clip(floor // max(1, total), 1, EPOCHS))
    h = F.xxhash64(F.col("row"), F.lit("lm"))
    rows = texts if want == total else texts.where(F.pmod(h, F.lit(1 << 20)) < F.lit(int(np.ceil(want / total * (1 << 20)))))
    dealt = rows.select("row", "ids", F.pmod(F.shiftright(h, 20), F.lit(parts)).cast("int").alias("part"), F.pmod(F.shiftright(h, 40), F.lit(rounds)).cast("int").alias("round"))
    steps = rounds * epochs
    for i in range(steps):
        sent = spark.sparkContext.broadcast(model)
        rates = RATE * (1 - i / steps), RATE * (1 - (i + 1) / steps)

        def train(t: pa.Table) -> pa.Table:
            t, part = t.sort_by("row"), t.column("part")[0].as_py()
            own = Attention.__new__(Attention)
            own.__dict__ = dict(sent.value.__dict__, w={k: v.copy() for k, v in sent.value.w.items()}, s={k: v.copy() for k, v in sent.value.s.items()})
            own.fit([np.frombuffer(x, np.uint16) for x in t.column("ids").to_pylist()], rates, i * 10_007 + part)
            return learnt(sent.value, own, part)

        changes = dealt.where(F.col("round") == i % rounds).select("row", "ids", "part").groupBy("part").applyInArrow(train, PARAMETERS)
        averaged(model, changes, parts)
        sent.unpersist()
    return model


def attention_scores(texts: DataFrame, model: Attention) -> DataFrame:
    """(row, score) of every row of ``texts(row, ids)``; score is the log10 probability of the text."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in slices(batches, 64):
            if b.num_rows:
                score = scorer.score([np.frombuffer(x, np.uint16) for x in b.column(-1).to_pylist()]) / np.log(10)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], "score"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, f"{kept}, score double")


def lm_scores(docs: DataFrame, train: Column, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train`` marks the rows to learn from."""
    docs.sparkSession.sparkContext.addFile(path)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    texts = stored(read(rows, path), "lm-texts")
    ends = texts.where("train").count()
    words = stored(count_words(texts, path), "lm-words")
    every, total, distinct = words.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    total, distinct = total + ends, distinct + (ends > 0)
    mass = total + 0.5 * (distinct + 1)
    sums = word_scores(texts, words, every, mass, path)
    scored = attention_scores(texts.select("row", "doc_id", "train", "n", "ids"), train_attention(texts.where("train").select("row", "ids")))
    end = float(np.log10((ends + 0.5) / mass))
    return scored.join(sums, "row").select(
        "doc_id", "train", F.col("n").alias("n_tokens"), (F.col("known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("word_score") + end).alias("base_score"), "score")
