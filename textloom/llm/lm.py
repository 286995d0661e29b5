"""Scoring by a log-bilinear model trained with noise-contrastive estimation (operator 10).

Symbols are the end of a text, the frequent words, and classes of all other
words by their last bytes; their number follows the corpus up to SYMBOLS.  The
log-bilinear model predicts the next symbol from the two before it.  It has
vectors for all symbols and for groups of symbols of like frequency, trained
together by noise-contrastive estimation with drawn noise: each Spark task goes
over all its training texts, and the tasks' changes are averaged, in ROUNDS
rounds whatever the corpus's size.
A token's probability is that of its group times that of its symbol within the
group, each from a matrix product and normalised; a word of a class then gets
its smoothed share of the class's counts.  So a token's probability is one of a
distribution over all words, one unseen word for each class included.
All counts are Spark aggregates over every training text; what reaches the
driver is bounded: HEAD words, class totals and one model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, mix, pieces, read, signed, word_hashes, words, written

#: Bound on the symbols (they fit 16 bits), classes among them, the least count of a word that is one, and the symbols of a group.
SYMBOLS, CLASSES, LEAST, GROUP = 4096, 128, 20, 64
#: Words whose counts are broadcast (12 bytes each); the counts of all others are joined.
HEAD = 1 << 18
#: Length of the vectors; tokens of a training step, noise symbols drawn for it, rate of the first round.
SIZE, STEP, NOISE, RATE = 16, 1024, 64, 0.04
#: How often training goes over the whole corpus, of whatever size.
ROUNDS = 4
#: Fixed value: the end's stand-in among the hashed words.
END_HASH = np.uint64(0x0E0D_E0D0_E0D0_E0D0)
END = -1
ALPHA = 0.1
#: Rows of a model that are summed together.
BLOCK = 512
#: Bytes of text whose words are hashed together; tokens that are scored together; training steps that are laid out together.
NEAR, TOGETHER, AHEAD = 1 << 17, 1 << 11, 32


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class (END: none) of each token, the rows' first tokens; every row ends with one end token."""
    parts, at = [], 0
    while at < len(offs) - 1:  # a few rows at a time, which stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + NEAR, "right")) - 1)
        parts.append(_tokens(LOWER[data[offs[at] : offs[to]]], offs[at : to + 1] - offs[at]))
        at = to
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    hashes, kind, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, kind, np.concatenate([[0], np.cumsum(counts)])


def _tokens(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token, and the rows' numbers of tokens, of lower-cased rows."""
    starts, ends, first = words(low, offs)
    hashes = word_hashes(low, starts, ends)
    last = low[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else last
    kind = (mix(last * np.uint64(256) + before) % np.uint64(CLASSES)).astype(np.int64)
    at = first[1:]
    return np.insert(hashes, at, END_HASH), np.insert(kind, at, END), np.diff(first) + 1


@dataclass
class Model:
    """`head`: sorted hashes, with log10(c + ALPHA) and symbol (-1: one of a class); `classes`: each class's symbol;
    `share`: each symbol's part of the tokens; `rest`: log10 of its smoothed count total (0 for single words);
    `part`: the vectors, by name."""

    head: np.ndarray
    logs: np.ndarray
    symbol: np.ndarray
    classes: np.ndarray
    share: np.ndarray
    rest: np.ndarray
    part: dict[str, np.ndarray]
    n: int
    v: int

    def symbols(self, hashes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each token's symbol, whether this is its own, whether the head holds the token, and its log10(c + ALPHA) if so, else 0."""
        if not len(self.head):
            return self.classes[kind], *np.zeros((2, len(hashes)), bool), np.zeros(len(hashes))
        unique, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.head, unique), len(self.head) - 1)
        held = self.head[at] == unique
        own = np.where(held, self.symbol[at], -1)[back]
        return np.where(own >= 0, own, self.classes[kind]), own >= 0, held[back], np.where(held, self.logs[at], 0.0)[back]

    def state(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The prediction from each pair of context symbols, and a 1 for the bias."""
        p, q = self.part, np.ones((len(one), SIZE + 1), np.float32)
        # both vectors side by side, each with its last column, of zeros
        pairs = np.take(p["r"], np.stack([one, two], axis=1).reshape(-1), axis=0).reshape(len(one), -1)
        none = np.zeros((1, SIZE), np.float32)
        into = np.concatenate([p["one"][:, :SIZE], none, p["two"][:, :SIZE], none])
        for cut in _cuts(len(q), into.size):
            np.matmul(pairs[cut], into, out=q[cut, :SIZE])
        return q

    def log10(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 P(target | one, two): of the group, and of the symbol within it."""
        p, out = self.part, np.empty(len(target))
        order = np.argsort((target // GROUP).astype(np.uint16), kind="stable")
        one, two, target = one[order], two[order], target[order]
        edge = np.searchsorted(target // GROUP, np.arange(len(p["g"]) + 1))
        for g in np.flatnonzero(np.diff(edge)):
            inner = p["w"][g * GROUP : (g + 1) * GROUP]
            rows, groups = np.concatenate([p["g"], inner]), len(p["g"])
            across = rows.T.copy()
            parts = np.zeros((len(rows), 2), np.float32)
            parts[:groups, 0] = parts[groups:, 1] = 1
            longest = _dots(rows, rows).max()
            for at in range(edge[g], edge[g + 1], TOGETHER):
                cut = slice(at, min(at + TOGETHER, edge[g + 1]))
                q = self.state(one[cut], two[cut])
                scores = np.empty((len(q), len(rows)), np.float32)
                for part in _cuts(len(q), rows.size):
                    np.matmul(q[part], across, out=scores[part])
                # no score exceeds both lengths' product; maxima are taken off where exp could leave the numbers' range
                if _dots(q, q).max() * longest > 60**2:
                    for part in (scores[:, :groups], scores[:, groups:]):
                        part -= part.max(axis=1, keepdims=True)
                own = scores[:, g] + np.take(scores, np.arange(0, scores.size, len(rows)) + (groups - g * GROUP) + target[cut]).astype(float)
                out[order[cut]] = (own - np.log((np.exp(scores, out=scores) @ parts).astype(float)).sum(axis=1)) / np.log(10)
        return out


def _cuts(rows: int, each: int) -> list[slice]:
    """Parts of the rows for matrix products of `each` multiplications a row: products of under a million take the BLAS less time each."""
    size = max(1, 1_000_000 // each)
    size = -(-rows // -(-rows // size)) if rows else size
    return [slice(at, min(at + size, rows)) for at in range(0, rows, size)]


def contexts(symbols: np.ndarray, first: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each token and the one before that; `begin` before a text's first."""
    one, two = np.full(len(symbols), begin), np.full(len(symbols), begin)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    at = first[:-1]
    one[at] = begin
    two[at] = begin
    second = at + 1
    two[second[second < first[1:]]] = begin
    return one, two


def start(share: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random vectors; the biases (last column) are the symbols' and groups' own shares."""
    rng = np.random.default_rng(seed)
    n, groups = len(share), -(-len(share) // GROUP)
    draw = lambda rows: np.hstack([rng.normal(0, 0.1, (rows, SIZE)), np.zeros((rows, 1))]).astype(np.float32)
    part = {"r": draw(n + 1), "w": draw(n), "g": draw(groups), "one": np.eye(SIZE, SIZE + 1, dtype=np.float32) * 0.7, "two": np.eye(SIZE, SIZE + 1, dtype=np.float32) * 0.3}
    part["w"][:, SIZE] = np.log(share)
    part["g"][:, SIZE] = np.log(np.add.reduceat(share, np.arange(0, n, GROUP)))
    return part


class Trainer:
    """Steps of noise-contrastive estimation on a copy of a model's vectors, with a rate of its own for each row (Adagrad).

    The vectors of symbols and groups are one matrix here, with one more column, of zeros, and so are the two
    matrices that take contexts to predictions.  What depends on the symbols alone is laid out for AHEAD steps at once.
    """

    def __init__(self, model: Model, rate: float, seed: int, step: int = STEP):
        p, self.n, self.first = model.part, len(model.share), model
        self.out = np.pad(np.concatenate([p["w"], p["g"]]), ((0, 0), (0, 1)))
        self.into, self.r = np.concatenate([p["one"], p["two"]])[:, :SIZE].copy(), p["r"][:, :SIZE].copy()
        self.squares = {k: np.full(len(x), 1e-3, np.float32) for k, x in (("r", self.r), ("out", self.out), ("into", self.into))}
        self.seen_r, self.seen_w, self.tokens = np.zeros(len(self.r), np.int64), np.zeros(self.n, np.int64), 0
        self.rate, self.size, self.rng = rate, step, np.random.default_rng(seed)
        self.below = np.cumsum(model.share)
        self.noise = np.log(NOISE * np.concatenate([model.share, np.add.reduceat(model.share, np.arange(0, self.n, GROUP))])).astype(np.float32)

    @property
    def model(self) -> Model:
        wide, out = lambda x: np.pad(x, ((0, 0), (0, 1))), self.out[:, : SIZE + 1]
        part = {"r": wide(self.r), "w": out[: self.n], "g": out[self.n :], "one": wide(self.into[:SIZE]), "two": wide(self.into[SIZE:])}
        return Model(**{**vars(self.first), "part": {k: part[k] for k in self.first.part}})

    def seen(self) -> dict[str, np.ndarray]:
        """How many tokens have moved each row, by name."""
        every = np.full(SIZE, self.tokens)
        return {"r": self.seen_r, "w": self.seen_w, "g": np.add.reduceat(self.seen_w, np.arange(0, self.n, GROUP)), "one": every, "two": every}

    def change(self, name: str, x: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
        """One step down the gradients of distinct rows."""
        squares = np.take(self.squares[name], rows) + _dots(g, g) / np.float32(SIZE + 1)
        self.squares[name][rows] = squares
        g *= (self.rate / np.sqrt(squares))[:, None]
        _put(x, rows, np.subtract(np.take(x, rows, axis=0), g, out=g))

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        self.steps(one[None], two[None], target[None])

    def steps(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        """A step for each row: tells its tokens from NOISE symbols drawn by their shares, and the tokens' groups from the groups of these."""
        n, (k, size) = self.n, target.shape
        drawn = np.minimum(np.searchsorted(self.below, self.rng.random((k, NOISE)) * self.below[-1], "right"), n - 1)
        drawn.sort(axis=1)
        drawn = np.concatenate([drawn, n + drawn // GROUP], axis=1)
        # a symbol drawn several times is one column with its number as weight
        new = _new(drawn)
        at, number = np.flatnonzero(new), np.count_nonzero(new, axis=1)
        false, times = drawn.reshape(-1)[at], np.diff(at, append=drawn.size).astype(np.float32)
        column = np.zeros((k, len(self.out)), np.int32)
        column[np.arange(k)[:, None], drawn] = np.cumsum(new).reshape(drawn.shape)
        true = np.concatenate([target, n + target // GROUP], axis=1).astype(np.int32)
        value, token, at, each, lone, rest = together(true, np.tile(np.arange(size, dtype=np.int32), 2), len(self.out), n, column)
        pairs = np.stack([one, two], axis=2).reshape(k, -1)
        context, place, begin, contexts, single, _ = together(pairs.astype(np.int32), np.arange(2 * size, dtype=np.int32), n + 1, n + 1)
        parts = zip(pairs, _split(number, false, times, self.noise[false] * np.float32(0.5)), column, np.cumsum(number) - number, value, token, rest, _split(each, at), lone, context, place, _split(contexts, begin), single, strict=True)
        q = np.ones((size, SIZE + 2), np.float32)
        q[:, SIZE + 1] = 0
        for at in parts:
            self.move(q, *at)
        self.seen_w += np.bincount(target.reshape(-1), minlength=n)
        self.seen_r += np.bincount(one.reshape(-1), minlength=n + 1)
        self.tokens += target.size

    def move(self, q: np.ndarray, pairs: np.ndarray, drawn: tuple, column: np.ndarray, before: int, value: np.ndarray, token: np.ndarray, rest: int, firsts: tuple, lone: int, context: np.ndarray, place: np.ndarray, begin: tuple, single: int) -> None:
        """One step as laid out by `steps`; sigmoid(x) is (1 + tanh(x / 2)) / 2."""
        vectors = np.take(self.r, pairs, axis=0).reshape(len(q), -1)  # both side by side
        np.matmul(vectors, self.into, out=q[:, :SIZE])
        false, times, shift = drawn
        y = np.take(self.out, false, axis=0)
        half = (y * np.float32(0.5)).T.copy()
        half[SIZE] -= shift
        down = np.empty((len(q), len(false)), np.float32)
        cuts = _cuts(len(q), half.size)
        for cut in cuts:
            part = np.matmul(q[cut], half, out=down[cut])
            np.tanh(part, out=part)
            part += 1  # by half of `times` d loss / d score
        # a true symbol that is drawn has its score in the drawn one's column
        at = np.take(column, value[rest:])
        at -= before + 1
        weight = np.take(1 / times, at)
        at += token[rest:] * len(false)
        scores = down.reshape(-1)
        score = np.take(scores, at)
        weight *= score - 2
        weight += score
        scores[at] = weight
        times = (times * np.float32(0.5))[:, None]
        y, back, more = y[:, :SIZE] * times, np.empty((len(q), SIZE), np.float32), 0
        for cut in cuts:
            np.matmul(down[cut], y, out=back[cut])
            more += q[cut].T @ down[cut]
        # the others
        value, token = value[:rest], token[:rest]
        x, own = np.take(self.out, value, axis=0), np.take(q, token, axis=0)
        up = _dots(x, own)
        up -= np.take(self.noise, value)
        up *= 0.5
        np.tanh(up, out=up)
        up -= 1
        up *= 0.5
        up = up[:, None]
        x *= up
        own *= up
        split = np.count_nonzero(value < self.n)
        for cut in (slice(split), slice(split, None)):  # symbols and groups, each of any token once
            _put(back, token[cut], np.take(back, token[cut], axis=0) + x[cut, :SIZE])
        (at,) = firsts
        g = np.empty((len(at) + len(false), SIZE + 2), np.float32)
        _sums(own, at, lone, g)
        np.multiply(more.T, times, out=g[len(at) :])
        grads, into = (back @ self.into.T.copy()).reshape(-1, SIZE), (back.T @ vectors).T
        self.change("out", self.out, np.concatenate([value[at], false]), g)
        (at,) = begin
        g = np.empty((len(at), SIZE), np.float32)
        _sums(np.take(grads, place, axis=0), at, single, g)
        self.change("r", self.r, context[at], g)
        squares = self.squares["into"]
        squares += _dots(into, into) / np.float32(SIZE + 1)
        self.into -= into * (self.rate / np.sqrt(squares))[:, None]

    def text(self, symbols: np.ndarray, first: np.ndarray) -> None:
        """Steps over all tokens of some texts, in random order."""
        each = np.stack([*contexts(symbols, first, self.n), symbols], axis=1).astype(np.uint16)  # with the start of a text, symbols fit
        order = self.rng.permutation(len(symbols))
        whole = len(order) - len(order) % self.size
        for at in [*range(0, whole, AHEAD * self.size), whole]:
            here = order[at : min(at + AHEAD * self.size, whole)] if at < whole else order[at:]
            if len(here):
                self.steps(*each[here].T.astype(np.int64).reshape(3, -1, min(self.size, len(here))))


def together(x: np.ndarray, tags: np.ndarray, width: int, single: int, last: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Each row's values and the tags of their columns, sorted so that equal values stand together.

    First come those under `single` that stand once in the row, and last those that aren't 0 in `last`'s row.  Then,
    without these, where each value begins, and how many begin in a row; the numbers of values that stand once and
    that aren't in `last`.
    """
    k, m = x.shape
    at = x + np.arange(0, k * width, width)[:, None]
    kind = (np.bincount(at.reshape(-1), minlength=k * width) != 1).view(np.int8).reshape(k, width)
    kind[:, single:] = 1
    if last is not None:
        kind[last > 0] = 2
    kind = np.take(kind.reshape(-1), at)
    rest = np.count_nonzero(kind < 2, axis=1)
    lone = m - np.count_nonzero(kind, axis=1)
    # all in one number, of 32 bits where they are enough
    high, low = int(width).bit_length(), int(m).bit_length()
    key = kind.astype(np.int32 if high + low < 30 else np.int64)
    key <<= high
    key |= x
    key <<= low
    key |= tags
    key.sort(axis=1)
    value = key >> low
    new = _new(value)
    if last is not None:
        new &= np.arange(m) < rest[:, None]
    value &= (1 << high) - 1
    key &= (1 << low) - 1
    each = np.count_nonzero(new, axis=1)
    begin = np.flatnonzero(new) - np.repeat(np.arange(0, k * m, m), each)
    return value.astype(np.int64), key.astype(np.int64), begin, each, lone, rest


def _split(lengths: np.ndarray, *arrays: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The arrays cut into parts of these lengths."""
    ends = np.cumsum(lengths).tolist()
    return [tuple(x[a:b] for x in arrays) for a, b in zip([0, *ends], ends)]


def _new(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, along the last axis."""
    new = np.ones(x.shape, bool)
    np.not_equal(x[..., 1:], x[..., :-1], out=new[..., 1:])
    return new


def _sums(x: np.ndarray, at: np.ndarray, lone: int, out: np.ndarray) -> None:
    """Sums of the rows from each of `at` to the next, the first `lone` being single rows; two columns at a time, as a complex number."""
    out[:lone] = x[:lone]
    if lone < len(at):
        np.add.reduceat(x[lone:].view(np.complex64), at[lone:] - lone, axis=0, out=out[lone : len(at)].view(np.complex64))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The products of two arrays' rows, summed."""
    return (x * y) @ np.ones(x.shape[1], x.dtype)


def _put(x: np.ndarray, rows: np.ndarray, new: np.ndarray) -> None:
    """x[rows] = new, each row as one value."""
    row = f"V{x.strides[0]}"
    x.view(row)[:, 0][rows] = new.view(row)[:, 0]


def coded(docs: DataFrame, model: Model) -> DataFrame:
    """symbols: each text's, 2 bytes each; written once for all rounds."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in pieces(batches):
            hashes, kind, first = tokens(data, offs)
            symbols = held.value.symbols(hashes, kind)[0].astype("<u2")
            yield pa.record_batch([pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(symbols)])], names=["symbols"])

    return written(docs.select("text").mapInArrow(code, "symbols binary"), "symbols")


def average(symbols: DataFrame, model: Model, rate: float, step: int = STEP) -> dict[str, np.ndarray]:
    """The vectors after each task's steps over its texts' symbols: every row's changes, weighted by how often a task has seen it.

    A task sends one model of SYMBOLS rows at most; blocks of rows are summed
    as they stream, so a reducer holds its blocks' sums however many tasks there are.
    """
    held = symbols.sparkSession.sparkContext.broadcast(model)
    names = list(model.part)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(held.value, rate, TaskContext.get().partitionId(), step)  # a task that runs again draws the same
        for _, data, offs in pieces(batches, "symbols"):
            trainer.text(data.view("<u2").astype(np.int64), offs // 2)
        moved, part = trainer.seen(), trainer.model.part
        seen = np.concatenate([moved[k] for k in names]).astype(float)
        delta = np.concatenate([part[k] - held.value.part[k] for k in names])
        for at in range(0, len(seen), BLOCK):
            n = seen[at : at + BLOCK]
            if n.any():
                yield pa.record_batch([pa.array([at // BLOCK]), pa.array([n.tobytes()]), pa.array([(n[:, None] * delta[at : at + BLOCK]).astype(np.float32).tobytes()])], names=["block", "n", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, n, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                n, x = np.frombuffer(n), np.frombuffer(x, np.float32).astype(float)
                had = sums.get(block)
                sums[block] = (had[0] + n, had[1] + x) if had else (n, x)
        for block, (n, x) in sums.items():
            yield pa.record_batch([pa.array([block]), pa.array([n.tobytes()]), pa.array([x.tobytes()])], names=["block", "n", "x"])

    sent = symbols.mapInArrow(learn, "block long, n binary, x binary")
    total = np.concatenate([model.part[k] for k in names]).astype(float)
    for r in sent.repartition("block").mapInArrow(add, "block long, n binary, x binary").collect():  # one model
        n, x = np.frombuffer(r.n), np.frombuffer(r.x).reshape(-1, SIZE + 1)
        total[r.block * BLOCK : r.block * BLOCK + len(n)] += x / np.maximum(n, 1)[:, None]
    ends = np.cumsum([len(model.part[k]) for k in names])
    return {k: x.astype(np.float32) for k, x in zip(names, np.split(total, ends[:-1]), strict=True)}


def vocabulary(docs: DataFrame) -> DataFrame:
    """h, kind, c: how often each token stands in `docs`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in pieces(batches, most=8 << 20):
            hashes, kind, _ = tokens(data, offs)
            order = np.argsort(hashes)
            hashes = hashes[order]
            at = np.flatnonzero(_new(hashes))
            yield pa.record_batch([pa.array(signed(hashes[at])), pa.array(kind[order[at]]), pa.array(np.diff(at, append=len(hashes)))], names=["h", "kind", "c"])

    return docs.select("text").mapInArrow(count, "h long, kind long, c long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))


def fit(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE, step: int = STEP) -> tuple[Model, DataFrame]:
    """The model of all texts in `docs`, and the whole vocabulary's counts.

    Every one of the `rounds` goes over all texts, whatever their number.
    """
    counts = written(vocabulary(docs), "vocabulary")
    # the least count that HEAD words or fewer have, from a histogram by eighths of a power of two
    steps = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()  # 512 rows at most
    least, total = None, 0
    for r in steps:
        total += r.n
        if total > HEAD:
            break
        least = r.c
    end = F.col("h") == int(signed(np.array([END_HASH]))[0])
    top = counts.where((F.col("c") >= least if least else F.lit(False)) | end).select("h", "c").toArrow()  # HEAD rows and the end at most
    # the words that are symbols, whether HEAD holds them or not
    first = counts.where(~end & (F.col("c") >= LEAST)).orderBy(F.desc("c"), "h").limit(SYMBOLS - CLASSES - 1).select("h", "c").toArrow()
    h, at = np.unique(np.concatenate([t.column("h").to_numpy() for t in (top, first)]), return_index=True)
    c = np.concatenate([t.column("c").to_numpy() for t in (top, first)])[at]
    order = np.lexsort((h, -c))
    h, c = h[order].view(np.uint64), c[order]
    own = np.isin(signed(h), first.column("h").to_numpy()) | (h == END_HASH)
    names = docs.sparkSession.createDataFrame([(int(x),) for x in signed(h[own])], "h long")
    others = counts.join(F.broadcast(names), "h", "left_anti")  # SYMBOLS rows at most
    total, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in others.where(~end).groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # CLASSES rows
        total[r.kind], types[r.kind] = r.c, r.n
    everything = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # symbols by how often they stand, so that a group's are of like frequency
    mass = np.concatenate([c[own], total])
    place = np.empty(len(mass), np.int64)
    place[np.argsort(-mass, kind="stable")] = np.arange(len(mass))
    symbol = np.full(len(h), -1)
    symbol[own] = place[: own.sum()]
    classes = place[own.sum() :]
    # an end that no text has is a symbol of a class
    classes = np.append(classes, symbol[h == END_HASH] if (h == END_HASH).any() else classes[:1])
    rest, share = np.zeros(len(mass)), np.empty(len(mass))
    rest[classes[:CLASSES]] = np.log10(total + ALPHA * (types + 1))
    share[place] = (mass + 0.5) / (mass.sum() + 0.5 * len(mass))
    order = np.argsort(h)
    model = Model(h[order], np.log10(c + ALPHA)[order], symbol[order], classes, share, rest, start(share), int(everything[0]), int(everything[1]))
    symbols = coded(docs, model)
    for at in range(rounds):
        model.part = average(symbols, model, rate / (1 + at), step)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each whole text.

    Null and empty texts are their end token alone.  Rows are kept apart also
    where a doc_id is repeated or null.  A model of no texts gives every class
    the same part.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # HEAD words and the vectors
    base = float(np.log10(model.n + ALPHA * (model.v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for rows, data, offs in pieces(batches):
            hashes, kind, first = tokens(data, offs)
            symbols, own, known, logs = m.symbols(hashes, kind)
            lm = m.log10(*contexts(symbols, first, len(m.share)), symbols) + np.where(own, 0.0, logs - m.rest[symbols])
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
            rare = np.flatnonzero(~known)
            doc = np.searchsorted(first, rare, "right") - 1
            # the rare words of each row, once each
            order = np.lexsort((hashes[rare], doc))
            rare, doc = rare[order], doc[order]
            new = np.ones(len(rare), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (hashes[rare][1:] != hashes[rare][:-1])
            begin = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[begin], np.arange(len(first))), pa.int32()), pa.StructArray.from_arrays([pa.array(signed(hashes[rare[begin]])), pa.array(np.diff(np.append(begin, len(rare))).astype(np.int32))], ["h", "n"]))
            yield pa.record_batch([rows.column("doc_id"), rows.column("row"), pa.array(np.diff(first)), pa.array(sums(known)), pa.array(sums(logs)), pa.array(sums(lm)), lists], names=["doc_id", "row", "n_tokens", "known", "logs", "lm", "rare"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    part = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, logs double, lm double, rare array<struct<h: long, n: int>>")
    part = written(part, "scores")
    rare = part.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n")
    found = rare.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    out = part.drop("rare").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("logs") + more - F.col("n_tokens") * base).alias("base_score"), (F.col("lm") + more).alias("score"))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 10 == 0, F.lit(False))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    model, counts = fit(docs.where(~held_out()))
    return score(docs, model, counts).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
