"""Scoring texts by a hierarchical Pitman-Yor language model.

The model. Every word of the training texts, and the beginning of a text, is a context with a
restaurant of its own; all of these share the root restaurant as their parent, which draws from a
uniform base. What they serve are symbols: every word of the training texts, the end of a text, and one
unknown word. So the probabilities of all words, the unknown one and the end sum to 1 in every
context; a context that training never showed is the root.

Counting. Words are counted (combined in tasks). Words with at least 1/`FREQUENT` of all training tokens
(so at most `FREQUENT` words) are known by number in every task, the rare ones by their hashes. Then
each task packs the steps (context, symbol, text) of a chunk of texts, sorted, by parts of the contexts: a
context once, a pair of context and symbol once (with its hash where it is rare), and two bytes a token for
its text. A context with a large share of all tokens is dealt over several parts by its symbols; how large
each is, is known from the counts of words. The same dealt steps serve the fit and the scores, so steps
are not shuffled again.

Fitting. A part holds whole restaurants. They are seated by Gibbs sampling: for each dish the number
of its tables is drawn from its exact conditional distribution given all others (a Stirling
number, the concentration's rising factorial and the parent's probability), `BURN` sweeps before
`KEEP` samples are averaged; Stirling numbers come from rows, or from an integral for dishes of any size.
First the parent is the distribution of symbols; tables are summed by symbol, the root is seated with
them as customers, and then all restaurants are seated again under it. Restaurants that may lie in several
parts are seated there apart: their parts take the tables elsewhere from the first seating, and the tables
of the second are summed before any score. A rare word that no context meets twice has as many tables as
tokens; where a part has a context that does, it asks for the word's probability in the parent and tells by how
many its tables are fewer, both by a shuffle by word. Dishes of the root differ in nothing but their
number of customers, so all those of one number are drawn at once, as a multinomial of their tables.

Scoring. Predictive probabilities are linear in the tables, so their mean over the samples is that of
the mean tables. A part gives each chunk the sums of its texts' logarithms. For steps to rare words it
gives the two numbers a and b such that the step's probability is a + b times the word's in the root, and these
rows meet the word by a shuffle. Words are 64-bit hashes throughout.

The input is read three times and must give the same rows in the same order each time, as Parquet
files do; an input whose plan shuffles is written to the shared folder first.

Edge cases: null and empty texts are one end token; a row with a null id counts as id "" for the
fold; repeated rows count and are scored each; without training texts every word has the uniform
probability over the unknown and the end; an empty table gives an empty table; columns other than id
and text are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import Spool, groups, map_arrow
from .shingles import mix, word_hashes

#: Share of the rarest word that is known by number; sweeps before sampling, samples.
FREQUENT, BURN, KEEP = 1 << 20, 3, 3
#: Customers of a dish up to which all sizes, and up to which some, have rows of Stirling numbers; tables of a
#: row; beyond those, steps of an integral and places that it is taken at.
EXACT, LARGEST, TABLES, STEPS, WIDTHS, GRID = 128, 16_384, 1_024, 48, 12, 65
#: Tokens that a task holds before it combines them, and before it packs them (which takes about 100
#: bytes a token); texts of a chunk; tokens of a part, about.
HELD, CHUNK, CHUNK_TEXTS, PART = 4_000_000, 1_500_000, 1 << 15, 2_000_000
#: Concentration of all restaurants; the contexts' discount in the first seating, before it is estimated.
THETA, FIRST = 1.0, 0.75
#: Different numbers of rare words' customers in the root up to which their probabilities are broadcast (16 bytes each).
KINDS = 1 << 20
#: The context of a text's beginning, ranges of symbols that tables are summed by.
_BEGIN, _RANGES = np.uint64(0x9E3779B97F4A7C15), 32
_ODD = np.uint64(0xD1342543DE82EF95)


def _count_words(docs: DataFrame) -> DataFrame:
    """Rows h, n: words and, under a null h, texts; combined within each task."""
    most = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            seen += len(batch)
            for _, _, words, _ in word_hashes(batch.column(0).to_pylist()):
                held.append(words)
                total += len(words)
                if total > most:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([seen], pa.int64())], ["h", "n"])

    return map_arrow(docs, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _symbols(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Symbols of words; `known` ascending; a rare word is len(known)."""
    if not len(known):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, len(known))


def _squeezed(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """`data` cut into compressed values of `counts` elements, each after its size: Spark's own codec packs these numbers less well."""
    codec, end = pa.Codec("zstd"), np.append(0, np.cumsum(counts))
    cut = (np.ascontiguousarray(data[a:b]).tobytes() for a, b in zip(end, end[1:]))
    return pa.array([len(x).to_bytes(4, "little") + codec.compress(x, asbytes=True) for x in cut], pa.binary())


def _size(x: bytes) -> int:
    return int.from_bytes(x[:4], "little")


def _unsqueezed(x: bytes) -> bytes:
    """A value of `_squeezed`."""
    return pa.decompress(memoryview(x)[4:], _size(x), "zstd", asbytes=True)


def _pack(first: int, words: np.ndarray, owner: np.ndarray, train: np.ndarray, known: np.ndarray, hot: tuple[np.ndarray, np.ndarray], parts: int) -> pa.RecordBatch:
    """A chunk's steps by part; `first`: the number of its first text, `train`: a flag for each text."""
    count, tail = len(train), len(known)
    uniq, local = np.unique(words, return_inverse=True)
    symbol = _symbols(uniq, known)
    symbol = np.where(symbol < tail, symbol, tail + 2 + np.arange(len(uniq)))  # rare words by their place in the chunk
    at = np.arange(len(words)) + owner  # an end stands after each text before
    ends = np.cumsum(np.bincount(owner, minlength=count)) + np.arange(count)
    n = len(words) + count
    # Context, symbol and text of each step in one number; the text before an end begins the next.
    key = np.full(n, len(uniq), np.uint64)
    key[np.minimum(at + 1, n - 1)] = local
    key[np.append(0, ends[:-1] + 1)] = len(uniq)
    key <<= np.uint64(24)
    key[at] |= symbol[local].astype(np.uint64)
    key[ends] |= np.uint64(tail + 1)
    key <<= np.uint64(16)
    key[at] |= ((owner << 1) | train[owner]).astype(np.uint64)
    key[ends] |= ((np.arange(count) << 1) | train).astype(np.uint64)
    del at, local, owner, words
    key.sort()
    pair = key >> np.uint64(16)
    start = np.flatnonzero(np.diff(pair, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)))
    times = np.diff(np.append(start, n))
    frm, to = (pair[start] >> np.uint64(24)).astype(np.int64), (pair[start] & np.uint64((1 << 24) - 1)).astype(np.uint32)
    hashes = np.append(uniq, _BEGIN)
    split = np.ones(len(hashes), np.uint64)
    if len(hot[0]):
        place = np.minimum(np.searchsorted(hot[0], hashes), len(hot[0]) - 1)
        split = np.where(hot[0][place] == hashes, hot[1][place], 1).astype(np.uint64)
    word = np.where(to > tail + 1, uniq[np.maximum(to.astype(np.int64) - tail - 2, 0)], to) if len(uniq) else to.astype(np.uint64)
    part = (mix(hashes[frm] + (word % split[frm]) * _ODD) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part, frm, to, word, start, times = part[order], frm[order], to[order], word[order], start[order], times[order]
    own = (key & np.uint64(0xFFFF)).astype(np.uint16)[np.repeat(start - (np.cumsum(times) - times), times) + np.arange(n)]
    fresh = np.ones(len(part), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (frm[1:] != frm[:-1])
    begin = np.flatnonzero(fresh)
    held = np.diff(np.append(begin, len(part))).astype(np.uint32)
    rare = to > tail + 1
    pairs, contexts, steps, rares = (np.bincount(part, weights=w, minlength=parts).astype(np.int64) for w in (None, fresh, times, rare))
    some, to = pairs > 0, np.where(rare, np.uint32(tail), to)
    planes = [(to >> np.uint32(8 * k)).astype(np.uint8) for k in range(3)]
    columns = [pa.array(np.flatnonzero(some).astype(np.int32)), pa.array(np.full(int(some.sum()), first)), _squeezed(hashes[frm[begin]], contexts[some]), _squeezed(held, contexts[some])]
    columns += [_squeezed(x, pairs[some]) for x in (*planes, times.astype(np.uint32))] + [_squeezed(own, steps[some]), _squeezed(word[rare], rares[some])]
    return pa.RecordBatch.from_arrays(columns, ["part", "chunk", "u", "held", "w0", "w1", "w2", "times", "own", "rare"])


def _deal(docs: DataFrame, known: np.ndarray, hot: tuple[np.ndarray, np.ndarray], parts: int) -> RDD:
    """The steps of all texts (text, train), keyed and dealt by part; chunks are numbered by their first text."""
    shared = docs.sparkSession.sparkContext.broadcast((known, hot))
    most, most_texts = CHUNK, CHUNK_TEXTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot = shared.value
        first, words, owners, flags, total, texts = TaskContext.get().partitionId() << 40, [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            return _pack(first, np.concatenate(words), np.concatenate(owners), np.concatenate(flags), known, hot, parts)

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for place, count, found, owner in word_hashes(batch.column(0).to_pylist()):
                for a in range(0, count, most_texts):  # runs of many short texts
                    b = min(a + most_texts, count)
                    x, y = np.searchsorted(owner, [a, b])
                    if texts and (total > most or texts + b - a > most_texts):
                        yield out()
                        first, words, owners, flags, total, texts = first + texts, [], [], [], 0, 0
                    words.append(found[x:y])
                    owners.append((owner[x:y] - a + texts).astype(np.int32))
                    flags.append(train[place + a : place + b])
                    total, texts = total + y - x, texts + b - a
        if texts:
            yield out()

    schema = "part int, chunk long, u binary, held binary, w0 binary, w1 binary, w2 binary, times binary, own binary, rare binary"
    return map_arrow(docs, run, schema).rdd.map(lambda r: (r["part"], r)).partitionBy(parts, _itself)


def _itself(part: int) -> int:
    """Where a part's rows go: all that is keyed by part lies in the same tasks, so it meets without a shuffle."""
    return part


class _Part:
    """A part's restaurants: its pairs of context and symbol with their counts in training.

    Symbols from `tail` + 2 on are the part's rare words, in the order of `rare`, their hashes; `root` has the
    parent's probabilities of those that the part asked for.
    """

    def __init__(self, found: Iterator[tuple[int, Row]], tail: int):
        rows, told = [], []
        for _, row in found:
            (told if len(row) == 2 else rows).append(row)
        join = lambda name, kind: np.frombuffer(b"".join(_unsqueezed(r[name]) for r in rows), kind)
        self.contexts, at = np.unique(join("u", "<u8"), return_inverse=True)
        w = join("w0", np.uint8).astype(np.int64) | (join("w1", np.uint8).astype(np.int64) << 8) | (join("w2", np.uint8).astype(np.int64) << 16)
        self.rare, place = np.unique(join("rare", "<u8"), return_inverse=True)
        w[w == tail] = tail + 2 + place
        key, of = np.unique((np.repeat(at, join("held", "<u4")) << 32) | w, return_inverse=True)
        self.u, self.w = key >> 32, key & ((1 << 32) - 1)
        own = join("own", "<u2")
        self.chunks, self.steps, self.tail = [r["chunk"] for r in rows], [_size(r["own"]) // 2 for r in rows], tail
        self.own, self.pair = own >> 1, np.repeat(of, join("times", "<u4"))
        self.c = np.bincount(self.pair, weights=own & 1, minlength=len(key)).astype(np.int64)
        self.root = np.ones(len(self.rare))
        for h, p in told:
            self.root[np.searchsorted(self.rare, np.frombuffer(h, "<u8"))] = np.frombuffer(p, "<f8")

    def base(self, symbols: np.ndarray) -> np.ndarray:
        """The parent's probability of each pair's symbol (1 for rare words that were not asked for)."""
        return np.concatenate([symbols, self.root])[self.w]

    def rare_sums(self, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the rare words among some pairs, and their sums of `x`."""
        at, of = np.unique(self.w[rows] - self.tail - 2, return_inverse=True)
        return self.rare[at], np.bincount(of, x[rows], len(at))

    def repeated(self) -> np.ndarray:
        """The pairs of a rare word that training has more than once: only they can share a table."""
        return np.flatnonzero((self.w > self.tail + 1) & (self.c > 1))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithms of the gamma function for x > 0."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    for _ in range(8):
        low, x = np.where(x < 8, low + np.log(x), low), np.where(x < 8, x + 1, x)
    return (x - 0.5) * np.log(x) - x + (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x - low


class Seats:
    """How customers of one dish may sit: generalised Stirling numbers S(c, t) of a discount.

    Up to `EXACT` customers there is a row for each number of them; beyond, up to `LARGEST`, for sizes a
    tenth apart, and what lies between is interpolated. A row has the logarithms for 1 to `TABLES` tables.
    Dishes with more customers, and those that may have more tables than a row tells, need no row:
    `_contour` integrates the numbers' generating function for just the tables that are likely.
    """

    def __init__(self, d: float, most: int):
        self.d, sizes = d, [*range(1, EXACT + 1)]
        while sizes[-1] < LARGEST:
            sizes.append(min(int(sizes[-1] * 1.1), LARGEST))
        self.sizes = np.array(sizes[: np.searchsorted(sizes, min(max(most, 1), LARGEST)) + 1])
        self.log = np.full((len(self.sizes), min(TABLES, int(self.sizes[-1]))), -np.inf)
        now, t, row = np.full(self.log.shape[1], -np.inf), np.arange(1, self.log.shape[1] + 1), 0
        now[0] = 0.0  # one customer, one table
        for c in range(1, int(self.sizes[-1]) + 1):
            if c == self.sizes[row]:
                self.log[row], row = now, row + 1
            after = now + np.log(np.maximum(c - t * d, 1e-300))
            after[1:] = np.logaddexp(after[1:], now[:-1])
            now = np.where(t <= c + 1, after, -np.inf)

    def draw(self, c: np.ndarray, others: np.ndarray | float, base: np.ndarray | float, rng: np.random.Generator, times: np.ndarray | None = None) -> np.ndarray:
        """Tables of dishes with c customers, each from its conditional distribution given the number of
        the restaurant's other tables and the parent's probability of the dish (either may be one
        number for all). With `times` c are different numbers, there are so many dishes of each, all are
        drawn, and their mean tables told."""
        out = np.minimum(c, 1).astype(np.int64 if times is None else np.float64)
        row = np.searchsorted(self.sizes, c)
        alike = np.ndim(others) == 0 and np.ndim(base) == 0
        beyond = [np.flatnonzero(row == len(self.sizes))]
        for k in np.unique(row[(c > 1) & (row < len(self.sizes))]):
            rows, size = np.flatnonzero((row == k) & (c > 1)), int(self.sizes[k])
            tables = min(size, self.log.shape[1])
            j = np.arange(tables)
            # Dishes that differ in nothing share one distribution.
            sets = [rows[c[rows] == x] for x in np.unique(c[rows])] if alike else np.array_split(rows, -(-len(rows) * tables // 500_000))
            for some in sets:
                n, b, o = (np.full(1, x[some[0]] if np.ndim(x) else x) if alike else np.broadcast_to(x, len(c))[some] for x in (c, base, others))
                log = self.log[k, :tables] + np.log(b)[:, None] * (j + 1) + np.cumsum(np.log(THETA + self.d * (o[:, None] + j)), axis=1)
                if size > EXACT:
                    less, this = (x[:tables] - x[0] for x in self.log[k - 1 : k + 1])
                    there = np.isfinite(less)
                    log[:, there] -= (np.log(size / n) / np.log(size / self.sizes[k - 1]))[:, None] * (this[there] - less[there])
                    log[j >= n[:, None]] = -np.inf
                p = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
                if times is None:
                    u = rng.random(len(some)) * p[:, -1]
                    out[some] = 1 + (np.searchsorted(p[0], u) if alike else (p < u[:, None]).sum(1))
                else:
                    out[some] = 1 + rng.multinomial(times[some[0]], np.diff(p[0], prepend=0.0) / p[0, -1]) @ j / times[some[0]]
                if tables < size:  # a row that breaks off where tables are still likely
                    beyond.append(some[np.broadcast_to(p[:, -1] - p[:, -2] > 1e-9 * p[:, -1], len(some))])
        rows = np.concatenate(beyond)
        if len(rows):
            _, lead, of = np.unique(c[rows] if alike else rows, return_index=True, return_inverse=True)
            for first in range(0, len(lead), 64):
                some, here = rows[lead[first : first + 64]], np.flatnonzero((of >= first) & (of < first + 64))
                n, b, o = (np.broadcast_to(x, len(c))[some].astype(np.float64) for x in (c, base, others))
                if times is None:
                    out[rows[here]] = self._contour(n, o, b, rng, of[here] - first)
                else:
                    drawn = self._contour(n, o, b, rng, np.repeat(np.arange(len(some)), times[some]))
                    out[some] = np.add.reduceat(drawn, np.cumsum(times[some]) - times[some]) / times[some]
        return out

    def _contour(self, c: np.ndarray, others: np.ndarray, base: np.ndarray, rng: np.random.Generator, of: np.ndarray) -> np.ndarray:
        """`draw` without rows, at the same cost for any number of customers: a draw from distribution
        `of[i]` for each i.

        S(c, t) is c! / (t! d^t) times the coefficient of x^c in (1 - (1 - x)^d)^t, an integral over
        y = log x around the cut y >= 0: here on a parabola about 0 through the saddle point, where
        `STEPS` steps give it to about 1e-6. The most likely t solves the saddle's equation together
        with the mode's; weights are taken at up to `GRID` places around it, within eight times its
        spread, and t is drawn from the line through their sums.
        """
        d, a = self.d, THETA / self.d + others
        low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)  # log v for v = 1 - x


        def pull(log_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The t whose saddle lies there, and the slope of its log weight."""
            g = -np.expm1(d * log_v)
            t = c * g / (d * np.exp((d - 1) * log_v) * -np.expm1(log_v))
            return t, np.log(g) + np.log(base) + np.log((a + t) / t)

        for _ in range(60):
            mid = (low + high) / 2
            few = pull(mid)[1] > 0
            low, high = np.where(few, mid, low), np.where(few, high, mid)
        (t, h), (t2, h2) = pull(mid), pull(mid * (1 + 1e-5))
        spread = np.sqrt(np.clip((t2 - t) / np.where(h2 == h, -1.0, h - h2), 0, t))
        t, v = np.clip(t, 1.0, c), np.exp(mid)
        wide = 8 * np.maximum(spread, 1) + 4
        first, last = np.maximum(1, np.floor(t - wide)), np.minimum(c, np.ceil(t + wide))
        step = np.maximum(1.0, (last - first) / (GRID - 1))
        at = first[:, None] + step[:, None] * np.arange(GRID)
        at, inside = np.minimum(at, c[:, None]), at <= last[:, None] + step[:, None] / 2
        m = np.maximum(-np.log1p(-np.minimum(v, 1 - 1e-12)), 4 / c)
        v = -np.expm1(-m)
        slope = d * v ** (d - 1) * (1 - v) / (1 - v**d)
        bend = t * slope * ((1 - d) * (1 - v) / v + 1 - slope)
        width = np.minimum(1 / np.sqrt(np.maximum(np.minimum(4 * m * m * bend, 2 * c * m), 1e-300)), 0.5)
        u = np.minimum(WIDTHS * width, np.pi / (2 * m))[:, None] * np.arange(STEPS) / STEPS
        turn = 1 - 1j * u
        inner = np.log(1 - (-np.expm1(-m[:, None] * turn**2)) ** d)
        outer = (c * m)[:, None] * (turn**2 - 1)
        weight = np.where(np.arange(STEPS) == 0, 0.5, 1.0) * turn
        total = np.einsum("nk,ntk->nt", weight, np.exp(at[:, :, None] * (inner - inner[:, :1])[:, None, :] + outer[:, None, :])).real
        log = np.log(np.maximum(total, 1e-300)) + at * (inner[:, :1].real + np.log(base)[:, None]) + _lgamma(a[:, None] + at) - _lgamma(at + 1)
        log[~inside] = -np.inf
        p = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
        x = rng.random(len(of)) * p[of, -1]
        k = np.concatenate([(p[of[i : i + 100_000]] < x[i : i + 100_000, None]).sum(1) for i in range(0, len(of), 100_000)])
        before = np.where(k > 0, p[of, k - 1], 0.0)
        over = (x - before) / (p[of, k] - before)
        drawn = at[of, k] + np.where(step[of] > 1, (over - 0.5) * step[of], 0.0)
        return np.clip(np.rint(drawn), 1, c[of]).astype(np.int64)


def discount(counts: np.ndarray, times: np.ndarray | None = None) -> float:
    """The usual estimate from how many counts are 1 and 2."""
    times = np.ones(len(counts)) if times is None else times
    one, two = times[counts == 1].sum(), times[counts == 2].sum()
    return float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one else 0.5


def seat(c: np.ndarray, group: np.ndarray, base: np.ndarray, seats: Seats, rng: np.random.Generator, elsewhere: np.ndarray, sweeps: tuple[int, int] = (BURN, KEEP)) -> tuple[np.ndarray, np.ndarray]:
    """Mean tables of each dish and of each restaurant over the samples of a Gibbs run.

    `group`: a dish's restaurant, `base`: the parent's probability of the dish, `elsewhere`: tables of
    each restaurant that other parts hold. Dishes of a sweep are drawn given the tables before it.
    """
    t, mean, few = np.minimum(c, 1).astype(np.int64), np.zeros(len(c)), np.flatnonzero(c > 1)
    for sweep in range(sum(sweeps)):
        total = np.bincount(group, t, len(elsewhere)) + elsewhere
        t[few] = seats.draw(c[few], (total[group] - t)[few], base[few], rng)
        if sweep >= sweeps[0]:
            mean += t
    mean /= sweeps[1]
    return mean, np.bincount(group, mean, len(elsewhere)) + elsewhere


def predictive(c: np.ndarray, tables: np.ndarray, customers: np.ndarray, all_tables: np.ndarray, base: np.ndarray, d: float) -> np.ndarray:
    """The probability of dishes in restaurants with so many customers and tables."""
    return (c - d * tables + (THETA + d * all_tables) * base) / (THETA + customers)


def fit_counts(c: np.ndarray, words: np.ndarray, seed: int = 0) -> np.ndarray:
    """Averaged probabilities in the root of a dish with c[i] customers (all different), where words[i] dishes have so many."""
    rng, kinds, n = np.random.default_rng(seed), int(words.sum()), int((c * words).sum())
    seats = Seats(discount(c[c > 0], words[c > 0]), int(c.max(initial=0)))
    mean, p = np.minimum(c, 1).astype(float), np.zeros(len(c))
    for sweep in range(BURN + KEEP):
        total = float((mean * words).sum())
        mean = seats.draw(c, max(total - total / max(kinds, 1), 0.0), 1 / max(kinds, 1), rng, words)
        if sweep >= BURN:
            p += predictive(c, mean, n, (mean * words).sum(), 1 / max(kinds, 1), seats.d)
    return p / KEEP


def fit_root(c: np.ndarray, seed: int = 0) -> np.ndarray:
    """Averaged probabilities of all symbols in the root, whose customers are the tables below."""
    counts, of, words = np.unique(np.maximum(np.rint(c), 0).astype(np.int64), return_inverse=True, return_counts=True)
    return fit_counts(counts, words, seed)[of]


def fit_tail(c: np.ndarray, words: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Averaged probabilities in the root of a word with c[i] > 0 customers (there are words[i] of them), and of
    the unknown word."""
    counts, of = np.unique(np.append(c, 0), return_inverse=True)
    p = fit_counts(counts.astype(np.int64), np.bincount(of, np.append(words, 1)).astype(np.int64), seed)[of]
    return p[:-1], float(p[-1])


def _group(part: _Part, hot: np.ndarray) -> np.ndarray:
    """Of each context of a part its place among those that may be dealt over several parts, or -1."""
    at = np.minimum(np.searchsorted(hot, part.contexts), len(hot) - 1)
    return np.where(hot[at] == part.contexts, at, -1)


def _seated(part: _Part, base: np.ndarray, seats: Seats, k: int, place: np.ndarray, elsewhere: np.ndarray, only_hot: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """`seat` of a part's restaurants; those in `place` apart and first, so both seatings under one parent
    that ask for them give them the same tables. `elsewhere`: of those, tables in other parts."""
    n, large = len(part.contexts), place[part.u] >= 0
    outside = np.zeros(n)
    outside[place >= 0] = elsewhere[place[place >= 0]]
    mean = np.zeros(len(part.c))
    for salt, rows in enumerate((large, ~large)[: 1 if only_hot else 2]):
        mean[rows], _ = seat(part.c[rows], part.u[rows], base[rows], seats, np.random.default_rng([k, salt]), outside)
    return mean, np.bincount(part.u, mean, n)


def _tables(dealt: RDD, symbols: np.ndarray, hot: tuple[np.ndarray, np.ndarray], seats: Seats, spool: Spool, only_hot: bool = False) -> tuple[np.ndarray, np.ndarray, float, DataFrame]:
    """Tables by symbol and by context of `hot` (hashes, tables that lie elsewhere for a part), of a
    seating under the distribution `symbols`; the discount that all pairs' counts give; and rows h, fewer: by how many
    the tables of rare words are fewer than their tokens. `only_hot`: seat the contexts of `hot` only."""
    spark, shared, width = spool.spark, spool.spark.sparkContext.broadcast((symbols, seats, *hot)), -(-len(symbols) // _RANGES)

    def run(k: int, rows: Iterator[tuple[int, Row]]) -> Iterator[tuple[int, bytearray, bytearray]]:
        base, seats, hashes, elsewhere = shared.value
        part = _Part(rows, len(base) - 2)
        if not part.chunks:
            return
        place = _group(part, hashes)
        mean, of = _seated(part, part.base(base), seats, k, place, elsewhere, only_hot)
        pack = lambda r, i, x, kind="<i4": (r, bytearray(np.asarray(i).astype(kind).tobytes()), bytearray(np.asarray(x).astype("<f8").tobytes()))
        yield pack(_RANGES, place[place >= 0], of[place >= 0])
        if only_hot:
            return
        yield pack(_RANGES + 1, [0, 1], [(part.c == 1).sum(), (part.c == 2).sum()])
        yield pack(_RANGES + 2, *part.rare_sums(part.c - mean, part.repeated()), "<u8")
        some = part.w < len(base)
        w, at = np.unique(part.w[some], return_inverse=True)
        sums, edges = np.bincount(at, mean[some], len(w)), np.searchsorted(w, np.arange(_RANGES + 1) * width)
        for r in np.flatnonzero(np.diff(edges)).tolist():
            yield pack(r, w[edges[r] : edges[r + 1]], sums[edges[r] : edges[r + 1]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "r"):
            i = np.frombuffer(b"".join(table["i"].to_pylist()), "<i4")
            x = np.frombuffer(b"".join(table["x"].to_pylist()), "<f8")
            i, at = np.unique(i, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([table["r"][0].as_py()], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([np.bincount(at, x).tobytes()], pa.binary())], ["r", "i", "x"])

    written = spool.write(spark.createDataFrame(dealt.mapPartitionsWithIndex(run), "r int, i binary, x binary"))
    found = written.filter(F.col("r") != _RANGES + 2)
    rows = map_arrow(found.repartition("r").sortWithinPartitions("r"), add, "r int, i binary, x binary").collect()  # a row a range
    by_symbol, by_context, ones = np.zeros(len(symbols)), np.zeros(len(hot[0])), np.zeros(2)
    for r in rows:
        out = (by_context, ones)[r["r"] - _RANGES] if r["r"] >= _RANGES else by_symbol
        out[np.frombuffer(r["i"], "<i4")] = np.frombuffer(r["x"], "<f8")
    fewer = map_arrow(written.filter(F.col("r") == _RANGES + 2).select("i", "x"), _opened(["<i8", "<f8"], ["h", "fewer"]), "h long, fewer double")
    fewer = fewer.groupBy("h").agg(F.sum("fewer").alias("fewer"))
    fewer.spooled = written.spooled
    return by_symbol, by_context, float(np.clip(ones[0] / (ones[0] + 2 * ones[1]), 0.1, 0.95)) if ones[0] else 0.5, fewer


#: Spark has no unsigned numbers.
_WIDER = {"<u2": "<i4", "<u4": "<i8"}


def _opened(kinds: list[str], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of columns of packed numbers, a row a number; columns before them are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                plain = batch.num_columns - len(kinds)
                packed = [np.frombuffer(batch.column(plain + i)[k].as_py(), kind).astype(_WIDER.get(kind, kind)) for i, kind in enumerate(kinds)]
                alike = [np.full(len(packed[0]), batch.column(i)[k].as_py()) for i in range(plain)]
                for a in range(0, len(packed[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (*alike, *packed)], names)

    return run


def _asked(dealt: RDD, tail: int, spool: Spool) -> DataFrame:
    """Rows part, h: the rare words that a part has repeated pairs of."""

    def run(k: int, rows: Iterator[tuple[int, Row]]) -> Iterator[tuple[int, bytearray]]:
        part = _Part(rows, tail)
        rare, _ = part.rare_sums(part.c, part.repeated())
        if len(rare):
            yield k, bytearray(rare.tobytes())

    found = spool.write(spool.spark.createDataFrame(dealt.mapPartitionsWithIndex(run), "part long, h binary"))
    out = map_arrow(found, _opened(["<i8"], ["part", "h"]), "part long, h long")
    out.spooled = found.spooled
    return out


def _told(told: DataFrame, dealt: RDD, parts: int) -> RDD:
    """The dealt steps with what each part asked for: rows part, h, p (the parent's probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "part"):
            h, p = (table[name].to_numpy().tobytes() for name in ("h", "p"))
            yield pa.RecordBatch.from_arrays([table["part"][:1].combine_chunks(), pa.array([h], pa.binary()), pa.array([p], pa.binary())], ["part", "h", "p"])

    by_part = told.select("part", "h", "p").repartition("part").sortWithinPartitions("part")
    return dealt.union(map_arrow(by_part, run, "part long, h binary, p binary").rdd.map(lambda r: (r["part"], (r["h"], r["p"]))).partitionBy(parts, _itself))


def _sums(dealt: RDD, root: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], seats: Seats, spool: Spool) -> tuple[DataFrame, DataFrame]:
    """Rows r, score: of each text the log10 probability of its steps to words known by number; and rows r, h, times, a, b: its
    steps to rare words, whose probability is a + b times that in the root. `hot`: contexts that may lie in several parts,
    their tables elsewhere, their customers, their tables in all."""
    shared = spool.spark.sparkContext.broadcast((root, seats, *hot))

    def run(k: int, rows: Iterator[tuple[int, Row]]) -> Iterator[tuple]:
        root, seats, hashes, elsewhere, customers, tables = shared.value
        part = _Part(rows, len(root) - 2)
        if not part.chunks:
            return
        place, base = _group(part, hashes), part.base(root)
        mean, of = _seated(part, base, seats, k, place, elsewhere)
        of = np.where(place >= 0, tables[place], of)
        c = np.where(place >= 0, customers[place], np.bincount(part.u, part.c, len(part.contexts)))
        known, n, all_tables = part.w < len(root), c[part.u], of[part.u]
        log = np.where(known, np.log10(predictive(part.c, mean, n, all_tables, base, seats.d)), 0.0)
        a, b = (predictive(x, t, n, all_tables, y, seats.d) for x, t, y in ((part.c, mean, 0.0), (0, 0, 1.0)))
        pack = lambda x, kind: bytearray(x.astype(kind).tobytes())
        end = np.cumsum(part.steps)
        for chunk, first, last in zip(part.chunks, end - part.steps, end):
            own, pair = part.own[first:last], part.pair[first:last]
            there = np.flatnonzero(np.bincount(own))
            rare = ~known[pair]
            key, times = np.unique(own[rare].astype(np.int64) << 40 | pair[rare], return_counts=True)
            pair, to = key & ((1 << 40) - 1), part.w[key & ((1 << 40) - 1)] - len(root)
            yield chunk, pack(there, "<u2"), pack(np.bincount(own, log[part.pair[first:last]])[there], "<f4"), pack(key >> 40, "<u2"), pack(part.rare[to], "<u8"), pack(times, "<u4"), pack(a[pair], "<f4"), pack(b[pair], "<f4")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "chunk"):
            own = np.frombuffer(b"".join(table["own"].to_pylist()), "<u2").astype(np.int64)
            x = np.bincount(own, np.frombuffer(b"".join(table["x"].to_pylist()), "<f4").astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(table["chunk"][0].as_py() + np.arange(len(x))), pa.array(x)], ["r", "score"])

    found = spool.write(spool.spark.createDataFrame(dealt.mapPartitionsWithIndex(run), "chunk long, own binary, x binary, text binary, h binary, times binary, a binary, b binary"), "zstd")
    sums = map_arrow(found.select("chunk", "own", "x").repartition("chunk").sortWithinPartitions("chunk"), add, "r long, score double")
    steps = map_arrow(found.select("chunk", "text", "h", "times", "a", "b"), _opened(["<u2", "<i8", "<u4", "<f4", "<f4"], ["chunk", "text", "h", "times", "a", "b"]), "chunk long, text int, h long, times long, a float, b float")
    return sums, steps.select((F.col("chunk") + F.col("text")).alias("r"), "h", "times", "a", "b")


def perplexity(scored: DataFrame, where: Column | None = None) -> float:
    """Perplexity per token of scored texts (n_tokens, score): 10 to the minus mean log10 probability."""
    few = scored if where is None else scored.filter(where)
    total = few.agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return float(10 ** (-total["s"] / total["n"])) if total["n"] else float("nan")


def score(df: DataFrame, training: Column, id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Columns id, n_tokens, n_known, train_tokens, base_score, score: a row for each row of `df`.

    `training` marks the rows to learn from.
    """
    spark = df.sparkSession
    spool = Spool(spark)
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = spool.write(docs)
    found = spool.write(_count_words(docs.filter("train").select("text")))
    texts, words, kinds = found.agg(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.sum(F.when(F.col("h").isNotNull(), F.col("n"))), F.count("h")).first()
    texts, words = texts or 0, words or 0
    tokens, types = texts + words, kinds + (texts > 0)
    counts = found.filter("h is not null")
    table = counts.filter(F.col("n") * frequent >= tokens).toArrow()  # at most `frequent` rows
    order = np.argsort(table["h"].to_numpy().view(np.uint64))
    known_h, known_n = table["h"].to_numpy().view(np.uint64)[order], table["n"].to_numpy()[order]
    # Contexts with more than half a part's tokens are dealt by symbols; customers of a context are its count.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART))
    large = np.flatnonzero(known_n * 2 * parts > max(tokens, 1))
    hot_h, hot_n = np.append(known_h[large], _BEGIN), np.append(known_n[large], texts)
    order = np.argsort(hot_h)
    hot_h, hot_n = hot_h[order], hot_n[order]
    pieces = np.maximum(1, -(-hot_n * 2 * parts // max(tokens, 1)))
    dealt = _deal(docs.select("text", "train"), known_h, (hot_h, pieces), parts)
    share = np.concatenate([known_n, [1, max(texts, 1)]]) / (tokens + 1)
    rare = counts.filter(F.col("n") * frequent < tokens)
    wanted = _asked(dealt, len(known_h), spool)
    # At first a part takes it that the other parts of a context hold a table for every two customers.
    guess = np.where(pieces > 1, hot_n * (1 - 1 / pieces) * 0.5, 0.0)
    most = int(max(known_n.max(initial=1), texts))
    asked = spool.write(wanted.join(rare.filter("n > 1"), "h").select("part", "h", "n"))
    spool.drop(wanted)
    first = _told(asked.withColumn("p", F.col("n") / F.lit(tokens + 1.0)), dealt, parts)
    by_symbol, by_context, d, fewer = _tables(first, share, (hot_h, guess), Seats(FIRST, most), spool)
    # A rare word's customers in the root (k) are its tokens less those that joined a table, which only words asked for can.
    joined = spool.write(asked.select("h", "n").distinct().join(fewer, "h", "left").select("h", "n", F.greatest(F.lit(1), F.rint(F.col("n") - F.coalesce("fewer", F.lit(0.0)))).cast("long").alias("k")))
    spool.drop(fewer)
    by_k = rare.select(F.col("n").alias("k"), F.lit(1).alias("words")).unionByName(joined.select(F.col("n").alias("k"), F.lit(-1).alias("words"))).unionByName(joined.select("k", F.lit(1).alias("words")))
    by_k = by_k.groupBy("k").agg(F.sum("words").alias("words")).toArrow()
    by_symbol = np.maximum(np.rint(by_symbol), 0).astype(np.int64)  # nothing is at len(known): the unknown word
    customers, of = np.unique(np.concatenate([by_symbol, by_k["k"].to_numpy()]), return_inverse=True)
    words = np.bincount(of, np.append(np.ones(len(by_symbol)), by_k["words"].to_numpy())).astype(np.int64)
    p = np.zeros(len(words))
    p[words > 0] = fit_counts(customers[words > 0], words[words > 0])
    root, rare_p, unknown = p[of[: len(by_symbol)]], p[of[len(by_symbol) :]], float(p[of[len(known_h)]])
    logs = spark.createDataFrame(list(zip(by_k["k"].to_pylist(), rare_p.tolist())), "k long, p double")
    logs = F.broadcast(logs) if len(rare_p) <= KINDS else logs
    dealt = _told(asked.join(joined.select("h", "k"), "h").join(logs, "k").select("part", "h", "p"), dealt, parts)
    away, seats = by_context * (1 - 1 / pieces), Seats(d, most)
    _, by_context, _, _ = _tables(dealt, root, (hot_h, away), seats, spool, only_hot=True)
    sums, steps = _sums(dealt, root, (hot_h, away, hot_n, by_context), seats, spool)
    log_base = float(np.log10(tokens + 0.1 * (types + 1)))
    shared = spark.sparkContext.broadcast((known_h, known_n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_h, known_n = shared.value
        row = TaskContext.get().partitionId() << 40
        base = np.append(np.log10(known_n + 0.1) - log_base, 0.0)
        end = np.log10(texts + 0.1) - log_base
        for batch in batches:
            for first, count, words, owner in word_hashes(batch.column(1).to_pylist()):
                symbol = _symbols(words, known_h)
                there = symbol < len(known_h)
                plain = np.bincount(owner, base[symbol], count) + end
                seen = np.bincount(owner[there], minlength=count) + (texts > 0)
                n = np.bincount(owner, minlength=count) + 1
                keys = row + np.arange(count)
                row += count
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys), batch.column(0).slice(first, count), pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(plain),
                ], ["r", "id", "n_tokens", "n_known", "base"])

    told = map_arrow(docs.select("id", "text"), run, "r long, id long, n_tokens long, n_known long, base double")
    n, times = F.coalesce("n", F.lit(0)), F.col("times")
    met = steps.join(rare, "h", "left").join(joined.select("h", "k"), "h", "left").withColumn("k", F.coalesce("k", "n")).join(logs, "k", "left").select(
        "r",
        F.when(n > 0, times).otherwise(0).alias("n_known"),
        (times * (F.log10(n + F.lit(0.1)) - log_base)).alias("base"),
        (times * F.log10(F.col("a") + F.col("b") * F.coalesce("p", F.lit(unknown)))).alias("score"),
    )
    met = told.unionByName(sums, allowMissingColumns=True).unionByName(met, allowMissingColumns=True)
    found = met.groupBy("r").agg(F.max("id").alias(id), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return found.select(id, "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
