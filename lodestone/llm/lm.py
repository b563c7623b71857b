"""Language-model scores: an exact unigram base, and a hashed maximum-entropy model.

Counts.  Every partition counts its training tokens in a bounded table that is emptied as it fills; the words' counts are
summed over the whole corpus and written.  Only a bounded number of the most frequent words comes to the driver.

Model.  A token's unit is the word itself if it is frequent enough, else a hash of its ending.  Its probability is factored:
P(class | history) * P(unit | class, history) * P(word | unit).  The first factor is a softmax over classes of units; its
features are hashed: the unit before (n-gram), the two units before together (n-gram), and the units two, three and four
places before (skips).  The second factor is a walk down the binary tree of the class (a Huffman tree by counts); each
fork is a two-way softmax whose features are the unit before and the unit two places before, frequent units as themselves
and the others by their class.  So n-grams and skips weigh the words of a class against each other.  The third factor is
the maximum-entropy solution with one feature a word: 1 for a unit that is one word, else counts plus one over the unit's
tokens plus types plus one, which leaves mass for unknown words as the base does.  Classes group units by the company they
keep: k-means over each unit's counts of hashed neighbours.

Growth.  Units, hashed rows and classes grow with the training tokens (`Sizes`): units and rows with their fifth root,
classes with the tenth; so 1000 times the corpus has four times the units.  At g = 1 the weights are 4 MB; for
100 TB of text they are 150 MB, which bounds what is broadcast.  Words without a unit
of their own have counts, which are as many as the corpus has words; these are joined from the written table.

Training is by distributed gradient updates in ROUNDS rounds, each over its own part of the training documents: every task
starts from the weights so far, makes adaptive gradient steps, and returns its changes, which are averaged, each row by
the tokens that touched it.  All training documents take part.  Tokens are looked up once and written as numbers; scoring
gathers weights for a batch of tokens at a time (sparse rows, numpy).

Cases: a null or empty text is the end token alone; null ids are training documents; rows that repeat count each; texts
of any length are read whole; with no training document every token is unknown; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import copy
import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, id_columns, ids_of, lower_words, materialize, small_batches

END = b"\n"
#: Words whose counts are broadcast; places of neighbours; distances of the skips; distances of the forks' features.
FREQUENT, PLACES, SKIPS, NEAR = 131_072, 64, 4, 2
#: Units that are a feature of the forks as themselves.
TOP = 192
RATE, DECAY, BATCH = 0.4, 1e-5, 8192
#: The forks': tokens of a step, rate, and what the sum of squares starts from.
FORK_BATCH, FORK_RATE, FORK_START = 32_768, 0.2, 30.0
ROUNDS, FLUSH = 3, 400_000
MODULUS, HELD = 7, 2


class Sizes:
    """Sizes of the model for a number of training tokens."""

    def __init__(self, tokens: int) -> None:
        self.growth = g = max(1.0, tokens / 2**24) ** 0.2
        self.own, self.endings, self.classes, self.pairs = round(1024 * g), round(512 * g), round(24 * g**0.5), round(8192 * g)
        self.units = self.own + self.endings + 2
        self.begin, self.end = self.units - 2, self.units - 1
        #: Rows of the classes' weights: the bias, one a unit and distance, and the hashed pairs; rows of the forks'.
        self.rows = 1 + SKIPS * self.units + self.pairs
        self.heads = TOP + self.classes + 1
        self.fork_rows = 1 + NEAR * self.heads

    def ending(self, word: bytes) -> int:
        return self.own + zlib.crc32(word.rstrip(b".,;:!?").decode("utf-8", "replace")[-2:].encode()) % self.endings


def tokens_of(text: str | None) -> list[bytes]:
    return [*lower_words(text), END] if text else [END]


def with_held(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_remainder(F.col("doc_id"), MODULUS) == HELD, F.lit(False)).alias("held_out"), "text")


def token_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the training rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(tokens_of(text))
            if len(counts) > FLUSH:
                yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})
                counts = Counter()
        if counts:
            yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})

    return rows.where("not held_out").select("text").mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """At most about `most` words with the highest counts, and the end token; found from a histogram of the counts'
    logarithms, so that no more rows than these come to the driver."""
    step = F.floor(F.log2("c") * 64)
    histogram = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for s, n in histogram:
        if total + n > most and total:
            break
        least, total = s, total + n
    if least is None:
        return []
    rows = counts.where((step >= least) | (F.col("word") == F.lit(bytearray(END)))).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Words:
    """Places of tokens in the table of frequent words, and units of all tokens."""

    def __init__(self, ranked: list[tuple[bytes, int]], sizes: Sizes) -> None:
        self.place, self.sizes, own, units = {word: i for i, (word, _) in enumerate(ranked)}, sizes, 0, []
        for word, _ in ranked:
            units.append(sizes.end if word == END else own if own < sizes.own else sizes.ending(word))
            own += word != END
        self.unit_at = np.array([*units, 0], np.int32)
        self.rare: dict[bytes, int] = {}

    def _rare(self, word: bytes) -> int:
        code = self.rare.get(word)
        if code is None:
            if len(self.rare) > 300_000:
                self.rare.clear()
            code = self.rare[word] = -1 - self.sizes.ending(word)
        return code

    def codes(self, tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """(a number for each token: its place, or -1 minus its unit where it is not frequent; the tokens that are not)."""
        get = self.place.get
        out = np.array([get(w, -1) for w in tokens], np.int32)
        missed = np.flatnonzero(out < 0)
        rare = [tokens[i] for i in missed.tolist()]
        out[missed] = [self._rare(w) for w in rare]
        return out, rare

    def units(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.unit_at[np.maximum(codes, 0)], -1 - codes)


_held: dict[str, object] = {}


class Shared:
    """A broadcast value with a name of its own, of which a worker keeps what it makes."""

    def __init__(self, spark, value, make=None) -> None:
        self.held, self.id, self.make = spark.sparkContext.broadcast(value), uuid.uuid4().hex, make

    def get(self):
        if self.id not in _held:
            if len(_held) > 8:
                _held.clear()
            _held[self.id] = self.held.value if self.make is None else self.make(*self.held.value)
        return _held[self.id]


def looked_up(rows: DataFrame, words: Shared) -> DataFrame:
    """The written rows: doc_id, held_out, row, turn (the round of a training row), codes (little-endian int32), rare."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = words.get()
        for batch in batches:
            found = [table.codes(tokens_of(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": ids_of(batch, "doc_id"), "held_out": batch["held_out"].to_numpy(), "turn": batch["turn"].to_numpy(), "codes": [c.astype("<i4").tobytes() for c, _ in found], "rare": [r for _, r in found]})

    turned = rows.withColumn("turn", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).cast("int")).select(*id_columns("doc_id"), "held_out", "turn", "text")
    out = turned.mapInPandas(look, "doc_id long, held_out boolean, turn int, codes binary, rare array<binary>")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "lm-tokens")


def _joined(units: list[np.ndarray], begin: int) -> np.ndarray:
    """Units of several documents, each after as many begin units as a history is long."""
    gap = np.full(SKIPS, begin, np.int32)
    return np.concatenate([x for u in units for x in (gap, u)]) if units else gap[:0]


def _units_of(batch: pd.DataFrame, words: Words) -> list[np.ndarray]:
    return [words.units(np.frombuffer(c, "<i4")) for c in batch["codes"]]


def company(tokens: DataFrame, words: Shared, sizes: Sizes) -> np.ndarray:
    """Units x PLACES: how often each unit stands within two places of units hashed to a place."""
    n_units = sizes.units

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = words.get(), np.zeros(n_units * PLACES, np.int64)
        for batch in batches:
            u = _joined(_units_of(batch, table), sizes.begin).astype(np.int64)
            hashed = (u * 2654435761 >> 7) % PLACES
            for d in (1, 2):
                total += np.bincount(u[d:] * PLACES + hashed[:-d], minlength=n_units * PLACES)
                total += np.bincount(u[:-d] * PLACES + hashed[d:], minlength=n_units * PLACES)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at.astype(np.int32), "n": total[at].astype(float)})

    summed = tokens.where("not held_out").select("codes").mapInPandas(count, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_units * PLACES)
    out[summed["i"].to_numpy(np.int64)] = summed["n"].to_numpy(float)
    return out.reshape(n_units, PLACES)


def classes_of(profile: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Class of each unit, by k-means on the square roots of its neighbours' shares; the end token has its own."""
    weight = profile.sum(axis=1)
    x = np.sqrt(profile / np.maximum(weight, 1)[:, None])
    seen = np.flatnonzero((weight > 0) & (np.arange(sizes.units) < sizes.begin))
    out, k = np.zeros(sizes.units, np.int32), min(sizes.classes - 1, len(seen))
    if k:
        rng = np.random.default_rng(7)
        points, w = x[seen], weight[seen]
        centres = [points[np.argmax(w)]]
        near = ((points - centres[0]) ** 2).sum(axis=1)
        while len(centres) < k:  # spread starts, by weight and distance
            p = near * np.sqrt(w)
            pick = rng.choice(len(points), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(points))
            centres.append(points[pick])
            near = np.minimum(near, ((points - points[pick]) ** 2).sum(axis=1))
        middle = np.array(centres)
        for _ in range(25):
            own = np.argmin((points**2).sum(axis=1)[:, None] - 2 * points @ middle.T + (middle**2).sum(axis=1)[None, :], axis=1)
            for c in range(k):
                if (own == c).any():
                    middle[c] = np.average(points[own == c], axis=0, weights=w[own == c])
        out[seen] = own
    out[sizes.end] = sizes.classes - 1
    return out


class Trees:
    """A Huffman tree for the units of each class.  starts[u] to starts[u + 1]: the forks from the top down to unit u, in
    `forks`, and whether the way goes right there, in `right`.  bias: each fork's log odds by counts."""

    def __init__(self, of_unit: np.ndarray, counts: np.ndarray, sizes: Sizes) -> None:
        ways: list[list[tuple[int, bool]]] = [[] for _ in of_unit]
        bias: list[float] = []
        for c in range(sizes.classes):
            heap = [(int(counts[u]) + 1, u, [u]) for u in np.flatnonzero(of_unit == c).tolist() if u != sizes.begin]
            heapq.heapify(heap)
            while len(heap) > 1:
                (n, u, left), (m, _, right) = heapq.heappop(heap), heapq.heappop(heap)
                for side, units in ((False, left), (True, right)):
                    for x in units:
                        ways[x].append((len(bias), side))
                bias.append(float(np.log(m / n)))
                heapq.heappush(heap, (n + m, u, left + right))
        self.starts = np.cumsum([0, *map(len, ways)])
        self.forks = np.array([f for way in ways for f, _ in reversed(way)], np.int64)
        self.right = np.array([r for way in ways for _, r in reversed(way)], bool)
        self.bias = np.array(bias, np.float32)

    def ways(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the token of each fork on the tokens' ways, the place of the fork in `forks`)."""
        lengths = self.starts[units + 1] - self.starts[units]
        token = np.repeat(np.arange(len(units)), lengths)
        return token, np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + self.starts[units][token]


class Model:
    """Weights, and the logarithms of probabilities under them."""

    def __init__(self, sizes: Sizes, of_unit: np.ndarray, counts: np.ndarray) -> None:
        self.sizes, self.of_unit, self.trees = sizes, of_unit, Trees(of_unit, counts, sizes)
        self.head = np.where(np.arange(sizes.units) < min(TOP, sizes.own), np.arange(sizes.units), TOP + of_unit).astype(np.int64)
        self.head[sizes.begin] = sizes.heads - 1
        self.w = np.zeros((sizes.rows, sizes.classes), np.float32)
        empty = np.bincount(np.delete(of_unit, sizes.begin), minlength=sizes.classes) == 0
        self.w[0, empty] = -30  # a small corpus has fewer classes
        self.f = np.zeros((sizes.fork_rows, len(self.trees.bias)), np.float32)
        self.f[0] = self.trees.bias

    def features(self, u: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of w for the tokens at places `at` of the joined units: len(at) x (SKIPS + 1); the bias is row 0."""
        n, out = self.sizes.units, np.empty((len(at), SKIPS + 1), np.int64)
        for d in range(1, SKIPS + 1):
            out[:, d - 1] = 1 + (d - 1) * n + u[at - d]
        pair = u[at - 2].astype(np.uint64) * np.uint64(n) + u[at - 1].astype(np.uint64)
        out[:, SKIPS] = 1 + SKIPS * n + ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.sizes.pairs
        return out

    def odds(self, rows: np.ndarray) -> np.ndarray:
        """Natural log of P(class | history), but for a number for each row, len(rows) x classes; 0 at most."""
        z = self.w.take(rows[:, 0], axis=0)
        z += self.w[0]
        for f in range(1, rows.shape[1]):
            z += self.w.take(rows[:, f], axis=0)
        z -= z.max(axis=1, keepdims=True)
        return z

    def log_classes(self, rows: np.ndarray) -> np.ndarray:
        """Natural log of P(class | history), len(rows) x classes."""
        z = self.odds(rows)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def forks(self, u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(token, places in f of its three weights, whether right) of each fork on the ways to the tokens at `at`."""
        token, k = self.trees.ways(u[at])
        fork, n = self.trees.forks[k], self.f.shape[1]
        places = [fork, *(fork + n * (1 + (d - 1) * self.sizes.heads + self.head[u[at - d]])[token] for d in range(1, NEAR + 1))]
        return token, places, self.trees.right[k]

    def log_units(self, u: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of P(unit | class, history) of the tokens at `at`."""
        token, places, right = self.forks(u, at)
        flat = self.f.reshape(-1)
        z = flat.take(places[0]) + flat.take(places[1]) + flat.take(places[2])
        z = np.where(right, -z, z)
        return -np.bincount(token, np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z))), len(at)).astype(float)

    def log_model(self, u: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of P(unit | history)."""
        out = self.log_units(u, at)
        for a in range(0, len(at), BATCH):
            here = at[a : a + BATCH]
            z = self.odds(self.features(u, here))
            own = z[np.arange(len(here)), self.of_unit[u[here]]]
            out[a : a + BATCH] += own - np.log(np.exp(z, out=z).sum(axis=1))
        return out


class Trainer:
    """Adaptive gradient steps from given weights."""

    def __init__(self, model: Model) -> None:
        self.m = copy.copy(model)
        self.m.w, self.m.f = model.w.copy(), model.f.copy()
        self.g2, self.touched = np.full(model.w.shape, 1e-2, np.float32), np.zeros(len(model.w))
        self.h2, self.f_touched = np.full(model.f.size, FORK_START, np.float32), np.zeros(len(model.f))

    def step(self, rows: np.ndarray, target: np.ndarray) -> None:
        """One on the classes' softmax."""
        w = self.m.w
        g = self.m.odds(rows)
        np.exp(g, out=g)
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(g)), target] -= 1
        g /= len(g)
        used, sums = [np.zeros(1, np.int64)], [g.sum(axis=0, keepdims=True)]
        for f in range(rows.shape[1]):
            own = rows[:, f] - rows[:, f].min()  # 16-bit keys sort in linear time
            order = np.argsort(own.astype(np.uint16) if own.max() < 1 << 16 else own, kind="stable")
            at = rows[order, f]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            used.append(at[first])
            sums.append(np.add.reduceat(g.take(order, axis=0), first, axis=0))
        used, d = np.concatenate(used), np.concatenate(sums)  # families of features have rows of their own
        self.touched += np.bincount(rows.ravel(), minlength=len(w))
        self.touched[0] += len(rows)
        d += DECAY * w[used]
        self.g2[used] += d * d * 1e2
        w[used] -= RATE * 10 * d / np.sqrt(self.g2[used])

    def fork_step(self, u: np.ndarray, at: np.ndarray) -> None:
        """One on the forks."""
        flat, n = self.m.f.reshape(-1), self.m.f.shape[1]
        if not n:
            return
        _, places, right = self.m.forks(u, at)
        z = flat.take(places[0]) + flat.take(places[1]) + flat.take(places[2])
        g = (1 / (1 + np.exp(-z)) - right).astype(float)
        d = np.bincount(places[0], g, len(flat))
        for p in places[1:]:
            d += np.bincount(p, g, len(flat))
        some = np.flatnonzero(d)
        d = d[some].astype(np.float32)
        self.h2[some] += d * d
        flat[some] -= FORK_RATE * d / np.sqrt(self.h2[some])
        self.f_touched[0] += len(at)
        for k in range(1, NEAR + 1):
            self.f_touched += np.bincount(1 + (k - 1) * self.m.sizes.heads + self.m.head[u[at - k]], minlength=len(self.f_touched))

    def learn(self, u: np.ndarray, at: np.ndarray, size: int) -> None:
        for a in range(0, len(at), size):
            here = at[a : a + size]
            self.step(self.m.features(u, here), self.m.of_unit[u[here]])
        for a in range(0, len(at), FORK_BATCH):
            self.fork_step(u, at[a : a + FORK_BATCH])


def train_round(tokens: DataFrame, words: Shared, model: Model) -> None:
    """Moves the model's weights by the average of what the tasks learn from these tokens."""
    start, begin = Shared(tokens.sparkSession, model), model.sizes.begin
    n_rows = len(model.w)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = start.get()
        table, trainer, size, kept, n_kept = words.get(), Trainer(model), 512, [], 0

        def step() -> None:
            nonlocal kept, n_kept, size
            u = _joined(kept, begin)
            trainer.learn(u, np.flatnonzero(u != begin), size)
            kept, n_kept, size = [], 0, min(BATCH, size * 2)

        for batch in batches:
            for units in _units_of(batch, table):
                kept.append(units)
                n_kept += len(units)
                if n_kept >= 4 * size:
                    step()
        if kept:
            step()
        for first, new, old, touched in ((0, trainer.m.w, model.w, trainer.touched), (n_rows, trainer.m.f, model.f, trainer.f_touched)):
            used = np.flatnonzero(touched)
            for lo in range(0, len(used), 2000):
                at = used[lo : lo + 2000]
                change = (new[at] - old[at]).astype(np.float16)
                yield pd.DataFrame({"i": (first + at).astype(np.int32), "n": touched[at], "d": [x.tobytes() for x in change]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Weighted sums of one range of rows, as they come."""
        total: dict[int, np.ndarray] = {}
        n: Counter = Counter()
        for batch in batches:
            for i, k, d in zip(batch["i"], batch["n"], batch["d"], strict=True):
                x = np.frombuffer(d, np.float16).astype(float) * k
                if i in total:
                    total[i] += x
                else:
                    total[i] = x
                n[i] += k
        if total:
            yield pd.DataFrame({"i": list(total), "d": [(total[i] / n[i]).astype(np.float32).tobytes() for i in total]})

    parts = tokens.select("codes").mapInPandas(learn, "i int, n double, d binary")
    for row in parts.repartition(12, "i").mapInPandas(add, "i int, d binary").toLocalIterator():  # at most one for each row of the weights
        target, i = (model.w, row["i"]) if row["i"] < n_rows else (model.f, row["i"] - n_rows)
        target[i] += np.frombuffer(row["d"], np.float32)


def unit_sums(counts: DataFrame, words: Shared, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, types) of each unit."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, n, v = words.get(), np.zeros(sizes.units), np.zeros(sizes.units)
        for batch in batches:
            u = table.units(table.codes([bytes(w) for w in batch["word"]])[0])
            n += np.bincount(u, batch["c"], sizes.units)
            v += np.bincount(u, minlength=sizes.units)
        yield pd.DataFrame({"u": np.flatnonzero(v), "n": n[v > 0], "v": v[v > 0]})

    n, v = np.zeros(sizes.units), np.zeros(sizes.units)
    for r in counts.mapInPandas(sums, "u int, n double, v double").groupBy("u").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # at most one a unit
        n[r["u"]], v[r["u"]] = r["n"], r["v"]
    return n, v


def log_room(n: np.ndarray, v: np.ndarray, sizes: Sizes) -> np.ndarray:
    """log10 of what a word's count plus one is divided by, for each unit: a unit that is one word has no room for others."""
    alone = np.arange(sizes.units)
    return np.log10(np.where((alone < sizes.own) | (alone == sizes.end), n + 1, n + v + 1))


def fit(tokens: DataFrame, counts: DataFrame, words: Shared, sizes: Sizes) -> tuple[Model, np.ndarray]:
    """(the trained model, log_room of its units)."""
    n, v = unit_sums(counts, words, sizes)
    model = Model(sizes, classes_of(company(tokens, words, sizes), sizes), n)
    for turn in range(ROUNDS):
        train_round(tokens.where(f"not held_out and turn = {turn}"), words, model)
    return model, log_room(n, v, sizes)


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = with_held(docs)
    small_batches(spark)
    counts = materialize(token_counts(rows), "lm-counts")
    n_all, n_types = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    sizes, ranked = Sizes(n_all), frequent_words(counts)
    words = Shared(spark, (ranked, sizes), Words)
    tokens = looked_up(rows, words)
    model, room = fit(tokens, counts, words, sizes)
    held = Shared(spark, (model, room, np.log10([*(c + 1.0 for _, c in ranked), 1.0])), lambda *x: x)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, (model, room, log_c) = words.get(), held.get()
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.iloc[lo : lo + 64]
                codes = [np.frombuffer(c, "<i4") for c in part["codes"]]
                lengths = np.array([len(c) for c in codes])
                places = np.concatenate(codes)
                starts = np.cumsum(lengths) - lengths
                u = _joined([table.units(c) for c in codes], model.sizes.begin)
                at = np.flatnonzero(u != model.sizes.begin)
                log_p = np.concatenate([model.log_model(u, at[a : a + FORK_BATCH]) for a in range(0, len(at), FORK_BATCH)]) / np.log(10) - room[u[at]]
                yield pd.DataFrame(
                    {
                        "row": part["row"], "n_tokens": lengths, "n_frequent": np.add.reduceat((places >= 0).astype(np.int64), starts),
                        "log_counts": np.add.reduceat(np.where(places >= 0, log_c[np.maximum(places, 0)], 0.0), starts), "log_model": np.add.reduceat(log_p, starts),
                        "doc_id": ids_of(part, "doc_id"), "held_out": part["held_out"],
                    }
                )

    schema = "row long, n_tokens long, n_frequent long, log_counts double, log_model double, doc_id long, held_out boolean"
    scored = tokens.select("row", *id_columns("doc_id"), "held_out", "codes").mapInPandas(apply, schema)
    pairs = tokens.select("row", F.explode("rare").alias("word"))
    found = pairs.join(counts, "word").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_log"))
    out = scored.join(found, "row", "left")
    log_counts = F.col("log_counts") + F.coalesce("rare_log", F.lit(0.0))
    base = log_counts - F.col("n_tokens") * F.lit(float(np.log10(n_all + n_types + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        base.alias("base_score"), (log_counts + F.col("log_model")).alias("score"),
    )
