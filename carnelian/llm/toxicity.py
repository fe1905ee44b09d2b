"""Toxicity: nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled rows: for each class the MOST_EXAMPLES
that come first by a hash of their id.  Terms are folded words, and the first
4 to 10 bytes of words that go on after them.  Vectors are over all terms of the
examples; their document frequencies are counted over the whole corpus.  The
length of a text's vector is over all its terms: one that no example has counts
with the weight of a term that a single row has.  It scales the cosines of that
text, but doesn't change which examples are near.  Examples with equal vectors
share one entry of the index.

The index keeps the postings of each term, and those of common terms also as
rows of a matrix, with the largest weight of each range of BLOCK entries.  A
query sums the postings of its other terms, adds the maxima of the common ones
to an upper bound for each range, visits spans of ranges by falling bound, and
skips those whose bound is below the k-th best cosine: the neighbours are exact.
Queries go through in batches.  They vote with weights
1 / (distance + SOFT).  How many of them vote is the number, of those tried, with
which leave-one-out votes on the examples part the classes best (by the area
under the curve; of equals the smallest).  An isotonic fit of leave-one-out votes on the examples,
weighted to the classes' shares in all labels, turns votes into probabilities.
The neighbours' ids and cosines are the evidence.

The driver holds the vocabulary, its document frequencies and the postings once,
and hands them out in one broadcast each.  Example texts, their vectors and the
leave-one-out votes stay on the executors: vectors pass through the driver one
by one, twice, first to size the postings and then to place them.

Defined cases: a null, empty or wordless text has the share of toxic rows among
wordless examples, 0 if there is none.  A text without a term of any example has
no neighbour, and its vote is the class prior.  Ties between neighbours go to the
entry that comes first.  Rows repeated in the input come out repeated; of rows
that share an id the one with the smallest text is an example; a row labelled both ways counts as toxic.  With no labels, or labels of one class,
every score is that class's share (0 without labels).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm.frames import broadcast, documents, first_by_hash, released, stored, text_bytes
from carnelian.llm.text import HashSet, prefixes, slices, to_signed, words

MOST_EXAMPLES = 4_000
#: Bytes of the beginnings of words that are terms.
BEGINNINGS = range(4, 11)
#: Numbers of neighbours that are tried.
NEIGHBOURS = (12, 25, 50, 100, 200)
BLOCK = 64
#: Blocks that are visited at a time, and queries in a batch.
SPAN, BATCH = 8, 128
#: A term in more than this share of the entries is common; the matrix has at most so many, the others keep to their postings.
COMMON_SHARE, MOST_COMMON = 1 / 16, 2_048
#: More than single precision loses in a bound or a cosine.
MARGIN = 1e-5
SOFT = 0.05
#: Bits of the table of known terms.
TERM_BITS = 22
#: Entries that a task asks for their leave-one-out votes, at least: each process makes the matrix first.
LEAST_ENTRIES = 256


def weights_of(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, unknown: float = 0.0) -> np.ndarray:
    """TF-IDF weights of the terms (numbers into idf) in a unit vector.

    unknown: the sum of (1 + log count) ** 2 over terms that have no number; the last of idf is theirs."""
    w = (1 + np.log(counts)) * idf[terms]
    return w / np.sqrt((w * w).sum() + unknown * idf[-1] ** 2)


class BlockMaxIndex:
    """Postings of unit vectors, by term, and of common terms the largest weight of each range of entries."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        n_of = np.zeros(n_terms, dtype=np.int64)
        for terms, _ in vectors:
            n_of[terms] += 1
        self._place(len(vectors), n_of, ((entry, *vector) for entry, vector in enumerate(vectors)))

    @classmethod
    def of_rows(cls, n: int, n_of: np.ndarray, rows: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        """From (entry, terms, weights) of n entries in any order, which are not kept; n_of: in how many of them each term is."""
        index = cls.__new__(cls)
        index._place(n, n_of, rows)
        return index

    def _place(self, n: int, n_of: np.ndarray, rows: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.n, self.n_blocks = n, -(-n // BLOCK)
        self.edges = np.concatenate([[0], np.cumsum(n_of)])
        most = np.argsort(-n_of, kind="stable")[:MOST_COMMON]
        self.common = np.sort(most[n_of[most] > COMMON_SHARE * self.n])
        self.place = np.full(len(n_of), -1, dtype=np.int32)
        self.place[self.common] = np.arange(len(self.common))
        self.dense = None
        self.entries = np.zeros(self.edges[-1], dtype=np.uint16 if n <= 1 << 16 else np.int32)
        self.weights = np.zeros(self.edges[-1], dtype=np.float32)
        free = self.edges[:-1].copy()
        for entry, terms, weights in rows:  # a term is in a vector once
            at = free[terms]
            self.entries[at], self.weights[at] = entry, weights
            free[terms] += 1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None, "maxima": None, "packed": None}

    def _fill(self) -> None:
        """The matrix of common terms, and entry and weight of each posting side by side, which aren't sent but made where they are used."""
        self.dense = np.zeros((self.n_blocks * BLOCK, len(self.common)), dtype=np.float32)
        for column, t in enumerate(self.common.tolist()):
            lo, hi = self.edges[t], self.edges[t + 1]
            self.dense[self.entries[lo:hi], column] = self.weights[lo:hi]
        self.maxima = self.dense.reshape(self.n_blocks, BLOCK, -1).max(axis=1)
        self.packed = self.entries.astype(np.int64) << 32 | self.weights.view(np.uint32)

    def _rare(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Dot products with all entries over terms that aren't common."""
        begins, lengths = self.edges[terms], self.edges[terms + 1] - self.edges[terms]
        stops = np.cumsum(lengths)
        at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(begins - stops + lengths, lengths)
        found = self.packed.take(at)
        return np.bincount(found >> 32, np.repeat(weights, lengths) * found.astype(np.uint32).view(np.float32), self.n)

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights), nearest(); without: an entry to leave out, or -1."""
        if not self.n:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in queries]
        if self.dense is None:
            self._fill()
        out = []
        for a in range(0, len(queries), BATCH):
            out += self._batch(queries[a : a + BATCH], k, without[a : a + BATCH] if without else [])
        return out

    def _batch(self, queries, k: int, without: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        m = len(queries)
        rest = np.full((m, self.n_blocks * BLOCK), -np.inf)
        asked = np.zeros((m, len(self.common)))
        for i, (terms, weights) in enumerate(queries):
            place = self.place[terms]
            rest[i, : self.n] = self._rare(terms[place < 0], weights[place < 0])
            asked[i, place[place >= 0]] = weights[place >= 0]
        for i, entry in enumerate(without):
            if entry >= 0:
                rest[i, entry] = -np.inf
        single = asked.astype(np.float32)
        bound = rest.reshape(m, self.n_blocks, BLOCK).max(axis=2) + single @ self.maxima.T
        bound = np.maximum.reduceat(bound, np.arange(0, self.n_blocks, SPAN), axis=1) + MARGIN
        total, best = np.full(rest.shape, -np.inf), np.zeros((m, k))
        for span in np.argsort(-bound.max(axis=0), kind="stable").tolist():
            live = np.flatnonzero(bound[:, span] > best[:, 0] - MARGIN)
            if len(live):
                lo, hi = span * SPAN * BLOCK, (span + 1) * SPAN * BLOCK
                found = rest[live, lo:hi] + single[live] @ self.dense[lo:hi].T
                total[live, lo:hi] = found
                best[live] = np.partition(np.concatenate([best[live], found], axis=1), -k, axis=1)[:, -k:]
        out = []
        for i in range(m):
            at = np.flatnonzero(total[i] > max(best[i, 0] - 2 * MARGIN, -MARGIN))
            own = np.flatnonzero(asked[i])
            cosine = rest[i, at] + self.dense.take(at, axis=0).take(own, axis=1).astype(np.float64) @ asked[i, own]
            at, cosine = at[cosine > 0], cosine[cosine > 0]
            order = np.lexsort((at, -cosine))[:k]
            out.append((at[order], cosine[order]))
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the k nearest with a cosine above 0, best first, ties by entry."""
        return self.nearest_of([(terms, weights)], k, [without])[0]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: levels and the largest x of each."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if blocks and blocks[-1][0] == xi:
            last = blocks[-1]
            last[1], last[2] = (last[1] * last[2] + yi * wi) / (last[2] + wi), last[2] + wi
        else:
            blocks.append([xi, yi, wi])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            xb, yb, wb = blocks.pop()
            last = blocks[-1]
            last[0], last[1], last[2] = xb, (last[1] * last[2] + yb * wb) / (last[2] + wb), last[2] + wb
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def area_under(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The chance that a positive has a greater x than a negative, by weight; a half where x is equal."""
    levels, which = np.unique(x, return_inverse=True)
    pos, neg = (np.bincount(which, weights=w * (y == c), minlength=len(levels)) for c in (1, 0))
    both = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / both) if both else 0.0


class Neighbours:
    """The index of the entries, with the weight of each class and the least id of each entry, and how they vote."""

    def __init__(self, idf: np.ndarray, keys: list[bytes], names: list, mass: np.ndarray, scale: dict[int, float], prior: float, index: BlockMaxIndex):
        """keys: of the entries, ascending; scale: the weight of one example of each class."""
        self.idf, self.keys, self.names, self.mass, self.scale, self.prior, self.index = idf, keys, names, mass, scale, prior, index

    def vote(self, at: np.ndarray, cosine: np.ndarray, left: np.ndarray | None = None) -> float:
        """The share of toxic weight among neighbours; left: what is left of the entry itself."""
        pull = 1 / (np.maximum(0.0, 1 - cosine) + SOFT)
        mass = (self.mass[at] * pull[:, None]).sum(axis=0) if len(at) else np.zeros(2)
        if left is not None:
            mass = mass + np.maximum(left, 0) / SOFT
        return float((mass[1] + 1e-9 * self.prior) / (mass.sum() + 1e-9))

    def left_out(self, entries: list[int], queries: list[tuple[np.ndarray, np.ndarray]], tried: tuple) -> list[tuple]:
        """(entry, class, votes by each number of neighbours tried) of the entries whose vectors are given, without one example of that class."""
        out = []
        for entry, (at, cosine) in zip(entries, self.index.nearest_of(queries, max(tried), entries), strict=True):
            for toxic in (0, 1):
                if self.mass[entry, toxic]:
                    left = self.mass[entry].copy()
                    left[toxic] -= self.scale[toxic]
                    out.append((entry, toxic, [self.vote(at[:n], cosine[:n], left) for n in tried]))
        return out

    def votes(self, queries: list[tuple], k: int) -> list[tuple[float, list]]:
        """For each query, the share of toxic weight among its neighbours, and the nearest."""
        found = self.index.nearest_of(queries, k)
        return [(self.vote(at, cosine), [(self.names[a], float(c)) for a, c in zip(at[:3].tolist(), cosine[:3].tolist(), strict=True)]) for at, cosine in found]


class Calibration(NamedTuple):
    """How many neighbours vote, what their votes mean, and the score of wordless texts."""

    bare: float
    k: int = NEIGHBOURS[0]
    knots: np.ndarray = np.zeros(0)
    levels: np.ndarray = np.zeros(0)

    def score(self, near: Neighbours, rows: list[tuple[np.ndarray, np.ndarray, float]]) -> list[tuple[float, list]]:
        """(probability, evidence) for each row's term numbers, their counts, and its unknown terms (see weights_of)."""
        out: list[tuple[float, list]] = [(float(self.bare), [])] * len(rows)
        if not len(self.levels):
            return out
        worded = [i for i, (terms, _, unknown) in enumerate(rows) if len(terms) or unknown]
        votes = near.votes([(terms, weights_of(terms, counts, near.idf, unknown)) for terms, counts, unknown in (rows[i] for i in worded)], self.k)
        for i, (vote, evidence) in zip(worded, votes, strict=True):
            level = float(self.levels[min(int(np.searchsorted(self.knots, vote)), len(self.levels) - 1)])
            # a hundredth of the raw vote parts rows on one level
            out[i] = (min(1.0, max(0.0, 0.99 * level + 0.01 * vote)), evidence)
        return out


def calibrated(bare: float, asked: list[tuple], mass: np.ndarray, tried: tuple) -> Calibration:
    """The number of neighbours whose votes part the classes best, and their isotonic fit; asked: see Neighbours.left_out."""
    asked = sorted(asked)
    y, w = np.array([toxic for _, toxic, _ in asked], dtype=float), np.array([mass[entry, toxic] for entry, toxic, _ in asked])
    out, best = Calibration(bare, tried[0]), -1.0
    for n, k in enumerate(tried if asked else ()):
        x = np.array([votes[n] for _, _, votes in asked])
        parted = area_under(x, y, w)
        if parted > best + 1e-9:
            best, out = parted, Calibration(bare, k, *isotonic(x, y, w))
    return out


class Model(NamedTuple):
    """A vocabulary of term hashes; itself and the neighbours (Neighbours) as broadcasts; and the calibration."""

    vocabulary: HashSet
    sent: object
    near: object
    calibration: Calibration


def terms_of(part) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, row) of every term of a slice, each as often as it stands there."""
    found = words(part)
    begun, rows = prefixes(part, found, BEGINNINGS)
    return np.concatenate([found.hashes, begun]), np.concatenate([found.rows, rows])


def counted(part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct term hashes of a slice; for each distinct term of each row, by row, its number among them and its count; the rows' edges."""
    hashes, rows = terms_of(part)
    distinct, number = np.unique(hashes, return_inverse=True)
    n = max(1, len(distinct))
    key, counts = np.unique(rows * n + number, return_counts=True)
    return distinct, key % n, counts, np.searchsorted(key, np.arange(len(part) + 1) * n)


def vectors(part, vocabulary: HashSet) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each row of a slice, the sorted numbers of its vocabulary terms, their counts, and its unknown terms (see weights_of)."""
    distinct, number, counts, edges = counted(part)
    known = vocabulary.has(distinct)[number]
    terms = np.searchsorted(vocabulary.values, distinct)[number]
    unknown = np.concatenate([[0.0], np.cumsum(np.where(known, 0.0, (1 + np.log(counts)) ** 2))])
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        held = known[a:b]
        out.append((terms[a:b][held], counts[a:b][held], 0.0 if held.all() else float(unknown[b] - unknown[a])))
    return out


def sample_labels(labels: DataFrame, learn, id_column: str, label_column: str, most: int) -> tuple[list, dict[int, float]]:
    """(id, toxic) of the first rows of each class by a hash of the id, and the classes' shares."""
    usable = labels.where(learn & F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = first_by_hash(usable.withColumnRenamed("toxic", "group"), most).select("id", F.col("group").alias("toxic")).collect()
    total = sum(counts.values())
    return [(r.id, r.toxic) for r in rows], {c: n / total for c, n in counts.items()}


def _terms(batches):
    """Distinct term hashes of every row, with their counts, as bytes; a batch for each slice, as terms take more room than texts."""
    for batch in batches:
        for part in slices(batch.column("text")):
            distinct, number, counts, edges = counted(part)
            ends = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            own = [batch.column(name).slice(part.at, len(part)) for name in ("id", "toxic")]
            terms, counts = [distinct[number[a:b]].tobytes() for a, b in ends], [counts[a:b].astype(np.uint32).tobytes() for a, b in ends]
            yield pa.RecordBatch.from_arrays([*own, pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["id", "toxic", "terms", "counts"])


def _distinct(batches):
    """The distinct term hashes of a task's rows."""
    seen = np.zeros(0, dtype=np.uint64)
    for batch in batches:
        seen = np.unique(np.concatenate([seen, *(np.frombuffer(t, dtype=np.uint64) for t in batch.column("terms").to_pylist())]))
    yield pa.RecordBatch.from_arrays([pa.array(to_signed(seen))], ["term"])


def entries_of(examples: DataFrame, sent, tasks: int) -> DataFrame:
    """A row for each distinct vector: key, name (the least id), n0 and n1 (examples of each class), terms (numbers, int32) and counts (uint32); sent: the vocabulary."""

    def run(batches):
        for batch in batches:
            terms = [np.searchsorted(sent.value.values, np.frombuffer(t, dtype=np.uint64)).astype(np.int32) for t in batch.column("terms").to_pylist()]
            keys = [hashlib.sha256(t.astype(">i8").tobytes() + np.frombuffer(c, dtype=np.uint32).astype(">i8").tobytes()).digest() for t, c in zip(terms, batch.column("counts").to_pylist(), strict=True)]
            made = [pa.array(keys, pa.binary()), pa.array([t.tobytes() for t in terms], pa.binary())]
            yield pa.RecordBatch.from_arrays([*made, *(batch.column(c) for c in ("counts", "id", "toxic"))], ["key", "terms", "counts", "id", "toxic"])

    kind = examples.schema["id"].dataType.simpleString()
    rows = examples.mapInArrow(run, f"key binary, terms binary, counts binary, id {kind}, toxic int").repartition(tasks, "key")
    return rows.groupBy("key").agg(F.min("id").alias("name"), *(F.sum((F.col("toxic") == c).cast("long")).alias(f"n{c}") for c in (0, 1)), F.min("terms").alias("terms"), F.min("counts").alias("counts"))


def votes_left_out(entries: DataFrame, near, tried: tuple, tasks: int) -> list[tuple]:
    """Neighbours.left_out of every entry that has a word, asked on the executors."""

    def run(batches):
        n = near.value
        for batch in batches:
            rows = batch.select(["key", "terms", "counts"]).to_pylist()
            entries = [bisect_left(n.keys, r["key"]) for r in rows]
            out = n.left_out(entries, [vector_of(r["terms"], r["counts"], n.idf) for r in rows], tried)
            kinds = pa.int64(), pa.int32(), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["entry", "toxic", "votes"])

    asked = entries.where(F.length("terms") > 0).select("key", "terms", "counts").repartition(tasks)
    return [(r.entry, r.toxic, r.votes) for r in asked.mapInArrow(run, "entry bigint, toxic int, votes array<double>").collect()]


def vector_of(terms: bytes, counts: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of an entry from what entries_of() keeps of it."""
    numbers = np.frombuffer(terms, dtype=np.int32)
    return numbers, weights_of(numbers, np.frombuffer(counts, dtype=np.uint32), idf).astype(np.float32)


def learn_model(df: DataFrame, labels: DataFrame, learn, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most_examples: int = MOST_EXAMPLES, tried: tuple = NEIGHBOURS) -> Model:
    """learn: a condition on the label rows to learn from; tried: numbers of neighbours."""
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    chosen, shares = sample_labels(labels, learn, id_column, label_column, most_examples)
    listed = F.broadcast(spark.createDataFrame(chosen, f"id {kind}, toxic int"))  # two classes of most_examples rows
    texts = df.select(F.col(id_column).alias("id"), text_bytes(text_column)).join(listed, "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    examples = stored(texts.select("id", "toxic", "text").mapInArrow(_terms, f"id {kind}, toxic int, terms binary, counts binary"))
    total = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0.0)
    if not total.get(0, 0) or not total.get(1, 0):
        nothing = HashSet(np.zeros(0, dtype=np.uint64))
        return Model(nothing, broadcast(spark, nothing), broadcast(spark, None), Calibration(prior))
    # Arrow, as the vocabulary of the examples has many terms
    vocabulary = HashSet(examples.select("terms").mapInArrow(_distinct, "term bigint").distinct().toArrow().column("term").to_numpy().view(np.uint64), TERM_BITS)
    sent, n_terms = broadcast(spark, vocabulary), len(vocabulary.values)
    weights = idf(df, sent, n_terms, text_column)
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-sum(total.values()) // LEAST_ENTRIES)))
    entries = stored(entries_of(examples, sent, tasks))
    released(examples)
    found, n_of, bare = [], np.zeros(n_terms, dtype=np.int64), [0.0, 0.0]
    scale = {c: shares.get(c, 0.0) / total[c] for c in (0, 1)}
    for r in entries.select("key", "name", "n0", "n1", "terms").toLocalIterator():
        mass = [r.n0 * scale[0], r.n1 * scale[1]]
        if r.terms:
            found.append((bytes(r.key), r.name, mass))
            n_of[np.frombuffer(r.terms, dtype=np.int32)] += 1
        else:
            bare = mass
    found.sort(key=lambda e: e[0])
    keys, mass = [e[0] for e in found], np.array([e[2] for e in found]).reshape(-1, 2)
    rows = ((bisect_left(keys, bytes(r.key)), *vector_of(r.terms, r.counts, weights)) for r in entries.select("key", "terms", "counts").where(F.length("terms") > 0).toLocalIterator())
    index = BlockMaxIndex.of_rows(len(keys), n_of, rows)
    near = broadcast(spark, Neighbours(weights, keys, [e[1] for e in found], mass, scale, prior, index))
    del index
    share = (bare[1] + (0.0 if keys else 1e-4 * prior)) / (sum(bare) + 1e-4)
    calibration = calibrated(share, votes_left_out(entries, near, tried, tasks) if keys else [], mass, tried)
    released(entries)
    return Model(vocabulary, sent, near, calibration)


def idf(df: DataFrame, sent, n: int, text_column: str) -> np.ndarray:
    """log((rows + 1) / (rows with the term + 1)) for the n terms of the vocabulary sent, counted over all rows of df; at the end, that of a term of one row."""

    def run(batches):
        total = np.zeros(len(sent.value.values) + 1, dtype=np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for part in slices(batch.column("text")):
                distinct, number, _, _ = counted(part)
                known = sent.value.has(distinct)
                total[np.searchsorted(sent.value.values, distinct[known])] += np.bincount(number, minlength=len(distinct))[known]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counts = np.zeros(n + 1)
    found = df.select(text_bytes(text_column)).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return np.log((counts[-1] + 1) / (np.append(counts[:-1], 1) + 1)) + 1e-6


def score_toxicity(df: DataFrame, model: Model, columns: list, schema: str, text_column: str = "text") -> DataFrame:
    """The columns given, score and evidence for every row of df, in one scan without a shuffle."""
    sent, near, calibration, n = model.sent, model.near, model.calibration, len(columns)

    def run(batches):
        for batch in batches:
            scores, evidence = [], []
            for part in slices(batch.column(n)):
                for score, nearest in calibration.score(near.value, vectors(part, sent.value)):
                    scores.append(score)
                    evidence.append([{"id": str(i), "cosine": c} for i, c in nearest])
            kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64()), pa.array(evidence, kind)], [*batch.schema.names[:n], "score", "evidence"])

    return df.select(*columns, F.col(text_column).cast("binary").alias("_text")).mapInArrow(run, f"{schema}, score double, evidence array<struct<id: string, cosine: double>>")


def held_out(id_column: str, folds: int = 5, fold: int = 0):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn_model(df, labels, ~held_out("doc_id"))
    out = score_toxicity(df, model, [F.col("doc_id"), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")], "doc_id bigint, held_out boolean")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op2_toxicity": op2_toxicity}
