"""Quality classifier by co-training of two views of a page.

The text view sees the content alone: hashed words and word endings, and bins
of the layout (length, lines, and shares of letters, capitals, digits, symbols
and distinct words).  The metadata view sees the page's other columns alone
(source, language, recorded length, by name, pair and power of two) and never
the text.  Both are naive Bayes models, so what they learn from any number of
rows is one sum for each feature and class.

Both start from the same labelled rows.  Then, in each of ROUNDS scans over all
rows without a chosen label, each view judges every row, and those it is sure
of (a calibrated probability of SURE, at even classes) are added, with the
label it gives them, to the sums of the other view.  A task adds up its rows
before the shuffle, so the whole corpus takes part and only sums move.  At the
end the views' log odds are calibrated on labelled rows that no training saw,
and so is their sum, which scores every document.

The labelled rows are a bounded sample, the MOST_LABELLED of each class that
come first by a hash of the id, a quarter of them for calibration only; of rows
that share an id the one with the smallest text is learned from.

Defined cases: a null or empty text has no words and an empty layout, and is
scored by the same models; a null source, language, length or id is a value of
its own for the features, and is never a labelled row without an id.  Rows
repeated in the input come out repeated; a row labelled both ways counts as
bad.  Without labels of both classes every score is 0.5.  A row is kept if its
score is 0.5 at least.  A missing metadata column is as one of nulls.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm.frames import broadcast, documents, first_by_hash, text_bytes
from carnelian.llm.text import Slice, mix, slices, words

TEXT_BITS, METADATA_BITS = 14, 12
MOST_LABELLED = 3_000
ROUNDS, SURE = 3, 0.9
#: Added to every sum.
SMOOTHING = 0.05
#: Sums are of whole units, so that they are the same in any order.
UNIT = 10_000
METADATA = ("source", "lang", "n_chars")

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
N_LAYOUT, N_BINS = 9, 64
SIZES = {"text": (1 << TEXT_BITS) + N_LAYOUT * N_BINS, "metadata": 1 << METADATA_BITS}


class Sparse(NamedTuple):
    """Rows of (column, value) pairs."""

    edges: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def times(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.values * weights[self.columns])])
        return sums[self.edges[1:]] - sums[self.edges[:-1]]

    def sums(self, n: int, rows: np.ndarray) -> np.ndarray:
        """Sums of the columns over the rows where rows holds, in units."""
        units = np.where(np.repeat(rows, np.diff(self.edges)), np.rint(self.values * UNIT), 0.0)
        return np.bincount(self.columns, weights=units, minlength=n).astype(np.int64)

    def take(self, rows: np.ndarray) -> Sparse:
        parts = [np.arange(a, b) for a, b in zip(self.edges[rows].tolist(), self.edges[rows + 1].tolist(), strict=True)]
        at = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        return Sparse(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), self.columns[at], self.values[at])


def text_view(part: Slice) -> Sparse:
    """Unit rows of 1 + log counts of hashed words and of their last two bytes, and beside them a bin of each layout figure."""
    found = words(part, folded=False)
    ends = found.ends
    last = part.buf[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, dtype=np.uint64)
    before = np.where(ends - found.starts > 1, part.buf[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else last
    hashes = np.concatenate([mix(found.hashes, 3), mix(last * np.uint64(257) + before, 5)])
    rows = np.concatenate([found.rows, found.rows])
    n = 1 << TEXT_BITS
    key, counts = np.unique(rows * n + (hashes >> np.uint64(64 - TEXT_BITS)).astype(np.int64), return_counts=True)
    edges = np.searchsorted(key, np.arange(len(part) + 1) * n)
    values = 1 + np.log(counts)
    sums = np.concatenate([[0.0], np.cumsum(values * values)])
    norm = np.sqrt(np.maximum(1e-12, sums[edges[1:]] - sums[edges[:-1]]))
    values = values / np.repeat(norm, np.diff(edges))
    bins = n + layout(part) + N_BINS * np.arange(N_LAYOUT)
    at = np.repeat(edges[1:], N_LAYOUT)
    return Sparse(edges + N_LAYOUT * np.arange(len(edges)), np.insert(key % n, at, bins.ravel()), np.insert(values, at, 1.0))


def layout(part: Slice) -> np.ndarray:
    """[row, N_LAYOUT] bins of the layout figures, from 0."""
    out = np.zeros((len(part), N_LAYOUT))
    for r in range(len(part)):
        text = part.text(r)
        n = max(1, len(text))
        tokens, lines = text.split(), text.count(b"\n") + 1
        share = lambda chars, text=text, n=n: (len(text) - len(text.translate(None, chars))) / n
        letters, digits, space = share(_LETTER), share(_DIGIT), share(_SPACE)
        other = 1 - letters - digits - space if text else 0.0
        logs = (len(text), lines, len(tokens) / lines)
        shares = (letters, share(_UPPER), digits, space, max(0.0, other), len(set(tokens)) / max(1, len(tokens)))
        out[r] = (*(2 * np.log2(1 + x) for x in logs), *(40 * np.sqrt(x) for x in shares))
    return np.minimum(out.astype(np.int64), N_BINS - 1)


def _value(name: str, value) -> str:
    if isinstance(value, int | float) and not isinstance(value, bool):
        value = f"2**{int(abs(value)).bit_length()}"
    return f"{name}\0" if value is None else f"{name}={value}"


def metadata_view(rows: list[tuple], names: tuple = METADATA) -> Sparse:
    """A column for each value of a row's metadata and for each pair of values; numbers by powers of two."""
    columns = []
    for row in rows:
        held = [_value(name, value) for name, value in zip(names, row, strict=True)]
        held += [f"{a}\1{b}" for k, a in enumerate(held) for b in held[:k]]
        columns.append([zlib.crc32(h.encode()) >> (32 - METADATA_BITS) for h in held])
    width = len(names) * (len(names) + 1) // 2
    flat = np.array(columns, dtype=np.int64).reshape(-1)
    return Sparse(np.arange(len(rows) + 1) * width, flat, np.ones(len(flat)))


class Linear(NamedTuple):
    weights: np.ndarray

    def odds(self, view: Sparse) -> np.ndarray:
        return view.times(self.weights)


def naive_bayes(sums: np.ndarray) -> Linear:
    """Log ratios of the features from their sums by class [2, feature]."""
    shares = sums / UNIT + SMOOTHING
    logs = np.log(shares / shares.sum(axis=1, keepdims=True))
    return Linear(logs[1] - logs[0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(odds: np.ndarray, y: np.ndarray, even: bool = False) -> tuple[float, float]:
    """(slope, shift) of log odds, by Newton steps on smoothed targets; even: classes of equal weight."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, len(y) / 2 / max(1, n1), len(y) / 2 / max(1, n0)) if even else np.ones(len(y))
    # in units of the odds' spread, so that the steps suit any range
    spread = float(odds.std()) or 1.0
    x = np.stack([odds / spread, np.ones(len(odds))], axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ a)
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        a = a - np.clip(np.linalg.solve(hessian, x.T @ (weight * (p - goal)) + 1e-3 * (a - [1.0, 0.0])), -1, 1)
    return float(max(a[0], 0.0) / spread), float(a[1])


VIEWS = ("text", "metadata")


class Model(NamedTuple):
    text: Linear
    metadata: Linear
    text_fit: tuple[float, float]
    metadata_fit: tuple[float, float]
    fit: tuple[float, float]

    def odds(self, text: Sparse, metadata: Sparse) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of the two views, at even classes."""
        return self.text_fit[0] * self.text.odds(text) + self.text_fit[1], self.metadata_fit[0] * self.metadata.odds(metadata) + self.metadata_fit[1]

    def score(self, text: Sparse, metadata: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, metadata, combined) probabilities of good quality; the first two at even classes."""
        a, b = self.odds(text, metadata)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.fit[0] * (a + b) + self.fit[1])


def fitted(sums: dict[str, np.ndarray], text: Sparse, metadata: Sparse, y: np.ndarray) -> Model:
    """The model of these sums, calibrated on rows with labels y."""
    models = {view: naive_bayes(sums[view]) for view in VIEWS}
    first = Model(models["text"], models["metadata"], platt(models["text"].odds(text), y, True), platt(models["metadata"].odds(metadata), y, True), (1.0, 0.0))
    return first._replace(fit=platt(sum(first.odds(text, metadata)), y))


def pseudo_sums(model: Model, text: Sparse, metadata: Sparse, free: np.ndarray) -> dict[str, np.ndarray]:
    """What the rows where free holds add to the sums of each view: those that the other view is sure of."""
    a, b = model.odds(text, metadata)
    least = np.log(SURE / (1 - SURE))
    return {view: np.stack([own.sums(SIZES[view], free & (-odds >= least)), own.sums(SIZES[view], free & (odds >= least))]) for view, own, odds in (("text", text, b), ("metadata", metadata, a))}


def _columns(df: DataFrame, text_column: str, metadata: tuple) -> list:
    return [text_bytes(text_column), *[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(f"m{k}") for k, c in enumerate(metadata)]]


def _views(batch: pa.RecordBatch, first: int, names: tuple):
    """(part, text view, metadata view) of each slice of a batch whose text is column first and whose metadata follow."""
    rows = list(zip(*(batch.column(first + 1 + k).to_pylist() for k in range(len(names))), strict=True)) if names else [()] * batch.num_rows
    for part in slices(batch.column(first)):
        yield part, text_view(part), metadata_view(rows[part.at : part.at + len(part)], names)


def _features(names: tuple):
    """The views of every row, with its label."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("text_columns", "text_values", "metadata_columns")}
            for _, text, metadata in _views(batch, 2, names):
                for view, edges in ((text, text.edges.tolist()), (metadata, metadata.edges.tolist())):
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        if view is text:
                            out["text_columns"].append(view.columns[a:b].astype(np.int32))
                            out["text_values"].append(view.values[a:b].astype(np.float32))
                        else:
                            out["metadata_columns"].append(view.columns[a:b].astype(np.int32))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["id", "label", *out])

    return run


def _stacked(columns: list, values: list | None = None) -> Sparse:
    edges = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *(np.array(c, dtype=np.int64) for c in columns)])
    return Sparse(edges, flat, np.ones(len(flat)) if values is None else np.concatenate([np.zeros(0), *(np.array(v, dtype=float) for v in values)]))


def learn_model(df: DataFrame, labels: DataFrame, learn, id_column: str = "doc_id", text_column: str = "text", metadata: tuple = METADATA, label_column: str = "quality", most: int = MOST_LABELLED, rounds: int = ROUNDS) -> Model | None:
    """learn: a condition on the labelled ids, under the name id."""
    spark, kind = df.sparkSession, df.schema[id_column].dataType.simpleString()
    usable = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.min(label_column).cast("int").alias("label"))
    chosen = [(r.id, r.group) for r in first_by_hash(usable.where(learn).withColumnRenamed("label", "group"), most).select("id", "group").collect()]
    listed = F.broadcast(spark.createDataFrame(chosen, f"id {kind}, label int"))  # two classes of at most most rows
    columns = _columns(df, text_column, metadata)
    names = ["text", *[f"m{k}" for k in range(len(metadata))]]
    rows = df.select(F.col(id_column).alias("id"), *columns).join(listed, "id").groupBy("id", "label").agg(F.min(F.struct(*names)).alias("row")).select("id", "label", "row.*")
    rows = rows.mapInArrow(_features(metadata), f"id {kind}, label int, text_columns array<int>, text_values array<float>, metadata_columns array<int>")
    got = sorted(rows.toLocalIterator(), key=lambda r: (zlib.crc32(str(r.id).encode()), str(r.id)))
    y = np.array([r["label"] for r in got], dtype=np.int64)
    if len(np.unique(y)) < 2:
        return None
    views = {"text": _stacked([r["text_columns"] for r in got], [r["text_values"] for r in got]), "metadata": _stacked([r["metadata_columns"] for r in got])}
    # each class in its order of arrival: three to train, one to calibrate
    turn = np.zeros(len(y), dtype=np.int64)
    for c in (0, 1):
        turn[y == c] = np.arange((y == c).sum()) % 4
    test = turn == 3 if (np.bincount(y) >= 8).all() else np.ones(len(y), dtype=bool)
    train = ~test if not test.all() else test
    base = {v: np.stack([views[v].sums(SIZES[v], train & (y == c)) for c in (0, 1)]) for v in VIEWS}
    held = [views[v].take(np.flatnonzero(test)) for v in VIEWS]
    model = fitted(base, *held, y[test])
    known = broadcast(spark, frozenset(r["id"] for r in got))
    scanned = df.select(F.col(id_column).alias("id"), *columns)
    for _ in range(rounds):
        more = _pool_sums(scanned, model, known, metadata)
        model = fitted({v: base[v] + more[v] for v in VIEWS}, *held, y[test])
    return model


def _pool_sums(scanned: DataFrame, model: Model, known, names: tuple) -> dict[str, np.ndarray]:
    """pseudo_sums() over all rows but the labelled ones, added up in each task."""
    sent = broadcast(scanned.sparkSession, model)

    def run(batches):
        total = {v: np.zeros((2, SIZES[v]), dtype=np.int64) for v in VIEWS}
        for batch in batches:
            free = np.array([i not in known.value for i in batch.column("id").to_pylist()], dtype=bool)
            for part, text, metadata in _views(batch, 1, names):
                for view, sums in pseudo_sums(sent.value, text, metadata, free[part.at : part.at + len(part)]).items():
                    total[view] += sums
        both = np.concatenate([total[v] for v in VIEWS], axis=1)
        some = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[0][some]), pa.array(both[1][some])], ["feature", "bad", "good"])

    found = scanned.mapInArrow(run, "feature bigint, bad bigint, good bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    both = np.zeros((2, sum(SIZES.values())), dtype=np.int64)
    at = found.column("feature").to_numpy()
    both[0][at], both[1][at] = found.column("bad").to_numpy(), found.column("good").to_numpy()
    return {"text": both[:, : SIZES["text"]], "metadata": both[:, SIZES["text"] :]}


def classify(df: DataFrame, model: Model | None, columns: list, schema: str, text_column: str = "text", metadata: tuple = METADATA) -> DataFrame:
    """The columns given, text_score, metadata_score and score for every row of df, in one scan without a shuffle."""
    sent, n = broadcast(df.sparkSession, model), len(columns)

    def run(batches):
        m = sent.value
        for batch in batches:
            scores = [np.stack(m.score(text, meta)) for _, text, meta in _views(batch, n, metadata)] if m else [np.full((3, batch.num_rows), 0.5)]
            done = np.concatenate(scores, axis=1) if scores else np.zeros((3, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(s) for s in done)], [*batch.schema.names[:n], "text_score", "metadata_score", "score"])

    return df.select(*columns, *_columns(df, text_column, metadata)).mapInArrow(run, f"{schema}, text_score double, metadata_score double, score double")


def held_out(id_column: str, folds: int = 5, fold: int = 0):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn_model(df, labels, ~held_out("id"))
    out = classify(df, model, [F.col("doc_id"), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")], "doc_id bigint, held_out boolean")
    return out.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "kept": F.col("score") >= 0.5})


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
