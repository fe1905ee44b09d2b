"""Benchmark decontamination by a generalised suffix automaton of the test items.

The words of every item go into one automaton.  A document's words are streamed
through it, which gives at each word the length of the longest match that ends
there; wherever that length reaches a window (ten words, or a whole shorter
item) the words of the window are hit.  A stretch of the stream is only walked
where every pair of neighbouring words occurs in an item: elsewhere the longest
match is one word at most, so the automaton would fall back to its start.

The automaton is sent to the executors, so its size is checked: items beyond
GROUP_WORDS words go into further automata, each in a scan of its own, and the
hits of the scans are united.

Defined cases: a null, empty or wordless text has no words and no hits; a
wordless item is no window; a null item id marks words but is not listed;
repeated items count once by id; repeated documents come out repeated.  With no
items nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm.frames import broadcast, documents, text_bytes
from carnelian.llm.text import FOLD, HashSet, Slice, Words, hash_words, ngrams, slices, words

WINDOW = 10
#: Most words of items in one automaton (about 200 bytes each in a worker).
GROUP_WORDS = 400_000
#: A document of which more than this share of words is hit is dropped whole.
MAX_COVERAGE = 0.5


class SuffixAutomaton:
    """Of several sequences of hashables; state 0 is the start."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """Parts from q the strings that p reaches by symbol."""
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = part
            p = self.link[p]
        return part

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            there = self.next[last].get(symbol)
            if there is not None:
                last = there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
            last = new

    def stream(self, sequence):
        """(state, longest matching length) after each symbol."""
        moves, link, length = self.next, self.link, self.length
        state = matched = 0
        for symbol in sequence:
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            if symbol in moves[state]:
                state = moves[state][symbol]
                matched += 1
            else:
                matched = 0
            yield state, matched

    def windows(self, sequence, window: int):
        """(state, longest matching length up to window) after each symbol.

        The state is that of the match itself, not of a longer one that ends there, so a step climbs few links."""
        moves, link, length = self.next, self.link, self.length
        state = matched = 0
        for symbol in sequence:
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            if symbol in moves[state]:
                state = moves[state][symbol]
                matched = min(matched + 1, window)
                while length[link[state]] >= matched:
                    state = link[state]
            else:
                matched = 0
            yield state, matched


class Benchmark:
    """The automaton of some items, with the windows that its states stand for."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.automaton = window, SuffixAutomaton()
        self.at: dict[int, set] = defaultdict(set)  # state of a full window: items
        self.short: dict[int, set] = defaultdict(set)  # state of a whole short item: (words, item)
        self.single: dict[int, set] = defaultdict(set)  # hash of a one-word item
        pairs, kept = [], []
        for name, tokens in items:
            if len(tokens) == 1:
                self.single[int(hash_words(tokens)[0])].add(name)
            elif tokens:
                lengths = np.array([0, *(len(t) + 1 for t in tokens)], dtype=np.int64)
                text = np.frombuffer(b" ".join(tokens) + b" ", dtype=np.uint8)
                found = words(Slice(0, text, np.array([0, lengths.sum()])))
                pairs.append(ngrams(found, 2)[0])
                kept.append((name, found.hashes.tolist()))
                self.automaton.add(kept[-1][1])
        for name, sequence in kept:
            size = min(window, len(sequence))
            for state, matched in self.automaton.windows(sequence, size):
                if matched == size:
                    if size == window:
                        self.at[state].add(name)
                    else:
                        self.short[state].add((size, name))
        self.at, self.short, self.single = dict(self.at), dict(self.short), dict(self.single)
        self.pairs = HashSet(np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.uint64))
        self.ones = HashSet(np.array(sorted(self.single), dtype=np.uint64), 12)
        self.least = min([window, *(size for found in self.short.values() for size, _ in found)])

    def _walk(self, sequence: list[int]) -> tuple[list[tuple[int, int]], set]:
        hits, items, window = [], set(), self.window
        automaton, at, short = self.automaton, self.at, self.short
        for i, (state, matched) in enumerate(automaton.windows(sequence, window)):
            if matched == window and state in at:
                hits.append((i - window + 1, i + 1))
                items |= at[state]
            if short:
                up = state
                while up > 0:
                    for size, name in short.get(up, ()):
                        if size <= matched:
                            hits.append((i - size + 1, i + 1))
                            items.add(name)
                    up = automaton.link[up]
        return hits, items

    def find(self, found: Words) -> tuple[np.ndarray, dict[int, set]]:
        """Which words of a slice are hit, and the items by row."""
        n = len(found.hashes)
        hit, items = np.zeros(n, dtype=bool), defaultdict(set)
        if not n:
            return hit, items
        grams, at = ngrams(found, 2)
        linked = np.zeros(n + 1, dtype=np.int8)
        linked[at[self.pairs.has(grams)] + 1] = 1
        change = np.diff(np.concatenate([linked, [0]]))
        begins, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + 1
        long = stops - begins >= self.least
        for a, b in zip(begins[long].tolist(), stops[long].tolist(), strict=True):
            spans, names = self._walk(found.hashes[a:b].tolist())
            for x, y in spans:
                hit[a + x : a + y] = True
            if names:
                items[int(found.rows[a])] |= names
        if self.single:
            for i in np.flatnonzero(self.ones.has(found.hashes)).tolist():
                hit[i] = True
                items[int(found.rows[i])] |= self.single[int(found.hashes[i])]
        return hit, items


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words."""
    change = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True))


def groups(benchmark: DataFrame, id_column: str, text_column: str, window: int, most: int) -> list:
    """One Benchmark for each bounded group of items; at least one."""
    out, group, size = [], [], 0
    rows = benchmark.select(F.col(id_column).cast("string").alias("i"), F.col(text_column).alias("t")).distinct()
    for row in rows.sort("i", "t").toLocalIterator():
        tokens = (row.t or "").encode().translate(FOLD).split()
        if group and size + len(tokens) > most:
            out.append(Benchmark(group, window))
            group, size = [], 0
        group.append((row.i, tokens))
        size += len(tokens)
    return [*out, Benchmark(group, window)]


def _scan(df: DataFrame, id_column: str, text_column: str, sent) -> DataFrame:
    """id, key (tells apart texts under one id), n_words, hit spans in words, items."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        bench = sent.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for part in slices(batch.column("text")):
                found = words(part)
                hit, named = bench.find(found)
                n_words += found.counts().tolist()
                any_hit = set(np.unique(found.rows[hit]).tolist())
                for r in range(len(part)):
                    spans.append([{"first": a, "stop": b} for a, b in spans_of(hit[found.first[r] : found.first[r + 1]])] if r in any_hit else [])
                    items.append(sorted(x for x in named[r] if x is not None) if r in named else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                ["id", "key", "n_words", "spans", "items"],
            )

    return df.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("key"), text_bytes(text_column)).mapInArrow(run, f"id {kind}, key bigint, n_words bigint, spans array<struct<first: bigint, stop: bigint>>, items array<string>")


def find_leaks(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", window: int = WINDOW, group_words: int = GROUP_WORDS) -> DataFrame:
    """id, key, n_words, spans (hit runs, in words from 0), items, for every row of df.

    With one automaton this is a single scan without a shuffle.  With more, the
    hits of each further scan (contaminated documents only) are joined to the
    first, and runs that meet are united."""
    spark = df.sparkSession
    found = [_scan(df, id_column, text_column, broadcast(spark, b)) for b in groups(benchmark, item_column, "text", window, group_words)]
    if len(found) == 1:
        return found[0]
    rest = found[1]
    for more in found[2:]:
        rest = rest.unionByName(more)
    rest = rest.where(F.size("spans") > 0).groupBy("id", "key").agg(F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
    base = found[0].join(rest.withColumnsRenamed({"id": "id2", "key": "key2"}), F.col("id").eqNullSafe(F.col("id2")) & F.col("key").eqNullSafe(F.col("key2")), "left")
    none = F.array().cast("array<struct<first: bigint, stop: bigint>>")
    ordered = F.array_sort(F.concat("spans", F.coalesce("more_spans", none)))
    united = F.aggregate(
        ordered,
        none,
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return base.select("id", "key", "n_words", united.alias("spans"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>"))))).alias("items"))


def remove_spans(df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, group_words: int = GROUP_WORDS) -> DataFrame:
    """df without the hit spans: each is cut from its text, from its first word
    to its last; rows of which more than max_coverage of the words are hit go.
    Columns stay as they are.

    With more than one automaton, each marks its hits on the text as it came, in
    a column of runs; the last unites them, judges the coverage and cuts."""
    *before, last = groups(benchmark, item_column, "text", window, group_words)
    out, runs = df, "_runs"
    while runs in df.columns:
        runs += "_"
    for bench in before:
        out = _mark(out, text_column, runs, broadcast(df.sparkSession, bench))
    return _cut(out, df.schema, text_column, runs, broadcast(df.sparkSession, last), max_coverage)


def _hits(bench: Benchmark, part: Slice, found: Words, batch: pa.RecordBatch, runs: str) -> np.ndarray:
    """Which words of a slice are hit, now or in the runs (first, stop, first, stop, ...) that were marked before."""
    hit, _ = bench.find(found)
    if runs in batch.schema.names:
        for r, marked in enumerate(batch.column(runs).slice(part.at, len(part)).to_pylist()):
            for x, y in zip(marked[::2], marked[1::2], strict=True):
                hit[found.first[r] + x : found.first[r] + y] = True
    return hit


def _mark(df: DataFrame, text_column: str, runs: str, sent) -> DataFrame:
    """df with the runs of hit words of each row added to those in the column runs."""
    place, columns = df.columns.index(text_column), [c for c in df.columns if c != runs]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), f"`{runs}` array<bigint>"])

    def run(batches):
        bench = sent.value
        for batch in batches:
            marked = []
            for part in slices(batch.column(place)):
                found = words(part)
                hit = _hits(bench, part, found, batch, runs)
                rows = set(np.unique(found.rows[hit]).tolist())
                marked += [[x for span in spans_of(hit[found.first[r] : found.first[r + 1]]) for x in span] if r in rows else [] for r in range(len(part))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(marked, pa.list_(pa.int64()))], [*batch.schema.names[: len(columns)], runs])

    return df.mapInArrow(run, schema)


def _cut(df: DataFrame, schema, text_column: str, runs: str, sent, max_coverage: float) -> DataFrame:
    place, width = df.columns.index(text_column), len(schema)

    def run(batches):
        bench = sent.value
        for batch in batches:
            keep, changed = [], {}
            for part in slices(batch.column(place)):
                found = words(part)
                hit = _hits(bench, part, found, batch, runs)
                counts, hits = found.counts(), np.bincount(found.rows[hit], minlength=len(part))
                keep += (hits <= max_coverage * counts).tolist()
                for r in np.flatnonzero((hits > 0) & (hits <= max_coverage * counts)).tolist():
                    text, a, at = part.text(r), found.first[r], 0
                    pieces = []
                    for x, y in spans_of(hit[a : found.first[r + 1]]):
                        begin, end = found.starts[a + x] - part.offsets[r], found.ends[a + y - 1] - part.offsets[r]
                        pieces.append(text[at:begin])
                        at = end
                    changed[part.at + r] = b"".join([*pieces, text[at:]]).decode()
            batch = batch.select(batch.schema.names[:width])
            if changed:
                texts = batch.column(place).to_pylist()
                for r, text in changed.items():
                    texts[r] = text
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.column(place).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, schema)


def _digest(column: str):
    return F.sha2(F.array_join(column, ","), 256)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, x: total + x["stop"] - x["first"])
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), _digest("items").alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES = {"op5_decontamination": op5_decontamination}

_TOKENS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES = {
    "op5_decontamination": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS i, {_TOKENS} AS w FROM benchmark),
part AS (SELECT i, w, least(10, len(w)) AS size FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT i, size, array_to_string(w[k:k + size - 1], ' ') AS s
        FROM part, unnest(range(1, len(w) - size + 2)) AS u(k)),
doc AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
size AS (SELECT DISTINCT size FROM win),
place AS (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS s
          FROM doc, size, unnest(range(1, len(w) - size + 2)) AS u(k)),
hit AS (SELECT doc_id, k, p.size, i FROM place p JOIN win USING (s, size)),
word AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM hit, unnest(range(0, size)) AS u(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT i) AS n, string_agg(DISTINCT i, ',' ORDER BY i) AS names FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""
}
