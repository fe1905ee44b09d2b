"""N-gram Jaccard join: MinHash LSH forest with exact verification.

Texts are sets of five-word shingles (a shorter text's words are one shingle).
Texts of the same words are one class, known by a 128-bit hash, and only
classes are joined.  A signature has TREES paths of DEPTH minima each; a tree
of the forest is the sorted trie of one path.  Two classes meet in a tree at
the depth to which their paths agree.

Matching starts with whole paths and shortens them level by level.  At depth d
a pair of similarity s meets in some tree with probability
p = 1 - (1 - s**d)**TREES, so each pair that a class has met stands for
(1 - p) / p further ones which it hasn't.  A class stays open, and its prefixes
are shortened, until these and those of one supposed partner at the threshold
are at most 1 - target of its partners; a class with many close partners thus
ends early, one without goes on to the depth that has the target recall at the
threshold, and one whose partners lie near it may go further.  At each depth
only nodes are looked at that hold an open class and in which branches come
together; a pair is taken where it meets deepest, in the first such tree.
Paths that no other class shares at the depth where a class without partners
ends are dropped before.  A node that holds more than NODE_ROWS classes is cut
into blocks, every pair of which is a cell of its own, so no task holds an
unbounded node and no pair of the node is lost.

In a cell, pairs are first held against the estimate from the signatures (a
pair ERRORS standard errors below the threshold goes; one that belongs does so
with a probability below 1e-10).  Only rows with such a pair get their
shingles, and their exact similarity decides.  A cell gives back a row for each
of its members: how many documents it links to, and the smallest member that
it is connected to; no pair leaves a cell.  Labels are then spread over the
components by minimum and pointer jumping.

Class id: the smallest doc_id of the component.  n_links: documents of other
texts that are linked directly, and further documents with the same words.

Defined cases: a null, empty or wordless text is linked to nothing and is a
class of its own with its own id; null ids are ignored for the smallest id and
get their group's; rows repeated in the input are copies of one another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm.frames import documents, fresh, released, stored, text_bytes
from carnelian.llm.text import member, mix, ngrams, sequence_hashes, slices, to_signed, words

SHINGLE, SIMILARITY = 5, 0.8
TREES, DEPTH = 16, 6
TARGET_RECALL = 0.9995
#: Classes in a cell's side at most.
NODE_ROWS = 1024
#: Standard errors below the threshold at which a pair is no longer verified.
ERRORS = 6.5

_rng = np.random.RandomState(5)
_MULTIPLY = (_rng.randint(1, 1 << 31, TREES * DEPTH).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_FLIP = _rng.randint(0, 1 << 31, TREES * DEPTH).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def unmet(similarity, depth: int):
    """How many pairs of that similarity haven't met at a depth for each that has."""
    missed = (1 - np.asarray(similarity, dtype=float) ** depth) ** TREES
    return missed / (1 - missed)


def closing_depth(similarity: float = SIMILARITY, target: float = TARGET_RECALL) -> int:
    """The depth at which a class without partners ends; 1 if no prefix has the target recall."""
    for depth in range(DEPTH, 1, -1):
        if unmet(similarity, depth) <= 1 - target:
            return depth
    return 1


def shingles(found, n_rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle, repeats included, by row."""
    grams, at = ngrams(found, size)
    rows, counts = found.rows[at], found.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return grams, rows
    hashes = np.concatenate([grams, sequence_hashes(found, 41)[short]])
    rows = np.concatenate([rows, short])
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def signatures(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """uint16 [row, TREES * DEPTH]: the high bits of the minima; rows without a shingle are all ones."""
    out = np.full((n_rows, TREES * DEPTH), 0xFFFF, dtype=np.uint16)
    if len(hashes):
        full = np.flatnonzero(np.bincount(rows, minlength=n_rows))
        edges = np.searchsorted(rows, full)
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        for k in range(TREES * DEPTH):
            out[full, k] = (np.minimum.reduceat((low * _MULTIPLY[k]) ^ _FLIP[k], edges) >> np.uint32(16)).astype(np.uint16)
    return out


def paths(signature: np.ndarray) -> np.ndarray:
    """int64 [row, TREES, DEPTH]: hashes of the prefixes of every length of each path."""
    levels = signature.reshape(len(signature), TREES, DEPTH).astype(np.uint64)
    out, key = np.zeros(levels.shape, dtype=np.uint64), np.zeros(levels.shape[:2], dtype=np.uint64)
    for k in range(DEPTH):
        key = out[:, :, k] = mix(key ^ levels[:, :, k], k + 1)
    return to_signed(out.reshape(-1)).reshape(out.shape)


def _sign(batches):
    for batch in batches:
        nodes, full, signed = [], [], []
        for part in slices(batch.column("text")):
            found = words(part)
            hashes, rows = shingles(found, len(part))
            signed.append(signatures(hashes, rows, len(part)))
            both = np.stack([sequence_hashes(found, 1), sequence_hashes(found, 3)], axis=1).astype(">u8")
            nodes += [row.tobytes() for row in both]
            full.append(found.counts() > 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("key"), pa.array(nodes, pa.binary()), pa.array(np.concatenate(full)), pa.array([row.tobytes() for row in np.concatenate(signed)], pa.binary())],
            ["id", "key", "node", "full", "signature"],
        )


def _placed(first: int, last: int):
    """A row for each class and tree: the hashes of its prefixes of first to last levels."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = paths(_signatures_of(table))[:, :, first - 1 : last].reshape(-1, last - first + 1)
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), TREES))),
                    pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1))),
                ],
                ["node", "tree", "paths"],
            )

    return run


def _estimated(similarity: float) -> float:
    """Agreement of two signatures below which a pair is given up."""
    k = TREES * DEPTH
    return similarity - ERRORS * math.sqrt(similarity * (1 - similarity) / k)


CELL = ("depth", "tree", "path", "low", "high")


def by_cell(work):
    """work(table, edges) over runs of whole cells, from batches that are sorted by cell.

    edges: where each cell begins, and the end.  At most one cell is carried from
    a batch to the next."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            edges = _edges(rest)
            last = int(edges[-2]) if len(edges) > 1 else 0
            if last:
                yield from work(rest.slice(0, last), edges[:-1])
                rest = rest.slice(last).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from work(rest, _edges(rest))

    return run


def _edges(table: pa.Table) -> np.ndarray:
    n = table.num_rows
    new = np.zeros(max(0, n - 1), dtype=bool)
    for name in CELL:
        column = table.column(name).to_numpy()
        new |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, dtype=np.int64)


def _signatures_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint16).reshape(table.num_rows, TREES * DEPTH)


def _all_pairs(edges: np.ndarray, most: int = 100_000):
    """(rows, rows) of all pairs within cells, at most about most at a time."""
    starts, sizes = edges[:-1], np.diff(edges)
    for m in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == m]
        if m <= 64:
            i, j = np.triu_indices(m, 1)
            step = max(1, most // len(i))
            for at in range(0, len(own), step):
                base = own[at : at + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            step = max(1, most // m)
            for start in own.tolist():
                for at in range(0, m, step):
                    i = np.arange(at, min(m, at + step))
                    a, b = np.repeat(i, m - 1 - i), np.concatenate([np.arange(x + 1, m) for x in i.tolist()])
                    yield start + a, start + b


def _candidates(table: pa.Table, edges: np.ndarray, least: float):
    """Pairs that are worth verifying, with the agreement of their signatures: of
    the cell's two sides, not both closed, near enough by the estimate, and met
    nowhere deeper nor in an earlier tree."""
    signature = _signatures_of(table)
    depth, tree, block, child, open_ = (table.column(c).to_numpy() for c in ("depth", "tree", "block", "child", "open"))
    one = table.column("low").to_numpy() == table.column("high").to_numpy()
    need = least * TREES * DEPTH
    for a, b in _all_pairs(edges):
        near = np.flatnonzero((one[a] | (block[a] != block[b])) & (open_[a] | open_[b]) & ((child[a] != child[b]) | (depth[a] == DEPTH)))
        a, b = a[near], b[near]
        same = signature[a] == signature[b]
        agreed = same.sum(axis=1)
        near = np.flatnonzero(agreed >= need)
        met = np.logical_and.accumulate(same[near].reshape(len(near), TREES, DEPTH), axis=2).sum(axis=2)
        here = (met.max(axis=1, initial=0) == depth[a[near]]) & (met.argmax(axis=1) == tree[a[near]]) if len(near) else np.zeros(0, dtype=bool)
        near = near[here]
        yield a[near], b[near], agreed[near] / (TREES * DEPTH)


def _meet(least: float, similarity: float):
    """Members of cells that have a pair there which is worth verifying; how many
    partners they seem to have (by the estimate), and how many those stand for at each depth."""

    def work(table: pa.Table, edges: np.ndarray):
        n = table.num_rows
        good, partners, unseen = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros((DEPTH, n))
        for a, b, agreed in _candidates(table, edges, least):
            good[a] = good[b] = True
            linked = agreed >= similarity
            for x in (a[linked], b[linked]):
                partners += np.bincount(x, minlength=n)
                for depth in range(1, DEPTH + 1):
                    unseen[depth - 1] += np.bincount(x, weights=unmet(agreed[linked], depth), minlength=n)
        out = table.append_column("partners", pa.array(partners))
        for name, values in zip(_UNSEEN, unseen, strict=True):
            out = out.append_column(name, pa.array(values))
        yield from out.filter(pa.array(good)).to_batches()

    return by_cell(work)


def _verify(least: float, similarity: float):
    """For every member of a cell that is linked there: documents linked to, and
    the smallest node of its part of the cell."""

    def work(table: pa.Table, edges: np.ndarray):
        n = table.num_rows
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        nodes, copies = table.column("node").to_pylist(), table.column("copies").to_numpy()
        links, root = np.zeros(n, dtype=np.int64), np.arange(n)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for left, right, _ in _candidates(table, edges, least):
            order = np.argsort(left, kind="stable")
            left, right = left[order], right[order]
            cuts = np.flatnonzero(np.diff(left)) + 1
            for a, partners in zip(left[np.concatenate([[0], cuts])].tolist() if len(left) else [], np.split(right, cuts), strict=False):
                theirs = np.concatenate([sets[b] for b in partners.tolist()])
                ends = np.cumsum(sizes[partners])
                hit = np.concatenate([[0], np.cumsum(member(sets[a], theirs))])
                shared = hit[ends] - hit[ends - sizes[partners]]
                linked = partners[shared >= similarity * (sizes[a] + sizes[partners] - shared) - 1e-9]
                links[a] += copies[linked].sum()
                links[linked] += copies[a]
                for b in linked.tolist():
                    x, y = find(a), find(b)
                    if x != y:
                        low, high = (x, y) if nodes[x] < nodes[y] else (y, x)
                        root[high] = low
        kept = np.flatnonzero(links).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in kept], pa.binary()), pa.array([nodes[find(x)] for x in kept], pa.binary()), pa.array(links[kept])], ["node", "top", "links"])

    return by_cell(work)


def _shingle_sets(batches):
    for batch in batches:
        out = []
        for part in slices(batch.column("text")):
            found = words(part)
            hashes, rows = shingles(found, len(part))
            edges = np.searchsorted(rows, np.arange(len(part) + 1))
            out += [np.unique(hashes[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for edges (node, top), top the smaller.

    Every round gives each node the smallest label next to it and then its
    label's label; a round that changes nothing is the last."""
    both = stored(edges.where("node <> top").select("node", "top").unionByName(edges.where("node <> top").select(F.col("top").alias("node"), F.col("node").alias("top"))).distinct())
    labels = stored(both.groupBy("node").agg(F.least(F.min("top"), F.col("node")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("top"), "root"), "top").groupBy("node").agg(F.min("root").alias("near"))
        first = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        first = stored(first)
        jump = first.join(first.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        after = stored(jump.select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "old"))
        released(first, labels)
        if after.where("root <> old").isEmpty():
            released(both)
            return after
        labels = after


_UNSEEN = [f"unseen_{depth}" for depth in range(1, DEPTH + 1)]
_MEMBER = "depth int, tree int, path bigint, low int, high int, block int, child bigint, open boolean, node binary, copies bigint, signature binary"


def _cells(placed: DataFrame, stand: DataFrame, state: DataFrame, depth: int, node_rows: int) -> DataFrame:
    """The members of the cells of one depth; placed: node, tree, path, child."""
    placed = placed.join(state.select("node", "open"), "node")
    held = placed.groupBy("tree", "path").agg(F.count("*").alias("held"), F.max("open").alias("live"), (F.min("child") != F.max("child")).alias("joins"))
    held = held.where("held > 1 AND live" + (" AND joins" if depth < DEPTH else ""))
    blocks = F.ceil(F.col("held") / node_rows).cast("int")
    member = placed.join(held.select("tree", "path", blocks.alias("blocks")), ["tree", "path"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("node", F.lit(depth).alias("depth"), "tree", "path", "child", "open", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return cells.join(stand.select("node", "copies", "signature"), "node").select(*[c.split()[0] for c in _MEMBER.split(", ")])


def _met(stand: DataFrame, similarity: float, target: float, node_rows: int) -> list[DataFrame]:
    """For each depth, the members of cells with pairs that are worth verifying."""
    least, closing = _estimated(similarity), closing_depth(similarity, target)
    kind = "node binary, tree int, paths array<bigint>"
    placed = stand.select("node", "signature").mapInArrow(_placed(closing, DEPTH), kind)
    shared = placed.groupBy("tree", F.element_at("paths", 1).alias("path")).agg(F.count("*").alias("n")).where("n > 1").select("tree", "path")
    near = stored(placed.join(shared, (placed["tree"] == shared["tree"]) & (F.element_at("paths", 1) == shared["path"]), "left_semi"))
    nothing = [F.lit(0).cast("bigint").alias("partners"), *[F.lit(0.0).alias(name) for name in _UNSEEN]]
    # a class that isn't here closes without a partner
    state = stored(near.select("node").distinct().select("node", F.lit(True).alias("open"), *nothing))
    out: list[DataFrame] = []
    for depth in range(DEPTH, 0, -1):
        if depth >= closing:
            here = near.select("node", "tree", F.element_at("paths", depth - closing + 1).alias("path"), F.element_at("paths", min(depth + 1, DEPTH) - closing + 1).alias("child"))
        else:
            before = stand.select("node", "signature").mapInArrow(_placed(depth, depth + 1), kind)
            here = before.select("node", "tree", F.element_at("paths", 1).alias("path"), F.element_at("paths", 2).alias("child"))
            state = state.unionByName(stand.join(state, "node", "left_anti").select("node", F.lit(False).alias("open"), *nothing))
        cells = _cells(here, stand, state, depth, node_rows)
        met = stored(cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_meet(least, similarity), f"{_MEMBER}, partners bigint, " + ", ".join(f"{name} double" for name in _UNSEEN)))
        out.append(met)
        if depth == 1:
            break
        sums = ("partners", *_UNSEEN)
        more = met.groupBy("node").agg(*[F.sum(name).alias(f"more_{name}") for name in sums])
        total = {name: F.col(name) + F.coalesce(f"more_{name}", F.lit(0)) for name in sums}
        again = total[_UNSEEN[depth - 1]] + float(unmet(similarity, depth)) > (1 - target) * (total["partners"] + 1)
        done, state = state, stored(state.join(more, "node", "left").select("node", (F.col("open") & again).alias("open"), *[c.alias(name) for name, c in total.items()]))
        released(done)
        if state.where("open").isEmpty():
            break
    released(near, state)
    return out


def _classified(df: DataFrame, id_column: str, text_column: str, similarity: float, target: float, node_rows: int) -> DataFrame:
    """id, key (a hash of the text), class_id, n_links for every row of df."""
    kind, least = df.schema[id_column].dataType.simpleString(), _estimated(similarity)
    rows = df.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("key"), text_bytes(text_column))
    signed = stored(rows.mapInArrow(_sign, f"id {kind}, key bigint, node binary, full boolean, signature binary"))
    classes = stored(signed.where("full").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least")))

    # a row with the smallest id stands for its class
    own = signed.where("full").join(classes, "node").where(F.col("id").eqNullSafe(F.col("least")))
    stand = stored(own.select("node", "id", "key", "copies", "signature").dropDuplicates(["node"]))
    by_depth = _met(stand, similarity, target, node_rows)
    met = by_depth[0]
    for more in by_depth[1:]:
        met = met.unionByName(more)

    wanted = met.select("node").distinct().join(stand.select("node", F.col("id").alias("id_"), F.col("key").alias("key_")), "node")
    texts = rows.join(wanted, (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_"))).select("node", "text")
    sets = stored(texts.mapInArrow(_shingle_sets, "node binary, shingles binary").dropDuplicates(["node"]))
    full = met.drop("partners", *_UNSEEN).join(sets, "node").repartition(*CELL).sortWithinPartitions(*CELL)
    verified = stored(full.mapInArrow(_verify(least, similarity), "node binary, top binary, links bigint"))
    released(stand, sets, *by_depth)

    roots = components(verified)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = classes.join(roots.select("node", "root"), "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = by_class.groupBy("root").agg(F.min("least").alias("class_id"))
    known = stored(by_class.join(ids, "root").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    released(verified, classes, roots)
    out = signed.select("id", "key", "node", "full").join(known, "node", "left")
    class_id = F.when(F.col("full"), F.col("class_id")).otherwise(F.col("id"))
    return out.select("id", "key", class_id.alias("class_id"), F.when(F.col("full"), F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, target: float = TARGET_RECALL, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, class_id, n_links for every row of df."""
    return _classified(df, id_column, text_column, similarity, target, node_rows).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, target: float = TARGET_RECALL, node_rows: int = NODE_ROWS) -> DataFrame:
    """df with one row of each class: that with the smallest id.  Of equal rows
    one stays; rows without an id, which nothing tells apart, all stay."""
    id_, key_ = fresh(df, "_id", "_key")
    found = stored(_classified(df, id_column, text_column, similarity, target, node_rows))
    gone = found.where(F.col("id") != F.col("class_id")).select(F.col("id").alias(id_), F.col("key").alias(key_)).distinct()
    same = (df[id_column] == F.col(id_)) & (F.xxhash64(df[text_column]) == F.col(key_))
    kept = df.join(gone, same, "left_anti")
    again = stored(found.where(F.col("id") == F.col("class_id")).groupBy(F.col("id").alias(id_), F.col("key").alias(key_)).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if again.isEmpty():
        return kept
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_column]))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op1_near_duplicates": op1_near_duplicates}

#: All pairs that share a shingle, by plain joins; the forest's recall makes its result the same.
ORACLES = {
    "op1_near_duplicates": r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
cls AS (SELECT w, min(doc_id) AS id, count(*) AS copies FROM doc WHERE len(w) > 0 GROUP BY w),
sh AS (SELECT DISTINCT id, array_to_string(w[k:k + 4], ' ') AS s FROM cls, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(k)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pair AS (SELECT a.id AS x, b.id AS y, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
link AS (SELECT x, y FROM pair JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE common >= 0.8 * (p.n + q.n - common) - 1e-9),
reach AS (SELECT id, id AS top FROM cls UNION SELECT reach.id, link.y FROM reach JOIN link ON link.x = reach.top),
root AS (SELECT id, min(top) AS class_id FROM reach GROUP BY id),
links AS (SELECT x AS id, sum(copies) AS n FROM link JOIN cls ON cls.id = y GROUP BY x)
SELECT doc_id, coalesce(root.class_id, doc_id) AS class_id, CAST(CASE WHEN len(doc.w) = 0 THEN 0 ELSE coalesce(links.n, 0) + copies - 1 END AS BIGINT) AS n_links
FROM doc LEFT JOIN cls ON cls.w = doc.w AND len(doc.w) > 0 LEFT JOIN root ON root.id = cls.id LEFT JOIN links ON links.id = cls.id
"""
}
