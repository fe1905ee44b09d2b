"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for every piece of a fixed public vocabulary
(its pieces of letters, of any length, and every single character seen).  The
probability of a word is the sum over all its segmentations into pieces, which
a forward pass gives; a text's log probability is the sum over its words.  The
pieces' probabilities are fitted by expectation-maximisation (forward-backward
over all segmentations) on all words of a bounded sample of labelled rows: for
each language, MOST_ROWS rows that come first by a hash of their id.

Pieces are found by walking a table of the hashes of their beginnings, so only
places where a piece can go on are looked at.  Texts are scored whole, and so
are words: a long word (a line of an unspaced script, say) goes through the
forward pass in stretches that hand on the sums at their last places.  Only in
learning is a word of more than LEARN_CHARS characters taken in parts.  Equal
words of a slice are scored once; a worker also remembers words across slices,
up to MEMO_WORDS.  The score of the answer is its posterior probability under
equal priors, with the log probabilities divided by the square root of the
number of words (words of a text are not independent).  Ties go to the language
that comes first by code point.

Defined cases: a null text, one without a letter, and any text where there is
nothing to learn from, are "und" with score 0.  Rows with a null language or a
null id are never learned from.  Rows repeated in the input come out repeated.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm.frames import broadcast, documents, first_by_hash, text_bytes
from carnelian.llm.text import _FOLDED, LOWER, PieceTable, Slice, byte_characters, codes_of, slices, words

VOCABULARY = "word_bpe_49k.json"
MOST_ROWS = 400
ROUNDS = 3
#: Expected count that every piece has besides what is seen.
PRIOR = 0.05
#: Log probability of a character that is in no piece.
UNKNOWN = -18.0
#: Characters that go through the forward pass at a time; longer words go in stretches.
BATCH_CHARS, STRETCH = 1 << 16, 1 << 12
LEARN_CHARS = 1 << 12
MEMO_WORDS = 400_000
UNDECIDED = "und"


@lru_cache(maxsize=2)
def pieces(name: str = VOCABULARY) -> tuple[str, ...]:
    """Lower-case pieces of letters from the public vocabulary, without marks of a word's end."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    byte_of = {c: b for b, c in byte_characters().items()}
    out = set()
    for entry in vocabulary:
        raw = entry.removesuffix("</w>")
        try:
            piece = bytes(byte_of[c] for c in raw).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if piece.isalpha() and len(piece) > 1:
            out.add(piece.lower())
    return tuple(sorted(out))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log of the sum of exp of the runs of rows that begin at starts."""
    top = np.maximum.reduceat(values, starts, axis=0)
    size = np.diff(np.append(starts, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, size, axis=0)), starts, axis=0))


class Lattice:
    """All segmentations of some words; place i of word w is the node first[w] + i."""

    def __init__(self, table: PieceTable, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        room = np.repeat(first + self.lengths, self.lengths) - np.arange(int(self.lengths.sum()))
        begin, size, self.piece = table.matches(codes_of(texts), room)
        word = np.searchsorted(first + self.lengths, begin, side="right")
        self.first, self.last = first + np.arange(len(texts)), first + np.arange(len(texts)) + self.lengths
        self.begin, self.end = begin + word, begin + word + size
        self.step = self.end - self.first[word]  # place at which a match ends
        self.n = int(self.lengths.sum()) + len(texts)

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """log sums [node, language] over the segmentations up to each node."""
        out = np.full((self.n, logs.shape[1]), -np.inf)
        out[self.first] = 0
        order = np.lexsort((self.end, self.step))
        for run in np.split(order, np.flatnonzero(np.diff(self.step[order])) + 1) if len(order) else []:
            ends = self.end[run]
            starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            out[ends[starts]] = _sums(out[self.begin[run]] + logs[self.piece[run]], starts)
        return out

    def expected(self, logs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces (one language) in weighted words."""
        alpha, beta = self.forward(logs[:, None])[:, 0], np.full(self.n, -np.inf)
        beta[self.last] = 0
        word = np.searchsorted(self.last, self.begin)
        place = self.begin - self.first[word]
        order = np.lexsort((self.begin, -place))
        for run in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
            begins = self.begin[run]
            starts = np.flatnonzero(np.concatenate([[True], begins[1:] != begins[:-1]]))
            beta[begins[starts]] = _sums((logs[self.piece[run]] + beta[self.end[run]])[:, None], starts)[:, 0]
        share = np.exp(alpha[self.begin] + logs[self.piece] + beta[self.end] - alpha[self.last][word])
        return np.bincount(self.piece, weights=share * weights[word], minlength=len(logs))


def _batches(texts: list[str], most: int = BATCH_CHARS):
    """(first, stop) of runs of texts with about most characters."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Model:
    """languages, and log probabilities [piece, language]; the last row is that of unknown characters."""

    def __init__(self, languages: list[str], table: PieceTable, logs: np.ndarray):
        self.languages, self.table = languages, table
        self.logs = np.vstack([logs, np.full((1, len(languages)), UNKNOWN)])

    def forward(self, texts: list[str], most: int = BATCH_CHARS, stretch: int = STRETCH) -> np.ndarray:
        """log probability [word, language], over all segmentations."""
        out = np.zeros((len(texts), len(self.languages)))
        # words of like length together, so that a pass has few empty steps
        order = sorted((i for i, t in enumerate(texts) if len(t) <= stretch), key=lambda i: len(texts[i]))
        ordered = [texts[i] for i in order]
        for a, b in _batches(ordered, most):
            lattice = Lattice(self.table, ordered[a:b])
            out[order[a:b]] = lattice.forward(self.logs)[lattice.last]
        for i, t in enumerate(texts):
            if len(t) > stretch:
                out[i] = self._long(codes_of([t]), stretch)
        return out

    def _long(self, codes: np.ndarray, stretch: int) -> np.ndarray:
        """The same for one word, in stretches: places hand their sums on to the ends of their pieces."""
        n, reach = len(codes), self.table.longest
        sums = np.full((stretch + reach + 1, len(self.languages)), -np.inf)
        sums[0] = 0
        for at in range(0, n, stretch):
            part = codes[at : at + stretch + reach]
            room = np.minimum(len(part) - np.arange(len(part)), reach)
            room[stretch:] = 0
            begin, size, piece = self.table.matches(part, room)
            order = np.lexsort((size, begin))
            begin, size, piece = begin[order], size[order], piece[order]
            edges = np.searchsorted(begin, np.arange(min(stretch, n - at) + 1)).tolist()
            for place, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                ends = place + size[x:y]
                sums[ends] = np.logaddexp(sums[ends], sums[place] + self.logs[piece[x:y]])
            if at + stretch >= n:
                return sums[n - at]
            sums[: reach + 1] = sums[stretch:].copy()
            sums[reach + 1 :] = -np.inf
        return sums[0]


def fold_words(text: str) -> list[str]:
    return text.encode().translate(bytes(LOWER[b] if _FOLDED[b] and not 48 <= b <= 57 else 32 for b in range(256))).decode().split(" ")


def fit(counts: dict[str, dict[str, int]], vocabulary: tuple[str, ...], rounds: int = ROUNDS) -> Model | None:
    """counts: by language, how often each word stands in the sample."""
    languages = sorted(k for k, v in counts.items() if v)
    if not languages:
        return None
    characters = {c for by_word in counts.values() for w in by_word for c in w}
    known = sorted({*vocabulary, *characters})
    sizes = np.array([len(p) for p in known])
    start = -3.0 * sizes**0.5 - np.log(len(known))
    model = Model(languages, PieceTable(known), np.repeat(start[:, None], len(languages), axis=1))
    for k, language in enumerate(languages):
        flat: dict[str, int] = {}
        for w, c in counts[language].items():
            for i in range(0, len(w), LEARN_CHARS):
                part = w[i : i + LEARN_CHARS]
                flat[part] = flat.get(part, 0) + c
        texts = sorted(flat, key=len)
        weights = np.array([flat[t] for t in texts], dtype=float)
        for _ in range(rounds):
            seen = np.zeros(len(known) + 1)
            for a, b in _batches(texts):
                seen += Lattice(model.table, texts[a:b]).expected(model.logs[:, k], weights[a:b])
            seen = seen[:-1] + PRIOR
            model.logs[:-1, k] = np.log(seen / seen.sum())
    return model


def sample_counts(df: DataFrame, id_column: str, text_column: str, lang_column: str, learn, most_rows: int = MOST_ROWS) -> dict[str, dict[str, int]]:
    """Word counts by language from the bounded sample of rows where learn holds.

    The rows are chosen by id and language alone; only then are texts read, whole."""
    rows = df.where(learn & F.col(lang_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(lang_column).alias("group")).distinct()
    chosen = first_by_hash(rows, most_rows).select("id", F.col("group").alias("lang"))
    texts = df.where(learn).select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("t")).join(F.broadcast(chosen), ["id", "lang"], "left_semi")
    # of the copies of a row one is read, so that what is learned from is bounded as the rows are
    texts = texts.groupBy("id", "lang").agg(F.min("t").alias("t"))
    split = F.split(F.regexp_replace(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x60\x7B-\x7F]+", " "), " ")
    counted = texts.select("lang", F.explode(split).alias("w")).where(F.col("w") != "").groupBy("lang", "w").agg(F.count("*").alias("n")).toArrow()
    out: dict[str, dict[str, int]] = {}
    for lang, w, n in zip(*(counted.column(c).to_pylist() for c in ("lang", "w", "n")), strict=True):
        out.setdefault(lang, {})[w] = n
    return {lang: dict(sorted(found.items())) for lang, found in out.items()}


class Scorer:
    """Scores slices; remembers the words of earlier ones by their hash."""

    def __init__(self, model: Model):
        self.model = model
        self.known = np.zeros(0, dtype=np.uint64)
        self.scores = np.zeros((0, len(model.languages)))

    def words(self, part: Slice, found, keep: np.ndarray) -> np.ndarray:
        """log probabilities [word, language] of the words where keep holds."""
        hashes = found.hashes[keep]
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        old = np.zeros(len(distinct), dtype=bool)
        if len(self.known):
            old = self.known[np.minimum(at, len(self.known) - 1)] == distinct
        out = np.zeros((len(distinct), len(self.model.languages)))
        out[old] = self.scores[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            starts, ends = found.starts[keep][first[new]], found.ends[keep][first[new]]
            text = part.buf.tobytes()
            texts = [text[a:b].translate(_LETTERS).decode("utf-8", "replace").replace(" ", "") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            out[new] = self.model.forward(texts)
            self._remember(distinct[new], out[new])
        return out[which]

    def _remember(self, hashes: np.ndarray, scores: np.ndarray) -> None:
        if len(self.known) + len(hashes) > MEMO_WORDS:
            self.known, self.scores = self.known[:0], self.scores[:0]
        if len(hashes) <= MEMO_WORDS:
            known = np.concatenate([self.known, hashes])
            order = np.argsort(known)
            self.known, self.scores = known[order], np.concatenate([self.scores, scores])[order]

    def rows(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(language number or -1, posterior) of every row."""
        found, n = words(part), len(part)
        lettered = _has_letter(part, found)
        keep = lettered[found.rows] if len(found.rows) else np.zeros(0, dtype=bool)
        logs, rows = self.words(part, found, keep), found.rows[keep]
        total = np.stack([np.bincount(rows, weights=logs[:, k], minlength=n) for k in range(len(self.model.languages))], axis=1)
        size = np.maximum(1, np.bincount(rows, minlength=n))[:, None]
        scaled = (total - total.max(axis=1, keepdims=True)) / np.sqrt(size)
        odds = np.exp(scaled)
        best = np.argmax(total, axis=1)
        score = odds[np.arange(n), best] / odds.sum(axis=1)
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


_LETTERS = bytes(LOWER[b] if _FOLDED[b] and not 48 <= b <= 57 else 32 for b in range(256))


def _has_letter(part: Slice, found) -> np.ndarray:
    """Rows with an ASCII letter; of the others those where a character is a letter."""
    ascii_letter = np.zeros(256, dtype=bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    sums = np.concatenate([[0], np.cumsum(ascii_letter[part.buf])])
    out = sums[part.offsets[1:]] > sums[part.offsets[:-1]]
    for r in np.flatnonzero(~out & (part.offsets[1:] > part.offsets[:-1])).tolist():
        out[r] = any(c.isalpha() for c in part.text(r).decode("utf-8", "replace"))
    return out


def learn_model(df: DataFrame, learn, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", vocabulary: tuple[str, ...] | None = None) -> Model | None:
    """learn: a condition on the rows to learn from."""
    return fit(sample_counts(df, id_column, text_column, lang_column, learn), vocabulary or pieces())


def not_held_out(id_column: str, folds: int = 3, fold: int = 1):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds != fold


def identify(df: DataFrame, model: Model | None, columns: list, schema: str, text_column: str = "text") -> DataFrame:
    """The columns given, lang_pred and score for every row of df, in one scan without a shuffle."""
    sent = broadcast(df.sparkSession, model)
    n = len(columns)

    def run(batches):
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            names, scores = [], []
            for part in slices(batch.column(n)):
                if scorer is None:
                    names += [UNDECIDED] * len(part)
                    scores += [0.0] * len(part)
                    continue
                best, score = scorer.rows(part)
                names += [scorer.model.languages[b] if b >= 0 else UNDECIDED for b in best.tolist()]
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:n], "lang_pred", "score"])

    return df.select(*columns, F.col(text_column).cast("binary").alias("_text")).mapInArrow(run, f"{schema}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    learn = not_held_out("doc_id")
    return identify(df, learn_model(df, learn), [F.col("doc_id"), F.coalesce(~learn, F.lit(False)).alias("held_out")], "doc_id bigint, held_out boolean")


QUERIES = {"op10_language_id": op10_language_id}
