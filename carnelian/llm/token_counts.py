"""Token counts: the exact count at every prefix of a text.

A text is parted into chunks (runs of anything but ASCII white space), which
the word tokenizer never joins, and a chunk into the tokenizer's pre-tokens.
Within a pre-token a dynamic programme over its bytes gives the last token and
the number of tokens of every prefix: a sequence of tokens is what pair merging
makes of its bytes if and only if that holds for each two neighbours, so the
last token of a prefix is the one vocabulary entry which ends there and can
stand beside the last token of what is before it.  A prefix of a text ends a
word, so its last token is one with the mark of a word's end, beside the last
unmarked token of what is before.  Whether two tokens can stand side by side is
read from their merges: no merge across the border may come before those that
made the tokens.

The counts of a chunk at each of its characters are made once in a worker for
each distinct chunk.  A text's table is the running sum over its chunks and the
counts inside them; the number of tokens, whether a budget is kept, and where a
text has to be cut to keep it are all read from that table, without encoding.
Chunks of plain Latin text are in normal form as they are, and only their case
is folded.  The last count of any other distinct chunk is held against the
library's encoding, and one where they differ (as unstable normalisation may
make them) has its prefixes encoded by the library instead.

Defined cases: a null or empty text has 0 tokens and 0 bytes.  Rows repeated in
the input come out repeated.  Special strings inside a text are treated as the
library treats them by default: as one token each; a part of one is plain text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm.frames import documents, map_batches, text_bytes
from carnelian.llm.text import PieceTable, byte_characters, mix, slices

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Chunks that a worker remembers, and the longest such chunk in bytes.
MEMO_CHUNKS, MEMO_BYTES = 400_000, 64
#: Bits of the table of token pairs that a worker remembers.
PAIR_BITS = 22
#: Longer pre-tokens (in bytes) go through the programme one by one, others in batches of so many bytes.
LONG, BATCH = 128, 1 << 18
_END = "</w>"
#: The tokenizer's pre-tokens.  These texts are as they were when parted and in normal form, but for their case.
_SIMPLE = re.compile(r"[\x00-\x1b!-~\xa1-\u012f\u0131-\u024f]+")
_ODD = re.compile(r"[\x1c-\x1f]")
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_CONTRACTIONS = {"'re": (1, 2), "'ve": (1, 2), "'ll": (1, 2), "'s": (1,), "'t": (1,), "'m": (1,), "'d": (1,)}
#: A character with the marks or vowel and tail jamo after it.
_CLUSTER = regex.compile(r"(?s).[\p{M}\u1160-\u11FF]*")
_FOREVER = 1 << 60


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """The vocabulary of a pair-merging tokenizer, and which tokens can stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.inside: dict[str, int] = {}  # entries within a word, and those that end one, by their characters
        self.ending: dict[str, int] = {}
        for entry, number in model["vocab"].items():
            if entry.endswith(_END) and entry != _END:
                self.ending[entry.removesuffix(_END)] = number
            else:
                self.inside[entry] = number
        self.longest = max(map(len, (*self.inside, *self.ending)), default=1)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = model["vocab"][left], model["vocab"][right]
            self.rank[pair] = k
            self.parts.setdefault(model["vocab"][left + right], pair)
        self.spines: tuple[dict, dict] = ({}, {})
        self.whole: dict[int, bool] = {}
        known = sorted({*self.inside, *self.ending})
        self.table = PieceTable(known)
        self.tokens = np.array([[entries.get(k, -1) for k in known] for entries in (self.inside, self.ending)], dtype=np.int64)
        codes = byte_characters()
        self.codes = np.array([ord(codes[b]) for b in range(256)], dtype=np.uint32)
        self.letters = codes
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the token's left (0) or right (1) border while it is made: (part, rank at which it is used up)."""
        out = self.spines[side].get(token)
        if out is None:
            out, at, used = [], token, _FOREVER
            while True:
                out.append((at, used))
                if at not in self.parts:
                    break
                used, at = self.rank[self.parts[at]], self.parts[at][side]
            self.spines[side][token] = out
        return out

    def _crossed(self, left: int, right: int, least: int = _FOREVER) -> bool:
        """Whether a merge across the border comes first; of equal ranks the one further left does."""
        for y, used_y in self._spine(right, 0):
            for x, used_x in self._spine(left, 1):
                rank = self.rank.get((x, y))
                if rank is not None and rank < used_x and rank <= used_y and rank < least:
                    return True
        return False

    def own(self, token: int) -> bool:
        """Whether merging the token's characters gives the token."""
        out = self.whole.get(token)
        if out is None:
            pair = self.parts.get(token)
            out = self.whole[token] = pair is None or (self.own(pair[0]) and self.own(pair[1]) and not self._crossed(*pair, self.rank[pair]))
        return out

    def beside(self, left: int, right: int) -> bool:
        """Whether right can follow left; -1: nothing is before it."""
        return self.own(right) and (left < 0 or not self._crossed(left, right))

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """beside() of many pairs; those that the table holds aren't worked out again."""
        keys = (left + 1) << 32 | right
        at = (mix(keys.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_fits[at]
        new = np.flatnonzero(self.pair_keys[at] != keys)
        if len(new):
            distinct, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
            found = np.array([self.beside(x, y) for x, y in zip(left[new[first]].tolist(), right[new[first]].tolist(), strict=True)], dtype=bool)
            self.pair_keys[at[new[first]]], self.pair_fits[at[new[first]]] = distinct, found
            # of two pairs in one place the table keeps one; key and answer are written in the same order
            out[new] = found[which]
        return out

    def prefixes(self, words: list[bytes]) -> list[list[int]]:
        """For each word, the numbers of tokens of the words that are its first bytes, from one byte on."""
        out: list = [None] * len(words)
        order = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            stop = min(len(order), at + max(1, BATCH // max(1, len(words[order[min(len(order) - 1, at + BATCH // 8)]]))))
            for i, row in zip(order[at:stop], self._batch([words[i] for i in order[at:stop]]), strict=True):
                out[i] = row
            at = stop
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._single("".join(self.letters[b] for b in w))
        return out

    def _single(self, word: str) -> list[int]:
        last, count, out = [-1], [0], []
        for end in range(1, len(word) + 1):
            for entries in (self.ending, self.inside):
                for begin in range(max(0, end - self.longest), end):
                    token = entries.get(word[begin:end])
                    if token is not None and self.beside(last[begin], token):
                        break
                else:
                    raise ValueError("no token ends here")
                if entries is self.ending:
                    out.append(count[begin] + 1)
                else:
                    last.append(token)
                    count.append(count[begin] + 1)
        return out

    def _batch(self, words: list[bytes]) -> list[list[int]]:
        """The same for many words at once; node first[w] + n is the n-th place of word w."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        n = int(lengths.sum())
        codes = self.codes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        stops = np.cumsum(lengths)
        room = np.repeat(stops, lengths) - np.arange(n)
        begin, size, piece = self.table.matches(codes, room)
        word = np.repeat(np.arange(len(words)), lengths)[begin]
        begin = begin + word
        first = stops - lengths + np.arange(len(words))
        place = begin + size - first[word]
        last, count, ends = np.full(n + len(words), -1, dtype=np.int64), np.zeros(n + len(words), dtype=np.int64), np.zeros(n + len(words), dtype=np.int64)
        # by place, then word, then the longest first: sizes come in order, and of one size the nodes
        order = np.arange(len(begin))[::-1]
        order = order[np.argsort((begin + size)[order], kind="stable")]
        order = order[np.argsort(place[order].astype(np.uint8), kind="stable")]
        begin, size, piece, place = begin[order], size[order], piece[order], place[order]
        edges = np.searchsorted(place, np.arange(1, int(lengths.max(initial=0)) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for kind in (1, 0):
                token = self.tokens[kind, piece[a:b]]
                there = np.flatnonzero(token >= 0)
                token, before, node = token[there], begin[a:b][there], (begin[a:b] + size[a:b])[there]
                # of a word's candidates the longest is tried first
                while len(node):
                    head = np.concatenate([[True], node[1:] != node[:-1]])
                    good = self.fits(last[before[head]], token[head])
                    done, tried = node[head][good], np.flatnonzero(head)[good]
                    if kind:
                        ends[done] = count[before[tried]] + 1
                    else:
                        last[done], count[done] = token[tried], count[before[tried]] + 1
                    left = ~head & ~np.repeat(good, np.diff(np.append(np.flatnonzero(head), len(node))))
                    token, before, node = token[left], before[left], node[left]
        listed = ends.tolist()
        return [listed[x + 1 : x + 1 + len(w)] for x, w in zip(first.tolist(), words, strict=True)]


class Counter:
    """Counts at every character of chunks, remembered; the memory is emptied when it is full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.merges = Merges(path)
        special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.memo: dict[bytes, bytes] = {}
        self.words: dict[str, list[int]] = {}
        self.folded: dict[str, str] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.encoder.encode_batch(texts, add_special_tokens=False)]

    def of(self, chunks: list[bytes]) -> list:
        """The counts of each chunk at its characters, from 0 on."""
        memo = self.memo
        missing = [c for c in set(chunks) if c not in memo]
        if not missing:
            return [memo[c] for c in chunks]
        if len(memo) + len(missing) > MEMO_CHUNKS:
            memo = self.memo = {}
            missing = list(set(chunks))
        texts = [c.decode("utf-8", "replace") for c in missing]
        new = dict(zip(missing, self._checked(texts, self.programme(texts)), strict=True))
        if len(missing) <= MEMO_CHUNKS:
            memo.update((c, rows) for c, rows in new.items() if len(c) <= MEMO_BYTES)
        return [new[c] if c in new else memo[c] for c in chunks]

    def _checked(self, texts: list[str], rows: list) -> list:
        odd = [k for k, t in enumerate(texts) if rows[k] is None or self._split(t) is None]
        for k, total in zip(odd, self.encode([texts[k] for k in odd]), strict=True):
            if rows[k] is None or rows[k][-1] != total:
                rows[k] = [0, *self.encode([texts[k][:n] for n in range(1, len(texts[k]) + 1)])]
        return [bytes(r) if r[-1] < 256 else array("l", r) for r in rows]

    def programme(self, texts: list[str]) -> list[list[int] | None]:
        """The counts of chunks by the dynamic programme; None if a normal form isn't made from its clusters of characters one by one."""
        plain = [self._split(t) for t in texts]
        every = {w for parts in plain if parts for w in parts}
        need = every.difference(self.words)
        if len(self.words) + len(need) > MEMO_CHUNKS:
            self.words = {}
            need = every
        listed = list(need)
        self.words.update(zip(listed, map(self._at_characters, listed, self.merges.prefixes([w.encode() for w in listed])), strict=True))
        out = [self._simple(parts) if parts is not None else self._with_special(t) for t, parts in zip(texts, plain, strict=True)]
        if len(self.words) > MEMO_CHUNKS:
            self.words = {}
        return out

    def _split(self, text: str) -> list[str] | None:
        """The pre-tokens, if the text is simple; they leave nothing out."""
        if "<|" in text:
            return None
        if text.isascii():
            text = text.lower()
            return [text] if text.isalpha() else None if _ODD.search(text) else _ASCII_PARTS.findall(text)
        return _PARTS.findall(text.lower()) if _SIMPLE.fullmatch(text) else None

    @staticmethod
    def _at_characters(word: str, counts: list[int]) -> list[int]:
        if word in _CONTRACTIONS:
            return [*_CONTRACTIONS[word], counts[-1]]
        if word.isascii():
            return counts
        ends = accumulate(len(c.encode()) for c in word)
        return [counts[k - 1] for k in ends]

    def _simple(self, parts: list) -> list[int]:
        if len(parts) == 1:
            return [0, *self.words[parts[0]]]
        out, base = [0], 0
        for word in parts:
            out += [base + n for n in self.words[word]]
            base = out[-1]
        return out

    def _word(self, word: str) -> list[int]:
        if word not in self.words:
            self.words[word] = self._at_characters(word, self.merges.prefixes([word.encode()])[0])
        return self.words[word]

    def _with_special(self, text: str) -> list[int] | None:
        out, at = [0], 0
        for found in self.special.finditer(text):
            before, name = text[at : found.start()], found.group()
            rows = self._normal(before + name[:-1])
            if rows is None:
                return None
            out += [out[-1] + n for n in rows]
            out.append(out[-len(name)] + 1)
            at = found.end()
        rows = self._normal(text[at:])
        return None if rows is None else [*out, *(out[-1] + n for n in rows)]

    def _normal(self, text: str) -> list[int] | None:
        """The counts at each character of a text without special strings, from the first on."""
        # characters that normal forms may join: a base and the marks after it
        clusters = _CLUSTER.findall(text)
        folded = [self._fold(c) for c in clusters]
        folded = ["" if k and c == " " == folded[k - 1] else c for k, c in enumerate(folded)]
        normal = self.encoder.normalizer.normalize_str(text)
        if "".join(folded) != normal:
            return None
        rows, starts, at = [0] * (len(normal) + 1), [0] * (len(normal) + 1), 0
        for _, (begin, end) in self.encoder.pre_tokenizer.pre_tokenize_str(normal):
            rows[at + 1 : begin + 1] = [rows[at]] * (begin - at)
            starts[at + 1 : begin + 1] = range(at, begin)
            rows[begin + 1 : end + 1] = [rows[begin] + n for n in self._word(normal[begin:end])]
            starts[begin + 1 : end + 1] = [begin] * (end - begin)
            at = end
        rows[at + 1 :] = [rows[at]] * (len(normal) - at)
        starts[at + 1 :] = range(at, len(normal))
        out, place, inside = [], 0, []
        for cluster, form in zip(clusters, folded, strict=True):
            # within a cluster: the pre-token before it, with an apostrophe that may yet be a contraction's, and the part of it
            first = starts[place]
            first = starts[first] if normal[first - 1 : first] == "'" else first
            for n in range(1, len(cluster)):
                inside.append((len(out), rows[first], normal[first:place] + cluster[:n]))
                out.append(0)
            place += len(form)
            out.append(rows[place])
        for (k, before, _), n in zip(inside, self.encode([t for _, _, t in inside]), strict=True):
            out[k] = before + n
        return out

    def _fold(self, cluster: str) -> str:
        out = self.folded.get(cluster)
        if out is None:
            out = self.encoder.normalizer.normalize_str(cluster)
            if len(self.folded) < MEMO_CHUNKS:
                self.folded[cluster] = out
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One per worker process and vocabulary."""
    return Counter(path)


class PrefixTable:
    """Counts at every prefix of one text; answers budgets without encoding it again."""

    def __init__(self, data: bytes, chunks: list[bytes], rows: list):
        """rows: the counts at each character of the chunks, from 0 on."""
        self.data, self.chunks, self.rows = data, chunks, rows
        self.totals = [0, *accumulate(r[-1] for r in rows)]

    @classmethod
    def of(cls, text: str | None, path: str | None = None) -> PrefixTable:
        data = (text or "").encode()
        chunks = data.split()
        return cls(data, chunks, counter(path or vocabulary_path()).of(chunks))

    def _places(self) -> Iterator[tuple[int, bytes, list, int]]:
        """(first byte, chunk, its counts, tokens before it) of each chunk."""
        at = 0
        for chunk, rows, before in zip(self.chunks, self.rows, self.totals, strict=False):
            at = self.data.index(chunk, at)
            yield at, chunk, rows, before
            at += len(chunk)

    def count(self, n_bytes: int | None = None) -> int:
        """Tokens of the first n_bytes (to a character's end); of the whole text by default."""
        if n_bytes is None or n_bytes >= len(self.data):
            return self.totals[-1]
        last = 0
        for at, chunk, rows, before in self._places():
            if at >= n_bytes:
                return before
            if at + len(chunk) > n_bytes:
                return before + rows[len(chunk[: n_bytes - at].decode("utf-8", "ignore"))]
            last = before + rows[-1]
        return last

    def counts(self) -> list[int]:
        """The count at every character of the text, from 0 on."""
        out, done = [0], 0
        for at, chunk, rows, before in self._places():
            out += [before] * len(self.data[done:at].decode())
            out += [before + n for n in rows[1:]]
            done = at + len(chunk)
        return out + [self.totals[-1]] * len(self.data[done:].decode())

    def cut(self, budget: int) -> int:
        """Bytes of the longest prefix, to a character's end, of at most budget tokens
        among the prefixes that end before the first chunk which breaks it or inside that chunk."""
        if self.totals[-1] <= budget:
            return len(self.data)
        for at, chunk, rows, before in self._places():
            if before + rows[-1] > budget:
                fits = max(n for n, c in enumerate(rows) if before + c <= budget)
                return at + len(chunk.decode()[:fits].encode())
        return len(self.data)


def _tables(batch: pa.RecordBatch, path: str) -> Iterator[PrefixTable]:
    count = counter(path)
    for part in slices(batch.column("text")):
        texts = [part.text(r) for r in range(len(part))]
        chunks = [t.split() for t in texts]
        flat, at = count.of([c for row in chunks for c in row]), 0
        for text, row in zip(texts, chunks, strict=True):
            yield PrefixTable(text, row, flat[at : at + len(row)])
            at += len(row)


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, limit_bytes (what is kept of the text within
    the limit) for every row, read from its table, in one scan without a shuffle."""
    path = path or vocabulary_path()
    kind = df.schema[id_column].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(len(t.data), t.count(), t.cut(limit)) for t in _tables(batch, path)]
        n_bytes, tokens, kept = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([k < n for k, n in zip(kept, n_bytes, strict=True)], pa.bool_()), pa.array(kept, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"])

    return map_batches(df, [F.col(id_column).alias("id"), text_bytes(text_column)], f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_bytes bigint", work)


def prefix_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """id and the count at every character of the text, from 0 on, for every row."""
    path = path or vocabulary_path()
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row, table in enumerate(_tables(batch, path)):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, 1), pa.array([table.counts()], pa.list_(pa.int32()))], ["doc_id", "counts"])

    return df.select(F.col(id_column).alias("id"), text_bytes(text_column)).mapInArrow(run, f"doc_id {kind}, counts array<int>")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


QUERIES = {"op9_token_counts": op9_token_counts}
