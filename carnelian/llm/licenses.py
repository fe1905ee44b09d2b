"""License scan: fuzzy search for short notices.

A notice of k allowed edits is split into k+1 pieces; an occurrence with at most
k edits holds one piece unchanged (pigeonhole), so exact search for the pieces
finds every candidate place.  The regex library's bounded-error matching then
verifies the stretch around it and gives the edits (in code points) and the span.

Texts are searched as folded words joined by single spaces, so punctuation,
ASCII case and line breaks never count as edits.  A match begins and ends with
whole words, and holds every word of up to SHORT characters of its notice as it
is, since an edit there makes another word (nc, nd, all, mit).  Of matches that
overlap, of any notices, the one with the fewest edits stays, then the longest,
then the first, so a notice never stands for a variant that is listed itself.

Defined cases: a null, empty or wordless text has no places, null first and
last word, empty labels and score 0.  Repeated rows come out repeated.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm.frames import documents, text_bytes
from carnelian.llm.text import FOLD, slices

#: Phrases that are looked for as they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices, folded, with their labels.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2.0", "licensed under the apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "released under the bsd license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "creative commons attribution"),
    ("cc-by", "licensed under cc by"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc-sa", "licensed under cc by nc sa"),
    ("cc-by-nc-nd", "licensed under cc by nc nd"),
    ("cc0", "waived all copyright and related or neighboring rights"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
    ("proprietary", "may not be reproduced without permission"),
)
#: One edit is allowed for so many characters of a notice, and so many at most.
CHARS_AN_EDIT, MOST_EDITS = 12, 4
#: Words of so many characters must stand as they are.
SHORT = 3


class Notice:
    def __init__(self, label: str, words: str):
        self.label, self.words = label, words
        self.edits = min(MOST_EDITS, max(1, len(words) // CHARS_AN_EDIT))
        cuts = [len(words) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.seeds = [(words[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.short = Counter(w for w in words.split() if len(w) <= SHORT)
        self.pattern = regex.compile(rf"(?<= )(?:{regex.escape(words)}){{e<={self.edits}}}(?= )", regex.BESTMATCH)

    def matches(self, joined: str) -> set[tuple[int, int, int]]:
        """(edits, start, end) in the joined words, which have a space at either end."""
        around = set()
        for seed, offset in self.seeds:
            at = joined.find(seed)
            while at >= 0:
                around.add(max(1, at - offset - self.edits))
                at = joined.find(seed, at + 1)
        found = set()
        for begin in around:
            m = self.pattern.search(joined, begin, begin + len(self.words) + 3 * self.edits + 1)
            if m and not (self.short - Counter(m.group().split())):
                found.add((sum(m.fuzzy_counts), *m.span()))
        return found


def apart(found: list[tuple]) -> list[tuple]:
    """Of (edits, -length, start, end, ...) those that overlap no better one, by start."""
    kept: list[tuple[int, int, tuple]] = []
    for x in sorted(found):
        start, end = x[2], x[3]
        k = bisect_right(kept, (start, 1 << 62))
        if (k == 0 or kept[k - 1][1] <= start) and (k == len(kept) or kept[k][0] >= end):
            kept.insert(k, (start, end, x))
    return [x for _, _, x in kept]


@lru_cache(maxsize=4)
def notices(table: tuple = NOTICES) -> tuple[Notice, ...]:
    return tuple(Notice(*row) for row in table)


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Places at which the phrase's words stand; joined has a space at either end."""
    needle, out = b" " + phrase + b" ", []
    at = joined.find(needle)
    while at >= 0:
        out.append(at)
        at = joined.find(needle, at + 1)
    return out


def scan_text(text: bytes, table: tuple[Notice, ...]) -> dict:
    """Places of the phrases, and the fuzzy matches as (label, first word, last word, edits)."""
    tokens = text.translate(FOLD).split()
    joined = b" " + b" ".join(tokens) + b" "
    base: dict[str, list[int]] = {}
    for phrase, label in PHRASES.items():
        if places := phrase_places(joined, phrase.encode()):
            # the number of a word is the number of spaces before it
            gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
            base.setdefault(label, []).extend(np.searchsorted(gaps, places).tolist())
    spans, best = [], 1.0 if base else 0.0
    wide = joined.decode("utf-8", "replace")
    found = [(edits, start - end, start, end, k) for k, notice in enumerate(table) for edits, start, end in notice.matches(wide)]
    if found:
        gaps = np.flatnonzero(np.frombuffer(wide.encode("utf-32-le"), dtype=np.uint32) == 32)
        for edits, _, start, end, k in apart(found):
            first, last = (int(x) - 1 for x in np.searchsorted(gaps, (start, end - 1), side="right"))
            spans.append({"label": table[k].label, "first_word": first, "last_word": last, "edits": edits})
            best = max(best, 1 - edits / len(table[k].words))
    return {"n_words": len(tokens), "base": base, "spans": spans, "score": best}


def scan_licenses(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", table: tuple = NOTICES) -> DataFrame:
    """One row for each row of df, in one scan without a shuffle; spans are in words from 0."""
    kind = df.schema[id_column].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]

    def run(batches):
        known = notices(table)
        for batch in batches:
            out = {name: [] for name, _ in fields}
            for part in slices(batch.column("text")):
                for r in range(len(part)):
                    found = scan_text(part.text(r), known)
                    places = [p for got in found["base"].values() for p in got]
                    base = sorted(found["base"])
                    row = (found["n_words"], len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *(s["label"] for s in found["spans"])})), found["score"], found["spans"])
                    for (name, _), value in zip(fields, row, strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(out[name], type_) for name, type_ in fields)], ["doc_id", *out])

    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first_word: bigint, last_word: bigint, edits: bigint>>"
    return df.select(F.col(id_column).alias("id"), text_bytes(text_column)).mapInArrow(run, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {"op3_license_scan": op3_license_scan}
