"""License scans: exact phrases, and fuzzy search for short notices.

A text becomes a stream of lower-case words parted by one space. A notice that may hold k errors is split into k + 1
pieces; whatever k edits do, one piece stands unharmed, so an automaton over all pieces finds every place where a notice
can be. The window around such a place is then searched by the regex library with at most k errors, which reports the span.
The words that tell licences apart must stand as they are (a long one with one error); the other errors lie elsewhere.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame

from basaltic.llm.common import map_batches, texts_of, tool

# The base phrases and their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Notices that the method looks for, as streams of words, their labels, and the words that tell a licence from its rivals.
NOTICES = [
    ("under the gnu general public license", "gpl", "gnu general"),
    ("gnu lesser general public license", "lgpl", "lesser"),
    ("gnu affero general public license", "agpl", "affero"),
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ""),
    ("redistribution and use in source and binary forms with or without modification", "bsd", ""),
    ("subject to the terms of the mozilla public license", "mpl", "mozilla"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("creative commons attribution 4 0 international", "cc-by", "attribution 4 0 international"),
    ("creative commons attribution noncommercial", "cc-by-nc", "noncommercial"),
    ("this is free and unencumbered software released into the public domain", "unlicense", ""),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", ""),
    ("eclipse public license", "epl", "eclipse"),
]

#: Characters of a notice for each error that it may hold; letters of a telling word from which on it may hold one of these.
CHARS_PER_ERROR, LONG_WORD = 10, 6
#: Windows whose finds a worker remembers.
MEMO = 50_000

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def segments(notice: str, telling: str, errors: int) -> list[tuple[str, int]]:
    """A notice in parts, each with the errors that it may hold: none in a short telling word and the spaces round it, one in a long
    one, as many as the notice elsewhere."""
    words, tells = notice.split(), set(telling.split())
    out: list[tuple[str, int]] = []
    for i, word in enumerate(words):
        most = errors if word not in tells else 0 if len(word) < LONG_WORD else 1
        for part, bound in ((" ", 0 if word in tells or (i and words[i - 1] in tells) else errors), (word, most)):
            if part == " " and not i and word not in tells:
                continue
            if out and out[-1][1] == bound == errors or out and out[-1][1] == bound == 0:
                out[-1] = (out[-1][0] + part, bound)
            else:
                out.append((part, bound))
    return [*out, (" ", 0)] if words[-1] in tells else out


class NoticeFinder:
    """All phrases and the seeds of all notices in one automaton.

    Hits of a notice's seeds that mean nearly the same place share a window, whose length is bounded by the notice's. A window is
    searched only if it holds the telling words, or half of a long one, and enough of the notice's trigrams; so a text costs time in proportion to its length."""

    def __init__(self, phrases: list[tuple[str, str]], notices: list[tuple[str, str, str]], per_error: int):
        import ahocorasick
        import regex

        self.notices, self.grams = [], []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (text, label, telling) in enumerate(notices):
            k, n = max(1, len(text) // per_error), len(text)
            parts = segments(text, telling, k)
            spelled = "".join(regex.escape(part, literal_spaces=True) if not most else f"(?:{regex.escape(part, literal_spaces=True)}){{e<={most}}}" for part, most in parts)
            must = [[part] if not most else [part[: len(part) // 2], part[len(part) // 2 :]] for part, most in parts if most < k or not most]
            self.notices.append((text, label, k, regex.compile(f"(?b){spelled}"), must))
            self.grams.append([text[i : i + 3] for i in range(n - 2)])
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((number, a))
        self.labels = [label for _, label in phrases]
        for number, (text, _) in enumerate(phrases):
            seeds.setdefault(f" {text} ", []).append((-1 - number, 0))
        self.machine = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.machine.add_word(seed, (len(seed), uses))
        self.machine.make_automaton()
        self.memo: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def _verified(self, number: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, errors) of the best match in a window."""
        _, _, k, pattern, must = self.notices[number]
        if not all(any(half in window for half in word) for word in must):
            return None
        # an error takes three trigrams at the most
        if sum(map(window.__contains__, self.grams[number])) < len(self.grams[number]) - 3 * k:
            return None
        key = (number, window)
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            m = pattern.search(window)
            errors = sum(m.fuzzy_counts) if m else 0
            self.memo[key] = (m.start(), m.end(), errors) if m and errors <= k else None
        return self.memo[key]

    def _of_notice(self, number: int, starts: list[int], stream: str) -> list[tuple[int, int, int]]:
        """The finds of one notice that do not overlap, those with the fewest errors first in choice, then the leftmost."""
        text, _, k, _, _ = self.notices[number]
        found, at = set(), 0
        starts.sort()
        while at < len(starts):
            to = bisect.bisect_right(starts, starts[at] + k)
            lo = max(0, starts[at] - k - 1)
            if (got := self._verified(number, stream[lo : starts[to - 1] + len(text) + k + 1])) is not None:
                found.add((got[2], lo + got[0], lo + got[1]))
            at = to
        kept: list[tuple[int, int, int]] = []
        for errors, a, b in sorted(found):
            i = bisect.bisect(kept, (a,))
            if (i == len(kept) or kept[i][0] >= b) and (not i or kept[i - 1][1] <= a):
                kept.insert(i, (a, b, errors))
        return kept

    def find(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int, float]]]:
        """(words, base places as (word, label), fuzzy finds as (first word, last word, label, errors, similarity))."""
        words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
        stream = f" {b' '.join(words).decode('latin-1')} "
        places: list[tuple[int, str]] = []
        starts: dict[int, list[int]] = {}
        for end, (length, uses) in self.machine.iter(stream):
            at = end - length + 1
            for number, offset in uses:
                if number < 0:
                    places.append((at, self.labels[-1 - number]))
                else:
                    starts.setdefault(number, []).append(at - offset)
        finds = []
        for number, hits in starts.items():
            notice, label = self.notices[number][:2]
            for a, b, errors in self._of_notice(number, hits, stream):
                finds.append((a + (stream[a] == " "), b - (stream[b - 1] == " "), label, errors, 1 - errors / len(notice)))
        # places of characters to numbers of words: the spaces before them
        marks = sorted({p for p, _ in places} | {x for a, b, *_ in finds for x in (a, b)})
        word_at, seen, count = {}, 0, 0
        for p in marks:
            count += stream.count(" ", seen, p)
            seen = p
            word_at[p] = count
        last = max(0, len(words) - 1)
        spans = [(min(last, max(0, word_at[a] - 1)), min(last, max(0, word_at[b] - 1)), label, errors, like) for a, b, label, errors, like in finds]
        return len(words), sorted((word_at[p], label) for p, label in places), sorted(spans)


def license_scan(docs: DataFrame, phrases=BASE_PHRASES, notices=NOTICES, per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """Of every whole text: doc_id, n_words, n_base (all places of base phrases), first_word and last_word (their smallest
    and largest first word), base_labels, labels (with those of fuzzy notices), score (the best similarity, 1 for a base
    phrase, 0 without a find) and spans, the fuzzy finds as label:first word:last word:errors.

    Labels are distinct, sorted and joined by commas. A null text counts as empty: no words, null places, empty labels,
    score 0. Repeated rows each get a row; other columns are left out. Narrow: no shuffle.
    """

    def make():
        finder = tool(NoticeFinder, tuple(phrases), tuple(notices), per_error)

        def row(text: str) -> tuple:
            n, places, finds = finder.find(text)
            own = {label for _, label in places}
            return (
                n,
                len(places),
                places[0][0] if places else None,
                places[-1][0] if places else None,
                ",".join(sorted(own)),
                ",".join(sorted(own | {f[2] for f in finds})),
                1.0 if places else max((f[4] for f in finds), default=0.0),
                ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e, _ in finds),
            )

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            columns = zip(*map(row, texts_of(batch)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

        return one

    return map_batches(
        docs.select("doc_id", "text"),
        make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string",
    )
