"""Secret scans over a trigram inverted index.

Each rule's pattern is parsed, and a Boolean query over trigrams is derived that every match satisfies. A batch of texts
gets an index of the trigrams that the queries name: postings of text numbers, found in one vectorised pass. Postings are
intersected and united as each query says, and only the candidates are searched with the rule's pattern. A rule without
mandatory trigrams is searched for in every text.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basaltic.llm.common import SLICE_CHARS, map_batches, texts_of, tool

# The base rules, in the order in which kinds are listed: kind, pattern, the group and the least characters of it.
BASE_RULES = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]

# A private key runs to the END line of its label. Where none comes before the next marker, it takes what is on the header's
# line in the form of base64, the headers of an encrypted key, and the lines of base64. Line breaks may be escaped ones. No part
# gives back what it took, and none looks beyond the next marker, so the search is linear.
_BREAK, _LEAD = r"(?:\r?\n|\r|(?:\\r)?\\n)", r"[ \t>#*|\"']*+"
_PRIVATE_KEY = (
    r"-----BEGIN((?: [A-Z0-9]+)*) PRIVATE KEY-----"
    r"(?:(?:[^-]|-(?!----(?:BEGIN|END)))*+-----END\1 PRIVATE KEY-----|"
    r"(?:[ \t]*+(?:[A-Za-z0-9+/]{16,}+={0,2}|[A-Za-z0-9+/]++={1,2}))*+"
    rf"(?:{_BREAK}{_LEAD}(?:Proc-Type|DEK-Info)\x20*+:[^\r\n\\]*+)*+(?:{_BREAK}{_LEAD}(?={_BREAK}))*+"
    rf"(?:{_BREAK}{_LEAD}[A-Za-z0-9+/=]++[ \t\"',;]*+(?={_BREAK}|\Z))*+)"
)

#: Rules that the method adds: credentials whose issuers give them a form of their own.
ADDED_RULES = [
    ("private_key", _PRIVATE_KEY, 0, 0),
    ("code_host", r"gh[opusr]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", r"xox[abposr]-[A-Za-z0-9-]+", 0, 20),
    # begins within the first 64 characters of its run, so that a run without an end is not tried from each of its places
    ("web_token", r"(?<![A-Za-z0-9_-]{64})eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("payment_key", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    ("url_login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://[^\s/:@]{1,100}:[^\s/:@]{1,200}@", 0, 0),
]

#: Sets of strings larger than this are cut down to what they have in common: their trigrams, or nothing.
MOST_EXACT = 24

# A query: True (anything), or ("and" | "or", members), or a trigram in lower case
Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    flat = [q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])]
    parts = [p for p in dict.fromkeys(flat) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(word: str) -> Query:
    return _all([word[i : i + 3] for i in range(len(word) - 2)])


class _Facts:
    """What is known of a part of a pattern: all strings that it can be (None: too many), ends else, and a query."""

    def __init__(self, exact: frozenset | None, first: frozenset = frozenset([""]), last: frozenset = frozenset([""]), query: Query = True):
        self.exact, self.query = exact, query
        self.first, self.last = (exact, exact) if exact is not None else (first, last)

    def needs(self) -> Query:
        """The part's own query with that of its exact strings."""
        return _any([_grams(w) for w in self.exact]) if self.exact is not None else self.query


def _joined(a: _Facts, b: _Facts) -> _Facts:
    """Facts of a followed by b; trigrams across the border come from a's ends with b's beginnings."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_EXACT:
        return _Facts(frozenset(x + y for x in a.exact for y in b.exact))
    edges = [x[-2:] + y[:2] for x in a.last for y in b.first] if len(a.last) * len(b.first) <= 8 * MOST_EXACT else []
    query = _all([a.needs(), b.needs(), _any([_grams(e) for e in edges]) if edges else True])
    first = frozenset(x + y for x in a.exact for y in b.first) if a.exact is not None and len(a.exact) * len(b.first) <= MOST_EXACT else a.first
    last = frozenset(x + y for x in a.last for y in b.exact) if b.exact is not None and len(a.last) * len(b.exact) <= MOST_EXACT else b.last
    return _Facts(None, first, last, query)


def _facts(parsed) -> _Facts:
    out = _Facts(frozenset([""]))
    for op, arg in parsed:
        if op is sre.LITERAL:
            c = chr(arg)
            part = _Facts(frozenset([c.lower()])) if c.isascii() else _Facts(None)
        elif op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
            letters = {chr(x).lower() for o, v in arg for x in ([v] if o is sre.LITERAL else range(v[0], min(v[1], v[0] + 200) + 1))}
            part = _Facts(frozenset(letters)) if len(letters) <= 6 and all(x.isascii() for x in letters) else _Facts(None)
        elif op is sre.SUBPATTERN:
            part = _facts(arg[3])
        elif op is sre.BRANCH:
            parts = [_facts(p) for p in arg[1]]
            if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_EXACT:
                part = _Facts(frozenset().union(*(p.exact for p in parts)))
            else:
                part = _Facts(None, frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts)), _any([p.needs() for p in parts]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            one = _facts(inner)
            if least == 0 and most == 1 and one.exact is not None:
                part = _Facts(one.exact | {""})
            elif least == 0:
                part = _Facts(None)
            elif least == most == 1:
                part = one
            else:
                part = _Facts(None, one.first, one.last, one.needs())
        elif op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            part = _Facts(frozenset([""]))
        else:
            part = _Facts(None)
        out = _joined(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """The query over lower-case ASCII trigrams that holds of every text with a match; True if there is none."""
    return _facts(sre_parser.parse(pattern)).needs()


def _named(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(_named, query[1]))


class Scanner:
    """Rules with their queries, and the index of a batch."""

    def __init__(self, base: list[tuple], added: list[tuple]):
        self.rules = [(kind, re.compile(p), group, least, trigram_query(p)) for kind, p, group, least in [*base, *added]]
        self.n_base = len(base)
        grams = sorted(set().union(*(_named(q) for *_, q in self.rules)))
        self.number = {g: i + 1 for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            a, b, c = g.encode()
            self.table[a << 16 | b << 8 | c] = i
        self.low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Of each trigram that the queries name, the numbers of the texts that hold it, ascending."""
        ends = np.cumsum([len(t) + 2 for t in texts])  # two zero bytes keep trigrams from spanning texts
        codes = np.frombuffer(b"\0\0".join(texts).translate(self.low) + b"\0\0", np.uint8)
        hits: list[np.ndarray] = []
        for at in range(0, len(codes) - 2, 1 << 20):
            part = codes[at : at + (1 << 20) + 2].astype(np.uint32)
            found = self.table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            where = np.flatnonzero(found)
            doc = np.searchsorted(ends, where + at, side="right")
            hits.append(np.unique(found[where].astype(np.int64) << 32 | doc))
        pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        cuts = np.searchsorted(pairs >> 32, np.arange(1, len(self.number) + 2))
        return {g: pairs[cuts[i - 1] : cuts[i]] & 0xFFFFFFFF for g, i in self.number.items()}

    def candidates(self, query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return postings[query]
        sets = [self.candidates(q, postings, n) for q in query[1]]
        out = sets[0]
        for s in sets[1:]:
            out = np.intersect1d(out, s, assume_unique=True) if query[0] == "and" else np.union1d(out, s)
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text, (start, number of the rule, end) in code points, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings([t.encode("utf-8", "surrogatepass") for t in texts])
        for k, (_, pattern, group, least, query) in enumerate(self.rules):
            for d in self.candidates(query, postings, len(texts)):
                for m in pattern.finditer(texts[d]):
                    if m.end(group) - m.start(group) >= least:
                        out[d].append((m.start(), k, m.end()))
        for found in out:
            found.sort()
        return out

    def name(self, found: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{self.rules[k][0]}:{a}:{b}" for a, k, b in found)


def _slices(texts: list[str]) -> list[tuple[int, int]]:
    """Runs of texts of a bounded number of characters; a longer text stands alone."""
    cuts, size = [0], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            cuts.append(i)
            size = 0
        size += len(t)
    return list(zip(cuts, [*cuts[1:], len(texts)]))


def secret_spans(docs: DataFrame, base: list[tuple] = BASE_RULES, added: list[tuple] = ADDED_RULES) -> DataFrame:
    """doc_id, a count n_<kind> of each base rule, base_sha256 of the base spans, and spans, all of them.

    A span is kind:start:end in code points, end exclusive; spans are in order of start, then of the kinds as listed, joined
    by commas. A null text counts as empty: no spans, and the digest of nothing. Repeated rows each get a row; other columns
    are left out. Narrow: no shuffle; memory is bounded by a batch.
    """
    kinds = [k for k, *_ in base]

    def make():
        scanner = tool(Scanner, tuple(base), tuple(added))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            found = [f for lo, hi in _slices(texts) for f in scanner.spans(texts[lo:hi])]
            own = [[x for x in f if x[1] < scanner.n_base] for f in found]
            counts = [pa.array([sum(x[1] == k for x in f) for f in own], pa.int64()) for k in range(len(kinds))]
            digests = [hashlib.sha256(scanner.name(f).encode()).hexdigest() for f in own]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests), pa.array(map(scanner.name, found), pa.string())], ["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"])

        return one

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, " + "".join(f"n_{k} long, " for k in kinds) + "base_sha256 string, spans string")


def redacted(docs: DataFrame, base: list[tuple] = BASE_RULES, added: list[tuple] = ADDED_RULES) -> DataFrame:
    """All columns of the documents, each secret in text replaced by its kind in brackets; overlapping spans are one.

    A null text stays null, a text without secrets as it is."""

    def make():
        scanner = tool(Scanner, tuple(base), tuple(added))

        def clean(text: str, found: list[tuple[int, int, int]]) -> str:
            out, at = [], 0
            for start, k, end in found:
                if start >= at:
                    out += [text[at:start], f"[{scanner.rules[k][0]}]"]
                at = max(at, end)
            return "".join([*out, text[at:]])

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            found = [f for lo, hi in _slices(texts) for f in scanner.spans(texts[lo:hi])]
            new = [None if raw is None else clean(t, f) if f else t for raw, t, f in zip(batch.column("text").to_pylist(), texts, found)]
            k = batch.schema.get_field_index("text")
            return batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

        return one

    return map_batches(docs, make, docs.schema)
