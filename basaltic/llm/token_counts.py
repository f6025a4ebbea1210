"""Token counts by a compiled finite-state transducer.

The tokenizer becomes two machines. The outer one cuts normalised text into words and drops white space. The inner one
reads a word's bytes; each transition carries the change in the number of tokens emitted so far. It is determinised as
it is used: a state is what the tokens of later bytes can depend on, which is the longest end of the word that some token
begins with, and for each cut inside that end the last token before it and how many tokens fewer that beginning has.

A text is read in chunks. A chunk's state map is kept as a triple, for white space sends every state to the start: the
piece before its first white space, whose effect depends on the state on entry, the tokens of what lies between, and the
piece after its last white space, which is the state on exit. Maps compose associatively, so a scan over the chunks gives
the total whatever the grouping.
"""

from __future__ import annotations

import json
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltic.llm.common import KEPT_CHARS, map_batches, texts_of, tool
from basaltic.llm.merges import Merges, byte_letters
from basaltic.llm.splitting import ODD, splitter

#: Characters of a chunk; states and words that a worker remembers before it starts anew.
CHUNK, MOST_STATES, MEMO = 1 << 16, 400_000, 400_000


class WordTransducer:
    """Deterministic transducer over the symbols of one word: bytes, and 256 + byte for a word's last byte."""

    def __init__(self, symbols: dict[int, list[int]], merges: Merges):
        """symbols: of each usable token id, its symbols."""
        self.merges = merges
        self.child: dict[int, int] = {}  # node << 9 | symbol -> node
        self.depth, self.token, self.fail = [0], [-1], [0]
        for token, word in symbols.items():
            node = 0
            for s in word:
                key = node << 9 | s
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                    self.fail.append(-1)
                node = nxt
            self.token[node] = token
        # breadth first: nodes by depth, so that a node's fail link is there before its children ask for it
        for (key, node) in sorted(self.child.items(), key=lambda x: self.depth[x[1]]):
            self.fail[node] = self._next(self.fail[key >> 9], key & 511) if key >> 9 else 0
        self._reset()

    def _next(self, node: int, symbol: int) -> int:
        while True:
            to = self.child.get(node << 9 | symbol)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.fail[node]

    def _reset(self, state: tuple | None = None) -> int:
        """Forgets all states but the first and the given one, whose new number is returned."""
        # a state: node, then (last token, tokens fewer than now) of the beginnings that end within the node's depth
        start = (0, ((-1, 0),))
        self.states: list[tuple] = [start]
        self.known: dict[tuple, int] = {start: 0}
        self.arcs: dict[int, tuple[int, int]] = {}  # state << 9 | symbol -> (state, change in the number of tokens)
        if state is None or state == start:
            return 0
        self.known[state] = 1
        self.states.append(state)
        return 1

    def _arc(self, state: int, symbol: int) -> tuple[int, int]:
        node, cuts = self.states[state]
        to = self._next(node, symbol)
        fits, found, at = self.merges.fits, None, to
        while at and found is None:  # the tokens that end here, longest first; one fits
            token, length = self.token[at], self.depth[at]
            if token >= 0:
                last, fewer = cuts[length - 1]
                if last < 0 or fits(last, token):
                    found = (token, fewer)
            at = self.fail[at]
        assert found is not None, "every single symbol is a token"
        token, fewer = found
        change = 1 - fewer
        # cuts[k] belongs to the beginning that ends k symbols back
        kept = ((token, 0), *((t, f + change) for t, f in cuts[: self.depth[to]]))
        key = (to, kept)
        nxt = self.known.get(key)
        if nxt is None:
            nxt = self.known[key] = len(self.states)
            self.states.append(key)
        return nxt, change

    def count(self, word: bytes) -> int:
        """Tokens of a whole word: the sum of its transitions' changes."""
        state, total, arcs, last = 0, 0, self.arcs, len(word) - 1
        for i, s in enumerate(word):
            if i == last:
                s |= 256
            key = state << 9 | s
            arc = arcs.get(key)
            if arc is None:
                if len(self.states) > MOST_STATES:  # starts anew from the state it is in
                    key, arcs = self._reset(self.states[state]) << 9 | s, self.arcs
                    state = key >> 9
                arc = arcs[key] = self._arc(state, s)
            state, change = arc
            total += change
        return total


class Counter:
    """Counts the tokens of whole texts for a BPE with word ends, lower-casing and white space dropped."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        end = model["end_of_word_suffix"]
        assert end and not model.get("dropout") and not model.get("unk_token"), "a BPE with word ends and no unknown token"
        vocab = model["vocab"]
        rules = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            rules[vocab[left], vocab[right]] = (rank, vocab[left + right])

        def symbols(token: str) -> list[int]:
            final = token.endswith(end) and token != end
            out = [letters[c] for c in (token[: -len(end)] if final else token)]
            return [*out[:-1], out[-1] | 256] if final else out

        spelled = {i: symbols(t) for t, i in vocab.items()}
        merges = Merges({i for i, s in spelled.items() if len(s) == 1}, rules)
        self.machine = WordTransducer({i: s for i, s in spelled.items() if len(s) == 1 or i in merges.parts}, merges)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.mark = self.special[0][:2] if self.special and len({t[:2] for t in self.special}) == 1 else ""
        cut = spec["pre_tokenizer"]["pretokenizers"][0]
        assert cut["invert"] and cut["behavior"] == "Removed", "words are what the pattern matches"
        self.word = splitter(cut["pattern"]["Regex"])
        self.space = regex.compile(r"\s")
        self.library = Tokenizer.from_file(path)
        self.letters = letters
        self.memo: dict[str, int] = {}

    def _new(self, word: str) -> int:
        got = self.machine.count(word.encode("utf-8"))
        if len(word) <= KEPT_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got

    def _run(self, piece: str) -> int:
        """Tokens of settled, lower-cased text."""
        known, new = self.memo.get, self._new
        return sum([known(w) or new(w) for w in self.word.findall(piece)])

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """The state map of a chunk: (piece before the first white space, tokens between, piece after the last); no
        white space: (chunk, None, "")."""
        first = self.space.search(chunk)
        if first is None:
            return chunk, None, ""
        last = max(chunk.rfind(" "), chunk.rfind("\n"), first.start())
        return chunk[: first.start()], self._run(chunk[first.start() : last]), chunk[last:]

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        """The map of two adjoining chunks; associative."""
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self._run(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple[str, int | None, str]]) -> tuple[str, int | None, str]:
        """Composes neighbours pairwise, level by level, as a parallel prefix scan's upward sweep does."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def _settled(self, text: str) -> int:
        low = text.lower()
        if len(low) <= CHUNK:
            return self._run(low)
        head, between, tail = self.scan([self.chunk_map(low[i : i + CHUNK]) for i in range(0, len(low), CHUNK)])
        return self._run(head) + (between or 0) + self._run(tail)

    def _by_library(self, text: str) -> int:
        """As above, with the library's normaliser and splitter in place of the outer machine."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum(self.machine.count(bytes(map(self.letters.__getitem__, w))) for w, _ in words)

    def _plain(self, text: str) -> int:
        """Within the settled range, composition changes nothing and lower-casing is by character; other texts go through the
        library's normaliser."""
        return self._settled(text) if text.isascii() or not ODD.search(text) else self._by_library(text)

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token, as the library has it."""
        if self.special_re is None or (self.mark and self.mark not in text):
            return self._plain(text)
        return sum(map(self._plain, self.special_re.split(text))) + sum(1 for _ in self.special_re.finditer(text))


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than the limit) of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each get a row; a null doc_id stays null; other columns
    are left out. Narrow: no shuffle; a very long text is read in chunks.
    """

    def make():
        own = tool(Counter, path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(map(own.count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return one

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return map_batches(sized, make, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
