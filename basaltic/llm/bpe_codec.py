"""Byte-level BPE encoding and decoding: longest matches with backtracking over memoised neighbour checks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from basaltic.llm.common import Memory, map_batches, texts_of, tool
from basaltic.llm.merges import Merges
from basaltic.llm.splitting import splitter

#: Distinct pieces that a worker remembers, about half a kilobyte each.
MEMO = 300_000


class Codec:
    """Encodes and decodes by a rank file. Bytes stand as Latin-1 characters, so the trie matches bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        import ahocorasick

        self.pattern = splitter(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.ranks = ranks
        self.merges = Merges({i for b, i in ranks.items() if len(b) == 1}, self._rules(ranks))
        self.machine = ahocorasick.Automaton()
        # a token that its own text does not give is never used
        self.usable = {t: i for t, i in ranks.items() if len(t) == 1 or i in self.merges.parts}
        for token in self.usable:
            self.machine.add_word(token.decode("latin-1"), len(token))
        self.longest = max(map(len, self.usable), default=0)
        self.memory = Memory(memo)

    @staticmethod
    def _rules(ranks: dict[bytes, int]) -> dict[tuple[int, int], tuple[int, int]]:
        """In a rank file any two neighbours merge whose join has a rank, so every cut of a token is a rule."""
        rules = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    rules[left, right] = (rank, rank)
        return rules

    @classmethod
    def load(cls, path: str, pattern: str, memo: int = MEMO) -> Codec:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return cls(ranks, pattern, memo)

    def ids(self, piece: str) -> list[int]:
        """Token ids of one match of the pattern."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n, text, longest, usable, most = len(raw), raw.decode("latin-1"), self.machine.longest_prefix, self.usable.get, self.longest
        known, fits = self.merges.known.get, self.merges.fits
        seen, tokens, places, at, last = bytearray(n + 1), [], [0], 0, -1
        untried = [longest(text[:most])]  # at each place of the path, the longest match that has not been tried there
        while at < n:
            length = untried[-1]
            while length:
                token = usable(raw[at : at + length])
                # a place that was reached once was reached by its only encoding; it need not be tried again
                if token is not None and not seen[at + length]:
                    fit = last < 0 or known(last << 32 | token)
                    if fit is None:
                        fit = fits(last, token)
                    if fit:
                        untried[-1] = length - 1
                        at += length
                        seen[at] = 1
                        tokens.append(token)
                        places.append(at)
                        untried.append(longest(text[at : at + most]) if at < n else 0)
                        last = token
                        break
                length -= 1
            else:
                tokens.pop()
                places.pop()
                untried.pop()
                at, last = places[-1], tokens[-1] if tokens else -1
        return tokens

    def piece(self, piece: str) -> tuple[int, str, bytes]:
        """Of one piece: number of ids, the ids as decimal text, and the bytes that the ids decode to."""
        ids = self.ids(piece)
        got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        self.memory.offer(piece, got)
        return got

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.ids(p)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids' decimals joined by a space, SHA-256 of the decoded bytes)."""
        count, known, new = 0, self.memory.kept.get, self.piece
        of_ids, of_bytes, first = hashlib.sha256(), hashlib.sha256(), True
        for pieces in self._some(text):
            got = [known(p) or new(p) for p in pieces]
            counts, words, back = zip(*got)
            count += sum(counts)
            of_ids.update(("" if first else " ").encode() + " ".join(words).encode())
            of_bytes.update(b"".join(back))
            first = False
        return count, of_ids.hexdigest(), of_bytes.hexdigest()

    def _some(self, text: str, most: int = 100_000) -> Iterator[list[str]]:
        """The pieces of a text, not all at once if it is very long."""
        if len(text) < 1_000_000:
            if pieces := self.pattern.findall(text):
                yield pieces
            return
        held: list[str] = []
        for m in self.pattern.finditer(text):
            held.append(m.group())
            if len(held) >= most:
                yield held
                held = []
        if held:
            yield held


def encode_digests(docs: DataFrame, path: str, pattern: str, memo: int = MEMO) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    A null text counts as empty: no tokens, and digests of nothing. Repeated rows each get a row; a null doc_id stays
    null; other columns are left out. Narrow: no shuffle, one pass, memory bounded by a batch and the memo.
    """

    def make():
        own = tool(Codec.load, path, pattern, memo)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [own.digest(t) for t in texts_of(batch)]
            n, a, b = zip(*rows)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return one

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The ids themselves: doc_id and ids array<int>; the same cases as in encode_digests."""

    def make():
        own = tool(Codec.load, path, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.encode(t) for t in texts_of(batch)], pa.list_(pa.int32()))], ["doc_id", "ids"])

        return one

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>")


def decode_ids(frame: DataFrame, path: str) -> DataFrame:
    """The bytes that ids stand for: doc_id and content binary. Null ids decode to nothing."""

    def make():
        own = tool(Codec.load, path, r"\S+|\s+")

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "content"])

        return one

    return map_batches(frame.select("doc_id", "ids"), make, "doc_id long, content binary")
