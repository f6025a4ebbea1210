"""Byte-pair merges: which two tokens may stand side by side, and the exact encoding of one piece of text.

Two facts make both tokenizer operators here linear. A sequence of tokens is what the merges give exactly if every two
neighbours are what the merges give for their own joined text. And an encoding's beginnings are encodings too, so each
beginning of a text has one possible last token.
"""

from __future__ import annotations

INF = 1 << 60


class Merges:
    """rules: of two neighbouring ids, the rank of their merge and the id it makes. singles: the ids that no merge makes."""

    def __init__(self, singles: set[int], rules: dict[tuple[int, int], tuple[int, int]]):
        self.rules = rules
        self.parts: dict[int, tuple[int, int, int]] = {}
        self._right: dict[int, tuple[list[int], list[int]]] = {}
        self._left: dict[int, tuple[list[int], list[int]]] = {}
        self.known: dict[int, bool] = {}  # a << 32 | b -> fits(a, b)
        # the two parts that a token is made of are those that lower ranks leave apart; other cuts never come up
        for (left, right), (rank, made) in sorted(rules.items(), key=lambda x: x[1][0]):
            real = all(t in singles or t in self.parts for t in (left, right))
            if made not in self.parts and real and self._apart(left, right, rank):
                self.parts[made] = (left, right, rank)

    def _spine(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """The tokens at one edge, from the symbol up to the whole token, and the rank at which each is used up."""
        chain, used = [token], [INF]
        while token in self.parts:
            used.append(self.parts[token][2])
            token = self.parts[token][side]
            chain.append(token)
        return chain[::-1], used[::-1]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart when they stand side by side; memoised."""
        key = a << 32 | b
        fit = self.known.get(key)
        if fit is None:
            if len(self.known) > 400_000:
                self.known.clear()
            fit = self.known[key] = self._apart(a, b)
        return fit

    def _apart(self, a: int, b: int, below: int = INF) -> bool:
        """As fits(), where only merges of a rank below the given one take place."""
        ra = self._right.get(a)
        if ra is None:
            ra = self._right[a] = self._spine(a, 1)
        lb = self._left.get(b)
        if lb is None:
            lb = self._left[b] = self._spine(b, 0)
        (xs, xu), (ys, yu), rules, i, j = ra, lb, self.rules, 0, 0
        while True:
            end_x, end_y = xu[i], yu[j]
            hit = rules.get((xs[i], ys[j]))
            # of equal ranks the leftmost merges first: a's own merge stands left of the border, b's right of it
            if hit is not None and hit[0] < end_x and hit[0] <= end_y and hit[0] < below:
                return False
            if end_x == INF and end_y == INF:
                return True
            if end_x <= end_y:
                i += 1
            else:
                j += 1

    def merge(self, symbols: list[int]) -> list[int]:
        """The plain definition: merge the lowest rank, leftmost first, until nothing merges."""
        out = list(symbols)
        while len(out) > 1:
            best = min((self.rules.get(p, (INF, -1)) + (i,) for i, p in enumerate(zip(out, out[1:]))), key=lambda x: (x[0], x[2]))
            if best[0] == INF:
                break
            out[best[2] : best[2] + 2] = [best[1]]
        return out


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies use: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}
