"""Embedding near-dedup by spherical-cap filters.

Filter directions form a structured product code: after a random rotation the coordinates fall in two halves, each half has a
random code of unit vectors, and a direction is a pair of codewords. A vector is list-decoded to all directions whose inner
product with it exceeds a threshold, by halves, without touching the rest of the product. Vectors of one label that share a
direction are compared in double precision.

A vector goes to a cell once, not once for each direction: a cell has the directions of one label and code, of some first
codewords where a label is large. Cells of very many vectors are cut into tiles. A pair is counted under the smallest direction
that both share, so no pairs are written out: a task returns each vector's number of links found there, and links along a
spanning forest.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basaltic.llm.common import connected, grouped, map_arrow, map_batches, stored

#: Vectors whose comparison costs as much as an entry of a direction, the chance to miss a pair at the threshold, codes.
BUCKET, MISS, CODES = 512, 1e-8, 16
#: Vectors of a cell or of a tile of one, members of a direction that are compared at once, pairs that are settled at once, vectors
#: whose rows are made at once.
CELL, TILE, PAIRS, SLICE = 1 << 17, 512, 1 << 16, 256
#: Pairs that a plan is measured on, and the most codewords in a half.
SAMPLE, MOST_WORDS = 1600, 1024


def half_codes(rng: np.random.Generator, dim: int, words: int) -> list[np.ndarray]:
    """Random unit vectors of each half of the coordinates."""
    half = max(1, dim // 2)
    out = []
    for width in (half, dim - half):
        c = rng.normal(size=(words, width))
        out.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300))
    return out


def pairs_at(rng: np.random.Generator, count: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at the cosine; equal ones where a dimension has no room."""
    x, z = rng.normal(size=(2, count, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return x, x
    z -= (x * z).sum(axis=1, keepdims=True) * x
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z, axis=1, keepdims=True)


def measured(dim: int, words: int, cosine: float, most: float) -> tuple[float, float]:
    """(threshold, share of directions beyond it): the highest threshold at which a pair at the cosine shares no direction of
    one code with a chance of `most` at the most, three standard errors allowed for."""
    rng = np.random.default_rng((12, dim, words))
    half, each = max(1, dim // 2), SAMPLE // CODES
    shared, beyond = [], []
    for _ in range(CODES):
        one, two = half_codes(rng, dim, words)
        x, y = pairs_at(rng, each, dim, cosine)
        sides = [(v[:, :half] @ one.T, v[:, half:] @ two.T) for v in (x, y)]
        for k in range(each):
            first, second = (a[k][:, None] + b[k] for a, b in sides)
            shared.append(np.minimum(first, second).max())
            beyond.append(np.sort(rng.choice(first.ravel(), min(first.size, 4096), replace=True)))
    allowed = most - 3 * math.sqrt(most * (1 - most) / len(shared))
    need = np.sort(shared)[max(0, int(allowed * len(shared)))] - 1e-9
    return need / math.sqrt(2), float(np.mean([(b >= need).mean() for b in beyond]))


@functools.cache
def plan(n: int, dim: int, cosine: float, miss: float = MISS) -> tuple[int, float]:
    """(codewords in a half, threshold on a unit direction's inner product) of each of CODES codes, for n vectors.

    The codes are turned independently, so a pair is missed by all of them with the CODES-th power of its chance to share no
    direction of one, whatever the pair is; vectors without filters are part of that chance. It is measured in this dimension,
    on a seeded sample of pairs at the cosine. The number of codewords is the one with the least work for a vector."""
    best, worse = (math.inf, 0, 0.0), 0
    for words in sorted({round(2 ** (k / 2)) for k in range(4, 2 * int(math.log2(MOST_WORDS)) + 1)}):
        least, share = measured(dim, words, cosine, miss ** (1 / CODES))
        work = CODES * words**2 * share * (BUCKET + n * share)
        best, worse = ((work, words, least), 0) if work < best[0] else (best, worse + 1)
        if worse == 2:
            break
    return best[1:]


class Code:
    """One product code of a dimension; the same everywhere for the same arguments."""

    def __init__(self, dim: int, words: int, number: int):
        rng = np.random.default_rng((11, dim, words, number))
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.half = max(1, dim // 2)
        self.words = words
        self.codes = half_codes(rng, dim, words)

    def decode(self, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The ascending numbers of all directions that exceed the threshold, vector after vector, and how many each vector has."""
        turned = x @ self.turn
        one, two = turned[:, : self.half] @ self.codes[0].T, turned[:, self.half :] @ self.codes[1].T
        need, numbers, counts = least * math.sqrt(2), [], []
        for lo in range(0, len(x), 256):
            a, b = one[lo : lo + 256], two[lo : lo + 256]
            (ra, i), (rb, j) = np.nonzero(a >= (need - b.max(axis=1))[:, None]), np.nonzero(b >= (need - a.max(axis=1))[:, None])
            many = np.bincount(rb, minlength=len(a))
            p = np.repeat(np.arange(len(ra)), many[ra])
            q = ragged((np.cumsum(many) - many)[ra], many[ra])
            hit = a[ra, i][p] + b[rb, j][q] >= need
            numbers.append(i[p[hit]] * self.words + j[q[hit]])
            counts.append(np.bincount(ra[p[hit]], minlength=len(a)))
        return np.concatenate(numbers), np.concatenate(counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its count, one run after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


@functools.cache
def codes(dim: int, words: int) -> list[Code]:
    return [Code(dim, words, k) for k in range(CODES)]


def decode(x: np.ndarray, words: int, least: float) -> list[np.ndarray]:
    """Of each unit vector, the ascending numbers of the directions of all codes that exceed the threshold."""
    each = [c.decode(x, least) for c in codes(x.shape[1], words)]
    each = [np.split(got + k * words * words, np.cumsum(n)[:-1]) for k, (got, n) in enumerate(each)]
    return [np.concatenate(y) for y in zip(*each)]


def _valid(embedding: list | None, kind: type) -> bytes | None:
    """The components as bytes, or nothing if a vector can't be linked. One whose squares would not fit into a double is brought
    near 1 by a power of two, which leaves its cosines as they are."""
    if not embedding or None in embedding:
        return None
    v = np.array(embedding, kind)
    most = float(np.abs(v).max())
    if not 0 < most < np.inf:  # NaN is not, either
        return None
    if not 1e-100 < most < 1e100:
        v = np.ldexp(v, -math.frexp(most)[1])
    return (v + 0).tobytes()


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def units(rows: list[bytes], kind: type) -> np.ndarray:
    return unit(np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1))


def usable(vectors: DataFrame, kind: type) -> DataFrame:
    """vec_id, label, v (components as bytes; null if it links with nothing) and d, their digest."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [None if label is None or i is None else _valid(e, kind) for i, label, e in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")))]
            digest = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary()), pa.array(digest, pa.binary())], ["vec_id", "label", "v", "d"])

        return one

    return map_batches(vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding"), make, "vec_id long, label string, v binary, d binary")


def packed(words: int) -> type:
    """What a direction's number within a code, and how many there are, is kept as."""
    return np.uint16 if words < 256 else np.uint32


def listed(x: np.ndarray, words: int, least: float) -> list[bytes]:
    """Of each vector, how many directions it has of each code, and their numbers within the code, one code after the other."""
    each = [c.decode(x, least) for c in codes(x.shape[1], words)]
    counts = np.stack([n for _, n in each], axis=1)
    parts = [np.split(got, np.cumsum(n)[:-1]) for got, n in each]
    return [np.concatenate(y).astype(packed(words)).tobytes() for y in zip(counts, *parts)]


def cells(decoded: DataFrame, plans: dict[int, tuple[int, float, int]], width: int, whole: bool) -> DataFrame:
    """label, size, code, part of every cell that a vector is in; if whole, with id, many, v and the vector's lists up to that
    code, else c, how many vectors of a batch there are."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, at, code, part, lists = batch.column("lists").to_pylist(), [], [], [], []
            sizes = batch.column("size").to_pylist()
            for r, (row, size) in enumerate(zip(rows, sizes)):
                words, _, parts = plans[size // width]
                kind = packed(words)
                step = np.dtype(kind).itemsize
                flat = np.frombuffer(row, kind)
                ends = np.cumsum(flat[:CODES], dtype=np.int64).tolist()
                first = (flat[CODES:] // kind(words) % parts).tolist() if parts > 1 else None
                lo = 0
                for k, hi in enumerate(ends):
                    if hi > lo:
                        own = sorted(set(first[lo:hi])) if first else (0,)
                        for x in own:
                            at.append(r)
                            code.append(k)
                            part.append(x)
                        if whole:
                            lists += [row[: (k + 1) * step] + row[CODES * step : (CODES + hi) * step]] * len(own)
                    lo = hi
            if not at:
                return None
            out = pa.RecordBatch.from_arrays([*batch.select(["label", "size"]).take(pa.array(at)).columns, pa.array(code, pa.int32()), pa.array(part, pa.int32())], ["label", "size", "code", "part"])
            if whole:
                out = pa.RecordBatch.from_arrays([*out.columns, *batch.select(["id", "many", "v"]).take(pa.array(at)).columns, pa.array(lists, pa.binary())], [*out.schema.names, "id", "many", "v", "lists"])
                return out
            return pa.Table.from_batches([out]).group_by(out.schema.names).aggregate([([], "count_all")]).rename_columns([*out.schema.names, "c"]).combine_chunks().to_batches()[0]

        return one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE if whole else batch.num_rows):  # a vector's rows are many
                if (out := one(batch.slice(lo, SLICE if whole else batch.num_rows))) is not None:
                    yield out

    columns = ["label", "size", *(["id", "many", "v"] if whole else []), "lists"]
    kept = "id long, many long, v binary, lists binary" if whole else "c long"
    return map_arrow(decoded.select(columns), run, f"label string, size int, code int, part int, {kept}")


def joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all binary values, one value after the other, and how many each has."""
    held = column.combine_chunks()
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    each = np.dtype(kind).itemsize
    return np.frombuffer(held.buffers()[2], kind, (ends[-1] - ends[0]) // each, ends[0]), np.diff(ends) // each


class Cell:
    """The vectors of one cell, or of two of its tiles, and their links that are counted there."""

    def __init__(self, t: pa.Table, cosine: float, kind: type, plans: dict[int, tuple[int, float, int]]):
        self.cosine, self.raw = cosine, joined(t.column("v"), kind)[0].reshape(t.num_rows, -1)
        dim = self.raw.shape[1]
        self.short = np.empty(self.raw.shape, np.float32)
        for lo in range(0, t.num_rows, 4096):
            self.short[lo : lo + 4096] = unit(self.raw[lo : lo + 4096])
        self.slack = 1e-6 + 2e-7 * dim  # single precision loses less
        self.ids, self.many, self.tile = (t.column(c).to_numpy() for c in ("id", "many", "tile"))
        self.tile_a, self.tile_b, self.code, part = (t.column(c)[0].as_py() for c in ("tile_a", "tile_b", "code", "part"))
        self.words, _, parts = plans[dim]
        self.flat, long = joined(t.column("lists"), packed(self.words))
        begin = np.cumsum(long) - long
        self.ends = np.cumsum(np.stack([self.flat[begin + k] for k in range(self.code + 1)], axis=1), axis=1, dtype=np.int64)
        self.base = begin + self.code + 1
        who, what = self.entries(np.arange(len(long)), self.code)
        here = what // self.words % parts == part
        who, what = who[here], what[here]
        order = np.argsort(what, kind="stable")
        self.who, self.what = who[order].astype(np.int32), what[order]

    def entries(self, rows: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in rows, number) of the directions that rows have of a code."""
        lo = self.ends[rows, code - 1] if code else np.zeros(len(rows), np.int64)
        n = self.ends[rows, code] - lo
        return np.repeat(np.arange(len(rows)), n), self.flat[ragged(self.base[rows] + lo, n)].astype(np.int64)

    def meet(self, a: np.ndarray, b: np.ndarray, code: int, below: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair shares a direction of a code, one below a number of its own if given."""
        keys = []
        for side in (a, b):
            at, number = self.entries(side, code)
            if below is not None:
                at, number = at[number < below[at]], number[number < below[at]]
            keys.append(at * self.words**2 + number)
        both = np.concatenate(keys)
        both.sort()
        out = np.zeros(len(a), bool)
        out[both[1:][both[1:] == both[:-1]] // self.words**2] = True
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """a, b and the direction of what looks alike, by ascending directions."""
        cuts = np.concatenate([[0], np.flatnonzero(self.what[1:] != self.what[:-1]) + 1, [len(self.what)]])
        crossing = self.tile_a != self.tile_b
        least = np.float32(self.cosine - self.slack)
        for lo, hi in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist()):
            own = self.who[lo:hi]
            left, right = (own[self.tile[own] == self.tile_a], own[self.tile[own] == self.tile_b]) if crossing else (own, own)
            x, y = self.short[left], self.short[right] if crossing else None
            for i in range(0, len(left), TILE):
                for j in range(0 if crossing else i, len(right), TILE):
                    like = x[i : i + TILE] @ (x if y is None else y)[j : j + TILE].T >= least
                    a, b = np.divmod(np.flatnonzero(like), like.shape[1])
                    if not crossing and i == j:
                        a, b = a[a < b], b[a < b]
                    if len(a):
                        yield left[i + a].astype(np.int64), right[j + b].astype(np.int64), np.full(len(a), self.what[lo])

    def settled(self, held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """id, n and root of those in the links among held pairs that are counted here."""
        a, b, f = (np.concatenate(c) for c in zip(*held))
        first = np.unique(np.minimum(a, b) * len(self.ids) + np.maximum(a, b), return_index=True)[1]
        a, b, f = a[first], b[first], f[first]
        for lo in range(0, len(a), 1 << 16):  # in pieces, as the vectors of many pairs take room
            at = slice(lo, lo + (1 << 16))
            f[at][np.einsum("ij,ij->i", unit(self.raw[a[at]]), unit(self.raw[b[at]])) < self.cosine] = -1
        a, b, f = a[f >= 0], b[f >= 0], f[f >= 0]
        # pairs that share a smaller direction are counted there
        for code in [*range(self.code), self.code]:
            other = ~self.meet(a, b, code, f if code == self.code else None)
            a, b, f = a[other], b[other], f[other]
        if not len(a):
            return None
        own, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ends[: len(a)], ends[len(a) :]
        n = np.zeros(len(own), np.int64)
        np.add.at(n, x, self.many[b])
        np.add.at(n, y, self.many[a])
        ids = self.ids[own]
        root = ids.copy()
        while True:
            low = root.copy()
            np.minimum.at(low, x, root[y])
            np.minimum.at(low, y, root[x])
            if (low == root).all():
                return ids, n, root
            root = low

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, count = [], 0
        for got in self.pairs():
            held.append(got)
            count += len(got[0])
            if count >= PAIRS:
                if (out := self.settled(held)) is not None:
                    yield out
                held, count = [], 0
        if held and (out := self.settled(held)) is not None:
            yield out


def links_in_cells(rows: DataFrame, cosine: float, kind: type, plans: dict[int, tuple[int, float, int]]) -> DataFrame:
    """From the rows of cells (code, part, tile_a, tile_b, tile, id, many, v, lists), sorted runs of one cell's tile pair g: id,
    n (members of the classes that it is linked with and that are counted here) and root, the smallest id that it hangs
    together with here. Of one id there may be several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "g"):
            if t.num_rows > 1:
                cell, t = Cell(t, cosine, kind, plans), None  # its rows are let go
                for got in cell.links():
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["id", "n", "root"])

    return map_arrow(rows, run, "id long, n long, root long")


def near_vectors(vectors: DataFrame, cosine: float = 0.93, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Vectors of equal label link if their cosine reaches the threshold; the chance to miss a link is about `miss` at the
    threshold and falls fast above it. Null labels, null, zero and empty vectors, and null or non-finite components link with
    nothing, nor do vectors of unlike dimension. Equal vectors are one class, so copies cost nothing and count in full;
    repeated rows of one id and vector count once and are all returned. A row with a null id stays alone.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    rows = stored(usable(vectors, kind), "vectors")
    members = rows.where("v is not null").groupBy("label", "d", "vec_id").agg(F.first("v").alias("v"))
    classes = members.groupBy("label", "d").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"), F.first("v").alias("v"))
    classes = stored(classes, "classes")
    width = np.dtype(kind).itemsize
    largest = classes.groupBy("label", (F.octet_length("v") / width).cast("int").alias("dim")).agg(F.count("*").alias("c")).groupBy("dim").agg(F.max("c").alias("c")).collect()
    plans = {r.dim: (*(p := plan(r.c, r.dim, cosine, miss)), min(p[0], -(-r.c // CELL))) for r in largest}

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = batch.column("v").to_pylist()
            lists: list = [None] * len(v)
            for size in {len(r) for r in v}:
                at = [i for i, r in enumerate(v) if len(r) == size]
                words, least, _ = plans[size // width]
                for lo in range(0, len(at), 2000):
                    some = at[lo : lo + 2000]
                    for i, got in zip(some, listed(units([v[i] for i in some], kind), words, least)):
                        lists[i] = got
            size = pa.array([len(x) for x in v], pa.int32())
            return pa.RecordBatch.from_arrays([*batch.select(["label", "id", "many", "v"]).columns, size, pa.array(lists, pa.binary())], ["label", "id", "many", "v", "size", "lists"])

        return one

    decoded = map_batches(classes.select("label", "id", "many", "v"), make, "label string, id long, many long, v binary, size int, lists binary")
    decoded = stored(decoded, "decoded")
    # cells beyond their size, a CELL-th of all rows at the most, are cut into tiles; vectors are shuffled once, to their cells
    key = ["label", "size", "code", "part"]
    large = cells(decoded, plans, width, whole=False).groupBy(key).agg(F.sum("c").alias("c")).where(F.col("c") > 2 * CELL)
    large = large.select(F.xxhash64(*key).alias("cell"), F.ceil(F.col("c") / CELL).cast("int").alias("tiles"))
    dealt = cells(decoded, plans, width, whole=True).withColumn("cell", F.xxhash64(*key)).drop("label", "size")
    tiled = dealt.join(F.broadcast(large), "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumn("tile_a", F.least("tile", "other")).withColumn("tile_b", F.greatest("tile", "other")).withColumn("g", F.xxhash64("cell", "tile_a", "tile_b"))
    tiled = tiled.select("g", "code", "part", "tile_a", "tile_b", "tile", "id", "many", "v", "lists")
    found = stored(links_in_cells(tiled.repartition("g").sortWithinPartitions("g"), cosine, kind, plans), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("_id"), "component")
    known = classes.select("label", "d", "id", "many").join(counts, "id", "left").join(parts, F.col("id") == F.col("_id"), "left")
    known = known.select(F.col("label").alias("_label"), F.col("d").alias("_d"), "id", "many", "n", "component")
    joined = rows.select("vec_id", "label", "d").join(known, (F.col("label") == F.col("_label")) & (F.col("d") == F.col("_d")), "left")
    part = F.coalesce("component", "id", "vec_id")
    return joined.select("vec_id", F.coalesce(F.col("many") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(part == F.col("vec_id"), F.lit(True)).alias("kept"))
