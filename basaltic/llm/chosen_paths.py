"""MinHash near-dedup by a chosen-path set similarity join.

Texts become sets of word shingles. Equal sets are one class with one representative. Representatives are branched down
independent random trees: a node picks one or two places of the MinHash sketch, the same for all its members, and sends each
member to the child named by its value there, so a pair at the threshold keeps about one common node on every level. Nodes
of bounded size are compared exhaustively by sketch, and candidate links are confirmed on the full sets.

Only components are wanted, and that bounds the work in large groups of near copies. First every node, large ones in random
chunks, proposes a spanning forest of its most similar pairs. Once these are confirmed, most of a group is one component, and only
pairs across components can matter: few members against all the rest. Nodes with too many such pairs branch further.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltic.llm.common import KEPT_CHARS, connected, dropped, map_arrow, map_batches, stored, texts_of, tool

#: Places of a sketch; members of a node that are compared at once; pairs across components for each member of a large node.
PLACES, NODE, ACROSS = 128, 128, 1024
#: The chance to miss a pair at the threshold, and levels that large nodes may branch beyond the first ones.
MISS, MORE_LEVELS = 1e-5, 6
#: Shares of nodes that pick one place and two: 1.25 children for each member on the average, for a similarity of 0.8.
_TWO = 4
#: Bits of the map of ids that texts are fetched by.
FILTER_BITS = 1 << 24
#: Distinct words whose hashes a worker remembers.
MEMO = 200_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of hashed word shingles of texts, and their sketches."""

    def __init__(self, words: int):
        import xxhash

        self.words, self.hash = words, xxhash.xxh3_64_intdigest
        self.memo: dict[bytes, int] = {}
        rng = np.random.default_rng(5)
        self.times = rng.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)

    def _word(self, word: bytes) -> int:
        got = self.hash(word)
        if len(word) <= KEPT_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got

    def of(self, text: str) -> np.ndarray:
        """Ascending distinct hashes; the whole sequence is one shingle if it is shorter than a shingle."""
        cut = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, both concern ASCII alone
        if not cut:
            return np.zeros(0, np.uint64)
        known, new = self.memo.get, self._word
        h = np.array([known(w) or new(w) for w in cut], np.uint64)
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = _mix(out * _GOLD + h[i : len(h) - k + 1 + i])
        return np.unique(out)

    def sketch(self, s: np.ndarray) -> np.ndarray:
        """The least of each place's permutation, its upper half."""
        least = np.full(PLACES, np.uint64(0xFFFFFFFFFFFFFFFF))
        for lo in range(0, len(s), 4096):
            least = np.minimum(least, (s[lo : lo + 4096, None] * self.times + self.plus).min(axis=0))
        return (_mix(least) >> np.uint64(32)).astype("<u4")


def digest(hashes: bytes) -> bytes:
    """Names a set by the bytes of its ascending hashes."""
    return hashlib.blake2b(hashes, digest_size=16).digest()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), d (digest of the set; null if empty), and the sketch as s, the lowest byte of each of its places, and upper, the other three."""

    def make():
        own = tool(Shingles, words)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, d, s, upper = [], [], [], []
            for text in texts_of(batch):
                h = own.of(text)
                n.append(len(h))
                d.append(digest(h.tobytes()) if len(h) else None)
                least = own.sketch(h) if len(h) else None
                s.append(least.astype("u1").tobytes() if len(h) else None)
                upper.append(least.view("u1").reshape(PLACES, 4)[:, 1:].tobytes() if len(h) else None)
            binary = [pa.array(x, pa.binary()) for x in (d, s, upper)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *binary], ["doc_id", "n", "d", "s", "upper"])

        return one

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n long, d binary, s binary, upper binary")


def _bytes(batch: pa.RecordBatch | pa.Table, column: str, each: int = 1) -> np.ndarray:
    """So many bytes for each place, of every row."""
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), "u1").reshape(-1, PLACES * each)


def _sketch(batch: pa.RecordBatch) -> np.ndarray:
    """The sketches, from s and upper."""
    out = np.empty((batch.num_rows, PLACES, 4), "u1")
    out[:, :, 0] = _bytes(batch, "s")
    out[:, :, 1:] = _bytes(batch, "upper", 3).reshape(-1, PLACES, 3)
    return out.view("<u4").reshape(-1, PLACES)


def branch(nodes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: from the members' nodes and sketches, (member, child node) of all their children."""
    draw = _mix(nodes + _GOLD)
    first = (draw % np.uint64(PLACES)).astype(int)
    second = (first + 1 + ((draw >> np.uint64(20)) % np.uint64(PLACES - 1)).astype(int)) % PLACES
    two = np.flatnonzero((draw >> np.uint64(50)) % np.uint64(_TWO) == 0)
    member = np.concatenate([np.arange(len(nodes)), two])
    place = np.concatenate([first, second[two]])
    value = sketch[member, place].astype(np.uint64)
    return member, _mix(nodes[member] ^ _mix(value + (place.astype(np.uint64) << np.uint64(33))))


def survival(depth: int, similarity: float = 0.8, below: float = 0.0) -> float:
    """The chance that a pair shares a node on a level of one tree and is not lost below it."""
    q = below
    for _ in range(depth):
        s = 1 - similarity + similarity * q
        q = (1 - 1 / _TWO) * s + s * s / _TWO
    return 1 - q


def missed(similarity: float, least: int, trees: int, levels: int, copies: int = 0) -> float:
    """The chance that a pair is missed: by the sketch filter, or by all trees. All share the sketch's places, so trees are
    independent only for a given number of equal ones. With copies, the pair's nodes all branch the further levels, too."""
    out = 0.0
    for equal in range(PLACES + 1):
        share = equal / PLACES
        below = (1 - survival(1, share, 1 - survival(MORE_LEVELS - 1, share))) ** copies if copies else 0.0
        lost = (1 - survival(levels, share, below)) ** trees if equal >= least else 1.0
        out += math.comb(PLACES, equal) * similarity**equal * (1 - similarity) ** (PLACES - equal) * lost
    return out


def forest_size(n: int, similarity: float) -> tuple[int, int, int, int]:
    """(least, trees, levels, copies): so many equal places as a candidate needs; so many levels that unlike sets, which share
    one value in twenty at the most, fill few nodes; so many trees, and fresh branchings of a node that goes deeper, that a pair
    at the similarity is missed with a chance of MISS at the most, a quarter of it by the filter and half before going deeper."""
    levels = min(8, max(1, math.ceil(math.log(max(1, n) / 32) / math.log(20)))) if n > 32 else 1
    least = trees = copies = 1
    while least < PLACES and sum(math.comb(PLACES, k) * similarity**k * (1 - similarity) ** (PLACES - k) for k in range(least + 1)) <= MISS / 4:
        least += 1
    while missed(similarity, least, trees, levels) > MISS / 2:
        trees += 1
    while missed(similarity, least, trees, levels, copies) > MISS:
        copies += 1
    return least, trees, levels, copies


def first_nodes(reps: DataFrame, trees: int, levels: int) -> DataFrame:
    """p, id: the nodes of every representative on the first level that is looked at, in all trees."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sketch = _sketch(batch)
            ids = batch.column("id").to_numpy()
            who, where = [], []
            for tree in range(trees):
                member, node = np.arange(len(ids)), np.full(len(ids), _mix(np.array([tree + 1], np.uint64))[0])
                for _ in range(levels):
                    at, node = branch(node, sketch[member])
                    member = member[at]
                both = np.unique(np.stack([member.astype(np.uint64), node]), axis=1)
                who.append(ids[both[0].astype(int)])
                where.append(both[1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(where).view(np.int64)), pa.array(np.concatenate(who))], ["p", "id"])

        return one

    return map_batches(reps.select("id", "s", "upper"), make, "p long, id long")


def next_nodes(rows: DataFrame, reps: DataFrame, copies: int) -> DataFrame:
    """p, id one level further down, from rows with p and id, each node branched independently so many times."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sketch = _sketch(batch)
            nodes = batch.column("p").to_numpy().view(np.uint64)
            member, node = (np.concatenate(c) for c in zip(*(branch(nodes ^ _mix(np.array([k], np.uint64)), sketch) for k in range(copies))))
            return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("id").take(pa.array(member))], ["p", "id"])

        return one

    return map_batches(rows.select("p", "id").join(reps.select("id", "s", "upper"), "id"), make, "p long, id long").distinct()


def runs(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Calls work on batches cut so that no run of equal g is split; g is sorted. A batch's last run may go on in the next one."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held and (out := work(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        if held and held[-1].column("g")[-1].as_py() != g[0]:
            yield from flush()
        other = np.flatnonzero(g != g[-1])
        if len(other):
            last = int(other[-1]) + 1
            held.append(batch.slice(0, last))
            yield from flush()
            batch = batch.slice(last)
        held.append(batch)
    yield from flush()


def _groups(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and short sketches of a table, and where its runs of g begin and end."""
    g = t.column("g").to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
    return t.column("id").to_numpy(), _bytes(t, "s"), cuts[:-1], cuts[1:]


def forests(rows: DataFrame, least: int) -> DataFrame:
    """From rows (g, p, id, s): p, a, b and e, the equal places of s, of each member b's most similar earlier member a within
    its g; and a row with a and b null for a g with further candidates."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        ids, s, begin, end = _groups(t)
        p = t.column("p").to_numpy()
        pair = begin[end - begin == 2]  # most groups are pairs: all at once
        e = (s[pair] == s[pair + 1]).sum(axis=1)
        pair, e = pair[(e >= least) & (ids[pair] != ids[pair + 1])], e[(e >= least) & (ids[pair] != ids[pair + 1])]
        out = [np.stack([p[pair], np.minimum(ids[pair], ids[pair + 1]), np.maximum(ids[pair], ids[pair + 1]), e])]
        more: list[int] = []
        for lo, hi in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist()):
            order = lo + np.argsort(ids[lo:hi], kind="stable")
            own, sketch = ids[order], s[order]
            extra = False
            for at in range(0, hi - lo, NODE):  # a block of members against all before them
                to = min(hi - lo, at + NODE)
                e = (sketch[at:to, None] == sketch[None, :to]).sum(axis=2, dtype=np.int16)
                e[np.arange(to)[None, :] >= np.arange(at, to)[:, None]] = 0
                a = e.argmax(axis=1)
                b = np.flatnonzero(e[np.arange(to - at), a] >= least)
                out.append(np.stack([np.full(len(b), p[lo]), own[a[b]], own[at + b], e[b, a[b]].astype(np.int64)]))
                extra = extra or int((e >= least).sum()) > len(b)
            if extra:
                more.append(p[lo])
        node, a, b, e = np.concatenate(out, axis=1).astype(np.int64)
        nulls = pa.nulls(len(more), pa.int64())
        columns = [pa.concat_arrays([pa.array(x), y]) for x, y in zip((node, a, b, e), (pa.array(more, pa.int64()), nulls, nulls, nulls))]
        return pa.RecordBatch.from_arrays(columns, ["p", "a", "b", "e"]) if len(columns[0]) else None

    return map_arrow(rows.repartition("g").sortWithinPartitions("g"), lambda batches: runs(batches, work), "p long, a long, b long, e long")


def _crossing(s: np.ndarray, part: np.ndarray, minor: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one group, each minor member with the members of other parts that its sketch is like; a pair of minors once."""
    for i in np.flatnonzero(minor):
        like = (part != part[i]) & ~(minor & (np.arange(len(part)) < i))
        at = np.flatnonzero(like)
        at = at[(s[at] == s[i]).sum(axis=1) >= least]
        if len(at):
            yield int(i), at


def involved(rows: DataFrame, least: int) -> DataFrame:
    """From rows (g, id, part, minor, s): g, id and part of those that are in any candidate pair across parts within their g, and
    head, the first row's id of those that such pairs connect there. Rows, not pairs."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        ids, s, begin, end = _groups(t)
        g, part, minor = t.column("g").to_numpy(), t.column("part").to_numpy(), t.column("minor").to_numpy(zero_copy_only=False)
        out = []
        for lo, hi in zip(begin.tolist(), end.tolist()):
            head, paired = np.arange(hi - lo), np.zeros(hi - lo, bool)
            for i, at in _crossing(s[lo:hi], part[lo:hi], minor[lo:hi], least):
                at = np.append(at, i)
                paired[at] = True
                same = np.zeros(hi - lo, bool)
                same[head[at]] = True
                head[same[head]] = head[at].min()
            at = lo + np.flatnonzero(paired)
            out.append(np.stack([g[at], ids[at], part[at], ids[lo + head[at - lo]]]))
        found = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["g", "id", "part", "head"]) if found.size else None

    return map_arrow(rows.repartition("g").sortWithinPartitions("g"), lambda batches: runs(batches, work), "g long, id long, part long, head long")


def gathered(met: DataFrame) -> DataFrame:
    """From rows (g, id, part, head) of involved, rows (g, id, part) in which every candidate pair shares a g.

    A family of similar texts meets in many nodes, in each with other members. Twice, what candidate pairs connect in a node takes
    the least name that its members have anywhere. What then has one name is one group if it has no more than 16 * NODE
    members, so that most sets are shuffled once; larger ones keep their nodes' groups.
    """
    rows = met.withColumn("family", F.col("head"))
    for _ in range(2):
        for keys in (["id"], ["g", "head"]):
            rows = rows.withColumn("family", F.min("family").over(Window.partitionBy(*keys)))
    rows = stored(rows, "families")
    large = rows.select("family", "id").distinct().groupBy("family").agg(F.count("*").alias("c")).where(F.col("c") > 16 * NODE)
    rows = rows.join(large, "family", "left")
    return rows.select(F.when(F.col("c").isNull(), F.xxhash64("family")).otherwise(F.xxhash64("g", "head")).alias("g"), "id", "part").distinct()


def meet(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of ascending distinct numbers."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def joined_parts(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """From rows (g, id, part, s, set): links a, b confirmed on the full sets that join parts within their g. Pairs of
    parts that have been joined are not looked at again, so there are fewer links than rows."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        ids, s, begin, end = _groups(t)
        part = t.column("part").to_numpy().copy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        out = []
        for lo, hi in zip(begin.tolist(), end.tolist()):
            own = part[lo:hi]
            parts, k = np.unique(own, return_counts=True)
            for i, at in _crossing(s[lo:hi], own.copy(), own != parts[k.argmax()], least):
                like = (s[lo + at] == s[lo + i]).sum(axis=1)
                for j in at[np.argsort(-like, kind="stable")]:
                    if own[j] != own[i] and meet(sets[lo + i], sets[lo + j], percent):
                        out.append((ids[lo + i], ids[lo + j]))
                        own[own == own[j]] = own[i]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"]) if out else None

    return map_arrow(rows.repartition("g").sortWithinPartitions("g"), lambda batches: runs(batches, work), "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The rows of ids, which have an id and a class digest d of representatives, with set, the full set of shingle hashes.

    A bit map of FILTER_BITS hashed ids, a bounded size whatever the input, keeps most other texts from being handled and all texts
    from being shuffled; what passes it is joined to the ids. Of several rows with one id, those count whose set has the digest.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words_of_map = ids.select(F.floor(bit / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    held = words_of_map.toArrow()  # at most FILTER_BITS / 32 rows
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[held.column("w").to_numpy()] = held.column("m").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def make():
        own, bits = tool(Shingles, words), np.frombuffer(shared.value, np.uint32)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            b = batch.column("b").to_numpy()
            batch = batch.filter(pa.array((bits[b // 32] >> (b % 32).astype(np.uint32)) & np.uint32(1)).cast(pa.bool_()))
            sets = [own.of(t).tobytes() for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["id", "d", "set"])

        return one

    found = map_batches(docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text").withColumn("b", bit), make, "id long, d binary, set binary")
    return found.join(ids, ["id", "d"]).drop("d")


def confirmed(docs: DataFrame, best: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs a, b of best, which has one a for each b, whose full sets meet in at least percent of their union.

    The b of one a are a star. A set goes once to the star of its a, and once to its own star if it is an a itself; no pair of
    sets is ever shuffled, and a task holds the sets of one a. A member has one a in each of its nodes or chunks of at most
    NODE members, so a star has at most NODE members for each node that its a is in.
    """
    heads = best.select(F.col("a").alias("id")).distinct().withColumn("head", F.lit(True))
    asked = best.select(F.col("b").alias("id"), "a").join(heads, "id", "full_outer")
    wanted = stored(reps.select("id", "d").join(asked, "id"), "wanted")
    stars = F.array_compact(F.array(F.when(F.col("head"), F.col("id")), F.col("a")))
    rows = full_sets(docs, wanted, words).withColumn("g", F.explode(stars)).select("g", "id", (F.col("id") != F.col("g")).alias("member"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for g, i, member, held in zip(*(batch.column(c).to_pylist() for c in ("g", "id", "member")), batch.column("set")):
                if g != at:
                    at, sets = g, []
                one = np.frombuffer(held.as_buffer(), np.uint64)
                if not member:
                    sets.append(one.copy())  # rows with one id and other texts are several a
                elif any(meet(x, one, percent) for x in sets):
                    found.append((g, i))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return map_arrow(rows.repartition("g").sortWithinPartitions("g", "member"), run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row: groups of texts linked by similar sets of word shingles.

    Words are runs of other characters than ASCII white space, A-Z lower-cased. A text of fewer words than a shingle is one
    shingle; without words (or null) it is empty and linked with nothing. Links are confirmed on the full sets of 64-bit shingle
    hashes; a pair at the threshold is found with a chance of 1 - MISS at least, also in nodes that branch all further levels. component_id is the smallest id of the
    component; rows with a null id stay alone, and repeated ids belong to the components of all their rows.
    """
    every = stored(sketches(docs, words), "sketches")
    whole = every.where("d is not null and doc_id is not null")
    reps = stored(whole.groupBy("d").agg(F.min("doc_id").alias("id"), F.first("s").alias("s"), F.first("upper").alias("upper")), "classes")
    rows = stored(every.select("doc_id", "n", "d"), "rows")
    dropped(every)
    least, trees, levels, copies = forest_size(reps.count(), percent / 100)
    every = stored(first_nodes(reps, trees, levels), "nodes")
    sizes = every.groupBy("p").agg(F.count("*").alias("c")).where("c > 1")
    nodes = shared = stored(every.join(sizes, "p"), "shared")
    dropped(every)
    # of the small nodes with the same members (by two 64-bit marks), of which the trees have many, one is looked at
    marks = nodes.where(F.col("c") <= NODE).groupBy("p", "c").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    once = marks.groupBy("c", "x", "y").agg(F.min("p").alias("p")).select("p")
    nodes = stored(nodes.where(F.col("c") > NODE).unionByName(nodes.where(F.col("c") <= NODE).join(once, "p").select(nodes.columns)), "once")
    dropped(shared)

    # forests of the most similar pairs, in nodes or chunks of nodes; each member's best pair is confirmed
    chunk = F.pmod(F.xxhash64("id", "p"), F.ceil(F.col("c") / NODE))
    short = reps.select("id", "s")
    proposed = stored(forests(nodes.select(F.xxhash64("p", chunk).alias("g"), "p", "id").join(short, "id"), least), "proposed")
    best = stored(proposed.where("b is not null").groupBy("b").agg(F.max_by("a", F.struct("e", "a")).alias("a")).where("a <> b"), "best")
    links = stored(confirmed(docs, best, reps, words, percent), "links")
    parts = connected(links)

    # nodes whose candidates lie across components, and large nodes: what joins components there
    named = proposed.join(parts.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(parts.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    apart = named.where(F.col("b").isNull() | (F.coalesce("ca", "a") != F.coalesce("cb", "b"))).select("p")
    front = nodes.where(F.col("c") > NODE).select("p", "id").union(nodes.where(F.col("c") <= NODE).select("p", "id").join(apart.distinct(), "p", "left_semi"))
    sets = None
    for level in range(MORE_LEVELS + 1):
        parted = front.join(parts, "id", "left").select("p", "id", F.coalesce("component", "id").alias("part"))
        counts = parted.groupBy("p", "part").agg(F.count("*").alias("k"))
        stats = counts.groupBy("p").agg(F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("q"), F.max_by("part", F.struct("k", "part")).alias("main"))
        stats = stats.where("c * c > q").withColumn("go", ((F.col("c") * F.col("c") - F.col("q")) / 2 <= ACROSS * F.col("c")) | F.lit(level == MORE_LEVELS))
        state = stored(parted.join(stats, "p"), "across")
        # the minor members of a large node meet every chunk of it
        now = state.where("go").withColumn("minor", F.col("part") != F.col("main")).withColumn("chunks", F.ceil(F.col("c") / (16 * NODE)))
        mine = F.pmod(F.xxhash64("id", "p"), F.col("chunks"))
        spread = now.withColumn("chunk", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(mine))))
        met = stored(involved(spread.select(F.xxhash64("p", "chunk").alias("g"), "id", "part", "minor").join(short, "id"), least), "involved")
        if not met.isEmpty():
            more = met.select("id").distinct() if sets is None else met.select("id").distinct().join(sets.select("id"), "id", "left_anti")
            new = stored(full_sets(docs, stored(reps.select("id", "d", "s").join(more, "id"), "wanted"), words), "sets")
            sets = new if sets is None else sets.unionByName(new)
            new = stored(joined_parts(gathered(met).join(sets, "id"), least, percent), "links")
            if not new.isEmpty():
                links = links.unionByName(new)
                parts = connected(links)
        deeper = state.where("not go")
        if level == MORE_LEVELS or deeper.isEmpty():
            break
        front = stored(next_nodes(deeper, reps, copies if level == 0 else 1), "front")

    part_of = reps.select("d", "id").join(parts, "id", "left").select(F.col("d").alias("_d"), F.coalesce("component", "id").alias("component"))
    part = F.coalesce("component", "doc_id")
    out = rows.select("doc_id", "n", "d").join(part_of, F.col("d") == F.col("_d"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), part.alias("component_id"), F.coalesce(part == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that stand for their component. Rows with a null id stay."""
    gone = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.col("doc_id").alias("_doc"), F.struct("*").alias("row"))  # no column's name can clash
    return rows.join(gone, F.col("_doc") == F.col("_gone"), "left_anti").select("row.*")
