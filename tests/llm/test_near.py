"""Near-duplicate texts and vectors against brute force, and the pipeline."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from basaltic.llm import bpe_codec, cap_filters, chosen_paths, rule_ensemble, secrets, source_mix
from basaltic.llm.common import connected
from basaltic.session import shared_dir
from basaltic.sources.tables import table
from tests.conftest import DATA


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, words):
    w = (text or "").encode().lower().split()
    k = min(words, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, words, percent=80):
    """Links by an inverted index over all shingles."""
    sets = {i: shingle_set(t, words) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    links = []
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        links += [(j, i) for j, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    return sets, components(sets, links)


@pytest.mark.parametrize("words", [2, 5])
def test_near_texts(spark, words):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sets, wanted = brute([(r.doc_id, r.text) for r in docs.collect()], words)
    got = chosen_paths.near_duplicates(docs, words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), wanted[i], wanted[i] == i) for i, s in sets.items()}
    assert {r.doc_id for r in chosen_paths.deduplicated(docs, words).collect()} == {i for i in sets if wanted[i] == i}


def test_large_group_of_near_copies(spark, monkeypatch):
    """A group many times a node's size whose members differ at random, so that not all of them are linked."""
    monkeypatch.setattr(chosen_paths, "NODE", 16)
    monkeypatch.setattr(chosen_paths, "ACROSS", 8)
    rng = np.random.default_rng(8)
    first = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = list(first)
        for k in rng.choice(60, rng.integers(0, 8), replace=False):
            own[k] = f"x{rng.integers(1 << 30)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(50)]
    _, wanted = brute(rows, 2)
    got = chosen_paths.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == wanted


def test_pairs_of_a_large_templated_group(spark, monkeypatch):
    """Pairs just beyond the threshold among documents of a common template, so that nodes branch many further levels."""
    monkeypatch.setattr(chosen_paths, "NODE", 16)
    monkeypatch.setattr(chosen_paths, "ACROSS", 1)
    rows = []
    for i in range(300):
        own = [f"t{k}" for k in range(75)] + [f"p{i // 2}x{k}" for k in range(14)] + [f"d{i}x{k}" for k in range(11)]  # 89 of 111 within a pair, 75 of 125 else
        rows.append((i, " ".join(own)))
    got = chosen_paths.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(300)}


def test_pairs_survive_all_further_levels():
    """Sketches of pairs at the threshold: the filter and the trees, each node of which branches all further levels."""
    rng, n = np.random.default_rng(31), 3000
    a = rng.integers(0, 1 << 32, (n, chosen_paths.PLACES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a ^ np.uint32(1))
    least, trees, levels, copies = chosen_paths.forest_size(250_000, 0.8)
    found = np.zeros(n, bool)
    for tree in range(trees):
        who, node = np.arange(n), np.full(n, chosen_paths._mix(np.array([tree + 1], np.uint64))[0])
        for level in range(levels + chosen_paths.MORE_LEVELS):
            salts = [chosen_paths._mix(np.array([k], np.uint64)) for k in range(copies if level == levels else 1)]
            sides = [[chosen_paths.branch(node ^ salt, s[who]) for salt in salts] for s in (a, b)]
            kept = [(who[m[x == y]], x[x == y]) for (m, x), (_, y) in zip(*sides)]
            who, node = (np.concatenate(c) for c in zip(*kept))
        found[who] = True
    assert (found & ((a == b).sum(axis=1) >= least)).all()


def test_near_texts_odd_rows(spark):
    rows = [(5, None, 1), (4, "", 2), (3, " \n", 3), (9, "one", 4), (8, "ONE", 5), (7, "one two", 6), (7, "one two", 6), (None, "one two", 7), (None, None, 8), (2, "é" * 50_000 + " b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").selectExpr("*", "n AS d", "n AS id", "n AS component_id")
    got = sorted((tuple(r) for r in chosen_paths.near_duplicates(docs, 2).collect()), key=str)
    assert got == sorted([(5, 0, 5, True), (4, 0, 4, True), (3, 0, 3, True), (9, 1, 8, False), (8, 1, 8, True), (7, 1, 7, True), (7, 1, 7, True), (None, 1, 7, True), (None, 0, None, True), (2, 1, 2, True)], key=str)
    assert chosen_paths.near_duplicates(docs.limit(0), 2).count() == 0


def test_sets_of_a_family_are_shuffled_once(spark, monkeypatch):
    """Texts that are similar but not linked meet in nodes of many trees; their full sets go to one group each. Sketches are dropped."""
    seen = []
    real = chosen_paths.joined_parts
    monkeypatch.setattr(chosen_paths, "joined_parts", lambda rows, *rest: seen.extend(r.id for r in rows.select("id").collect()) or real(rows, *rest))
    at = Path(shared_dir(spark).removeprefix("file://")) / "basaltic"
    before = {p.name for p in at.glob("*")}
    rows = [(i * 100 + j, " ".join([f"f{i}x{k}" for k in range(87)] + [f"d{i}y{j}x{k}" for k in range(13)])) for i in range(4) for j in range(30)]  # 87 of 113
    got = chosen_paths.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert all(r.kept for r in got) and len(got) == len(rows)
    assert len(seen) > 60 and max(Counter(seen).values()) == 1
    assert not [p for p in at.glob("sketches-*") if p.name not in before]


@pytest.mark.parametrize("node", [1, 2])
def test_gathered(spark, monkeypatch, node):
    """A family of up to 16 * NODE members is one group, a larger one keeps its nodes' groups; all pairs of a group and head meet."""
    monkeypatch.setattr(chosen_paths, "NODE", node)
    star = [(g, i, i % 3, 0) for g in range(20) for i in (0, g + 1)]  # 21 members
    chain = [(200 + g, 200 + i, i % 3, 200 + g) for g in range(20) for i in (g, g + 1)]  # longer than names go
    met = [*star, *chain, *((100 + g, i, i, 50) for g in range(5) for i in (50, 51, 52 + g)), (7, 70, 1, 70), (7, 71, 2, 70)]
    got = [tuple(r) for r in chosen_paths.gathered(spark.createDataFrame(met, "g long, id long, part long, head long")).collect()]
    held = {}
    for g, i, part in got:
        held.setdefault(g, set()).add((i, part))
    wanted = {}
    for g, i, part, head in met:
        wanted.setdefault((g, head), set()).add((i, part))
    assert all(any(x <= y for y in held.values()) for x in wanted.values())
    assert len(got) == len(set(got)) and sum(i < 200 for _, i, _ in got) == (40 if node == 1 else 21) + 7 + 2


def test_superseded_tables_are_dropped(spark):
    """Nodes that a later table replaces, and all rounds of the components but the last, leave the shared folder."""
    at = Path(shared_dir(spark).removeprefix("file://")) / "basaltic"
    kinds = lambda: Counter(p.name.split("-")[0] for p in at.glob("*"))
    docs = spark.createDataFrame([(i, f"a b c d {i // 2}") for i in range(40)], "doc_id long, text string")
    before = kinds()
    assert chosen_paths.near_duplicates(docs, 2).where("kept").count() == 20
    new = kinds() - before
    assert new["once"] == 1 and not new["nodes"] and not new["shared"]
    before = kinds()
    assert connected(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")).where("component = 0").count() == 50
    assert (kinds() - before)["pairs"] == 1


def test_components(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(300)]
    links = [*chain, *((int(a), int(b)) for a, b in rng.integers(1000, 1600, (500, 2))), *((5000, 5000 + i) for i in range(1, 400)), (7, 7)]
    ids = {i for pair in links for i in pair}
    wanted = components(ids, links)
    got = {r.id: r.component for r in connected(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in ids} == wanted
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "TILE", 32)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 32))
    v[100:300] = v[0] + rng.normal(size=(200, 32)) * 0.25  # a large group, not all of it linked
    v[300:330] = v[1]
    v[330:400] = v[330] + rng.normal(size=(70, 32)) * rng.uniform(0, 0.6, (70, 1))
    rows = [(i, x.astype("f4").tolist(), int(i % 7 == 0)) for i, x in enumerate(v)]
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    hit = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(hit, False)
    wanted = components(range(600), np.argwhere(hit))
    got = {r.vec_id: r for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(hit[i].sum()), wanted[i]) for i in range(600)}


def test_vectors_go_to_cells_not_to_directions(spark, monkeypatch):
    """A vector is sent to a label's codes, not to each direction; cells of one label in parts and in tiles, a few pairs at once."""
    rng = np.random.default_rng(17)
    v = rng.normal(size=(900, 24))
    v[300:600] = v[:300] + rng.normal(size=(300, 24)) * rng.uniform(0, 0.5, (300, 1))
    v[700:] = v[700] + rng.normal(size=(200, 24)) * 0.2
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.93
    np.fill_diagonal(hit, False)
    wanted = components(range(900), np.argwhere(hit))
    made, stored = {}, cap_filters.map_arrow

    def seen(df, run, schema):
        made[tuple(schema.split())[0], "lists" in schema and "code" in schema] = out = stored(df, run, schema)
        return out

    monkeypatch.setattr(cap_filters, "map_arrow", seen)
    for cell in (1 << 17, 300, 60):
        monkeypatch.setattr(cap_filters, "CELL", cell)
        monkeypatch.setattr(cap_filters, "PAIRS", 500)
        got = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        assert got == {i: (int(hit[i].sum()), wanted[i]) for i in range(900)}
        if cell > 900:
            assert made["label", True].count() <= cap_filters.CODES * 900


def test_near_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, -0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "label AS id", "label AS n", "label AS v", "label AS d")
    got = cap_filters.near_vectors(df).collect()
    assert len(got) == len(rows)
    alone = {3, 4, 5, 6, 7, 8, 9, 10, 11, None}
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id in alone)
    assert all((r.n_links, r.component_id, r.kept) == (2, 1, r.vec_id == 1) for r in got if r.vec_id in (1, 2, 12))
    assert cap_filters.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_extreme_lengths(spark):
    """Squares that over- or underflow a double don't keep vectors from their links."""
    rows = [(k, [x * 0.6, x * 0.8], 1) for k, x in enumerate((1.0, 1e200, 1e-200, 1e308, 1e-310, -1e200))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 5: (0, 5)}


def test_recall_on_the_given_vectors(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").limit(4000).collect()
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    hit = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(hit, False)
    got = cap_filters.near_vectors(spark.createDataFrame(rows)).collect()
    assert sum(r.n_links for r in got) >= 0.999 * hit.sum()


@pytest.mark.parametrize(("dim", "n"), [(64, 100_000), (64, 3_000_000), (16, 300_000)])
def test_recall_at_the_threshold_of_large_plans(dim, n):
    """Fixed pairs at the cosine itself, decoded as in an input of n vectors of a label."""
    x, y = cap_filters.pairs_at(np.random.default_rng(21), 2000, dim, 0.93)
    plan = cap_filters.plan(n, dim, 0.93)
    lists = [cap_filters.decode(v, *plan) for v in (x, y)]
    assert all(len(np.intersect1d(a, b)) for a, b in zip(*lists)) and min(map(len, lists[0])) >= 16


def test_pipeline(spark):
    """Against a plain version: the model's scores, brute-force groups, each text's secrets, the mix of what is left."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "secret_scans", "source_mixing", "byte_bpe"]
    model = rule_ensemble.train(docs, labels)
    good = {r.doc_id for r in rule_ensemble.scored(docs, model).where("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    _, part = brute([(i, r.text) for i, r in rows.items()], 5)
    scanner = secrets.Scanner(secrets.BASE_RULES, secrets.ADDED_RULES)

    def clean(text):
        out, at = "", 0
        for a, k, b in scanner.spans([text])[0]:
            out += text[at:a] + f"[{scanner.rules[k][0]}]" if a >= at else ""
            at = max(at, b)
        return out + text[at:]

    kept = [(i, clean(r.text), r.lang, r.source, r.n_chars) for i, r in rows.items() if part[i] == i]
    mixed = source_mix.mix(spark.createDataFrame(kept, docs.schema)).collect()
    times = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in mixed}
    import public_tokenizers

    codec = bpe_codec.Codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    wanted = sorted((i, *codec.digest(t)) for i, t, *_ in kept for _ in range(times[i]))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == wanted
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_stages_on_odd_columns(spark):
    """Columns with the names that operators use inside, nulls, and no rows at all."""
    docs = table(spark, DATA, "documents").limit(30)
    for c in ("_doc", "_gone", "_id", "_times", "row", "stats", "_words", "part", "taken", "size", "s", "component_id"):
        docs = docs.selectExpr("*", f"'x' AS {c}")
    docs = docs.unionByName(docs.limit(1).selectExpr(*(f"cast(null as {t}) AS {c}" for c, t in docs.dtypes)))
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, DATA)
            assert name == "byte_bpe" or out.columns == docs.columns
            got, given = [r.doc_id for r in out.collect()], [r.doc_id for r in some.collect()]
            assert set(got) <= set(given) and (not given or got)
            if name in ("secret_scans", "byte_bpe"):
                assert sorted(got, key=str) == sorted(given, key=str)
            if name == "minhash_near_dedup":
                assert len(got) == len(set(got)) and (not given or None in got)
