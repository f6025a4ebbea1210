"""DataFrame operators, sources, sinks and streams on small fixtures."""

import json
import struct

from pyspark.sql import functions as F

from basaltic.functions import routing, text
from basaltic.operators import control, dedupe, names, paths, records, summary, timeline
from basaltic.sources import binary, files
from basaltic.streaming import status

DUMP = """banner
// 00401000
void NamedFunc(int param_1)
{ }

// 00401100
undefined8 FUN_00401100(void)
{ }

// ram:00408abc
void __thiscall A::B::method(A::B *this,int p)
{ }

// 0050ffff
int TArray<int>::Add(int p)
{ }
// Total: 4 functions decompiled, 0 errors
lost
"""


def lines(spark, text):
    return records.numbered_lines(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text")


def test_split(spark):
    split = records.split_records(lines(spark, DUMP), "file")
    found = records.functions_of(records.record_metrics(split, "file")).orderBy("record").collect()
    assert [r.address for r in found] == ["0x00401000", "0x00401100", "0x00408abc", "0x0050ffff"]
    assert [r.is_named for r in found] == [True, False, True, True]
    assert found[0].lines == 4 and found[0].size_bytes == sum(len(x) + 1 for x in ("// 00401000", "void NamedFunc(int param_1)", "{ }", ""))
    bodies = records.bodies_of(split, "file").orderBy("record").collect()
    assert bodies[3].body == "int TArray<int>::Add(int p)\n{ }"


def test_names(spark):
    refs = spark.createDataFrame([("1", "UPlayer::Jump"), ("1", "UPlayer::Jump"), ("1", "some log"), ("3", "a::x"), ("3", "b::y"), ("4", "none")], "address string, s string")
    got = names.single_name(refs, "address", "s")
    assert [tuple(r) for r in got.collect()] == [("1", "UPlayer::Jump")]
    symbols = spark.createDataFrame([("1", "FUN_1"), ("2", "Already::Named")], "address string, name string")
    assert sorted(r.final for r in names.overlaid(symbols, "address", "name", got, "final").collect()) == ["Already::Named", "UPlayer::Jump"]
    claims = spark.createDataFrame([(2, "n", "b"), (1, "n", "a"), (3, "m", "c")], "pos int, name string, address string")
    assert sorted(r.address for r in names.first_claims(claims, "name", "pos").collect()) == ["a", "c"]
    edges = spark.createDataFrame([("FUN_140002000",), ("vinsertps_avx",), ("Other::Method",), ("memcpy",), ("switchD_1::caseD_6",), ("caseD_6",)], "callee string")
    known = spark.createDataFrame([("memcpy",), ("memcpy",)], "n string")
    assert sorted(r.callee for r in names.real_callees(edges, "callee", known).collect()) == ["FUN_140002000", "Other::Method", "memcpy"]


def test_prefix_lookup_has_no_phantoms(spark):
    asked = spark.createDataFrame([("AMyPawn",), ("UMyComponent",), ("Helper",), ("FUnrelated",), ("Apple",), ("pple",)], "n string")
    have = spark.createDataFrame([("MyPawn",), ("MyComponent",), ("Helper",), ("MyActor",), ("Apple",)], "e string")
    assert sorted(r.n for r in names.prefix_lookup(asked, "n", have, "e").where("matched is not null").collect()) == ["AMyPawn", "Apple", "Helper", "UMyComponent"]


def test_dedupe(spark):
    rows = spark.createDataFrame([(1, "x FUN_11"), (2, "x FUN_22"), (3, "y"), (4, None)], "pos int, b string").withColumn("name", F.lit("n"))
    from basaltic.functions.symbols import normal_body

    assert tuple(dedupe.duplicate_totals(rows, normal_body(F.col("b"))).first()) == (3, 2, 1, 1)
    group = dedupe.duplicate_groups(rows, normal_body(F.col("b")), "pos", "name").collect()
    assert [(g.canonical, g["count"], g.truncated) for g in group] == [(1, 2, False)]
    assert tuple(dedupe.duplicate_totals(rows.limit(0), F.col("b")).first()) == (0, 0, 0, 0)
    listed = dedupe.listed_members(rows, normal_body(F.col("b")), "pos", "name").collect()
    assert [(r.canonical, [m.position for m in r.members]) for r in listed] == [(1, [2])]


def test_paths(spark):
    roots = lambda *p: spark.createDataFrame([(x,) for x in p], "root string")
    top = lambda *p: sorted(r.root for r in paths.topmost(roots(*p), "root").collect())
    assert top("a/b", "a/b/c", "A/B/d", "e") == ["a/b", "e"] and top("a") == ["a"]
    builds = lambda *p: sorted(r.root for r in paths.without_nested_builds(roots(*p), "root").collect())
    assert builds("c/client", "c/Builds/x", "c/Rebuilds") == ["c/Rebuilds", "c/client"] and builds("c/builds/x", "d/Builds") == ["c/builds/x", "d/Builds"]
    items = spark.createDataFrame([("a/b/c/f.pak",), ("a/f.pak",), ("z/f",)], "p string")
    assert sorted((r.p, r.root) for r in paths.nearest_root(items, "p", roots("a", "a/b"), "root").collect()) == [("a/b/c/f.pak", "a/b"), ("a/f.pak", "a")]
    f = spark.createDataFrame([("g", "x.ucas", 9), ("g", "b.pak", 5), ("g", "a.pak", 5), ("h", "z.utoc", 1)], "k string, p string, s long")
    assert {r.k: r.representative for r in paths.representative(f, "k", "p", "s", ".pak").collect()} == {"g": "a.pak", "h": "z.utoc"}


def test_mangled_and_obfuscators(spark):
    letters = [chr(97 + i) for i in range(26)] + [f"a{chr(97 + i)}" for i in range(26)] + ["PublicApi", "", "<Module>"]
    df = spark.createDataFrame([("bad", n) for n in letters] + [("good", f"Readable{i}") for i in range(20)], "k string, n string")
    got = {r.k: (r.total, r.flagged) for r in routing.mangled_ratio(df, "k", "n").collect()}
    assert got == {"bad": (53, True), "good": (20, False)}
    s = spark.createDataFrame([("f", 2, "Babel"), ("f", 1, "x Confuser .Protect"), ("g", 1, "none")], "k string, pos int, s string")
    assert [tuple(r) for r in routing.first_obfuscator(s, "k", "pos", "s").collect()] == [("f", "Confuser")]


def test_summaries(spark):
    rows = spark.createDataFrame([("Native", "native", False, False), ("Managed", None, True, True), ("Native", "native", False, True)], "k string, r string, s boolean, e boolean")
    got = summary.run_summary(rows, F.col("s"), F.col("e"), F.col("k"), F.col("r")).first()
    assert (got.total, got.skipped, got.failed, got.success, got.by_kind, got.by_recipe) == (3, 1, 1, 1, {"Managed": 1, "Native": 2}, {"native": 2})
    docs = spark.createDataFrame([("a.c", "one line here, yes\n"), ("sub/b.cpp", "1\n2\n3\n"), ("a.c", "one line here, yes\n")], "p string, c string")
    assert tuple(summary.file_index(docs, "p", "c").first()) == (2, 25, 4)
    versions = spark.createDataFrame([("net8.0",), ("net10.0",), ("netstandard2.0",)], "n string")
    assert summary.highest_framework(versions, "n").first()[0] == "10.0" and summary.highest_framework(versions.limit(0), "n").first()[0] == "10.0"
    assert "total" in files.document(rows.agg(F.count("*").alias("total")))


#: Committed vectors of the cipher: magic number, UTF-16 units in hex and the text, with their key.
KEY = "8CE0E84420AA8860E1E6A18400821090"
VECTORS = [(62686, "F4AEF4BFF4ADF4ADF4A9F4B1F4ACF4BA", "password"), (61582, "F0D7F0EDF0DFF0FDF0EAF0F7F0E8F0FB", "IsActive"), (63036, "F67DF658F658F64EF659F64FF64F", "Address"), (61695, "F0ACF08BF09EF08BF08AF08C", "Status"), (59965, "EACDEAD0EACAEACBEADA", "route"), (60941, "EEE9EEE6EEE3EEEAEEDBEEF6EEFFEEEA", "fileType"), (57621, "E1F1E1DAE1D8E1D0E1CBE1D6E1DEE1CBE1DA", "Negotiate")]


def test_cipher_arithmetic(spark):
    rows = [(m, [int(h[i : i + 4], 16) for i in range(0, len(h), 4)], t) for m, h, t in VECTORS]
    df = spark.createDataFrame(rows, "magic int, units array<int>, plain string")
    key = lambda k: F.array(*map(F.lit, k))
    good = list(bytes.fromhex(KEY))
    decoded = df.withColumn("t", summary.xor_decoded(F.col("units"), key(good), F.col("magic")))
    assert all(r.t == r.plain for r in decoded.collect())
    assert tuple(summary.agreement(decoded, "magic", "t", 16).first()) == (1.0, True)


def test_key_scores(spark):
    units = spark.createDataFrame([(0, ord(c) ^ 0x41) for c in "plain text"], "g int, u int")
    best = summary.key_scores(units, "g", "u").first()
    assert best.score == 20 and all(32 <= (ord(c) ^ 0x41 ^ best.kb) < 127 for c in "plain text")


def catalogue_bytes(body_names=("MyActor", "Health", "Actor", "E", "A"), method=0):
    n = b"".join(struct.pack("<H", len(x)) + x.encode() for x in body_names)
    enums = struct.pack("<I", 1) + struct.pack("<iH", 3, 1) + struct.pack("<Qi", 7, 4)
    prop = struct.pack("<HBi", 0, 1, 1) + bytes([24, 5, 8]) + bytes([9]) + struct.pack("<i", 2)  # map of name to array of a struct
    structs = struct.pack("<I", 1) + struct.pack("<iiHH", 0, -1, 1, 1) + prop
    body = struct.pack("<I", len(body_names)) + n + enums + structs
    packed = body
    if method == 3:
        import zstandard

        packed = zstandard.ZstdCompressor().compress(body)
    return struct.pack("<HBI", 0x30C4, 4, 0) + bytes([method]) + struct.pack("<II", len(packed), len(body)) + packed


def test_catalogues(spark):
    good = catalogue_bytes()
    rows = [("a", good), ("z", catalogue_bytes(method=3)), ("magic", b"\0\0" + good[2:]), ("version", good[:2] + b"\xff" + good[3:]), ("size", good[:12] + b"\xff\xff\xff\xff" + good[16:]), ("cut", good[:-3]), ("oodle", good[:7] + b"\x01" + good[8:]), ("none", None)]
    got = {r.path: r for r in binary.parse_catalogues(spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")).collect()}
    for p in ("a", "z"):
        assert got[p].error is None and got[p].structs[0].name == "MyActor" and got[p].structs[0].super == ""
        assert got[p].structs[0].properties[0].cpp_type == "TMap<FName, TArray<FActor>>" and got[p].enums[0]["values"][0].value == 7
    assert all(got[p].error for p in ("magic", "version", "size", "cut", "oodle", "none"))


def test_assets_and_heaps(spark):
    name = lambda s: struct.pack("<i", len(s) + 1) + s.encode() + b"\0" + b"\0\0\0\0"
    head = struct.pack("<I", 0x9E2A83C1) + struct.pack("<iiii", -7, 0, 0, 0) + struct.pack("<iiiI", 0, 0, 0, 0) + struct.pack("<ii", 2, 0x34) + b"\0" * 8
    good = head + name("MyClass") + name("MyProperty")
    rows = [("a", good), ("cut", good[:20]), ("junk", b"\x01" * 100)]
    got = {r.path: r for r in binary.parse_assets(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert got["a"].names == ["MyClass", "MyProperty"] and got["a"].total_names == 2 and got["cut"].error and got["junk"].error
    entry = lambda s: bytes([len(s) * 2 + 1]) + s.encode("utf-16-le") + b"\0"
    assert list(binary.user_strings(b"\0" + entry("ab") + entry(""))) == ["ab", ""] and list(binary.user_strings(b"\0\xff")) == []
    assert binary.heap_string(b"\0abc\0", 1) == "abc" and binary.heap_string(b"", 5) == ""


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    for n in ("a.DLL", "sub/b.pak", "sub/c.txt"):
        (tmp_path / "t" / n).write_bytes(b"x\ny")
    found = {r.path.rsplit("/", 1)[1]: r.container for r in files.scan(spark, str(tmp_path / "t")).collect()}
    assert found == {"a.DLL": False, "b.pak": True}
    (tmp_path / "n.json").write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_ndjson(spark, str(tmp_path / "n.json"), "a int").collect()) == [1, 2]
    (tmp_path / "n.csv").write_text('x,y,z\n1,"a\nb",c\nshort,row\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "n.csv"), "x string, y string, z string").collect()] == [("1", "a\nb", "c")]
    (tmp_path / "d.json").write_text(json.dumps({"a": [1, 2]}, indent=2))
    assert files.read_document(spark, str(tmp_path / "d.json"), "a array<int>").first().a == [1, 2]
    assert [(r.n, r.line) for r in files.read_lines(spark, str(tmp_path / "t/a.DLL")).orderBy("n").collect()] == [(0, "x"), (1, "y")]
    df = spark.createDataFrame([(2, "b\tc"), (1, "a")], "magic int, plain string")
    files.write_tsv(df, str(tmp_path / "out"), "magic")
    files.write_tsv(df, str(tmp_path / "out"), "magic")  # replaces, never appends
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert files.replaced(df, str(tmp_path / "versions")).count() == 2
    tree = spark.createDataFrame([("b/x.usmap",), ("a/z.usmap",), ("a/y.usmap",)], "p string")
    assert files.first_match(tree, "p", F.col("p").endswith(".usmap"), ["c", "a", "b"]).first().p == "a/y.usmap"


def test_timeline(spark):
    rows = [("r", i, p, t) for i, (p, t) in enumerate([("scan", "a"), ("skip", ""), ("install", ""), ("execute", "b"), ("skip", "")])]
    df = spark.createDataFrame(rows, "run string, n int, phase string, target string")
    got = timeline.carried(df.withColumn("s", F.coalesce(timeline.mapped_stage(F.col("phase")), F.lit(""))), "run", ["n"], F.col("s"), "stage").orderBy("n").collect()
    assert [r.stage for r in got] == ["analysis", "analysis", "tools", "execute", "execute"]
    ops = spark.createDataFrame([("m", i, o) for i, o in enumerate(["ldsfld", "x", "and", "xor", "ldsfld", "xor", "and"])], "m string, n int, o string")
    assert [r.n for r in timeline.tight_pattern(ops, "m", "n", "o", "ldsfld", ("and", "xor"), 4).collect()] == [0]


def test_stream_in_batches(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k, events in enumerate([[(1, 1, "scan", "a", 5)], [(1, 2, "skip", "", 0), (2, 1, "execute", "z", 0)], [(1, 3, "done", "", 0)]]):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("run", "position", "phase", "target", "files_total"), e))) for e in events))
    events = status.event_source(spark, str(source), "run long, position long, phase string, target string, files_total long")
    seen = []
    query = status.fold_status(events).writeStream.outputMode("update").option("checkpointLocation", str(out)).foreachBatch(lambda b, n: seen.extend(b.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r.run: tuple(r)[1:] for r in sorted(seen, key=lambda r: r.events)}
    assert last == {1: ("done", "a", 5, "done", 3), 2: ("execute", "z", 0, "execute", 1)}


def test_rolled_counts_anew_in_each_file(spark):
    rows = spark.createDataFrame([("a", i, 1_000_000) for i in range(4)] + [("b", 0, 5_000_000), ("b", 1, None), (None, 0, 1)], "bucket string, pos int, size long")
    got = {(r.bucket, r.pos): r.file for r in control.rolled(rows, "bucket", "pos", "size").collect()}
    assert [got["a", i] for i in range(4)] == [0, 0, 1, 1] and (got["b", 0], got["b", 1], got[None, 0]) == (0, 1, 0)


def test_changes_measure_from_the_last_row_shown(spark):
    rows = spark.createDataFrame([("k", i, 7.2, 0.4 * i) for i in range(7)] + [("z", 0, 100.0, 0.0), ("z", 1, 100.0, 0.1)], "key string, pos int, percent double, at double")
    got = timeline.changes(rows, "key", ["pos"], F.col("percent"), F.col("at")).collect()
    assert sorted((r.key, r.pos) for r in got) == [("k", 0), ("k", 3), ("k", 6), ("z", 0), ("z", 1)]


def test_type_list(spark):
    listing = ["ilspycmd: 8.2.0", "ICSharpCode.Decompiler: 8.2", "", "  Class Foo.Bar  ", "Struct A.B C", "Class <Module>", "Class Foo/<>c", "Lone", "//x y"]
    rows = spark.createDataFrame([(x,) for x in listing], "line string")
    assert [r.name for r in control.type_list(rows, "line").collect()] == ["Foo.Bar", "A.B C", "Lone", "y"]


def test_required_tools_by_first_need(spark):
    registry = control.Registry()
    registry.register(control.Recipe("one", lambda: F.col("kind") == 1, lambda d: d, ("ghidra", "diec")))
    registry.register(control.Recipe("two", lambda: F.col("kind") == 2, lambda d: d, ("retoc",), shown=("strings", "retoc")))
    routed = registry.route(spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "pos int, kind int"))
    tools = control.tool_table(spark)
    assert [(r.tool, r.place) for r in control.required(routed, registry.requirements(spark), tools, "pos").collect()] == [("retoc", 1), ("ghidra", 2), ("diec", 3)]
    assert [r.tool for r in control.required(routed, registry.requirements(spark, shown=True), tools, "pos").collect()] == ["strings", "retoc", "ghidra", "diec"]


def test_matched_assets(spark):
    rows = spark.createDataFrame([(1, "tool-x64.zip"), (1, "Tool-X64-debug.zip"), (2, "My-TOOL-big-X64.ZIP"), (2, "x64-tool"), (None, "tool-a-x64.zip")], "release int, name string")
    assert sorted(r.name for r in text.matched_assets(rows, "release", "name", "tool-*x64.zip").collect()) == ["My-TOOL-big-X64.ZIP", "tool-a-x64.zip", "tool-x64.zip"]


def test_settings_are_typed_by_key(spark):
    rows = [("LogToFile", "yes", "true"), ("LogToFile", "YES", None), ("LogToFile", "0", "false"), ("DownloadRetries", "1", "1"), ("DownloadRetries", "1.5", None), ("OutputDir", "1", "1")]
    df = spark.createDataFrame(rows, "key string, value string, wanted string")
    assert all(r.got == r.wanted for r in df.select("wanted", text.typed_setting(F.col("key"), F.col("value"))["value"].alias("got")).collect())
