"""Column expressions on rows written out here."""

import pytest
from pyspark.sql import functions as F

from basaltic.functions import routing, symbols, text
from basaltic.functions.globs import glob_pattern


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.select(column(F.col("c")).alias("v"), "i").orderBy("i").collect()]


NAMES = {
    "void NamedFunc(int param_1)": "NamedFunc",
    "undefined8 FUN_00401100(void)": "FUN_00401100",
    "void __thiscall A::B::method(A::B *this,int p)": "A::B::method",
    "int TArray<int>::Add(int p)": "TArray<int>::Add",
    "void *getptr(void)": "getptr",
    "int noparen": "",
    "undefined1 (*) [16]FUN_14000f3c0(longlong param_1,uint param_7)": "FUN_14000f3c0",
    "undefined1 (*) [32]Foo::Bar(longlong p)": "Foo::Bar",
    "undefined1(longlong param_1)": "",
}
OWNERS = {"A::operator->::b": "A::operator->", " A ::b": "A", "::b": "", "a>b::c": "a>b", "A::B::method": "A::B", "TArray<int>::Add": "TArray<int>", "plainfunc": "", "Foo::bar": "Foo", "NS::TMap<int,FString>::Find": "NS::TMap<int,FString>", "A<B<C::d>>::e": "A<B<C::d>>", "A<B<int>,C::d>": "", "": ""}
URLS = {
    "https://example.com/api?k=1&v=2 trailingGarbageGluedHere moreStuff": ["https://example.com/api?k=1&v=2"],
    "prefix https://first.test/a https://second.test/b suffix": ["https://first.test/a", "https://second.test/b"],
    "visit http://plain.example/path)now": ["http://plain.example/path"],
    "clean https://solo.example/ok.": ["https://solo.example/ok"],
    "none": ["none"],
}
NOISE = {"abc": True, "1.2,3": True, "<div>": True, "A" * 40: True, "A" * 39: False, ".html": True, "text/html": True, "\x01\x02\x03a": True, "plain words": False, "": True}


@pytest.mark.parametrize(
    "table, column",
    [
        (NAMES, symbols.function_name),
        (OWNERS, symbols.owner_class),
        (URLS, text.url_tokens),
        (NOISE, text.is_noise),
        ({"AActor": "Actor", "UObject": "Object", "FVector": "Vector", "Actor": "Actor", "alpha": "alpha", "U": "U"}, symbols.bare_type),
        ({"a": True, "ab": True, "a`1": True, "\ue001": True, "Id": False, "To": False, "GetUserAsync": False, "WebMapController": False}, symbols.is_mangled),
        ({"140001000": "001", "0x140001000": "001", "xyz": "000", "12": "000", "FFFFFFFFFFFFFFFF": "fff", "abc": "000"}, symbols.address_bucket),
        ({"TArray<int>": True, "UObject": True, "BWeapon": False, "std::string": True, "APlayerCharacter": False}, symbols.is_boilerplate),
        ({"x = FUN_00401000; DAT_1g": "x = <SYM>; <SYM>g", "aFUN_12": "aFUN_12", "FUN_zz": "FUN_zz"}, symbols.normal_body),
        ({"UFoo::Bar": True, "hello": False, "%d": False, "A::~B": True, "A::": False, "A::b\n": False}, symbols.is_qualified),
        ({"switchD_1::caseD_6": False, "FUN_1": True, "Other::Method": True, "memcpy": None, "caseD_6": False}, symbols.real_callee_rule),
        ({"v1.2": "1.2", "Ghidra_12.1_build": "12.1", "Ghidra_12.1": "12.1", "Tool_11.2_build": "Tool_11.2_build", "latest": "", "Latest": "", "releases": "", "V3": "3", "vV3": "3"}, text.clean_tag),
        ({'java "21.0.1" x\n"9"': "21.0.1", "none": ""}, text.banner_version),
        ({"a\tb\r\n": "a\\tb\\r\\n"}, text.tab_escaped),
        ({"Reading stopped: i/o timeout": True, "not found": False, "failed to loadSystemRoots: exit status 0x80072EE2": True, "Timed Out": True, "context deadline exceeded": True, "connection reset by peer": False, "temporary failure": False}, text.is_transient),
        ({"password": True, "": True, "a\ue001b": False, "a\x01": False}, text.is_meaningful),
    ],
)
def test_table(spark, table, column):
    assert values(spark, list(table), column) == list(table.values())


def test_references(spark):
    body = 'void Engine::Widget::Tick() {\n  // note(x)\n  puts("hello world"); FUN_140002000(1); FUN_140002000(2);\n  Other::Helper(x,"second string"); if (a) return(b);\n  ZEXT416(c); CONCAT44(d); undefined1(e); "";\n}'
    df = spark.createDataFrame([(body,)], "b string")
    row = df.select(symbols.string_literals(F.col("b")).alias("s"), symbols.call_sites(F.col("b"), F.lit("Engine::Widget::Tick")).alias("c")).first()
    assert row.s == ["hello world", "second string"]
    assert row.c == ["puts", "FUN_140002000", "Other::Helper"]


def test_categories(spark):
    rows = ["https://a.b/c see", "/usr/bin/x", "an error happened", "name = value", "token: abc", "a long enough interesting line", "short one"]
    found = values(spark, rows, text.categories)
    assert [[x.category for x in r] for r in found] == [["urls", "paths"], ["paths"], ["errors"], ["config"], ["api_keys"], ["interesting"], []]


def test_newer(spark):
    df = spark.createDataFrame([("v1.2.3", "1.2.2"), ("1.2", "1.2.0"), ("1.10", "1.9"), ("x", "1"), ("1", "dev"), ("v2.0-beta", "1.9")], "a string, b string")
    assert [r[0] for r in df.select(text.is_newer(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True, True]


def test_skip_precedence(spark):
    rows = ["mscorlib.dll", "System.Runtime.dll", "KERNEL32.dll", "netstandard.dll", "MyApp.dll", "MonoMod.Utils.dll"]
    assert values(spark, rows, routing.skip_reason) == ["dotnet_bcl", "dotnet_bcl", "system_crt", "dotnet_bcl", None, "mod_frameworks"]
    assert values(spark, rows[:1], lambda c: routing.skip_reason(c, enabled=False)) == [None]
    assert values(spark, rows[:1], lambda c: routing.skip_reason(c, off=("dotnet_bcl",))) == [None]
    assert values(spark, rows[:1], lambda c: routing.skip_reason(c, include=("MSCORLIB.dll",))) == [None]
    assert values(spark, rows[4:5], lambda c: routing.skip_reason(c, custom=("myapp.dll",))) == ["custom"]


def test_skip_table(spark):
    assert routing.skip_table(spark).count() == 105
    assert sum(map(len, routing.SKIP_GLOBS.values())) == 105 and len(routing.SKIP_GLOBS) == 13


def test_glob():
    import re

    assert re.match(glob_pattern("a*.dll").replace("\\z", r"\Z"), "abc.dll") and not re.match(glob_pattern("a*.dll").replace("\\z", r"\Z"), "a/c.dll")


def test_routes(spark):
    rows = [("Managed", "", "ConfuserEx", False), ("Native", "Delphi 7", "", False), ("Managed", "", "", False), ("Managed", "", "Babel", False), ("Managed", None, None, True), ("Unknown", "", "", False)]
    df = spark.createDataFrame(rows, "k string, c string, o string, p boolean")
    got = [r[0] for r in df.select(routing.recipe(*map(F.col, "kcop"))).collect()]
    assert got == ["dotnet-confuserex", "delphi", "dotnet-generic", None, None, None]


def test_compiler_and_merge(spark):
    df = spark.createDataFrame([(["CC32x.dll"], ["a"]), (["x"], ["CODE"]), (["x"], [".go.buildid"]), ([], [])], "i array<string>, s array<string>")
    assert [r[0] for r in df.select(routing.native_compiler(F.col("i"), F.col("s"))).collect()] == ["Delphi", "Delphi", "Go", ""]
    d = spark.createDataFrame([("f", 2, "Packer", "UPX", "3"), ("f", 1, "Compiler", "VC", "9"), ("f", 3, "Compiler", "X", "1")], "k string, pos int, type string, name string, version string")
    assert routing.merged_detection(d, "k", "pos").first()[1:] == ("VC 9", "UPX", True)


def test_small_text_functions(spark):
    df = spark.createDataFrame([("fn:12:main",), ("EXTRACT_COUNT:7",), ("other",)], "c string")
    got = [(r[0].kind, r[0].number, r[0].text) for r in df.select(text.progress_line(F.col("c"))).collect()]
    assert got[:2] == [("fn", 12, "main"), ("extract_count", 7, "7")] and got[2][0] == ""
    d = spark.createDataFrame([("Downloading Tool... 45%  3.5 / 10 MB",)], "c string").select(text.download_line(F.col("c"))).first()[0]
    assert (d.name, d.percent, d.done_mb, d.total_mb) == ("Tool", 45.0, 3.5, 10.0)
