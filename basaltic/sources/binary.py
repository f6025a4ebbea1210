"""Adapters for binary files: bytes in, typed rows with an error column out. Nothing of a file is ever executed."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltic.functions.symbols import is_boilerplate_type
from basaltic.session import ship

# The type catalogue's magic, versions and limits.
CATALOGUE_MAGIC, CATALOGUE_LATEST = 0x30C4, 4
VERSIONED, LONG_NAMES, LARGE_ENUMS, EXPLICIT_ENUMS = 1, 2, 3, 4
MOST = {"body": 512 << 20, "names": 5_000_000, "enums": 2_000_000, "structs": 2_000_000, "values": 1_000_000, "file": 256 << 20, "depth": 32}
METHODS = {0: "None", 1: "Oodle", 2: "Brotli", 3: "ZStandard"}

# Property types by code; each is followed by "Property" in full.
PROPERTY_TYPES = (
    "Byte", "Bool", "Int", "Float", "Object", "Name", "Delegate", "Double", "Array", "Struct", "Str", "Text", "Interface",
    "MulticastDelegate", "WeakObject", "LazyObject", "AssetObject", "SoftObject", "UInt64", "UInt32", "UInt16", "Int64", "Int16",
    "Int8", "Map", "Set", "Enum", "FieldPath", "Optional", "Utf8Str", "AnsiStr", "Class", "MulticastInlineDelegate", "SoftClass",
    "VerseString", "VerseDynamic", "VerseFunction",
)

# How scalar property types are spelled in C++.
CPP_TYPES = {
    "Bool": "bool", "Byte": "uint8", "Int8": "int8", "Int16": "int16", "Int": "int32", "Int64": "int64", "UInt16": "uint16", "UInt32": "uint32",
    "UInt64": "uint64", "Float": "float", "Double": "double", "Name": "FName", "Str": "FString", "Utf8Str": "FString", "AnsiStr": "FString",
    "Text": "FText", "Object": "UObject*", "Class": "UObject*", "WeakObject": "TWeakObjectPtr<UObject>", "LazyObject": "TLazyObjectPtr<UObject>",
    "SoftObject": "TSoftObjectPtr<UObject>", "AssetObject": "TSoftObjectPtr<UObject>", "SoftClass": "TSoftClassPtr<UObject>",
    "Interface": "TScriptInterface<>", "Delegate": "FScriptDelegate", "MulticastDelegate": "FMulticastScriptDelegate",
    "MulticastInlineDelegate": "FMulticastScriptDelegate", "FieldPath": "FFieldPath",
}

# The asset package's tag and limits.
ASSET_TAG, ASSET_NAMES, ASSET_NAMES_KEPT, ASSET_VERSIONS = 0x9E2A83C1, 1_000_000, 200, 4096


class Malformed(ValueError):
    """Bytes that don't follow the format, or counts beyond the limits."""


class Reader:
    """Little-endian numbers from bytes, within bounds."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Malformed(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def count(self, form: str, most: int, what: str) -> int:
        n = self.number(form)
        if not 0 <= n <= most:
            raise Malformed(f"{what}: {n} is beyond {most}")
        return n

    def text(self) -> str:
        """A length-prefixed string: bytes, or UTF-16 for negative lengths; zeros at the end are dropped."""
        n = self.number("i")
        raw = self.take(n if n >= 0 else -2 * n)
        return raw.decode("latin-1").rstrip("\0") if n >= 0 else raw.decode("utf-16-le", "replace").rstrip("\0")


def inflate(method: int, packed: bytes, size: int) -> bytes:
    if size > MOST["body"]:
        raise Malformed(f"body of {size} bytes is beyond {MOST['body']}")
    if method == 0:
        body = packed
    elif method == 3:
        import zstandard

        try:
            body = zstandard.ZstdDecompressor(max_window_size=1 << 30).decompress(packed, max_output_size=size)
        except zstandard.ZstdError as e:
            raise Malformed(f"zstd: {e}") from None
    else:
        raise Malformed(f"compression {METHODS.get(method, f'Unknown({method})')} can't be decoded")
    if len(body) != size:
        raise Malformed(f"body has {len(body)} bytes, not {size}")
    return body


def render(kind: dict | None) -> str:
    """A property type as C++ spells it."""
    if not kind:
        return "void"
    name, inner = kind["type"].removesuffix("Property"), kind.get("inner")
    if name in ("Array", "Set", "Optional"):
        return f"T{name}<{render(inner)}>"
    if name == "Map":
        return f"TMap<{render(inner)}, {render(kind.get('value'))}>"
    if name == "Struct":
        return "F" + (kind.get("struct_type") or "Struct")
    if name == "Enum":
        return kind.get("enum_name") or "uint8"
    return CPP_TYPES.get(name, kind["type"])


class Catalogue:
    """A type catalogue: header, body, then the names, enums and structs that refer to them."""

    def __init__(self, raw: bytes):
        if len(raw) > MOST["file"]:
            raise Malformed("file too large")
        r = Reader(raw)
        if (magic := r.number("H")) != CATALOGUE_MAGIC:
            raise Malformed(f"magic {magic:#06x}")
        self.version = r.count("B", CATALOGUE_LATEST, "version")
        if self.version >= VERSIONED and r.number("I"):
            r.take(8)
            r.take(20 * r.count("i", MOST["enums"], "custom versions"))
            r.take(4)
        self.method = r.number("B")
        packed, size = r.number("I"), r.number("I")
        if size > MOST["body"]:
            raise Malformed(f"body of {size} bytes is beyond {MOST['body']}")
        self.body = Reader(inflate(self.method, r.take(packed), size))
        b = self.body
        self.names = [b.take(b.number("H" if self.version >= LONG_NAMES else "B")).decode("utf-8", "replace") for _ in range(b.count("I", MOST["names"], "names"))]
        self.enums = [self._enum() for _ in range(b.count("I", MOST["enums"], "enums"))]
        self.structs = [self._struct() for _ in range(b.count("I", MOST["structs"], "structs"))]

    def name(self) -> str:
        i = self.body.number("i")
        if i == -1:
            return ""
        if not 0 <= i < len(self.names):
            raise Malformed(f"name {i} of {len(self.names)}")
        return self.names[i]

    def _enum(self) -> dict:
        b, name, values = self.body, self.name(), {}
        for k in range(b.count("H" if self.version >= LARGE_ENUMS else "B", MOST["values"], "values")):
            value = b.number("Q") if self.version >= EXPLICIT_ENUMS else k
            values[value] = self.name()
        return {"name": name, "values": [{"name": n, "value": v} for v, n in sorted(values.items())]}

    def _struct(self) -> dict:
        name, above = self.name(), self.name()
        self.body.number("H")  # slots, with fixed arrays spread out
        return {"name": name, "super": above, "properties": [self._property() for _ in range(self.body.number("H"))]}

    def _property(self) -> dict:
        b = self.body
        index, dim, name = b.number("H"), b.number("B"), self.name()
        kind = self._type(0)
        return {"index": index, "name": name, "array_dim": dim, "type": kind["type"], "type_json": json.dumps(kind), "cpp_type": render(kind)}

    def _type(self, depth: int) -> dict:
        if depth > MOST["depth"]:
            raise Malformed(f"types nested beyond {MOST['depth']}")
        code = self.body.number("B")
        name = PROPERTY_TYPES[code] if code < len(PROPERTY_TYPES) else ""
        kind: dict = {"type": f"{name}Property" if name else f"Unknown({code})"}
        if name in ("Enum", "Array", "Set", "Optional", "Map"):
            kind["inner"] = self._type(depth + 1)
        if name == "Map":
            kind["value"] = self._type(depth + 1)
        if name == "Enum":
            kind["enum_name"] = self.name()
        if name == "Struct":
            kind["struct_type"] = self.name()
        return kind


def plausible_name(data: bytes, at: int) -> tuple[str, int] | None:
    """A printable string of at most 1024 bytes with its length before it, and the bytes it takes up."""
    if at + 4 > len(data):
        return None
    n = struct.unpack_from("<i", data, at)[0]
    if not 0 < n <= 1024 or at + 4 + n > len(data):
        return None
    body = data[at + 4 : at + 4 + n]
    body = body[:-1] if body[-1] == 0 else body
    return (body.decode("ascii"), 4 + n) if body and all(32 <= c < 127 for c in body) else None


def _hash_follows(data: bytes, at: int) -> bool:
    """Whether what stands at a place can't be the length of a further string."""
    n = struct.unpack_from("<i", data, at)[0]
    return n <= 0 or n > len(data) - at - 4


def name_table(data: bytes, at: int, most: int) -> list[str]:
    names: list[str] = []
    while 0 <= at <= len(data) and len(names) < most and (found := plausible_name(data, at)):
        names.append(found[0])
        at += found[1]
        if at + 4 > len(data):
            break
        at += 4 * _hash_follows(data, at)
    return names


def name_table_start(data: bytes) -> int:
    """The first aligned place past the head where two names of two or more letters stand one after the other; -1 if none."""
    for start in range(0x14, len(data) - 8, 4):
        at, found = start, 0
        while found < 2 and (name := plausible_name(data, at)) and len(name[0]) >= 2:
            found, at = found + 1, at + name[1]
            at += 4 * (at + 4 > len(data) or _hash_follows(data, at))
        if found == 2:
            return start
    return -1


def asset(data: bytes) -> dict:
    """The names of an asset package: by its summary or by a search, whichever gives more."""
    r = Reader(data)
    if (tag := r.number("I")) != ASSET_TAG:
        raise Malformed(f"tag {tag:#010x}")
    legacy = r.number("i")
    r.take(4 * ((legacy != -4) + 1 + (legacy <= -8) + 1))
    r.take(20 * r.count("i", ASSET_VERSIONS, "custom versions"))
    r.take(4)
    r.text()
    r.take(4)
    count, offset = r.count("i", ASSET_NAMES, "names"), r.count("i", len(data), "name offset")
    names = name_table(data, offset, count)
    if (start := name_table_start(data)) >= 0 and len(found := name_table(data, start, ASSET_NAMES)) > len(names):
        names = found
    return {"name_count": count if count > 0 and len(names) == count else len(names), "import_count": 0, "export_count": 0, "total_names": len(names), "names": names[:ASSET_NAMES_KEPT]}


def user_strings(heap: bytes) -> Iterator[str]:
    """The strings of a user-string heap: compressed length, UTF-16 text and a flag byte each, after one empty entry."""
    at = 1
    while at < len(heap):
        first = heap[at]
        wide = 1 if first < 0x80 else 2 if first < 0xC0 else 4
        if at + wide > len(heap):
            return
        size = int.from_bytes(heap[at : at + wide], "big") & (0x7F, 0x3FFF, 0, 0x1FFFFFFF)[wide - 1]
        at += wide
        if size <= 0 or at + size > len(heap):
            return
        raw = heap[at : at + size - 1]
        if text := raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace"):
            yield text
        at += size


def heap_string(heap: bytes, at: int) -> str:
    """A zero-ended UTF-8 string of a name heap; empty beyond its end."""
    return heap[at:].split(b"\0", 1)[0].decode("utf-8", "replace") if 0 <= at < len(heap) else ""


def stub_like(has_data: bool, static: bool, signature: str, size: int, opcodes: list[str]) -> bool:
    """The shape of a string-decrypting stub, from already parsed method facts."""
    return has_data and static and signature == "string(int32)" and 40 <= size <= 120 and opcodes.count("ldsfld") >= 2 and "callvirt" in opcodes


_VALUES = "array<struct<name:string,value:decimal(20,0)>>"
_PROPERTIES = "array<struct<index:int,name:string,array_dim:int,type:string,type_json:string,cpp_type:string>>"
CATALOGUE_SCHEMA = f"path string, error string, version int, method string, enums array<struct<name:string,values:{_VALUES}>>, structs array<struct<name:string,super:string,properties:{_PROPERTIES}>>"
ASSET_SCHEMA = "path string, error string, name_count int, import_count int, export_count int, total_names long, names array<string>"


def _each(files: DataFrame, parse, schema: str) -> DataFrame:
    columns = [c.split(" ")[0] for c in schema.replace("decimal(20,0)", "").split(", ") if " " in c]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                row = dict.fromkeys(columns) | {"path": path}
                try:
                    row |= parse(bytes(content) if content is not None else b"")
                except Exception as e:  # any broken file is a row with its error, never a failed job
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=columns)

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, schema)


def parse_catalogues(files: DataFrame) -> DataFrame:
    """Type catalogues from (path, content): version, method, enums and structs, or an error."""
    from decimal import Decimal

    def parse(raw: bytes) -> dict:
        c = Catalogue(raw)
        enums = [{"name": e["name"], "values": [{"name": v["name"], "value": Decimal(v["value"])} for v in e["values"]]} for e in c.enums]
        return {"version": c.version, "method": METHODS.get(c.method, f"Unknown({c.method})"), "enums": enums, "structs": c.structs}

    return _each(files, parse, CATALOGUE_SCHEMA)


def parse_assets(files: DataFrame) -> DataFrame:
    """Asset packages from (path, content): counts and the first names, or an error."""
    return _each(files, asset, ASSET_SCHEMA)


def asset_totals(assets: DataFrame) -> DataFrame:
    """One row: parsed, failed and the sum of names."""
    bad = F.col("error").isNotNull()
    return assets.agg(F.count_if(~bad).alias("parsed"), F.count_if(bad).alias("failed"), F.coalesce(F.sum("total_names"), F.lit(0)).alias("total_names"))


def classes(catalogues: DataFrame) -> DataFrame:
    """The classes of catalogues by name, with their boilerplate flag."""
    rows = catalogues.select(F.explode("structs").alias("s")).select("s.*")
    return rows.withColumn("boilerplate", is_boilerplate_type(F.col("name"))).orderBy("name")
