"""Classification and routing of files as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltic.functions.globs import glob_pattern

# Categories of files to skip, with their globs.
SKIP_GLOBS = {
    "system_crt": ["kernel32.dll", "ntdll.dll", "user32.dll", "advapi32.dll", "shell32.dll", "ole32.dll", "oleaut32.dll", "gdi32.dll", "ws2_32.dll", "comctl32.dll", "msvcrt.dll", "ucrtbase.dll", "vcruntime*.dll", "msvcp*.dll", "api-ms-*.dll", "concrt*.dll", "vcomp*.dll"],
    "directx_gpu": ["d3d*.dll", "dxgi.dll", "dxgi*.dll", "vulkan-1.dll", "nvngx*.dll", "nvapi*.dll", "amd_ags*.dll", "dxcompiler.dll", "XInput*.dll", "GPUOpen*.dll", "PhysX*.dll", "PxFoundation*.dll", "NvCloth*.dll", "NVUnityPlugin.dll", "nvToolsExt*.dll"],
    "dotnet_bcl": ["mscorlib.dll", "System.dll", "System.*.dll", "Microsoft.*.dll", "netstandard.dll", "WindowsBase.dll", "PresentationCore.dll", "PresentationFramework.dll", "clrjit.dll", "coreclr.dll", "hostpolicy.dll", "hostfxr.dll"],
    "unity_engine": ["UnityEngine.dll", "UnityEngine.*.dll", "Unity.*.dll", "Mono.*.dll", "UnityPlayer.dll", "UnityCrashHandler*.exe", "baselib.dll"],
    "mod_frameworks": ["BepInEx.*.dll", "MelonLoader.*.dll", "0Harmony.dll", "HarmonyX.dll", "Harmony.dll", "MonoMod.*.dll", "Il2CppInterop.*.dll", "UnhollowerBaseLib.dll"],
    "sdk": ["steam_api*.dll", "Steamworks.NET.dll", "discord_*.dll", "EOS*.dll", "GalaxySdk.dll", "Facepunch.Steamworks.dll"],
    "popular_nuget": ["Newtonsoft.Json.dll", "NLog.dll", "log4net.dll", "Serilog.dll", "Serilog.*.dll", "AutoMapper.dll", "Dapper.dll"],
    "crypto_compression": ["BouncyCastle.dll", "BouncyCastle.Crypto.dll", "ICSharpCode.SharpZipLib.dll", "zlib*.dll", "lz4*.dll", "zstd*.dll"],
    "middleware": ["fmod*.dll", "fmodstudio*.dll", "AkSoundEngine*.dll", "wwise*.dll", "bink2*.dll", "binkw*.dll", "Miles*.dll", "MSS*.dll"],
    "video_codecs": ["avcodec*.dll", "avformat*.dll", "avutil*.dll", "swresample*.dll", "swscale*.dll"],
    "chromium_cef": ["libcef.dll", "chrome_elf.dll", "libEGL.dll", "libGLESv2.dll"],
    "crash_telemetry": ["crashpad_handler.exe", "crashpad_wer.dll", "CrashReporter*.exe", "sentry*.dll", "breakpad*.dll"],
    "anticheat": ["EasyAntiCheat*.dll", "EasyAntiCheat*.sys", "BattlEye*.dll", "BEService*.dll", "BEClient*.dll"],
}

# Needles in strings that name an obfuscator, in order of precedence.
OBFUSCATORS = (
    ("ConfuserEx", "ConfuserEx"), ("Confuser", "Confuser"), ("Dotfuscator", "Dotfuscator"), ("Obfuscar", "Obfuscar"), ("Eazfuscator", "Eazfuscator"),
    ("SmartAssembly", "SmartAssembly"), ("Babel", "Babel"), ("Crypto Obfuscator", "CryptoObfuscator"), (".Protect", "DotNetProtect"),
    (".NET Reactor", ".NET Reactor"), ("Themida", "Themida"), ("VMProtect", "VMProtect"),
)

# Markers of embedded assemblies, and of obfuscator features with their names.
EMBEDDED_MARKERS = (
    ("costura.", "Costura.Fody resources"), ("Costura.AssemblyLoader", "Costura.Fody loader"), ("AssemblyResolve", "AssemblyResolve hook"),
    ("ILMerge", "ILMerge signature"), ("ILRepack", "ILRepack signature"),
)
FEATURE_MARKERS = (
    ("AntiTamper", "anti_tamper"), ("AntiDebug", "anti_debug"), ("Constants", "constants"),
    ("ControlFlow", "ctrl_flow"), ("ReferenceProxy", "ref_proxy"), ("Resources", "resources"),
)

# Thresholds of the mangled-name rule; the head of a file that markers are looked for in.
MANGLED_LEAST, MANGLED_SHARE, HEAD_BYTES = 20, 0.40, 10 << 20

# Extensions of scanned binaries, containers, sources and assets; tool executables that no game is.
BINARY_EXTENSIONS = (".dll", ".exe", ".so", ".dylib", ".dat")
CONTAINER_EXTENSIONS = (".pak", ".utoc", ".ucas")
SOURCE_EXTENSIONS = (".c", ".h", ".cpp", ".cs")
ASSET_EXTENSIONS = (".uasset", ".uexp", ".umap", ".ubulk", ".uptnl", ".ufont", ".bin", ".locres")
TOOL_EXECUTABLES = ("crashreportclient.exe", "unrealcefsubprocess.exe", "easyanticheat_eosservice.exe")


def skip_reason(name: Column, globs: dict[str, list[str]] | None = None, enabled: bool = True, include: tuple = (), custom: tuple = (), off: tuple = ()) -> Column:
    """Why a file is skipped, null if it is kept: forced includes, then custom skips, then the first category by name.

    Categories are on unless named in `off`; enabled switches all of them."""
    low = F.lower(name)
    first = F.when(low.isin(*map(str.lower, include)), F.lit(None).cast("string")) if include else F.when(F.lit(False), F.lit(None).cast("string"))
    if custom:
        first = first.when(low.isin(*map(str.lower, custom)), "custom")
    if enabled:
        for category, patterns in sorted((globs or SKIP_GLOBS).items()):
            if category not in off:
                first = first.when(low.rlike("|".join(glob_pattern(p.lower()) for p in patterns)), category)
    return first


def skip_table(spark) -> DataFrame:
    """The skip patterns as a dimension table: category, glob."""
    return spark.createDataFrame([(c, g) for c, globs in sorted(SKIP_GLOBS.items()) for g in globs], "category string, glob string")


def excluded(name: Column, globs: list[str]) -> Column:
    """Case-sensitive globs on a base name."""
    return name.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


def recipe(kind: Column, compiler: Column, obfuscator: Column, packed: Column) -> Column:
    """The first recipe in order of priority that fits, null if none does."""
    obf, comp = F.lower(F.coalesce(obfuscator, F.lit(""))), F.lower(F.coalesce(compiler, F.lit("")))
    return (
        F.when((kind == "Managed") & (obf.contains("confuser") | obf.contains("obfuscated")), "dotnet-confuserex")
        .when((kind == "Native") & comp.contains("delphi"), "delphi")
        .when((kind == "Managed") & ~needs_deobfuscation(obfuscator, packed), "dotnet-generic")
        .when(kind == "UnityIL2CPP", "unity-il2cpp")
        .when(kind == "Native", "native")
        .when(kind == "UnrealEngine", "ue5")
        .when(kind == "UnityMono", "unity-mono")
    )


def needs_deobfuscation(obfuscator: Column, packed: Column) -> Column:
    return (F.coalesce(obfuscator, F.lit("")) != "") | F.coalesce(packed, F.lit(False))


def overridden_kind(kind: Column, group: Column) -> Column:
    """A group's kind replaces a file's own."""
    return F.when(group == "Unreal", "UnrealEngine").when(group.isin("UnityMono", "UnityIL2CPP"), group).otherwise(kind)


def deobfuscator(obfuscator: Column) -> Column:
    return F.when(F.lower(obfuscator).rlike("confuser|obfuscated"), "de4dot").otherwise("")


def is_system_assembly(name: Column) -> Column:
    low = F.lower(name)
    test = low.isin("mscorlib.dll", "netstandard.dll", "unityengine.dll")
    for start in ("system.", "microsoft.", "unityengine.", "unity.", "mono."):
        test = test | low.startswith(start)
    return test


def kind_by_extension(extension: Column) -> Column:
    return F.when(F.lower(extension).isin(".so", ".dylib"), "Native").otherwise("Unknown")


def native_compiler(imports: Column, sections: Column) -> Column:
    """Compiler by imported libraries, then by section names; empty if unknown."""
    delphi = F.exists(imports, lambda n: (F.lower(n) == "borlndmm.dll") | F.lower(n).startswith("cc32")) | F.array_contains(sections, "CODE")
    return F.when(delphi, "Delphi").when(F.arrays_overlap(sections, F.array(F.lit(".symtab"), F.lit(".go.buildid"))), "Go").otherwise("")


def marks(text: Column, markers: tuple) -> Column:
    """The signals of the markers that the head of a file contains, in the markers' order."""
    head = F.when(F.octet_length(text) <= HEAD_BYTES, text).otherwise(F.substring(text.cast("binary"), 1, HEAD_BYTES).cast("string"))
    return F.array_compact(F.array(*(F.when(head.contains(m), F.lit(signal)) for m, signal in markers)))


def features(strings: Column) -> Column:
    """Distinct feature names in the order in which the strings first show them."""
    each = F.transform(strings, lambda s: F.array_compact(F.array(*(F.when(s.contains(m), F.lit(name)) for m, name in FEATURE_MARKERS))))
    return F.array_distinct(F.flatten(each))


def first_needle(text: Column) -> Column:
    """The first obfuscator in order of precedence whose needle a text contains."""
    out = F.when(F.lit(False), F.lit(""))
    for needle, name in OBFUSCATORS:
        out = out.when(text.contains(needle), name)
    return out


def first_obfuscator(strings: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """key and obfuscator of the first string by position that holds any needle."""
    hit = strings.withColumn("_o", first_needle(F.col(text))).where("_o is not null")
    return hit.groupBy(key).agg(F.min(F.struct(position, "_o"))["_o"].alias("obfuscator"))


def mangled_ratio(names: DataFrame, key: str, name: str) -> DataFrame:
    """key, total, ratio and flagged of type names; empty names and <Module> don't count."""
    from basaltic.functions.symbols import is_mangled

    real = names.where((F.col(name) != "") & (F.col(name) != "<Module>"))
    out = real.groupBy(key).agg(F.count("*").alias("total"), F.avg(is_mangled(F.col(name)).cast("double")).alias("ratio"))
    return out.withColumn("flagged", (F.col("total") >= MANGLED_LEAST) & (F.col("ratio") >= MANGLED_SHARE))


def merged_detection(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Detector rows (type, name, version) merged by key: the first compiler with its version; a packer sets packed and is the
    obfuscator if no protector came before it."""
    order = lambda test: F.min(F.when(test, F.struct(position, "name", "version")))
    kind = F.lower(F.col("type"))
    out = rows.groupBy(key).agg(order(kind == "compiler").alias("c"), order(kind.isin("packer", "protector", "obfuscator")).alias("o"), F.bool_or(kind == "packer").alias("packed"))
    compiler = F.trim(F.concat_ws(" ", "c.name", "c.version"))
    return out.select(key, F.coalesce(compiler, F.lit("")).alias("compiler"), F.coalesce("o.name", F.lit("")).alias("obfuscator"), F.coalesce("packed", F.lit(False)).alias("packed"))


def settled_obfuscator(found: Column, by_strings: Column, ratio_flag: Column, stub: Column, managed: Column) -> Column:
    """A specific name stays; else strings, then the mangled-name rule, then the stub, of which the stub may refine the generic name."""
    named = F.coalesce(F.nullif(found, F.lit("")), F.nullif(by_strings, F.lit("")))
    general = F.coalesce(named, F.when(managed & ratio_flag, F.lit("Obfuscated")))
    return F.when(managed & stub & (general.isNull() | (general == "Obfuscated")), "ConfuserEx").otherwise(F.coalesce(general, F.lit("")))
