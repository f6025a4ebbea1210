"""Names, signatures and bodies of decompiled functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that stand before an address in generated names.
ADDRESS_PREFIXES = ("FUN", "DAT", "LAB", "UNK", "SUB")

# Primitive types that look like callees in casts.
PRIMITIVES = (
    "void", "bool", "char", "uchar", "wchar_t", "short", "ushort", "int", "uint", "long", "ulong", "longlong", "ulonglong",
    "float", "double", "byte", "code", "undefined", "undefined1", "undefined2", "undefined4", "undefined8",
)

# Control words that look like calls.
CALL_WORDS = ("if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "catch", "__assert")

# Prefixes of engine and standard-library classes.
BOILERPLATE = (
    "UObject", "AActor", "UActorComponent", "UClass", "UStruct", "UFunction", "UScriptStruct", "UEnum", "UPackage", "UProperty", "FProperty",
    "FName", "FString", "FText", "FArchive", "FVector", "FRotator", "FQuat", "FTransform", "FMatrix", "FBox", "FColor", "FGuid",
    "TArray", "TMap", "TSet", "TWeakObjectPtr", "TSharedPtr", "TSharedRef", "TUniquePtr", "TFunction", "TOptional", "TSubclassOf",
    "std::",
)

_ADDRESS = "(?<![A-Za-z0-9_])(?:" + "|".join(ADDRESS_PREFIXES) + ")_[0-9A-Fa-f]+"
_CALL = r"([A-Za-z_][A-Za-z0-9_]*(?:(?:::|<[^>]*>)[A-Za-z0-9_~]*)*)\s*\("


def normal_body(body: Column) -> Column:
    """A body whose generated, address-bearing names are all alike, so that relocated copies compare equal."""
    return F.regexp_replace(body, _ADDRESS, "<SYM>")


def is_anonymous(name: Column) -> Column:
    return name.rlike("^(" + "|".join(f"{p}_" for p in ADDRESS_PREFIXES) + ")")


def function_name(signature: Column) -> Column:
    """The identifier before the parameter list; empty if there is none or it is a primitive type."""
    name = F.regexp_extract(signature, r"^.*?([\w:~<>,]*[\w>])\(", 1)
    return F.when(name.isin(*PRIMITIVES), "").otherwise(name)


def owner_class(name: Column) -> Column:
    """What stands before the last :: outside template brackets, trimmed; empty if there is none. A > without its < counts for nothing."""
    end = F.aggregate(
        F.split(name, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("cut"), F.lit("").alias("prev")),
        lambda s, c: F.struct(
            F.greatest(s["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0), F.lit(0)).alias("depth"),
            (s["n"] + 1).alias("n"),
            F.when((s["depth"] == 0) & (c == ":") & (s["prev"] == ":"), s["n"] - 1).otherwise(s["cut"]).alias("cut"),
            c.alias("prev"),
        ),
    )["cut"]
    return F.regexp_replace(F.substring(name, F.lit(1), end), r"\A\s+|\s+\z", "")


def is_boilerplate(name: Column) -> Column:
    return name.rlike("^(?:" + "|".join(BOILERPLATE) + ")")


def is_boilerplate_type(name: Column) -> Column:
    """For names without their prefix letter: the name itself or with any of the three letters."""
    test = is_boilerplate(name)
    for letter in "UAF":
        test = test | is_boilerplate(F.concat(F.lit(letter), name))
    return test


def is_engine_function(name: Column) -> Column:
    owner = owner_class(name)
    return (owner != "") & is_boilerplate(owner)


def is_qualified(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:::~?[A-Za-z_][A-Za-z0-9_]*)+\z")


def real_callee_rule(name: Column) -> Column:
    """True or false by the name alone; null if only a known name can tell."""
    return F.when(name.rlike("^(?:switchD_|switchdataD_|caseD_)"), F.lit(False)).when(name.startswith("FUN_") | name.contains("::"), F.lit(True))


def string_literals(body: Column) -> Column:
    """Distinct non-empty double-quoted literals in order of appearance, without their quotes."""
    found = F.regexp_extract_all(body, F.lit(r'"(?:\\.|[^"\\])*"'), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda s: F.substring(s, F.lit(2), F.length(s) - 2)), lambda s: s != ""))


def call_sites(body: Column, own_name: Column) -> Column:
    """Distinct callees in order of appearance: no comment lines, control words, casts, pseudo-operations or the function itself."""
    code = F.regexp_replace(body, r"(?m)^[ \t]*//[^\n]*", "")
    found = F.regexp_extract_all(code, F.lit(_CALL), F.lit(1))
    kept = F.filter(found, lambda c: ~c.isin(*CALL_WORDS, *PRIMITIVES) & ~c.rlike(r"^(?:CONCAT|ZEXT|SEXT|SUB)\d"))
    return F.array_except(F.array_distinct(kept), F.array(F.coalesce(own_name, F.lit(""))))


def name_from_body(body: Column) -> Column:
    """The name in the first line that is neither blank nor a comment."""
    lines = F.filter(F.split(body, "\n"), lambda x: ~x.rlike(r"^\s*(//.*)?\z"))
    return F.coalesce(function_name(F.get(lines, F.lit(0))), F.lit(""))


def bare_type(name: Column) -> Column:
    """Without a leading U, A or F before another capital."""
    return F.regexp_replace(name, "^[UAF](?=[A-Z])", "")


def is_mangled(name: Column) -> Column:
    """Machine-made names: beyond ASCII, or one or two lower-case letters, before any backtick."""
    head = F.substring_index(name, "`", 1)
    return head.rlike(r"[^\x00-\x7e]") | head.rlike(r"^[a-z]{1,2}\z")


def address_bucket(address: Column) -> Column:
    """Hex digits four to six from the right, 000 if the address is no hexadecimal number."""
    digits = F.regexp_replace(address, "^0[xX]", "")
    return F.when(digits.rlike(r"^[0-9A-Fa-f]{1,16}\z"), F.lower(F.substring(F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")), F.greatest(F.lit(6), F.length(digits)) - 5, F.lit(3)))).otherwise("000")
