"""File sources and sinks: scans of trees, NDJSON, CSV, JSON documents and lines, and their writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basaltic.functions.routing import BINARY_EXTENSIONS, CONTAINER_EXTENSIONS
from basaltic.functions.symbols import address_bucket
from basaltic.operators.paths import base_name, extension


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = BINARY_EXTENSIONS + CONTAINER_EXTENSIONS) -> DataFrame:
    """Files below a root with the given extensions: path, length, extension and whether a container. Bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    marked = files.withColumn("extension", extension(F.col("path")))
    return marked.where(F.col("extension").isin(*extensions)).withColumn("container", F.col("extension").isin(*CONTAINER_EXTENSIONS))


def contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length and content of files, for the binary adapters."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "content")


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, required: int = 3) -> DataFrame:
    """CSV with a header; rows without the required number of fields are ignored, longer ones cut."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    return rows.where(F.col(rows.columns[required - 1]).isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n and line of text files, numbered within each file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line"))


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A whole file as one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_match(files: DataFrame, path: str, test: Column, roots: list[str]) -> DataFrame:
    """The first file by the order of roots, then by path, that meets the test; aggregated, not sorted."""
    place = F.coalesce(*(F.when(F.col(path).startswith(r.rstrip("/") + "/"), F.lit(i)) for i, r in enumerate(roots)), F.lit(None).cast("int"))
    hit = files.where(test).withColumn("_o", place).where("_o is not null")
    return hit.agg(F.min(F.struct("_o", path))[path].alias(path)).where(F.col(path).isNotNull())


def named(files: DataFrame, path: str, name: str, any_case: bool = True) -> DataFrame:
    """The smallest path of a file name."""
    own = base_name(F.col(path))
    test = F.lower(own) == name.lower() if any_case else own == name
    return files.where(test).agg(F.min(path).alias(path)).where(F.col(path).isNotNull())


def write_ndjson(df: DataFrame, path: str) -> None:
    """Replaces what is there."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("sep", separator).option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str, key: str) -> None:
    """Sorted by the key, without a header."""
    write_csv(df.orderBy(key), path, "\t", False)


def write_bucketed(functions: DataFrame, path: str, address: str, rows_a_file: int = 5000) -> None:
    """Functions by address bucket, one folder each, rolled over after so many rows. Rows of a bucket go to few tasks, dealt by the bucket and
    a salt, so one hot bucket does not wait for one writer."""
    dealt = functions.withColumn("bucket", address_bucket(F.col(address)))
    dealt.repartition("bucket", F.pmod(F.xxhash64(address), F.lit(4))).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("bucket").json(path)


def document(df: DataFrame) -> str:
    """A bounded summary, one row, as an indented JSON document."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary document has one row")
    return json.dumps(rows[0].asDict(recursive=True), indent=2, default=str, ensure_ascii=False)


def replaced(df: DataFrame, path: str) -> DataFrame:
    """Writes a new version of a dataset beside the old ones and returns it read back; an input is never overwritten while read."""
    import uuid

    target = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def class_headers(classes: DataFrame) -> DataFrame:
    """C++-like text of each class: name, super, boilerplate and properties of cpp_type, name, array_dim."""
    field = lambda p: F.concat(F.lit("    "), p["cpp_type"], F.lit(" "), p["name"], F.when(p["array_dim"] > 1, F.concat(F.lit("["), p["array_dim"].cast("string"), F.lit("]"))).otherwise(""), F.lit(";"))
    base = F.when(F.coalesce("super", F.lit("")) != "", F.concat(F.lit(" : public "), F.col("super"))).otherwise("")
    head = F.concat(F.lit("class "), F.col("name"), base, F.lit(" {"), F.when(F.col("boilerplate"), " // [engine]").otherwise(""))
    return classes.select("name", F.array_join(F.concat(F.array(head), F.transform("properties", field), F.array(F.lit("};"))), "\n").alias("text"))


def enum_headers(enums: DataFrame) -> DataFrame:
    """C++-like text of each enum: name and values of name, value, by value."""
    ordered = F.array_sort(F.transform("values", lambda v: F.struct(v["value"].alias("value"), v["name"].alias("name"))))
    line = lambda v: F.concat(F.lit("    "), v["name"], F.lit(" = "), v["value"].cast("string"), F.lit(","))
    return enums.select("name", F.array_join(F.concat(F.array(F.concat(F.lit("enum class "), F.col("name"), F.lit(" {"))), F.transform(ordered, line), F.array(F.lit("};"))), "\n").alias("text"))


def json_array(df: DataFrame, order: Column, most: int = 100_000) -> str:
    """A bounded table as one JSON array, in order; a larger table is an error, and belongs in NDJSON."""
    rows = df.select(order.alias("_o"), F.to_json(F.struct("*")).alias("_j")).orderBy("_o").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return "[" + ",\n".join(r["_j"] for r in rows) + "]"
