"""Quality rules over lines that many documents of a host share. DataFrame functions only.

Lines are normalised and hashed. Each host's documents are counted for each hash; a line found in more documents of its host
than the limits allow is removed, and a document that keeps too few of its words is rejected. What the shuffles carry is
hashes and counts, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltic.llm.common import SPACE, stored

#: Low bits that hold a position beside a hash; an array never has so many entries.
_PLACE = 28
#: The symbols that the base counts.
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text, as an array without empty entries; the text must not be null."""
    bare = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the array holds twice or more.

    Windows are sorted by a hash with their place in its low bits; only those whose hash bits meet are compared by
    their words, so equal hashes of unlike windows change nothing.
    """
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    spots = F.sequence(F.lit(0), F.size(words) - 3)
    coded = F.transform(spots, lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), _PLACE), _PLACE).bitwiseOR(i.cast("long")))
    near = lambda a, x, i, k: F.shiftright(x, _PLACE) == F.shiftright(F.get(a, i + k), _PLACE)

    def let(value: Column, then) -> Column:
        """Binds a value once, as a lambda variable."""
        return F.element_at(F.transform(F.array(value), then), 1)

    def met(sorted_codes: Column) -> Column:
        return F.filter(sorted_codes, lambda x, i: F.coalesce(near(sorted_codes, x, i, F.lit(-1)), F.lit(False)) | F.coalesce(near(sorted_codes, x, i, F.lit(1)), F.lit(False)))

    def spelled(codes: Column) -> Column:
        return F.sort_array(F.transform(codes, lambda c: F.struct(window(c.bitwiseAND((1 << _PLACE) - 1).cast("int")).alias("w"), c.bitwiseAND((1 << _PLACE) - 1).alias("p"))))

    def same(rows: Column) -> Column:
        alike = lambda x, i, k: F.coalesce(x["w"] == F.get(rows, i + k)["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(rows, lambda x, i: alike(x, i, F.lit(-1)) | alike(x, i, F.lit(1))), lambda x: x["p"]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, i + 1) - p, F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(F.sort_array(coded), lambda s: let(met(s), lambda m: F.when(F.size(m) == 0, F.lit(0).cast("long")).otherwise(let(spelled(m), lambda r: let(same(r), covered)))))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(found)


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    split = docs.select("doc_id", "source", text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    return split.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def hashed_lines(docs: DataFrame) -> DataFrame:
    """One row for each distinct normalised line of a document: doc_id, source, h and n, the words in all its copies there.

    Normal: lower case, runs of white space as one space, runs of digits as one 0, nothing at the ends.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0")
    line = F.trim(F.col("line"))
    exploded = docs.select("doc_id", "source", F.explode(F.split(text, "\n")).alias("line")).select("doc_id", "source", line.alias("line")).where("line <> ''")
    return exploded.select("doc_id", "source", F.xxhash64("line").alias("h"), F.size(F.split("line", " ")).cast("long").alias("n"))


def line_frequency(docs: DataFrame, min_docs: int = 10, min_share: float = 0.1, min_left: float = 0.5) -> DataFrame:
    """Base counts, base_failed and kept of every document, with n_removed, the words in its removed lines.

    A line is removed if more than min_docs documents of its host hold it and these are more than min_share of the host's
    documents; a document is rejected if fewer than min_left of its words are left. A null source is a host of its own,
    a null text has no words. Documents of equal id count as one for the frequency; each row is returned, and judged by its
    id's lines together. Documents with a null id are judged by the base alone. Other columns are left out.
    """
    rows = docs.select("doc_id", "source", "text")
    lines = hashed_lines(rows.where("doc_id is not null")).groupBy("doc_id", "source", "h").agg(F.sum("n").alias("n"))
    lines = stored(lines, "lines")
    hosts = rows.groupBy("source").agg(F.count("*").alias("host_docs"))
    counts = lines.groupBy("source", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    over = counts.join(hosts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where(F.col("docs") > min_share * F.col("host_docs"))
    over = stored(over.select(F.col("source").alias("s"), F.col("h").alias("k")), "over")
    gone = lines.join(over, (F.col("h") == F.col("k")) & F.col("source").eqNullSafe(F.col("s"))).groupBy("doc_id").agg(F.sum("n").alias("n_removed"))
    judged = base_rules(rows).join(gone.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left").drop("_d", "source")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("n_removed", F.lit(0))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= min_left * F.col("n_words"))).alias("kept"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
    )
