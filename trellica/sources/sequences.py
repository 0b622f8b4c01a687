"""Readers of sequence files: FASTA, FASTQ and raw text, parsed by Spark expressions.

A record is (source, idx, id, seq): the file, the record's ordinal in it from 0, its id and its normalised symbols.
read_fasta() and read_fastq() read files of any size in splits, read_records() files of both kinds by their first symbol;
parse() takes whole texts that are rows already.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space without the vertical tab (fixed by the format's definition).
BLANK = r"[ \t\n\r\f]"


def normalise(seq: Column, label: Column) -> Column:
    """Upper-case symbols without white space; anything outside ASCII is an error."""
    bare = F.regexp_replace(seq, BLANK, "")
    return F.when(bare.rlike(r"[^\x00-\x7F]"), F.raise_error(F.concat(label, F.lit(": sequence is not ASCII"))).cast("string")).otherwise(F.upper(bare))


def record_id(header: Column, ordinal: Column) -> Column:
    """First word of the header, or record_N with N from 1."""
    word = F.element_at(F.split(F.trim(F.regexp_replace(header, BLANK, " ")), " +"), 1)
    return F.coalesce(F.nullif(word, F.lit("")), F.concat(F.lit("record_"), (ordinal + 1).cast("string")))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def parse(texts: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Records of whole file texts; the first symbol tells the format: > FASTA, @ FASTQ, else one raw sequence."""
    body = F.regexp_replace(F.col(text), rf"^{BLANK}+", "")
    kinds = texts.select(F.col(source).alias("source"), body.alias("body"), F.substring(body, 1, 1).alias("mark"))
    fasta = parse_fasta(kinds.where("mark = '>'"))
    fastq = parse_fastq(kinds.where("mark = '@'"))
    raw = kinds.where("mark NOT IN ('>', '@')").select("source", F.lit(0).alias("idx"), file_stem(F.col("source")).alias("id"), normalise(F.col("body"), F.col("source")).alias("seq"))
    return fasta.unionByName(fastq).unionByName(raw)


def parse_fasta(kinds: DataFrame) -> DataFrame:
    """Records start at lines with >; their other lines are joined."""
    parts = F.slice(F.split("body", r"(?m)^>"), 2, 2**31 - 1)
    each = kinds.select("source", F.posexplode(parts).alias("idx", "part"))
    header = F.regexp_extract("part", r"^([^\n]*)", 1)
    return each.select("source", "idx", record_id(header, F.col("idx")).alias("id"), normalise(F.regexp_replace("part", r"^[^\n]*\n?", ""), F.col("source")).alias("seq"))


def parse_fastq(kinds: DataFrame) -> DataFrame:
    """Four lines a record, blank lines skipped; qualities are read over and not checked."""
    lines = F.filter(F.split("body", r"\r?\n"), lambda x: F.regexp_replace(x, BLANK, "") != "")
    sound = F.when(F.size("lines") % 4 != 0, F.raise_error(F.concat("source", F.lit(": a FASTQ record has four lines"))).cast("int")).otherwise(F.size("lines"))
    each = kinds.select("source", lines.alias("lines")).withColumn("n", sound)
    each = each.select("source", F.posexplode(F.transform(F.sequence(F.lit(0), (F.col("n") / 4).cast("int") - 1), lambda i: F.slice("lines", i * 4 + 1, 4))).alias("idx", "r"))
    head, plus = F.element_at("r", 1), F.element_at("r", 3)
    head = F.when(head.startswith("@") & plus.startswith("+"), F.substring(head, 2, 2**31 - 1)).otherwise(F.raise_error(F.concat("source", F.lit(": a FASTQ record needs @ and + lines"))).cast("string"))
    return each.select("source", "idx", record_id(head, F.col("idx")).alias("id"), normalise(F.element_at("r", 2), F.col("source")).alias("seq"))


def read_sequences(spark: SparkSession, path: str | None = None, inline: str | None = None, label: str = "query") -> DataFrame:
    """Records of the files at path, or one inline sequence; exactly one of the two must be given."""
    if (path is None) == (inline is None):
        raise ValueError(f"{label}: give a path or an inline sequence, not both and not neither")
    if inline is not None:
        return spark.range(1).select(F.lit(label).alias("source"), F.lit(0).alias("idx"), F.lit(label).alias("id"), normalise(F.lit(inline), F.lit(label)).alias("seq"))
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    return parse(files)


def lines_by_block(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(source, block, at, value): pieces of files between separators; `at` grows along each file block without gaps."""
    scan = spark.read.option("lineSep", separator).text(path)
    rows = scan.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), "value")
    if separator == "\n":
        rows = rows.where(F.regexp_replace("value", BLANK, "") != "")
    return rows.select("source", "block", F.monotonically_increasing_id().alias("at"), "value")


def ahead_of_block(n: str = "n") -> Column:
    """Sum of n over the earlier blocks of a file, for a table of one row a block."""
    within = Window.partitionBy("source").orderBy("block")
    return F.coalesce(F.sum(n).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of FASTA files, read in splits: a record, not a file, is the largest row.

    Gives what parse() gives for the same files. A record's ordinal is its place in its file block plus the number of
    records in the blocks before, of which one row each is brought together. A file that does not start with > fails.
    """
    rows = lines_by_block(spark, path, "\n>")
    bare = F.regexp_replace("value", rf"^{BLANK}+", "")
    blocks = rows.groupBy("source", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min_by(bare == "", "at").alias("blank"))
    ahead = ahead_of_block() - F.first("blank").over(Window.partitionBy("source").orderBy("block")).cast("int")
    blocks = blocks.select("source", "block", "first", ahead.alias("ahead"))
    each = rows.join(blocks, ["source", "block"]).select("source", (F.col("ahead") + F.col("at") - F.col("first")).cast("int").alias("idx"), (F.col("block") == 0) & (F.col("at") == F.col("first")), "value").toDF("source", "idx", "head", "value")
    marked = F.when(bare.startswith(">"), F.substring(bare, 2, 2**31 - 1)).otherwise(F.raise_error(F.concat("source", F.lit(": a FASTA file starts with >"))).cast("string"))
    each = each.where("idx >= 0").select("source", "idx", F.when(F.col("head"), marked).otherwise(F.col("value")).alias("part"))
    header = F.regexp_extract("part", r"^([^\n]*)", 1)
    return each.select("source", "idx", record_id(header, F.col("idx")).alias("id"), normalise(F.regexp_replace("part", r"^[^\n]*\n?", ""), F.col("source")).alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of FASTQ files, read in splits by lines; blank lines are skipped, qualities are counted but not kept.

    Gives what parse() gives for the same files. Lines are numbered along a file from the counts of its blocks before, of
    which one row each is brought together; four of them are a record, wherever a split falls, and meet by its number.
    """
    rows = lines_by_block(spark, path, "\n")
    blocks = rows.groupBy("source", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("source"))
    sound = F.when(whole % 4 != 0, F.raise_error(F.concat("source", F.lit(": a FASTQ record has four lines"))).cast("long")).otherwise(ahead_of_block())
    blocks = blocks.select("source", "block", "first", sound.alias("ahead"))
    line = F.col("ahead") + F.col("at") - F.col("first")
    each = rows.join(blocks, ["source", "block"]).select("source", F.floor(line / 4).cast("int").alias("idx"), (line % 4).alias("place"), F.regexp_replace("value", r"\r$", "").alias("value"))
    part = lambda n: F.max(F.when(F.col("place") == n, F.col("value"))).alias(("head", "seq", "plus")[n])
    each = each.where("place < 3").groupBy("source", "idx").agg(part(0), part(1), part(2))
    head = F.when(F.col("head").startswith("@") & F.col("plus").startswith("+"), F.substring("head", 2, 2**31 - 1)).otherwise(F.raise_error(F.concat("source", F.lit(": a FASTQ record needs @ and + lines"))).cast("string"))
    return each.select("source", "idx", record_id(head, F.col("idx")).alias("id"), normalise(F.col("seq"), F.col("source")).alias("seq"))


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of FASTA, FASTQ and raw files together; a file's first symbol that is not blank tells its format.

    FASTA and FASTQ files are read in splits. A raw file is one sequence and so one row. The driver holds the names of the
    files, as it does to list them.
    """
    first = lines_by_block(spark, path, "\n").where("block = 0").groupBy("source").agg(F.min_by(F.substring(F.regexp_replace("value", rf"^{BLANK}+", ""), 1, 1), "at").alias("mark"))
    names: dict[str, list[str]] = {"fasta": [], "fastq": [], "raw": []}
    for r in first.collect():
        names[{">": "fasta", "@": "fastq"}.get(r["mark"], "raw")].append(unquote(r["source"]))
    found = spark.createDataFrame([], "source string, idx int, id string, seq string")
    for kind, read in (("fasta", read_fasta), ("fastq", read_fastq), ("raw", lambda s, p: parse(s.read.text(p, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))))):
        if names[kind]:
            found = found.unionByName(read(spark, names[kind]))
    return found


def numbered(records: DataFrame) -> DataFrame:
    """records with pair_index, their ordinal over all files in the order of the files' names.

    Only one count per file is brought together, never the records.
    """
    per = records.groupBy("source").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return records.join(per.select("source", ahead.alias("ahead")), "source").withColumn("pair_index", F.col("ahead") + F.col("idx"))


def zip_pairs(query: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of records with equal ordinals over all files of a side; unequal numbers of records fail the query."""
    left = numbered(query).select("pair_index", F.col("id").alias("query_id"), F.col("seq").alias("query"))
    right = numbered(target).select("pair_index", F.col("id").alias("target_id"), F.col("seq").alias("target"))
    both = left.join(right, "pair_index", "full")
    lone = F.col("query").isNull() | F.col("target").isNull()
    return both.select(F.when(lone, F.raise_error(F.lit("query and target have unequal numbers of records")).cast("long")).otherwise(F.col("pair_index")).cast("long").alias("pair_index"), "query_id", "query", "target_id", "target")


def dna(spark: SparkSession, n: int, step: int = 7, offset: int = 3) -> DataFrame:
    """(seq): a deterministic sequence of n bases, base i being number (i * step + offset) modulo 4 of ACGT."""
    bases = F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda i: F.substring(F.lit("ACGT"), ((i * step + offset) % 4 + 1).cast("int"), F.lit(1)))
    return spark.range(1).select((F.array_join(bases, "") if n else F.lit("")).alias("seq"))


def series(spark: SparkSession, n: int, offset: int | None = None) -> DataFrame:
    """(series): a deterministic integer series of n values; with an offset, a second family that starts there.

    The constants are fixed values of the benchmark inputs.
    """
    i = F.sequence(F.lit(0), F.lit(n - 1))
    plain = lambda x: (x * 17 + 11) % 31 - 15 + x % 7 - 3
    moved = lambda x: ((x + offset) * 13 + 5) % 29 - 14 + (x + offset) % 5 - 2
    return spark.range(1).select(F.transform(i, plain if offset is None else moved).alias("series"))


def repeated(spark: SparkSession, unit: str, n: int) -> DataFrame:
    """(seq): the first n symbols of a unit repeated."""
    return spark.range(1).select(F.substring(F.repeat(F.lit(unit), F.lit(n // max(len(unit), 1) + 1)), 1, n).alias("seq"))


def mutated(records: DataFrame, positions: list[int], seq: str = "seq") -> DataFrame:
    """records with the base at each position (of a long enough sequence) moved to the next of ACGT."""
    out = F.col(seq)
    for p in positions:
        base = F.substring(out, p + 1, 1)
        out = F.when(F.length(out) > p, F.concat(F.substring(out, 1, p), F.translate(base, "ACGT", "CGTA"), F.substring(out, p + 2, 2**31 - 1))).otherwise(out)
    return records.withColumn(seq, out)
