"""Readers and writers of aligned sequences: FASTA, PHYLIP and the difference format, as DataFrames.

Records are split by Spark's text reader (at '>' where a record begins with one), so a file is read in parallel and no
record order is lost: `seq` numbers the records in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.states import PROTEIN, clean_body
from ..operators import encode

REFERENCE_NAMES = ("REF", "REFERENCE")
DNA_STATES = "ACGTU"
LEAST_ROWS = 3


class FormatError(ValueError):
    """A file that does not follow its format."""


FORMATS = ("auto", "fasta", "phylip", "delta")


def format_named(name: str) -> str:
    """The format with this name, whatever its case; unknown for any other."""
    return name.lower() if name.lower() in FORMATS else "unknown"


def detect_format(spark: SparkSession, path: str) -> str:
    """fasta, delta, phylip or unknown, from the first lines."""
    lines = [r.value.rstrip("\r") for r in spark.read.text(path).where("trim(value) <> ''").limit(200).collect()]
    if not lines:
        return "unknown"
    if lines[0][0].isdigit():
        return "phylip"
    if lines[0][0] != ">":
        return "unknown"
    heads = 0
    for line in lines:
        heads += line[0] == ">"
        if heads >= 2 and line[0] != ">":
            return "delta" if len(line.split()) > 1 else "fasta"
    return "fasta"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(seq, name, body) of a file whose records begin with '>'."""
    rows = spark.read.option("lineSep", ">").text(path).select(F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    rows = rows.where("trim(both '\n' from trim(value)) <> ''")
    cut = F.locate("\n", F.col("value"))
    head = F.when(cut > 0, F.substring(F.col("value"), F.lit(1), cut - 1)).otherwise(F.col("value"))
    body = F.when(cut > 0, F.substring(F.col("value"), cut + 1, F.length("value"))).otherwise("")
    named = rows.select("id", F.trim(head).alias("name"), body.alias("body"))
    return _numbered(named, "id").withColumnRenamed("number", "seq").select("seq", "name", "body")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """Add number, 0-based, by a monotonically increasing id: counts per partition give the offsets, so nothing is sorted whole."""
    rows = rows.withColumn("_part", F.shiftright(order, 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return rows.withColumn("_in", inside).join(offsets, "_part").withColumn("number", F.col("_offset") + F.col("_in")).drop("_part", "_offset", "_in")


def shorten_names(rows: DataFrame) -> DataFrame:
    """Cut names at the first blank; while that leaves equal names, up to four parts are kept, joined by '_'."""
    parts = F.split(F.trim("name"), r"\s+")
    for kept in range(1, 5):
        short = rows.withColumn("name", F.array_join(F.slice(parts, 1, F.lit(kept)), "_"))
        if kept == 4 or short.groupBy("name").count().where("count > 1").isEmpty():
            return short
    return rows


def _checked(rows: DataFrame, least: int) -> DataFrame:
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.length("text")).alias("low"), F.max(F.length("text")).alias("high"), F.sum(F.col("text").isNull().cast("int")).alias("bad")).first()
    if facts.n < least:
        raise FormatError(f"{facts.n} sequences; at least {least} are needed")
    if facts.bad:
        raise FormatError("a sequence holds characters that are not allowed")
    if facts.low != facts.high:
        raise FormatError(f"sequences have lengths {facts.low} to {facts.high}")
    return rows


def read_fasta(spark: SparkSession, path: str, least: int = LEAST_ROWS) -> DataFrame:
    """(seq, name, text)."""
    rows = _records(spark, path).select("seq", "name", clean_body(F.col("body")).alias("text"))
    return _checked(shorten_names(rows), least)


def read_phylip(spark: SparkSession, path: str, least: int = LEAST_ROWS) -> DataFrame:
    """(seq, name, text) of a sequential or interleaved file: after the header, line i belongs to row i modulo the number of rows."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r", "").alias("value")).where("trim(value) <> ''")
    numbered = _numbered(lines, "id")
    header = numbered.where("number = 0").first()
    size = header.value.split() if header else []
    if len(size) < 2 or not all(s.isdigit() for s in size[:2]):
        raise FormatError("the header must hold the number of sequences and their length")
    n, length = int(size[0]), int(size[1])
    body = numbered.where("number > 0").select(((F.col("number") - 1) % n).alias("seq"), F.floor((F.col("number") - 1) / n).alias("block"), "value")
    first = F.col("block") == 0
    name_end = F.regexp_instr(F.col("value"), F.lit(r"\s"))
    width = F.when((name_end > 0) & (name_end <= 11), name_end - 1).otherwise(10)
    parts = body.select("seq", "block", F.when(first, F.trim(F.substring(F.col("value"), F.lit(1), width))).alias("name"), F.when(first, F.substring(F.col("value"), width + 1, F.length("value"))).otherwise(F.col("value")).alias("piece"))
    rows = parts.groupBy("seq").agg(F.max("name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("text"))
    rows = _checked(rows.select("seq", "name", clean_body(F.col("text")).alias("text")), least)
    if rows.where(F.length("text") != length).limit(1).count() or rows.count() != n:
        raise FormatError(f"the header says {n} sequences of length {length}")
    return rows


def read_reference(spark: SparkSession, path: str, name: str, file_format: str = "fasta") -> str:
    """The sequence of the record with this name, whatever its case."""
    rows = (read_fasta if file_format == "fasta" else read_phylip)(spark, path, 1)
    found = rows.where(F.upper("name") == name.upper()).select("text").first()
    if found is None:
        raise FormatError(f"no sequence named {name}")
    return found.text


def read_delta(spark: SparkSession, path: str) -> tuple[str, DataFrame, DataFrame]:
    """(reference, rows (seq, name), differences (seq, type, pos, len)); positions are 0-based here."""
    records = _records(spark, path)
    first = records.where("seq = 0").first()
    if first is None or first.name.upper() not in REFERENCE_NAMES:
        raise FormatError("the first record must be the reference")
    body = first.body.strip("\n")
    if "\n" in body:
        raise FormatError("the reference must be one line")
    reference = body.strip().upper()
    # nucleotides if nine in ten letters are; a reference says one state for each site
    states = DNA_STATES if sum(reference.count(c) for c in DNA_STATES) > 0.9 * len(reference) else PROTEIN
    if unclear := sorted(set(reference) - set(states)):
        raise FormatError(f"the reference holds {', '.join(unclear)}, which is no single state")
    rows = records.where("seq > 0").select((F.col("seq") - 1).alias("seq"), "name", "body")
    lines = rows.select("seq", F.explode(F.split("body", "\n")).alias("line")).where("trim(line) <> ''").withColumn("f", F.split(F.trim("line"), r"\s+"))
    up = F.upper(F.col("f")[0])
    mut = lines.select("seq", up.alias("type"), (F.get("f", F.lit(1)).try_cast("int") - 1).alias("pos"), F.coalesce(F.get("f", F.lit(2)).try_cast("int"), F.lit(1)).alias("len"))
    same = F.substring(F.lit(reference), F.col("pos") + 1, F.lit(1)) == F.col("type")
    long = (F.col("len") > 1) & ~F.col("type").isin("N", "-")
    outside = F.col("pos").isNull() | (F.col("pos") < 0) | (F.col("pos") + F.col("len") > len(reference)) | (F.col("len") < 1)
    bad = mut.where(same | long | outside).first()
    if bad is not None:
        raise FormatError(f"record {bad.type} {None if bad.pos is None else bad.pos + 1} {bad.len} of sequence {bad.seq} is not allowed")
    return reference, rows.select("seq", "name"), mut


def cells(rows: DataFrame, aln: Column | None = None) -> DataFrame:
    """(aln, seq, pos, ch) of rows (seq, text)."""
    return rows.select((F.lit(0) if aln is None else aln).alias("aln"), "seq", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")


def write_text(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (seq, line) in order; an existing path is an error unless `overwrite`."""
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select(F.col("line").alias("value")).write.mode("overwrite" if overwrite else "error").text(path)


def fasta_lines(rows: DataFrame) -> DataFrame:
    return rows.select("seq", F.concat(F.lit(">"), "name", F.lit("\n"), "text").alias("line"))


def delta_file(reference: str, rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (seq, line) of a difference file from rows (seq, name) and records (seq, lines); the reference comes first."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(-1, f">REF\n{reference}")], "seq bigint, line string")
    body = rows.join(records, "seq", "left").select(F.col("seq").cast("bigint").alias("seq"), F.concat_ws("\n", F.concat(F.lit(">"), "name"), "lines").alias("line"))
    return head.unionByName(body)


def phylip_file(n: int, length: int, padded: DataFrame) -> DataFrame:
    head = padded.sparkSession.createDataFrame([(-1, f"{n}\t{length}")], "seq bigint, line string")
    return head.unionByName(padded.select(F.col("seq").cast("bigint").alias("seq"), "line"))


def read_site_rates(spark: SparkSession, path: str) -> DataFrame:
    """(pos, from_state, to_state, q) from lines of twelve rates: A to CGT, C to AGT, G to ACT, T to ACG."""
    pairs = [(a, b) for a in "ACGT" for b in "ACGT" if a != b]
    lines = _numbered(spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), "value").where("trim(value) <> ''"), "id")
    split = lines.select(F.col("number").alias("pos"), F.split(F.trim("value"), r"\s+").alias("f"))
    if split.where(F.size("f") != 12).limit(1).count():
        raise FormatError("each line must hold twelve rates")
    each = F.array(*[F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state"), F.col("f")[i].cast("float").cast("double").alias("q")) for i, (a, b) in enumerate(pairs)])
    return split.select("pos", F.inline(each))


def read_rows(spark: SparkSession, path: str, file_format: str, least: int = LEAST_ROWS) -> DataFrame:
    """(seq, name, text) of a FASTA or PHYLIP file; other formats do not hold whole rows."""
    readers = {"fasta": read_fasta, "phylip": read_phylip}
    if format_named(file_format) not in readers:
        raise FormatError(f"{file_format} is no format of whole sequences")
    return readers[format_named(file_format)](spark, path, least)


def read_alignment(spark: SparkSession, path: str, file_format: str = "auto", reference: str | None = None, least: int = LEAST_ROWS) -> tuple[str, DataFrame, DataFrame]:
    """(reference, rows (seq, name), differences (seq, type, pos, len)) of a file of any format, which is found out if it is `auto`. Whole
    sequences are compared with `reference`, or with their consensus if there is none; a file of differences has its own."""
    found = format_named(file_format)
    if found == "auto":
        found = detect_format(spark, path)
    if found == "unknown":
        raise FormatError(f"the format of {path} is not known")
    if found == "delta":
        if reference is not None:
            raise FormatError("a file of differences has a reference of its own")
        own, rows, mut = read_delta(spark, path)
        if rows.count() < least:
            raise FormatError(f"at least {least} sequences are needed")
        return own, rows, mut
    rows = read_rows(spark, path, found, least)
    sites = cells(rows)
    if reference is None:
        ref = encode.consensus(sites)
        # one row for each site: the reference is a text that the caller holds
        parts = ref.agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("parts")).first().parts
        reference = "".join(x.ref for x in parts)
    elif rows.where(F.length("text") != len(reference)).limit(1).count():
        raise FormatError(f"sequences are not of the reference's length, {len(reference)}")
    return reference, rows.select("seq", "name"), encode.differences(sites, reference_sites(spark, reference)).select("seq", "type", "pos", "len")


def reference_sites(spark: SparkSession, reference: str) -> DataFrame:
    """(aln, pos, ref) of a reference."""
    return spark.createDataFrame([(0, reference.upper())], "aln int, text string").select("aln", F.posexplode(F.split("text", "")).alias("pos", "ref")).where("ref <> ''")


def write_alignment(path: str, reference: str, rows: DataFrame, mut: DataFrame, file_format: str = "delta", overwrite: bool = False) -> None:
    """Write rows (seq, name) and their differences (seq, type, pos, len) in a format; an existing path is an error unless `overwrite`."""
    found = format_named(file_format)
    if found not in ("fasta", "phylip", "delta"):
        raise FormatError(f"cannot write {file_format}")
    one = F.lit(0).alias("aln")
    keyed = mut.select(one, "seq", "type", "pos", "len")
    if found == "delta":
        write_text(delta_file(reference, rows, encode.delta_lines(keyed, strict_reference=False)), path, overwrite)
        return
    spark = rows.sparkSession
    texts = encode.reconstruct(keyed, reference_sites(spark, reference), rows.select(one, "seq")).join(rows.select("seq", "name"), "seq").select("aln", "seq", "name", "text")
    write_text(fasta_lines(texts) if found == "fasta" else phylip_file(rows.count(), len(reference), encode.padded_rows(texts)), path, overwrite)
