"""Substitution models as files: named models of a NEXUS block, and reports of frequencies and rates as text.

A model is a handful of numbers, so a file of them is one small text. No published matrix is kept here; a file of them is read from the
path that the user names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignments import FormatError

# Fixed value: the order of amino acids in published matrices.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"


def _positions(states: str, symmetric: bool) -> list[tuple[str, str]]:
    """The pairs of states in the order of the file: the lower triangle by rows, or whole rows."""
    return [(a, b) for i, a in enumerate(states) for j, b in enumerate(states) if j < i or not symmetric]


def read_models(spark: SparkSession, path: str, states: str = AMINO_ACIDS) -> tuple[DataFrame, DataFrame]:
    """(rates (model, from_state, to_state, s, symmetric), frequencies (model, state, freq)) of all `model NAME=` blocks of a file.

    A block ends at ';' and holds either the lower triangle of exchangeabilities or, if its first number is negative, all rows of a rate
    matrix whose rows sum to 0; the frequencies follow, and are scaled to a sum of 1. Comments stand in brackets. A block with another
    count of numbers, a negative rate off the diagonal, a negative frequency or a row with another sum is a FormatError.
    """
    n = len(states)
    # read as one text, so that a comment or block may run over lines
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\[[^\]]*\]", " ").alias("value"))
    block = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?i)(\bmodel\s+[^\s=]+\s*=[^;]*);"), 1)).alias("block"))
    numbers = F.filter(F.split(F.regexp_replace("block", r"^[^=]*=", ""), r"\s+"), lambda x: x != "")
    models = block.select(F.upper(F.regexp_extract("block", r"(?i)^model\s+([^\s=]+)", 1)).alias("model"), F.transform(numbers, lambda x: x.try_cast("double")).alias("x"))
    models = models.withColumn("symmetric", F.coalesce(F.get("x", F.lit(0)) >= 0, F.lit(True)))
    models = models.withColumn("n_rates", F.when(F.col("symmetric"), n * (n - 1) // 2).otherwise(n * n))
    models = models.withColumn("freqs", F.slice("x", F.col("n_rates") + 1, F.lit(n))).withColumn("rates", F.slice("x", F.lit(1), F.col("n_rates")))

    places = [(symmetric, i, *pair) for symmetric in (True, False) for i, pair in enumerate(_positions(states, symmetric))]
    places = F.broadcast(spark.createDataFrame(places, "symmetric boolean, i int, from_state string, to_state string"))  # as many as pairs of states
    rates = models.select("model", "symmetric", F.posexplode("rates").alias("i", "s")).join(places, ["symmetric", "i"])
    row_sum = rates.where("not symmetric").groupBy("model", "from_state").agg(F.sum("s").alias("total"))
    wrong = [
        models.where((F.size("x") != F.col("n_rates") + n) | F.exists("x", lambda x: x.isNull()) | F.exists("freqs", lambda x: x < 0)).select("model"),
        rates.where("s < 0 and from_state <> to_state").select("model"),
        row_sum.where(F.abs("total") > 1e-3).select("model"),
    ]
    bad = wrong[0].unionByName(wrong[1]).unionByName(wrong[2]).first()
    if bad is not None:
        raise FormatError(f"model {bad.model} is not a triangle or matrix of rates and {n} frequencies")
    whole = F.aggregate("freqs", F.lit(0.0), lambda acc, x: acc + x)
    shares = F.array(*[F.struct(F.lit(s).alias("state"), (F.get("freqs", F.lit(i)) / whole).alias("freq")) for i, s in enumerate(states)])
    return rates.select("model", "from_state", "to_state", "s", "symmetric"), models.select("model", F.inline(shares))


def _line(values: Column, states: str, lead: Column | None = None) -> Column:
    """Numbers by state (a map) as one line of tab-separated columns."""
    cells = F.concat_ws("\t", *[F.coalesce(F.element_at(values, F.lit(s)).cast("string"), F.lit("0.0")) for s in states])
    return cells if lead is None else F.concat(lead, F.lit("\t"), cells)


def frequency_lines(freqs: DataFrame, states: str) -> DataFrame:
    """Rows (seq, line): the states, and their frequencies below."""
    by_state = freqs.agg(F.map_from_entries(F.collect_list(F.struct("state", "freq"))).alias("m"))  # one entry per state
    lines = F.array(F.lit("\t".join(states)), _line(F.col("m"), states))
    return by_state.select(F.posexplode(lines).alias("seq", "line"))


def matrix_lines(rates: DataFrame, states: str, key: str | None = None) -> DataFrame:
    """Rows (seq, line) of a report of rates (from_state, to_state, q), or of one matrix per `key` (numbers from 0, such as sites): a head for
    each, then a line per state."""
    keyed = rates if key else rates.withColumn("_one", F.lit(0))
    by = key or "_one"
    rows = keyed.groupBy(by, "from_state").agg(F.map_from_entries(F.collect_list(F.struct("to_state", "q"))).alias("m"))
    size, place = len(states) + 1, F.instr(F.lit(states), F.col("from_state"))
    start = F.col(by).cast("bigint") * size
    head = F.concat(F.lit("Position: ") if key else F.lit(""), F.col(by).cast("string") if key else F.lit(""), F.lit("\n" if key else ""), F.lit("\t" + "\t".join(states)))
    heads = rows.select(by).distinct().select(start.alias("seq"), head.alias("line"))
    return heads.unionByName(rows.select((start + place).alias("seq"), _line(F.col("m"), states, F.col("from_state")).alias("line")))
