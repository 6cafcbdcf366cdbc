"""Site states: characters, codes, ambiguity sets and text cleaning, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide codes; an ambiguity code is its bit set + 3 with A=1, C=2, G=4, T=8.
DNA_CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3, "M": 6, "R": 8, "S": 9, "V": 10, "W": 12, "Y": 13, "H": 14, "K": 15, "D": 16, "B": 17}
TYPE_R, TYPE_O, TYPE_N, TYPE_DEL = 250, 251, 252, 253
UNKNOWN = "NOX?.~"
#: The protein alphabet in code order.
PROTEIN = "ARNDCQEGHILKMFPSTWYV"


def _lookup(pairs: dict[str, int], ch: Column) -> Column:
    table = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(table, ch)


def state_code(ch: Column, sequence_type: str = "dna") -> Column:
    """Code of a character; null for one that is not allowed."""
    up = F.upper(ch)
    if sequence_type == "protein":
        codes = {c: i for i, c in enumerate(PROTEIN)} | {"B": 20, "Z": 21, "J": 22} | dict.fromkeys("*UOX?.~", TYPE_N)
    else:
        codes = DNA_CODES | dict.fromkeys(UNKNOWN, TYPE_N)
    return _lookup(codes | {"-": TYPE_DEL}, up)


def state_char(code: Column) -> Column:
    """Character of a nucleotide code; unknown sites and gaps are both written as '-'."""
    table = {v: k for k, v in DNA_CODES.items() if k != "U"} | {TYPE_N: "-", TYPE_DEL: "-"}
    chars = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(chars, code), F.lit("?"))


def ambiguity_set(code: Column) -> Column:
    """Bit set of an ambiguity code (4 to 17), or null."""
    return F.when(code.between(4, 17), code - 3)


def ambiguity_vector(code: Column) -> Column:
    """Likelihoods of A, C, G, T: equal for the possible ones; one-hot for a determined state; null otherwise."""
    bits = F.when(code.between(0, 3), F.call_function("shiftleft", F.lit(1), code)).otherwise(ambiguity_set(code))
    vector = F.transform(F.array(*[F.lit(1 << i) for i in range(4)]), lambda b: (bits.bitwiseAND(b) > 0).cast("double") / F.bit_count(bits))
    return F.when(bits.isNotNull(), vector)


def ascii_upper(text: Column) -> Column:
    """Upper case of ASCII letters only, which is the same in every engine."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def clean_body(text: Column) -> Column:
    """Sequence text as it is stored: blanks dropped, upper case, bracketed choices replaced by '?'. Null if anything else is in it."""
    plain = F.regexp_replace(ascii_upper(F.regexp_replace(text, r"[\x00-\x20]", "")), r"\([^)]*\)|\{[^}]*\}", "?")
    return F.when(plain.rlike(r"^[A-Z0-9?.*~-]*$"), plain)


def sequence_type(text: Column) -> Column:
    """dna, protein or unknown, by the share of nucleotides, or else of letters, among all but gaps and unknowns. N and X are unknown sites and
    count on neither side for nucleotides; among letters they count as letters."""
    body = F.regexp_replace(ascii_upper(text), r"[-?.~\x09-\x0D\x20]", "")
    count = lambda pattern: F.regexp_count(body, F.lit(pattern))
    known = F.length(body) - count("[NX]")
    return F.when(F.length(body) == 0, "unknown").when(count("[ACGTU]") > 0.9 * known, "dna").when(count("[A-Z*]") > 0.9 * F.length(body), "protein").otherwise("unknown")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_.|/-]", "_")
