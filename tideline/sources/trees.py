"""Trees as node tables: Newick and NEXUS text to and from rows (tree, node, parent, ord, name, length)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees

NODES = "tree long, node long, parent long, ord int, name string, length double"


class TreeError(ValueError):
    """Text that is not a tree."""


def parse_newick(text: str) -> list[tuple[int, int | None, int, str | None, float | None]]:
    """(node, parent, place among siblings, name, length) in pre-order, with an explicit stack: depth is not limited."""
    nodes: list[list] = [[0, None, 0, None, None]]
    fans, at, i, n, closed = [0], 0, 0, len(text), False

    def child(parent: int) -> int:
        nodes.append([len(nodes), parent, fans[parent], None, None])
        fans[parent] += 1
        fans.append(0)
        return len(nodes) - 1

    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif c == "[":
            end = text.find("]", i)
            if end < 0:
                raise TreeError("a comment is not closed")
            i = end + 1
        elif c == "(":
            at, i = child(at), i + 1
        elif c in ",)":
            parent = nodes[at][1]
            if parent is None:
                raise TreeError("brackets do not match")
            at, i = (child(parent) if c == "," else parent), i + 1
        elif c == ";":
            closed = True
            break
        elif c == ":":
            j = i + 1
            while j < n and text[j] not in ",();[" and not text[j].isspace():
                j += 1
            try:
                nodes[at][4] = float(text[i + 1 : j])
            except ValueError:
                raise TreeError(f"{text[i + 1 : j]!r} is not a length") from None
            i = j
        elif c in "'\"":
            end = text.find(c, i + 1)
            if end < 0:
                raise TreeError("a quoted name is not closed")
            nodes[at][3], i = text[i + 1 : end], end + 1
        else:
            j = i
            while j < n and text[j] not in ":,();[" and not text[j].isspace():
                j += 1
            nodes[at][3], i = text[i:j], j
    if not closed or nodes[at][1] is not None:
        raise TreeError("a tree must end with ';' outside all brackets")
    return [tuple(x) for x in nodes]  # type: ignore[misc]


def newick_nodes(texts: DataFrame) -> DataFrame:
    """Node rows of tree texts (tree, text); NEXUS text is taken from its first bracket after BEGIN TREES."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tree, text in zip(pdf["tree"], pdf["text"], strict=True):
                if text.lstrip().upper().startswith("#NEXUS"):
                    begin = text.upper().find("BEGIN TREES")
                    if begin < 0 or text.find("(", begin) < 0:
                        raise TreeError("no tree in the NEXUS text")
                    body = text[text.find("(", begin) :]
                    text = body[: body.find(";") + 1]
                rows += [(tree, *x) for x in parse_newick(text)]
            yield pd.DataFrame(rows, columns=["tree", "node", "parent", "ord", "name", "length"]).astype({"tree": "int64", "node": "int64", "parent": "Int64", "ord": "int32"})

    return texts.select("tree", "text").mapInPandas(parse, NODES)


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Trees of a text file, separated by ';'."""
    rows = spark.read.option("lineSep", ";").text(path).where(F.col("value").rlike(r"\("))
    return newick_nodes(rows.select(F.monotonically_increasing_id().alias("tree"), F.concat("value", F.lit(";")).alias("text")))


def number_text(x: Column, digits: int = 12) -> Column:
    """A number above 0 with that many digits at most, without zeros at its end, as an exponent where it is far from 1; 0 for others."""
    shown = F.format_string(f"%.{digits - 1}e", x)
    digit = F.replace(F.substring_index(shown, "e", 1), F.lit("."), F.lit(""))
    e = F.substring_index(shown, "e", -1).cast("int")
    fixed = F.when(e >= 0, F.concat(F.substring(digit, F.lit(1), e + 1), F.lit("."), F.substring(digit, e + 2, F.lit(digits)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0))), digit))
    power = F.abs(e).cast("string")
    far = F.concat(F.regexp_replace(F.substring_index(shown, "e", 1), r"\.?0*$", ""), F.when(e < 0, "e-").otherwise("e+"), F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    return F.when(x > 0, F.when((e < -4) | (e >= digits), far).otherwise(F.regexp_replace(fixed, r"\.?0*$", ""))).otherwise("0")


def tree_tokens(nodes: DataFrame) -> DataFrame:
    """(tree, rank, token): the text of trees in pieces, numbered without a gap: what a walk around the tree writes when it enters and leaves a node.

    A node row may have a `note`, which is written in brackets behind the name, as supports and other annotations are."""
    kind = nodes.select(F.struct("tree", "node").alias("node"), F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").alias("node"))).alias("parent"), F.struct("ord", "node").alias("order"))
    tour = trees.toured(kind, "order")
    facts = nodes.select(F.struct("tree", "node").alias("node"), "tree", F.coalesce("name", F.lit("")).alias("name"), "length", F.col("note") if "note" in nodes.columns else F.lit(None).cast("string").alias("note"))
    both = tour.join(facts, "node")
    inner, root = F.col("size") > 1, F.col("depth") == 0
    enter = F.concat(F.when(F.col("nth") > 1, ",").otherwise(""), F.when(inner, "(").otherwise(""))
    length = F.when(F.col("length").isNotNull() & ~root, F.concat(F.lit(":"), number_text(F.col("length")))).otherwise("")
    note = F.when(F.col("note").isNotNull(), F.concat(F.lit("[&"), F.col("note"), F.lit("]"))).otherwise("")
    leave = F.concat(F.when(inner, ")").otherwise(""), "name", note, length, F.when(root, ";").otherwise(""))
    tokens = F.array(F.struct(F.col("enter").alias("rank"), enter.alias("token")), F.struct(F.col("leave").alias("rank"), leave.alias("token")))
    return both.select("tree", F.inline(tokens))


def newick_lines(nodes: DataFrame, tokens: int = 2_000) -> DataFrame:
    """(tree, line, text): the text of each tree in lines of so many pieces, so that no row holds a large tree."""
    lines = tree_tokens(nodes).groupBy("tree", F.floor(F.col("rank") / tokens).alias("line")).agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("own"))
    return lines.select("tree", "line", F.array_join(F.transform("own", lambda x: x["token"]), "").alias("text"))


def write_newick(nodes: DataFrame, path: str, tokens: int = 2_000, parts: int | None = None) -> None:
    """Write trees as text files in order of trees and lines: many tasks write a part each, and the parts one behind the other are the text. Without
    `parts` their number follows the text's size."""
    newick_lines(nodes, tokens).repartitionByRange(*([parts] if parts else []), "tree", "line").sortWithinPartitions("tree", "line").select("text").write.text(path)


def newick_text(nodes: DataFrame) -> DataFrame:
    """(tree, text) of node rows, a row with the whole text of each tree: children in their order, lengths with up to 12 digits, 0 for those not
    above 0. Large trees are written by lines, see `write_newick`."""
    lines = newick_lines(nodes).groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("own"))
    return lines.select(F.col("tree").cast("bigint").alias("tree"), F.array_join(F.transform("own", lambda x: x["text"]), "").alias("text"))


def nexus_lines(nodes: DataFrame) -> DataFrame:
    """(tree, part, line, text): a NEXUS document for each tree in lines, in order of part and line: a block of the leaves' names in the order of the
    tree, and a block with the tree and the notes of its nodes."""
    keyed = nodes.select(F.struct("tree", "node").alias("node"), F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").alias("node"))).alias("parent"), F.struct("ord", "node").alias("order"))
    leaves = trees.toured(keyed, "order").where("size = 1").join(nodes.select(F.struct("tree", "node").alias("node"), "tree", "name"), "node").select("tree", "place", "name")
    count = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    block = lambda part, text: count.select("tree", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("line"), text.alias("text"))
    head = block(0, F.concat(F.lit("#NEXUS\nBEGIN TAXA;\nDIMENSIONS NTAX="), F.col("n").cast("string"), F.lit(";\nTAXLABELS")))
    taxa = leaves.select("tree", F.lit(1).alias("part"), F.col("place").alias("line"), F.coalesce("name", F.lit("")).alias("text"))
    middle = block(2, F.lit(";\nEND;\nBEGIN TREES;\nTREE tree1 = [&R]"))
    body = newick_lines(nodes).select("tree", F.lit(3).alias("part"), "line", "text")
    return head.unionByName(taxa).unionByName(middle).unionByName(body).unionByName(block(4, F.lit("END;")))


def write_nexus(nodes: DataFrame, path: str) -> None:
    """Write a NEXUS document of one tree, as `write_newick` does."""
    nexus_lines(nodes).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("text").write.text(path)


def nexus_text(names: list[str], newick: str) -> str:
    """A NEXUS document with a taxa block and one tree, of a few names and a short text."""
    taxa = "\n".join(names)
    return f"#NEXUS\nBEGIN TAXA;\nDIMENSIONS NTAX={len(names)};\nTAXLABELS\n{taxa}\n;\nEND;\nBEGIN TREES;\nTREE tree1 = [&R] {newick}\nEND;\n"


def minor_clades(rows: DataFrame) -> DataFrame:
    """(aln, host, clade): a row with those that it absorbs as one clade of zero lengths, from rows (aln, host, seq, host_name, name)."""
    parts = rows.groupBy("aln", "host", "host_name").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("own"))
    names = F.array_join(F.transform("own", lambda x: F.concat(x["name"], F.lit(":0"))), ",")
    return parts.select("aln", "host", F.concat(F.lit("("), "host_name", F.lit(":0,"), names, F.lit(")")).alias("clade"))
