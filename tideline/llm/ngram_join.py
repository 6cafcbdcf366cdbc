"""N-gram Jaccard join of whole texts with a prefix tree.

1. Each text becomes the set of its distinct word n-grams (64-bit hashes). Texts with equal sets form a class, known by a
   64-bit digest of the set; only one text of a class goes on.
2. Blocking without loss. Two sets whose similarity reaches `percent` differ in at most k = (a+b)(100-p)/(100+p)
   elements, so if the elements are dealt by hash to k+1 parts, one part is the same in both. Sets emit a
   signature per part. Sizes fall into bands that are one similarity ratio wide, so a pair is in one band or in
   neighbours, and a set emits for its band and, where a partner can be there, for the band below. Nearly empty
   parts say little; each set leaves out at most d of them, and k+1+2d parts make up for that. Signatures are made and
   shuffled once; only those that two classes have are kept.
3. Sketches thin the candidates without loss. A sketch is the parity of a set's elements per hash bucket; the bits in which
   two sketches differ are at most the elements in which the sets do, so a pair with too many such bits has no link.
   First each class is compared with the smallest and the largest class of its signatures, and keeps one partner. Only
   signatures that still hold classes of different components are compared in full. Connected components of the pairs that
   remain are the candidate groups: no link leaves a group, and a passage that many texts share joins none of them.
4. Sets of a group meet in pages. The sets of a page are put in one global order and stored in a prefix tree that they
   are looked up in (see prefix_tree). Groups of one page are done then. Larger ones are dealt to pages anew, and
   what is still apart after that is compared in full.
5. Components of the links give the result, which copies inherit through their class.

"In full" is linear where it can be: classes of the largest component of a signature or group (`big`) are never compared with
each other, only the pages of the others with all pages. A task reports pairs of components, each pair of pages no more
of them than it has components less one, so a cluster of M near copies gives fewer than 2 M links whatever its pages.

Sets are never kept on disk: the texts are read again, which is cheaper. Hash collisions (two of 2**64) are the only
approximation.

Defined results: texts without words have an empty set and are linked with nothing; rows with a null id take no part in
links, and their component is null; rows with the same id but different texts are linked as their texts are; other columns
play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint
from .components import connected_components
from .prefix_tree import link_forest
from .sketch import close_pairs, sketches
from .textkernel import ASCII_LOWER, SPACE_SEPARATORS, Chunk, chunks, mix, ngram_hashes, words

#: Sets in a page of a large group, and elements that the sets of one task have, about.
PAGE_SETS = 512
TASK_ELEMENTS = 1_000_000
#: Bytes of sketches that one task has, about; pairs of sketches that are compared at once.
TASK_BYTES, PAIRS = 32 << 20, 1 << 16
_MIN_WEIGHT = 3


@lru_cache
def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size, number of parts, parts that may be left out) of each band up to a size."""
    first = [1]
    while first[-1] <= largest:
        first.append(-(-first[-1] * 100 // percent) + (first[-1] * 100 % percent == 0))
    first.append(-(-first[-1] * 100 // percent) + 1)
    top = np.array(first[1:]) - 1
    differ = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    spare = np.where(differ >= 8, -(-6 * (differ + 1) // 100), 0)
    return np.array(first[:-1]), np.where(differ > 0, differ + 1 + 2 * spare, 0), spare


def distinct_ngrams(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row, size of each row's set), by row and hash."""
    h, row = ngram_hashes(words(chunk, SPACE_SEPARATORS, ASCII_LOWER), n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
        h, row = h[new], row[new]
    return h, row, np.bincount(row, minlength=len(chunk.begin))


def _digest(h: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.zeros(len(size), np.uint64)
    np.add.at(total, row, mix(h + np.uint64(0x5851F42D4C957F2D)))
    return mix(total ^ mix(size.astype(np.uint64))).view(np.int64)


def _sets_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, parities = [], [], []
        for chunk in chunks(batch.column(1)):
            h, row, size = distinct_ngrams(chunk, n)
            sizes.append(size)
            nodes.append(_digest(h, row, size))
            parities.append(sketches(h, row, size))
        if sizes:
            sketch = pa.chunked_array(parities, pa.binary()).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(nodes)), sketch], names=["doc_id", "n_shingles", "node", "sketch"])


def _signatures(h: np.ndarray, row: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets."""
    first, parts, spare = bands(percent, 1 << max(6, int(size.max(initial=1)).bit_length()))
    own = np.searchsorted(first, size, side="right") - 1
    out = []
    for lower in (0, 1):
        scheme = own - lower
        usable = (size > 0) & (scheme >= 0)
        scheme = np.maximum(scheme, 0)
        if lower:  # is there a size in the band below that can be similar?
            usable &= -(-size * percent // 100) < first[scheme + 1]
        count = np.where(usable, parts[scheme], 0)
        base = np.cumsum(count) - count
        live = count[row] > 0
        hl, rl = h[live], row[live]
        part = ((mix(hl + np.uint64(0x14057B7EF767814F)) >> np.uint64(40)) * count[rl].astype(np.uint64)) >> np.uint64(24)
        place = base[rl] + part.astype(np.int64)
        total = int(count.sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, place, mix(hl))
        weight = np.bincount(place, minlength=total)
        owner = np.repeat(np.arange(len(size)), count)
        number = np.arange(total) - base[owner]
        sig = mix(mix(sums + weight.astype(np.uint64)) ^ mix((scheme[owner] * (1 << 32) + number).astype(np.uint64)))
        # leave out the lightest parts of each set, as many as its scheme spares, if they are light
        light = np.flatnonzero(weight < _MIN_WEIGHT)
        light = light[np.lexsort((weight[light], owner[light]))]
        rank = np.arange(len(light)) - np.searchsorted(owner[light], owner[light], side="left")
        keep = np.ones(total, bool)
        keep[light[rank < spare[scheme[owner[light]]]]] = False
        out.append((sig[keep], owner[keep]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


_SEEN = 1 << 18


def _signature_rows(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # copies within a task emit once; it only saves work, so it may be emptied at any time
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            h, row, size = distinct_ngrams(chunk, n)
            node = _digest(h, row, size)
            fresh = np.zeros(len(size), bool)
            for i in np.flatnonzero(size):
                if node[i] not in seen:
                    seen.add(int(node[i]))
                    fresh[i] = True
            if len(seen) > _SEEN:
                seen.clear()
            pick = fresh[row]
            sig, owner = _signatures(h[pick], row[pick], np.where(fresh, size, 0), percent)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[owner])], names=["sig", "node"])


def _member_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """From (text, node, left, right, ...) the set of each text whose class is `node`, of equal rows mostly one a task."""
    seen: set[tuple[int, int, int]] = set()
    for batch in batches:
        node, left, right = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        rest = [batch.column(i) for i in range(2, batch.num_columns)]
        for chunk in chunks(batch.column(0)):
            h, row, size = distinct_ngrams(chunk, n)
            fits = np.flatnonzero((_digest(h, row, size) == node[chunk.lo : chunk.hi]) & (size > 0))
            keys = [(int(node[i]), int(left[i]), int(right[i])) for i in fits + chunk.lo]
            wanted = []
            for i, k in zip(fits, keys, strict=True):
                if k not in seen:
                    seen.add(k)
                    wanted.append(i)
            if len(seen) > _SEEN:
                seen.clear()
            if wanted:
                right_rows = np.array(wanted)
                keep = np.isin(row, right_rows)
                offsets = np.append(0, np.cumsum(size[right_rows])).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[keep].view(np.int64)))
                take = pa.array(right_rows + chunk.lo)
                yield pa.RecordBatch.from_arrays([pa.array(node[right_rows + chunk.lo]), *[c.take(take) for c in rest], sets], names=["node", *batch.schema.names[2:], "elements"])


def _join_pages(percent: int):  # noqa: ANN202
    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["node", "left", "right", "group"])
        links: list[tuple[int, int]] = []
        for (_, left, right), own in rows.groupby(["group", "left", "right"], sort=True):
            own = own.sort_values("node")
            sets = [np.asarray(x).view(np.uint64) for x in own["elements"]]
            page, component = own["page"].to_numpy(), own["component"].to_numpy()
            probes, stored = (np.flatnonzero(page == p).tolist() for p in (left, right))
            links += [(int(component[i]), int(component[j])) for i, j in link_forest(sets, percent, probes, stored, component)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return join


def _close_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, size and sketch of a, size and sketch of b) the pairs that may be linked."""
    for batch in batches:
        size = np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4)])
        sketch = batch.column(3).to_pylist() + batch.column(5).to_pylist()
        left = np.arange(batch.num_rows)
        keep = pa.array(close_pairs(size, sketch, left, left + batch.num_rows, percent))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])


def _compare_sketches(percent: int):  # noqa: ANN202
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        for (_, left, right), own in rows.groupby(["group", "left", "right"], sort=True):
            node, page, component = (own[c].to_numpy() for c in ("node", "page", "component"))
            size, sketch = own["n_shingles"].to_numpy(), own["sketch"].tolist()
            stored = np.flatnonzero(page == right)
            parent = {int(c): int(c) for c in component}

            def root(c: int, parent: dict[int, int] = parent) -> int:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            for probe in np.array_split(np.flatnonzero(page == left), max(1, len(own) * len(stored) // PAIRS)):
                i, j = (x.ravel() for x in np.meshgrid(probe, stored, indexing="ij"))
                now = np.array([root(int(c)) for c in component])
                fresh = (now[i] != now[j]) & (node[i] < node[j] if left == right else True)
                i, j = i[fresh], j[fresh]
                close = close_pairs(size, sketch, i, j, percent)
                for x, y in zip(i[close].tolist(), j[close].tolist(), strict=True):
                    cx, cy = root(int(component[x])), root(int(component[y]))
                    if cx != cy:
                        parent[cx] = cy
                        edges.append((int(component[x]), int(component[y])))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return compare


def _pages(sets: Column, weight: Column, limit: int) -> Column:
    return F.greatest(F.ceil(sets / PAGE_SETS), F.ceil(weight / limit), F.lit(1)).cast("bigint")


def _dealt(pages: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), pages)


def _across(rows: DataFrame, weight: str, limit: int) -> DataFrame:
    """Deal rows (group, node, component, ...) to pairs of pages so that any two of one group meet in one place, but for two of the
    group's largest component. Groups of one component go. Adds page, left and right; a row is copied once per pair."""
    per = rows.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    first = F.struct("n", "component")
    whole = per.groupBy("group").agg(F.max_by("component", first).alias("big"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("n").alias("n_big"), F.max_by("w", first).alias("w_big"))
    whole = whole.where("n > n_big")
    few, many = _pages(F.col("n") - F.col("n_big"), F.col("w") - F.col("w_big"), limit), _pages(F.col("n_big"), F.col("w_big"), limit)
    rows = rows.join(whole.select("group", "big", few.alias("few"), many.alias("many")), "group")
    of_big = F.col("component") == F.col("big")
    rows = rows.withColumn("page", F.when(of_big, F.col("few") + _dealt(F.col("many"), 3)).otherwise(_dealt(F.col("few"), 3)))
    # pages of the largest component are numbered last and meet only the others
    met = F.sequence(F.lit(0).cast("bigint"), F.when(of_big, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    pairs = F.transform(met, lambda j: F.struct(F.least("page", j).alias("left"), F.greatest("page", j).alias("right")))
    return rows.select("*", F.inline(pairs)).drop("big", "few", "many")


def _in_tasks(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Add task: pairs of pages share tasks of about `limit` in all; weights are summed after rows are copied."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    tasks = int(total // limit) + 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.withColumn("task", F.pmod(F.xxhash64("group", "left", "right"), F.lit(tasks)).cast("int"))


def _close_stars(shared: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the smallest of those partners that may be linked with it, among the first and last classes of its
    signatures; at most one pair for a class."""
    pairs = shared.select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    of = lambda x: known.select(F.col("node").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
    close = both.mapInArrow(lambda it: _close_rows(it, percent), "a bigint, b bigint")
    ways = close.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
    return checkpoint(ways.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))


def _candidate_groups(shared: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that may be linked with another one, from rows (sig, node, low, high)."""
    star = _close_stars(shared, known, percent)
    near = connected_components(star)
    placed = shared.join(near, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    # signatures whose classes are in one component already add nothing, and of those with the same classes one is enough
    same = [F.count(F.lit(1)).alias("sets"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *same).where("lo <> hi")
    mixed = mixed.groupBy("sets", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    bare = placed.join(mixed, "sig").join(known.select("node", "n_shingles", F.octet_length("sketch").alias("bytes")), "node")
    bare = checkpoint(_across(checkpoint(bare.withColumnRenamed("sig", "group")), "bytes", TASK_BYTES // 4))
    bare = _in_tasks(bare, F.col("bytes") + 64, TASK_BYTES)
    sketched = bare.drop("bytes").join(known.select("node", "sketch"), "node")
    more = sketched.groupBy("task").applyInPandas(_compare_sketches(percent), "a bigint, b bigint")
    return connected_components(star.union(more))


def _links_in_pages(source: DataFrame, dealt: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): components to be joined, from rows (node, group, component, doc_id, n_shingles, page, left, right)."""
    dealt = _in_tasks(dealt, F.col("n_shingles"), TASK_ELEMENTS).withColumnRenamed("doc_id", "member_id")
    # always a shuffled join, since members grow with the corpus: so a small input needs what a large one does
    texts = source.join(dealt.hint("merge"), F.col("doc_id") == F.col("member_id")).select("text", "node", "left", "right", "group", "component", "page", "task")
    sets = texts.mapInArrow(lambda it: _member_rows(it, n), "node bigint, `left` bigint, `right` bigint, group bigint, component bigint, page bigint, task int, elements array<bigint>")
    return sets.groupBy("task").applyInPandas(_join_pages(percent), "a bigint, b bigint")


def _exact_links(source: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) between classes, whose components are those of all links, from candidates (node, group, doc_id, n_shingles)."""
    size = members.groupBy("group").agg(_pages(F.count(F.lit(1)), F.sum("n_shingles"), TASK_ELEMENTS).alias("pages"))
    members = checkpoint(members.join(size, "group"))

    def own_pages(rows: DataFrame, seed: int) -> DataFrame:
        page = _dealt(F.col("pages"), seed)
        return rows.select("node", "group", "component", "doc_id", "n_shingles", page.alias("page"), page.alias("left"), page.alias("right"))

    links = checkpoint(_links_in_pages(source, own_pages(members.withColumn("component", F.col("node")), 1), n, percent))
    large = members.where("pages > 1")
    if large.isEmpty():
        return links
    for last in (False, True):
        joined = connected_components(links)
        placed = large.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = placed.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("group")
        placed = checkpoint(placed.join(apart, "group"))
        dealt = checkpoint(_across(placed.drop("pages"), "n_shingles", TASK_ELEMENTS)) if last else own_pages(placed, 2)
        links = checkpoint(links.union(_links_in_pages(source, dealt, n, percent)).distinct())
    return links


def ngram_links(docs: DataFrame, n: int = 3, percent: int = 90, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (doc_id, n_shingles, node) of all documents, where node is the class of equal sets, and links
    (a, b) between classes, which connect what all links at similarity percent / 100 connect."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, node bigint, sketch binary"
    rows = checkpoint(source.mapInArrow(lambda it: _sets_of(it, n), fields))
    signed = source.where("doc_id is not null").select("text").mapInArrow(lambda it: _signature_rows(it, n, percent), "sig bigint, node bigint")
    sig = Window.partitionBy("sig")
    shared = signed.withColumn("low", F.min("node").over(sig)).withColumn("high", F.max("node").over(sig)).where("low < high")
    shared = checkpoint(shared.distinct())
    known = rows.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    known = checkpoint(known.join(shared.select("node").distinct(), "node", "left_semi"))
    groups = _candidate_groups(shared, known, percent)
    members = groups.join(known, "node").select("node", F.col("component").alias("group"), "doc_id", "n_shingles")
    return rows.drop("sketch"), _exact_links(source, checkpoint(members), n, percent)


def _components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with `key`, the component of their class."""
    return rows.join(connected_components(links), "node", "left").withColumn("key", F.coalesce("component", "node"))


def ngram_groups(docs: DataFrame, n: int = 3, percent: int = 90, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of documents: doc_id, n_shingles and component_id, the smallest id that links lead to."""
    known = _components(*ngram_links(docs, n, percent, text, doc_id))
    linked = known.where("n_shingles > 0 and doc_id is not null")
    least = linked.groupBy("key").agg(F.min("doc_id").alias("least"))
    out = known.join(least.withColumnRenamed("key", "least_key"), (F.col("key") == F.col("least_key")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _with_class(batches: Iterator[pa.RecordBatch], n: int, text: str) -> Iterator[pa.RecordBatch]:
    """From (row, doc_id), the text being a field of the row, rows (row, doc_id, node, body), body being a digest of the words as they stand; of equal rows mostly one a task."""
    seen: set[tuple] = set()
    for batch in batches:
        nodes, bodies = [], []
        for chunk in chunks(batch.column(0).field(text)):
            nodes.append(_digest(*distinct_ngrams(chunk, n)))
            w = words(chunk, SPACE_SEPARATORS)
            place = np.arange(len(w.hash), dtype=np.int64) - w.first[w.row]
            total = np.zeros(len(chunk.begin), np.uint64)
            np.add.at(total, w.row, mix(w.hash ^ mix(place.astype(np.uint64))))
            bodies.append(total.view(np.int64))
        if not nodes:
            continue
        node, body = np.concatenate(nodes), np.concatenate(bodies)
        fresh = []
        for i, k in enumerate(zip(batch.column(1).to_pylist(), node.tolist(), body.tolist(), strict=True)):
            if k not in seen:
                seen.add(k)
                fresh.append(i)
        if len(seen) > _SEEN:
            seen.clear()
        take = pa.array(fresh, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(node).take(take), pa.array(body).take(take)], names=["row", "doc_id", "node", "body"])


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without near duplicates: of each component the text with the smallest id stays, of several such texts under that id
    the one of smallest class. Of rows with the same id and class one stays (of unlike rows that of the smallest digest of its words;
    among rows that differ in other columns only, any). Rows without words or id all stay."""
    known = _components(*ngram_links(docs, n, percent, text, doc_id)).where("n_shingles > 0 and doc_id is not null")
    kept = known.groupBy("key").agg(F.min(F.struct("doc_id", "node")).alias("kept")).select(F.col("kept.doc_id").alias("doc_id"), F.col("kept.node").alias("node"))
    wordy = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col(doc_id).isNotNull()
    # the text goes to the tasks once, within its row
    packed = docs.where(wordy).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"))
    schema = T.StructType([packed.schema["row"], packed.schema["doc_id"], T.StructField("node", T.LongType()), T.StructField("body", T.LongType())])
    classed = packed.mapInArrow(lambda it: _with_class(it, n, text), schema)
    # one shuffle of the texts: the rows of one id and class are together after the join
    stay = classed.join(kept.hint("merge"), ["doc_id", "node"]).groupBy("doc_id", "node").agg(F.min_by("row", "body").alias("row"))
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).union(docs.where(~wordy))
