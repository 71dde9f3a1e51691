"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks, and the anchors are the words whose blocks are each all 0 or all 1: a covering code
whose radius is the sum of half the block lengths. Each distinct fingerprint has a home, its nearest anchor (the
majority of every block), and is replicated to those anchors within covering radius plus threshold that are the home
of some word within the threshold. Any two linked fingerprints thus meet at the home of each of them, and are compared
there. Anchors multiply with the number of distinct fingerprints, so that a home stays of about the same size; an
anchor that still gets very many fingerprints is cut into cells that are compared as separate groups. Each group gives
the edges of a forest, never all its pairs, and the forests are joined to components.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, shingles are `shingle` words joined by a space, repeats included;
fewer words are one shingle. A bit is 1 if it is set in over half the XXH64 hashes (seed 42).

Defined results: null, empty and wordless texts have fingerprint zero, which links like any other; repeated rows are
nodes like any others; null ids are passed over when the smallest id is sought and get their group's, or null if it has
none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, fresh_name, join_groups, materialise
from tessella.llm.components import components

SHINGLE, THRESHOLD, SEED = 3, 2, 42
#: Fingerprints that a home should have, about; and replicas beyond which an anchor is cut into cells.
HOME, CELL = 512, 1 << 16
#: Hashes whose bits are counted at once, and pairs compared at once.
HASHES, PAIRS = 1 << 14, 1 << 20


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are 1 where over half the hashes have one; zero of no hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASHES):
        part = np.ascontiguousarray(hashes[at : at + HASHES], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    return majority(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts)))


def fingerprint_of(text_col: str = "text", shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column, as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return run(as_bytes(text_col))


def block_masks(distinct: int, home: int = HOME) -> np.ndarray:
    """Bit masks of the code's blocks: 64 bits cut into as many blocks as make about distinct / home anchors."""
    m = min(32, max(4, math.ceil(math.log2(max(1, distinct) / home)) if distinct > home else 4))
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return np.array([sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])], dtype=np.uint64)


def replicas(prints: np.ndarray, masks: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of fingerprint, anchor, whether it is the home) for every anchor that is home to a word within the threshold."""
    ones = np.stack([np.bitwise_count(prints & m) for m in masks], axis=1).astype(np.int64)
    width = np.bitwise_count(masks).astype(np.int64)
    high = 2 * ones > width
    home = (high * (1 << np.arange(len(masks)))).sum(axis=1)
    # Bits that must flip before a block's majority does.
    cost = np.where(high, ones - width // 2, width // 2 + 1 - ones)
    index, anchor = [np.arange(len(prints))], [home]
    for size in range(1, threshold + 1):
        for blocks in combinations(range(len(masks)), size):
            near = np.flatnonzero(cost[:, blocks].sum(axis=1) <= threshold)
            index.append(near)
            anchor.append(home[near] ^ sum(1 << b for b in blocks))
    index, anchor = np.concatenate(index), np.concatenate(anchor)
    return index, anchor, anchor == home[index]


def _spread(masks: np.ndarray, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(prints), 4096):
                part = prints[at : at + 4096]
                index, anchor, home = replicas(part, masks, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(hop := root[root], root):
                root = hop
    return root


def _linked(prints: np.ndarray, homes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted fingerprints, one at home, that differ in `threshold` bits or fewer."""
    neighbours = sum(math.comb(64, k) for k in range(threshold + 1))
    if len(prints) < 16 * neighbours:
        step = max(1, PAIRS // max(1, len(prints)))
        for at in range(0, len(homes), step):
            own = homes[at : at + step]
            i, j = np.nonzero(np.bitwise_count(prints[own][:, None] ^ prints[None, :]) <= threshold)
            yield own[i], j
        return
    for k in range(1, threshold + 1):
        for bits in combinations(range(64), k):
            want = prints[homes] ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(prints, want), len(prints) - 1)
            found = prints[at] == want
            if found.any():
                yield homes[found], at[found]


def _compare(threshold: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        signed, first = np.unique(group["fp"].to_numpy(), return_index=True)
        prints = signed.view(np.uint64)
        order = np.argsort(prints)
        prints = prints[order]
        home = group["home"].to_numpy()[first][order]
        root = _roots(len(prints), _linked(prints, np.flatnonzero(home), threshold))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"u": prints[moved].view(np.int64), "v": prints[root[moved]].view(np.int64)})

    return run


def _cells(spread: DataFrame, cell: int) -> DataFrame:
    """Replicas with the cell that they are compared in: one an anchor, or a grid of home parts by replica parts."""
    crowded = spread.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("at_home")).where(F.col("n") > cell)
    grid = {r["anchor"]: (-(-r["at_home"] // cell) or 1, -(-r["n"] // cell)) for r in crowded.collect()}  # replicas / cell at most
    plain = spread.withColumn("cell", F.lit(0))
    if not grid:
        return plain
    sides = F.broadcast(
        spread.sparkSession.createDataFrame([(a, h, r) for a, (h, r) in grid.items()], "anchor long, homes int, parts int")
    )
    hot = spread.join(sides, "anchor")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("homes")).cast("int")
    # At home a fingerprint is compared in its row of the grid with every part; as a replica it stands in its column.
    at_home = hot.where("home").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: mine * F.col("parts") + p)))
    replica = hot.withColumn("home", F.lit(False)).withColumn(
        "cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda h: h * F.col("parts") + part))
    )
    both = at_home.unionByName(replica).groupBy("anchor", "cell", "fp").agg(F.max("home").alias("home"))
    rest = plain.join(F.broadcast(sides.select("anchor")), "anchor", "left_anti")
    columns = ["anchor", "fp", "home", "cell"]
    return rest.select(columns).unionByName(both.select(columns))


def anchor_links(prints: DataFrame, threshold: int = THRESHOLD, home: int = HOME, cell: int = CELL) -> DataFrame:
    """Edges (u, v) of a forest for each anchor, which together join all linked fingerprints, from a frame of distinct fingerprints `fp`."""
    masks = block_masks(prints.count(), home)
    spread = prints.select("fp").mapInArrow(_spread(masks, threshold), "anchor long, fp long, home boolean")
    return _cells(spread, cell).groupBy("anchor", "cell").applyInPandas(_compare(threshold), "u long, v long")


def link_fingerprints(prints: DataFrame, threshold: int = THRESHOLD, home: int = HOME, cell: int = CELL) -> DataFrame:
    """(node, root) of every linked fingerprint, from a frame of distinct fingerprints `fp`; those without links are left out."""
    return components(anchor_links(prints, threshold, home, cell))


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id, text_key (a hash of the text), fp (signed), component_id."""
    rows = materialise(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), fingerprint_of(text_col, shingle).alias("fp"))
    )
    prints = materialise(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    roots = link_fingerprints(prints, threshold)
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed)
    sizes = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    groups = join_groups(placed, sizes, "root", "members", prints.count()).select("fp", "copies", "component_id")
    return join_groups(rows, materialise(groups), "fp", "copies", rows.count()).drop("copies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **args: int) -> DataFrame:
    """One row per document: id, fingerprint (16 lower-case hex digits), component_id (smallest id reachable)."""
    return label(docs, id_col, text_col, **args).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **args: int) -> DataFrame:
    """The documents with the smallest id of each component, with all columns; of rows that tie one stays.

    Rows with a null id stay only where their whole component has none, one of each.
    """
    return keep_first(docs, label(docs, id_col, text_col, **args), id_col, text_col)


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One document of each component of `rows`, the label of each document, by the smallest id."""
    # One text for each component: rows of its smallest id, the smallest text key; then whole rows are counted.
    first = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", "text_key", "component_id", "fp").agg(F.count("*").alias("rows"))
    named = first.withColumn("group", F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("null "), F.hex("fp"))))
    kept = named.groupBy("group").agg(F.min_by(F.struct("id", "text_key", "rows"), "text_key").alias("k")).select("k.*")
    key, many, same_id, same_key = (fresh_name(docs, n) for n in ("text_key_", "rows_", "kept_id_", "kept_key_"))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    right = materialise(kept.select(F.col("id").alias(same_id), F.col("text_key").alias(same_key), F.col("rows").alias(many)))
    joined = keyed.join(right, keyed[id_col].eqNullSafe(right[same_id]) & (keyed[key] == right[same_key])).drop(same_id, same_key)
    single = joined.where(F.col(many) == 1)
    several = joined.where(F.col(many) > 1).dropDuplicates([id_col, key])
    return single.unionByName(several).select(docs.columns)
