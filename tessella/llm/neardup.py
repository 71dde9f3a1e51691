"""Near-duplicates at a Jaccard similarity of word shingles: candidates by SimHash anchors and MinHash bands, links confirmed.

Words are as in simhash; a text's set has its distinct shingles of `shingle` words, fewer words are one shingle. Texts of
equal sets are one node. A node has a SimHash fingerprint of its shingles, and nodes whose fingerprints anchor covering
links (simhash.anchor_links) are candidates. At a similarity of 0.8 fingerprints differ in 10 of 64 bits on
average and in up to 18, which no covering code reaches with few replicas, so a node also has BANDS x ROWS minimum
hashes, and two nodes are candidates if all ROWS of a band agree: a pair of similarity 0.8 is missed with probability
(1 - 0.8 ** 4) ** 32 < 5e-8. Candidates are linked if the Jaccard similarity of their whole sets is `least` or more.

First each node is compared with the smallest of its fingerprint, of those that an anchor links to it and of each of its
bands; whatever is compared is one cluster, and the links join it to components. Clusters with one component are done; in
the others each component is compared with all others but the largest with itself, so that no link that would join
components is passed over. Pairs are first told apart by their minimum hashes: at a similarity of 0.8 fewer than AGREE of
128 agree with probability below 1e-6. Sets are sent to cells of parts of a cluster and compared there, so that no pair
is a row and a set goes to few places.

Defined results: null, empty and wordless texts have the empty set and are one node; texts of any length are read whole,
a slice at a time; rows without an id are as in simhash; repeated rows are one node; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import simhash
from tessella.llm.common import as_bytes, in_slices, join_groups, materialise, mix, word_hashes
from tessella.llm.components import components

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 4
#: Minimum hashes, of BANDS x ROWS, that agree in every pair worth a look, at the default similarity.
AGREE = 76
#: Hashes that are permuted at once, and sets that one is compared with at once.
HASHES, TOGETHER = 1024, 32
#: Bytes of sets that a part of a cluster has, about, and bytes of a set that are one row.
BLOCK, PIECE = 1 << 20, 8 << 10
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
_TIMES, _PLUS = _RANDOM[0] | np.uint32(1), _RANDOM[1]
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each shingle of a text, repeats included, from the hashes of its words."""
    size = min(shingle, len(words))
    if not size:
        return words
    places = len(words) - size + 1
    out = mix(words[:places], np.full(places, size, dtype=np.uint64) * _LENGTH)
    for k in range(1, size):
        out = mix(out, words[k : places + k])
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The BANDS x ROWS minimum hashes of a set."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(short), HASHES):
        np.minimum(least, (short[at : at + HASHES, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return least


def _hashed(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Shingle hashes of each text, repeats included."""
    for a, b in in_slices(texts):
        words, counts = word_hashes([t.lower() for t in texts[a:b]], SEED)
        ends = np.cumsum(counts)
        yield from (shingle_hashes(words[x:y], shingle) for x, y in zip(ends - counts, ends))


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for batch in batches:
            nodes, sizes, prints, signs, bands = [], [], [], [], []
            for hashes in _hashed(batch.column("text").to_pylist(), shingle):
                prints.append(simhash.majority(hashes))
                own = np.unique(hashes)
                least = minima(own)
                nodes.append(xxh3_128_digest(own.tobytes(), SEED))
                sizes.append(len(own))
                signs.append(least.astype(np.uint8).tobytes())
                bands.append([xxh3_64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))])
            flat = pa.array(np.array(bands, dtype=np.uint64).reshape(-1).view(np.int64))
            columns = [
                batch.column("id"), batch.column("text_key"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(signs, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * BANDS, pa.int32()), flat),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "node", "size", "fp", "sign", "bands"])

    return run


def _sets(shingle: int):
    """Sorted distinct shingle hashes of texts, for those that are the node they are taken for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            nodes, sets = [], []
            for node, hashes in zip(batch.column("node").to_pylist(), _hashed(batch.column("text").to_pylist(), shingle)):
                own = np.unique(hashes).tobytes()
                if xxh3_128_digest(own, SEED) == node:
                    nodes.append(node)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return run


def _confirmed(least: float):
    """Links of cells that follow one another: pieces of sets (kind 0) first, then pairs (kind 1); those that are linked already are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pieces, sets, root = None, {}, {}, {}

        def top(x: bytes) -> bytes:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        def hashes(x: bytes) -> np.ndarray:
            if x not in sets:
                sets[x] = np.frombuffer(b"".join(pieces[x]), np.uint64)
            return sets[x]

        for batch in batches:
            linked = []
            for *key, kind, u, v, piece in zip(*(batch.column(c).to_pylist() for c in ("cluster", "p", "q", "kind", "u", "v", "piece"))):
                if key != cell:
                    cell, pieces, sets, root = key, {}, {}, {}
                if not kind:
                    pieces.setdefault(u, []).append(piece)
                elif (a := top(u)) != (b := top(v)):
                    x, y = hashes(u), hashes(v)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= least * (len(x) + len(y) - both):
                        root[a] = b
                        linked.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.binary()) for k in (0, 1)], names=["u", "v"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, clusters: DataFrame, least: float, block: int) -> DataFrame:
    """Those of the distinct pairs (u, v) of nodes that are similar, but for links between what others link already.

    A cluster (node, cluster, size; closed under pairs) is cut into parts of about `block` bytes of sets, and the pairs of
    two parts meet with the sets that they need in a cell, so that a set is sent once a cell and not once a pair.
    """
    total = clusters.groupBy("cluster").agg(F.sum("size").alias("hashes"), F.count("*").alias("n"))
    parts = F.ceil(F.col("hashes") * 8 / block).cast("int")
    placed = join_groups(clusters, total, "cluster", "n", clusters.count())
    placed = materialise(placed.select("node", "cluster", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), parts)).cast("int").alias("part")))
    of = lambda c: placed.select(F.col("node").alias(c), "cluster", F.col("part").alias(f"{c}_part"))
    cells = pairs.join(of("u"), "u").join(of("v").drop("cluster"), "v")
    cells = materialise(cells.select("u", "v", "cluster", F.least("u_part", "v_part").alias("p"), F.greatest("u_part", "v_part").alias("q")))
    wanted = cells.select("cluster", "p", "q", F.col("u").alias("node")).unionByName(cells.select("cluster", "p", "q", F.col("v").alias("node"))).distinct()
    pieces = F.expr(f"transform(sequence(0, greatest(0, (octet_length(hashes) - 1) div {PIECE})), k -> substring(hashes, k * {PIECE} + 1, {PIECE}))")
    own = wanted.join(sets, "node").select("cluster", "p", "q", F.lit(0).alias("kind"), F.col("node").alias("u"), F.lit(None).cast("binary").alias("v"), F.posexplode(pieces).alias("nth", "piece"))
    asked = cells.select("cluster", "p", "q", F.lit(1).alias("kind"), "u", "v", F.lit(0).alias("nth"), F.lit(None).cast("binary").alias("piece"))
    both = own.unionByName(asked).repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "kind", "u", "nth", "v")
    return materialise(both.select("cluster", "p", "q", "kind", "u", "v", "piece").mapInArrow(_confirmed(least), "u binary, v binary"))


def _in_order(pairs: DataFrame) -> DataFrame:
    return materialise(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def _overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes of each of the other sets are in this one."""
    flat, sizes = np.concatenate(others), np.array([len(o) for o in others])
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.array([c.sum() for c in np.split(own[at] == flat, np.cumsum(sizes)[:-1])])


def _across(least: float, agree: int):
    """Links across components in cells that follow one another.

    The nodes of a cell's side 1 are compared with those of side 0, or with one another if it has none. Of the nodes of
    other components, like size and `agree` equal minimum hashes, those most alike come first; what is joined meanwhile is
    passed over, so that a cell gives fewer links than it has components.
    """

    def links(nodes: list[list]) -> list[tuple[bytes, bytes]]:
        name, side, size, sign, root, pieces = zip(*nodes)
        side, size = np.array(side), np.array(size)
        sign = np.frombuffer(b"".join(sign), np.uint8).reshape(len(side), -1)
        component = np.unique(np.array([r.hex() for r in root]), return_inverse=True)[1]
        top, sets, found = np.arange(component.max() + 1), {}, []

        def hashes(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.frombuffer(b"".join(pieces[i]), np.uint64)
            return sets[i]

        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for n, i in enumerate(b.tolist()):
            j = a if len(a) else b[n + 1 :]
            j = j[(top[component[j]] != top[component[i]]) & (np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i]))]
            equal = (sign[j] == sign[i]).sum(axis=1)
            j = j[np.argsort(-equal, kind="stable")][: np.count_nonzero(equal >= agree)]
            while len(j):
                now, j = j[:TOGETHER], j[TOGETHER:]
                both = _overlaps(hashes(i), [hashes(k) for k in now.tolist()])
                for k in now[both >= least * (size[now] + size[i] - both)].tolist():
                    x, y = top[component[i]], top[component[k]]
                    if x != y:
                        top[top == x] = y
                        found.append((name[i], name[k]))
                j = j[top[component[j]] != top[component[i]]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes = None, []
        for batch in batches:
            linked = []
            for *key, node, side, size, sign, root, piece in zip(*(batch.column(c).to_pylist() for c in ("cluster", "p", "q", "node", "side", "size", "sign", "root", "piece"))):
                if key != cell:
                    linked += links(nodes) if len(nodes) > 1 else []
                    cell, nodes = key, []
                if nodes and nodes[-1][0] == node:
                    nodes[-1][-1].append(piece)
                else:
                    nodes.append([node, side, size, sign, root, [piece]])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.binary()) for k in (0, 1)], names=["u", "v"])
        linked = links(nodes) if len(nodes) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.binary()) for k in (0, 1)], names=["u", "v"])

    return run


def _links_across(paired: DataFrame, clusters: DataFrame, roots: DataFrame, sets: DataFrame, least: float, agree: int, block: int) -> DataFrame:
    """Links between the components of each cluster that has several.

    The nodes of a cluster's largest component are cut into parts of about `block` bytes of sets, and so are all its other
    nodes. Each part of the others meets each part of both in a cell: nothing is compared inside the largest component, and
    a set is sent once for each part of the others.
    """
    placed = clusters.join(paired.select("node", "sign"), "node").join(roots, "node", "left")
    placed = materialise(placed.select("node", "cluster", "size", "sign", F.coalesce("root", "node").alias("root")))
    counts = placed.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"))
    most = F.max_by(F.struct("root", "hashes"), F.struct("n", "root"))
    several = counts.groupBy("cluster").agg(F.sum("n").alias("n"), F.count("*").alias("components"), most.alias("most"), F.sum("hashes").alias("hashes")).where("components > 1")
    several = materialise(several.select("cluster", "n", F.col("most.root").alias("largest"), F.col("most.hashes").alias("inside"), (F.col("hashes") - F.col("most.hashes")).alias("outside")))
    rows = join_groups(placed, several, "cluster", "n", clusters.count())
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) * 8 / block)).cast("int")
    rows = rows.withColumns({"a": parts("inside"), "b": parts("outside"), "other": F.col("root") != F.col("largest")})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("b")).otherwise(F.col("a"))).cast("int"))
    columns = ["cluster", "node", "size", "sign", "root"]
    cell = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(side).alias("side"))
    every = lambda low, high: F.when(high >= low, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))
    zero, own, last = F.lit(0), F.col("own"), F.col("b") - 1
    inside = F.transform(F.sequence(zero, last), lambda q: cell(own, q, 0))
    # Cells of two parts of the others are numbered after those with a part of the largest component.
    first = F.transform(every(own + 1, last), lambda q: cell(F.col("a") + own, q, 0))
    second = F.transform(F.sequence(zero, F.col("a") + own), lambda p: cell(p, own, 1))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("other"), F.concat(first, second)).otherwise(inside))).select(*columns, "cell.*")
    pieces = F.expr(f"transform(sequence(0, greatest(0, (octet_length(hashes) - 1) div {PIECE})), k -> substring(hashes, k * {PIECE} + 1, {PIECE}))")
    sent = rows.join(sets, "node").select(*columns, "p", "q", "side", F.posexplode(pieces).alias("nth", "piece"))
    sent = sent.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "node", "nth")
    return materialise(sent.select("cluster", "p", "q", "node", "side", "size", "sign", "root", "piece").mapInArrow(_across(least, agree), "u binary, v binary"))


def _fingerprint_pairs(nodes: DataFrame, total: int) -> DataFrame:
    """(u, v): the smallest node of each fingerprint with every other of it, and with the smallest of those that an anchor links to it."""
    hubs = materialise(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("n")))
    same = join_groups(nodes.select("node", "fp"), hubs.where("n > 1"), "fp", "n", total).select(F.col("hub").alias("u"), F.col("node").alias("v"))
    edges = materialise(simhash.anchor_links(hubs))
    of = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"{c}_hub"))
    return same.unionByName(edges.join(of("u"), "u").join(of("v"), "v").select(F.col("u_hub").alias("u"), F.col("v_hub").alias("v")))


def label(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    least: float = LEAST,
    agree: int = AGREE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, text_key (a hash of the text), fp (the smallest node of its component), component_id."""
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), as_bytes(text_col).alias("text"))
    rows = materialise(keyed.mapInArrow(_sketches(shingle), f"id {kind}, text_key long, node binary, size long, fp long, sign binary, bands array<bigint>"))
    total = rows.count()
    # Equal sets have equal sketches, so that any row of a node will do; texts of equal sets may differ, so that id and text are of one row.
    nodes = rows.groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("row"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("sign").alias("sign"),
        F.count("*").alias("copies"), F.first("bands").alias("bands"),
    )
    nodes = materialise(nodes.withColumns({"text_key": F.col("row.text_key"), "least": F.col("row.id")}).drop("row"))
    n_nodes = nodes.count()
    spread = nodes.select(F.explode("bands").alias("band"), "node")
    hubs = materialise(spread.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    shared = materialise(join_groups(spread, hubs, "band", "n", BANDS * n_nodes).select("band", "node", "hub"))
    pairs = _in_order(shared.select(F.col("hub").alias("u"), F.col("node").alias("v")).unionByName(_fingerprint_pairs(nodes, n_nodes)))
    paired = materialise(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.drop("bands"), "node"))
    # One row for each node, but for rows that are equal in id and text.
    wanted = paired.select("text_key", "node", F.col("least").alias("first"), "copies")
    texts = join_groups(keyed, wanted, "text_key", "copies", total).where(F.col("id").eqNullSafe(F.col("first"))).select("node", "text")
    sets = materialise(texts.mapInArrow(_sets(shingle), "node binary, hashes binary").groupBy("node").agg(F.min("hashes").alias("hashes")))
    # Whatever shares a band or a fingerprint group is in one cluster.
    clusters = materialise(paired.select("node", "size").join(components(pairs), "node").select("node", "size", F.col("root").alias("cluster")))
    edges = _links(pairs, sets, clusters, least, block)
    roots = materialise(components(edges))
    more = _links_across(paired, clusters, roots, sets, least, agree, block)
    if not more.isEmpty():
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        across = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
        higher = components(across).select(F.col("node").alias("root"), F.col("root").alias("top"))
        lower = roots.unionByName(higher.select(F.col("root").alias("node"), "root")).distinct()
        roots = materialise(lower.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    placed = materialise(nodes.select("node", "least", "copies").join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root")))
    sizes = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    groups = join_groups(placed, sizes, "root", "members", n_nodes).select("node", "copies", "root", "component_id")
    named = join_groups(rows.select("id", "text_key", "node"), materialise(groups), "node", "copies", total)
    return named.select("id", "text_key", F.col("root").alias("fp"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **args: float) -> DataFrame:
    """The documents with the smallest id of each component, as simhash.drop_near_duplicates has them."""
    return simhash.keep_first(docs, label(docs, id_col, text_col, **args), id_col, text_col)
