"""Near-duplicates of the pipeline against all pairs."""

import random
import re
from itertools import combinations

import numpy as np

import corpus_pipeline
from tessella.llm import neardup


def shingles(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(texts, least=0.8):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        union = sets[i] | sets[j]
        if not union or len(sets[i] & sets[j]) >= least * len(union):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def copies(seed, n):
    """Texts of 200 words, n chains of ten in which each has three words of the one before changed, and odd texts."""
    draw = random.Random(seed)
    out = ["", None, "one two", "One  TWO", "a b c d e", "a b c d e f"]
    for _ in range(n):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        for _ in range(10):
            out.append(" ".join(words))
            for at in draw.sample(range(200), 3):
                words[at] = f"x{draw.randrange(10**6)}"
    return out


def test_near_stage_links_all_at_four_fifths(spark, sf_dir):
    texts = copies(3, 4) + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r["doc_id"] for r in near(spark, docs, sf_dir).collect()) == sorted(set(brute(texts)))


def test_hubs_alone_are_not_enough(spark):
    """A group whose smallest node is like few of the others is linked through the pairs that stay open."""
    draw = random.Random(4)
    texts = []
    for _ in range(6):
        core = [f"w{draw.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(core[:at] + [f"y{k}{j}" for j in range(8)] + core[at + 8 :]) for k, at in enumerate(range(0, 280, 14))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = brute(texts)
    for block in (neardup.BLOCK, 9000):
        assert {r["id"]: r["component_id"] for r in neardup.label(docs, block=block).collect()} == dict(enumerate(label))


def test_links_across_components(spark):
    """All components of a cluster are compared, whatever its parts; clusters of one component give nothing."""
    draw = random.Random(11)
    core = [draw.randrange(1 << 60) for _ in range(100)]
    sets = {i: sorted({*core[: 100 - 2 * (i % 8)], *(draw.randrange(1 << 60) for _ in range(i % 8))}) for i in range(40)}
    name = lambda i: bytes([i])
    rows = [(name(i), len(s), neardup.minima(np.array(s, np.uint64)).astype(np.uint8).tobytes()) for i, s in sets.items()]
    paired = spark.createDataFrame(rows, "node binary, size long, sign binary")
    hashes = spark.createDataFrame([(name(i), np.array(s, np.uint64).tobytes()) for i, s in sets.items()], "node binary, hashes binary")
    clusters = spark.createDataFrame([(name(i), len(s), name(i // 30)) for i, s in sets.items()], "node binary, size long, cluster binary")
    roots = {i: 2 if i < 20 else i for i in range(30)} | {i: 30 for i in range(30, 40)}
    known = spark.createDataFrame([(name(i), name(r)) for i, r in roots.items() if i != r or i == 30], "node binary, root binary")
    similar = lambda i, j: len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))
    label = dict(roots)
    for i, j in combinations(range(30), 2):
        if similar(i, j):
            a, b = sorted((label[i], label[j]))
            label = {k: a if x == b else x for k, x in label.items()}
    for block in (neardup.BLOCK, 4000, 900):
        found = dict(roots)
        for r in neardup._links_across(paired, clusters, known, hashes, 0.8, neardup.AGREE, block).collect():
            i, j = r["u"][0], r["v"][0]
            assert similar(i, j) and i < 30 and j < 30
            a, b = sorted((found[i], found[j]))
            found = {k: a if x == b else x for k, x in found.items()}
        assert len(set(found.values())) == len(set(label.values())) < len(set(roots.values()))


def test_minima_tell_pairs_apart():
    """Pairs of similarity 0.8 or more share a band and AGREE minimum hashes."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        both, one = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        a, b = neardup.minima(both), neardup.minima(np.concatenate([both, one, one + np.uint64(1)]))
        assert (a == b).reshape(neardup.BANDS, -1).all(axis=1).any() and (a.astype(np.uint8) == b.astype(np.uint8)).sum() >= neardup.AGREE


def test_long_texts_in_pieces(spark):
    draw = random.Random(9)
    words = [f"w{draw.randrange(10**6)}" for _ in range(30_000)]
    other = words[:]
    for at in draw.sample(range(30_000), 600):
        other[at] = "x"
    docs = spark.createDataFrame([(5, " ".join(words)), (6, " ".join(other)), (7, " ".join(words[:20_000])), (8, "short one")], "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in neardup.label(docs).collect()} == {5: 5, 6: 5, 7: 7, 8: 8}


def test_near_empty(spark):
    assert neardup.label(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_equal_sets_that_differ(spark):
    """Case, spacing and repeats make other texts of the same set, whichever of them has the smallest id."""
    draw = random.Random(5)
    texts = []
    for _ in range(8):
        words = [f"w{draw.randrange(5000)}" for _ in range(100)]
        same = [" ".join(words), "  ".join(words), " ".join(words).upper(), " ".join(words * 2 + words[:4]), " ".join(words * 3 + words[:4])]
        draw.shuffle(same)
        words[50] = "other"
        texts += [*same, " ".join(words)]
    label = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in neardup.label(docs).collect()} == dict(enumerate(label))
    # Rows without an id stay out of the choice of the smallest.
    some = spark.createDataFrame([(None if n % 6 == 0 else n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    least = {}
    for n, x in enumerate(label):
        if n % 6:
            least.setdefault(x, n)
    assert sorted((r["id"] or -1, r["component_id"]) for r in neardup.label(some).collect()) == sorted((n if n % 6 else -1, least[x]) for n, x in enumerate(label))
