"""The pipeline against a plain version of its stages."""

import hashlib
import math
import zlib

import numpy as np

import corpus_pipeline
from tessella.llm import decontam, langid, mixing
from tessella.llm.queries import tokenizer_path
from tests.llm.test_neardup import brute
from tests.llm.test_operators import brute_hits, brute_targets, plain_languages


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "token_output"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    (_, language), (_, near), (_, clean), (_, mix), (_, tokens) = corpus_pipeline.STAGES

    kept = language(spark, docs, sf_dir)
    assert kept.columns == columns
    before, rows = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(i in rows or not any(c.isalpha() for c in t or "") for i, t in before.items())

    kept = near(spark, kept, sf_dir)
    assert kept.columns == columns
    ids = sorted(rows)
    first = {ids[la]: ids[la] for la in brute([rows[i] for i in ids])}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())

    kept = clean(spark, kept, sf_dir)
    assert kept.columns == columns
    windows = decontam.item_windows([(str(i), (t or "").encode()) for i, t in items])
    grams = {w for w in windows}

    def hit(text):
        words = decontam.words_of((text or "").encode())
        return any(tuple(words[k : k + m]) in grams for m in {len(g) for g in grams} for k in range(len(words) - m + 1))

    want = sorted(i for i in first.values() if not hit(rows[i]))
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert brute_hits(rows[want[0]], items[:3], 10)[-1] is False

    mixed = mix(spark, kept, sf_dir)
    assert mixed.columns == columns
    taken = [r["doc_id"] for r in mixed.collect()]
    assert set(taken) <= set(want) and max(map(taken.count, set(taken))) <= 2

    out = tokens(spark, mixed, sf_dir)
    assert out.count() == len(taken)


def plain_copies(rows):
    """How often the mix takes each (id, text, source), by whole documents."""
    words = [len((t or "").encode().split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for n, r in zip(words, rows) if r[2] == s) for s in names}
    target = brute_targets(size)
    block = {s: max(1, size[s] // mixing.BLOCKS) for s in names}
    n_blocks = {s: -(-size[s] // block[s]) for s in names}
    slots = {s: math.floor(target[s] / block[s] + 0.5) for s in names}
    owner = [s for s in names for _ in range(slots[s])]
    uses, rank = {}, dict.fromkeys(names, 0)
    for i in range(len(owner)):
        s = owner[i * mixing.STEP % mixing.CYCLE * len(owner) // mixing.CYCLE]
        if rank[s] < 2 * n_blocks[s]:
            uses[s, rank[s] % n_blocks[s]] = uses.get((s, rank[s] % n_blocks[s]), 0) + 1
        rank[s] += 1
    out, at = [0] * len(rows), dict.fromkeys(names, 0)
    place = lambda k: (hashlib.md5(f"mix-1/{rows[k][0]}/{rows[k][1]}".encode()).hexdigest(), rows[k][0])
    for k in sorted((k for k, n in enumerate(words) if n), key=place):
        s = rows[k][2]
        out[k] = uses.get((s, at[s] // block[s]), 0)
        at[s] += words[k]
    return out


def test_run(spark, sf_dir):
    """All five stages, written plainly, give the rows of run()."""
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]
    items = [((r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = plain_languages([d[:3] for d in docs])
    docs = [d for d, (lang, score) in zip(docs, found) if lang != "und" and score >= langid.LEAST_SCORE]
    docs = [docs[k] for k in sorted(set(brute([d[1] for d in docs])))]
    grams = {w for w in decontam.item_windows([(str(i), (t or "").encode()) for i, t in items])}
    lengths = {len(g) for g in grams}

    def hit(text):
        words = decontam.words_of((text or "").encode())
        return any(tuple(words[k : k + m]) in grams for m in lengths for k in range(len(words) - m + 1))

    docs = [d for d in docs if not hit(d[1])]
    mixed = [d for d, n in zip(docs, plain_copies([(d[0], d[1], d[3]) for d in docs])) for _ in range(n)]
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want, at = [], 0
    for d in mixed:
        ids = t.encode(d[1] or "", add_special_tokens=False).ids + [2]
        want.append((d[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    df = corpus_pipeline.run(spark, sf_dir)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls in any column, empty and long texts, ties, repeats, clashing columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, ID string, rows_ int"
    long = "the cat and the dog " * 20_000
    rows = [
        (1, "the cat and the dog sat here", "en", "a", 5, 0.5, "x", 1), (1, "the cat and the dog sat here", "en", "a", 5, 0.5, "x", 1), (1, "the cat and the dog sat here", "en", "b", 5, 0.5, "x", 1),
        (2, None, None, None, None, None, None, None), (None, "le chat et la souris dorment", None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0.1, "y", 2), (4, long, "en", "a", 9, 0.1, "y", 2), (5, long, None, None, 9, 0.1, "y", 2), (6, "12 !?", "en", "a", 5, 0.1, "z", 3), (-7, "der hund und die katze", "de", "", 1, 0.2, "w", 4),
    ]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, none, docs.where("lang IS NULL"), docs.where("text IS NULL")):
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns, name
            assert out.count() <= 2 * table.count()
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
    tokens = corpus_pipeline.STAGES[-1][1]
    assert tokens(spark, at, sf_dir).count() == at.count()
    assert tokens(spark, docs, sf_dir).count() == len(rows)
    assert tokens(spark, none, sf_dir).count() == 0
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [-7, 0, 1, 1, 1, 4, 5]
    near = corpus_pipeline.STAGES[1][1](spark, docs, sf_dir).collect()
    assert len(near) == 6 and {r["doc_id"] for r in near} == {1, 2, None, 4, 6, -7}
