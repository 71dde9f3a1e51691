"""Operators against brute force on small tables, with nulls, ties, repeats, clashing columns and nothing at all."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import chat, components, decontam, exact_dedup, langid, licences, mixing, queries, simhash, substring, tokens, warc, wavelet
from tessella.llm.common import shared_dir, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT_ string, id long, fp string, sha string, size string, k string, chunk string, kept_id_ string, COPIES_ string"
WORD = ["alpha", "beta", "gamma", "delta", "omega", "le", "und", "größe", "x"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORD[i] + str(rng.integers(0, 30)) for i in rng.integers(0, len(WORD), n))


def rows_of(texts, langs=None, sources=None, ids=None):
    ids = ids or list(range(len(texts)))
    return [
        (i, t, langs[k] if langs else "en", sources[k] if sources else f"s{k % 4}", len(t or ""), "a", 7, "f", "s", "z", None, "c", "d", "e")
        for k, (i, t) in enumerate(zip(ids, texts))
    ]


LONG = prose(1, 4000)
BASE = prose(2, 120)
TEXTS = [
    None, "", "   \n\t ", "one", "One", BASE, BASE.upper(), BASE, BASE + " tail", BASE.replace("alpha", "ALPHA", 1), LONG, LONG, prose(3, 80) + "\n" + BASE[200:], "12 345 .!",
    prose(4, 60), prose(4, 60), "größe ÄÖ \x00 nul", prose(5, 34), prose(6, 35), prose(6, 35) + "  x",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS) + rows_of([BASE, None, "null id"], ids=[7, 1000, None]), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def key(v):
    return (v is not None, v)


# --- language ID


LANGS = {"en": "the cat and the dog with their house", "de": "der hund und die katze mit ihrem haus", "fr": "le chien et la souris avec leur maison"}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = np.random.default_rng(8)
    out = []
    for i in range(240):
        lang = sorted(LANGS)[i % 3]
        words = LANGS[lang].split()
        out.append((i, " ".join(rng.choice(words, 20)), lang))
    out += [(900, None, "en"), (901, "123 !?", "en"), (902, "", None), (903, "der und die", None), (None, "the and with", None), (904, "the and with " * 5000, None)]
    return spark.createDataFrame(out, "doc_id long, text string, lang string")


def test_language_held_out(spoken):
    found = {r["doc_id"]: r for r in langid.identify(spoken).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spoken.collect()}
    for i in range(240):
        assert found[i]["lang_pred"] == truth[i]
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= found[i]["score"] <= 1
    assert [found[i]["lang_pred"] for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "de", "en", "en"]
    assert found[900]["score"] == 0


def plain_languages(rows, fit_rows=10**9, length=400, top=300):
    """(language, score) of each (id, text, lang), with dictionaries only."""

    def grams(text):
        word = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        p = " " + " ".join(word) + " "
        out = {}
        for g in [c for c in p if c != " "] + [p[i : i + 2] for i in range(len(p) - 1)] + [p[i : i + 3] for i in range(len(p) - 2) if p[i + 1] != " "]:
            out[g] = out.get(g, 0) + 1
        return out if word else {}

    def rank(counts, most):
        return sorted(counts, key=lambda g: (-counts[g], sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))))[:most]

    totals = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2:
            mine = totals.setdefault(lang, {})
            for g, n in grams(text).items():
                mine[g] = mine.get(g, 0) + n
    profiles = {lang: {g: r for r, g in enumerate(rank(c, length))} for lang, c in totals.items() if c}
    out = []
    for _, text, _ in rows:
        own = rank(grams(text or ""), top)
        apart = sorted((sum(min(abs(p[g] - k), length) if g in p else length for k, g in enumerate(own)), lang.encode(), lang) for lang, p in profiles.items())
        out.append((apart[0][2], 1.0 - apart[0][0] / (length * len(own))) if own and apart else ("und", 0.0))
    return out


def test_language_against_dictionaries(spark, spoken, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    for table in (spoken, spoken.unionByName(spoken.limit(9)), docs.where("length(text) < 4000")):
        rows = [tuple(r) for r in table.select("doc_id", "text", "lang").collect()]
        want = sorted(((i, *found) for (i, _, _), found in zip(rows, plain_languages(rows))), key=repr)
        clashing = table.selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS found", "4 AS pick", "5 AS gram")
        got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(clashing).collect()), key=repr)
        assert got == want


def test_language_fit_is_bounded(spark):
    rows = [(i, f"{'the cat' if i % 2 else 'der hund'} {i}", "en" if i % 2 else "de") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, all_rows = langid.fit(df, fit_rows=100), langid.fit(df)
    assert few.languages == all_rows.languages == ("de", "en")


def test_language_filter_keeps_columns(spoken):
    kept = langid.keep_identified(spoken.withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS score", "2 AS lang_pred"))
    assert kept.columns == ["doc_id", "text", "lang", "score", "lang_pred"]
    assert {r["doc_id"] for r in kept.collect()} == set(range(240)) | {903, 904, None}


def test_language_without_labels(empty, spoken):
    assert langid.identify(empty).count() == 0
    found = langid.identify(spoken.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()
    assert {r["lang_pred"] for r in found} == {"und"}


def test_out_of_place_by_hand():
    grams = np.array([1, 2, 3], dtype=np.uint64)
    p = langid.Profiles(("a", "b"), grams, np.array([[0, 2], [1, 3], [3, 0]]), 3)
    own = langid.ngrams("ab")
    assert len(own[0]) == 2 + 3 + 2
    assert p.closest("ab")[1] == 0.0


def test_ngrams_in_slices(monkeypatch):
    text = prose(9, 500)
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "SLICE", 97)
    parts = langid.ngrams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


# --- decontamination


def brute_hits(text, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = word.findall(lower(text))
    hit, ids = set(), set()
    for item, body in items:
        w = word.findall(lower(body))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    hit.update(range(j, j + m))
                    ids.add(item)
    named = sorted(str(i) for i in ids if i is not None)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


ITEMS = [(None, prose(3, 40)), (1, BASE[:150]), (2, "one"), (10, "größe äö"), (3, None), (4, "!!"), (1, prose(4, 30)), (11, BASE[:150].upper()), (5, "alpha1 alpha1"), (6, " ".join(["rep"] * 12))]


@pytest.mark.parametrize("slab_bytes", [1 << 20, 60])
@pytest.mark.parametrize("window", [10, 3])
def test_decontamination(spark, docs, slab_bytes, window, monkeypatch):
    monkeypatch.setattr(decontam, "SLABS", 2)
    more = docs.unionByName(spark.createDataFrame(rows_of(["rep " * 40, "x " + "rep " * 9 + "y", "alpha1 alpha1 alpha1"], ids=[50, 51, 52]), SCHEMA))
    bench = spark.createDataFrame([(*i, "c") for i in ITEMS], "item_id long, text string, doc_id string")
    found = decontam.find_contamination(more, bench, window=window, slab_bytes=slab_bytes).collect()
    want = sorted((repr((i, *brute_hits(t, ITEMS, window))) for i, t in collected(more)))
    assert sorted(repr(tuple(r)) for r in found) == want
    kept = decontam.drop_contaminated(more, bench, window=window, slab_bytes=slab_bytes)
    assert kept.columns == more.columns
    assert sorted(kept.select("doc_id", "text").collect(), key=repr) == sorted(((i, t) for i, t in collected(more) if not brute_hits(t, ITEMS, window)[-1]), key=repr)


def test_decontamination_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontam.find_contamination(docs, none).collect()} == {0}
    assert decontam.find_contamination(empty, none).count() == 0


# --- archive


def test_archive_round_trip(spark):
    big, small = "ü" * 700, "s" * 999
    pages = [(1, "u1", big), (5, "u5", big), (5, "u5", big), (3, None, small), (4, "u4", small), (7, "a\r\nb", None), (8, "u", "b" * 1000), (None, "n", big), (9, "u9", "x" * 200_000)]
    df = spark.createDataFrame([(*p, "c", "d") for p in pages], "page_id long, url string, html string, payload string, sha256 string")
    path = shared_dir(spark)
    warc.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in pages})
    got = sorted(((r["id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["record"])) for r in warc.read_archive(spark, path).collect()), key=repr)
    want = []
    for i, url, html in pages:
        body = (html or "").encode()
        last = max((j for j, _, h in pages if (h or "") == (html or "") and j is not None), default=None)
        revisit = len(body) >= 1000 and last is not None and i != last
        want.append((str(i) if i is not None else "null", "revisit" if revisit else "response", str(last) if revisit else None, len(body), hashlib.sha1(body).hexdigest(), body, revisit))
    want.sort(key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        head, _, rest = g[5].partition(b"\r\n\r\n")
        http, _, tail = rest.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and tail == (b"" if w[6] else w[5]) + b"\r\n\r\n"
        assert int(re.search(rb"\nContent-Length: (\d+)$", head)[1]) == len(http) + 4 + len(tail) - 4


def test_archive_exports_valid_records(spark, tmp_path):
    big = "p" * 3000
    pages = [(i, f"http://h/{i}\r\nx", big if i % 3 else f"small {i}") for i in range(30)] + [(40, "u", big)] * 12
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = shared_dir(spark)
    warc.write_archive(df, path)
    assert warc.read_archive(spark, path, spread=3).where("record_type = 'response' AND payload_bytes = 3000").count() == 12
    warc.export_warc(spark, path, str(tmp_path), files=2)
    found, payloads = [], []
    for name in ("00000.warc", "00001.warc"):
        data = (tmp_path / name).read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n" and re.fullmatch(rb"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields[b"WARC-Date"])
            found.append(fields[b"WARC-Target-URI"])
            payloads.append(rest[:size].partition(b"\r\n\r\n")[2])
            data = rest[size + 4 :]
    assert sorted(found) == sorted((u.replace("\r", "%0D").replace("\n", "%0A")).encode() for _, u, _ in pages)
    assert payloads.count(big.encode()) == 12 and payloads.count(b"") == 20


def test_archive_fails_on_other_bytes(spark):
    path = shared_dir(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "a" * 2000)], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "cast('b' AS binary) AS payload", "copies").collect()
    spark.createDataFrame(bad, "sha256 binary, payload binary, copies long").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, path).collect()


def test_archive_empty(spark):
    path = shared_dir(spark)
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


# --- licences


def test_longest_licence_rule_wins():
    assert licences.match_rules([50, 51, 52]) == ["BSD-2-Clause"]
    assert licences.match_rules([1, 50, 51, 52, 53, 50, 51]) == ["BSD-3-Clause"]
    assert all(licences.normalise(t.encode()) == t for t in licences.SENTENCES.values())


MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("", []),
        ("Nothing. Here;", []),
        ("Words.\nReleased under the MIT License.\nMore.", ["MIT"]),
        ("RELEASED under the   mit license! Licensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"]),
        (MIT, ["MIT"]),
        (MIT.replace("\n", "\r\n"), ["MIT"]),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", []),
        ("a | b\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 2.0.\n" * 3, ["Apache-2.0"] * 3),
        ("* Released under the MIT License", ["MIT"]),
    ],
)
def test_licence_scan(spark, text, want):
    df = spark.createDataFrame([(1, text, "c")], "doc_id long, text string, licences string")
    assert [r["licences"] for r in licences.scan_licences(df).collect()] == [want]


def test_licence_break_between_distant_sentences():
    far = licences.SENTENCES[21].encode() + b".\n" + b"Other.\n" * 5 + licences.SENTENCES[22].encode() + b".\n"
    near = licences.SENTENCES[21].encode() + b".\n" + b"Other.\n" * 2 + licences.SENTENCES[22].encode() + b".\n"
    assert licences.match_rules(licences.identifiers(far)) == []
    assert licences.match_rules(licences.identifiers(near)) == ["Apache-2.0"]


# --- exact deduplication


@pytest.mark.parametrize(("bits", "most", "spread"), [(16, 1 << 20, 1 << 14), (1, 1 << 20, 1), (1 << 14, 1 << 14, 2)])
def test_exact_groups(spark, docs, bits, most, spread):
    docs = docs.unionByName(spark.createDataFrame(rows_of(["many"] * 7 + [None] * 5, ids=[None] * 7 + [70] * 5), SCHEMA))
    got = sorted((tuple(r) for r in exact_dedup.group_exact(docs, bits_per_row=bits, max_filter_bytes=most, spread=spread).collect()), key=repr)
    lower = lambda t: (t or "").encode().lower()
    all_rows, want, done = collected(docs), [], set()
    for i, t in all_rows:
        same = [j for j, u in all_rows if lower(u) == lower(t)]
        keep = max((j for j in same if j is not None), default=None)
        first = (i, lower(t)) not in done
        done.add((i, lower(t)))
        want.append((i, keep, len(same), i == keep and first, hashlib.sha256(lower(t)).hexdigest()))
    assert got == sorted(want, key=repr)


def test_exact_shuffles_few_unique_rows(spark):
    """Each range has a plane of its own, so that few unique rows look repeated at any number of rows."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20_000)], "doc_id long, text string")
    hashed = rows.selectExpr("doc_id AS id", "cast(text AS binary) AS text").mapInArrow(exact_dedup._digests(3), "id long, sha binary, at int")
    looked = exact_dedup._looked_up(exact_dedup.materialise(hashed), 3, 2, "bigint")
    assert looked.count() == 20_000 and looked.where("maybe").count() < 400


def test_exact_empty(empty):
    assert exact_dedup.group_exact(empty).count() == 0


# --- chats


def test_chat_escape_round_trip():
    for text in ("", "\\", "\\l", "<turn", "</turn>\n<turn role=\"x\">", "\\</turn>", "\\\\<turn", '"q"', "a<b", queries.EXTRA_TEXT, "é</turn>\n\n"):
        assert chat.unescape(chat.escape(text)) == text
        rendered, _ = chat.render([("us\"er</turn>", text), ("assistant", text)])
        assert chat.parse(rendered) == [("us\"er</turn>", text), ("assistant", text)]


def test_chat_masks_are_exact():
    t = chat.load(queries.tokenizer_path("byte_bpe_50k.json"))
    turns = [("user", "Hé <|endoftext|> 日本"), ("assistant", "  naïve\n\n日本 🙂 </turn> "), ("assistant", ""), ("assistant", "x"), ("user", "\t")]
    text, spans = chat.render(turns)
    ids, offsets = chat.encoded(t, text)
    assert t.decode(ids.tolist(), skip_special_tokens=False) == text
    mask, pieces = chat.aligned(offsets, spans)
    assert pieces.tolist() == spans.tolist()
    brute = [any(min(e, b) > max(s, a) for a, b in spans) for s, e in offsets]
    assert mask.tolist() == brute
    said = "".join(x for r, x in turns if r == "assistant")
    assert chat.masked_text(text, offsets, mask, spans) == said
    for k in np.flatnonzero(mask):
        if (offsets[mask] == offsets[k]).all(axis=1).sum() == 1:
            broken = mask.copy()
            broken[k] = False
            with pytest.raises(ValueError):
                chat.masked_text(text, offsets, broken, spans)
    with pytest.raises(ValueError):
        chat.masked_text(text, np.minimum(offsets, 60), mask, spans)


def test_chat_parts_have_the_ids_of_the_whole():
    t = chat.load(queries.tokenizer_path("byte_bpe_50k.json"))
    turns = [(r, x) for r in ("user", "assistant", "") for x in ("", " ", "\n", "  a \n", "日本\n\n", "it's 12 <turn", *[u for u in TEXTS if u][:12])]
    whole = chat.encoded(t, chat.render(turns)[0])[0].tolist()
    assert sum((chat.encoded(t, chat.render([turn])[0])[0].tolist() for turn in turns), []) == whole


CHATS = [(1, 2, "assistant", "b"), (1, 0, "user", None), (1, 1, None, "a"), (1, 1, None, "a"), (None, 0, "assistant", "nö" * 40), (2, None, "user", ""), (None, 1, "user", "z")]
CHATS += [(3, k, "assistant" if k % 2 else "user", f"turn {k} " * 9) for k in range(60)] + [(k, 0, "assistant", "one") for k in range(10, 40)] + [(50, 0, "user", "long text " * 40_000)]


@pytest.mark.parametrize("part_chars", [1 << 18, 30])
def test_chat_digests(spark, part_chars):
    df = spark.createDataFrame([(*r, "c") for r in CHATS], "conv_id long, turn long, role string, text string, conv string")
    path, tokenizer = shared_dir(spark), queries.tokenizer_path("byte_bpe_50k.json")
    chat.write_chats(df, path, tokenizer, part_chars=part_chars)
    rows = chat.chat_digests(spark, path, tokenizer).collect()
    got = {r["conv_id"]: r for r in rows}
    assert set(got) == {c for c, *_ in CHATS} and len(rows) == len(got)
    for conv in got:
        mine = sorted(((t, r or "", x or "") for c, t, r, x in CHATS if c == conv), key=lambda v: (key(v[0]), v[1:]))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("change", ["transform(mask, x -> false) AS mask", "transform(ids, x -> 11) AS ids", "transform(token_end, x -> 1) AS token_end"])
def test_chat_reader_fails_on_broken_files(spark, change):
    path, bad, tokenizer = shared_dir(spark), shared_dir(spark), queries.tokenizer_path("byte_bpe_50k.json")
    chat.write_chats(spark.createDataFrame([(1, 0, "assistant", "some words")], "conv_id long, turn long, role string, text string"), path, tokenizer)
    parts = spark.read.parquet(path)
    parts.selectExpr(*[c for c in parts.columns if not change.endswith(f" AS {c}")], change).write.parquet(bad)
    with pytest.raises(Exception, match="mask does not cover|do not decode"):
        chat.chat_digests(spark, bad, tokenizer).collect()


def test_chat_empty(spark):
    path, tokenizer = shared_dir(spark), queries.tokenizer_path("byte_bpe_50k.json")
    chat.write_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), path, tokenizer)
    assert chat.chat_digests(spark, path, tokenizer).count() == 0


# --- SimHash


def brute_print(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(prints, threshold=2):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= threshold:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_simhash_documents(docs):
    rows = collected(docs)
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [j for m, (j, _) in enumerate(rows) if label[m] == label[k] and j is not None]
        want.append((i, f"{prints[k]:016x}", min(ids, default=None)))
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], brute_print(r["text"])) for r in kept.collect()]
    assert len(got) == len(set(label))
    assert {i for i, _ in got if i is not None} == {w[2] for w in want if w[2] is not None}


@pytest.mark.parametrize(("n", "home", "cell"), [(300, 512, 1 << 16), (900, 8, 1 << 16), (700, 64, 20)])
def test_simhash_links(spark, n, home, cell):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {0}
    for c in centres:
        for _ in range(n // 12):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    root = {r["node"]: r["root"] for r in simhash.link_fingerprints(df, home=home, cell=cell).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    label = brute_components(prints)
    first = {}
    for s, la in zip(signed, label):
        first.setdefault(la, []).append(s)
    assert {s: root.get(s, s) for s in signed} == {s: min(first[la]) for s, la in zip(signed, label)}


def test_simhash_many_neighbours():
    """Neighbour lookup, which dense anchors use, finds what all pairs do."""
    rng = np.random.default_rng(5)
    prints = np.unique(np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    homes = np.arange(0, len(prints), 3)
    brute = simhash._roots(len(prints), simhash._linked(prints, homes, 2))
    neighbours = simhash.math.comb
    simhash.math.comb = lambda n, k: 0
    try:
        quick = simhash._roots(len(prints), simhash._linked(prints, homes, 2))
    finally:
        simhash.math.comb = neighbours
    assert (brute == quick).all()


def test_simhash_replicas_cover_every_near_word():
    rng = np.random.default_rng(6)
    for distinct in (10, 1 << 14, 1 << 20):
        masks = simhash.block_masks(distinct, 16)
        prints = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        index, anchor, _ = simhash.replicas(prints, masks)
        have = {(int(i), int(a)) for i, a in zip(index, anchor)}
        for i, p in enumerate(prints):
            for _ in range(200):
                near = np.array([int(p) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))], dtype=np.uint64)
                home = simhash.replicas(near, masks)
                assert (i, int(home[1][home[2]][0])) in have


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (500, 500)] + [(1000, 1000 + i) for i in range(1, 60)]
    df = spark.createDataFrame(chain, "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100} | {1000 + i: 1000 for i in range(60)}


# --- substring deduplication


def brute_kept(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("window", [35, 10, 5])
def test_substrings(spark, docs, window):
    loops = ["same " * 50, "same " * 36, prose(11, 50) + " " + prose(11, 50), prose(12, 90) + "\n" + BASE[90:500]]
    more = docs.unionByName(spark.createDataFrame(rows_of(loops, ids=[60, 61, 62, 63]), SCHEMA))
    got = [tuple(r) for r in substring.remove_repeats(more, window=window, chunks=5).collect()]
    rows = collected(more)
    want = [(i, *kept) for (i, _), kept in zip(rows, brute_kept([t for _, t in rows], window))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_substring_levels():
    assert substring.levels(35) == [9, 18, 35]
    assert substring.levels(5) == [5]
    h = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 9, 27):
        assert substring._leftmost_least(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]


def test_substring_ranges_fill_evenly():
    texts = [prose(i, 400).encode() for i in range(100, 200)] + [" ".join(f"u{i}x{j}" for j in range(400)).encode() for i in range(100)]
    chunk = substring.Chunk(texts, 35)
    for length in substring.levels(35):
        part = substring._ranges(chunk.entries(length)[0], 16)
        counts = np.bincount(part, minlength=16)
        assert (np.diff(part) >= 0).all() and counts.max() < 2 * counts.mean() and counts.min() > 0
    sent = substring._send(35, [], 9, 7)((pa.scalar(3),), pa.table({"text": pa.array(texts, pa.binary())}))
    assert sent.num_rows <= 7


def test_substring_parts_follow_the_size(spark, sf_dir):
    """More shuffle partitions do not make chunks or ranges of next to nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        chunks, ranges = substring._parts(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 1 <= ranges <= chunks <= 1 + substring.planned_bytes(docs) // substring.CHUNK_BYTES[1] < 2000


def test_words_with_equal_polynomials_stay_apart(spark):
    """Thue-Morse words and their complements have equal sums of powers, whatever the base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes, counts = word_hashes([word.encode(), other.encode(), b"", b"abc\x00", b"abc", b"12345678", b"1234567812345678", b"12345678123456781"])
    assert len(set(hashes.tolist())) == len(hashes) == counts.sum() == 7
    df = spark.createDataFrame([(1, " ".join([word] * 35)), (2, " ".join([other] * 35)), (3, " ".join([word] * 35))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(df).collect()} == {1: 35, 2: 0, 3: 35}


def test_word_hashes_in_slices(monkeypatch):
    from tessella.llm import common

    texts = [(t or "").encode() for t in TEXTS]
    whole = word_hashes(texts)
    monkeypatch.setattr(common, "SLICE_BYTES", 60)
    parts = word_hashes(texts)
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist() == [len((t or "").encode().split()) for t in TEXTS]


def test_substring_empty(empty):
    assert substring.remove_repeats(empty).count() == 0


# --- mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * w[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] >= 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_targets_and_bounds(spark):
    rng = np.random.default_rng(3)
    sources = ["a", "b", "c", "d", "e", None, "B", "é"]
    rows = [(i, prose(i, int(rng.integers(0, 60))), sources[int(rng.integers(0, 8)) % (3 if i % 2 else 8)]) for i in range(400)]
    rows += [(5, rows[5][1], rows[5][2]), (700, None, "a"), (701, "", "b"), (None, "x y z", "c"), (800, prose(1, 5000), "d")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, taken int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    by_size = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_size.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    for s, n in sizes.items():
        taken = sum(by_size[(n, round(target[s], 6))])
        assert abs(taken - target[s]) <= max(0.03 * target[s], 4 * max(1, n // mixing.BLOCKS), 6)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)


def test_mixed_documents(spark, docs, empty):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts, have = {}, {}
    for r in out.collect():
        counts[tuple(r)] = counts.get(tuple(r), 0) + 1
    for r in docs.collect():
        have[tuple(r)] = have.get(tuple(r), 0) + 1
    assert counts and all(k in have and n <= 2 * have[k] for k, n in counts.items())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# --- tokens


@pytest.mark.parametrize("shard_tokens", [1 << 20, 300])
def test_token_shards(spark, docs, empty, shard_tokens):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    where = shared_dir(spark)
    got = tokens.token_documents(docs, where, path, shard_tokens=shard_tokens).orderBy("start").collect()
    rows = collected(docs)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=key)
    at, texts, stream = 0, {}, []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        texts.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    for r in got:
        assert r["start"] == at
        entry = next(e for e in texts[r["doc_id"]] if e[:2] == (r["n_tokens"], r["ids_crc32"]))
        texts[r["doc_id"]].remove(entry)
        stream += entry[2]
        at += r["n_tokens"]
    some = max(set(stream), key=stream.count)
    assert sorted(r["place"] for r in tokens.locate_token(spark, where, some).collect()) == [k for k, x in enumerate(stream) if x == some]
    assert tokens.token_documents(empty, shared_dir(spark), path).count() == 0


HARD = [
    "", " ", "It's  they'll ABC's 12½ ²x §!! <|endoftext|> hi", "Ωmega ΣΑΣ", "naïve Übung İstanbul ŉ", "a\x00b \x1c c", "é x", "don't'd 'S co-op... x\xadb 1st 'll's",
    "tab\tnew line\x85x\xa0y", "ſ ß ẞ Ǆ", "<|startoftext|>", "a<|b", "ĳĲ ÿ", "日本 語", "🙂🙂", "''''s''re", "\x7f\x1f",
]


def test_encoder_gives_the_library_s_ids(monkeypatch, sf_dir):
    import pyarrow.parquet as pq

    monkeypatch.setattr(tokens, "MEMO", 500)
    coder = tokens.Encoder(queries.tokenizer_path("word_bpe_49k.json"))
    texts = HARD + [x.as_py() or "" for x in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"]]
    assert coder.pattern is not None
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        got = coder.encode(part)
        assert [g.tolist() for g in got] == [coder.whole.encode(x, add_special_tokens=False).ids for x in part]


def test_shards_of_other_ids_and_tokenizers(spark, monkeypatch):
    import datetime
    import decimal

    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for kind, values in (("date", [datetime.date(2020, 1, k) for k in (1, 2, 3)]), ("decimal(10,2)", [decimal.Decimal(f"{k}.50") for k in (1, 2, 3)]), ("binary", [b"a", b"b", b"c"]), ("string", ["x", "y", None])):
        df = spark.createDataFrame([(v, f"some text {k}") for k, v in enumerate(values)], f"doc_id {kind}, text string")
        got = tokens.token_documents(df, shared_dir(spark), path).collect()
        assert {repr(bytes(r["doc_id"]) if kind == "binary" else r["doc_id"]) for r in got} == {repr(v) for v in values}
    coder = tokens.Encoder(path)
    monkeypatch.setattr(coder, "ends", np.zeros_like(coder.ends))
    assert [g.tolist() for g in coder.encode(["it's one", "two"])] == [t.encode(x, add_special_tokens=False).ids for x in ("it's one", "two")]
    assert coder.pattern is None


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 511, 512, 513, 3000):
        t = rng.integers(0, 49408, n).astype(np.uint32)
        t[::5] = 3
        blob = wavelet.pack(t, [(None, n)])
        m, table = wavelet.unpack(blob)
        assert table == [[None, n]] and (m.decode() == t).all()
        assert [m.access(i) for i in range(0, n, 29)] == t[::29].tolist()
        for v in {3, 49407, 70000, *t[:3].tolist()}:
            assert m.count(v) == (t == v).sum() and m.count(v, n // 3, n // 2) == (t[n // 3 : n // 2] == v).sum()
            assert m.locate(v) == np.flatnonzero(t == v).tolist()
    with pytest.raises(ValueError):
        wavelet.unpack(b"other")
