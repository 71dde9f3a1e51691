"""The operators bound to the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, decontam, exact_dedup, langid, licences, mixing, simhash, substring, tokens, warc
from tessella.llm.common import read, shared_dir


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    records = warc.read_archive(spark, path)
    return records.select(
        F.expr("try_cast(id as bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


#: The fixed conversation that every run formats besides the table.
EXTRA_CONVERSATION, EXTRA_TEXT = -7, r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    path, tokenizer = shared_dir(spark), tokenizer_path("byte_bpe_50k.json")
    chat.write_chats(rows.unionByName(extra), path, tokenizer)
    return chat.chat_digests(spark, path, tokenizer)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct("licences")), ",").alias("licences"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_exact(read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_documents(read(spark, sf_dir, "documents"), shared_dir(spark), tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_benchmark_decontamination,
        op3_warc_archive,
        op4_licence_scan,
        op5_exact_dedup,
        op6_chat_format,
        op7_simhash_near_dedup,
        op8_substring_dedup,
        op9_source_mixing,
        op10_token_ids,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _licence_sql() -> str:
    known = ", ".join(f"({i}, '{text}')" for i, text in licences.SENTENCES.items())
    rules = ", ".join(f"('{name}', {list(ids)})" for name, ids in licences.RULES)
    neutral = ", ".join(map(str, sorted(licences.NEUTRAL)))
    norm = f"trim(regexp_replace({_LOWER.replace('coalesce(text, ' + chr(39) * 2 + ')', 'piece')}, '[^a-z0-9.+-]+', ' ', 'g'), ' .-')"
    bullets = r"'^(([0-9]+\.?|-|[a-z]\.) )+'"
    # A join longer than every known sentence can't become one.
    return rf"""
        WITH RECURSIVE known(id, s) AS (VALUES {known}), rules(name, ids) AS (VALUES {rules}),
        d AS (SELECT row_number() OVER () AS k, doc_id,
                     string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;])[\t\x0B\f\r ]+', '\1' || chr(10), 'g'), '\n+') AS raw FROM documents),
        pieces AS (SELECT k, unnest(raw) AS piece, unnest(range(len(raw))) AS nth FROM d),
        normed AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY nth) - 1 AS i, ended, t
                   FROM (SELECT k, nth, right(piece, 1) IN ('.', '!', '?', ';') AS ended, {norm} AS t FROM pieces) WHERE t <> ''),
        firsts AS (SELECT DISTINCT split_part(s, ' ', 1) AS w FROM known),
        begun AS (SELECT k, i, ended, t, regexp_replace(t, {bullets}, '') AS u FROM normed),
        grown AS (SELECT b.k, b.i, 1 AS size, b.ended, b.t, b.u, coalesce(known.id, CASE WHEN split_part(u, ' ', 1) = 'copyright' THEN {licences.COPYRIGHT} END) AS id
                  FROM begun b LEFT JOIN known ON s = u
                  WHERE split_part(u, ' ', 1) IN (SELECT w FROM firsts) OR regexp_full_match(u, '[0-9]+\.?|-|[a-z]\.')
                  UNION ALL
                  SELECT g.k, g.i, g.size, g.ended, g.t, g.u, known.id
                  FROM (SELECT g.k, g.i, g.size + 1 AS size, n.ended, g.t || ' ' || n.t AS t, regexp_replace(g.t || ' ' || n.t, {bullets}, '') AS u
                        FROM grown g JOIN normed n ON n.k = g.k AND n.i = g.i + g.size
                        WHERE NOT g.ended AND length(g.u) < {max(map(len, licences.SENTENCES.values()))}) g
                  LEFT JOIN known ON s = u),
        hits AS (SELECT k, i, size, id FROM grown WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY size DESC) = 1),
        chain AS (SELECT k, i + size AS reach, [id] AS ids FROM hits QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) = 1
                  UNION ALL
                  (SELECT c.k, h.i + h.size, c.ids || CASE WHEN h.i - c.reach > {licences.MAX_GAP} THEN [0, h.id] ELSE [h.id] END
                   FROM chain c JOIN hits h ON h.k = c.k AND h.i >= c.reach QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY h.i) = 1)),
        found AS (SELECT k, len(ids) AS n, list_filter(ids, lambda x: x NOT IN ({neutral})) AS ids
                  FROM chain QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(chain.ids) DESC) = 1),
        walk AS (SELECT k, n, ids, 1 AS j, CAST([] AS VARCHAR[]) AS names FROM found
                 UNION ALL
                 (SELECT w.k, w.n, w.ids, w.j + coalesce(len(r.ids), 1), CASE WHEN r.name IS NULL THEN w.names ELSE w.names || [r.name] END
                  FROM walk w LEFT JOIN rules r ON w.ids[w.j] = r.ids[1] AND w.ids[w.j:w.j + len(r.ids) - 1] = r.ids WHERE w.j <= len(w.ids)
                  QUALIFY row_number() OVER (PARTITION BY w.k ORDER BY len(r.ids) DESC NULLS LAST) = 1)),
        done AS (SELECT k, n, names FROM walk WHERE j > len(ids))
        SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(len(names), 0) AS n_licences,
               coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licences FROM d LEFT JOIN done USING (k)"""


def _language_sql() -> str:
    """Profiles, ranks and out-of-place sums; n-grams are packed as 21 bits a code point, as the operator has them."""
    return rf"""
        WITH crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS tbl FROM range(256) t(n)),
        d AS (SELECT row_number() OVER () AS k, doc_id, text, lang,
                     xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: unicode(x)::BIGINT)),
                                                 lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8))) % 4 = 2 AS held_out
              FROM documents, crc),
        padded AS (SELECT k, list_transform(string_split(' ' || array_to_string(w, ' ') || ' ', ''), lambda x: unicode(x)::BIGINT) AS p
                   FROM (SELECT k, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS w FROM d) WHERE len(w) > 0),
        spots AS (SELECT k, unnest(p) AS a, unnest(p[2:] || [NULL]) AS b, unnest(p[3:] || [NULL, NULL]) AS c FROM padded),
        grams AS (SELECT k, gram, count(*) AS n
                  FROM (SELECT k, a AS gram FROM spots WHERE a <> 32
                        UNION ALL SELECT k, a * 2097152 + b FROM spots WHERE b IS NOT NULL
                        UNION ALL SELECT k, (a * 2097152 + b) * 2097152 + c FROM spots WHERE b <> 32 AND c IS NOT NULL) GROUP BY k, gram),
        labelled AS (SELECT k, lang, CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || text)[1:5] AS BIGINT) AS pick, count(*) OVER (PARTITION BY lang) AS rows
                     FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL),
        counted AS (SELECT lang, gram, sum(n) AS n FROM labelled JOIN grams USING (k) WHERE pick * rows < {langid.FIT_ROWS << 20} GROUP BY lang, gram),
        profile AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS rank FROM counted QUALIFY rank < {langid.PROFILE}),
        own AS (SELECT k, gram, row_number() OVER (PARTITION BY k ORDER BY n DESC, gram) - 1 AS place FROM grams QUALIFY place < {langid.TOP}),
        apart AS (SELECT k, l.lang, count(*) AS n, sum(coalesce(least(abs(rank - place), {langid.PROFILE}), {langid.PROFILE})) AS apart
                  FROM own CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.gram = own.gram GROUP BY k, l.lang),
        best AS (SELECT * FROM apart QUALIFY row_number() OVER (PARTITION BY k ORDER BY apart, lang) = 1)
        SELECT doc_id, held_out, coalesce(best.lang, '{langid.UNDETERMINED}') AS lang_pred, coalesce(1e0 - CAST(apart AS DOUBLE) / ({langid.PROFILE} * n), 0e0) AS score
        FROM d LEFT JOIN best USING (k)"""


SQL: dict[str, str] = {
    "op1_language_id": _language_sql(),
    "op2_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s
               FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
               FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
        hit AS (SELECT DISTINCT doc_id, m, i, item FROM dw JOIN bw USING (m, s)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
                  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_warc_archive": """
        SELECT page_id, size AS payload_bytes, digest AS payload_digest,
               CASE WHEN size >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN size >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size, sha1(coalesce(html, '')) AS digest,
                     max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id FROM pages)""",
    "op4_licence_scan": _licence_sql(),
    "op5_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)
        WINDOW g AS (PARTITION BY norm)""",
    "op6_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '\lturn'), '</turn', '\l/turn') AS body FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(body) + length('<turn role="') + length('">') + length('</turn>') + 2) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          md5('mix-1/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || coalesce(text, '')) AS place FROM documents),
        s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
        s1 AS (SELECT *, ([3, 1, 2])[nth % 3 + 1]::DOUBLE AS weight, (sum(source_size) OVER ())::DOUBLE * 1.5e0 AS total, source_size * 2.0e0 AS bound FROM s0),
        s2 AS (SELECT *, total - coalesce(sum(bound) OVER (ORDER BY source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
                      sum(weight) OVER (ORDER BY source_size / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s1),
        s3 AS (SELECT *, remains * weight >= bound * weights AS is_full FROM s2),
        s4 AS (SELECT *, CASE WHEN is_full THEN bound ELSE (total - sum(CASE WHEN is_full THEN bound ELSE 0e0 END) OVER ()) * weight
                              / sum(CASE WHEN is_full THEN 0e0 ELSE weight END) OVER () END AS target FROM s3),
        s5 AS (SELECT *, greatest(1, source_size // 4096) AS block FROM s4),
        s6 AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks, CAST(floor(target / block + 0.5e0) AS BIGINT) AS slots FROM s5),
        s7 AS (SELECT *, CAST(coalesce(sum(slots) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low FROM s6),
        n AS (SELECT CAST(sum(slots) AS BIGINT) AS n FROM s7),
        slots AS (SELECT slot, CAST((slot % 2147483648 * 1327217885 % 2147483648)::HUGEINT * n // 2147483648 AS BIGINT) AS point
                  FROM (SELECT unnest(range(n)) AS slot, n FROM n)),
        ranked AS (SELECT nth, n_blocks, row_number() OVER (PARTITION BY nth ORDER BY slot) - 1 AS rank
                   FROM slots JOIN s7 ON point >= low AND point < low + slots),
        uses AS (SELECT nth, rank % n_blocks AS block_no, count(*) AS uses FROM ranked WHERE rank // n_blocks < 2 GROUP BY ALL),
        lines AS (SELECT doc_id, size, nth, source_size, target, block, row_number() OVER () AS k,
                         CAST(coalesce(sum(size) OVER (PARTITION BY nth ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
                  FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
        parts AS (SELECT *, unnest(range(begins // block, (begins + size - 1) // block + 1)) AS block_no FROM lines WHERE size > 0),
        got AS (SELECT k, CAST(sum((least(begins + size, (block_no + 1) * block) - greatest(begins, block_no * block)) * coalesce(uses, 0)) AS BIGINT) AS taken
                FROM parts LEFT JOIN uses USING (nth, block_no) GROUP BY k)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM lines LEFT JOIN got USING (k)""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        r AS (SELECT k, i FROM s JOIN (SELECT s FROM s GROUP BY s HAVING count(*) > 1) USING (s)),
        gone AS (SELECT k, list(DISTINCT p) AS gone FROM (SELECT k, unnest(range(i, i + 35)) AS p FROM r) GROUP BY k),
        kept AS (SELECT k, string_agg(word, ' ' ORDER BY p) AS kept
                 FROM (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0)
                 WHERE (k, p) NOT IN (SELECT k, unnest(gone) FROM gone) GROUP BY k)
        SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN gone USING (k) LEFT JOIN kept USING (k)""",
}
