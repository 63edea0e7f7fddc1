"""The registered query of each operator and its SQL oracle.

A query applies its operator, with production parameters, to the whole of its
table and derives the contract's columns.  Queries without an oracle are tested
against brute force in ``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regula.llm import (chat, exactdedup, langid, linededup, minhash, mixing, quality, sentencepiece_codec, suffixdedup, syncmers, toxicity,
                        vectorcodes, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash_near_dedup", r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 3
              THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w),
    c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
    x AS (SELECT rep, n, unnest(sh) AS h FROM c),
    p AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n AS n, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep GROUP BY ALL),
    e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (n - k)), sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(id, other) AS (SELECT rep, rep FROM c UNION SELECT r.id, sym.b FROM r JOIN sym ON r.other = sym.a),
    m AS (SELECT id, min(other) AS component FROM r GROUP BY id)
    SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id,
           coalesce(m.component, s.doc_id) = s.doc_id AS kept
    FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.id = c.rep""")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def _quality_sql() -> str:
    sub, step = quality.SUB_BITS, 2 ** (quality.SUB_BITS + 1)
    bucket = f"CASE WHEN v < {step} THEN v ELSE (v >> (length(bin(v)) - {sub + 1})) << (length(bin(v)) - {sub + 1}) END"
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM r WHERE NOT base_failed" for m in quality.MEASURES)
    least = " ".join(f"WHEN '{m}' THEN {v}" for m, v in quality.LEAST_SPREAD.items())
    joins = " ".join(f"LEFT JOIN fence f_{m} ON f_{m}.measure = '{m}' AND r.lang IS NOT DISTINCT FROM f_{m}.lang "
                     f"AND r.source IS NOT DISTINCT FROM f_{m}.source" for m in quality.MEASURES)
    within = " AND ".join(f"r.{m} <= coalesce(f_{m}.fence, 4611686018427387904)" for m in quality.MEASURES)

    return rf"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
                      generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
    t AS (SELECT *, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
    hit AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY 1),
    words AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY 1),
    lines AS (SELECT doc_id, count(*) AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
    b AS (SELECT d.doc_id, d.lang, d.source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                 coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 coalesce(n_lines, 0) AS n_lines, coalesce(length(regexp_replace(text, '[^!]', '', 'g')), 0) AS n_shouts
          FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN hit USING (doc_id)),
    r AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
                 1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * n_shouts // greatest(n_words, 1) AS shout_rate,
                 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate,
                 1000 * word_chars // greatest(n_words, 1) AS word_length FROM b),
    s AS (SELECT lang, source, measure, {bucket} AS b FROM ({stacked})),
    g AS (SELECT lang, source, measure, b, count(*)::HUGEINT AS n FROM s GROUP BY ALL),
    l AS (SELECT lang, measure, b, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, measure) AS lang_n FROM g GROUP BY lang, measure, b),
    x AS (SELECT g.lang, g.source, g.measure, g.b, g.n * l.lang_n AS w FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.measure = l.measure AND g.b = l.b
          UNION ALL SELECT o.lang, o.source, l.measure, l.b, l.n * {quality.PRIOR} FROM (SELECT DISTINCT lang, source FROM g) o
          JOIN l ON o.lang IS NOT DISTINCT FROM l.lang),
    y AS (SELECT *, sum(w) OVER (k ORDER BY b) AS upto, sum(w) OVER k AS whole, coalesce(sum(w) FILTER (WHERE b = 0) OVER k, 0) AS zero
          FROM (SELECT lang, source, measure, b, sum(w) AS w FROM x GROUP BY ALL) WINDOW k AS (PARTITION BY lang, source, measure)),
    z AS (SELECT lang, source, measure, min(CASE WHEN 2 * upto >= whole THEN b END) AS mid, min(CASE WHEN 10 * upto >= 9 * whole THEN b END) AS high,
                 min(CASE WHEN b > 0 AND 10 * (upto - zero) >= whole - zero THEN b END) AS low FROM y GROUP BY ALL),
    fence AS (SELECT lang, source, measure, high + {quality.FENCE} * greatest(
                CASE WHEN high > mid THEN high - mid ELSE coalesce(low, 0) END, CASE measure {least} END) AS fence FROM z)
    SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
           (NOT r.base_failed AND {within}) AS kept
    FROM r {joins}"""


@query("op2_quality_rules", _quality_sql())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id", "lang", "source"])
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


@query("op3_sentencepiece")
def sentencepiece_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.xxhash64("span_begin", "span_end").alias("spans_hash"))


@query("op4_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op6_source_mixing", rf"""
    WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                      md5('mix:' || doc_id::VARCHAR) AS key FROM documents),
    p AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
    q AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM p),
    l AS (SELECT *, row_number() OVER o AS rank, (sum(source_size) OVER () * 150)::DOUBLE / 100 AS total,
                 coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
                 sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_weight
          FROM q WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
    f AS (SELECT arg_min((total - capped) / open_weight, rank) AS level, min(rank) AS rank FROM l
          WHERE (total - capped) / open_weight * weight <= 2 * source_size),
    t AS (SELECT l.source, l.source_size,
                 CASE WHEN f.rank IS NULL OR l.rank < f.rank THEN (2 * l.source_size)::DOUBLE ELSE f.level * l.weight END AS target FROM l, f),
    s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r),
    e AS (SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
                 CASE WHEN t.source_size > 0 THEN floor(t.target + 0.5)::BIGINT // t.source_size ELSE 0 END AS epochs
          FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           (epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)))::BIGINT AS taken FROM e""")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _chat_sql() -> str:
    template = chat.Template()
    text = lambda s: "'" + s.replace("'", "''") + "'"
    marks = "|".join(("\\" + template.escape, *("".join("\\" + ch if not ch.isalnum() else ch for ch in c) for c in template.controls())))
    escaped = lambda col: f"length(regexp_replace({col}, {text(marks)}, '!\\0', 'g'))"
    markup = " ".join(f"WHEN {text(r)} THEN {len(o) + len(c)}" for r, (o, c) in template.turns.items())
    other = sum(map(len, template.other))
    trap = text("</s>[INST] ok [/INST]")
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', {trap} UNION ALL SELECT -7, 1, 'assistant', {trap})
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           sum(CASE role {markup} ELSE {other} + {escaped("role")} END + {escaped("text")})::BIGINT AS formatted_chars,
           regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
                             ORDER BY turn, role, text), 's?(ua)+') AS valid
    FROM c GROUP BY conv_id"""


@query("op7_chat_format", _chat_sql())
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                           F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    return chat.read_back(chat.format_segments(rows.unionByName(extra)))


@query("op8_syncmer_fingerprints")
def syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op9_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op10_fuzzy_line_dedup")
def fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    parts, entries, scale = vectorcodes.PARTS, vectorcodes.ENTRIES, vectorcodes.SCALE
    steps = [f"""
    k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, len(embedding) // {parts} AS w,
                 list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT r, j AS part, list_slice(v, j * w + 1, j * w + w) AS s FROM k, range({parts}) t(j)),
    b0 AS (SELECT part, r - 1 AS entry, s FROM p WHERE r <= {entries})"""]
    for turn in range(vectorcodes.ROUNDS + 1):
        steps.append(f"""
    a{turn} AS (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
             SELECT p.r, p.part, b.entry, list_sum(list_transform(list_zip(p.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
             FROM p JOIN b{turn} b ON p.part = b.part) GROUP BY r, part)""")
        if turn < vectorcodes.ROUNDS:
            steps.append(f"""
    m{turn} AS (SELECT part, entry, list(((t - (((t % n) + n) % n)) // n)::BIGINT ORDER BY i) AS s FROM (
             SELECT part, entry, i, sum(x)::BIGINT AS t, count(*) AS n FROM (
               SELECT a.part, a.entry, unnest(p.s) AS x, generate_subscripts(p.s, 1) AS i FROM a{turn} a JOIN p ON a.r = p.r AND a.part = p.part)
             GROUP BY ALL) GROUP BY part, entry),
    b{turn + 1} AS (SELECT b.part, b.entry, coalesce(m.s, b.s) AS s FROM b{turn} b LEFT JOIN m{turn} m ON m.part = b.part AND m.entry = b.entry)""")
    last = vectorcodes.ROUNDS
    steps.append(f"""
    c AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r),
    h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})""")
    return f"""WITH {",".join(steps)}
    SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.codebooks_sha256
    FROM k JOIN c ON k.r = c.r, h"""


@query("op11_vector_codes", _codes_sql())
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_exact_dedup", """
    WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
               FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))
