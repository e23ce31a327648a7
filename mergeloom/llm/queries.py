"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, embed_dedup, licenses, minhash, quality, quotes, token_pack, toxicity, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(index, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, root = token_pack.pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)
    return token_pack.read(files, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def judged(scored: DataFrame, least: float, *more: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), *more)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(toxicity.score(docs, toxicity.fit(docs, quality.training_rows(table(spark, sf_dir, "labels")))), 0.5, "sentences")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link(table(spark, sf_dir, "conversations"))
    told = F.array_join(F.transform("quotes", lambda q: F.concat_ws(":", q["level"], q["turn"], q["text"])), "\n")
    return linked.select("conv_id", "turn", "role", "text", "n_quoted", "n_linked", told.alias("quoted"), "parent_turn", "quoted_parent", "position", "formatted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(quality.score(table(spark, sf_dir, "documents"), quality.training_rows(table(spark, sf_dir, "labels"))), 0.3)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary).drop("text")
    coded = bpe.decode(encoded, vocabulary[0])
    n, ids, decoded = bpe.digests(coded)
    return coded.select("doc_id", n.alias("n_tokens"), ids.alias("ids_sha256"), decoded.alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_token_bits": op3_token_bits,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_quotation_linking": op6_quotation_linking,
    "op7_quality": op7_quality,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_byte_bpe": op10_byte_bpe,
}

#: Rows (id, component) of the graph given as links(a, b) over nodes(id).
CLOSURE = """
reach(id, low) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.low
),
component AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (SELECT * FROM nodes WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.id < b.id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
degree AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),
{CLOSURE}
SELECT n.id AS vec_id, coalesce(d.n, 0) AS n_links, component_id, n.id = component_id AS kept
FROM nodes n JOIN component USING (id) LEFT JOIN degree d USING (id)
""",
    "op2_warc_bundles": """
WITH digests AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
fives AS (SELECT page_id, octet_length(payload) AS n, hex, list_transform(range(0, 8), lambda i: ('0x' || hex[5 * i + 1:5 * i + 5])::INT) AS f FROM digests),
coded AS (
    SELECT page_id, n, array_to_string(list_transform(f, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> b) & 31) + 1]), '')), '') AS payload_digest
    FROM fives
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded)
""",
    "op6_quotation_linking": rf"""
WITH messages AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) - 1 AS place FROM conversations
),
split AS (SELECT conv_id, place, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS lines FROM messages),
lines AS (SELECT conv_id, place, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM split),
parsed AS (
    SELECT conv_id, place, n, length(regexp_extract(line, '{quotes.PREFIX}', 1)) - length(replace(regexp_extract(line, '{quotes.PREFIX}', 1), '>', '')) AS level, regexp_replace(line, '{quotes.PREFIX}', '') AS rest
    FROM lines
),
changes AS (SELECT *, CASE WHEN level <> lag(level) OVER (PARTITION BY conv_id, place ORDER BY n) THEN 1 ELSE 0 END AS changed FROM parsed),
islands AS (SELECT *, sum(changed) OVER (PARTITION BY conv_id, place ORDER BY n) AS island FROM changes),
passages AS (
    SELECT *, trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS said
    FROM (SELECT conv_id, place, island, level, string_agg(rest, chr(10) ORDER BY n) AS body FROM islands WHERE level > 0 GROUP BY ALL)
),
hashed AS (
    SELECT conv_id, place, island, CASE WHEN len(string_split(said, ' ')) >= {quotes.WORDS}
        THEN list_distinct(list_transform(range(1, len(string_split(said, ' ')) - {quotes.WORDS - 2}), lambda i: array_to_string(string_split(said, ' ')[i:i + {quotes.WORDS - 1}], ' '))) ELSE ['=' || said] END AS units
    FROM passages WHERE said <> ''
),
quoted AS (SELECT conv_id, place, island, len(units) AS of, unnest(units) AS unit FROM hashed),
bodies AS (SELECT conv_id, place, coalesce(string_agg(rest, chr(10) ORDER BY n) FILTER (level = 0), '') AS body FROM parsed GROUP BY ALL),
words AS (SELECT conv_id, place, body, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM bodies),
own AS (
    SELECT DISTINCT conv_id, place, unnest(list_concat(
        list_transform(range(1, len(w) - {quotes.WORDS - 2}), lambda i: array_to_string(w[i:i + {quotes.WORDS - 1}], ' ')),
        list_transform(list_filter(list_transform(list_concat(string_split_regex(body, '\n'), string_split_regex(body, '[.!?\n]+')), lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))),
            lambda x: x <> '' AND len(string_split(x, ' ')) < {quotes.WORDS}), lambda x: '=' || x))) AS unit
    FROM words
),
met AS (
    SELECT q.conv_id, q.place, q.island, q.of, q.unit, max(o.place) AS source FROM quoted q JOIN own o ON o.conv_id IS NOT DISTINCT FROM q.conv_id AND o.unit = q.unit AND o.place < q.place GROUP BY ALL
),
votes AS (SELECT conv_id, place, island, of, source, count(*) AS n FROM met GROUP BY ALL HAVING n >= {quotes.COVER} * of),
links AS (SELECT conv_id, place, island, arg_max(source, n * 1000000000 + source) AS source FROM votes GROUP BY ALL),
told AS (
    SELECT p.conv_id, p.place, count(*) AS n_quoted, count(l.source) AS n_linked, max(l.source) FILTER (p.level = 1) AS parent,
        string_agg(concat_ws(':', p.level, m.turn, p.body), chr(10) ORDER BY p.island) FILTER (l.source IS NOT NULL) AS quoted
    FROM passages p LEFT JOIN links l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.place = p.place AND l.island = p.island
    LEFT JOIN messages m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.place = l.source
    WHERE p.said <> '' GROUP BY ALL
),
replies AS (
    SELECT m.conv_id, m.turn, m.role, m.place, coalesce(t.n_quoted, 0) AS n_quoted, coalesce(t.n_linked, 0) AS n_linked, coalesce(t.quoted, '') AS quoted, coalesce(t.parent, m.place - 1) AS parent, t.parent IS NOT NULL AS quoted_parent,
        regexp_replace(b.body, '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$', '', 'g') AS said
    FROM messages m JOIN bodies b ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.place = m.place LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM m.conv_id AND t.place = m.place
)
SELECT r.conv_id, r.turn, r.role, r.said AS text, r.n_quoted, r.n_linked, r.quoted, p.turn AS parent_turn, r.quoted_parent,
    row_number() OVER (PARTITION BY r.conv_id ORDER BY r.parent, r.place) - 1 AS position, '<|' || coalesce(r.role, '') || '|>' || chr(10) || r.said || chr(10) || '<|end|>' AS formatted
FROM replies r LEFT JOIN messages p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.place = r.parent
""",
    "op8_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
),
nodes AS (SELECT doc_id AS id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id AS id, unnest(s) AS v FROM sets),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.v = b.v AND a.id < b.id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
{CLOSURE}
SELECT n.id AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, n.id = component_id AS kept
FROM nodes n JOIN component USING (id)
""",
}
