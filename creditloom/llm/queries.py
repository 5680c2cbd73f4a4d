"""Registered queries of the corpus operators and, where SQL can say the same, their statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import fertility, forest, linerun, packing, pieces, positional, ppm, prefixtrie, probminhash, toxicity, vectorcode, warc, weaklabel

BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = pieces.tokenise(docs, PIECES)
    return rows.select("doc_id", "ids", "score", "n_pieces", "n_byte_pieces", F.length("decoded").alias("decoded_chars"), F.crc32(F.encode("decoded", "UTF-8")).alias("decoded_crc32"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(table(spark, sf_dir, "documents"), BYTES, PIECES)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linerun.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc.doc_id", "n_lines", "n_deleted", "doc.text")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), BYTES))


@query
def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.linked_vectors(table(spark, sf_dir, "embeddings"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.classify(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_rows(warc.archive_and_read(table(spark, sf_dir, "pages")))


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
     o AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS low FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN low < page_id THEN low END AS refers_to
FROM o
"""


@query
def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.language_model_scores(table(spark, sf_dir, "documents"))


@query
def op11_slice_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.compressed(table(spark, sf_dir, "embeddings"))


_SEEDS = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, len(embedding) // 16 AS w
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT vec_id, label, part, q[part * w + 1 : part * w + w] AS v FROM e, (SELECT unnest(range(16)) AS part)),
     s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM e ORDER BY vec_id LIMIT 64)),
     b0 AS (SELECT part, entry, v FROM p JOIN s USING (vec_id))"""


def _assigned(n: int) -> str:
    return f""",
     a{n} AS (SELECT vec_id, label, part, min(struct_pack(d := d, entry := entry)) AS m FROM
              (SELECT p.vec_id, p.label, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
               FROM p JOIN b{n} b ON p.part = b.part) GROUP BY ALL)"""


def _refined(n: int) -> str:
    return f""",
     u{n} AS (SELECT part, entry, list(mean ORDER BY i) AS v FROM
              (SELECT a.part, a.m.entry AS entry, i, CAST(floor(sum(p.v[i])::HUGEINT / count(*)) AS BIGINT) AS mean
               FROM a{n} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part, (SELECT unnest(range(1, 1 + (SELECT max(w) FROM e))) AS i) GROUP BY ALL) GROUP BY ALL),
     b{n + 1} AS (SELECT b.part, b.entry, coalesce(u.v, b.v) AS v FROM b{n} b LEFT JOIN u{n} u ON b.part = u.part AND b.entry = u.entry)"""


ORACLES["op11_slice_intersect"] = _SEEDS + _assigned(0) + _refined(0) + _assigned(1) + _refined(1) + _assigned(2) + """,
     c AS (SELECT vec_id, label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM c
"""


@query
def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op12_positional_index"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
     b AS (SELECT item_id, w, least(len(w), 10) AS l FROM (SELECT item_id, {_TERMS} AS w FROM benchmark) WHERE len(w) > 0),
     k AS (SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS g FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM b)),
     t AS (SELECT doc_id, w, l, unnest(range(1, greatest(len(w) - l + 2, 1))) AS i FROM d, (SELECT DISTINCT l FROM b)),
     m AS (SELECT doc_id, i, t.l, item_id FROM (SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS g FROM t) t JOIN k ON k.l = t.l AND k.g = t.g),
     h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM m) GROUP BY ALL),
     n AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
           FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY ALL)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal conv_id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
         lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLES["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
     i AS (SELECT conv_id, turn, left(sha256(concat(length(r), ':', r, x)), 32) AS id, length(x) AS n FROM t),
     o AS (SELECT conv_id, list(struct_pack(id := id, n := n) ORDER BY turn NULLS FIRST, id) AS turns, {_CRC} % 6 AS h FROM i GROUP BY conv_id),
     q AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1 : o.h], o.turns[o.h + 1 :]) AS turns FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
     p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM q),
     s AS (SELECT conv_id, d, array_to_string(list_transform(turns[1 : d], lambda y: y.id), ',') AS node, coalesce(turns[d].n, 0) AS n, d = len(turns) AS ended FROM p),
     v AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended) AS ends
           FROM s GROUP BY ALL),
     c AS (SELECT d - 1 AS d, left(node, greatest(33 * (d - 1) - 1, 0)) AS node, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
     w AS (SELECT v.d, v.node, v.conv_id, n_convs, coalesce(n_children, 0) AS n_children, n, ends FROM v LEFT JOIN c ON v.d = c.d AND v.node = c.node),
     u AS (SELECT e AS d, left(node, greatest(33 * e - 1, 0)) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n) AS saved
           FROM (SELECT d, node, n_children, n_convs, n, unnest(range(0, d + 1)) AS e FROM w) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN u ON w.d = u.d AND w.node = u.node LEFT JOIN w up ON up.d = w.d - 1 AND up.node = left(w.node, greatest(33 * (w.d - 1) - 1, 0))
"""
