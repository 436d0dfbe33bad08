"""The registered query of each operator over its whole table, and oracle SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hardneg, mixing, neardup_text, neardup_vectors, nearest, quality, secrets, sharding, spelling, token_counts, toxicity, warc
from .common import fresh_folder, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = fresh_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), archives)
    return warc.resolve(warc.assemble(spark, archives)).select(
        "page_id",
        "payload_bytes",
        F.col("payload_sha256").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        "refers_to",
    )


OP1_SQL = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
marked AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
    min(page_id) OVER (PARTITION BY body) AS first_id FROM bodies
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM marked
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan(docs).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).cast("bigint").alias("taken"),
    )


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS mark, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sums
),
steps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))
      / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
goals AS (
  SELECT source, source_size, least(cap, w * (SELECT max(level) FROM steps WHERE level * w <= cap)) AS target FROM steps
),
rated AS (
  SELECT doc_id, mark, size, source_size, target, least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, 2.0) AS rate
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN
  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || mark), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_inner_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id
)
SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 20
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup_text.link_documents(docs).select("doc_id", "n_shingles", "component_id", "kept")


OP7_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
shingled AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle
  FROM split WHERE len(words) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT documents.doc_id AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y) AS component_id, documents.doc_id = min(y) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.x JOIN documents ON documents.doc_id = reach.x GROUP BY documents.doc_id
"""

def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP8_SQL = """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95
),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT x AS vec_id, (SELECT count(*) FROM links WHERE links.x = reach.x) AS n_links, min(y) AS component_id, x = min(y) AS kept
FROM reach GROUP BY x
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, path, decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.col("label").cast("bigint")
    turned = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.mine(vectors, turned, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id AS anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, s.vec_id AS negative_id,
  positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER best <= 3
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: struct_pack(pos := i, w := array_to_string(words[i:i + 2], ' ')))) AS s
  FROM split
),
again AS (SELECT doc_id, s.pos AS pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s.w) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split),
dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
base AS (
  SELECT split.doc_id AS doc_id, lang, text, low, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup_lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN dup_lines USING (doc_id)
),
chars AS (
  SELECT doc_id, lang, unnest(range(9)) AS bin, unnest([
    length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')),
    length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')),
    length(regexp_replace(text, '[^.,;:!?]', '', 'g')), length(regexp_replace(text, '[^''"()-]', '', 'g')),
    length(regexp_replace(text, '[^\x{80}-\x{27F}]', '', 'g')), length(regexp_replace(text, '[\x{0}-\x{27F}]', '', 'g')),
    length(regexp_replace(text, '[a-zA-Z0-9\x20\x09-\x0D.,;:!?''"()-]|[^\x00-\x7F]', '', 'g'))]) AS n
  FROM split
),
words AS (SELECT doc_id, lang, unnest(regexp_extract_all(low, '[^\x20\x09-\x0D]+')) AS word FROM split),
sizes AS (SELECT lang FROM words WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 10000 ORDER BY count(*) DESC, lang LIMIT 256),
places AS (SELECT doc_id, sizes.lang AS ref FROM base LEFT JOIN sizes USING (lang)),
word_counts AS (
  SELECT lang AS ref, word, count(*) AS n FROM words JOIN sizes USING (lang) GROUP BY ALL
  UNION ALL SELECT NULL, word, count(*) FROM words GROUP BY word
),
common AS (
  SELECT ref, word, n, sum(n) OVER (PARTITION BY ref) AS total FROM word_counts
  QUALIFY row_number() OVER (PARTITION BY ref ORDER BY strlen(word) > 64, n DESC, encode(word)) <= 200
),
char_counts AS (
  SELECT lang AS ref, bin, sum(n) AS n FROM chars JOIN sizes USING (lang) GROUP BY ALL
  UNION ALL SELECT NULL, bin, sum(n) FROM chars GROUP BY bin
),
totals AS (SELECT ref, sum(n) AS total FROM word_counts GROUP BY ref),
word_shares AS (
  SELECT common.ref AS ref, word, n / totals.total AS p FROM common JOIN totals ON totals.ref IS NOT DISTINCT FROM common.ref
),
rests AS (SELECT ref, '' AS word, 1 - sum(p) AS p FROM word_shares GROUP BY ref),
word_bins AS (SELECT ref, word, p FROM word_shares UNION ALL SELECT ref, word, p FROM rests),
char_bins AS (SELECT ref, bin, n / sum(n) OVER (PARTITION BY ref) AS p FROM char_counts),
held AS (
  SELECT w.doc_id, coalesce(b.word, '') AS word, count(*) AS n FROM words w JOIN places USING (doc_id)
  LEFT JOIN word_bins b ON b.ref IS NOT DISTINCT FROM places.ref AND b.word = w.word GROUP BY ALL
),
word_meets AS (
  SELECT base.doc_id AS doc_id, base.n_words AS size, b.p AS p, coalesce(held.n, 0) / base.n_words AS q
  FROM base JOIN places USING (doc_id) JOIN word_bins b ON b.ref IS NOT DISTINCT FROM places.ref
  LEFT JOIN held ON held.doc_id = base.doc_id AND held.word = b.word WHERE base.n_words >= 50
),
char_meets AS (
  SELECT chars.doc_id AS doc_id, b.p AS p, chars.n / sum(chars.n) OVER (PARTITION BY chars.doc_id) AS q, sum(chars.n) OVER (PARTITION BY chars.doc_id) AS size
  FROM (SELECT * FROM chars WHERE doc_id IN (SELECT doc_id FROM base WHERE length(text) >= 200)) chars JOIN places USING (doc_id)
  JOIN char_bins b ON b.ref IS NOT DISTINCT FROM places.ref AND b.bin = chars.bin
),
by_words AS (
  SELECT doc_id, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2
    > 0.09 + sum(least(p / 2, 1 / (8 * size * ln(2)))) + sqrt(2 * count(*)) / (8 * any_value(size) * ln(2)) AS strays
  FROM word_meets GROUP BY doc_id
),
by_chars AS (
  SELECT doc_id, sqrt(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) > 0.3 AS strays
  FROM char_meets GROUP BY doc_id
)
SELECT base.doc_id AS doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR coalesce(by_words.strays, false) OR coalesce(by_chars.strays, false)) AS kept
FROM base LEFT JOIN by_words USING (doc_id) LEFT JOIN by_chars USING (doc_id)
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), every=199)


# crc32 from its polynomial, byte by byte over the runs of each document.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT n, list_reduce([n::BIGINT] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(n)
),
crc AS (SELECT list(v ORDER BY n) AS t FROM bits),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
),
counted AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS named FROM runs GROUP BY doc_id, run),
checked AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(named) + 1), lambda i: ('0x' || substr(hex(encode(named)), 2 * i - 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]))) AS h
  FROM counted, crc
),
typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM checked
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM gaps),
near AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
),
formed AS (
  SELECT words.word AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
walk AS (
  SELECT word, word AS root FROM formed
  UNION SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL
)
SELECT formed.word AS word, formed.form AS form, root, formed.n AS n, formed.n_near AS n_near, formed.form_n AS form_n
FROM formed JOIN walk ON walk.word = formed.word JOIN formed ends ON ends.word = walk.root AND ends.form IS NULL
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_token_counts": op4_token_counts,
    "op5_nearest": op5_nearest,
    "op6_secrets": op6_secrets,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_embedding_neardup": op8_embedding_neardup,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality": op12_quality,
    "op13_spelling": op13_spelling,
}
ORACLES = {
    "op1_warc": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op5_nearest": OP5_SQL,
    "op7_minhash_neardup": OP7_SQL,
    "op8_embedding_neardup": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_quality": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
