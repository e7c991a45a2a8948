"""The named queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.llm import (
    exact, fingerprint, languages, mixing, nearcopies, negatives, packing, personal, quality, sharding, squares, substrings,
    toxicity)
from probewise.llm.shared import table
from probewise.workspace import ship


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_spans(table(spark, sf_dir))


def op2_anchor_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substrings.repeats_removed(table(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir)
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir)
    return quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return nearcopies.near_classes(table(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    digest = docs.withColumn("text_sha256", F.sha2(exact.normalised(), 256))
    return exact.exact_groups(digest, carry=["text_sha256"]).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("row.text_sha256").alias("text_sha256"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packed(table(spark, sf_dir))


def op9_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return fingerprint.edited_fingerprints(table(spark, sf_dir))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.rebalanced(table(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "map_version", "next_shard", "text_group")


def op11_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, shifted)


def op12_dyadic_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return squares.periodic_runs(table(spark, sf_dir), squares.looped)


def op13_language_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir)
    return languages.labelled(docs, languages.fitted(docs))


QUERIES = {f.__name__: f for f in (
    op1_personal_data, op2_anchor_substrings, op3_toxicity, op4_quality, op5_order_minhash, op6_source_mix, op7_exact_dedup, op8_vector_packing, op9_piecewise_hash, op10_virtual_slots,
    op11_strassen_negatives, op12_dyadic_squares,
    op13_language_chain)}

_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

SQL = {
    "op2_anchor_substrings": """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM repeated),
kept AS (
  SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) k
  LEFT JOIN covered c ON c.doc_id = k.doc_id AND c.i = k.i WHERE c.i IS NULL GROUP BY k.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    "op6_source_mix": """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || doc_id) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM docs GROUP BY source),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources),
steps AS (
  SELECT *, source_size::DOUBLE / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, rank
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rank
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
free AS (SELECT ratio, rank, level FROM steps WHERE level * weight <= 2 * source_size ORDER BY ratio, rank LIMIT 1),
aimed AS (
  SELECT s.source, s.source_size, s.rank,
         CASE WHEN f.rank IS NULL OR s.ratio < f.ratio OR (s.ratio = f.ratio AND s.rank < f.rank)
              THEN (2 * s.source_size)::DOUBLE ELSE f.level * s.weight END AS target
  FROM steps s LEFT JOIN free f ON true),
needed AS (
  SELECT *, ceil(source_size / 64.0)::BIGINT AS blocks, round(target)::BIGINT AS wanted,
         (round(target)::BIGINT // greatest(source_size, 1)) * ceil(source_size / 64.0)::BIGINT
         + ceil((round(target)::BIGINT % greatest(source_size, 1)) / 64.0)::BIGINT AS needed
  FROM aimed),
needs AS (
  SELECT *, CASE WHEN needed > 0 THEN needed + 4 + ceil(2 * log2(sum(needed) OVER () + 2) / 3)::BIGINT ELSE 0 END AS needs
  FROM needed),
bounds AS (
  SELECT rank, (sum(needs) OVER (ORDER BY rank) - needs)::DOUBLE / sum(needs) OVER () AS since,
         sum(needs) OVER (ORDER BY rank)::DOUBLE / sum(needs) OVER () AS upto
  FROM needs WHERE needs > 0),
points AS (
  SELECT i AS slot, ('0b' || reverse(bin(i)))::BIGINT::DOUBLE / pow(2.0, length(bin(i))) AS point
  FROM range((SELECT sum(needs)::BIGINT FROM needs)) t(i)),
turns AS (
  SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS turn
  FROM points JOIN bounds ON point >= since AND point < upto),
reads AS (
  SELECT t.rank, turn % blocks AS block, count(*) AS times,
         min(wanted - ((turn // blocks) * source_size + (turn % blocks) * 64)) AS least
  FROM turns t JOIN needs n ON n.rank = t.rank WHERE turn < needed GROUP BY 1, 2),
placed AS (
  SELECT d.doc_id, d.size, n.rank, n.source_size, n.target,
         sum(d.size) OVER (PARTITION BY n.rank ORDER BY d.key, d.doc_id) - d.size AS begin
  FROM docs d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source),
pieces AS (
  SELECT doc_id, rank, block, greatest(begin - block * 64, 0) AS low, least(begin + size - block * 64, 64) AS high
  FROM (SELECT *, unnest(range((begin // 64)::BIGINT, ((begin + size - 1) // 64)::BIGINT + 1)) AS block
        FROM placed WHERE size > 0)),
taken AS (
  SELECT doc_id, sum((CASE WHEN least < 64 THEN times - 1 ELSE times END) * (high - low)
                     + CASE WHEN least < 64 THEN greatest(0, least(high, least) - low) ELSE 0 END) AS taken
  FROM pieces p JOIN reads r ON p.rank = r.rank AND p.block = r.block GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t USING (doc_id)""",
    "op7_exact_dedup": f"""
WITH hashed AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), {_BLANKS}, '')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept, text_sha256
FROM hashed""",
    "op11_strassen_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
found AS (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scores s USING (anchor_id)
  WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5""",
    "op12_dyadic_squares": """
WITH crc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS given,
         4294967295 - list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[],
                                         lambda x, step: xor(x >> 1, (x & 1) * 3988292384))) AS h
  FROM documents),
ends AS (SELECT doc_id, given, len(given) AS n, h % 10 = 0 AND len(given) > 0 AS moved, h // 10 AS g FROM crc),
parts AS (
  SELECT *, CASE WHEN moved THEN g % n ELSE n END AS a,
         CASE WHEN moved THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p
  FROM ends),
texts AS (
  SELECT doc_id, n, CASE WHEN moved THEN list_transform(range(n), lambda i: given[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
                         ELSE given END AS w
  FROM parts),
threes AS (
  SELECT doc_id, n, i, md5(w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS three
  FROM (SELECT doc_id, n, w, unnest(range(n - 2)) AS i FROM texts WHERE n >= 6)),
alike AS (
  SELECT x.doc_id, y.i - x.i AS period, x.i AS i
  FROM threes x JOIN threes y ON x.doc_id = y.doc_id AND x.three = y.three AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, min(i) AS start, count(*) + 2 + period AS length, period
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS part FROM alike)
  GROUP BY doc_id, period, part HAVING count(*) + 2 + period >= greatest(6, 4 * period)),
runs AS (SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
         arg_min({'start': start, 'length': length, 'period': period}, {'a': -length, 'b': start, 'c': period}) AS best
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM texts) k
  LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i WHERE g.i IS NULL GROUP BY k.doc_id)
SELECT t.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, l.best.start::BIGINT AS start, l.best.length::BIGINT AS length,
       l.best.period::BIGINT AS period, (1000 * l.best.length // l.best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(l.listed, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
}
