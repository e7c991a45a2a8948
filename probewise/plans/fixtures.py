"""The given tables seen as the inputs of the operators, in Spark and in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from probewise.functions import kernels
from probewise.operators.normalize import chat_pairs
from probewise.workspace import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (example_id, domain, y, label, x) with a planted linear label."""
    first, second = (F.col("embedding")[i].cast("double") for i in (0, 1))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("example_id"),
        F.concat(F.lit("d"), (F.col("label") % 5).cast("string")).alias("domain"),
        F.when(first + F.lit(0.5) * second > 0, 1).otherwise(0).alias("y"),
        F.col("label").cast("int").alias("label"), F.col("embedding").alias("x"))


def mean_difference_bank(acts: DataFrame) -> DataFrame:
    """(row_id, scope, row): mean of class 1 minus mean of class 0 per domain."""
    parts = acts.select("domain", "y", F.posexplode(F.col("x").cast("array<double>")).alias("pos", "v"))
    gap = F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))
    gaps = parts.groupBy("domain", "pos").agg(gap.alias("w"))
    rows = gaps.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("_row"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("domain")) - 1
    return rows.select(place.cast("int").alias("row_id"), F.col("domain").alias("scope"),
                       F.transform("_row", lambda s: s["w"]).alias("row"))


def bank_rows(acts: DataFrame) -> np.ndarray:
    return kernels.bounded_bank(mean_difference_bank(acts))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_pairs(table(spark, sf_dir, "conversations"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "text", "source", "lang", "quality", "toxic")


def text_of(x: Column) -> Column:
    """A vector as text: components in millionths, separated by commas."""
    parts = F.transform(x, lambda v: F.rint(v.cast("double") * 1e6).cast("long").cast("string"))
    return F.array_join(parts, ",")


# The same views in SQL.
ACT = """
act AS (SELECT vec_id AS example_id, 'd' || CAST(label % 5 AS VARCHAR) AS domain,
  CASE WHEN CAST(embedding[1] AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(embedding[2] AS DOUBLE) > 0
       THEN 1 ELSE 0 END AS y, CAST(label AS INT) AS label, CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings)"""
BANK = """
part AS (SELECT domain, y, generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM act),
gap AS (SELECT domain, pos, avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0) AS w
  FROM part GROUP BY domain, pos),
bank AS (SELECT row_number() OVER (ORDER BY domain) - 1 AS row_id, domain AS scope, w AS row FROM
  (SELECT domain, list(w ORDER BY pos) AS w FROM gap GROUP BY domain))"""
CHAT = """
chat AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS user_prompt,
  arg_min(text, turn) FILTER (WHERE role = 'assistant') AS assistant_text
  FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant') > 0)"""
DOCS = """
docs AS (SELECT doc_id, text, source, lang, quality, toxic FROM documents JOIN labels USING (doc_id))"""


def text_of_sql(x: str) -> str:
    return (f"array_to_string(list_transform({x}, lambda v: "
            f"CAST(CAST(round_even(v * 1000000.0, 0) AS BIGINT) AS VARCHAR)), ',')")


def signs_sql(x: str) -> str:
    return f"list_transform({x}, lambda v: CASE WHEN v >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"


def unit_sql(x: str) -> str:
    return f"list_transform({x}, lambda v: v / (sqrt(list_dot_product({x}, {x})) + 1e-8::DOUBLE))"


def best_sql(pairs: str, keys: str = "example_id", order: str = "score DESC") -> str:
    """The best bank row per example; lowest row id among equals."""
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, row_id) AS _r "
            f"FROM ({pairs})) WHERE _r = 1")


def quotas_sql(name: str, source: str) -> str:
    """Largest-remainder quotas of a fifth of ``source`` and each row's place in its pool."""
    return f"""
{name}_size AS (SELECT stratum, count(*) AS n FROM {source} GROUP BY stratum),
{name}_tot AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, count(*) OVER () AS k,
  min(n) OVER () AS smallest FROM {name}_size),
{name}_take AS (SELECT *, CAST(ceil(CAST(total AS DOUBLE) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS take FROM {name}_tot),
{name}_share AS (SELECT *, (k >= 2 AND smallest >= 2 AND take >= k AND total - take >= k) AS ok,
  (take * n) // total AS share, (take * n) % total AS remainder FROM {name}_take),
{name}_spare AS (SELECT *, row_number() OVER (ORDER BY remainder DESC, stratum) AS place,
  take - sum(share) OVER () AS spare FROM {name}_share),
{name}_quota AS (SELECT stratum, CASE WHEN ok THEN stratum ELSE '*' END AS pool,
  CASE WHEN ok THEN share + CASE WHEN place <= spare THEN 1 ELSE 0 END ELSE take END AS quota FROM {name}_spare),
{name}_rank AS (SELECT s.*, quota, row_number() OVER (PARTITION BY pool ORDER BY h, example_id) AS r
  FROM {source} s JOIN {name}_quota q USING (stratum))"""


def split_sql(rows: str) -> str:
    """CTEs from (example_id, stratum) rows to ``split``."""
    return f"""
keyed AS (SELECT example_id, stratum, md5('0|' || CAST(example_id AS VARCHAR)) AS h FROM ({rows})),
{quotas_sql('t', 'keyed')},
rest AS (SELECT example_id, stratum, h FROM t_rank WHERE r > quota),
{quotas_sql('v', 'rest')},
split AS (SELECT example_id, 'test' AS split FROM t_rank WHERE r <= quota
  UNION ALL SELECT example_id, CASE WHEN r <= quota THEN 'val' ELSE 'train' END FROM v_rank)"""


BY_DOMAIN = "SELECT example_id, domain || '__label_' || CAST(y AS VARCHAR) AS stratum FROM act"


def auroc_sql(source: str, keys: str) -> str:
    """(keys, auroc) by mid-ranks; NULL for groups of one class."""
    ranks = (f"SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) "
             f"+ (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS rk FROM {source}")
    return (f"SELECT {keys}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN "
            f"(sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) "
            f"/ (CAST(sum(y) AS DOUBLE) * sum(1 - y)) END AS auroc FROM ({ranks}) GROUP BY {keys}")


def confusion_sql(source: str, keys: str, threshold: str) -> str:
    """Confusion metrics per group of rows (keys, score, y, threshold)."""
    return f"""
SELECT {keys}, {threshold} AS threshold, n, (tp + nn - fp) / CAST(n AS DOUBLE) AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision,
  CASE WHEN np > 0 THEN tp / CAST(np AS DOUBLE) ELSE 0 END AS recall,
  CASE WHEN tp + fp + np > 0 THEN 2 * tp / CAST(tp + fp + np AS DOUBLE) ELSE 0 END AS f1
FROM (SELECT {keys}, {threshold}, count(*) AS n, sum(y) AS np, sum(1 - y) AS nn,
  sum(CASE WHEN score >= {threshold} THEN y ELSE 0 END) AS tp,
  sum(CASE WHEN score >= {threshold} THEN 1 - y ELSE 0 END) AS fp
  FROM {source} GROUP BY {keys}, {threshold})"""


def grid_sql(grid: np.ndarray) -> str:
    return "[" + ", ".join(f"{float(p)!r}::DOUBLE" for p in grid) + "]"


def candidates_sql(source: str, keys: str, grid: np.ndarray) -> str:
    """Confusion metrics of every group at every quantile candidate."""
    cuts = (f"SELECT DISTINCT {keys}, unnest(quantile_cont(score, {grid_sql(grid)})) AS threshold "
            f"FROM {source} GROUP BY {keys}")
    joined = f"(SELECT s.*, c.threshold FROM {source} s JOIN ({cuts}) c USING ({keys}))"
    return confusion_sql(joined, keys, "threshold")


def adam_sql(t: int, name: str, gradient: str = "g") -> str:
    """One optimiser step of ``name`` with its moments m and v (rate 0.03, decay 1e-4)."""
    m, v = f"(0.9 * m + 0.1 * {gradient})", f"(0.999 * v + 0.001 * {gradient} * {gradient})"
    return (f"{name} * (1 - 0.03 * 1e-4) - 0.03 * ({m} / (1 - pow(0.9, {t}))) "
            f"/ (sqrt({v} / (1 - pow(0.999, {t}))) + 1e-8) AS {name}, {m} AS m, {v} AS v")


# Training rows: every example once per scope it belongs to.
TRAINING = f"""
seen AS MATERIALIZED (SELECT unnest(['combined', domain]) AS scope, example_id, y, x, split
  FROM act JOIN split USING (example_id)),
size AS MATERIALIZED (SELECT scope, count(*) AS n, greatest(sum(1 - y), 1) / CAST(greatest(sum(y), 1) AS DOUBLE) AS pw
  FROM seen WHERE split = 'train' GROUP BY scope),
pair AS MATERIALIZED (SELECT scope, example_id, y, split, row_id,
  list_dot_product({signs_sql('x')}, {signs_sql('row')}) / len(x) AS s FROM seen CROSS JOIN (SELECT row_id, row FROM bank)),
raw0 AS MATERIALIZED (SELECT scope, row_id, ln(exp(1.0::DOUBLE) - 1) AS raw, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM size CROSS JOIN (SELECT row_id FROM bank)),
bias0 AS MATERIALIZED (SELECT scope, 0.0::DOUBLE AS bias, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM size)"""


def best_pair_sql(t: int, split: str) -> str:
    """The winning row of every example with the weights after step ``t``."""
    weighted = (f"SELECT p.*, s * (ln(1 + exp(raw)) + 1e-6) AS q, n, pw, bias FROM pair p JOIN raw{t} USING (scope, row_id) "
                f"JOIN size USING (scope) JOIN bias{t} USING (scope) WHERE split = '{split}'")
    return best_sql(weighted, "scope, example_id", "q DESC")


def readout_step_sql(t: int) -> str:
    """CTEs of training step ``t`` of row weights and bias over sign similarities."""
    return f"""
hit{t} AS MATERIALIZED (SELECT scope, row_id, s, n, q + bias AS z, y, pw, 1 / (1 + exp(-(q + bias))) * (1 - y + pw * y) - pw * y AS e
  FROM ({best_pair_sql(t - 1, 'train')})),
loss{t} AS MATERIALIZED (SELECT scope, avg(pw * y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z))) AS loss FROM hit{t} GROUP BY scope),
raw{t} AS MATERIALIZED (SELECT scope, row_id, {adam_sql(t, 'raw')} FROM (
  SELECT p.scope, p.row_id, raw, m, v, coalesce(g, 0) / n / (1 + exp(-raw)) AS g FROM raw{t - 1} p JOIN size USING (scope)
  LEFT JOIN (SELECT scope, row_id, sum(e * s) AS g FROM hit{t} GROUP BY scope, row_id) USING (scope, row_id))),
bias{t} AS MATERIALIZED (SELECT scope, {adam_sql(t, 'bias')} FROM bias{t - 1} JOIN
  (SELECT scope, sum(e) / any_value(n) AS g FROM hit{t} GROUP BY scope) USING (scope))"""


def readout_report_sql(t: int) -> str:
    scored = f"(SELECT scope, q + bias AS score, y FROM ({best_pair_sql(t, 'val')}))"
    return (f"SELECT scope, {t} AS epoch, round(loss, 6) AS loss, round(auroc, 6) AS val_auroc FROM loss{t} JOIN "
            f"({auroc_sql(scored, 'scope')}) USING (scope)")


# Quantised training without a projection: 3 bits, 64 components.
QUANTISED = f"""
seen AS MATERIALIZED (SELECT unnest(['combined', domain]) AS scope, example_id, y, x, split
  FROM act JOIN split USING (example_id)),
size AS MATERIALIZED (SELECT scope, count(*) AS n FROM seen WHERE split = 'train' GROUP BY scope),
unit AS MATERIALIZED (SELECT row_id, {unit_sql('row')} AS u FROM bank),
raw0 AS MATERIALIZED (SELECT scope, row_id, 0.0::DOUBLE AS raw, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM size CROSS JOIN (SELECT row_id FROM bank)),
bias0 AS MATERIALIZED (SELECT scope, 0.0::DOUBLE AS bias, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM size),
act0 AS MATERIALIZED (SELECT scope, ln(0.03125::DOUBLE) AS act, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM size),
row0 AS MATERIALIZED (SELECT scope, ln(0.03125::DOUBLE) AS row, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM size)"""


def _levels_sql(x: str, scale: str) -> str:
    return f"list_transform({x}, lambda c: greatest(-4.0, least(3.0, round_even(c / {scale}, 0))))"


def _slopes_sql(x: str, scale: str) -> str:
    level = f"greatest(-4.0, least(3.0, round_even(c / {scale}, 0)))"
    return (f"list_transform({x}, lambda c: CASE WHEN c / {scale} >= -4 AND c / {scale} <= 3 "
            f"THEN {level} - c / {scale} ELSE {level} END)")


def quantised_pairs_sql(t: int, split: str) -> str:
    """The winning row of every example with the parameters after step ``t``."""
    queries = (f"SELECT scope, example_id, y, n, bias, sa, {_levels_sql('x', 'sa')} AS ql, {_slopes_sql('x', 'sa')} AS qs FROM ("
               f"SELECT *, exp(act) AS sa FROM seen JOIN size USING (scope) JOIN bias{t} USING (scope) "
               f"JOIN (SELECT scope, act FROM act{t}) USING (scope) WHERE split = '{split}')")
    rows = (f"SELECT scope, row_id, ln(1 + exp(raw)) AS alpha, sr, {_levels_sql('u', 'sr')} AS rl, {_slopes_sql('u', 'sr')} AS rs FROM ("
            f"SELECT scope, row_id, raw, u, exp(row) AS sr FROM raw{t} JOIN unit USING (row_id) JOIN (SELECT scope, row FROM row{t}) USING (scope))")
    pairs = (f"SELECT *, list_dot_product(ql, rl) * (sa * sr) AS s, list_dot_product(ql, rl) * (sa * sr) * alpha + 0.0 AS q "
             f"FROM ({queries}) JOIN ({rows}) USING (scope)")
    return best_sql(pairs, "scope, example_id", "q DESC")


def quantised_step_sql(t: int) -> str:
    """CTEs of training step ``t`` of row weights, bias and both quantiser scales."""
    return f"""
hit{t} AS MATERIALIZED (SELECT scope, row_id, s, n, alpha, sa, sr, q + bias AS z, y, 1 / (1 + exp(-(q + bias))) - y AS e,
  list_dot_product(qs, rl) * sr AS by_act, list_dot_product(ql, rs) * sa AS by_row FROM ({quantised_pairs_sql(t - 1, 'train')})),
loss{t} AS MATERIALIZED (SELECT scope, avg(y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z))) AS loss FROM hit{t} GROUP BY scope),
raw{t} AS MATERIALIZED (SELECT scope, row_id, {adam_sql(t, 'raw')} FROM (
  SELECT p.scope, p.row_id, raw, m, v, coalesce(g, 0) / n / (1 + exp(-raw)) AS g FROM raw{t - 1} p JOIN size USING (scope)
  LEFT JOIN (SELECT scope, row_id, sum(e * s) AS g FROM hit{t} GROUP BY scope, row_id) USING (scope, row_id))),
sums{t} AS MATERIALIZED (SELECT scope, sum(e) / any_value(n) AS gb,
  sum(e * alpha * by_act) / any_value(n) / sqrt(least(512, any_value(n)) * 64.0 * 3.0) * any_value(sa) AS ga,
  sum(e * alpha * by_row) / any_value(n) / sqrt((SELECT count(*) FROM bank) * 64.0 * 3.0) * any_value(sr) AS gr
  FROM hit{t} GROUP BY scope),
bias{t} AS MATERIALIZED (SELECT scope, {adam_sql(t, 'bias', 'gb')} FROM bias{t - 1} JOIN sums{t} USING (scope)),
act{t} AS MATERIALIZED (SELECT scope, {adam_sql(t, 'act', 'ga')} FROM act{t - 1} JOIN sums{t} USING (scope)),
row{t} AS MATERIALIZED (SELECT scope, {adam_sql(t, 'row', 'gr')} FROM row{t - 1} JOIN sums{t} USING (scope))"""


def quantised_report_sql(t: int) -> str:
    scored = f"(SELECT scope, q + bias AS score, y FROM ({quantised_pairs_sql(t, 'val')}))"
    return (f"SELECT scope, {t} AS epoch, round(loss, 6) AS loss, round(auroc, 6) AS val_auroc, round(exp(act), 6) AS act_scale, "
            f"round(exp(row), 6) AS row_scale FROM loss{t} JOIN act{t} USING (scope) JOIN row{t} USING (scope) JOIN "
            f"({auroc_sql(scored, 'scope')}) USING (scope)")


def local_training_sql(epochs: int, parts: int, batch: int, most: int) -> str:
    """Training of row weights and bias in passes: each part takes its own steps, then states are averaged by rows.

    ``most`` is the largest number of batches of a part.
    """
    number = "('0x' || substr(md5('{}|' || example_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    ctes = [f"""
dealt AS MATERIALIZED (SELECT *, floor({number.format('part')} * {parts}) AS part, {number.format('deal')} AS deal
  FROM seen WHERE split = 'train'),
weigh AS MATERIALIZED (SELECT scope, part, count(*) AS rows FROM dealt GROUP BY ALL),
step0 AS MATERIALIZED (SELECT scope, 0::DOUBLE AS t FROM size)"""]
    for e in range(1, epochs + 1):
        start = repr((e - 1) * 0.6180339887498949 % 1.0)
        ctes.append(f"""
placed{e} AS MATERIALIZED (SELECT scope, example_id, part, (row_number() OVER (PARTITION BY scope, part
  ORDER BY deal - {start}::DOUBLE + CASE WHEN deal < {start}::DOUBLE THEN 1 ELSE 0 END) - 1) // {batch} AS batch FROM dealt),
w{e}_0 AS MATERIALIZED (SELECT scope, part, row_id, raw, m, v FROM raw{e - 1} JOIN weigh USING (scope)),
b{e}_0 AS MATERIALIZED (SELECT scope, part, bias, m, v, t, 0::DOUBLE AS losses, 0 AS steps
  FROM bias{e - 1} JOIN weigh USING (scope) JOIN step{e - 1} USING (scope))""")
        for k in range(1, most + 1):
            weighted = (f"SELECT p.*, part, s * (ln(1 + exp(raw)) + 1e-6) AS q, pw, bias FROM pair p "
                        f"JOIN placed{e} USING (scope, example_id) JOIN w{e}_{k - 1} USING (scope, part, row_id) "
                        f"JOIN b{e}_{k - 1} USING (scope, part) JOIN size USING (scope) WHERE batch = {k - 1}")

            def adam(name: str) -> str:
                return (f"CASE WHEN g IS NULL THEN {name} ELSE {name} * (1 - 0.03 * 1e-4) - 0.03 * ((0.9 * m + 0.1 * g) / (1 - pow(0.9, t + 1))) "
                        f"/ (sqrt((0.999 * v + 0.001 * g * g) / (1 - pow(0.999, t + 1))) + 1e-8) END AS {name}, "
                        "CASE WHEN g IS NULL THEN m ELSE 0.9 * m + 0.1 * g END AS m, CASE WHEN g IS NULL THEN v ELSE 0.999 * v + 0.001 * g * g END AS v")

            ctes.append(f"""
hit{e}_{k} AS MATERIALIZED (SELECT scope, part, row_id, s, q + bias AS z, y, pw, 1 / (1 + exp(-(q + bias))) * (1 - y + pw * y) - pw * y AS e
  FROM ({best_sql(weighted, 'scope, example_id', 'q DESC')})),
total{e}_{k} AS MATERIALIZED (SELECT scope, part, count(*) AS rows, sum(e) / count(*) AS g,
  avg(pw * y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z))) AS loss FROM hit{e}_{k} GROUP BY ALL),
w{e}_{k} AS MATERIALIZED (SELECT scope, part, row_id, {adam('raw')} FROM (
  SELECT p.scope, p.part, p.row_id, raw, p.m, p.v, t, CASE WHEN o.rows IS NOT NULL THEN coalesce(own, 0) / o.rows / (1 + exp(-raw)) END AS g
  FROM w{e}_{k - 1} p JOIN b{e}_{k - 1} b USING (scope, part) LEFT JOIN total{e}_{k} o USING (scope, part)
  LEFT JOIN (SELECT scope, part, row_id, sum(e * s) AS own FROM hit{e}_{k} GROUP BY ALL) USING (scope, part, row_id))),
b{e}_{k} AS MATERIALIZED (SELECT scope, part, {adam('bias')}, t + (g IS NOT NULL)::INT AS t, losses + coalesce(loss, 0) AS losses,
  steps + (g IS NOT NULL)::INT AS steps FROM b{e}_{k - 1} LEFT JOIN total{e}_{k} USING (scope, part))""")
        mean = "sum({0} * rows) / sum(rows) AS {0}"
        ctes.append(f"""
raw{e} AS MATERIALIZED (SELECT scope, row_id, {', '.join(mean.format(c) for c in ('raw', 'm', 'v'))} FROM w{e}_{most} JOIN weigh USING (scope, part) GROUP BY ALL),
bias{e} AS MATERIALIZED (SELECT scope, {', '.join(mean.format(c) for c in ('bias', 'm', 'v'))} FROM b{e}_{most} JOIN weigh USING (scope, part) GROUP BY ALL),
step{e} AS MATERIALIZED (SELECT scope, {mean.format('t')} FROM b{e}_{most} JOIN weigh USING (scope, part) GROUP BY ALL),
loss{e} AS MATERIALIZED (SELECT scope, sum(losses) / sum(steps) AS loss FROM b{e}_{most} GROUP BY ALL)""")
    return ",".join(ctes)
