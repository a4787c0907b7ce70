"""Ranking metrics and the metric log."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedforge.operators import metrics, progress
from feedforge.operators.sampling import pool_draws
from feedforge.operators.split import subsample
from feedforge.session import new_scratch_path
from feedforge.sources import tables
from feedforge.workload.registry import query
from feedforge.workload.views import INTERACTIONS, METRIC_LOG, SCORED, interactions, metric_log, scored, sql_mix, table

KS = (5, 10, 20)


def auc_sql(source: str, label: str, score: str) -> str:
    """Mann-Whitney AUC by average ranks."""
    return f"""(SELECT CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE (s - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q) END FROM (
      SELECT sum(CASE WHEN y = 1 THEN r END) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM (
        SELECT {label} AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r
        FROM {source})))"""


def _rounded(df, digits=6):
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) for c in df.columns])


@query(f"SELECT round({auc_sql('(SELECT * FROM labels JOIN documents USING (doc_id))', 'quality', 'n_chars')}, 9) AS auc")
def auc_with_ties(spark, sf_dir):
    """Quality labels against document length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return metrics.auc(rows, "quality", "n_chars").select(F.round("auc", 9).alias("auc"))


@query(f"WITH {SCORED} SELECT round({auc_sql('scored', 'label', 'score')}, 9) AS auc")
def click_auc(spark, sf_dir):
    return metrics.auc(scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query("""
SELECT DISTINCT CAST(n_chars AS BIGINT) AS score, n, rank() OVER (ORDER BY n_chars) + (n - 1) / 2.0::DOUBLE AS avg_rank
FROM (SELECT n_chars, count(*) OVER (PARTITION BY n_chars) AS n FROM documents)""")
def average_ranks(spark, sf_dir):
    return metrics.average_ranks(table(spark, sf_dir, "documents"), "n_chars")


RANKED = f"""{SCORED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_pos) AS rank,
         row_number() OVER (PARTITION BY sample_id ORDER BY label DESC) AS ideal FROM scored
), per_sample AS (
  SELECT sample_id, count(*) AS n, sum(label) AS n_pos, coalesce(1.0::DOUBLE / min(rank) FILTER (label > 0), 0) AS mrr,
  {", ".join(f'''sum(label) FILTER (rank <= {k}) AS hits_{k},
  sum(label / log2(rank + 1)) FILTER (rank <= {k}) AS dcg_{k}, sum(label / log2(ideal + 1)) FILTER (ideal <= {k}) AS idcg_{k}''' for k in KS)}
  FROM ranked GROUP BY sample_id
)"""


def _at(k: int) -> list[str]:
    return [
        f'avg(CASE WHEN idcg_{k} > 0 THEN dcg_{k} / idcg_{k} ELSE 0 END) AS "ndcg@{k}"',
        f'avg((hits_{k} > 0)::INT) AS "hit_rate@{k}"',
        f'avg(CASE WHEN n_pos > 0 THEN hits_{k}::DOUBLE / n_pos ELSE 0 END) AS "recall@{k}"',
        f'avg(hits_{k}::DOUBLE / least(n, {k})) AS "precision@{k}"',
    ]


def _round_sql(columns: list[str], digits: int = 6) -> str:
    parts = [c.rsplit(" AS ", 1) for c in columns]
    return ", ".join(f"round({e}, {digits}) AS {n}" for e, n in parts)


def _one(k: int, which: int, name: str) -> str:
    expression = _at(k)[which].rsplit(" AS ", 1)[0]
    return f"WITH {RANKED} SELECT round({expression}, 6) AS {name} FROM per_sample"


@query(_one(10, 0, "ndcg"))
def ndcg_at_10(spark, sf_dir):
    return _rounded(metrics.ndcg_at_k(scored(spark, sf_dir), 10))


@query(_one(10, 1, "hit_rate"))
def hit_rate_at_10(spark, sf_dir):
    return _rounded(metrics.hit_rate_at_k(scored(spark, sf_dir), 10))


@query(_one(10, 2, "recall"))
def recall_at_10(spark, sf_dir):
    return _rounded(metrics.recall_at_k(scored(spark, sf_dir), 10))


@query(_one(10, 3, "precision"))
def precision_at_10(spark, sf_dir):
    return _rounded(metrics.precision_at_k(scored(spark, sf_dir), 10))


@query(f"WITH {RANKED} SELECT round(avg(mrr), 6) AS mrr FROM per_sample")
def mean_reciprocal_rank(spark, sf_dir):
    return _rounded(metrics.mrr(scored(spark, sf_dir)))


ALL = ["avg(mrr) AS mrr", *[c for k in KS for c in _at(k)]]


@query(f"WITH {RANKED} SELECT round({auc_sql('scored', 'label', 'score')}, 6) AS auc, {_round_sql(ALL)} FROM per_sample")
def all_metrics(spark, sf_dir):
    return _rounded(metrics.all_metrics(scored(spark, sf_dir), KS))


@query(
    f"WITH {RANKED}, m AS (SELECT {_round_sql(ALL)} FROM per_sample) "
    + " UNION ALL ".join(f"SELECT '{c.rsplit(' AS ', 1)[1].strip(chr(34))}' AS metric, {c.rsplit(' AS ', 1)[1]} AS value FROM m" for c in ALL)
)
def metric_report(spark, sf_dir):
    return metrics.report(_rounded(metrics.mean_metrics(scored(spark, sf_dir), KS)))


@query(f"WITH {SCORED} SELECT sample_id FROM scored GROUP BY sample_id HAVING max(\"like\") > 0")
def samples_with_positive(spark, sf_dir):
    return metrics.samples_with_positive(scored(spark, sf_dir).withColumn("label", F.col("like")))


def bce_sql(logit: str, label: str) -> str:
    return f"(greatest({logit}, 0) - {logit} * {label} + ln(1 + exp(-abs({logit}))))"


CELLS = "(" + " + ".join(bce_sql(f"{a}_logit", f'"{a}"') for a in ("click", "like", "share", "follow")) + ") / 4.0::DOUBLE"
SMOOTH = bce_sql("click_logit", "(click * 0.9::DOUBLE + 0.05::DOUBLE)")


@query(f"""WITH {SCORED} SELECT round(avg({CELLS}), 6) AS loss, round(avg({SMOOTH}), 6) AS smoothed,
  round((SELECT avg(m) FROM (SELECT avg({CELLS}) AS m FROM scored GROUP BY batch_id)), 6) AS batch_loss FROM scored""")
def cross_entropy_loss(spark, sf_dir):
    rows = scored(spark, sf_dir)
    pairs = [(f"{a}_logit", a) for a in ("click", "like", "share", "follow")]
    smoothed = metrics.bce_loss(rows, pairs[:1], smoothing=0.1).scalar()
    batched = metrics.bce_loss(rows, pairs, batch="batch_id").scalar()
    return _rounded(metrics.bce_loss(rows, pairs).select("loss", smoothed.alias("smoothed"), batched.alias("batch_loss")))


BUNDLE = f"""
WITH {SCORED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_pos) AS rank,
         row_number() OVER (PARTITION BY sample_id ORDER BY click DESC) AS ideal FROM scored
), probs AS (SELECT click, "like", 1 / (1 + exp(-click_logit)) AS pc, 1 / (1 + exp(-like_logit)) AS pl FROM scored
), per_sample AS (
  SELECT sample_id, max(click) AS pos, arg_min(rank, cand_pos) FILTER (click > 0) AS first,
    sum(click / log2(rank + 1)) FILTER (rank <= 10) AS d10, sum(click / log2(ideal + 1)) FILTER (ideal <= 10) AS i10,
    sum(click / log2(rank + 1)) FILTER (rank <= 20) AS d20, sum(click / log2(ideal + 1)) FILTER (ideal <= 20) AS i20
  FROM ranked GROUP BY sample_id
)
SELECT round((SELECT avg({CELLS}) FROM scored), 6) AS loss,
  round({auc_sql('probs', 'click', 'pc')}, 6) AS auc, round({auc_sql('scored', 'click', 'score')}, 6) AS auc_score,
  round({auc_sql('probs', 'click', 'pc')}, 6) AS auc_sigmoid, round({auc_sql('probs', '"like"', 'pl')}, 6) AS like_auc,
  round(coalesce(avg((first = 1)::INT) FILTER (pos > 0), 0), 6) AS "hit@1",
  round(coalesce(avg(1.0::DOUBLE / first) FILTER (pos > 0), 0), 6) AS mrr,
  round(avg(CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END), 6) AS "ndcg@10",
  round(avg(CASE WHEN i20 > 0 THEN d20 / i20 ELSE 0 END), 6) AS "ndcg@20"
FROM per_sample"""


@query(BUNDLE)
def evaluation_bundle(spark, sf_dir):
    return _rounded(metrics.evaluation_bundle(scored(spark, sf_dir)))


POINTWISE = f"""
WITH {INTERACTIONS}, picked AS (
  SELECT row_id, item_id, click FROM interactions ORDER BY {sql_mix('row_id', 42)}, row_id LIMIT (SELECT count(*) // 2 FROM interactions)
), counts AS (SELECT item_id, count(*) AS n FROM interactions GROUP BY item_id),
pool AS (SELECT item_id, row_number() OVER (ORDER BY {sql_mix('item_id', 42)}, item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM interactions)),
pairs AS (
  SELECT click AS y, item_id FROM picked
  UNION ALL SELECT 0, pool.item_id FROM picked JOIN pool ON idx = {sql_mix('row_id', 42, 1)} % (SELECT count(*) FROM pool)
), rows AS (SELECT y, coalesce(n, 0) AS score FROM pairs LEFT JOIN counts USING (item_id))"""


@query(f"{POINTWISE} SELECT round({auc_sql('rows', 'y', 'score')}, 9) AS auc")
def pointwise_auc(spark, sf_dir):
    """Half of the rows, each against one random item, scored by popularity."""
    log = interactions(spark, sf_dir)
    half = log.count() // 2
    picked = subsample(log, half, 42)
    counts = log.groupBy("item_id").agg(F.count(F.lit(1)).alias("score"))
    own = picked.select(F.col("click").alias("label"), "item_id")
    pool = log.select("item_id").distinct()
    random = pool_draws(picked.select(F.col("row_id").alias("sample_id")), pool, 42)
    pairs = own.unionByName(random.select(F.lit(0).alias("label"), "item_id"))
    rows = pairs.join(counts, "item_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return metrics.auc(rows).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {METRIC_LOG} SELECT name, step, round(value, 6) AS value, row_number() OVER (PARTITION BY name ORDER BY step) AS seq FROM metric_log")
def metric_history(spark, sf_dir):
    return progress.metric_history(metric_log(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""
WITH {METRIC_LOG} SELECT name, step, round(CASE WHEN name LIKE '%/loss' THEN min(value) OVER w ELSE max(value) OVER w END, 6) AS best
FROM metric_log WINDOW w AS (PARTITION BY name ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def running_best(spark, sf_dir):
    found = progress.running_best(metric_log(spark, sf_dir))
    return found.select("name", "step", F.round("best", 6).alias("best"))


@query(f"WITH {METRIC_LOG} SELECT name, round(CASE WHEN name LIKE '%/loss' THEN min(value) ELSE max(value) END, 6) AS best FROM metric_log GROUP BY name")
def best_values(spark, sf_dir):
    return progress.best_values(metric_log(spark, sf_dir)).withColumn("best", F.round("best", 6))


@query(f"""
WITH {METRIC_LOG}, r AS (
  SELECT *, row_number() OVER w AS seq, max(value) OVER (PARTITION BY name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM metric_log WINDOW w AS (PARTITION BY name ORDER BY step)
), g AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN seq END) OVER (PARTITION BY name ORDER BY step) AS since FROM r)
SELECT name, min(step) AS step FROM g WHERE seq - since >= 3 GROUP BY name""")
def patience_stop(spark, sf_dir):
    return progress.patience_stop(metric_log(spark, sf_dir), 3)


@query(
    f"WITH {RANKED}, m AS (SELECT {_round_sql(ALL)} FROM per_sample) "
    + " UNION ALL ".join(
        f"SELECT 'test/{c.rsplit(' AS ', 1)[1].strip(chr(34))}' AS name, 7::BIGINT AS step, {c.rsplit(' AS ', 1)[1]} AS value FROM m"
        for c in ALL
    )
)
def metric_log_sink(spark, sf_dir):
    """Metrics appended to a log and read back."""
    path = new_scratch_path(spark, "metric-log")
    report = metrics.report(_rounded(metrics.mean_metrics(scored(spark, sf_dir), KS)))
    tables.append_metrics(report, path, 7, "test")
    return tables.read_metrics(spark, path)
