"""Queries over the given tables, one or more an operator, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions import scalars as S
from relyframe.operators import caps, nearest, partition, scoring, tracks, vectors
from relyframe.plans import association, grid, mapping, models, studies
from relyframe.plans.mapping import CELLS_SQL, PROBE_SQL
from relyframe.sources import tables
from relyframe.sources.scratch import scratch_path, stored
from relyframe.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CELL = scoring.CELL
_CELL = ", ".join(CELL)
DRAWS = 200
_CELLS = f"WITH {PROBE_SQL}, {CELLS_SQL}"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


# Means of short decimals often end in a half of the last digit; a small step decides those alike in both engines.
def _up(*names: str) -> list[Column]:
    return [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]


def _ups(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in names)


# Cells and support


@query(f"{_CELLS} SELECT {_CELL}, {_ups('pDetA', 'pAssA', 'pHOTA')}, n_frames, num_masklets, n_videos FROM cells")
def score_cells(spark, d):
    return mapping.cells(spark, d).select(*CELL, *_up(*scoring.METRICS), "n_frames", "num_masklets", "n_videos")


@query("""
SELECT o_orderkey AS video_id, o_custkey % 10 AS category_id, coalesce(n_frames, 0) AS n_frames, coalesce(n_masklets, 0) AS n_masklets
FROM orders LEFT JOIN (
  SELECT l_orderkey, l_suppkey % 10 AS c, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_linenumber END) AS n_frames, count(DISTINCT l_partkey) AS n_masklets
  FROM lineitem GROUP BY 1, 2) f ON o_orderkey = l_orderkey AND o_custkey % 10 = c""")
def probe_support(spark, d):
    items = mapping.read(spark, d, "lineitem")
    frames = items.select(F.col("l_orderkey").alias("video_id"), (F.col("l_suppkey") % 10).alias("category_id"), F.col("l_partkey").alias("ann_id"), F.col("l_linenumber").alias("frame_idx"), (F.col("l_returnflag") != "N").alias("present"))
    probes = mapping.read(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_custkey") % 10).alias("category_id"))
    return scoring.probe_support(probes, frames, ["video_id", "category_id"])


@query("""WITH m AS (SELECT l_orderkey, l_suppkey % 10 AS c, avg(l_discount * 10) AS pDetA, avg(l_tax * 12.5) AS pAssA, CAST(NULL AS DOUBLE) AS pHOTA FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS video_id, o_custkey % 10 AS category_id, round(pDetA + 1e-9, 6) AS pDetA, round(pAssA + 1e-9, 6) AS pAssA, pHOTA FROM orders LEFT JOIN m ON o_orderkey = l_orderkey AND o_custkey % 10 = c""")
def scored_probes(spark, d):
    keys = [F.col("l_orderkey").alias("video_id"), (F.col("l_suppkey") % 10).alias("category_id")]
    metrics = mapping.read(spark, d, "lineitem").groupBy(*keys).agg(F.avg(F.col("l_discount") * 10).alias("pDetA"), F.avg(F.col("l_tax") * 12.5).alias("pAssA"), F.lit(None).cast("double").alias("pHOTA"))
    probes = mapping.read(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_custkey") % 10).alias("category_id"))
    return scoring.with_metrics(probes, metrics, ["video_id", "category_id"]).select("video_id", "category_id", *_up("pDetA", "pAssA"), "pHOTA")


@query(f"""{_CELLS}, s AS (SELECT * FROM cells WHERE pDetA IS NOT NULL)
SELECT {", ".join(f"round(sum(n_frames * {m}) / nullif(sum(n_frames), 0), 6) AS {m}" for m in scoring.METRICS)}, count(*) AS n_scored, (SELECT count(*) FROM cells) AS n_cells FROM s""")
def weighted_means(spark, d):
    return scoring.weighted_means(mapping.cells(spark, d)).select(*_r(*scoring.METRICS), "n_scored", "n_cells")


@query(f"""{_CELLS}, c AS (SELECT count(*) AS n, count(pDetA) AS a, count(pAssA) AS b, count(time) AS t FROM cells)
SELECT 'pDetA' AS "column", a AS n_real, n AS n_rows FROM c UNION ALL SELECT 'pAssA', b, n FROM c UNION ALL SELECT 'time', t, n FROM c""")
def coverage(spark, d):
    return scoring.coverage(mapping.cells(spark, d), ["pDetA", "pAssA", "time"])


# Scalars


@query("""
SELECT o_orderkey, coalesce(nullif(regexp_extract(o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m-%d'), '[0-9]{4}'), ''), '') AS year,
  lower(trim(o_orderstatus)) NOT IN ('', 'nan', 'none') AS is_real,
  trim(replace(regexp_replace(lower(trim(o_orderpriority || '_(old)')), '_\\([^)]*\\)$', ''), '_', ' ')) AS class_name,
  CASE WHEN o_orderstatus = 'F' THEN 'animal' ELSE coalesce(nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END, ''), 'species') END AS prompt
FROM orders""".replace("\\\\", "\\"))
def year_bucket(spark, d):
    rows = mapping.read(spark, d, "orders")
    text = F.concat_ws(" ", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"))
    noun = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    return rows.select(
        "o_orderkey", S.year_text(text).alias("year"), S.is_real(F.col("o_orderstatus")).alias("is_real"),
        S.normal_class_name(F.concat("o_orderpriority", F.lit("_(old)"))).alias("class_name"),
        S.prompt_text(F.when(F.col("o_orderstatus") == "F", "generic").otherwise("noun"), noun, F.lit("species")).alias("prompt"),
    )


@query("""
WITH o AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(v) <= 3 THEN v ELSE list_sort(list_distinct(list_transform(range(3), lambda k: v[(1 + round_even(k * (len(v) - 1) / 2.0, 0))::BIGINT]))) END AS picked,
  v[1:1] AS single, list_filter(v, lambda x, i: (i - 1) % greatest(1, len(v) // 2) = 0)[1:2] AS strided FROM o""")
def even_sample(spark, d):
    rows = mapping.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    rows = rows.select("l_orderkey", F.col("s.l_linenumber").alias("v"))
    return rows.select("l_orderkey", F.when(F.size("v") <= 3, S.sample_evenly(F.col("v"), 3)).otherwise(F.array_sort(S.sample_evenly(F.col("v"), 3))).alias("picked"), S.sample_evenly(F.col("v"), 1).alias("single"), S.sample_stride(F.col("v"), 2).alias("strided"))


@query("""
SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value / 60, 0.0), 1.0) END AS clipped, greatest(coalesce(value - 20, 0.0), 0.0) AS weight,
  TRY_CAST(event_type || '1' AS DOUBLE) AS number, CASE WHEN value / 100 >= 0.2 THEN least(value / 100 * 2.0, 1.0) END AS gained, 'u' AS origin, CAST(user_id AS VARCHAR) AS raw_id
FROM events""")
def clipped_scores(spark, d):
    rows = mapping.read(spark, d, "events")
    origin, raw = S.split_key(F.concat_ws(":", F.lit("u"), "user_id"))
    return rows.select("event_id", S.unit(F.col("value") / 60).alias("clipped"), S.weight(F.col("value") - 20).alias("weight"), S.number(F.concat("event_type", F.lit("1"))).alias("number"), S.gained(F.col("value") / 100, 0.2, 2.0).alias("gained"), origin.alias("origin"), raw.alias("raw_id"))


_TAX = """tax AS (SELECT CAST(p_partkey AS VARCHAR) AS id, [p_type, p_brand, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2),
  CAST(p_size % 5 AS VARCHAR), CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR)] AS path, p_partkey AS k FROM part)"""
_SHARED = " + ".join("(" + " AND ".join(f"a.path[{j}] = b.path[{j}]" for j in range(1, i + 1)) + ")::INT" for i in range(1, 8))


@query(f"WITH {_TAX} SELECT a.id, b.id AS other, 7 - ({_SHARED}) AS steps FROM tax a JOIN tax b ON b.k = a.k + 25")
def tree_steps(spark, d):
    a = mapping.taxonomy(spark, d)
    b = a.select(F.col("category_id").alias("other"), F.col("path").alias("other_path"))
    pairs = a.join(b, b.other.cast("long") == a.category_id.cast("long") + 25)
    return pairs.select(F.col("category_id").alias("id"), "other", S.tree_distance(F.col("path"), F.col("other_path")).alias("steps"))


# Caps


_RANK = "row_number() OVER (PARTITION BY {by} ORDER BY {order}) <= {n}"
_ORDER = ", ".join(mapping.ORDER)


@query(f"WITH {PROBE_SQL} SELECT category_id, {_ORDER} FROM probe WHERE num_masklets > 0 QUALIFY {_RANK.format(by='category_id', order=_ORDER, n=40)}")
def capped_masklets(spark, d):
    rows = mapping.probes(spark, d).filter("num_masklets > 0")
    return caps.first_n(rows, ["category_id"], mapping.ORDER, 40).select("category_id", *mapping.ORDER)


@query(f"WITH {PROBE_SQL} SELECT location_id, {_ORDER} FROM probe QUALIFY {_RANK.format(by='location_id', order=_ORDER, n=200)}")
def capped_frames(spark, d):
    return caps.first_n(mapping.probes(spark, d), ["location_id"], mapping.ORDER, 200).select("location_id", *mapping.ORDER)


@query(f"WITH {PROBE_SQL}, c AS (SELECT * FROM probe WHERE num_masklets > 0 QUALIFY {_RANK.format(by='category_id', order=_ORDER, n=5)}) SELECT category_id, {_ORDER} FROM c ORDER BY {_ORDER} LIMIT 60")
def capped_probes(spark, d):
    rows = mapping.probes(spark, d).withColumn("record_ord", F.struct(*mapping.ORDER))
    return caps.capped_probes(rows, 5, 60).select("category_id", *mapping.ORDER)


@query("""
WITH det AS (SELECT l_orderkey AS video_id, l_linenumber AS frame_idx, concat_ws(':', l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS det_id, l_discount * 10 AS score FROM lineitem)
SELECT video_id, frame_idx, det_id, round(score, 6) AS score FROM det WHERE score > 0.15 QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY score DESC, det_id) <= 2""")
def topk_detections(spark, d):
    return caps.top_detections(mapping.detections(spark, d), 2, 0.15).select("video_id", "frame_idx", "det_id", *_r("score"))


@query(f"{_CELLS} SELECT {_CELL}, round(avg(pDetA) OVER (PARTITION BY species), 6) AS pDetA FROM cells")
def species_collapse(spark, d):
    return caps.species_mean(mapping.cells(spark, d), "pDetA", "species").select(*CELL, *_r("pDetA"))


# Partitions


@query(f"WITH {PROBE_SQL} SELECT origin || ':' || CAST(k1 AS VARCHAR) AS video_key, origin, category_id, num_masklets FROM probe WHERE num_masklets > 0")
def pooled_probes(spark, d):
    rows = mapping.probes(spark, d).withColumn("video_id", F.col("k1"))
    pooled = partition.pool({o: rows.filter(F.col("origin") == o).drop("origin") for o in ("train", "test")})
    return partition.present(pooled).select("video_key", "origin", "category_id", "num_masklets")


_MEMBERS = "SELECT DISTINCT 'species' AS axis, '{s}' AS side, category_id AS value FROM {t} UNION SELECT DISTINCT 'location', '{s}', location_id FROM {t} UNION SELECT DISTINCT 'year', '{s}', time FROM {t}"


def _members(reference: str, probe: str) -> str:
    sides = [_MEMBERS.format(s=s, t=f"(SELECT * FROM probe WHERE num_masklets > 0 AND {where})") for s, where in (("reference", reference), ("probe", probe))]
    return f"WITH {PROBE_SQL}, member AS ({' UNION '.join(sides)})"


@query(_members("true", "true") + " SELECT axis, side, value FROM member")
def partition_species(spark, d):
    return partition.species_partition(mapping.probes(spark, d), ["train", "test"])


@query(_members("true", "true") + " SELECT axis, side, value, (SELECT count(*) FROM (SELECT DISTINCT category_id, location_id, time FROM probe)) AS n_cells FROM member")
def frozen_partition(spark, d):
    """A partition and its manifest, frozen and loaded again."""
    rows, path = mapping.probes(spark, d), scratch_path(spark)
    partition.save(partition.species_partition(rows, ["train", "test"]), path, partition.manifest(rows))
    n_cells = partition.load_manifest(spark, path).agg(F.count("*").alias("n_cells"))
    return partition.load(spark, path).select("axis", "side", "value").crossJoin(n_cells)  # one row


@query(_members("origin_loc = 'train'", "origin_loc = 'test'") + " SELECT axis, side, value FROM member")
def partition_location(spark, d):
    return partition.location_partition(mapping.probes(spark, d).withColumn("origin", F.col("origin_loc")))


@query(_members("origin_loc = 'train'", "origin_loc = 'test'") + """, v AS (SELECT axis, value, bool_or(side = 'reference') AS r, bool_or(side = 'probe') AS p FROM member GROUP BY 1, 2)
SELECT axis, count(*) FILTER (r) AS n_reference, count(*) FILTER (p) AS n_probe, count(*) FILTER (r AND p) AS n_both FROM v GROUP BY 1""")
def overlap_report(spark, d):
    rows = partition.location_partition(mapping.probes(spark, d).withColumn("origin", F.col("origin_loc")))
    return partition.assert_no_leakage(rows, "location", loso=False)


@query(_members("origin = 'train'", "origin = 'test'") + f" SELECT category_id, {_ORDER} FROM probe WHERE num_masklets > 0 AND origin = 'test' AND category_id IN (SELECT value FROM member WHERE axis = 'species' AND side = 'probe')")
def probe_side(spark, d):
    rows = mapping.probes(spark, d)
    return partition.side_of(rows, partition.location_partition(rows), "probe", ["test"]).select("category_id", *mapping.ORDER)


@query(f"WITH {PROBE_SQL} SELECT category_id, location_id, time, min(species) AS species, count(*) AS n_videos FROM probe WHERE origin = 'test' GROUP BY 1, 2, 3")
def manifest(spark, d):
    return partition.manifest(mapping.probes(spark, d).filter("origin = 'test'"))


@query(f"""WITH {PROBE_SQL}, pairs AS (SELECT DISTINCT category_id, time AS location_id FROM probe WHERE num_masklets > 0),
s AS (SELECT location_id, CAST(count(*) > 1 AS DOUBLE) AS shared FROM pairs GROUP BY 1)
SELECT round(avg(share), 3) AS shared_locations FROM (SELECT category_id, avg(shared) AS share FROM pairs JOIN s USING (location_id) GROUP BY 1)""")
def shared_locations(spark, d):
    rows = mapping.probes(spark, d).withColumn("location_id", F.col("time"))
    return partition.structural_report(rows, mapping.taxonomy(spark, d))[1]


@query(f"""WITH {_TAX}, near AS (SELECT a.id, min(7 - ({_SHARED})) AS distance FROM tax a JOIN tax b ON a.id <> b.id GROUP BY 1)
SELECT CAST(distance AS DOUBLE) AS distance, count(*) AS n_species FROM near GROUP BY 1""")
def structural_report(spark, d):
    paths = mapping.taxonomy(spark, d)
    rows = paths.select("category_id", F.lit("site").alias("location_id"), F.lit(1).alias("num_masklets"))
    return partition.structural_report(rows, paths)[0]


# Sources


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def resume_pending(spark, d):
    orders = mapping.read(spark, d, "orders")
    return tables.pending(orders, orders.filter("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def trim_ground_truth(spark, d):
    predicted = mapping.read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return mapping.read(spark, d, "lineitem").join(predicted, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT CAST(event_id AS VARCHAR) AS video_id, event_type AS category_id,
  round(coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS pDetA, round(value, 6) AS pAssA, CAST(NULL AS DOUBLE) AS pHOTA FROM events""")
def evaluator_parse(spark, d):
    rows = mapping.read(spark, d, "events").select(
        F.col("event_id").cast("string").alias("video_id"), F.col("event_type").alias("category_id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("mask_DetA"), F.get_json_object("props", "$.k").cast("double").alias("bbox_DetA"),
        F.lit(None).cast("double").alias("mask_AssA"), F.col("value").alias("AssA"), F.lit(None).cast("double").alias("HOTA"),
    )
    return tables.evaluator_metrics(rows).select("video_id", "category_id", *_r("pDetA", "pAssA", "pHOTA"))


@query("""SELECT 'p' AS category, id, map_keys(m) AS levels FROM (
  SELECT p_partkey AS id, MAP_FROM_ENTRIES(list_filter([('Family', p_brand), ('Genus', CASE WHEN p_size % 3 = 0 THEN 'NaN' ELSE split_part(p_name, ' ', 1) END)], lambda e: lower(trim(e[2])) NOT IN ('', 'nan', 'none'))) AS m FROM part)""")
def clean_taxonomy(spark, d):
    genus = F.when(F.col("p_size") % 3 == 0, "NaN").otherwise(F.split("p_name", " ")[0])
    cleaned = S.clean_taxonomy({"Family": F.col("p_brand"), "Genus": genus})
    return mapping.read(spark, d, "part").select(F.lit("p").alias("category"), F.col("p_partkey").alias("id"), F.map_keys(cleaned).alias("levels"))


@query("""SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS path FROM part JOIN lineitem ON l_partkey = p_partkey""")
def category_entries(spark, d):
    parts = mapping.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), "p_size")
    pairs = mapping.read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("category_id"))
    return tables.category_entries(pairs, parts, parts.filter("p_size % 2 = 0")).select("id", "name", "path")


# Nearest joins and vectors


@query(f"""WITH {_TAX} SELECT a.id AS category_id, CAST(min(7 - ({_SHARED})) AS DOUBLE) AS distance FROM tax a LEFT JOIN tax b ON b.k % 3 <> 0 AND a.id <> b.id GROUP BY 1""")
def taxonomic_distance(spark, d):
    paths = mapping.taxonomy(spark, d)
    return nearest.taxonomic_distance(paths, paths.filter("cast(category_id as long) % 3 <> 0"), loso=True)


@query(f"""{_CELLS}, y AS (SELECT DISTINCT CAST(time AS INT) AS y FROM probe WHERE origin = 'train' AND num_masklets > 0)
SELECT {_CELL}, CAST(min(abs(CAST(time AS INT) - y)) AS DOUBLE) AS temporal_gap FROM cells, y GROUP BY {_CELL}""")
def temporal_gap(spark, d):
    years = mapping.probes(spark, d).filter("origin = 'train' and num_masklets > 0").select(F.col("time").alias("year"))
    return nearest.temporal_gap(mapping.cells(spark, d), years).select(*CELL, "temporal_gap")


def _proto(key: str, where: str = "true", name: str = "proto") -> str:
    return f"""{name}_m AS (SELECT {key} AS key, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) WHERE {where} GROUP BY 1, 2),
{name} AS (SELECT key, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY key)), 1e-12) AS x FROM {name}_m)"""


_LABEL, _SITE = "CAST(label AS VARCHAR)", "CAST(vec_id % 20 AS VARCHAR)"


@query(f"WITH {_proto(_LABEL)} SELECT key AS category_id, i - 1 AS i, round(x, 6) AS x FROM proto")
def prototype(spark, d):
    protos = nearest.prototypes(mapping.vectors(spark, d), "category_id")
    return protos.select("category_id", F.posexplode("proto").alias("i", "x")).select("category_id", F.col("i").cast("long").alias("i"), *_r("x"))


def _nearest_sql(key: str) -> str:
    return f"""WITH {_proto(key, name='p')}, {_proto(key, 'vec_id % 4 <> 0', 'q')}, cos AS (SELECT p.key, q.key AS other, sum(p.x * q.x) AS c FROM p JOIN q USING (i) WHERE p.key <> q.key GROUP BY 1, 2)
SELECT key AS {{name}}, round(1 - max(c), 6) AS distance FROM cos GROUP BY 1"""


@query(_nearest_sql(_LABEL).format(name="category_id"))
def visual_distance(spark, d):
    rows = mapping.vectors(spark, d)
    near = nearest.nearest_prototype(nearest.prototypes(rows, "category_id"), nearest.prototypes(rows.filter("is_reference"), "category_id"), "category_id", True)
    return near.select("category_id", *_r("distance"))


@query(_nearest_sql(_SITE).format(name="location_id"))
def environment_distance(spark, d):
    rows = mapping.vectors(spark, d)
    near = nearest.nearest_prototype(nearest.prototypes(rows, "location_id"), nearest.prototypes(rows.filter("is_reference"), "location_id"), "location_id", True)
    return near.select("location_id", *_r("distance"))


@query(f"""WITH {_proto(_LABEL)}, cos AS (SELECT a.key, max(c) AS c FROM (SELECT a.key, b.key AS o, sum(a.x * b.x) AS c FROM proto a JOIN proto b USING (i) WHERE a.key <> b.key GROUP BY 1, 2) a GROUP BY 1),
v AS (SELECT {_LABEL} AS key, vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)),
n AS (SELECT key, vec_id, sqrt(sum(x * x)) AS len FROM v GROUP BY 1, 2),
intra AS (SELECT key, avg(g) AS g FROM (SELECT v.key, v.vec_id, 1 - sum(v.x * proto.x) / any_value(len) AS g FROM v JOIN proto ON v.key = proto.key AND v.i = proto.i JOIN n ON n.key = v.key AND n.vec_id = v.vec_id GROUP BY 1, 2) GROUP BY 1)
SELECT key AS category_id, round(((1 - c) - g) / greatest(1 - c, g), 6) AS value FROM cos JOIN intra USING (key)""")
def silhouette(spark, d):
    return vectors.familiarity(mapping.vectors(spark, d), "category_id", "silhouette").select("category_id", *_r("value"))


@query()
def frechet(spark, d):
    rows = mapping.vectors(spark, d)
    return vectors.distribution_distance(rows, rows.filter("is_reference"), "category_id", "vec_id", True, "frechet").select("category_id", *_r("value"))


@query()
def mahalanobis(spark, d):
    return vectors.familiarity(mapping.vectors(spark, d), "category_id", "mahalanobis").select("category_id", *_r("value"))


_MMD_SIDE = 512


@query(f"""WITH v AS (SELECT vec_id, {_LABEL} AS k, vec_id % 4 <> 0 AS ref, CAST(embedding AS DOUBLE[]) AS x, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings),
pool AS (SELECT k, h, vec_id, x FROM v WHERE ref ORDER BY h, vec_id LIMIT {8 * _MMD_SIDE}),
mine AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY h, vec_id) AS i FROM v QUALIFY i <= {_MMD_SIDE}),
other AS (SELECT g.k, p.x, row_number() OVER (PARTITION BY g.k ORDER BY p.h, p.vec_id) AS i FROM (SELECT DISTINCT k FROM v) g JOIN pool p ON p.k <> g.k QUALIFY i <= {_MMD_SIDE}),
side AS (SELECT k, true AS own, x FROM mine UNION ALL SELECT k, false, x FROM other),
d AS (SELECT a.k, a.own AS a, b.own AS b, list_distance(a.x, b.x) ** 2 AS d2 FROM side a JOIN side b USING (k)),
w AS (SELECT k, 2 * median(d2) + 1e-12 AS width FROM d GROUP BY 1)
SELECT k AS category_id, round(avg(exp(-d2 / width)) FILTER (a AND b) + avg(exp(-d2 / width)) FILTER (NOT a AND NOT b) - 2 * avg(exp(-d2 / width)) FILTER (a AND NOT b), 6) AS value
FROM d JOIN w USING (k) GROUP BY 1""")
def mmd(spark, d):
    rows = mapping.vectors(spark, d)
    return vectors.distribution_distance(rows, rows.filter("is_reference"), "category_id", "vec_id", True, "mmd").select("category_id", *_r("value"))


_UNIT = "(('0x' || substr(md5('0:' || j || ':' || (i - 1)), {at}, 8))::BIGINT + 1) / 4294967296.0"


@query(f"""WITH v AS (SELECT vec_id, {_LABEL} AS k, vec_id % 4 <> 0 AS ref, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)),
m AS (SELECT 2 * sum(v) AS width FROM (SELECT avg(x * x) - avg(x) ** 2 AS v FROM v WHERE ref GROUP BY i)),
o AS (SELECT j, i, sqrt(-2 * ln({_UNIT.format(at=1)})) * cos(2 * pi() * {_UNIT.format(at=9)}) / sqrt(width) AS o FROM range(256) a(j), range(1, 65) b(i), m),
a AS (SELECT k, vec_id, any_value(ref) AS ref, j, sum(x * o) AS angle FROM v JOIN o USING (i) GROUP BY k, vec_id, j),
f AS (SELECT k, ref, j, cos(angle) AS c, sin(angle) AS s FROM a),
p AS (SELECT j, sum(c) AS c, sum(s) AS s, count(*) AS n FROM f WHERE ref GROUP BY j),
g AS (SELECT k, j, avg(c) AS c, avg(s) AS s, sum(c) FILTER (ref) AS rc, sum(s) FILTER (ref) AS rs, count(*) FILTER (ref) AS rn FROM f GROUP BY k, j)
SELECT k AS category_id, round(sum((g.c - (p.c - rc) / (n - rn)) ** 2 + (g.s - (p.s - rs) / (n - rn)) ** 2) / 256, 6) AS value FROM g JOIN p USING (j) GROUP BY k""")
def mmd_features(spark, d):
    rows = mapping.vectors(spark, d)
    return vectors.distribution_distance(rows, rows.filter("is_reference"), "category_id", "vec_id", True, "mmd_features").select("category_id", *_r("value"))


@query("SELECT vec_id AS key, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE vec_id % 4 = 0")
def encode_backlog(spark, d):
    rows = mapping.vectors(spark, d).select(F.col("vec_id").alias("key"), "vec", "is_reference")
    done = rows.filter("is_reference")

    def encoder(batches):
        for pdf in batches:
            yield pdf.assign(total=[float(sum(map(float, v))) for v in pdf["vec"]])[["key", "total"]]

    return nearest.encode_missing(rows, done, encoder, "key long, total double").select("key", *_r("total"))


# Scene, size and feature assembly


@query("""SELECT CAST(user_id % 8 AS VARCHAR) AS location_id, round(avg(CAST(event_type = 'error' AS DOUBLE)), 6) AS achromatic_fraction, round(avg(value), 6) AS clutter,
  avg(CAST(event_type = 'error' AS DOUBLE)) > 0.5 AS is_night_ir FROM events GROUP BY 1""")
def scene_flags(spark, d):
    from relyframe.operators.masks import location_scene

    rows = mapping.predictions(spark, d).withColumn("clutter", F.col("score")).drop("clutter")
    rows = rows.join(mapping.read(spark, d, "events").select("event_id", "value"), "event_id")
    return location_scene(rows, "is_error", "value").select("location_id", *_r("achromatic_fraction", "clutter"), "is_night_ir")


_LOG_SIZE = f"""capped AS (SELECT category_id, n_frames * 100 AS area FROM probe WHERE num_masklets > 0 QUALIFY {_RANK.format(by='category_id', order=_ORDER, n=40)}),
size AS (SELECT s.category_id, ln(1 + avg(area)) AS log_area FROM (SELECT DISTINCT category_id FROM probe) s LEFT JOIN capped USING (category_id) GROUP BY 1)"""


def _log_area(spark, d) -> DataFrame:
    from relyframe.operators.masks import log_area

    rows = mapping.probes(spark, d).withColumn("record_ord", F.struct(*mapping.ORDER)).withColumn("ann_id", F.concat_ws(":", *mapping.ORDER))
    frames = rows.filter("num_masklets > 0").select("category_id", "ann_id", "record_ord", F.lit(0).alias("masklet_ord"), (F.col("n_frames") * 100).alias("area"))
    return log_area(frames, rows, 40)


@query(f"WITH {PROBE_SQL}, {_LOG_SIZE} SELECT category_id, round(log_area, 6) AS log_area FROM size")
def log_size(spark, d):
    return _log_area(spark, d).select("category_id", *_r("log_area"))


@query(f"""{_CELLS}, {_LOG_SIZE}, y AS (SELECT DISTINCT CAST(time AS INT) AS y FROM probe WHERE origin = 'train' AND num_masklets > 0),
gap AS (SELECT {_CELL}, CAST(min(abs(CAST(time AS INT) - y)) AS DOUBLE) AS temporal_gap FROM cells, y GROUP BY {_CELL}),
night AS (SELECT location_id, avg(CAST(is_night_ir AS DOUBLE)) AS night FROM probe GROUP BY 1)
SELECT {_CELL}, round(pDetA + 1e-9, 6) AS pDetA, round(log_area, 6) AS log_area, temporal_gap, round(night, 6) AS night
FROM cells LEFT JOIN size USING (category_id) LEFT JOIN gap USING ({_CELL}) LEFT JOIN night USING (location_id)""")
def features_assembled(spark, d):
    rows, cells = mapping.probes(spark, d), mapping.cells(spark, d)
    gap = nearest.temporal_gap(cells, rows.filter("origin = 'train' and num_masklets > 0").select(F.col("time").alias("year"))).select(*CELL, "temporal_gap")
    night = rows.groupBy("location_id").agg(F.avg(F.col("is_night_ir").cast("double")).alias("night"))
    member = partition.species_partition(rows, ["train", "test"])
    table = studies.assemble_features(cells, member, "species", True, per_species=[_log_area(spark, d)], per_location=[night], per_cell=[gap])
    return table.select(*CELL, *_up("pDetA"), *_r("log_area"), "temporal_gap", *_r("night"))


def _drawn_sql(rows: str, n_draws: int = DRAWS, tag: str = "") -> str:
    """Draws of numbered rows (g from 0) in DuckDB: the same slots as in Spark."""
    return f"""gn{tag} AS (SELECT count(*) AS n FROM {rows}), slots{tag} AS (SELECT b, j, (('0x' || substr(md5('0:' || b || ':' || j), 1, 8))::BIGINT) % n AS g FROM gn{tag}, range({n_draws}) x(b), (SELECT unnest(range((SELECT n FROM gn{tag}))) AS j)),
drawn{tag} AS (SELECT b, g, count(*) AS m FROM slots{tag} GROUP BY 1, 2)"""


# Confidence and false positives


_PRED = """pred AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, least(value / 100, 1.0) AS score,
  CAST(json_extract_string(props, '$.k') AS INT) AS frame_idx, event_type = 'error' AS is_error, user_id % 2 = 1 AS is_reference FROM events)"""


@query(f"WITH {_PRED} SELECT round(coalesce(quantile_cont(score, 1 - 0.4), 0.5), 6) AS threshold FROM pred WHERE is_reference")
def atc_threshold(spark, d):
    return scoring.atc_threshold(mapping.predictions(spark, d).filter("is_reference"), 0.4).select(*_r("threshold"))


@query(f"""WITH {_PRED}, f AS (SELECT user_id, sum(covered) AS c, sum(total) AS t FROM (SELECT user_id, day, count(DISTINCT frame_idx) AS covered, max(frame_idx) + 1 AS total FROM pred GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, round(avg(CAST(score >= 0.3 AS DOUBLE)), 6) AS conf_share, round(avg(score) + 1e-9, 6) AS conf_mean, round(quantile_cont(score, 0.5) + 1e-9, 6) AS conf_median, round(any_value(c) / any_value(t), 6) AS conf_coverage
FROM pred JOIN f USING (user_id) GROUP BY 1""")
def confidence_cells(spark, d):
    rows = mapping.predictions(spark, d).withColumn("probe", F.concat_ws(":", "user_id", "day"))
    frames = rows.groupBy("probe").agg(F.count_distinct("frame_idx").alias("covered"), (F.max("frame_idx") + 1).alias("total"))
    cells = scoring.confidence_cells(rows.join(frames, "probe"), 0.3, ["user_id"])
    return cells.select("user_id", *_r("conf_share"), *_up("conf_mean", "conf_median"), *_r("conf_coverage"))


@query(ORACLE_SQL["confidence_cells"].replace("SELECT user_id, round(avg(CAST", "SELECT user_id AS category_id, round(avg(CAST"))
def stream_confidence(spark, d):
    """The same cells through the incremental ingest, read back from its table."""
    rows = mapping.predictions(spark, d).withColumn("video_id", F.col("day")).withColumn("category_id", F.col("user_id"))
    frames = rows.groupBy("video_id", "category_id").agg(F.count_distinct("frame_idx").alias("covered"), (F.max("frame_idx") + 1).alias("total"))
    source, made = scratch_path(spark), scratch_path(spark)
    probes = rows.groupBy("video_id", "category_id").agg(F.collect_list("score").alias("scores")).join(frames, ["video_id", "category_id"])
    probes.write.parquet(source)
    probes.filter(F.col("category_id") % 2 == 0).write.mode("append").parquet(source)  # delivered again under another name
    stream = spark.readStream.schema(probes.schema).option("maxFilesPerTrigger", 8).parquet(source)
    incremental.ingest_probes(stream, made, scratch_path(spark)).awaitTermination()
    cells = incremental.confidence_of(spark, made, 0.3)
    return cells.select("category_id", *_r("conf_share"), *_up("conf_mean", "conf_median"), *_r("conf_coverage"))


_FP = f"""{_PRED}, neg AS (SELECT user_id AS category_id, user_id, day, max(score) AS max_score, count(*) AS n_pred FROM pred GROUP BY user_id, day HAVING bool_or(is_error)),
fp AS (SELECT *, CAST(max_score >= 0.4 AS INT) AS fp, CAST(CAST(category_id AS BIGINT) % 7 AS DOUBLE) AS distance, CAST(CAST(category_id AS BIGINT) % 5 AS DOUBLE) AS log_area FROM neg),
sp AS (SELECT category_id, avg(CAST(fp AS DOUBLE)) AS fp_rate, count(*) AS n, min(distance) AS distance, min(log_area) AS log_area FROM fp GROUP BY 1)"""


def _fp(spark, d) -> DataFrame:
    rows = mapping.predictions(spark, d).withColumn("probe", F.concat_ws(":", "user_id", "day"))
    negatives = rows.filter("is_error").select("probe", F.col("user_id").alias("category_id")).distinct()
    # A user's day holds a bounded number of masklets.
    scores = rows.groupBy("probe").agg(F.collect_list("score").alias("scores"))
    fp = scoring.false_positives(negatives, scores, 0.4)
    key = F.col("category_id").cast("long")
    return fp.withColumns({"distance": (key % 7).cast("double"), "log_area": (key % 5).cast("double")})


def _fp_species(spark, d) -> DataFrame:
    return scoring.fp_by_species(_fp(spark, d)).withColumn("log_area", (F.col("category_id").cast("long") % 5).cast("double"))


@query(f"WITH {_FP} SELECT category_id, round(fp_rate, 6) AS fp_rate, n, distance FROM sp")
def fp_rates(spark, d):
    return scoring.fp_by_species(_fp(spark, d)).select("category_id", *_r("fp_rate"), "n", "distance")


@query(f"WITH {_FP} SELECT round(avg(CAST(fp AS DOUBLE)), 6) AS fp_rate, 1.0::DOUBLE AS any_rate, count(*) AS n FROM fp")
def fp_overall(spark, d):
    return scoring.fp_overall(_fp(spark, d)).select(*_r("fp_rate", "any_rate"), "n")


@query(f"""WITH {_FP}, e AS (SELECT quantile_cont(distance, 1 / 3.0::DOUBLE) AS a, quantile_cont(distance, 2 / 3.0::DOUBLE) AS b FROM fp)
SELECT (distance > a)::INT + (distance > b)::INT AS bin, count(*) AS n, round(avg(CAST(fp AS DOUBLE)), 6) AS rate FROM fp, e GROUP BY 1""")
def fp_terciles(spark, d):
    rows = _fp(spark, d).withColumn("rate", F.col("fp").cast("double"))
    return scoring.quantile_bins(rows, "distance", "rate").select("bin", "n", *_r("rate"))


_WR = "(sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) / sqrt((sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) * (sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2))"


@query(f"WITH {_FP} SELECT round({_WR}, 6) AS r FROM (SELECT distance AS x, fp_rate AS y, n AS w FROM sp)")
def weighted_pearson(spark, d):
    return scoring.weighted_pearson(scoring.fp_by_species(_fp(spark, d)), "distance", "fp_rate", "n").select(*_r("r"))


@query(f"""WITH {_FP}, a AS (SELECT {_WR} AS r FROM (SELECT distance AS x, fp_rate AS y, n AS w FROM sp)), b AS (SELECT {_WR} AS r FROM (SELECT distance AS x, log_area AS y, n AS w FROM sp)),
c AS (SELECT {_WR} AS r FROM (SELECT fp_rate AS x, log_area AS y, n AS w FROM sp)) SELECT round((a.r - b.r * c.r) / sqrt((1 - b.r ** 2) * (1 - c.r ** 2)), 6) AS r FROM a, b, c""")
def partial_corr(spark, d):
    return scoring.partial_corr(_fp_species(spark, d), "distance", "fp_rate", "log_area", "n").select(*_r("r"))


@query(f"""WITH {_FP}, m AS (SELECT sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy FROM (SELECT distance AS x, fp_rate AS y, n AS w FROM sp)),
l AS (SELECT (w * wxy - wx * wy) / (w * wxx - wx * wx) AS slope, * FROM m) SELECT round(slope, 6) AS slope, round((wy - slope * wx) / w, 6) AS intercept FROM l""")
def weighted_line(spark, d):
    return scoring.weighted_line(scoring.fp_by_species(_fp(spark, d)), "distance", "fp_rate", "n").select(*_r("slope", "intercept"))


@query(f"""WITH {_FP}, t AS (SELECT sum(n) AS w, sum(n * distance) AS wx, sum(n * fp_rate) AS wy, sum(n * distance * distance) AS wxx, sum(n * distance * fp_rate) AS wxy FROM sp),
l AS (SELECT category_id, distance, w - n AS w, wx - n * distance AS wx, wy - n * fp_rate AS wy, wxx - n * distance * distance AS wxx, wxy - n * distance * fp_rate AS wxy FROM sp, t)
SELECT category_id, round(wy / w + (w * wxy - wx * wy) / (w * wxx - wx * wx) * (distance - wx / w), 6) AS predicted, round(wy / w, 6) AS base FROM l""")
def fp_loo_line(spark, d):
    rows = scoring.fp_by_species(_fp(spark, d)).select("category_id", "distance", "fp_rate", "n")
    return association.leave_one_out_line(rows, "distance", "fp_rate", "n").select("category_id", *_r("predicted", "base"))


_LOO = f"""{_FP}, t AS (SELECT sum(n) AS w, sum(n * distance) AS wx, sum(n * fp_rate) AS wy, sum(n * distance * distance) AS wxx, sum(n * distance * fp_rate) AS wxy FROM sp),
l AS (SELECT category_id, distance, fp_rate, n, w - n AS w, wx - n * distance AS wx, wy - n * fp_rate AS wy, wxx - n * distance * distance AS wxx, wxy - n * distance * fp_rate AS wxy FROM sp, t),
held AS (SELECT category_id, n, abs(fp_rate - (wy / w + (w * wxy - wx * wy) / (w * wxx - wx * wx) * (distance - wx / w))) AS e, abs(fp_rate - wy / w) AS e0 FROM l)"""


@query(f"""WITH {_LOO}, num AS (SELECT n AS w, e0 - e AS gain, row_number() OVER (ORDER BY category_id) - 1 AS g FROM held), {_drawn_sql('num')},
boot AS (SELECT b, sum(m * w * gain) / sum(m * w) AS d FROM drawn JOIN num USING (g) GROUP BY 1),
ends AS (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, avg(CAST(d <= 0 AS DOUBLE)) AS p FROM boot)
SELECT round(sum(n * e) / sum(n), 6) AS mae, round(sum(n * e0) / sum(n), 6) AS baseline_mae, round(sum(n * (e0 - e)) / sum(n), 6) AS delta, round(any_value(lo), 6) AS ci_lo,
  round(any_value(hi), 6) AS ci_hi, round(any_value(p), 6) AS p_value, any_value(lo) > 0 AS significant, count(*) AS n FROM held, ends""")
def fp_line_validation(spark, d):
    found = association.line_validation(scoring.fp_by_species(_fp(spark, d)), "category_id", "distance", "fp_rate", "n", DRAWS)
    return found.select(*_r("mae", "baseline_mae", "delta", "ci_lo", "ci_hi", "p_value"), "significant", "n")


@query(f"""WITH {_FP}, num AS (SELECT *, row_number() OVER (ORDER BY category_id) - 1 AS g FROM sp), {_drawn_sql('num')},
boot AS (SELECT b, {_WR} AS r FROM (SELECT b, distance AS x, fp_rate AS y, n * m AS w FROM drawn JOIN num USING (g)) GROUP BY b), p AS (SELECT {_WR} AS r, count(*) AS n FROM (SELECT distance AS x, fp_rate AS y, n AS w FROM sp))
SELECT round(any_value(p.r), 6) AS r, round(quantile_cont(boot.r, 0.025), 6) AS ci_lo, round(quantile_cont(boot.r, 0.975), 6) AS ci_hi, any_value(p.n) AS n,
  quantile_cont(boot.r, 0.025) > 0 OR quantile_cont(boot.r, 0.975) < 0 AS significant FROM boot, p""")
def fp_correlation(spark, d):
    found = association.bootstrap_corr(scoring.fp_by_species(_fp(spark, d)), "category_id", "distance", "fp_rate", "n", DRAWS)
    return found.select(*_r("r", "ci_lo", "ci_hi"), "n", "significant")


def _partial_sql(rows: str, by: str = "") -> str:
    """Partial correlation of x and y given z over rows with x, y, z and w, one for each ``by``."""
    of = lambda a, b: _WR.replace("* x", f"* _{a}").replace("* y", f"* _{b}").replace("_x", "x").replace("_y", "y").replace("_z", "z")
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {by + ', ' if by else ''}(xy - xz * yz) / sqrt((1 - xz ** 2) * (1 - yz ** 2)) AS r, n FROM
(SELECT {by + ', ' if by else ''}{of('x', 'y')} AS xy, {of('x', 'z')} AS xz, {of('y', 'z')} AS yz, count(*) AS n FROM {rows} {group})"""


@query(f"""WITH {_FP}, num AS (SELECT distance AS x, fp_rate AS y, log_area AS z, n AS w, row_number() OVER (ORDER BY category_id) - 1 AS g FROM sp), {_drawn_sql('num')},
boot AS ({_partial_sql('(SELECT b, x, y, z, w * m AS w FROM drawn JOIN num USING (g))', 'b')}), p AS ({_partial_sql('num')}),
ends AS (SELECT quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM boot WHERE isfinite(r))
SELECT round(p.r, 6) AS r, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, p.n, lo > 0 OR hi < 0 AS significant FROM ends, p""")
def fp_partial_correlation(spark, d):
    found = association.bootstrap_partial(_fp_species(spark, d), "category_id", "distance", "fp_rate", "log_area", "n", DRAWS)
    return found.select(*_r("r", "ci_lo", "ci_hi"), "n", "significant")


# Correlations


_FEATURES = f"{_CELLS}, feat AS (SELECT *, CAST(time AS DOUBLE) AS year, CAST(n_frames AS DOUBLE) AS frames FROM cells)"


def _feat(spark, d) -> DataFrame:
    return mapping.cells(spark, d).withColumns({"year": F.col("time").cast("double"), "frames": F.col("n_frames").cast("double")})


@query(_FEATURES + " " + " UNION ALL ".join(f"SELECT '{f}' AS feature, '{t}' AS target, round(corr({f}, {t}), 6) AS r, count(*) FILTER ({f} IS NOT NULL AND {t} IS NOT NULL) AS n FROM feat" for f in ("year", "frames") for t in ("pDetA", "pAssA")))
def correlations(spark, d):
    return scoring.correlations(_feat(spark, d), ["year", "frames"], ["pDetA", "pAssA"]).select("feature", "target", *_r("r"), "n")


@query(f"{_FEATURES}, g AS (SELECT species, avg(frames) AS x, avg(pDetA) AS y FROM feat GROUP BY 1) SELECT round(corr(x, y), 6) AS r FROM g")
def between_species_corr(spark, d):
    return scoring.group_mean_corr(_feat(spark, d), "species", "frames", "pDetA").select(*_r("r"))


@query(f"{_FEATURES}, w AS (SELECT pDetA AS x, pDetA - avg(pDetA) OVER (PARTITION BY species) AS e FROM feat WHERE pDetA IS NOT NULL) SELECT round(var_samp(e) / var_samp(x), 6) AS fraction FROM w")
def within_fraction(spark, d):
    return scoring.within_fraction(_feat(spark, d), "species", "pDetA").select(*_r("fraction"))


@query(f"{_FEATURES} SELECT round(corr(pDetA, pHOTA), 6) AS r, round(avg(abs(pDetA - pHOTA)), 6) AS mean_gap, count(*) FILTER (abs(pDetA - pHOTA) <= 1e-8 + 1e-5 * abs(pHOTA)) AS n_equal, count(*) AS n FROM feat")
def agreement(spark, d):
    return scoring.agreement(_feat(spark, d), "pDetA", "pHOTA").select(*_r("r", "mean_gap"), "n_equal", "n")


# Models


_INTERCEPT = models.Design("intercept")
_BINARY = models.Design("night", binary=("is_night_ir",))
_FULL = models.Design("full", ("x_price", "x_size"), ("is_night_ir",), support=True)
_CELL_FULL = models.Design("full", ("year", "frames"), support=True)


@query(f"""{_CELLS}, t AS (SELECT category_id, sum(n_frames * pDetA) AS wy, sum(n_frames) AS w FROM cells WHERE pDetA IS NOT NULL GROUP BY 1)
SELECT {_CELL}, round(pDetA + 1e-9, 6) AS actual, round(((SELECT sum(wy) FROM t) - wy) / ((SELECT sum(w) FROM t) - w), 6) AS predicted FROM cells JOIN t USING (category_id) WHERE pDetA IS NOT NULL""")
def logo_intercept(spark, d):
    oos = grid.oos_predictions(mapping.cells(spark, d), "pDetA", "n_frames", _INTERCEPT, "category_id", "species", CELL)
    return oos.select(*CELL, *_up("actual"), *_r("predicted"))


@query(f"""WITH {PROBE_SQL}, m AS (SELECT is_night_ir AS x, sum(n_frames * pDetA) / sum(n_frames) AS mu FROM probe WHERE pDetA IS NOT NULL GROUP BY 1),
l AS (SELECT max(CASE WHEN x = 0 THEN ln(mu / (1 - mu)) END) AS a, max(CASE WHEN x = 1 THEN ln(mu / (1 - mu)) END) AS b FROM m)
SELECT 'const' AS term, round(a, 6) AS coef FROM l UNION ALL SELECT 'is_night_ir', round(b - a, 6) FROM l""")
def glm_binary_closed_form(spark, d):
    fits = models.fit_many(stored(models.prepare(mapping.probes(spark, d), "pDetA", "n_frames", _BINARY, "category_id")), _BINARY)
    return models.coefficient_table(spark, "pDetA", fits).select("term", *_r("coef"))


@query()
def glm_full(spark, d):
    fits = models.fit_many(stored(models.prepare(mapping.probes(spark, d), "pDetA", "n_frames", _FULL, "category_id")), _FULL)
    table = models.coefficient_table(spark, "pDetA", fits)
    return table.select("target", "term", *_r("coef", "std_err", "z", "p_value", "ci_lo_naive", "ci_hi_naive", "pseudo_r2"))


@query()
def cluster_bootstrap_ci(spark, d):
    found = models.cluster_bootstrap(stored(_feat(spark, d)), "pDetA", "n_frames", _CELL_FULL, ["category_id", "location_id"], DRAWS)
    return found.select("term", *_r("ci_lo", "ci_hi"))


def _cv(spark, d, scheme: str) -> DataFrame:
    oos = grid.oos_predictions(_feat(spark, d), "pDetA", "n_frames", _CELL_FULL, studies.SCHEMES[scheme], scheme, CELL)
    found = models.cv_summary(oos, ["group_scheme", "target"], DRAWS)
    return found.select("group_scheme", "target", "n", *_r("mae", "baseline_mae", "delta", "delta_lo", "delta_hi", "p_value"), "significant")


@query()
def cv_species(spark, d):
    return _cv(spark, d, "species")


@query()
def cv_location(spark, d):
    return _cv(spark, d, "location")


@query(f"""{_CELLS}, n AS (SELECT count(DISTINCT category_id) AS n FROM cells), s AS (SELECT b, (('0x' || substr(md5('7:' || b || ':' || j), 1, 8))::BIGINT) % n AS g FROM n, range(50) x(b), (SELECT unnest(range((SELECT n FROM n))) AS j))
SELECT b, g, count(*) AS m FROM s GROUP BY 1, 2""")
def bootstrap_multiplicity(spark, d):
    n = mapping.cells(spark, d).select("category_id").distinct().count()
    return models.bootstrap_draws(spark, 7, 50, n)


@query(f"""{_CELLS}, t AS (SELECT category_id, sum(n_frames * pDetA) AS wy, sum(n_frames) AS w FROM cells WHERE pDetA IS NOT NULL GROUP BY 1),
e AS (SELECT category_id, abs(pDetA - (SELECT avg(pDetA) FROM cells)) - abs(pDetA - ((SELECT sum(wy) FROM t) - wy) / ((SELECT sum(w) FROM t) - w)) AS d FROM cells JOIN t USING (category_id) WHERE pDetA IS NOT NULL),
num AS (SELECT category_id, sum(d) AS s, count(*) AS c, row_number() OVER (ORDER BY category_id) - 1 AS g FROM e GROUP BY 1), {_drawn_sql('num')},
boot AS (SELECT b, sum(m * s) / sum(m * c) AS d FROM drawn JOIN num USING (g) GROUP BY 1)
SELECT 'species' AS group_scheme, round(quantile_cont(d, 0.025), 6) AS delta_lo, round(quantile_cont(d, 0.975), 6) AS delta_hi, round(avg(CAST(d <= 0 AS DOUBLE)), 6) AS p_value, quantile_cont(d, 0.025) > 0 AS significant FROM boot""")
def paired_bootstrap_delta(spark, d):
    oos = grid.oos_predictions(mapping.cells(spark, d), "pDetA", "n_frames", _INTERCEPT, "category_id", "species", CELL)
    return models.cv_summary(oos, ["group_scheme"], DRAWS).select("group_scheme", *_r("delta_lo", "delta_hi", "p_value"), "significant")


@query(f"""{_FEATURES}, r AS (SELECT corr(year, pDetA) AS a, corr(frames, pDetA) AS b, corr(year, frames) AS c FROM feat WHERE pDetA IS NOT NULL),
s AS (SELECT a * a AS r1, b * b AS r2, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r12, 1 / (1 - c * c) AS vif FROM r)
SELECT 'year' AS factor, round((r1 + r12 - r2) / 2, 6) AS r2_share, round(vif, 6) AS vif FROM s UNION ALL SELECT 'frames', round((r2 + r12 - r1) / 2, 6), round(vif, 6) FROM s""")
def shapley_r2(spark, d):
    return models.shapley_r2(_feat(spark, d), "pDetA", ["year", "frames"]).select("factor", *_r("r2_share", "vif"))


def _lmg_sql(target: str) -> str:
    """LMG shares of three factors in closed form, from the correlations of the complete rows."""
    names = ["year", "frames", "videos"]
    v = [*names, target]
    corr = ", ".join(f"corr({v[i]}, {v[j]}) AS r{i}{j}" for i in range(4) for j in range(i + 1, 4))
    r = lambda i, j: f"r{min(i, j)}{max(i, j)}"
    one = lambda i: f"{r(i, 3)} ** 2"
    two = lambda i, j: f"(({r(i, 3)} ** 2 + {r(j, 3)} ** 2 - 2 * {r(i, 3)} * {r(j, 3)} * {r(i, j)}) / (1 - {r(i, j)} ** 2))"
    det3 = "(1 + 2 * r01 * r02 * r12 - r01 ** 2 - r02 ** 2 - r12 ** 2)"
    squares = " - ".join(f"r{i}{j} ** 2" for i in range(4) for j in range(i + 1, 4))
    det4 = f"(1 - {squares} + 2 * (r01 * r02 * r12 + r01 * r03 * r13 + r02 * r03 * r23 + r12 * r13 * r23) + r01 ** 2 * r23 ** 2 + r02 ** 2 * r13 ** 2 + r03 ** 2 * r12 ** 2 - 2 * (r01 * r02 * r13 * r23 + r01 * r03 * r12 * r23 + r02 * r03 * r12 * r13))"
    rest = {0: (1, 2), 1: (0, 2), 2: (0, 1)}
    shares = ", ".join(f"{one(k)} / 3 + ({two(k, i)} - {one(i)} + {two(k, j)} - {one(j)}) / 6 + (1 - {det4} / {det3} - {two(i, j)}) / 3 AS s{k}, (1 - {r(i, j)} ** 2) / {det3} AS v{k}" for k, (i, j) in rest.items())
    picked = " UNION ALL ".join(f"SELECT '{target}' AS target, '{n}' AS factor, round(s{k}, 6) AS r2_share, round(s{k} / (s0 + s1 + s2), 6) AS share, round(v{k}, 6) AS vif FROM s" for k, n in enumerate(names))
    return f"SELECT * FROM (WITH r AS (SELECT {corr} FROM wide WHERE {target} IS NOT NULL), s AS (SELECT {shares} FROM r) {picked})"


@query(f"{_FEATURES}, wide AS (SELECT *, CAST(n_videos AS DOUBLE) AS videos FROM feat) {_lmg_sql('pDetA')} UNION ALL {_lmg_sql('pAssA')}")
def variance_partition(spark, d):
    rows = _feat(spark, d).withColumn("videos", F.col("n_videos").cast("double"))
    found = studies.variance_partition(rows, ["pDetA", "pAssA"], ["year", "frames", "videos"])
    return found.select("target", "factor", *_r("r2_share", "share", "vif"))


@query()
def coefficient_contrast(spark, d):
    rows = stored(_feat(spark, d))
    fits = {t: models.fit_many(stored(models.prepare(rows, t, "n_frames", _CELL_FULL, "category_id")), _CELL_FULL) for t in ("pDetA", "pAssA")}
    return models.contrast(spark, fits).select("term", *_r("pDetA", "pAssA"))


@query(f"""{_CELLS}, num AS (SELECT pAssA AS x, pDetA AS y, row_number() OVER (ORDER BY concat_ws('|', {_CELL})) - 1 AS g FROM cells WHERE pAssA IS NOT NULL AND pDetA IS NOT NULL), {_drawn_sql('num', 100)},
boot AS (SELECT (sum(m) * sum(m * x * y) - sum(m * x) * sum(m * y)) / (sum(m) * sum(m * x * x) - sum(m * x) ** 2) AS slope, sum(m * x) / sum(m) AS mx, sum(m * y) / sum(m) AS my FROM drawn JOIN num USING (g) GROUP BY b),
fit AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS cut FROM num), grid AS (SELECT a + (z - a) * k / 49 AS x FROM (SELECT min(x) AS a, max(x) AS z FROM num), range(50) r(k))
SELECT round(grid.x, 6) AS x, round(any_value(fit.cut + fit.slope * grid.x), 6) AS fit, round(quantile_cont(my + boot.slope * (grid.x - mx), 0.05), 6) AS lo, round(quantile_cont(my + boot.slope * (grid.x - mx), 0.95), 6) AS hi
FROM grid, boot, fit GROUP BY grid.x""")
def calibration_band(spark, d):
    rows = _feat(spark, d).withColumn("key", F.concat_ws("|", *CELL))
    return association.calibration_band(rows, "key", "pAssA", "pDetA", draws=100).select(*_r("x", "fit", "lo", "hi"))


@query()
def calibration_band_records(spark, d):
    """The band over draws of all scored probes, of which no (draw, row) pair is made."""
    return association.calibration_band(mapping.probes(spark, d), None, "pAssA", "pDetA", draws=100).select(*_r("x", "fit", "lo", "hi"))


@query()
def reliability_scores(spark, d):
    rows = stored(_feat(spark, d))
    found = models.score_reliability(rows.filter("time = '2001'"), rows.filter("time <> '2001'"), "pDetA", "n_frames", _CELL_FULL, "category_id", 50, CELL)
    return found.select(*CELL, *_r("predicted", "lo", "hi"))


# Studies


_DESIGNS = [models.Design("year", ("year",), support=True), models.Design("frames", ("frames",), support=True)]


#: Designs of one 0/1 predictor: their models have one mean a class, which SQL can tell.
_LATE, _LARGE = models.Design("late", binary=("late",)), models.Design("large", binary=("large",))
_CLASSES = f"{_FEATURES}, cls AS (SELECT *, CAST(time >= '1995' AS INT) AS late, CAST(n_videos >= 3 AS INT) AS large FROM feat)"


def _classes(spark, d) -> DataFrame:
    return _feat(spark, d).withColumns({"late": (F.col("time") >= "1995").cast("int"), "large": (F.col("n_videos") >= 3).cast("int")})


def _summary_sql(parts: list[tuple[str, str, str]], draws: int) -> str:
    """CTEs c0.. and ``summary`` of the validation of one 0/1 predictor on both schemes.

    A part is its name, the predictor, and rows with the columns of ``cls``; the summary has the names as ``name`` and ``design``.
    """
    ctes, found = [], []
    for k, (name, x, rows) in enumerate(parts):
        for scheme, column in studies.SCHEMES.items():
            t = f"{k}{scheme[0]}"
            ctes.append(f"""r{t} AS (SELECT {column} AS grp, {x} AS x, least(greatest(pDetA, 0), 1) AS y, n_frames AS w FROM {rows} WHERE pDetA IS NOT NULL),
s{t} AS (SELECT grp, x, sum(w * y) AS wy, sum(w) AS w FROM r{t} GROUP BY 1, 2), a{t} AS (SELECT x, sum(wy) AS wy, sum(w) AS w FROM s{t} GROUP BY 1),
e{t} AS (SELECT grp, abs(y - (a.wy - s.wy) / (a.w - s.w)) AS e, abs(y - (SELECT avg(y) FROM r{t})) AS e0 FROM r{t} JOIN s{t} s USING (grp, x) JOIN a{t} a USING (x)),
num{t} AS (SELECT sum(e0 - e) AS s, count(*) AS c, row_number() OVER (ORDER BY grp) - 1 AS g FROM e{t} GROUP BY grp), {_drawn_sql(f'num{t}', draws, t)},
boot{t} AS (SELECT b, sum(m * s) / sum(m * c) AS d FROM drawn{t} JOIN num{t} USING (g) GROUP BY 1),
c{t} AS (SELECT '{name}' AS name, '{x}' AS design, '{scheme}' AS group_scheme, 'pDetA' AS target, (SELECT count(*) FROM e{t}) AS n, (SELECT avg(e) FROM e{t}) AS mae, (SELECT avg(e0) FROM e{t}) AS baseline_mae,
  (SELECT avg(e0 - e) FROM e{t}) AS delta, quantile_cont(d, 0.025) AS delta_lo, quantile_cont(d, 0.975) AS delta_hi, avg(CAST(d <= 0 AS DOUBLE)) AS p_value FROM boot{t})""")
            found.append(f"SELECT * FROM c{t}")
    return ", ".join(ctes) + f", summary AS ({' UNION ALL '.join(found)})"


@query(f"""{_CLASSES}, {_summary_sql([('late', 'late', 'cls'), ('large', 'large', 'cls')], DRAWS)}
SELECT design, bool_and(delta > 0) AS both_positive, bool_and(p_value < 0.05 / 2) AS both_significant FROM summary GROUP BY 1""")
def designs_verdict(spark, d):
    return studies.verdicts(studies.run_designs(_classes(spark, d), [_LATE, _LARGE], ["pDetA"], "n_frames", DRAWS), 2)


@query(f"{_CLASSES}, {_summary_sql([('late', 'late', 'cls')], DRAWS)} SELECT group_scheme, target, n, round(mae, 6) AS mae, round(delta, 6) AS delta FROM summary")
def cv_sorted(spark, d):
    found = studies.sorted_summary(studies.run_designs(_classes(spark, d), [_LATE], ["pDetA"], "n_frames", DRAWS))
    return found.select("group_scheme", "target", "n", *_r("mae", "delta"))


@query()
def design_verdicts_scaled(spark, d):
    """The verdicts of designs with continuous predictors."""
    return studies.verdicts(studies.run_designs(_feat(spark, d), _DESIGNS, ["pDetA"], "n_frames", DRAWS), len(_DESIGNS))


@query()
def confidence_study(spark, d):
    rows = _feat(spark, d).withColumns({"conf_share": F.col("pAssA"), "conf_mean": F.col("pHOTA"), "log_area": F.log1p("frames")})
    found = studies.confidence_experiment(rows, ["conf_share", "conf_mean"], "log_area", "pDetA", "n_frames", 50)
    return found.select("design", "group_scheme", "n", *_r("mae", "delta", "p_value"), "both_positive", "both_significant", "is_primary")


@query()
def difficulty_study(spark, d):
    rows = _classes(spark, d).withColumns({"clutter": F.col("num_masklets") / F.col("n_videos"), "log_area": F.log1p("frames")})
    _, parts = studies.difficulty_experiment(rows, ["clutter"], ["late"], "log_area", "pDetA", "n_frames", 50)
    return parts.select("design", "group_scheme", "n", *_r("mae", "delta", "p_value"), "size_carries")


@query()
def familiarity_study(spark, d):
    rows = _feat(spark, d).withColumns({"familiar": F.col("pAssA"), "log_area": F.log1p("frames")})
    _, gains = studies.familiarity_experiment(rows, ["familiar"], "year", "log_area", "pDetA", "n_frames", 50)
    return gains.select("design", *_r("gain_species", "gain_location"), "adds", *_r("r_base", "r_size"))


@query(f"""{_CELLS}, m AS (SELECT category_id, avg(pAssA) AS other FROM cells GROUP BY 1) SELECT {_CELL}, round(other + 1e-9, 6) AS pDetA FROM cells LEFT JOIN (SELECT * FROM m WHERE category_id < 'Brand#4') USING (category_id)""")
def replaced_feature(spark, d):
    rows = mapping.cells(spark, d)
    other = rows.filter("category_id < 'Brand#4'").groupBy("category_id").agg(F.avg("pAssA").alias("pDetA"))
    return studies.replace_feature(rows, other, ["category_id"]).select(*CELL, *_up("pDetA"))


@query()
def ablation(spark, d):
    found = studies.ablation(_feat(spark, d), "pDetA", ["year"], "frames", "n_frames", 50)
    return found.select("design", "group_scheme", *_r("delta", "p_value", "pseudo_r2"))


@query(f"""{_CLASSES}, {_summary_sql([('early', 'large', "(SELECT * FROM cls WHERE time < '1998')"), ('late', 'large', "(SELECT * FROM cls WHERE time >= '1998')")], 50)}
SELECT name AS variant, group_scheme, n, round(mae, 6) AS mae, round(delta, 6) AS delta, round(p_value, 6) AS p_value FROM summary""")
def robustness_variants(spark, d):
    rows = _classes(spark, d)
    wanted = spark.createDataFrame([("early",), ("late",), ("absent",)], "variant string")
    found = studies.robustness({"early": rows.filter("time < '1998'"), "late": rows.filter("time >= '1998'")}, wanted, _LARGE, ["pDetA"], "n_frames", 50)
    return found[0].select("variant", "group_scheme", "n", *_r("mae", "delta", "p_value"))


@query(f"""{_CLASSES}, found AS (SELECT 'early' AS variant FROM cls WHERE time < '1998' AND pDetA IS NOT NULL UNION SELECT 'late' FROM cls WHERE time >= '1998' AND pDetA IS NOT NULL)
SELECT variant FROM (VALUES ('early'), ('late'), ('absent')) v(variant) WHERE variant NOT IN (SELECT variant FROM found)""")
def robustness_missing(spark, d):
    """The variants that were asked for and have no table."""
    rows = _classes(spark, d)
    wanted = spark.createDataFrame([("early",), ("late",), ("absent",)], "variant string")
    return studies.robustness({"early": rows.filter("time < '1998'"), "late": rows.filter("time >= '1998'")}, wanted, _LARGE, ["pDetA"], "n_frames", 10)[2]


@query()
def difficulty_verdicts(spark, d):
    """The validation of the single signals and of all together, with their verdicts."""
    rows = _classes(spark, d).withColumns({"clutter": F.col("num_masklets") / F.col("n_videos"), "log_area": F.log1p("frames")})
    found, _ = studies.difficulty_experiment(rows, ["clutter"], ["late"], "log_area", "pDetA", "n_frames", 50)
    return found.select("design", "group_scheme", "n", *_r("mae", "delta", "p_value"), "both_positive", "both_significant")


@query()
def familiarity_verdicts(spark, d):
    """The validation of the familiarity metrics, with their verdicts."""
    rows = _feat(spark, d).withColumns({"familiar": F.col("pAssA"), "log_area": F.log1p("frames")})
    found, _ = studies.familiarity_experiment(rows, ["familiar"], "year", "log_area", "pDetA", "n_frames", 50)
    return found.select("design", "group_scheme", "n", *_r("mae", "delta", "p_value"), "both_positive", "both_significant")


@query(f"""{_CLASSES}, swapped AS (SELECT * REPLACE (pAssA AS pDetA) FROM cls), {_summary_sql([('swap', 'late', 'swapped')], 50)}
SELECT design, group_scheme, target, n, round(mae, 6) AS mae, round(delta, 6) AS delta, round(p_value, 6) AS p_value FROM summary""")
def model_swap(spark, d):
    rows = _classes(spark, d)
    other = rows.select(*CELL, F.col("pAssA").alias("pDetA"))
    found = studies.model_swap(rows, other, [_LATE], ["pDetA"], "n_frames", 50)
    return found.select("design", "group_scheme", "target", "n", *_r("mae", "delta", "p_value"))


@query(f"""{_CLASSES}, {_summary_sql([('all', 'late', 'cls'), ('full_taxonomy', 'late', "(SELECT * FROM cls WHERE category_id IN (SELECT category_id FROM cls WHERE species < 'Brand#5'))"),
  ('species_mean', 'late', '(SELECT * REPLACE (avg(frames) OVER (PARTITION BY species) AS frames) FROM cls)')], 50)}
SELECT name AS subset, design, group_scheme, n, round(mae, 6) AS mae, round(delta, 6) AS delta, round(p_value, 6) AS p_value FROM summary""")
def replication(spark, d):
    rows = _classes(spark, d)
    found = studies.replication(rows, [_LATE], "pDetA", "n_frames", rows.filter("species < 'Brand#5'"), "frames", 50)
    return found.select("subset", "design", "group_scheme", "n", *_r("mae", "delta", "p_value"))


@query(f"""{_CLASSES}, {_summary_sql([('late', 'late', 'cls')], 50)}
SELECT 'validation' AS section, design || '/' || group_scheme || '/' || target AS metric, round(delta, 6) AS value, round(delta_lo, 6) AS lo, round(delta_hi, 6) AS hi, round(p_value, 6) AS p, n FROM summary
UNION ALL SELECT 'coverage', 'pDetA', count(pDetA), NULL, NULL, NULL, count(*) FROM cls UNION ALL SELECT 'coverage', 'year', count(year), NULL, NULL, NULL, count(*) FROM cls""")
def results_roll_up(spark, d):
    rows = _classes(spark, d)
    found = studies.roll_up(studies.run_designs(rows, [_LATE], ["pDetA"], "n_frames", 50), rows, ["pDetA", "year"])
    return found.select("section", "metric", *_r("value", "lo", "hi", "p"), "n")


# Tracks


@query("""WITH det AS (SELECT l_orderkey AS video_id, l_suppkey AS track_id, l_linenumber AS f, l_discount * 10 AS s FROM lineitem WHERE l_linenumber <= 7),
t AS (SELECT video_id, track_id, max(s) AS raw, list_sort(list_distinct(list(f))) AS fs FROM det GROUP BY 1, 2)
SELECT video_id, track_id, round(least(raw * 1.5, 1.0), 6) AS score, len(fs) AS n_present, 8 AS n_frames FROM t WHERE raw >= 0.2""")
def track_assembly(spark, d):
    rows = mapping.detections(spark, d).filter("frame_idx <= 7").withColumn("rle", F.col("det_id"))
    found = tracks.assemble(rows, 8, 0.2, 1.5)
    return found.select("video_id", "track_id", *_r("score"), F.size(S.present_frames(F.col("segmentations"))).alias("n_present"), F.size("segmentations").alias("n_frames"))


def _boxes(spark, d) -> DataFrame:
    rows = mapping.detections(spark, d)
    x, y = (F.col("track_id") % 7).cast("double"), (F.col("track_id") % 5).cast("double")
    return rows.withColumn("box", F.array(x, y, x + 3, y + 3)).withColumn("embed", F.array(x + 1, y + 1, F.lit(1.0)))


_SHARED = "greatest(3 - abs(k.x - r[1].x), 0) * greatest(3 - abs(k.y - r[1].y), 0)"


@query(f"""WITH det AS (SELECT l_orderkey AS video_id, l_linenumber AS frame_idx, concat_ws(':', l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS det_id,
  l_discount * 10 AS score, CAST(l_suppkey % 7 AS DOUBLE) AS x, CAST(l_suppkey % 5 AS DOUBLE) AS y FROM lineitem),
f AS (SELECT video_id, frame_idx, list({{'det_id': det_id, 'score': score, 'x': x, 'y': y}} ORDER BY score DESC, det_id) AS ds FROM det GROUP BY 1, 2),
kept AS (SELECT video_id, frame_idx, list_reduce(list_transform(ds, lambda q: [q]),
  lambda acc, r: CASE WHEN len(list_filter(acc, lambda k: {_SHARED} / greatest(18 - {_SHARED}, 1e-12) > 0.5)) > 0 THEN acc ELSE acc || r END) AS ks FROM f)
SELECT video_id, frame_idx, k.det_id AS det_id, round(k.score, 6) AS score FROM (SELECT video_id, frame_idx, unnest(ks) AS k FROM kept)""")
def frame_suppression(spark, d):
    return tracks.suppress(_boxes(spark, d).select("video_id", "frame_idx", "det_id", "score", "box"), 0.5).select("video_id", "frame_idx", "det_id", *_r("score"))


@query()
def track_linking(spark, d):
    return tracks.link(_boxes(spark, d).select("video_id", "frame_idx", "det_id", "embed"), 0.9).select("video_id", "frame_idx", "det_id", "track_id")
