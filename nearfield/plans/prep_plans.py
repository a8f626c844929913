"""Registered queries of feature preparation and text parsing over the order tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import prep
from ..operators.points import points, read
from .register import registry

QUERIES, ORACLES, query = registry()

#: Feature columns of the line items, and how DuckDB names them.
COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
BASE = "b AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3, l_returnflag AS label FROM lineitem)"


def features(spark, sf_dir: str) -> DataFrame:
    """id, four features and a label of each line item."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(*[F.col(c).cast("double") for c in COLS]).alias("features"), F.col("l_returnflag").alias("label"))


def spread(df: DataFrame, n: int = 4) -> DataFrame:
    """id and one column for each feature."""
    return df.select("id", *[F.get("features", F.lit(k)).alias(f"f{k}") for k in range(n)])


def _each(expr: str) -> str:
    return ", ".join(f"round({expr.format(f=f'f{k}')}, 6) + 0.0 AS f{k}" for k in range(4))


@query("zscore_features", f"WITH {BASE} SELECT id, " + _each("({f} - avg({f}) OVER ()) / greatest(stddev_pop({f}) OVER (), 1e-8)") + " FROM b")
def zscore_features(spark, sf_dir):
    """Features in deviations from their mean."""
    return spread(prep.z_score(features(spark, sf_dir), "features"))


@query("minmax_features", f"WITH {BASE} SELECT id, " + _each("({f} - min({f}) OVER ()) / CASE WHEN max({f}) OVER () > min({f}) OVER () THEN max({f}) OVER () - min({f}) OVER () ELSE 1 END") + " FROM b")
def minmax_features(spark, sf_dir):
    """Features in [0, 1]."""
    return spread(prep.min_max(features(spark, sf_dir), "features"))


@query("global_minmax", f"WITH {BASE}, m AS (SELECT min(least(f0, f1, f2, f3)) AS lo, max(greatest(f0, f1, f2, f3)) AS hi FROM b) SELECT id, " + _each("({f} - lo) / (hi - lo)") + " FROM b, m")
def global_minmax(spark, sf_dir):
    """Features by one common range."""
    return spread(prep.global_min_max(features(spark, sf_dir), "features"))


@query("centre_by_max", f"WITH {BASE}, c AS (SELECT id, " + ", ".join(f"f{k} - avg(f{k}) OVER () AS f{k}" for k in range(4)) + " FROM b), m AS (SELECT max(greatest(abs(f0), abs(f1), abs(f2), abs(f3))) AS m FROM c) SELECT id, " + _each("{f} / m") + " FROM c, m")
def centre_by_max(spark, sf_dir):
    """Centred features by the greatest absolute value."""
    return spread(prep.centre_by_max(features(spark, sf_dir), "features"))


@query("log1p_clip", f"WITH {BASE} SELECT id, " + _each("ln(1 + greatest({f} - 20, 0))") + " FROM b")
def log1p_clip(spark, sf_dir):
    """Logs of counts over 20, negative ones cut to 0."""
    df = features(spark, sf_dir)
    return spread(prep.log_counts(df.withColumn("features", F.transform("features", lambda x: x - 20)), "features"))


@query("sanitize_center", f"WITH {BASE}, z AS (SELECT id, CASE WHEN f0 > 45 THEN 1e6 WHEN f0 < 5 THEN 0 ELSE f0 END AS f0, f1, f2, f3 FROM b) SELECT id, " + _each("{f} - avg({f}) OVER ()").replace(", 6)", ", 4)") + " FROM z")
def sanitize_center(spark, sf_dir):
    """Holes and infinities replaced, then centred; quantities over 45 stand for infinity, under 5 for NaN."""
    q = F.get("features", F.lit(0))
    holed = F.when(q > 45, F.lit(float("inf"))).when(q < 5, F.lit(float("nan"))).otherwise(q)
    df = features(spark, sf_dir).withColumn("features", F.concat(F.array(holed), F.slice("features", 2, 3)))
    out = spread(prep.sanitise(df, "features"))
    return out.select("id", *[F.round(f"f{k}", 4).alias(f"f{k}") for k in range(4)])  # differences from a mean end in 5


@query("finite_filter", f"WITH {BASE} SELECT id FROM b WHERE f0 BETWEEN 5 AND 45")
def finite_filter(spark, sf_dir):
    """Rows that are finite in all features."""
    q = F.get("features", F.lit(0))
    holed = F.when(q > 45, F.lit(float("inf"))).when(q < 5, F.lit(float("nan"))).otherwise(q)
    return prep.finite_rows(features(spark, sf_dir).withColumn("features", F.array(holed)), "features").select("id")


@query("top_variance_features", f"WITH {BASE}, v AS (SELECT 0 AS pos, var_pop(f0) AS v FROM b UNION ALL SELECT 1, var_pop(f1) FROM b UNION ALL SELECT 2, var_pop(f2) FROM b UNION ALL SELECT 3, var_pop(f3) FROM b) SELECT pos::INTEGER AS pos FROM v ORDER BY v DESC, pos LIMIT 2")
def top_variance_features(spark, sf_dir):
    """The two features of greatest variance."""
    return prep.top_variance(features(spark, sf_dir), "features", 2)


@query("max_feature_filter", f"WITH {BASE} SELECT id, f0, f1 FROM b WHERE (SELECT max(f0) > 4 AND max(f1) > 4 AND max(f2) <= 4 AND max(f3) <= 4 FROM b)")
def max_feature_filter(spark, sf_dir):
    """Features whose greatest value is over 4."""
    df = features(spark, sf_dir)
    return spread(prep.keep_features(df, "features", prep.features_above(df, "features", 4)), 2)


@query("rare_class_filter", "SELECT o_orderkey AS id, o_orderpriority AS label FROM orders QUALIFY count(*) OVER (PARTITION BY o_orderpriority) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))")
def rare_class_filter(spark, sf_dir):
    """Rows of classes of at least mean size."""
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    least = df.groupBy("label").count().agg(F.avg("count").alias("a")).first()["a"] or 0
    return prep.drop_rare(df, "label", least)


@query("exclude_sentinel", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def exclude_sentinel(spark, sf_dir):
    """Rows that are not of the marker class."""
    return read(spark, sf_dir, "events").where(F.col("event_type") != "error").select("event_id", "event_type")


@query("label_encode", "SELECT o_orderkey AS id, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code FROM orders")
def label_encode(spark, sf_dir):
    """Labels by their place in order."""
    return prep.label_codes(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label")), "label").select("id", "code")


@query("pad_even", f"WITH {BASE} SELECT id, f0, f1, f2, 0.0::DOUBLE AS f3 FROM b")
def pad_even(spark, sf_dir):
    """Three features and one zero."""
    return spread(prep.pad_even(features(spark, sf_dir).withColumn("features", F.slice("features", 1, 3)), "features"))


@query("label_default_join", "SELECT d.doc_id, coalesce(l.quality, 0) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_default_join(spark, sf_dir):
    """A label for each row, 0 where there is none."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("label"))


@query("align_dedupe_left", "WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) SELECT c_custkey, o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM customer LEFT JOIN f ON c_custkey = o_custkey")
def align_dedupe_left(spark, sf_dir):
    """Each customer with the first of their orders."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return prep.align(read(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey")


@query("time_bin_parse", "WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice < 100000 THEN '<100' WHEN o_totalprice > 400000 THEN '>400' WHEN o_totalprice < 200000 THEN '100-200' ELSE floor(o_totalprice / 1000)::BIGINT::VARCHAR END AS bin FROM orders) SELECT id, bin, CASE WHEN bin LIKE '%-%' THEN split_part(bin, '-', -1)::DOUBLE WHEN bin LIKE '<%' THEN replace(bin, '<', '')::DOUBLE - 50 WHEN bin LIKE '>%' THEN replace(bin, '>', '')::DOUBLE + 100 ELSE bin::DOUBLE END AS time FROM t")
def time_bin_parse(spark, sf_dir):
    """Numbers of binned times."""
    p = F.col("o_totalprice")
    text = F.when(p < 100000, "<100").when(p > 400000, ">400").when(p < 200000, "100-200").otherwise(F.floor(p / 1000).cast("long").cast("string"))
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("bin"))
    return df.withColumn("time", parse.time_bin(F.col("bin")))


@query("branch_split", "SELECT c_custkey AS id, r_name || '->' || n_name AS branch, trim(split_part(r_name || '->' || n_name, '->', 1)) AS src, trim(split_part(r_name || '->' || n_name, '->', 2)) AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def branch_split(spark, sf_dir):
    """Branch text from its ends, and its ends from the text."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.select(F.col("c_custkey").alias("id"), parse.branch(F.col("r_name"), F.col("n_name")).alias("branch"))
    a, b = parse.branch_ends(F.col("branch"))
    return df.select("id", "branch", a.alias("src"), b.alias("dst"))


@query("run_name_parse", "WITH r AS (SELECT s_suppkey AS id, 'runtime_latent_part' || s_nationkey || '_n' || s_suppkey || '_seed' || (s_suppkey % 5) AS run FROM supplier) SELECT id, run, 'latent' AS method, regexp_extract(run, '^runtime_([^_]+)_(.+?)_n', 2) AS data, regexp_extract(run, '_seed(\\d+)', 1) AS seed, substr(sha256(run || ':7'), 1, 16) AS digest FROM r")
def run_name_parse(spark, sf_dir):
    """Method, data and seed of a run's name, and its short digest."""
    run = F.concat(F.lit("runtime_latent_part"), F.col("s_nationkey"), F.lit("_n"), F.col("s_suppkey"), F.lit("_seed"), F.col("s_suppkey") % 5)
    df = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), run.alias("run"))
    return df.select("id", "run", *[c.alias(n) for n, c in parse.run_name(F.col("run")).items()], parse.short_digest(F.col("run"), F.lit(7)).alias("digest"))


@query("numeric_coercion", "SELECT event_id, coalesce(try_cast(CASE WHEN event_type = 'error' THEN 'bad' ELSE (event_id % 97)::VARCHAR END AS DOUBLE), -1) AS number FROM events")
def numeric_coercion(spark, sf_dir):
    """Numbers of texts; those that are none, NaN in the operator, are shown as -1."""
    text = F.when(F.col("event_type") == "error", "bad").otherwise((F.col("event_id") % 97).cast("string"))
    x = parse.to_number(text)
    return read(spark, sf_dir, "events").select("event_id", F.when(F.isnan(x), F.lit(-1.0)).otherwise(x).alias("number"))


@query("elapsed_clock", "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) AS elapsed FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events WHERE value >= 0)")
def elapsed_clock(spark, sf_dir):
    """Hours, minutes and seconds of a duration."""
    return read(spark, sf_dir, "events").where("value >= 0").select("event_id", parse.clock(F.col("value") * 60).alias("elapsed"))


@query("standardise_global", "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT avg(x) AS mx, avg(y) AS my, sqrt(greatest((var_pop(x) + var_pop(y)) / 2, 1e-12)) AS rms FROM p) SELECT id, round((x - mx) / rms, 6) + 0.0 AS f0, round((y - my) / rms, 6) + 0.0 AS f1 FROM p, s")
def standardise_global(spark, sf_dir):
    """The picture by one scale, its axis ratio kept."""
    df = points(spark, sf_dir).select("id", F.col("ld").alias("features"))
    return spread(prep.standardise(df, "features", "global"), 2)


@query("standardise_floored", "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT id, round((x - avg(x) OVER ()) / greatest(stddev_samp(x) OVER (), 1e-6), 6) + 0.0 AS f0, round((y - avg(y) OVER ()) / greatest(stddev_samp(y) OVER (), 1e-6), 6) + 0.0 AS f1 FROM p")
def standardise_floored(spark, sf_dir):
    """The picture axis by axis, deviations floored."""
    df = points(spark, sf_dir).select("id", F.col("ld").alias("features"))
    return spread(prep.standardise(df, "features", "floored"), 2)


@query("positional_zip", "WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey FROM customer), b AS (SELECT row_number() OVER (ORDER BY c_name) - 1 AS pos, c_name FROM customer) SELECT a.pos, c_custkey, c_name FROM a JOIN b ON a.pos = b.pos")
def positional_zip(spark, sf_dir):
    """Two tables side by side, row by row."""
    from ..operators.sampling import with_position

    c = read(spark, sf_dir, "customer")
    keys = with_position(c, "c_custkey").select("pos", F.col("id").alias("c_custkey"))
    names = with_position(c.withColumn("k", F.regexp_extract("c_name", r"(\d+)$", 1).cast("long")), "k").select("pos", F.col("id").alias("k"))
    named = names.join(c.select(F.regexp_extract("c_name", r"(\d+)$", 1).cast("long").alias("k"), "c_name"), "k").select("pos", "c_name")
    return prep.zip_rows(keys, named)
