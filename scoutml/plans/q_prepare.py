"""Registered queries: sources, profiling, preparation, folds, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutml.functions import scalar as S
from scoutml.operators import folds, prepare, profile
from scoutml.plans.fixtures import customer_xy, events_with_nulls, table
from scoutml.sources import csv as csv_src

R6 = 6


def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """S1+S2: write customer as CSV to the shared work folder, scan it back."""
    cust = table(spark, sf, "customer")
    path = csv_src.write_csv(cust, "customer_csv")
    back = csv_src.scan_csv(spark, path, infer_schema=True)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in cust.schema.fields])


def preview_head(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the first ten rows by key."""
    return csv_src.preview(table(spark, sf, "customer"), "c_custkey", 10)


def profile_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_profile(events_with_nulls(spark, sf))


def profile_shape(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shape(table(spark, sf, "lineitem"))


_TARGETS = [
    ("customer", "c_mktsegment"), ("customer", "c_nationkey"), ("part", "p_size"), ("part", "p_type"),
    ("lineitem", "l_returnflag"), ("lineitem", "l_quantity"), ("orders", "o_orderpriority"),
    ("events", "event_type"), ("labels", "quality"), ("embeddings", "label"), ("supplier", "s_nationkey"),
]


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t, c in _TARGETS:
        part = profile.target_cardinality(table(spark, sf, t), c).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def profile_target_card(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct non-null count of candidate targets, < 15 -> classification."""
    return _cards(spark, sf).select("table_name", "target", "n_distinct")


def detect_task(spark: SparkSession, sf: str) -> DataFrame:
    """Task per candidate target (string -> classification)."""
    return _cards(spark, sf)


def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    """T2 over three string columns of part, one of them near-unique."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return prepare.label_encode(p, ["p_name", "p_brand", "p_type"]).select(
        "p_partkey", F.col("p_name").alias("p_name_code"), F.col("p_brand").alias("p_brand_code"),
        F.col("p_type").alias("p_type_code"),
    )


def label_encode_target(spark: SparkSession, sf: str) -> DataFrame:
    """String target -> 0..K-1."""
    return prepare.label_encode(customer_xy(spark, sf), ["target"]).select("row_id", "target")


def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    """T4: exact median fill of the nulls made in events.value."""
    ev = events_with_nulls(spark, sf).select("event_id", "value", "user_id")
    out = prepare.impute_median(ev, ["value", "user_id"])
    return out.select("event_id", F.round("value", R6).alias("value"), F.round("user_id", R6).alias("user_id"))


def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    """T5: z-scores with the population deviation."""
    c = customer_xy(spark, sf)
    z = prepare.standard_scale(c, ["acctbal", "nationkey"])
    return z.select("row_id", F.round("acctbal", R6).alias("z_acctbal"), F.round("nationkey", R6).alias("z_nationkey"))


_PART_X = ["p_size", "p_retailprice", "p_partkey"]


def interaction_features(spark: SparkSession, sf: str) -> DataFrame:
    """x_i then x_i*x_j (i<j) for three part columns."""
    p = table(spark, sf, "part").select(*[F.col(c).cast("double") for c in _PART_X], F.col("p_partkey").alias("key"))
    out = prepare.add_interactions(p, _PART_X)
    names = [n for n, _ in prepare.interaction_names(_PART_X)]
    return out.select("key", *[F.round(F.col(f"`{n}`"), R6).alias(n.replace("*", "_x_")) for n in names])


_LI_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def select_anova(spark: SparkSession, sf: str) -> DataFrame:
    """T7+T9: ANOVA F of the interaction set against the return flag; top k kept."""
    li = table(spark, sf, "lineitem").select(*_LI_X, "l_returnflag")
    ex = prepare.add_interactions(li, _LI_X)
    feats = [n for n, _ in prepare.interaction_names(_LI_X)]
    sc = prepare.anova_f_scores(ex, feats, "l_returnflag")
    return sc.select("position", F.regexp_replace("feature", "\\*", "_x_").alias("feature"),
                     F.round("f_score", 4).alias("f_score"), "rank", "selected")


_LR_X = ["l_quantity", "l_discount", "l_tax"]


def select_fregression(spark: SparkSession, sf: str) -> DataFrame:
    """T8+T9: F-regression of the interaction set against the extended price."""
    li = table(spark, sf, "lineitem").select(*_LR_X, "l_extendedprice")
    ex = prepare.add_interactions(li, _LR_X)
    feats = [n for n, _ in prepare.interaction_names(_LR_X)]
    sc = prepare.f_regression_scores(ex, feats, "l_extendedprice")
    return sc.select("position", F.regexp_replace("feature", "\\*", "_x_").alias("feature"),
                     F.round("f_score", 4).alias("f_score"), "rank", "selected")


def pca_2d(spark: SparkSession, sf: str) -> DataFrame:
    """PCA coordinates of the z-scored customer slice."""
    c = prepare.standard_scale(customer_xy(spark, sf), ["acctbal", "nationkey"])
    coords, _ = prepare.pca_project(c, ["acctbal", "nationkey"], 2, keep=["row_id"])
    return coords.select("row_id", F.round("pc1", R6).alias("pc1"), F.round("pc2", R6).alias("pc2"))


def pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    """T11 + A13: explained-variance ratios and the caption figures."""
    c = prepare.standard_scale(customer_xy(spark, sf), ["acctbal", "nationkey"])
    ratios = prepare.pca_variance(c, ["acctbal", "nationkey"])
    rows = [(i + 1, float(r)) for i, r in enumerate(ratios)]
    df = spark.createDataFrame(rows, "component int, ratio double")
    return df.withColumn("total_pct", F.round(F.sum("ratio").over(Window.partitionBy()) * 100, 1))


def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Five contiguous folds in key order."""
    return folds.kfold(customer_xy(spark, sf).select("row_id"), "row_id", 5)


def stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    """Five stratified, unshuffled folds."""
    return folds.stratified_kfold(customer_xy(spark, sf).select("row_id", "target"), "row_id", "target", 5).select(
        "row_id", "fold"
    )


def scalar_strings(spark: SparkSession, sf: str) -> DataFrame:
    """lower/strip, contains, replace, split on the conversation texts."""
    cv = table(spark, sf, "conversations")
    return cv.select(
        "conv_id", "turn",
        S.normalize("text").alias("norm"),
        F.lower("text").contains("de").alias("has_de"),
        F.length(F.replace("text", F.lit("\n"), F.lit(" "))).alias("len_replaced"),
        F.size(S.split_trimmed("text", ",")).alias("n_parts"),
    )


def scalar_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """60 characters then '...'."""
    return table(spark, sf, "conversations").select("conv_id", "turn", S.truncate_text("text", 60).alias("short"))


def scalar_math(spark: SparkSession, sf: str) -> DataFrame:
    """round, int cast, greatest/least, the k rule on a width column."""
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.round("o_totalprice", 1).alias("r1"),
        F.col("o_totalprice").cast("int").alias("as_int"),
        F.greatest("o_totalprice", F.lit(100000.0)).alias("g"),
        F.least("o_totalprice", F.lit(100000.0)).alias("l"),
        S.k_rule(F.length("o_orderpriority")).alias("k"),
    )


def scalar_format(spark: SparkSession, sf: str) -> DataFrame:
    """'%.4f' with 'N/A' for missing, padded to 25."""
    ev = events_with_nulls(spark, sf)
    return ev.select("event_id", S.fmt_fixed("value").alias("v4"), S.pad_right("event_type", 25).alias("padded"))


def scalar_latin1(spark: SparkSession, sf: str) -> DataFrame:
    """characters outside Latin-1 -> '?' over whole documents."""
    return table(spark, sf, "documents").select("doc_id", S.latin1_safe("text").alias("safe"))


def scalar_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """'yyyy-MM-dd HH:mm:ss'."""
    return table(spark, sf, "events").select("event_id", S.fmt_timestamp("ts").alias("ts_text"))


def scalar_json(spark: SparkSession, sf: str) -> DataFrame:
    """F8: tolerant JSON decode of events.props (bad text -> default -1)."""
    ev = table(spark, sf, "events")
    parsed = S.json_or_default("props", "k int", F.struct(F.lit(-1).alias("k")))
    return ev.select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


QUERIES = {
    "scan_csv": scan_csv, "preview_head": preview_head, "profile_nulls": profile_nulls,
    "profile_shape": profile_shape, "profile_target_card": profile_target_card, "detect_task": detect_task,
    "label_encode": label_encode, "label_encode_target": label_encode_target, "impute_median": impute_median,
    "standard_scale": standard_scale, "interaction_features": interaction_features, "select_anova": select_anova,
    "select_fregression": select_fregression, "pca_2d": pca_2d, "pca_variance": pca_variance,
    "kfold_assign": kfold_assign, "stratified_kfold": stratified_kfold, "scalar_strings": scalar_strings,
    "scalar_truncate": scalar_truncate, "scalar_math": scalar_math, "scalar_format": scalar_format,
    "scalar_latin1": scalar_latin1, "scalar_timestamp": scalar_timestamp, "scalar_json": scalar_json,
}


def _ev_nulls() -> str:
    return "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, props FROM events)"


def _interactions_sql(cols: list[str]) -> list[tuple[str, str]]:
    out = [(c, c) for c in cols]
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            out.append((f"{cols[i]}_x_{cols[j]}", f"{cols[i]}*{cols[j]}"))
    return out


def _anova_sql() -> str:
    feats = _interactions_sql(_LI_X)
    k = max(1, min(int(0.3 * len(feats)), len(feats)))
    sel = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in feats)
    per = " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS feature, l_returnflag AS y, {n} AS x FROM ex" for i, (n, _) in enumerate(feats)
    )
    return f"""
WITH ex AS (SELECT l_returnflag, {sel} FROM lineitem),
long AS ({per}),
cls AS (SELECT position, feature, y, count(*) AS nk, avg(x) AS mk, var_pop(x) AS vk FROM long GROUP BY 1,2,3),
tot AS (SELECT position, sum(nk) AS n, count(*) AS K, sum(nk*mk)/sum(nk) AS m FROM cls GROUP BY 1),
f AS (SELECT c.position, c.feature, sum(c.nk*(c.mk-t.m)*(c.mk-t.m)) AS ssb, sum(c.nk*c.vk) AS ssw,
             any_value(t.n) AS n, any_value(t.K) AS K
      FROM cls c JOIN tot t USING (position) GROUP BY 1,2),
s AS (SELECT position, feature,
             CASE WHEN ssw = 0 THEN (CASE WHEN ssb > 0 THEN CAST('inf' AS DOUBLE) END)
                  ELSE (ssb/(K-1))/(ssw/(n-K)) END AS f FROM f)
SELECT position, feature, round(f, 4) AS f_score,
       CAST(row_number() OVER (ORDER BY f DESC NULLS LAST, position) - 1 AS INTEGER) AS rank,
       (row_number() OVER (ORDER BY f DESC NULLS LAST, position) - 1) < {k} AS selected
FROM s"""


def _freg_sql() -> str:
    feats = _interactions_sql(_LR_X)
    k = max(1, min(int(0.3 * len(feats)), len(feats)))
    sel = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in feats)
    per = " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS feature, count(*) AS n, corr({n}, l_extendedprice) AS r FROM ex"
        for i, (n, _) in enumerate(feats)
    )
    return f"""
WITH ex AS (SELECT l_extendedprice, {sel} FROM lineitem),
c AS ({per}),
s AS (SELECT position, feature, CASE WHEN isnan(r) THEN NULL ELSE r*r/(1-r*r)*(n-2) END AS f FROM c)
SELECT position, feature, round(f, 4) AS f_score,
       CAST(row_number() OVER (ORDER BY f DESC NULLS LAST, position) - 1 AS INTEGER) AS rank,
       (row_number() OVER (ORDER BY f DESC NULLS LAST, position) - 1) < {k} AS selected
FROM s"""


_CARD_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS target, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"typeof(any_value({c})) = 'VARCHAR' AS is_string FROM {t}"
    for t, c in _TARGETS
)

_STRAT = """
WITH r AS (SELECT c_custkey, c_mktsegment AS y,
                  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS rk FROM customer),
c AS (SELECT c_mktsegment AS y, count(*) AS n FROM customer GROUP BY 1),
s AS (SELECT y, n, coalesce(sum(n) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c),
a AS (SELECT y, {cols} FROM s),
cum AS (SELECT y, {cums} FROM a)
SELECT c_custkey AS row_id,
       CAST(CASE {cases} ELSE 4 END AS INTEGER) AS fold
FROM r JOIN cum USING (y)"""


def _strat_sql() -> str:
    cols = ", ".join(f"floor((s+n-1-{i})/5.0) - floor((s-1-{i})/5.0) AS a{i}" for i in range(5))
    cums = ", ".join(f"{' + '.join(f'a{j}' for j in range(i + 1))} AS c{i}" for i in range(5))
    cases = " ".join(f"WHEN rk < c{i} THEN {i}" for i in range(4))
    return _STRAT.format(cols=cols, cums=cums, cases=cases)


def _label_sql(col: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY coalesce({col}, 'nan')) - 1 AS INTEGER)"


ORACLE = {
    "scan_csv": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "preview_head": "SELECT * FROM customer ORDER BY c_custkey LIMIT 10",
    "profile_nulls": " UNION ALL ".join(
        f"SELECT '{c}' AS column, {i} AS position, CAST(count(*) AS BIGINT) AS n_rows, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS n_nulls FROM {_ev_nulls()}"
        for i, c in enumerate(["event_id", "ts", "user_id", "event_type", "value", "props"])
    ),
    "profile_shape": "SELECT CAST(count(*) AS BIGINT) AS n_rows, 11 AS n_cols FROM lineitem",
    "profile_target_card": f"SELECT table_name, target, n_distinct FROM ({_CARD_SQL})",
    "detect_task": f"""SELECT table_name, target, is_string, n_distinct,
        CASE WHEN is_string OR n_distinct < 15 THEN 'classification' ELSE 'regression' END AS task FROM ({_CARD_SQL})""",
    "label_encode": f"""SELECT p_partkey, {_label_sql('p_name')} AS p_name_code, {_label_sql('p_brand')} AS p_brand_code,
        {_label_sql('p_type')} AS p_type_code FROM part""",
    "label_encode_target": f"SELECT c_custkey AS row_id, {_label_sql('c_mktsegment')} AS target FROM customer",
    "impute_median": f"""SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {_ev_nulls()})), 6) AS value,
        round(CAST(user_id AS DOUBLE), 6) AS user_id FROM {_ev_nulls()}""",
    "standard_scale": """SELECT c_custkey AS row_id,
        round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z_acctbal,
        round((c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer), 6) AS z_nationkey
        FROM customer""",
    "interaction_features": "SELECT p_partkey AS key, "
    + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in _interactions_sql(_PART_X))
    + " FROM part",
    "select_anova": _anova_sql(),
    "select_fregression": _freg_sql(),
    "pca_2d": """WITH s AS (SELECT avg(c_acctbal) m1, stddev_pop(c_acctbal) s1, avg(c_nationkey) m2,
                      stddev_pop(c_nationkey) s2, corr(c_acctbal, c_nationkey) r FROM customer),
        z AS (SELECT c_custkey, (c_acctbal - m1)/s1 AS z1, (c_nationkey - m2)/s2 AS z2, r FROM customer, s)
        SELECT c_custkey AS row_id, round((z1 + sign(r)*z2)/sqrt(2), 6) AS pc1,
               round((z1 - sign(r)*z2)/sqrt(2), 6) AS pc2 FROM z""",
    "pca_variance": """WITH s AS (SELECT abs(corr(c_acctbal, c_nationkey)) r FROM customer)
        SELECT 1 AS component, round((1 + r)/2, 4) AS ratio, round((round((1+r)/2,4) + round((1-r)/2,4))*100, 1) AS total_pct FROM s
        UNION ALL SELECT 2, round((1 - r)/2, 4), round((round((1+r)/2,4) + round((1-r)/2,4))*100, 1) FROM s""",
    "kfold_assign": "SELECT c_custkey AS row_id, CAST(ntile(5) OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS fold FROM customer",
    "stratified_kfold": _strat_sql(),
    "scalar_strings": r"""SELECT conv_id, turn,
        lower(regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')) AS norm,
        contains(lower(text), 'de') AS has_de,
        length(replace(text, chr(10), ' ')) AS len_replaced,
        CAST(len(list_filter(list_transform(string_split(text, ','),
             lambda s: regexp_replace(s, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda s: s <> '')) AS INTEGER) AS n_parts
        FROM conversations""",
    "scalar_truncate": "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' ELSE text END AS short FROM conversations",
    "scalar_math": """SELECT o_orderkey, round(o_totalprice, 1) AS r1, CAST(trunc(o_totalprice) AS INTEGER) AS as_int,
        greatest(o_totalprice, 100000.0) AS g, least(o_totalprice, 100000.0) AS l,
        CAST(greatest(1, least(floor(0.3*length(o_orderpriority)), length(o_orderpriority))) AS INTEGER) AS k FROM orders""",
    "scalar_format": f"""SELECT event_id, coalesce(printf('%.4f', value), 'N/A') AS v4,
        CASE WHEN length(event_type) < 25 THEN rpad(event_type, 25, ' ') ELSE event_type END AS padded FROM {_ev_nulls()}""",
    "scalar_latin1": "SELECT doc_id, regexp_replace(text, '[^\\x{0000}-\\x{00FF}]', '?', 'g') AS safe FROM documents",
    "scalar_timestamp": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events",
    "scalar_json": """SELECT event_id, coalesce(CASE WHEN json_valid(props) THEN TRY_CAST(json_extract(props, '$.k') AS INTEGER) END, -1) AS k
        FROM events""",
}
