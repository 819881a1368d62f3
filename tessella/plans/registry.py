"""All registered queries over whole tables, `(spark, sf_dir) -> DataFrame`. Doubles are rounded, so that results can be compared."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import roles
from tessella.functions import stats
from tessella.operators import clean, cluster, compare, features, profile, scale, transform
from tessella.operators import family as families
from tessella.operators.log import Log
from tessella.sources import infer, io, tables

MAP, ORDER, WEIGHT = roles.STAND_IN_MARITAL_MAP, roles.STAND_IN_EDUCATION_ORDER, roles.STAND_IN_MARITAL_WEIGHT
AXES = ["Recency", "TotalPurchases", "Total_Spent"]
#: Fixed centres over standard-scaled axes: queries on clusters then have one right result.
CENTERS = [[-1.0, -1.0, -1.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]
DESCRIBED = ["Income", "Year_Birth", "MntWines", "MntMeatProducts"]
LAMBDAS = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]
#: Given centres for each k: the curve of k and its measures then has one right result.
CURVE_CENTERS = {k: [[-1.5 + 3.0 * i / (k - 1)] * len(AXES) for i in range(k)] for k in range(2, 8)}

#: A given projection to two components.
GIVEN_MEANS, GIVEN_LOADINGS = [0.1, -0.2, 0.3], [[-0.4, 0.6, 0.7], [0.9, 0.3, 0.2]]

behaviour, raw, table = tables.behaviour, tables.raw_behaviour, tables.table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.demographic(behaviour(spark, sf_dir), WEIGHT, ORDER)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.product_channel(behaviour(spark, sf_dir))


def buying(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rfm(behaviour(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    # many columns of the stand-in table are functions of one key, which the optimizer would otherwise unfold for every filter
    return clean.clean(io.settle(raw(spark, sf_dir)), MAP, ORDER)


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The raw and the cleaned table, each computed once."""
    df = io.settle(raw(spark, sf_dir))
    return df, io.settle(clean.clean(df, MAP, ORDER))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID and the scaled axes of customers with orders."""
    return scale.scaled(buying(spark, sf_dir).filter("Recency IS NOT NULL").select("ID", *AXES), AXES)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(points(spark, sf_dir), AXES, CENTERS)


def clustered(spark: SparkSession, sf_dir: str, more: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The features of `more` with each customer's cluster."""
    return more(spark, sf_dir).join(labelled(spark, sf_dir).select("ID", "cluster"), "ID")


def curve(spark: SparkSession, sf_dir: str, exact: bool | float = True) -> DataFrame:
    return cluster.measured(io.settle(points(spark, sf_dir)), AXES, CURVE_CENTERS, exact)


def _made(name: str) -> Callable[[DataFrame, float | None], DataFrame]:
    if name == "demographic":
        return lambda df, cut: features.demographic(df, WEIGHT, ORDER, cut)
    return lambda df, cut: (features.product_channel if name == "product_channel" else features.rfm)(df)


def _dependency_cut(df: DataFrame) -> float | None:
    return features.dependency_cut(df.withColumn("TotalChildren", features.children()).withColumn("Income_per_Family_Member", features.income_per_member()))


FAMILIES = {
    name: families.Family(
        name, _made(name), roles.TRANSFORMS[name], roles.SKEW[name], roles.CANDIDATES[name], roles.TRAINED_PAIRS[name], roles.REFERENCE[name],
        _dependency_cut if name == "demographic" else None, roles.TRAINED_K[name],
    )
    for name in roles.TRAINED_K
}
#: Given models: scores of any rows then have one right result.
GIVEN = {
    "demographic": families.Model(
        "demographic", 40.0, [("Age", "Age", "none", None), ("Income", "Income", "yeo-johnson", 0.9), ("Dependency_Ratio", "Dependency_Ratio", "yeo-johnson", 0.5)],
        [], {"Age": (48.0, 30.0), "Income": (2100.0, 2500.0), "Dependency_Ratio": (1.5, 2.5)}, [[-0.5, 0.0, 0.0], [0.5, -0.5, 0.5], [0.0, 1.0, -0.5]],
    ),
    "product_channel": families.Model(
        "product_channel", None, [("Total_Spent", "Total_Spent_Transformed", "yeo-johnson", 0.25)],
        [("Total_Spent_Transformed", "TotalPurchases", "PC1_Total_TotalPurchases", 120.0, 30.0, 8.0, 5.0, 1.0)],
        {"Product_HHI": (0.2, 0.1), "Store_Preference": (0.25, 0.25), "Web_Engagement": (2.0, 2.0), "PC1_Total_TotalPurchases": (0.1, 1.5)},
        [[0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.5, -1.0], [0.0, 1.0, 0.5, 0.5], [-0.5, -0.5, 1.0, 1.0]],
    ),
    "rfm": families.Model(
        "rfm", None, [("AvgPerPurchase", "AvgPerPurchase_Transformed", "yeo-johnson", 0.6), ("Income_per_Family_Member", "Income_per_Family_Member_Transformed", "yeo-johnson", 0.8)],
        [("TotalPurchases", "Total_Spent", "PC1_TotalPurchases_Total", 8.0, 5.0, 1500000.0, 900000.0, 1.0),
         ("AvgPerPurchase_Transformed", "Income", "PC1_AvgPerPurchase_Income", 2400.0, 600.0, 6000.0, 40000.0, -1.0)],
        {"Recency": (60.0, 120.0), "Income_per_Family_Member_Transformed": (700.0, 800.0), "PC1_TotalPurchases_Total": (0.1, 1.4), "PC1_AvgPerPurchase_Income": (0.0, 1.1)},
        [[0.5, 0.0, -0.5, 0.0], [-0.2, 0.3, 0.8, 0.2]],
    ),
}


def family_export(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The family's features with fitted exponents and components, as clustering gets them before scaling."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = io.settle(behaviour(spark, sf_dir))
        return rounded(families.export(df, FAMILIES[name], families.fit(df, FAMILIES[name])[0]))

    return run


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, cluster, n, pct, inertia): K-Means of each family as it is finally trained, on transformed, reduced and robust-scaled features."""
    df, out = io.settle(behaviour(spark, sf_dir)), []
    for name, own in FAMILIES.items():
        model, cost = families.fit(df, own)
        found = cluster.sizes(families.score(df, own, model).filter("cluster IS NOT NULL"))
        out.append(found.select(F.lit(name).alias("family"), F.col("cluster").cast("long").alias("cluster"), "n", "pct", F.lit(cost).alias("inertia")))
    return _stacked(out)


def family_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard against robust scaling: the quality of each family's clustering."""
    df = io.settle(behaviour(spark, sf_dir))
    return _stacked([families.compared(df, own, {scale.STANDARD: roles.STANDARD_K[name], scale.ROBUST: roles.TRAINED_K[name]}) for name, own in FAMILIES.items()])


def family_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted models as the table that they are saved in, written and read again."""
    df = io.settle(behaviour(spark, sf_dir))
    fitted_ = [families.fit(df, own)[0] for own in FAMILIES.values()]
    return spark.read.parquet(families.save(spark, fitted_, io.scratch(spark, "models")))


def family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given models, through their table, applied to the raw table with its duplicates: (family, ID, cluster, d2)."""
    models = families.load(families.table(spark, list(GIVEN.values())))
    scored = [families.score(raw(spark, sf_dir), own, models[name]).select(F.lit(name).alias("family"), "ID", F.col("cluster").cast("long").alias("cluster"), F.round("d2", 4).alias("d2")) for name, own in FAMILIES.items()]
    return _stacked(scored)


def power_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = io.settle(buying(spark, sf_dir).select("Total_Spent", "AvgPerPurchase"))
    return transform.report(df, transform.plan(df, ["Total_Spent", "AvgPerPurchase"], roles.SKEW["rfm"]))


def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = io.settle(family(spark, sf_dir).select("ID", "Age", "Income", "Dependency_Ratio").na.drop("any"))
    return transform.transformed(df, transform.plan(df, ["Age", "Income", "Dependency_Ratio"], roles.SKEW["demographic"]), "")


def fitted(method: str, c: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.agg(F.lit(transform.fit(df, c, method)).alias("lambda"), F.count(c).alias("n"), F.count(transform.in_domain(c, method)).alias("n_fitted"))

    return run


def pca(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple]:
    df = io.settle(points(spark, sf_dir))
    return df, transform.principal(df, AXES, 3)


def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, (means, loadings, _) = pca(spark, sf_dir)
    return transform.projected(df, AXES, means, loadings).select("ID", "PC1", "PC2", "PC3")


def pca_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres of the clusters in the space of the first two components."""
    df, (means, loadings, _) = pca(spark, sf_dir)
    centers = cluster.update(cluster.assign(df, AXES, CENTERS), AXES)
    return transform.projected(centers, AXES, means, loadings[:2]).select("cluster", "PC1", "PC2")


def centers_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres of the clusters in the space of given components."""
    centers = cluster.update(labelled(spark, sf_dir), AXES)
    return transform.projected(centers, AXES, np.array(GIVEN_MEANS), np.array(GIVEN_LOADINGS)).select("cluster", "PC1", "PC2")


def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (_, loadings, shares) = pca(spark, sf_dir)
    rows = [(i + 1, float(s), [float(x) for x in w]) for i, (w, s) in enumerate(zip(loadings, shares))]
    return spark.createDataFrame(rows, "component int, share double, loadings array<double>")


def lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = io.settle(points(spark, sf_dir))
    return cluster.update(cluster.assign(df, AXES, cluster.lloyd(df, AXES, CENTERS, 2)), AXES)


def lloyd_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = io.settle(points(spark, sf_dir))
    return cluster.update(cluster.assign(df, AXES, cluster.lloyd_bounded(df, AXES, CENTERS, 2)[0].tolist()), AXES)


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = io.settle(points(spark, sf_dir))
    return cluster.sizes(cluster.assign(df, AXES, cluster.kmeans(df, AXES, roles.TRAINED_K["rfm"])))


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, key, value): what the report of a clustering holds, for Lloyd's iteration from the given centres."""
    df = io.settle(points(spark, sf_dir))
    (centers, cost, rounds), = cluster.lloyd_many(df, AXES, [np.array(CENTERS)])
    found = io.settle(cluster.assign(df, AXES, centers.tolist()))
    mean = lambda x: float(x.first()[0])
    rows = [
        ("quality", "inertia", cost), ("quality", "rounds", float(rounds)), ("quality", "silhouette", mean(cluster.mean_silhouette(found, AXES))),
        ("quality", "davies_bouldin", mean(cluster.davies_bouldin(found, AXES))), ("quality", "calinski_harabasz", mean(cluster.calinski_harabasz(found, AXES))),
        ("quality", "balance", mean(cluster.balance(found))),
    ]
    rows += [("size", str(r["cluster"]), float(r["n"])) for r in cluster.sizes(found).collect()]
    rows += [("centre", f"{i} {a}", float(x)) for i, c in enumerate(centers) for a, x in zip(AXES, c)]
    rows += [("explained", f"PC{i + 1}", float(x)) for i, x in enumerate(transform.principal(df, AXES, 3)[2])]
    return spark.createDataFrame(rows, "section string, key string, value double")


def stamped(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table written under a name with the time, and read again."""
    path = io.write_delimited(df, io.scratch(spark, "stamped"), stamped=True)
    return io.read_delimited(spark, path, df.schema)


def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, key, value): what the text report of the features holds."""
    long = compare.described(buying(spark, sf_dir), [*AXES, "AvgPerPurchase"], "value")
    return long.select(F.col("column").alias("section"), F.col("statistic").alias("key"), F.round("value", 6).alias("value"))


def encoding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.remap(raw(spark, sf_dir).select("Marital_Status"), "Marital_Status", MAP)
    dummies = [f"Marital_{v}" for v in clean.levels(clean.group_rare(df, "Marital_Status"), "Marital_Status")]
    rare = [r[0] for r in clean.rare_levels(df, "Marital_Status").orderBy("category").collect()]
    return spark.range(1).select(F.lit(io.encoding_report(MAP, ORDER, dummies, rare)).alias("report"))


def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.one_hot(clean.remap(behaviour(spark, sf_dir), "Marital_Status", MAP), "Marital_Status", drop=True)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.parse_date(behaviour(spark, sf_dir).select("ID", "Dt_Customer"))


def inferred(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table written as delimited text and read again with the types that its rows have."""
    path = io.write_delimited(df, io.scratch(spark, "inferred"), "\t")
    return infer.read(spark, path)[0]


def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after each step of the cleaning and how many the step removed, counted in the jobs of the cleaning itself."""
    log = Log()
    io.settle(clean.clean(io.settle(raw(spark, sf_dir)), MAP, ORDER, log=log))
    return log.table(spark).drop("at", "details")


def silhouette_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean silhouette within 0.02, by its bound, from sampled rows against all rows."""
    found = cluster.silhouette_estimate(labelled(spark, sf_dir), AXES, 0.02, exact_up_to=1000)
    return spark.createDataFrame([found], "silhouette double, bound double, n_sampled long")


def wide_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of all number columns of the behaviour table, from products of blocks."""
    df = behaviour(spark, sf_dir)
    return stats.correlation_matrix(df, [c for c, t in df.dtypes if t in ("bigint", "double")])


def counted(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n"))


def missing_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.group_rare(table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"), "n_name", 0.04)


def quantile_table(df: DataFrame, columns: list[str]) -> DataFrame:
    at = stats.quantiles(df, columns, [0.25, 0.5, 0.99])
    return stats.tall(df, columns, {"p25": lambda c: at(c, 0.25), "p50": lambda c: at(c, 0.5), "p99": lambda c: at(c, 0.99)})


def cols(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select(*names))


DUMMIES = ["Marital_AUTOMOBILE", "Marital_BUILDING", "Marital_HOUSEHOLD", "Marital_MACHINERY", "Marital_Other"]
FEATURES = roles.FEATURES
SPENT = ["MntWines", "MntMeatProducts"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources and sinks
    "rfm_features": tables.rfm,
    "behaviour_table": behaviour,
    "scan_tsv": lambda s, d: io.round_trip(table(s, d, "nation"), "\t"),
    "scan_csv": lambda s, d: io.round_trip(table(s, d, "customer"), ","),
    "scan_inferred": lambda s, d: inferred(s, table(s, d, "customer")),
    "sink_stamped": lambda s, d: stamped(s, table(s, d, "region")),
    "sink_csv_roundtrip": lambda s, d: io.round_trip(table(s, d, "region"), ","),
    "encoding_report_json": encoding_report,
    "feature_report": feature_report,
    "archive_features": lambda s, d: clean.archive(behaviour(s, d)),
    # projections and filters
    "project_features": lambda s, d: rounded(features.select_existing(products(s, d), ["ID", "Product_HHI", "Store_Preference", "Web_Engagement", "absent"])),
    "drop_columns": lambda s, d: clean.drop_columns(behaviour(s, d)),
    "select_numeric": lambda s, d: (lambda df: df.select("ID", *[c for c, t in df.dtypes if t in ("bigint", "double") and c != "ID"]))(behaviour(s, d)),
    "dropna_any": lambda s, d: clean.drop_missing(behaviour(s, d)),
    "filter_outliers": lambda s, d: clean.remove_outliers(behaviour(s, d)).select("ID", "Year_Birth", "Income"),
    "outlier_records": lambda s, d: clean.removed_records(behaviour(s, d)),
    "isin_filter": lambda s, d: table(s, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment"),
    # profiling
    "profile_missing": lambda s, d: profile.missing_by_column(raw(s, d)),
    "rows_with_missing": lambda s, d: profile.rows_with_missing(raw(s, d)),
    "dup_full_row": lambda s, d: (lambda df: profile.duplicate_counts(df, df.columns))(raw(s, d)),
    "dup_exclude_id": lambda s, d: profile.duplicate_counts(raw(s, d), FEATURES),
    "dup_groups": lambda s, d: profile.groups(raw(s, d), ["Year_Birth", "Education", "Marital_Status"]).filter("n > 1"),
    "dup_size_hist": lambda s, d: profile.duplicate_sizes(raw(s, d), FEATURES),
    "dup_ids": lambda s, d: profile.duplicate_keys(raw(s, d)),
    "dup_hidden": lambda s, d: profile.hidden_duplicates(raw(s, d)),
    "duplicate_group_members": lambda s, d: profile.duplicate_groups(raw(s, d), FEATURES),
    "dedupe_features": lambda s, d: clean.dedupe(raw(s, d)).select("ID", "Year_Birth", "Income"),
    "dup_rows_sorted": lambda s, d: profile.duplicate_rows(raw(s, d)).select("ID", "n", "copy"),
    "dup_documents": lambda s, d: profile.duplicate_counts(table(s, d, "documents"), ["text"]),
    "categorical_freq": lambda s, d: profile.frequencies(behaviour(s, d), "Education"),
    "cardinality_class": lambda s, d: profile.cardinality(behaviour(s, d), ["Education", "Marital_Status", "Dt_Customer"]),
    "basic_info": lambda s, d: profile.basic_info(behaviour(s, d)),
    "column_info": lambda s, d: profile.column_info(behaviour(s, d)),
    "validate_clean": lambda s, d: profile.validate_clean(clean.parse_date(clean.remap(clean.remove_outliers(clean.drop_missing(behaviour(s, d))), "Marital_Status", MAP)), list(MAP)),
    "validate_features": lambda s, d: rounded(profile.validate_features(buying(s, d), AXES), 0),
    "quality_summary": lambda s, d: profile.quality_summary(raw(s, d)),
    # outliers
    "outlier_binary": lambda s, d: profile.not_binary(behaviour(s, d), [*roles.BINARY, "Kidhome"]),
    "outlier_iqr_count": lambda s, d: rounded(profile.iqr_outliers(behaviour(s, d), roles.COUNT)),
    "outlier_iqr_spending": lambda s, d: rounded(profile.iqr_outliers(behaviour(s, d), roles.SPENDING)),
    "outlier_iqr_events": lambda s, d: rounded(profile.iqr_outliers(table(s, d, "events"), ["value"])),
    "outlier_top3": lambda s, d: profile.largest_outliers(table(s, d, "events"), "value", "event_id"),
    "outlier_income": lambda s, d: rounded(profile.income_outliers(behaviour(s, d), suspicious=9_900.0)),
    "suspicious_incomes": lambda s, d: profile.suspicious_values(behaviour(s, d), suspicious=9_900.0),
    "outlier_special": lambda s, d: profile.birth_year_outliers(behaviour(s, d)),
    "outlier_constant": lambda s, d: profile.constants(behaviour(s, d), [*roles.CONSTANT, "Kidhome"]),
    "outlier_summary": lambda s, d: profile.outlier_summary(behaviour(s, d)),
    "extreme_scaled": lambda s, d: profile.extremes(scale.scaled(table(s, d, "events"), ["value"]), ["value"]),
    # cleaning
    "remap_category": lambda s, d: clean.remap(behaviour(s, d), "Marital_Status", MAP).select("ID", "Marital_Status"),
    "remap_counts": lambda s, d: clean.remap_counts(behaviour(s, d), "Marital_Status", MAP),
    "parse_date": dated,
    "ordinal_encode": lambda s, d: behaviour(s, d).select("ID", "Education", clean.ordinal("Education", ORDER[:4]).alias("Education_ord")),
    "rare_group": missing_nation,
    "onehot_marital": lambda s, d: onehot(s, d).select("ID", *DUMMIES),
    "detect_binary": lambda s, d: clean.binary_columns(behaviour(s, d)),
    "binary_cast": lambda s, d: behaviour(s, d).select("ID", clean.as_binary("Kidhome").cast("int").alias("Kidhome_bin")),
    "clean_pipeline": cleaned,
    "clean_log": clean_log,
    "audit_onehot": lambda s, d: onehot(s, d).agg(*[F.sum(c).alias(c) for c in DUMMIES]),
    "audit_ordinal": lambda s, d: behaviour(s, d).groupBy("Education").agg(F.min(clean.ordinal("Education", ORDER)).alias("code")),
    "count_by_year": lambda s, d: counted(dated(s, d).select(F.year("Dt_Customer").alias("year")), "year"),
    "count_by_month": lambda s, d: counted(dated(s, d).select(F.month("Dt_Customer").alias("month")), "month"),
    # comparison
    "compare_quality": lambda s, d: compare.quality(*both(s, d)),
    "compare_categories": lambda s, d: clean.category_changes(behaviour(s, d), clean.remap(behaviour(s, d), "Marital_Status", MAP), "Marital_Status"),
    "category_set_diff": lambda s, d: clean.category_sets(behaviour(s, d), clean.remap(behaviour(s, d), "Marital_Status", MAP), "Marital_Status"),
    "compare_describe": lambda s, d: rounded(compare.describe(*both(s, d), DESCRIBED), 6),
    "compare_thresholds": lambda s, d: compare.threshold_counts(*both(s, d), {"income >= 5000": "Income >= 5000", "born < 1900": "Year_Birth < 1900"}),
    "compare_outlier_dist": lambda s, d: rounded(compare.describe(behaviour(s, d), clean.remove_outliers(behaviour(s, d)), [*SPENT, "Recency"]), 6),
    "summarize_changes": lambda s, d: rounded(compare.summary(*both(s, d))),
    "type_histogram": lambda s, d: compare.type_histogram(raw(s, d), cleaned(s, d)),
    "schema_diff": lambda s, d: compare.schema_diff(raw(s, d), cleaned(s, d)),
    # features
    "feat_age": lambda s, d: cols(family(s, d), "ID", "Age"),
    "feat_children": lambda s, d: counted(family(s, d), "TotalChildren"),
    "feat_income_pfm": lambda s, d: cols(family(s, d), "ID", "Income_per_Family_Member"),
    "feat_marital_score": lambda s, d: cols(family(s, d), "ID", "Marital_Encoded"),
    "feat_life_stage": lambda s, d: cols(family(s, d), "ID", "Life_Stage"),
    "feat_dependency": lambda s, d: cols(family(s, d), "ID", "Dependency_Ratio"),
    "feat_total_spent": lambda s, d: cols(products(s, d), "ID", "Total_Spent"),
    "feat_total_purchases": lambda s, d: cols(products(s, d), "ID", "TotalPurchases"),
    "feat_product_pref": lambda s, d: cols(products(s, d), "ID", *features.PREFERENCES),
    "feat_hhi": lambda s, d: cols(products(s, d), "ID", "Product_HHI"),
    "feat_dominant_product": lambda s, d: cols(products(s, d), "ID", "Dominant_Product", "Top_Product_Share"),
    "feat_store_pref": lambda s, d: cols(products(s, d), "ID", "Store_Preference"),
    "feat_web_engagement": lambda s, d: cols(products(s, d), "ID", "Web_Engagement"),
    "feat_avg_per_purchase": lambda s, d: cols(buying(s, d), "ID", "AvgPerPurchase"),
    # transforms and reduction
    "transform_decision": lambda s, d: rounded(transform.decision(table(s, d, "events"), "value", 0.5)),
    "boxcox_fixed": lambda s, d: cols(table(s, d, "events").select("event_id", transform.box_cox("value", 0.25).alias("y")), "event_id", "y"),
    "yeojohnson_fixed": lambda s, d: cols(table(s, d, "customer").select("c_custkey", transform.yeo_johnson("c_acctbal", 0.75).alias("y")), "c_custkey", "y"),
    "boxcox_fit": fitted(transform.BOX_COX, "value", "events"),
    "yeojohnson_fit": fitted(transform.YEO_JOHNSON, "c_acctbal", "customer"),
    "boxcox_llf_grid": lambda s, d: rounded(transform.log_likelihoods(table(s, d, "events"), "value", transform.BOX_COX, LAMBDAS), 3),
    "yeojohnson_llf_grid": lambda s, d: rounded(transform.log_likelihoods(table(s, d, "customer"), "c_acctbal", transform.YEO_JOHNSON, [0.5, 1.0, 1.5, 2.0]), 3),
    "transform_report": lambda s, d: rounded(power_report(s, d)),
    "transform_pipeline": lambda s, d: rounded(transformed(s, d)),
    "corr_wide": lambda s, d: rounded(wide_correlations(s, d)),
    "corr_matrix": lambda s, d: rounded(stats.correlation_matrix(buying(s, d), [*AXES, "Z_Revenue"])),
    "high_corr_pairs": lambda s, d: rounded(transform.high_pairs(buying(s, d), AXES)),
    "max_corr_pair": lambda s, d: rounded(transform.strongest_pair(buying(s, d), AXES)),
    "pca_pair_reduce": lambda s, d: rounded(transform.reduce_pairs(df := buying(s, d).select("ID", *AXES), transform.pairs_to_reduce(df, AXES))),
    "pca_pair_variance": lambda s, d: rounded(transform.pair_variance(buying(s, d), AXES)),
    "pca_projection": lambda s, d: rounded(pca_projection(s, d)),
    "pca_centers": lambda s, d: rounded(pca_centers(s, d)),
    "pca_centers_given": lambda s, d: rounded(centers_given(s, d)),
    "pca_explained": pca_explained,
    # statistics
    "describe_stats": lambda s, d: rounded(compare.described(behaviour(s, d), DESCRIBED, "value"), 6),
    "std_samp_pop": lambda s, d: rounded(stats.tall(behaviour(s, d), SPENT, {"samp": F.stddev_samp, "pop": F.stddev_pop, "var": F.var_samp}), 1),
    "quantiles_exact": lambda s, d: rounded(quantile_table(behaviour(s, d), SPENT)),
    "skew_adjusted": lambda s, d: rounded(stats.tall(table(s, d, "customer"), ["c_acctbal"], {"skew": stats.skew_adjusted})),
    "value_counts_pct": lambda s, d: profile.frequencies(table(s, d, "events"), "event_type"),
    "distinct_values": lambda s, d: behaviour(s, d).agg(F.count_distinct("Education").alias("n"), F.sort_array(F.collect_set("Education")).alias("found")),
    "histogram_bins": lambda s, d: rounded(stats.histogram(table(s, d, "events"), "value", 30)),
    "kde": lambda s, d: rounded(stats.density(table(s, d, "events"), "value", 50)),
    "boxplot_stats": lambda s, d: rounded(stats.boxplot(behaviour(s, d), SPENT)),
    # scaling
    "scale_standard": lambda s, d: rounded(points(s, d)),
    "scale_robust": lambda s, d: rounded(scale.scaled(buying(s, d).select("ID", *AXES), AXES, scale.ROBUST)),
    "pre_scale_stats": lambda s, d: rounded(scale.stats(buying(s, d), AXES), 4),
    "post_scale_stats": lambda s, d: rounded(scale.stats(points(s, d), AXES, population=True)),
    "validate_scaling": lambda s, d: scale.validated(points(s, d), AXES),
    "scaling_preserves": lambda s, d: scale.preserved(buying(s, d), scale.scaled(buying(s, d), AXES), ["Education", "Income"], "ID"),
    # clustering
    "assign_clusters": lambda s, d: labelled(s, d).select("ID", F.col("cluster").cast("long").alias("cluster")),
    "update_centroids": lambda s, d: rounded(cluster.update(labelled(s, d), AXES)),
    "inertia": lambda s, d: rounded(cluster.inertia(labelled(s, d)), 4),
    "init_random": lambda s, d: rounded(s.createDataFrame(cluster.random_centers(points(s, d), AXES, 3, 42), ", ".join(f"{c} double" for c in AXES)), 12),
    "kmeanspp_weights": lambda s, d: rounded(cluster.seeding_weights(points(s, d), AXES, CENTERS)),
    "kmeans_lloyd_fixed": lambda s, d: rounded(lloyd(s, d)),
    "kmeans_lloyd_bounded": lambda s, d: rounded(lloyd_bounded(s, d)),
    "kmeans_restarts": kmeans,
    "kmeans_ml": lambda s, d: cluster.sizes(cluster.ml_kmeans(io.settle(points(s, d)), AXES, roles.TRAINED_K["rfm"])[0]),
    "k_sweep": lambda s, d: cluster.sweep(io.settle(points(s, d)), AXES),
    "k_curve": lambda s, d: rounded(curve(s, d).drop("davies_bouldin"), 4),
    "elbow_point": lambda s, d: rounded(cluster.elbow(curve(s, d, exact=False))),
    "vote_k": lambda s, d: cluster.vote(curve(s, d)),
    "family_demographic": family_export("demographic"),
    "family_product_channel": family_export("product_channel"),
    "family_rfm": family_export("rfm"),
    "family_comparison": lambda s, d: rounded(family_comparison(s, d)),
    "family_models": family_models,
    "family_scores": family_scores,
    "trained_families": lambda s, d: rounded(trained(s, d)),
    "silhouette_exact": lambda s, d: rounded(cluster.mean_silhouette(labelled(s, d), AXES)),
    "silhouette_estimate": silhouette_estimate,
    "negative_silhouette": lambda s, d: cluster.negative_silhouettes(labelled(s, d), AXES),
    "squared_silhouette": lambda s, d: rounded(cluster.squared_silhouette(labelled(s, d), AXES)),
    "davies_bouldin": lambda s, d: rounded(cluster.davies_bouldin(labelled(s, d), AXES)),
    "calinski_harabasz": lambda s, d: rounded(cluster.calinski_harabasz(labelled(s, d), AXES), 4),
    "cluster_balance": lambda s, d: rounded(cluster.balance(labelled(s, d))),
    "cluster_sizes": lambda s, d: rounded(cluster.sizes(labelled(s, d))),
    "cluster_summary": lambda s, d: rounded(cluster_summary(s, d), 4),
    # after clustering
    "cluster_profile": lambda s, d: rounded(cluster.profile(clustered(s, d, products), ["Income", "Total_Spent"]), 6),
    "cluster_profile_long": lambda s, d: rounded(cluster.profile(labelled(s, d), AXES).selectExpr("cluster", f"stack({len(AXES)}, {', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in AXES)}) AS (feature, mean)")),
    "posthoc_education": lambda s, d: rounded(cluster.levels_by_cluster(clustered(s, d, family), "Education_ord", list(range(5)))),
    "posthoc_lifestage": lambda s, d: rounded(cluster.levels_by_cluster(clustered(s, d, family), "Life_Stage", list(range(5)))),
    "posthoc_preferences": lambda s, d: rounded(cluster.profile(clustered(s, d, products), features.PREFERENCES)),
    "posthoc_dominant": lambda s, d: rounded(cluster.top_levels_by_cluster(clustered(s, d, products), "Dominant_Product")),
    "posthoc_top_share": lambda s, d: rounded(cluster.profile(clustered(s, d, products), ["Top_Product_Share"])),
}
