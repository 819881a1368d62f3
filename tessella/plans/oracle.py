"""SQL of the registered queries, for any engine that knows the tables. Shared parts are named sub-queries."""

from __future__ import annotations

from tessella import roles
from tessella.plans.registry import GIVEN, GIVEN_LOADINGS, GIVEN_MEANS, AXES, CURVE_CENTERS, DESCRIBED, DUMMIES, FEATURES, LAMBDAS, SPENT
from tessella.sources.tables import LAST_DAY, PRIORITIES, TYPES


def _each(items, template: str, by: str = ", ") -> str:
    return by.join(template.format(x) for x in items)


_AMOUNT = "round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT)"
_CENTS = "(({0}::BIGINT + 50) // 100) / 100.0::DOUBLE"
_BEHAVIOUR = f"""
lo AS (SELECT l_orderkey, {", ".join(f"sum(CASE WHEN p_type = '{k}' THEN {_AMOUNT} END) AS {v}" for k, v in TYPES.items())}
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
bc AS (SELECT o_custkey, strftime(min(o_orderdate::DATE), '%d-%m-%Y') AS Dt_Customer, date_diff('day', max(o_orderdate::DATE), DATE '{LAST_DAY}') AS Recency,
       {", ".join(f"{_CENTS.format(f'sum({v})')} AS {v}" for v in TYPES.values())}, {", ".join(f"count(*) FILTER (o_orderpriority = '{k}') AS {v}" for k, v in PRIORITIES.items())}
       FROM orders LEFT JOIN lo ON o_orderkey = l_orderkey GROUP BY o_custkey),
b AS (SELECT c_custkey AS ID, CASE WHEN c_custkey % 499 = 0 THEN 1890 WHEN c_custkey % 397 = 0 THEN 2010 ELSE 1996 - c_custkey * 37 % 60 END AS Year_Birth, r_name AS Education,
      CASE WHEN c_custkey % 149 = 0 THEN 'ALONE' ELSE c_mktsegment END AS Marital_Status,
      CASE WHEN c_custkey % 93 <> 0 THEN CASE WHEN c_custkey % 211 = 0 THEN 600000.0 + c_custkey ELSE c_acctbal END END AS Income, c_custkey % 3 AS Kidhome, (c_custkey // 3) % 2 AS Teenhome,
      Dt_Customer, Recency, {_each(TYPES.values(), "coalesce({0}, 0) AS {0}")}, {_each(PRIORITIES.values(), "coalesce({0}, 0) AS {0}")},
      {", ".join(f"(c_custkey % 7 = {i})::BIGINT AS AcceptedCmp{i}" for i in range(1, 6))}, (c_custkey % 50 = 0)::BIGINT AS Complain,
      (c_custkey % 6 = 0)::BIGINT AS Response, 3::BIGINT AS Z_CostContact, 11::BIGINT AS Z_Revenue
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN bc ON c_custkey = o_custkey)"""
_ALL = _BEHAVIOUR + ", r AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE ID % 50 = 0 UNION ALL SELECT * REPLACE (ID + 10000000 AS ID) FROM b WHERE ID % 20 = 0)"
_NO_NULL = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
_MAPPED = "CASE Marital_Status WHEN 'FURNITURE' THEN 'HOUSEHOLD' ELSE Marital_Status END"
_CODE = "CASE Education WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 WHEN 'MIDDLE EAST' THEN 4 END"
#: The rare category of the stand-in table becomes Other.
_GROUPED = f"CASE {_MAPPED} WHEN 'ALONE' THEN 'Other' ELSE {_MAPPED} END"
_KEPT = [c for c in FEATURES if c not in roles.DROPPED and c != "Dt_Customer"]
_ALL += f""",
cl AS (SELECT DISTINCT {", ".join(_KEPT)}, strptime(Dt_Customer, '%d-%m-%Y') AS Dt_Customer, ({_CODE})::INT AS Education_ord,
       {", ".join(f"({_GROUPED} = '{d[8:]}')::INT AS {d}" for d in DUMMIES)}
       FROM r WHERE {_NO_NULL} AND NOT coalesce(Income >= 500000, false) AND NOT coalesce(Year_Birth < 1900, false))"""
_SPENT = " + ".join(roles.SPENDING)
_BOUGHT = " + ".join(roles.CHANNELS)
_ALL += f""",
f0 AS (SELECT *, Kidhome + Teenhome AS TotalChildren, least(2014 - Year_Birth, 100) AS Age, Income / (2 + Kidhome + Teenhome) AS Income_per_Family_Member,
       CASE Marital_Status WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS Marital_Encoded, {_SPENT} AS Total_Spent,
       ({_BOUGHT})::BIGINT AS TotalPurchases, ({_CODE})::INT AS Education_ord FROM b),
f1 AS (SELECT *, TotalChildren * 10000.0::DOUBLE / (Income_per_Family_Member + 1e-6) AS dr,
       CASE WHEN TotalChildren > 0 AND Marital_Encoded = 0 THEN 4 WHEN Age >= 60 THEN 3 WHEN Age >= 45 AND Age < 60 AND TotalChildren > 0 THEN 2
            WHEN Age < 45 AND TotalChildren > 0 AND Marital_Encoded > 0 THEN 1 ELSE 0 END AS Life_Stage,
       CASE WHEN TotalPurchases = 0 THEN 0 ELSE Total_Spent / TotalPurchases END AS AvgPerPurchase,
       CASE WHEN TotalPurchases = 0 THEN 0 ELSE NumStorePurchases / TotalPurchases END AS Store_Preference,
       {", ".join(f"CASE WHEN Total_Spent = 0 THEN 0 ELSE {c} / Total_Spent END AS {n}_Preference" for n, c in zip(("Wine", "Fruit", "Meat", "Fish", "Sweet", "Gold"), roles.SPENDING))}
       FROM f0),
f AS (SELECT *, CASE WHEN dr IS NOT NULL THEN least(dr, quantile_cont(dr, 0.99) OVER ()) END AS Dependency_Ratio,
      {" + ".join(f"{n}_Preference * {n}_Preference" for n in ("Wine", "Fruit", "Meat", "Fish", "Sweet", "Gold"))} AS Product_HHI,
      greatest({", ".join(f"{n}_Preference" for n in ("Wine", "Meat", "Fish", "Fruit", "Sweet", "Gold"))}) AS Top_Product_Share FROM f1),
p AS (SELECT *, CASE {" ".join(f"WHEN {n}_Preference = Top_Product_Share THEN '{n}'" for n in ("Wine", "Meat", "Fish", "Fruit", "Sweet", "Gold"))} END AS Dominant_Product FROM f),
z AS (SELECT ID, {_each(AXES, "({0} - avg({0}) OVER ()) / stddev_pop({0}) OVER () AS {0}")} FROM f WHERE Recency IS NOT NULL),
k0 AS (SELECT *, [{", ".join(" + ".join(f"({a} - ({x})) * ({a} - ({x}))" for a in AXES) for x in (-1, 0, 1))}] AS ds FROM z),
k AS (SELECT * EXCLUDE (ds), list_position(ds, list_min(ds)) - 1 AS cluster, list_min(ds) AS d2 FROM k0),
kp AS (SELECT p.*, cluster FROM p JOIN k USING (ID))"""


def q(body: str, digits: int = 6, rounded: str = "", more: str = "") -> str:
    """`body` over the named sub-queries, with the listed columns rounded and no negative zero."""
    replaced = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in rounded.split())
    return f"WITH {_ALL}{more} SELECT * {f'REPLACE ({replaced})' if replaced else ''} FROM ({body})"


def _union(template: str, items) -> str:
    return " UNION ALL ".join(template.format(x) for x in items)


def _groups(columns: list[str], source: str = "r") -> str:
    return f"(SELECT count(*) AS n FROM {source} GROUP BY {', '.join(columns)})"


def _dups(columns: list[str], source: str = "r") -> str:
    return f"SELECT coalesce(sum(n - 1), 0)::BIGINT AS surplus, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS in_groups, count(*) FILTER (n > 1) AS n_groups FROM {_groups(columns, source)}"


RAW = ["ID", *FEATURES]
_BOUNDS = """SELECT *, greatest(q1 - 3.0 * (q3 - q1), 0.0) AS low, q3 + 3.0 * (q3 - q1) AS high FROM
  (SELECT '{0}' AS "column", {0} AS v, quantile_cont({0}::DOUBLE, 0.25) OVER () AS q1, quantile_cont({0}::DOUBLE, 0.75) OVER () AS q3 FROM {1} WHERE {0} IS NOT NULL)"""
_IQR = """SELECT "column", q1, q3, low, high, count(*) AS n, count(*) FILTER (v < low) AS n_low, count(*) FILTER (v > high) AS n_high FROM ({0}) GROUP BY ALL"""


def _iqr(columns: list[str], source: str = "b") -> str:
    return " UNION ALL ".join(_IQR.format(_BOUNDS.format(c, source)) for c in columns)


def _describe(c: str, source: str, name: str) -> str:
    pairs = {
        "n": f"count({c})::DOUBLE", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})::DOUBLE", "p25": f"quantile_cont({c}::DOUBLE, 0.25)",
        "p50": f"quantile_cont({c}::DOUBLE, 0.5)", "p75": f"quantile_cont({c}::DOUBLE, 0.75)", "max": f"max({c})::DOUBLE",
    }
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{s}' AS statistic, {e} AS {name} FROM {source}" for s, e in pairs.items())


def _both(columns: list[str], one: str, two: str) -> str:
    side = lambda source, name: " UNION ALL ".join(_describe(c, source, name) for c in columns)
    return f"""SELECT *, after - before AS diff, CASE WHEN before = 0 THEN 'Infinity'::DOUBLE ELSE 100.0 * (after - before) / before END AS pct
               FROM ({side(one, "before")}) JOIN ({side(two, "after")}) USING ("column", statistic)"""


def _llf(c: str, source: str, jacobian: str, power: str, lambdas: list[float]) -> str:
    one = "SELECT {0}::DOUBLE AS lambda, ({0} - 1) * sum({1}) - count({2}) / 2.0 * ln(var_pop({3})) AS llf FROM {4}"
    return " UNION ALL ".join(one.format(x, jacobian, c, power.format(x), source) for x in lambdas)


_BC = lambda x: "ln(value)" if x == 0 else f"(pow(value, {x}) - 1) / ({x})"
_YJ = lambda x: f"CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, {x}) - 1) / {x} ELSE {'-ln(1 - c_acctbal)' if x == 2 else f'-(pow(1 - c_acctbal, {2 - x}) - 1) / {2 - x}'} END"
_STATS = """SELECT '{0}' AS feature, count({0}) AS n, avg({0}) AS mean, {1}({0}) AS std, min({0})::DOUBLE AS least, max({0})::DOUBLE AS greatest, quantile_cont({0}::DOUBLE, 0.5) AS median,
 quantile_cont({0}::DOUBLE, 0.75) - quantile_cont({0}::DOUBLE, 0.25) AS iqr, skewness({0}) AS skew, count(*) - count({0}) AS n_missing FROM {2}"""
_CENTER = ", ".join(f"avg({a}) AS {a}" for a in AXES)
_DIST = " + ".join(f"(x.{a} - y.{a}) * (x.{a} - y.{a})" for a in AXES)
_SIL = f"""
d AS (SELECT x.ID, x.cluster, y.cluster AS other, sum(sqrt({_DIST})) AS total, count(*) AS n FROM k x CROSS JOIN k y GROUP BY ALL),
ab AS (SELECT ID, cluster, max(CASE WHEN cluster = other AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN cluster <> other THEN total / n END) AS b FROM d GROUP BY ALL),
s AS (SELECT ID, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""
_SSIL = _SIL.replace("sqrt", "")
_DB = f"""
c AS (SELECT cluster, {_CENTER} FROM k GROUP BY cluster),
sp AS (SELECT y.*, s FROM c y JOIN (SELECT x.cluster, avg(sqrt({_DIST})) AS s FROM k x JOIN c y USING (cluster) GROUP BY x.cluster) USING (cluster)),
w AS (SELECT x.cluster, max((x.s + y.s) / sqrt({_DIST})) AS worst FROM sp x JOIN sp y ON x.cluster <> y.cluster GROUP BY x.cluster)"""
_CH = f"""
c AS (SELECT cluster, count(*) AS n, {_CENTER} FROM k GROUP BY cluster), m AS (SELECT count(*) AS n, {_CENTER} FROM k),
bw AS (SELECT sum(x.n * ({_DIST})) AS bt, count(*) AS kk FROM c x, m y), wi AS (SELECT sum({_DIST}) AS wt, count(*) AS n FROM k x JOIN c y USING (cluster))"""
_SIZES = "SELECT cluster::INT AS cluster, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM k GROUP BY cluster"


def _levels(c: str, levels) -> str:
    return " UNION ALL ".join(
        f"SELECT cluster, {v} AS level, count(*) FILTER ({c} = {v}) AS n, 100.0 * count(*) FILTER ({c} = {v}) / count(*) AS pct FROM kp GROUP BY cluster" for v in levels
    )


def _profile(columns: list[str]) -> str:
    return f"SELECT cluster, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in columns)} FROM kp GROUP BY cluster"


def _step(source: str, centers: str) -> str:
    """One round of Lloyd: nearest centres of `source` among `centers`, then the means."""
    near = f"SELECT x.*, row_number() OVER (PARTITION BY x.ID ORDER BY {_DIST}, y.cluster) AS rn, y.cluster FROM {source} x CROSS JOIN {centers} y"
    return f"SELECT cluster, count(*) AS n, {_CENTER} FROM ({near}) WHERE rn = 1 GROUP BY cluster"


_FIXED = "(VALUES (0, -1.0, -1.0, -1.0), (1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)) AS v(cluster, " + ", ".join(AXES) + ")"
_LLOYD = f", c0 AS (SELECT * FROM {_FIXED}), c1 AS ({_step('z', 'c0')}), c2 AS ({_step('z', 'c1')})"


def _near(k: int) -> str:
    """Rows with the nearest of the given centres for k, and the squared distance to it."""
    ds = ", ".join(" + ".join(f"({a} - ({x})) * ({a} - ({x}))" for a, x in zip(AXES, c)) for c in CURVE_CENTERS[k])
    return f"SELECT ID, {', '.join(AXES)}, list_position(ds, list_min(ds)) - 1 AS cluster, list_min(ds) AS d2 FROM (SELECT *, [{ds}] AS ds FROM z)"


def _measures(k: int) -> str:
    """Sub-queries: the clustering of k, and the mean Euclidean silhouette of its rows."""
    return f"""
n{k} AS ({_near(k)}),
d{k} AS (SELECT x.ID, x.cluster, y.cluster AS other, sum(sqrt({_DIST})) AS total, count(*) AS n FROM n{k} x CROSS JOIN n{k} y GROUP BY ALL),
ab{k} AS (SELECT ID, max(CASE WHEN cluster = other AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN cluster <> other THEN total / n END) AS b FROM d{k} GROUP BY ID),
m{k} AS (SELECT {k}::INT AS k, (SELECT sum(d2) FROM n{k}) AS wcss, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab{k})"""


_CURVE = "," + ",".join(map(_measures, CURVE_CENTERS)) + f", c AS ({' UNION ALL '.join(f'SELECT * FROM m{k}' for k in CURVE_CENTERS)})"
_CURVE += """, u AS (SELECT k, silhouette, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ())::DOUBLE AS x, (wcss - min(wcss) OVER ()) / (max(wcss) OVER () - min(wcss) OVER ()) AS y FROM c),
e AS (SELECT arg_min(x, k) AS x0, arg_min(y, k) AS y0, arg_max(x, k) AS x1, arg_max(y, k) AS y1 FROM u),
t AS (SELECT k, silhouette, abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS distance FROM u, e)"""
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_CORR_NAMES = [*AXES, "Z_Revenue"]
_CORR = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{_CORR_NAMES[i]}' AS f1, '{_CORR_NAMES[j]}' AS f2, "
    + ("NULL::DOUBLE AS r" if j == 3 else f"corr({_CORR_NAMES[i]}, {_CORR_NAMES[j]}) AS r FROM f")
    for i, j in _PAIRS
)
_HIGH = f"SELECT * FROM ({_CORR}) WHERE abs(r) >= 0.7"
_FREQ = "SELECT {0} AS value, n, round(100.0 * n / total, 4) AS pct FROM (SELECT {0}, count(*) AS n, (SELECT count(*) FROM {1}) AS total FROM {1} GROUP BY {0}) WHERE {0} IS NOT NULL"
_CARD = """SELECT *, CASE WHEN n_distinct / n_rows > 0.9 THEN 'HIGH' WHEN n_distinct / n_rows > 0.5 THEN 'MEDIUM' WHEN n_distinct / n_rows > 0.1 THEN 'LOW'
 WHEN n_distinct = 1 THEN 'CONSTANT' ELSE 'CATEGORICAL' END AS class FROM (SELECT '{0}' AS "column", count(DISTINCT {0}) AS n_distinct, count(*) AS n_rows FROM b)"""
_NULLS = lambda source: " + ".join(f"count(*) - count({c})" for c in source)
_CLEAN = [*_KEPT, "Dt_Customer", "Education_ord", *DUMMIES]
_QUALITY = f"""SELECT * FROM (SELECT count(*) AS rows_before, {_NULLS(RAW)} AS missing_before FROM r), (SELECT surplus AS duplicates_before FROM ({_dups(RAW)})),
 (SELECT count(*) AS rows_after, {_NULLS(_CLEAN)} AS missing_after FROM cl), (SELECT surplus AS duplicates_after FROM ({_dups(_CLEAN, 'cl')}))"""
_CHANGES = f"""SELECT category, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after FROM (SELECT Marital_Status AS category, count(*) AS n_before FROM b GROUP BY 1)
 FULL JOIN (SELECT {_MAPPED} AS category, count(*) AS n_after FROM b GROUP BY 1) USING (category)"""
_HIDDEN = f"SELECT x.surplus AS full_row, y.surplus AS features, y.surplus - x.surplus AS hidden FROM ({_dups(RAW)}) x, ({_dups(FEATURES)}) y"
_BIRTH = """SELECT count(*) FILTER (Year_Birth < 1900) AS too_old, count(*) FILTER (Year_Birth > 2006) AS too_young, count(*) FILTER (Year_Birth < 1900 OR Year_Birth > 2006) AS n_outliers,
 min(2024 - Year_Birth) AS youngest_age, max(2024 - Year_Birth) AS oldest_age FROM b"""
_CONST = """SELECT '{0}' AS "column", count(DISTINCT {0}) AS n_distinct, min({0}) AS value, count(DISTINCT {0}) = 1 AS is_constant FROM b"""
_BIN = """SELECT '{0}' AS "column", count({0}) AS n, count(*) FILTER ({0} NOT IN (0, 1)) AS n_outliers FROM b"""
_INTS = ["ID", "Year_Birth", *roles.COUNT, *roles.BINARY, *roles.CONSTANT]
_SUMMARY = " UNION ALL ".join(
    [
        f"""SELECT "column", 'binary' AS role, n_outliers FROM ({_union(_BIN, roles.BINARY)})""",
        *[f"""SELECT "column", '{r}' AS role, n_low + n_high AS n_outliers FROM ({_iqr(c)})""" for r, c in (("count", roles.COUNT), ("spending", roles.SPENDING), ("income", roles.INCOME))],
        f"SELECT 'Year_Birth' AS \"column\", 'special' AS role, n_outliers FROM ({_BIRTH})",
        f"""SELECT "column", 'constant' AS role, CASE WHEN is_constant THEN 0 ELSE n_distinct - 1 END AS n_outliers FROM ({_union(_CONST, roles.CONSTANT)})""",
    ]
)
_EVENT_BOUND = "(SELECT quantile_cont(value, 0.75) + 3.0 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events)"
_PREFS = " ".join(f"{n}_Preference" for n in ("Wine", "Fruit", "Meat", "Fish", "Sweet", "Gold"))
_FEATS = {
    "feat_age": "Age", "feat_income_pfm": "Income_per_Family_Member", "feat_marital_score": "Marital_Encoded", "feat_life_stage": "Life_Stage", "feat_dependency": "Dependency_Ratio",
    "feat_total_spent": "Total_Spent", "feat_total_purchases": "TotalPurchases", "feat_product_pref": _PREFS, "feat_hhi": "Product_HHI", "feat_store_pref": "Store_Preference",
    "feat_avg_per_purchase": "AvgPerPurchase",
}
_WHOLE = {"Age", "Marital_Encoded", "Life_Stage", "TotalPurchases"}



def _power(x: str, method: str, lam: float | None) -> str:
    if method == "none":
        return x
    return f"CASE WHEN {x} >= 0 THEN (pow({x} + 1, {lam}) - 1) / {lam} WHEN {x} < 0 THEN -(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam} END"


def _scored(model) -> str:
    """A given model over the raw table: one sub-query for each of its steps."""
    made = "SELECT *, CASE WHEN dr IS NOT NULL THEN least(dr, {}) END AS ratio FROM f".format(model.cut or "NULL")
    again = f"SELECT * FROM ({made}) WHERE ID % 50 = 0 UNION ALL SELECT * REPLACE (ID + 10000000 AS ID) FROM ({made}) WHERE ID % 20 = 0"
    read = {"Dependency_Ratio": "ratio", "Web_Engagement": "NumWebVisitsMonth"}
    at = {c: read.get(c, c) for c in [*model.columns, *(x for p in model.pairs for x in p[:2])]}
    at |= {name: _power(read.get(c, c), method, lam) for c, name, method, lam in model.exponents}
    at |= {name: f"(({at[a]} - {ma}) / {sa} + {sign} * ({at[b]} - {mb}) / {sb}) / sqrt(2)" for a, b, name, ma, sa, mb, sb, sign in model.pairs}
    columns = ", ".join(f"(({at[c]}) - {centre}) / {spread} AS x{i}" for i, (c, (centre, spread)) in enumerate(model.scales.items()))
    ds = ", ".join(" + ".join(f"(x{i} - ({v})) * (x{i} - ({v}))" for i, v in enumerate(c)) for c in model.centers)
    return f"""SELECT '{model.family}' AS family, ID, CASE WHEN ds[1] IS NOT NULL THEN list_position(ds, list_min(ds)) - 1 END::BIGINT AS cluster,
      round(CASE WHEN ds[1] IS NOT NULL THEN list_min(ds) END, 4) AS d2
      FROM (SELECT ID, [{ds}] AS ds FROM (SELECT ID, {columns} FROM ({made} UNION ALL {again})))"""


_NUMBERS = [c for c in RAW if c not in ("Education", "Marital_Status", "Dt_Customer")]
_WIDE_CORR = " UNION ALL ".join(
    f"SELECT {i}::INT AS i, {j}::INT AS j, '{a}' AS f1, '{b}' AS f2, CASE WHEN var_pop({a}) FILTER ({b} IS NOT NULL) > 0 AND var_pop({b}) FILTER ({a} IS NOT NULL) > 0 THEN corr({a}, {b}) END AS r FROM b"
    for i, a in enumerate(_NUMBERS) for j, b in enumerate(_NUMBERS) if i < j
)
_STEPS = {
    "load": "SELECT count(*) FROM r", "drop rows with missing values": f"SELECT count(*) FROM r WHERE {_NO_NULL}",
    "drop duplicate features": f"SELECT count(*) FROM (SELECT DISTINCT {', '.join(FEATURES)} FROM r WHERE {_NO_NULL})",
    "remove outliers": f"SELECT count(*) FROM (SELECT DISTINCT {', '.join(FEATURES)} FROM r WHERE {_NO_NULL} AND Income < 500000 AND Year_Birth >= 1900)",
    "encode categories": f"SELECT count(*) FROM (SELECT DISTINCT {', '.join(FEATURES)} FROM r WHERE {_NO_NULL} AND Income < 500000 AND Year_Birth >= 1900)",
    "drop columns and duplicate rows": "SELECT count(*) FROM cl",
}
_LOG = "SELECT step, action, n AS rows, coalesce(lag(n) OVER (ORDER BY step) - n, 0) AS removed FROM (" + " UNION ALL ".join(
    f"SELECT {i + 1}::INT AS step, '{a}' AS action, ({sql}) AS n" for i, (a, sql) in enumerate(_STEPS.items())
) + ")"


SQL: dict[str, str] = {
    "rfm_features": f"""SELECT o_custkey AS c_custkey, date_diff('day', max(o_orderdate::DATE), DATE '{LAST_DAY}') AS recency_days, count(*) AS frequency, {_CENTS.format("sum(spent)")} AS monetary
        FROM orders JOIN (SELECT l_orderkey, sum({_AMOUNT}) AS spent FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""",
    "behaviour_table": q("SELECT * FROM b"),
    "family_scores": q(" UNION ALL ".join(map(_scored, GIVEN.values()))),
    "clean_log": q(_LOG),
    "corr_wide": q(_WIDE_CORR, 6, "r"),
    "suspicious_incomes": q("SELECT Income AS value, count(*) AS n FROM b WHERE Income >= 9900 GROUP BY Income"),
    "scan_inferred": "SELECT * FROM customer",
    "scan_tsv": "SELECT * FROM nation",
    "scan_csv": "SELECT * FROM customer",
    "sink_csv_roundtrip": "SELECT * FROM region",
    "sink_stamped": "SELECT * FROM region",
    "feature_report": q("""SELECT "column" AS section, statistic AS key, value FROM (""" + " UNION ALL ".join(_describe(c, "f", "value") for c in [*AXES, "AvgPerPurchase"]) + ")", 6, "value"),
    "archive_features": q(f"SELECT ID, {', '.join(roles.BINARY)}, Education, Marital_Status FROM b"),
    "project_features": q("SELECT ID, Product_HHI, Store_Preference, NumWebVisitsMonth AS Web_Engagement FROM f", 6, "Product_HHI Store_Preference"),
    "drop_columns": q(f"SELECT * EXCLUDE ({', '.join(roles.DROPPED)}) FROM b"),
    "select_numeric": q("SELECT * EXCLUDE (Education, Marital_Status, Dt_Customer) FROM b"),
    "dropna_any": q(f"SELECT * FROM b WHERE {_NO_NULL}"),
    "filter_outliers": q("SELECT ID, Year_Birth, Income FROM b WHERE NOT coalesce(Income >= 500000, false) AND NOT coalesce(Year_Birth < 1900, false)"),
    "outlier_records": q("SELECT ID, Year_Birth, Income, 'suspicious income' AS reason FROM b WHERE Income >= 500000 UNION ALL SELECT ID, Year_Birth, Income, 'too old' FROM b WHERE Year_Birth < 1900"),
    "isin_filter": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "profile_missing": q(_union("""SELECT '{0}' AS "column", count(*) - count({0}) AS n_missing, round(100.0 * (count(*) - count({0})) / count(*), 2) AS pct FROM r""", RAW)),
    "rows_with_missing": q(f"SELECT count(*) AS n_rows, count(*) FILTER (NOT ({_NO_NULL})) AS n_with_missing FROM r"),
    "dup_full_row": q(_dups(RAW)),
    "dup_exclude_id": q(_dups(FEATURES)),
    "dup_groups": q("SELECT Year_Birth, Education, Marital_Status, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1"),
    "dup_size_hist": q(f"SELECT n, count(*) AS n_groups, n * count(*) AS n_rows FROM {_groups(FEATURES)} WHERE n > 1 GROUP BY n"),
    "dup_ids": q("SELECT ID, count(*) AS n FROM r GROUP BY ID HAVING count(*) > 1"),
    "dup_hidden": q(_HIDDEN),
    "duplicate_group_members": q(f"SELECT * FROM (SELECT count(*) OVER w AS n, min(ID) OVER w AS first_key, ID AS member FROM r WINDOW w AS (PARTITION BY {', '.join(FEATURES)})) WHERE n > 1"),
    "dedupe_features": q(f"SELECT min(ID) AS ID, Year_Birth, Income FROM r GROUP BY {', '.join(FEATURES)}"),
    "dup_rows_sorted": q(f"SELECT ID, n, copy::INT AS copy FROM (SELECT ID, count(*) OVER w AS n, row_number() OVER w AS copy FROM r WINDOW w AS (PARTITION BY {', '.join(RAW)})) WHERE n > 1"),
    "dup_documents": _dups(["text"], "documents"),
    "categorical_freq": q(_FREQ.format("Education", "b")),
    "cardinality_class": q(_union(_CARD, ["Education", "Marital_Status", "Dt_Customer"])),
    "basic_info": q(f"SELECT count(*) AS n_rows, max(len(ts)) AS n_columns, max(len(list_filter(ts, lambda t: t <> 'VARCHAR'))) AS n_other, max(len(list_filter(ts, lambda t: t = 'VARCHAR'))) AS n_text FROM (SELECT [{', '.join(f'typeof({c})' for c in RAW)}] AS ts FROM b)"),
    "column_info": q(_union("SELECT '{0}' AS \"column\", CASE any_value(typeof({0})) WHEN 'VARCHAR' THEN 'string' ELSE lower(any_value(typeof({0}))) END AS type, count(*) - count({0}) AS n_missing, count(DISTINCT {0}) AS n_distinct FROM b", RAW)),
    "validate_clean": q(f"""SELECT *, n_missing = 0 AND n_irregular = 0 AND date_ok AS all_passed FROM (
        SELECT {' + '.join(f'count(*) - count({c})' for c in RAW)} AS n_missing, count(*) FILTER ({_MAPPED} = 'FURNITURE') AS n_irregular, count(*) FILTER (Year_Birth < 1900) AS too_old,
        count(*) FILTER (Year_Birth > 2006) AS too_young, count(*) FILTER (Income >= 500000) AS suspicious_income, bool_and(strptime(Dt_Customer, '%d-%m-%Y') IS NOT NULL) AS date_ok
        FROM b WHERE {_NO_NULL} AND NOT Income >= 500000 AND NOT Year_Birth < 1900)"""),
    "validate_features": q(_union("SELECT '{0}' AS feature, count(*) - count({0}) AS n_missing, count(*) FILTER (isinf({0}::DOUBLE)) AS n_infinite, var_samp({0}) AS variance, coalesce(var_samp({0}) < 0.01, false) AS low_variance FROM f", AXES), 0, "variance"),
    "quality_summary": q(f"SELECT n_rows, missing_cells, round(100.0 * missing_cells / (n_rows * 29), 2) AS missing_pct, h.*, kd.surplus AS duplicate_keys FROM (SELECT count(*) AS n_rows, {_NULLS(RAW)} AS missing_cells FROM r), ({_HIDDEN}) h, ({_dups(['ID'])}) kd"),
    "outlier_binary": q(_union(_BIN, [*roles.BINARY, "Kidhome"])),
    "outlier_iqr_count": q(_iqr(roles.COUNT), 6, "q1 q3 low high"),
    "outlier_iqr_spending": q(_iqr(roles.SPENDING), 6, "q1 q3 low high"),
    "outlier_iqr_events": q(_iqr(["value"], "events"), 6, "q1 q3 low high"),
    "outlier_top3": f"SELECT event_id, value FROM events WHERE value > {_EVENT_BOUND} ORDER BY value DESC, event_id LIMIT 3",
    "outlier_income": q(f"SELECT * FROM ({_iqr(['Income'])}), (SELECT count(*) FILTER (Income >= 9900) AS n_suspicious, coalesce(list_sort(list(DISTINCT Income) FILTER (Income >= 9900)), []) AS suspicious FROM b)", 6, "q1 q3 low high"),
    "outlier_special": q(_BIRTH),
    "outlier_constant": q(_union(_CONST, [*roles.CONSTANT, "Kidhome"])),
    "outlier_summary": q(_SUMMARY),
    "extreme_scaled": """WITH s AS (SELECT (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS v FROM events) SELECT 'value' AS feature, round(min(v), 6) AS least, round(max(v), 6) AS greatest,
        count(*) FILTER (abs(v) > 3) AS n_extreme, round(100.0 * count(*) FILTER (abs(v) > 3) / count(v), 4) AS pct FROM s HAVING min(v) < -3 OR max(v) > 3""",
    "remap_category": q(f"SELECT ID, {_MAPPED} AS Marital_Status FROM b"),
    "remap_counts": q("SELECT 'FURNITURE' AS old, 'HOUSEHOLD' AS new, count(*) FILTER (Marital_Status = 'FURNITURE') AS n FROM b"),
    "parse_date": q("SELECT ID, strptime(Dt_Customer, '%d-%m-%Y') AS Dt_Customer FROM b"),
    "ordinal_encode": q(f"SELECT ID, Education, CASE WHEN Education <> 'MIDDLE EAST' THEN ({_CODE})::INT END AS Education_ord FROM b"),
    "rare_group": "WITH n AS (SELECT c_custkey, n_name, count(*) OVER (PARTITION BY n_name) / count(*) OVER () AS share FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, CASE WHEN share < 0.04 THEN 'Other' ELSE n_name END AS n_name FROM n",
    "onehot_marital": q(f"SELECT ID, {', '.join(f'''({_GROUPED} = '{d[8:]}')::INT AS {d}''' for d in DUMMIES)} FROM b"),
    "detect_binary": q(_union("""SELECT '{0}' AS "column", coalesce(bool_and({0} IN (0, 1)), false) AS is_binary FROM b""", _INTS)),
    "binary_cast": q("SELECT ID, (Kidhome = 1)::INT AS Kidhome_bin FROM b"),
    "clean_pipeline": q("SELECT * FROM cl"),
    "audit_onehot": q(f"SELECT {', '.join(f'''count(*) FILTER ({_GROUPED} = '{d[8:]}') AS {d}''' for d in DUMMIES)} FROM b"),
    "audit_ordinal": q(f"SELECT Education, min({_CODE})::INT AS code FROM b GROUP BY Education"),
    "count_by_year": q("SELECT year(strptime(Dt_Customer, '%d-%m-%Y')) AS year, count(*) AS n FROM b GROUP BY 1"),
    "count_by_month": q("SELECT month(strptime(Dt_Customer, '%d-%m-%Y')) AS month, count(*) AS n FROM b GROUP BY 1"),
    "compare_quality": q(_QUALITY),
    "compare_categories": q(_CHANGES),
    "category_set_diff": q(f"SELECT category, CASE WHEN n_after = 0 THEN 'before' WHEN n_before = 0 THEN 'after' ELSE 'both' END AS side FROM ({_CHANGES})"),
    "compare_describe": q(_both(DESCRIBED, "r", "cl"), 6, "before after diff pct"),
    "compare_thresholds": q(" UNION ALL ".join(f"SELECT '{n}' AS test, (SELECT count(*) FROM r WHERE {t}) AS before, (SELECT count(*) FROM cl WHERE {t}) AS after" for n, t in (("income >= 5000", "Income >= 5000"), ("born < 1900", "Year_Birth < 1900")))),
    "compare_outlier_dist": q(_both([*SPENT, "Recency"], "b", "bo"), 6, "before after diff pct", ", bo AS (SELECT * FROM b WHERE NOT coalesce(Income >= 500000, false) AND NOT coalesce(Year_Birth < 1900, false))"),
    "summarize_changes": q(f"SELECT *, rows_before - rows_after AS rows_removed, 100.0 * (rows_before - rows_after) / rows_before AS pct_removed FROM ({_QUALITY})", 6, "pct_removed"),
    **{name: q(f"SELECT ID, {', '.join(c.split())} FROM f", 6, " ".join(x for x in c.split() if x not in _WHOLE)) for name, c in _FEATS.items()},
    "feat_children": q("SELECT TotalChildren, count(*) AS n FROM f GROUP BY 1"),
    "feat_dominant_product": q("SELECT ID, Dominant_Product, Top_Product_Share FROM p", 6, "Top_Product_Share"),
    "feat_web_engagement": q("SELECT ID, NumWebVisitsMonth AS Web_Engagement FROM b"),
    "transform_decision": "SELECT 'value' AS feature, round(skewness(value), 6) AS skew, min(value) < 0 AS has_negative, count(*) FILTER (value = 0) AS n_zero, CASE WHEN abs(skewness(value)) < 0.5 THEN 'none' WHEN min(value) < 0 OR count(*) FILTER (value = 0) > 0 THEN 'yeo-johnson' ELSE 'box-cox' END AS method FROM events",
    "boxcox_fixed": "SELECT event_id, round((pow(value, 0.25) - 1) / 0.25, 6) + 0.0 AS y FROM events",
    "yeojohnson_fixed": "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.75) - 1) / 0.75 ELSE -(pow(1 - c_acctbal, 1.25) - 1) / 1.25 END, 6) + 0.0 AS y FROM customer",
    "boxcox_llf_grid": q(" UNION ALL ".join(_llf("value", "events", "ln(value)", _BC(x).replace("{", "").replace("}", ""), [x]) for x in LAMBDAS), 3, "llf"),
    "yeojohnson_llf_grid": q(" UNION ALL ".join(_llf("c_acctbal", "customer", "sign(c_acctbal) * ln(abs(c_acctbal) + 1)", _YJ(x), [x]) for x in (0.5, 1.0, 1.5, 2.0)), 3, "llf"),
    "corr_matrix": q(_CORR, 6, "r"),
    "high_corr_pairs": q(_HIGH, 6, "r"),
    "max_corr_pair": q(f"SELECT f1, f2, r FROM ({_CORR}) WHERE r IS NOT NULL ORDER BY abs(r) DESC, i, j LIMIT 1", 6, "r"),
    "pca_pair_reduce": q("SELECT ID, Recency, ((TotalPurchases - avg(TotalPurchases) OVER ()) / stddev_pop(TotalPurchases) OVER () + (Total_Spent - avg(Total_Spent) OVER ()) / stddev_pop(Total_Spent) OVER ()) / sqrt(2) AS PC1_TotalPurchases_Total FROM f", 6, "PC1_TotalPurchases_Total"),
    "pca_pair_variance": q(f"SELECT f1, f2, r, (1 + abs(r)) / 2 AS share FROM ({_HIGH})", 6, "r share"),
    "describe_stats": q(" UNION ALL ".join(_describe(c, "b", "value") for c in DESCRIBED), 6, "value"),
    "std_samp_pop": q(_union("SELECT '{0}' AS feature, stddev_samp({0}) AS samp, stddev_pop({0}) AS pop, var_samp({0}) AS \"var\" FROM b", SPENT), 1, "samp pop var"),
    "quantiles_exact": q(_union("SELECT '{0}' AS feature, quantile_cont({0}, 0.25) AS p25, quantile_cont({0}, 0.5) AS p50, quantile_cont({0}, 0.99) AS p99 FROM b", SPENT), 6, "p25 p50 p99"),
    "skew_adjusted": "SELECT 'c_acctbal' AS feature, round(skewness(c_acctbal), 6) AS skew FROM customer",
    "value_counts_pct": _FREQ.format("event_type", "events"),
    "distinct_values": q("SELECT count(DISTINCT Education) AS n, list_sort(list(DISTINCT Education)) AS found FROM b"),
    "kde": """WITH g AS (SELECT min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(value), -0.2) AS h, count(value) AS n FROM events),
        x AS (SELECT lo + i * (hi - lo) / 49 AS x, h, n FROM g, (SELECT unnest(range(50)) AS i))
        SELECT round(x, 6) + 0.0 AS x, round(sum(exp(-0.5 * pow((x - value) / h, 2)) / (n * h * sqrt(2 * pi()))), 6) + 0.0 AS density FROM x, events WHERE value IS NOT NULL GROUP BY x.x""",
    "histogram_bins": """WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS n FROM events, m GROUP BY 1)
        SELECT g AS bin, round(lo + g * ((hi - lo) / 30), 6) AS low, round(lo + (g + 1) * ((hi - lo) / 30), 6) AS high, coalesce(n, 0) AS n FROM m, (SELECT unnest(range(30)) AS g) LEFT JOIN c ON bin = g""",
    "boxplot_stats": q(_union("""SELECT '{0}' AS feature, q1, median, q3, min(v) FILTER (i) AS whisker_low, max(v) FILTER (i) AS whisker_high, count(*) FILTER (NOT i) AS n_outside FROM
        (SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS i FROM (SELECT {0} AS v, quantile_cont({0}, 0.25) OVER () AS q1, quantile_cont({0}, 0.5) OVER () AS median, quantile_cont({0}, 0.75) OVER () AS q3 FROM b)) GROUP BY ALL""", SPENT), 6, "q1 median q3 whisker_low whisker_high"),
    "scale_standard": q("SELECT * FROM z", 6, " ".join(AXES)),
    "scale_robust": q(f"SELECT ID, {_each(AXES, '({0} - quantile_cont({0}::DOUBLE, 0.5) OVER ()) / (quantile_cont({0}::DOUBLE, 0.75) OVER () - quantile_cont({0}::DOUBLE, 0.25) OVER ()) AS {0}')} FROM f", 6, " ".join(AXES)),
    "pre_scale_stats": q(" UNION ALL ".join(_STATS.format(c, "stddev_samp", "f") for c in AXES), 4, "mean std median iqr skew"),
    "post_scale_stats": q(" UNION ALL ".join(_STATS.format(c, "stddev_pop", "z") for c in AXES), 6, "mean std least greatest median iqr skew"),
    "validate_scaling": q(_union("SELECT '{0}' AS feature, abs(avg({0})) < 1e-10 AS centred, abs(stddev_pop({0}) - 1) < 1e-10 AS unit_spread, count(*) - count({0}) AS n_missing FROM z", AXES)),
    "scaling_preserves": q("SELECT bool_and(x.Education IS NOT DISTINCT FROM y.Education) AS Education, bool_and(x.Income IS NOT DISTINCT FROM y.Income) AS Income FROM f x FULL JOIN f y USING (ID)"),
    "assign_clusters": q("SELECT ID, cluster FROM k"),
    "update_centroids": q(f"SELECT cluster, count(*) AS n, {_CENTER} FROM k GROUP BY cluster", 6, " ".join(AXES)),
    "inertia": q("SELECT sum(d2) AS inertia FROM k", 4, "inertia"),
    "kmeanspp_weights": q("SELECT ID, d2, d2 / sum(d2) OVER () AS p, sum(d2) OVER (ORDER BY ID) / sum(d2) OVER () AS cum FROM k", 6, "d2 p cum"),
    "init_random": q(f"SELECT {', '.join(AXES)} FROM z ORDER BY md5('42:' || ID), ID LIMIT 3", 12, " ".join(AXES)),
    "pca_centers_given": q(
        "SELECT cluster::INT AS cluster, " + ", ".join(" + ".join(f"(avg({a}) - ({m})) * ({w})" for a, m, w in zip(AXES, GIVEN_MEANS, row)) + f" AS PC{i + 1}" for i, row in enumerate(GIVEN_LOADINGS)) + " FROM k GROUP BY cluster",
        6, "PC1 PC2",
    ),
    "kmeans_lloyd_bounded": q(_step("z", "c2"), 6, " ".join(AXES), _LLOYD),
    "kmeans_lloyd_fixed": q(_step("z", "c2"), 6, " ".join(AXES), _LLOYD),
    "k_curve": q("SELECT k, wcss, silhouette FROM c", 4, "wcss silhouette", _CURVE),
    "elbow_point": q("SELECT k, distance FROM t", 6, "distance", _CURVE),
    "vote_k": q("SELECT arg_max(k, distance) AS elbow_k, arg_max(k, silhouette) AS silhouette_k, arg_max(k, distance) AS chosen_k FROM t", more=_CURVE),
    "silhouette_exact": q("SELECT avg(s) AS silhouette FROM s", 6, "silhouette", "," + _SIL),
    "negative_silhouette": q("SELECT count(*) FILTER (s < 0) AS n, round(100.0 * count(*) FILTER (s < 0) / count(*), 4) AS pct FROM s", 6, "", "," + _SIL),
    "squared_silhouette": q("SELECT avg(s) AS silhouette FROM s", 6, "silhouette", "," + _SSIL),
    "davies_bouldin": q("SELECT avg(worst) AS davies_bouldin FROM w", 6, "davies_bouldin", "," + _DB),
    "calinski_harabasz": q("SELECT (bt / (kk - 1)) / (wt / (n - kk)) AS calinski_harabasz FROM bw, wi", 4, "calinski_harabasz", "," + _CH),
    "cluster_balance": q("SELECT min(n) / max(n) AS balance FROM (SELECT count(*) AS n FROM k GROUP BY cluster)", 6, "balance"),
    "cluster_sizes": q(_SIZES, 6, "pct"),
    "cluster_profile": q(_profile(["Income", "Total_Spent"]), 6, "Income Total_Spent"),
    "cluster_profile_long": q(_union("SELECT cluster, '{0}' AS feature, avg({0}) AS mean FROM k GROUP BY cluster", AXES), 6, "mean"),
    "posthoc_education": q(_levels("Education_ord", range(5)), 6, "pct"),
    "posthoc_lifestage": q(_levels("Life_Stage", range(5)), 6, "pct"),
    "posthoc_preferences": q(_profile(_PREFS.split()), 6, _PREFS),
    "posthoc_dominant": q(_levels("Dominant_Product", [f"'{n}'" for n in ("Wine", "Fruit", "Meat", "Fish", "Sweet", "Gold")]), 6, "pct"),
    "posthoc_top_share": q(_profile(["Top_Product_Share"]), 6, "Top_Product_Share"),
}
