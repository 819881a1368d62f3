"""Column roles, thresholds and mappings: what is applied to which column."""

from __future__ import annotations

# Names of columns and categories, and thresholds, as the data and the results define them.

ID = "ID"
SPENDING = ["MntWines", "MntFruits", "MntMeatProducts", "MntFishProducts", "MntSweetProducts", "MntGoldProds"]
CHANNELS = ["NumWebPurchases", "NumCatalogPurchases", "NumStorePurchases", "NumDealsPurchases"]
COUNT = ["Kidhome", "Teenhome", "Recency", *CHANNELS, "NumWebVisitsMonth"]
BINARY = ["AcceptedCmp1", "AcceptedCmp2", "AcceptedCmp3", "AcceptedCmp4", "AcceptedCmp5", "Complain", "Response"]
INCOME, SPECIAL = ["Income"], ["Year_Birth"]
CONSTANT = ["Z_CostContact", "Z_Revenue"]
ROLES = {
    **dict.fromkeys(BINARY, "binary"), **dict.fromkeys(COUNT, "count"), **dict.fromkeys(SPENDING, "spending"),
    **dict.fromkeys(INCOME, "income"), **dict.fromkeys(SPECIAL, "special"), **dict.fromkeys(CONSTANT, "constant"),
}
FEATURES = ["Year_Birth", "Education", "Marital_Status", "Income", "Kidhome", "Teenhome", "Dt_Customer", "Recency", *SPENDING, *CHANNELS, "NumWebVisitsMonth", *BINARY, *CONSTANT]

#: Dropped after cleaning; the binary ones are archived.
DROPPED = [*BINARY, ID, *CONSTANT, "Education", "Marital_Status"]

SUSPICIOUS_INCOME, OLDEST_BIRTH, YOUNGEST_BIRTH = 500_000, 1900, 2006
REPORT_YEAR, FEATURE_YEAR, MOST_AGE = 2024, 2014, 100
RARE = 0.01
IQR_FACTOR = 3.0
SKEW = {"demographic": 0.5, "product_channel": 0.8, "rfm": 1.0}
HIGH_CORRELATION = 0.7

#: Values as the raw table has them.
MARITAL_MAP = {"Alone": "Single", "YOLO": "Single", "Absurd": "Other"}
EDUCATION_ORDER = ["Basic", "2n Cycle", "Graduation", "Master", "PhD"]
MARITAL_WEIGHT = {"Single": 0, "Divorced": 0, "Widow": 0, "Together": 1, "Married": 2}

#: The same roles for the stand-in table built from the driver's tables.
STAND_IN_MARITAL_MAP = {"FURNITURE": "HOUSEHOLD"}
STAND_IN_EDUCATION_ORDER = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
STAND_IN_MARITAL_WEIGHT = {"AUTOMOBILE": 0, "BUILDING": 0, "HOUSEHOLD": 1, "MACHINERY": 2}

#: K that each family is finally trained with, on robust-scaled and on standard-scaled inputs; features that are transformed when skewed, with
#: their new names; features that may be clustered; the pairs that the trained models replace by a component.
TRAINED_K = {"demographic": 3, "product_channel": 4, "rfm": 2}
STANDARD_K = {"demographic": 2, "product_channel": 3, "rfm": 2}
TRANSFORMS = {
    "demographic": {"Age": "Age", "Income": "Income", "Dependency_Ratio": "Dependency_Ratio"},
    "product_channel": {"Total_Spent": "Total_Spent_Transformed"},
    "rfm": {"AvgPerPurchase": "AvgPerPurchase_Transformed", "Income_per_Family_Member": "Income_per_Family_Member_Transformed"},
}
CANDIDATES = {
    "demographic": ["Age", "Income", "Dependency_Ratio"],
    "product_channel": ["Total_Spent_Transformed", "TotalPurchases", "Product_HHI", "Store_Preference", "Web_Engagement"],
    "rfm": ["Recency", "TotalPurchases", "Total_Spent", "AvgPerPurchase_Transformed", "Income", "Income_per_Family_Member_Transformed"],
}
TRAINED_PAIRS = {
    "demographic": [],
    "product_channel": [("Total_Spent_Transformed", "TotalPurchases")],
    "rfm": [("TotalPurchases", "Total_Spent"), ("AvgPerPurchase_Transformed", "Income")],
}
REFERENCE = {
    "demographic": ["Education_ord", "Life_Stage"],
    "product_channel": ["Wine_Preference", "Meat_Preference", "Fish_Preference", "Fruit_Preference", "Sweet_Preference", "Gold_Preference", "Dominant_Product", "Top_Product_Share"],
    "rfm": [],
}


def assert_columns(df, required: list[str]) -> None:
    """Raises ValueError before any work is done if a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
