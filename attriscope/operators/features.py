"""Feature engineering and encoding (v1 and v2 pipelines) with a fitted manifest.

Fitted state is small and explicit: the constant columns that were dropped and
the sorted level vocabulary of each string column.  ``transform`` is then a
single projection of Catalyst expressions (``when(col = v, 1)`` dummies), so
scoring one row gives the same encoding as scoring the whole table.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.operators.profile import string_columns, zero_variance_columns

TARGET = "Attrition"
KEY = "EmployeeNumber"
# Score columns of the stand-in view: outputs of a scorer, never inputs.
SCORE_COLUMNS = ("RiskMargin", "Risk")
# Columns the scoring path always drops (fixed list of the scoring code).
SCORING_DROP = ("EmployeeCount", "Over18", "StandardHours", "Attrition")

RATIO_FEATURES = {
    "Income_Per_Year": ("MonthlyIncome", "TotalWorkingYears"),
    "Tenure_Ratio": ("YearsAtCompany", "TotalWorkingYears"),
    "Education_Income_Ratio": ("MonthlyIncome", "Education"),
    "Distance_Per_Income": ("DistanceFromHome", "MonthlyIncome"),
    "Years_Per_Promotion": ("YearsAtCompany", "YearsSinceLastPromotion"),
}


def ratio_features(df: DataFrame) -> DataFrame:
    """Five ``x / (y + 1)`` ratios (double division)."""
    return df.withColumns({
        name: F.col(num).cast("double") / (F.col(den) + F.lit(1)).cast("double")
        for name, (num, den) in RATIO_FEATURES.items()})


def label_binarize(col: str = TARGET):
    """Yes -> 1, No -> 0, anything else null."""
    c = F.col(col)
    return F.when(c == "Yes", F.lit(1)).when(c == "No", F.lit(0))


def dummy_name(col: str, value) -> str:
    return f"{col}_{value}"


@dataclass
class FittedFeatures:
    version: str
    dropped: list = field(default_factory=list)
    vocab: dict = field(default_factory=dict)      # string column -> sorted levels (all)
    numeric: list = field(default_factory=list)    # numeric input columns in order
    feature_names: list = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(s: str) -> "FittedFeatures":
        return FittedFeatures(**json.loads(s))

    def dummy_columns(self):
        out = []
        for c, levels in self.vocab.items():
            for v in levels[1:]:  # first level in sort order dropped
                out.append((c, v))
        return out

    def transform(self, df: DataFrame, keep: tuple = (KEY,), with_label: bool = True) -> DataFrame:
        """Encode ``df`` into the fitted feature columns (missing inputs give 0 dummies)."""
        src = ratio_features(df) if self.version == "v2" else df
        cols = [F.col(k) for k in keep if k in src.columns]
        cols += [F.col(c).alias(c) for c in self.numeric]
        if with_label and TARGET in src.columns:
            cols.append(label_binarize().alias(TARGET))
        for c, v in self.dummy_columns():
            x = F.col(c) if c in src.columns else F.lit(None).cast("string")
            cols.append(F.when(x == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(dummy_name(c, v)))
        return src.select(*cols)


def fit_features(df: DataFrame, version: str = "v1", exclude=SCORE_COLUMNS, key: str = KEY) -> FittedFeatures:
    """Fit the v1 (constants, label, one-hot) or v2 (ratios first) pipeline.

    The wide form has a column for each level, so the driver holds the vocabulary as it names the columns; for columns
    of very many levels use :mod:`attriscope.operators.sparse`, whose vocabulary is a table.
    """
    src = ratio_features(df) if version == "v2" else df
    src = src.drop(*[c for c in exclude if c in src.columns])
    dropped = [r["column_name"] for r in zero_variance_columns(src).collect()]
    src = src.drop(*dropped)
    strings = [c for c in string_columns(src) if c != TARGET]
    vocab = {}
    for c in strings:
        vocab[c] = sorted(r[0] for r in src.select(c).where(F.col(c).isNotNull()).distinct().collect())
    numeric = [f.name for f in src.schema.fields
               if f.name not in strings and f.name not in (TARGET, key)
               and not isinstance(f.dataType, (T.StringType, T.BooleanType))]
    ff = FittedFeatures(version=version, dropped=dropped, vocab=vocab, numeric=numeric)
    ff.feature_names = numeric + [dummy_name(c, v) for c, v in ff.dummy_columns()]
    return ff


def one_hot_long(df: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """One-hot encoding in long form, for any number of levels: (key, column_name, level) for each dummy that is 1.

    The first level in sort order of each column is dropped, as in the wide form.  The first levels are
    one row for each column (a partial aggregate); nothing is collected.
    """
    first = df.agg(*[F.min(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("level"), F.col(f"m{i}").alias("first")) for i, c in enumerate(columns)])
    long = df.select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in columns if c != key]).crossJoin(F.broadcast(first))  # one row
    return long.select(key, F.inline(cells)).where(F.col("level") != F.col("first")).drop("first")


def drop_for_scoring(df: DataFrame, cols=SCORING_DROP) -> DataFrame:
    """Drop the fixed non-feature columns; absent ones are ignored (``DataFrame.drop`` semantics)."""
    return df.drop(*cols)


def align_features(df: DataFrame, feature_names: list[str], keep: tuple = (KEY,)) -> DataFrame:
    """Select exactly the manifest's features in order; absent ones become 0, extras are dropped."""
    have = set(df.columns)
    cols = [F.col(k) for k in keep if k in have]
    cols += [F.col(f"`{c}`") if c in have else F.lit(0).alias(c) for c in feature_names]
    return df.select(*cols)


def seeded_sample(df: DataFrame, n: int, key: str = KEY, seed: int = 42) -> DataFrame:
    """Fixed-size sample without replacement: the n smallest MD5 hashes of seed and key.

    A distributed top-n (no full sort); asking for more rows than exist returns all rows.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(h, F.col(key)).limit(n)
