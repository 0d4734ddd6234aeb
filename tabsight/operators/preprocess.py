"""Fit-on-train preprocessing.

Fitting computes small per-column parameter tables with DataFrame aggregations
over the training rows only; applying them is plain column expressions (imputation,
scaling) plus Spark ML ``StringIndexer``/``OneHotEncoder``/``VectorAssembler`` for
the encoded feature vector.  Validation/test rows never touch a fitted value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tabsight.functions import exprs as X
from tabsight.operators import stats
from tabsight.operators.ordered import column_quantiles

UNKNOWN = "<unknown>"
MISSING = "missing"


def split_columns(df: DataFrame, exclude: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns; booleans count as numeric features."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if X.is_numeric_type(f.dataType) or isinstance(f.dataType, T.BooleanType):
            num.append(f.name)
        else:
            cat.append(f.name)
    return num, cat


def fit_medians(train: DataFrame, cols: list[str]) -> DataFrame:
    """Exact median per numeric column over training rows; 0.0 when a column is all missing."""
    if not cols:
        return train.sparkSession.createDataFrame([], "column string, median double")
    found = column_quantiles(train, {c: X.as_double(c) for c in cols}, [0.5])
    return train.sparkSession.createDataFrame([(c, found.get(c, {}).get(0.5, 0.0)) for c in cols], "column string, median double")


def fit_modes(train: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value per column (ties: smallest), 'missing' when all values are missing."""
    if not cols:
        return train.sparkSession.createDataFrame([], "column string, mode string")
    cis = [c for c in stats.columns_of(train) if c.name in cols]
    d = stats.distinct_summary(stats.value_counts(train, cis)).select("column", F.col("top_value").alias("mode"))
    names = train.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(d, "column", "left").select("column", F.coalesce("mode", F.lit(MISSING)).alias("mode"))


def fit_scaler(imputed_train: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std per column; a constant column scales by 1."""
    if not cols:
        return imputed_train.sparkSession.createDataFrame([], "column string, mean double, scale double")
    row = imputed_train.agg(*[F.avg(X.as_double(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                            *[F.stddev_pop(X.as_double(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"),
                 F.when((F.col(f"s{i}") == 0) | F.col(f"s{i}").isNull(), F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale"))
        for i, c in enumerate(cols)])))


def fit_vocabulary(train: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted category list per column with codes 0..k-1 (lexicographic order)."""
    cis = [c for c in stats.columns_of(train) if c.name in cols]
    vc = stats.value_counts(train, cis).select("column", F.col("value").alias("category"), "count")
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy("category")  # one partition per column: vocabulary sized
    return vc.withColumn("code", F.row_number().over(w) - 1)


@dataclass
class Preprocessor:
    """Fitted parameters (small tables collected to the driver: one row per column / category)."""
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    encoder: object | None = None  # fitted pyspark.ml PipelineModel for categorical columns
    feature_names: list[str] = field(default_factory=list)

    def impute(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.numeric:
            out = out.withColumn(c, F.coalesce(X.as_double(c), F.lit(float(self.medians.get(c, 0.0)))))
        for c in self.categorical:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c, MISSING))))
        return out

    def scale(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.numeric:
            out = out.withColumn(c, (F.col(c) - F.lit(self.means[c])) / F.lit(self.scales[c]))
        return out

    def transform(self, df: DataFrame, output_col: str = "features") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        out = self.scale(self.impute(df))
        if self.encoder is not None:
            out = self.encoder.transform(out)
        inputs = list(self.numeric) + [f"{c}__ohe" for c in self.categorical]
        return VectorAssembler(inputCols=inputs, outputCol=output_col, handleInvalid="keep").transform(out) \
            .drop(*[f"{c}__idx" for c in self.categorical], *[f"{c}__ohe" for c in self.categorical])


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> Preprocessor:
    """Fit imputation, scaling and one-hot encoding on ``train`` only."""
    pp = Preprocessor(list(numeric), list(categorical))
    pp.medians = {r["column"]: r["median"] for r in fit_medians(train, numeric).collect()}
    pp.modes = {r["column"]: r["mode"] for r in fit_modes(train, categorical).collect()}
    imputed = pp.impute(train)
    sc = fit_scaler(imputed, numeric).collect()
    pp.means = {r["column"]: r["mean"] for r in sc}
    pp.scales = {r["column"]: r["scale"] for r in sc}
    names = list(numeric)
    if categorical:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import OneHotEncoder, StringIndexer
        idx = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__idx" for c in categorical],
                            stringOrderType="alphabetAsc", handleInvalid="keep")
        # the indexer's extra 'unseen' label is the last category; dropLast removes its slot -> all zeros
        ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=[f"{c}__ohe" for c in categorical],
                            dropLast=True)
        pp.encoder = Pipeline(stages=[idx, ohe]).fit(imputed)
        for c, labels in zip(categorical, pp.encoder.stages[0].labelsArray):
            names += [f"{c}_{v}" for v in labels]
    pp.feature_names = names
    return pp


@dataclass
class OrdinalPreprocessor:
    """X8/X9, for forecasting: lexicographic category codes fitted on train (unseen and missing values get the code
    after the last), numeric gaps filled with 0."""
    numeric: list
    categorical: list
    encoder: object = None

    @property
    def feature_names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def transform(self, df: DataFrame, output_col: str = "features") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        out = df
        for c in self.numeric:
            out = out.withColumn(c, F.coalesce(X.as_double(c), F.lit(0.0)))
        if self.encoder is not None:
            out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in self.categorical})
            out = self.encoder.transform(out)
        codes = [f"{c}__code" for c in self.categorical]
        return VectorAssembler(inputCols=[*self.numeric, *codes], outputCol=output_col, handleInvalid="keep").transform(out).drop(*codes)


def fit_ordinal(train: DataFrame, numeric: list[str], categorical: list[str]) -> OrdinalPreprocessor:
    from pyspark.ml.feature import StringIndexer
    if not categorical:
        return OrdinalPreprocessor(list(numeric), [])
    texts = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in categorical])
    codes = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__code" for c in categorical],
                          stringOrderType="alphabetAsc", handleInvalid="keep").fit(texts)
    return OrdinalPreprocessor(list(numeric), list(categorical), codes)


def ordinal_encode(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lexicographic codes fitted on train; unseen test values get the code after the last one."""
    from pyspark.ml.feature import StringIndexer
    if not cols:
        return train, test
    si = StringIndexer(inputCols=cols, outputCols=[f"{c}__code" for c in cols], stringOrderType="alphabetAsc",
                       handleInvalid="keep").fit(train.select(*[F.col(c).cast("string").alias(c) for c in cols]))

    def apply(d: DataFrame) -> DataFrame:
        d2 = d
        for c in cols:
            d2 = d2.withColumn(c, F.col(c).cast("string"))
        d2 = si.transform(d2)
        for c in cols:
            d2 = d2.withColumn(c, F.col(f"{c}__code")).drop(f"{c}__code")
        return d2
    return apply(train), apply(test)


def encode_labels(df: DataFrame, target: str, output_col: str = "label") -> tuple[DataFrame, list[str]]:
    """Label codes in lexicographic order of the label text (always indexed, Q8); rows without a label are left out
    (``missing_labels`` counts them)."""
    from pyspark.ml.feature import StringIndexer
    si = StringIndexer(inputCol="_tgt_str", outputCol=output_col, stringOrderType="alphabetAsc")
    d = df.withColumn("_tgt_str", F.col(target).cast("string")).where("_tgt_str is not null")
    model = si.fit(d)
    return model.transform(d).drop("_tgt_str"), list(model.labels)


def missing_labels(df: DataFrame, target: str) -> DataFrame:
    """An alert row for the rows without a label, which a supervised run leaves out; empty if there are none."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_missing(target, df.schema[target].dataType)).alias("gone"))
    share = F.col("gone") * 100.0 / F.col("n")
    return n.where("gone > 0").select(
        F.lit("missing_target").alias("alert_type"), F.lit(target).alias("column"), F.lit("warning").alias("severity"), share.alias("metric"),
        F.format_string("%d of %d rows have no value of the target '%s' and are left out.", F.col("gone"), F.col("n"), F.lit(target)).alias("message"),
        F.lit("Label these rows, or check why the target is missing.").alias("suggested_action"))


def vocabulary_usage(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Training vocabulary of ``col`` (lexicographic codes) with train and test counts;
    test values outside the vocabulary are counted on one '<unknown>' row whose code follows
    the last category (the slot one-hot encoding leaves all zero)."""
    vocab = fit_vocabulary(train, [col]).select("category", "code", F.col("count").alias("train_count"))
    k = vocab.agg(F.count(F.lit(1)).alias("k"))
    tc = test.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("category")) \
        .agg(F.count(F.lit(1)).alias("test_count"))
    known = vocab.join(tc, "category", "left").fillna(0, ["test_count"])
    unseen = tc.join(vocab, "category", "left_anti").agg(F.sum("test_count").alias("test_count"))
    unk = unseen.where(F.col("test_count").isNotNull()).withColumn("_k", F.lit(1)).join(
        k.withColumn("_k", F.lit(1)), "_k").select(F.lit(UNKNOWN).alias("category"), F.col("k").cast("int").alias("code"),
                                                   F.lit(0).cast("long").alias("train_count"), "test_count")
    return known.select("category", F.col("code").cast("int").alias("code"), "train_count",
                        F.col("test_count").cast("long").alias("test_count")).unionByName(unk)
