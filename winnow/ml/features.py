"""Preparing features: choosing a target, dropping useless columns, encoding, splitting, engineering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import (DATE_WORDS, c, flat_cols, is_date, is_integral, is_numeric, is_text, name_has, num,
                              numeric_cols, require, text_cols)
from ..functions.dates import as_date, date_parts
from ..functions.stats import correlations, distinct_counts, exact_quantiles, rows_to_df, stats_row
from ..operators.columns import ratio_feature, text_metrics
from ..operators.encode import encode_frequency

# Names that suggest a target, and names of money-like or score-like numbers.
TARGET_WORDS = ("target", "label", "output", "result", "class", "y", "churn", "status", "price", "outcome", "survived",
                "default")
VALUE_WORDS = ("price", "cost", "salary", "amount", "revenue", "rate", "score", "val")
TARGET_HINTS = ("target", "label", "class", "output", "result", "price", "salary", "income", "score", "rating",
                "prediction", "y", "status", "category", "survived", "approved", "churn")


def coarse_distinct(df: DataFrame, cols: Sequence[str], small: int, share: float | None = None) -> tuple[dict, int]:
    """Distinct values per column, as exact as rules need them, and the number of rows.

    Exact up to ``small`` and around ``share`` of the rows; elsewhere the sketch's estimate is
    far enough from either limit to decide."""
    got = stats_row(df, {"n": F.count(F.lit(1)), **{n: F.approx_count_distinct(c(n), 0.02) for n in cols}})
    n = got["n"]
    need = [x for x in cols if got[x] <= 2 * small + 10 or (share and abs(got[x] - share * n) <= 0.15 * share * n)]
    exact = distinct_counts(df, need)
    return {x: exact.get(x, got[x]) for x in cols}, n


def target_scores(df: DataFrame) -> DataFrame:
    """(column, score, task) for every column: name, position and number of distinct values."""
    cols = flat_cols(df)
    u, n = coarse_distinct(df, cols, 15, 0.6)
    rows = []
    for i, name in enumerate(cols):
        if not u[name]:
            continue
        low, score, task = name.lower(), 0, "classification"
        for w in TARGET_WORDS:
            if w == low:
                score += 50
                break
            if w in low:
                score += 30
                break
        if name == cols[-1]:
            score += 20
        if 2 <= u[name] <= 10:
            score += 25
        elif u[name] == 1:
            score -= 50
        elif is_numeric(df, name) and u[name] > 15:
            task = "regression"
            score += 35 if any(w in low for w in VALUE_WORDS) else 15
        elif not is_numeric(df, name) and u[name] > 0.6 * n:
            score -= 40
        rows.append((i, name, score, task))
    return rows_to_df(df.sparkSession, rows, "pos int, column string, score int, task string")


def detect_target(df: DataFrame) -> DataFrame:
    """The best-scoring column (the first one on ties) with its task and a confidence of 20..95."""
    s = target_scores(df).orderBy(F.desc("score"), "pos").limit(1)
    return s.select(F.col("column").alias("target"), "task",
                    F.greatest(F.lit(20), F.least(F.lit(95), F.col("score"))).alias("confidence"))


def suggest_targets(df: DataFrame, k: int = 5) -> DataFrame:
    """Up to k candidate targets: named like one (high), the last column (medium), other usable ones (low)."""
    cols = flat_cols(df)
    u, _ = coarse_distinct(df, cols, 20)
    nums = [n for n in numeric_cols(df) if u[n]]
    cats = [n for n in text_cols(df) if 2 <= u[n] <= 20]

    def task(n):
        return "classification" if n in cats or 2 <= u[n] <= 10 else "regression"

    rows = [(n, task(n), "high") for n in cols if any(h in n.strip().lower() for h in TARGET_HINTS)
            and (n in nums or n in cats)]
    if not rows:
        last = cols[-1]
        if last in nums and u[last] >= 2:
            rows.append((last, task(last), "medium"))
    seen = {r[0] for r in rows}
    rows += [(n, "classification", "low") for n in cats if n not in seen]
    rows += [(n, "regression", "low") for n in nums if n not in seen and u[n] > 10]
    rank = {"high": 0, "medium": 1, "low": 2}
    rows = sorted(rows, key=lambda r: rank[r[2]])[:k]
    return rows_to_df(df.sparkSession, rows, "target string, task string, confidence string")


def task_of(df: DataFrame, target: str) -> str:
    """classification for text and for whole numbers with few values, else regression."""
    require(df, target)
    if not is_numeric(df, target):
        return "classification"
    x = num(df, target)
    got = stats_row(df, {"k": F.count(x), "frac": F.count(F.when(x % 1 != 0, 1))})
    if not got["k"] or (not is_integral(df, target) and got["frac"]):
        return "regression"
    u = coarse_distinct(df, [target], 5)[0][target]
    return "classification" if u <= 5 and u / got["k"] <= 0.5 else "regression"


# ---------------------------------------------------------------- preprocessing

@dataclass
class Prepared:
    """A fitted preparation: transforms raw rows to (features, label)."""

    model: PipelineModel
    features: list[str]
    target: str
    task: str
    labels: list[str]
    medians: dict
    text: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(_typed(df, self.medians, self.text))


def _typed(df: DataFrame, medians: dict, text: Sequence[str]) -> DataFrame:
    """The inputs the model expects: ``_f_`` numbers with gaps at the training median, ``_t_`` texts with
    'Missing'.  Columns the rows lack count as missing."""
    new = {f"_f_{n}": F.coalesce(num(df, n), F.lit(m)) if n in df.columns else F.lit(m) for n, m in medians.items()}
    new.update({f"_t_{n}": F.coalesce(c(n).cast("string"), F.lit("Missing")) if n in df.columns else F.lit("Missing")
                for n in text})
    return df.withColumns(new) if new else df


def _medians(df: DataFrame, cols: Sequence[str]) -> dict:
    return {n: q[0] or 0.0 for n, q in exact_quantiles(df, cols, [0.5]).items()}


def useful_features(df: DataFrame, target: str, skip: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical inputs: constants, and texts with too many values, are left out."""
    cols = [n for n in flat_cols(df) if n != target and n not in skip and not is_date(df, n)]
    got = stats_row(df, {(k, n): f(c(n)) for n in cols for k, f in (("k", F.count), ("lo", F.min), ("hi", F.max))})
    nums = [n for n in cols if is_numeric(df, n) and got[("lo", n)] != got[("hi", n)]]
    u, _ = coarse_distinct(df, [n for n in cols if n not in nums and not is_numeric(df, n)], 50)
    cats = [n for n in u if 1 < u[n] <= 50 and u[n] / max(got[("k", n)], 1) <= 0.5]
    return nums, cats


def with_target(df: DataFrame, target: str, task: str) -> DataFrame:
    """Rows that have a target: for regression a number that is not NaN."""
    return df.where((c(target) if task == "classification" else num(df, target)).isNotNull())


def prepare(df: DataFrame, target: str, task: str | None = None, skip: Sequence[str] = (), scale: bool = True) -> Prepared:
    """Median-fill and scale numbers, index categories (alphabetical, unknown ones keep a code), index the class."""
    task = task or task_of(df, target)
    df = with_target(df, target, task)
    nums, cats = useful_features(df, target, skip)
    if not nums and not cats:
        raise ValueError("no usable feature columns")
    med = _medians(df, nums)
    src = _typed(df, med, cats)
    stages: list = []
    ins = [f"_f_{n}" for n in nums]
    if cats:
        stages.append(StringIndexer(inputCols=[f"_t_{n}" for n in cats], outputCols=[f"_c_{n}" for n in cats],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        ins += [f"_c_{n}" for n in cats]
    stages.append(VectorAssembler(inputCols=ins, outputCol="_raw"))
    stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=scale))
    labels: list[str] = []
    if task == "classification":
        src = src.withColumn("_target", c(target).cast("string"))
        ix = StringIndexer(inputCol="_target", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(src)
        labels = list(ix.labels)
    else:
        src = src.withColumn("label", num(df, target))
    model = Pipeline(stages=stages).fit(src)
    return Prepared(model, nums + cats, target, task, labels, med, cats)


def labelled(p: Prepared, df: DataFrame) -> DataFrame:
    """(all columns, features, label) of rows that have a target."""
    d = p.transform(with_target(df, p.target, p.task))
    if p.task == "classification":
        codes = F.array(*[F.lit(x) for x in p.labels])  # the classes, a handful
        return d.withColumn("label", (F.array_position(codes, c(p.target).cast("string")) - 1).cast("double"))
    return d.withColumn("label", num(d, p.target))


def split(df: DataFrame, key: str, frac: float = 0.2, by: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by key hash.  With ``by``, the test share holds inside every class."""
    if by is None:
        u = F.pmod(F.xxhash64(c(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return df.where(u >= frac), df.where(u < frac)
    from ..operators.sample import stratified

    rows = df.where(c(by).isNotNull())
    n = rows.count()
    test_keys = stratified(rows.select(c(key), c(by)), key, by, max(1, round(n * frac)), seed).select(c(key))
    test = rows.join(test_keys, key, "left_semi")
    return rows.join(test_keys, key, "left_anti"), test


def test_share(n: int) -> float:
    """Share held out: one row up to eight, a quarter below thirty, else a fifth."""
    return 1.0 / max(n, 1) if n <= 8 else 0.25 if n < 30 else 0.2


def poly_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """Standardised polynomial terms of all given columns as a vector column ``poly``."""
    cols = list(columns)
    src = _typed(df, _medians(df, cols), ())
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=[f"_f_{n}" for n in cols], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
        PolynomialExpansion(degree=degree, inputCol="_std", outputCol="poly")])
    return pipe.fit(src).transform(src).drop("_raw", "_std", *[f"_f_{n}" for n in cols])


# ---------------------------------------------------------------- feature suggestions

SUGGESTION_SCHEMA = "type string, column string, action string, other string"


def suggestion_rows(df: DataFrame) -> list[tuple]:
    nums, texts = numeric_cols(df), text_cols(df)
    rows = [("date_decomposition", n, "extract_date_features", None) for n in flat_cols(df)
            if is_date(df, n) or name_has(n, DATE_WORDS)]
    got = stats_row(df, {"n": F.count(F.lit(1)), **{n: F.avg(F.length(c(n))) for n in texts}})
    rows += [("text_features", n, "create_text_metrics", None) for n in texts if (got[n] or 0) > 12]
    rs = correlations(df, nums)
    for i, a in enumerate(nums):
        for b in nums[i + 1:]:
            r = rs[(a, b)]
            if r is not None and 0.50 <= abs(r) <= 0.85:
                rows.append(("numeric_interaction", a, "create_ratio_column", b))
                break
    u, _ = coarse_distinct(df, texts, 10, 1.0)
    rows += [("categorical_encoding", n, "encode_frequency", None) for n in texts if 10 < u[n] < got["n"]]
    return rows


def suggest_features(df: DataFrame) -> DataFrame:
    """Dates to take apart, texts to measure, ratios of moderately correlated numbers, categories to encode."""
    return rows_to_df(df.sparkSession, suggestion_rows(df), SUGGESTION_SCHEMA)


def auto_engineer(df: DataFrame, suggestions: list[tuple] | None = None) -> DataFrame:
    """Add the suggested features."""
    for _, n, action, other in suggestion_rows(df) if suggestions is None else suggestions:
        if n not in df.columns:
            continue
        if action == "extract_date_features":
            df = df.withColumns(date_parts(as_date(df, n), n))
        elif action == "create_text_metrics":
            df = text_metrics(df, n)
        elif action == "create_ratio_column" and other in df.columns:
            df = ratio_feature(df, n, other)
        elif action == "encode_frequency" and is_text(df, n):
            df = encode_frequency(df, n, out=f"{n}_freq")
    return df

