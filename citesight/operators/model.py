"""Models re-aimed as Spark jobs (M1-M3).

M1 has two solvers: ``train_newton`` (a fixed number of Newton steps from sums
over the rows, for up to a few thousand features) and ``train_window`` (Spark
ML's L-BFGS, for any width). M2 and M3 take the model of either.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesight.session import ship_package
from citesight.sources.io import stage_table

#: Widest model of ``train_newton``: its sums are the square of this number.
MAX_NEWTON_FEATURES = 4_096
#: Numbers of the feature matrix a task holds at a time.
SLICE_NUMBERS = 1 << 21


def neighbour_mean(graph_x: str = "graph_x"):
    """Element-wise mean of the neighbour vectors (array of arrays) per row."""
    g = F.col(graph_x)
    n = F.size(g)
    first = F.get(g, 0)
    dims = F.sequence(F.lit(0), F.size(first) - 1)
    return F.transform(dims, lambda i: F.aggregate(g, F.lit(0.0), lambda a, v: a + F.get(v, i).cast("double")) / n)


def feature_array(x: str = "x", graph_x: str = "graph_x") -> Column:
    """Own vector concatenated with the neighbour mean."""
    return F.concat(F.transform(F.col(x), lambda v: v.cast("double")), neighbour_mean(graph_x))


def features(df: DataFrame, x: str = "x", graph_x: str = "graph_x") -> DataFrame:
    """``feature_array`` as an ML vector column ``features``."""
    return df.withColumn("features", array_to_vector(feature_array(x, graph_x)))


def train_window(table: DataFrame, label: str = "label", weight: str | None = "weight",
                 max_iter: int = 50, reg: float = 0.01) -> PipelineModel:
    """M1: weighted logistic regression on one training window (distributed L-BFGS)."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=reg,
                            weightCol=weight or "")
    if not weight:
        lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[lr]).fit(features(table))


@dataclass(frozen=True)
class NewtonModel:
    """Logistic regression of ``train_newton``. ``last_step`` is the largest change of a weight in the last step."""
    intercept: float
    weights: tuple[float, ...]
    last_step: float

    def prob(self, x: Column) -> Column:
        if not self.weights:  # nothing to learn from
            return F.when(x.isNotNull(), F.lit(0.5))
        products = F.zip_with(x, F.lit(list(self.weights)), lambda a, b: a * b)
        z = F.aggregate(products, F.lit(self.intercept), lambda a, v: a + v)
        return 1.0 / (1.0 + F.exp(-z))

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.intercept, list(self.weights), self.last_step)]
        frame = spark.createDataFrame(row, "intercept double, weights array<double>, last_step double")
        frame.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NewtonModel:
        r = spark.read.parquet(path).first()
        return NewtonModel(r["intercept"], tuple(r["weights"]), r["last_step"])


def _newton_sums(beta: list[float]):
    """Task side: for each feature (0 is the intercept) the row of the curvature matrix, then the gradient,
    both summed over the task's rows at the weights ``beta``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        b = np.array(beta)
        width, sums = len(b), None
        step = max(1, SLICE_NUMBERS // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.ones((part.num_rows, width))
                x[:, 1:] = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width - 1)
                y, w = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -700, 700)))
                one = np.column_stack([x.T @ (x * (w * p * (1 - p))[:, None]), x.T @ (w * (y - p))])
                sums = one if sums is None else sums + one
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))],
                                             names=["i", "v"])
    return run


def train_newton(table: DataFrame, label: str = "label", weight: str | None = "weight", steps: int = 8,
                 reg: float = 0.01, staged: bool = False) -> NewtonModel:
    """M1: weighted logistic regression by ``steps`` Newton steps from zero weights.

    Minimises ``sum(w * log loss) / sum(w) + reg / 2 * |weights|^2`` (the intercept is free). A step reads
    the features once, which are staged first unless the caller says that ``table`` is ``staged``; each task sends the sums of its rows, (features + 1) * (features + 2) numbers
    whatever the rows, the executors add them up and the driver solves one system of that size. Rows
    without label, weight (NaN counts as none) or features take no part; no rows give zero weights. A feature
    vector of another width, or a feature that is NaN or infinite, is an error. ``last_step`` of the model tells how far it has
    settled. For more than ``MAX_NEWTON_FEATURES`` features use ``train_window``.
    """
    import numpy as np
    ship_package(table.sparkSession)
    rows = table.select(feature_array().alias("x"), F.col(label).cast("double").alias("y"),
                                    (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna()
    rows = rows if staged else stage_table(rows)
    known = rows.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.sum("w").alias("w")).first()
    if known["hi"] is None:
        return NewtonModel(0.0, (), 0.0)
    if known["lo"] != known["hi"]:
        raise ValueError(f"feature vectors of {known['lo']} to {known['hi']} numbers")
    if known["hi"] > MAX_NEWTON_FEATURES:
        raise ValueError(f"{known['hi']} features; train_newton takes up to {MAX_NEWTON_FEATURES}")
    beta, move = np.zeros(known["hi"] + 1), np.zeros(1)
    penalty = np.full(len(beta), reg)
    penalty[0] = 0.0
    for _ in range(steps):
        parts = rows.mapInArrow(_newton_sums(beta.tolist()), "i int, v array<double>")
        total = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        sums = np.array([r["v"] for r in sorted(total.collect())]) / known["w"]  # features + 1 rows
        if not np.isfinite(sums).all():
            raise ValueError("features hold NaN or infinite values")
        move = np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1] - penalty * beta)
        beta = beta + move
    return NewtonModel(float(beta[0]), tuple(beta[1:].tolist()), float(np.abs(move).max()))


def score_batch(model: PipelineModel | NewtonModel, table: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """M2: probability of the positive class per row."""
    if isinstance(model, NewtonModel):
        prob = model.prob(feature_array())
        return table.select(*keep, prob.alias("prob")).withColumn("pred", (F.col("prob") > 0.5).cast("int"))
    out = model.transform(features(table))
    return out.select(*keep, vector_to_array("probability")[1].alias("prob"),
                      F.col("prediction").cast("int").alias("pred"))


def score_with(df: DataFrame, model_factory, input_cols: Sequence[str], out: str = "prob",
               batch_size: int = 256) -> DataFrame:
    """M2 for a foreign model: ``model_factory()`` returns ``(*numpy inputs) -> numpy scores``,
    loaded once per Python worker, fed Arrow batches."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType
    udf = predict_batch_udf(model_factory, return_type=DoubleType(), batch_size=batch_size)
    return df.withColumn(out, udf(*[F.col(c) for c in input_cols]))


def save_model(model: PipelineModel | NewtonModel, root: str, run_id: str, epoch: int) -> str:
    """M3: save under ``root/run_id/epoch``."""
    path = f"{root.rstrip('/')}/{run_id}/{epoch}"
    if isinstance(model, NewtonModel):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(root: str, run_id: str, epoch: int, kind: type = PipelineModel) -> PipelineModel | NewtonModel:
    """The model saved under ``root/run_id/epoch``, which a solver of this ``kind`` made."""
    path = f"{root.rstrip('/')}/{run_id}/{epoch}"
    return kind.load(SparkSession.active(), path) if kind is NewtonModel else kind.load(path)
