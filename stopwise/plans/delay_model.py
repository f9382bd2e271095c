"""Training and applying the delay model.

Text columns enter by their label numbers. The labels are an index table stored
beside the model, made from all records of the window, held-out ones included, and
published with it; records are encoded by joins with it, so no task or driver holds all labels. Gap
filling and forest are one ``PipelineModel``.

The expected and scheduled time parts are among the features although the
delay follows from them; pass ``exclude`` to train without them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from math import ceil, exp, inf, isqrt, lgamma, log
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.functions import whole_minutes
from stopwise.operators import encoding, ranking
from stopwise.operators.cleaning import restore_names
from stopwise.operators.correlation import correlated_columns, correlation_pairs
from stopwise.operators.nulls import drop_empty_rows, empty_columns
from stopwise.session import folders, numbered_files, publish_text, read_text, remove_folder, shared_folder

# Fixed values.
LABEL = "Delay"
PREDICTION = "Predicted_Delay"
TREES = 100
SEED = 16
WINDOW = 100
MAX_DEPTH = 30  # the deepest trees Spark builds
BINS = 32  # Spark's number of bins of a feature
REPORT_NAMES = {
    "VehicleRef": "Vehicle Reference",
    "NextStopPointName": "Next Stop Point",
    PREDICTION: "Predicted Delay (minutes)",
}

_CODE, _FEATURE, _BIN = "_indexed", "_feature", "_bin"
_SLICE_ROWS = 100_000  # rows of a tree in one task
_SPLIT_ROWS = 10_000  # of more rows, Spark's forest takes the thresholds of splits from a sample
_PART_ROWS = 25_000, 400_000  # least and most rows that a task passes over
_LOT_PLACES = 300_000_000  # rows times trees that grow at a time: each such place is eight bytes between passes
_PUBLISHED = "_published"


@dataclass
class DelayModel:
    """Gap filling and forest, and the written label index."""

    pipeline: PipelineModel
    labels: DataFrame

    @property
    def inputs(self) -> list[str]:
        """The records' columns that are features."""
        assembled = next(s for s in self.pipeline.stages if isinstance(s, VectorAssembler)).getInputCols()
        return [c.removesuffix(_FEATURE).removesuffix(_CODE) for c in assembled]

    @property
    def text(self) -> list[str]:
        return [c for c in self.inputs if c in schemas.TEXT_COLUMNS]


def snapshot(df: DataFrame, folder: str | None = None) -> DataFrame:
    """A written copy, so that every pass of a run sees the same rows."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _draw(seed: int, first: int) -> Column:
    """A number from 0 to 2^32 that depends on the key only: eight digits of the MD5
    of seed, recorded parts, and the other parts of the key in millionths."""
    whole = [F.col(c).cast("string") for c in schemas.RECORDED_PARTS]
    rest = [c for c in schemas.KEY if c not in schemas.RECORDED_PARTS]
    parts = [F.floor(F.col(c) * 1_000_000).cast("string") for c in rest]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *whole, *parts))
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("bigint")


def split(df: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Four fifths and one fifth of the rows, by a hash of the key.

    Unlike a random split this does not depend on how the rows are spread.
    """
    fifth = _draw(seed, 1) % 5
    return df.filter(fifth < 4), df.filter(fifth == 4)


def feature_columns(
    rows: DataFrame, training: DataFrame, *, exclude: tuple[str, ...] = (), select: bool = False
) -> list[str]:
    """The columns that become features: those with a value in the training part.

    ``select`` leaves out the later of two columns whose correlation over all
    ``rows`` is above the threshold, as the analysis lane nulls them out.
    """
    unused = {LABEL, *exclude, *empty_columns(training)}
    if select:
        order = [c for c in schemas.FEATURE_ORDER if c in rows.columns]
        pairs = correlation_pairs(rows.select(*order))
        unused |= {r.column_name for r in correlated_columns(pairs).collect()}
    return [c for c in rows.columns if c not in unused]


def build_preparation(columns: list[str]) -> Pipeline:
    """Numbers as doubles, gaps filled by means, assembled; text enters by its code.

    Label numbers enter as ordinary numbers, not as categories.
    """
    if not columns:
        raise ValueError("no feature column is left")
    text = [c for c in columns if c in schemas.TEXT_COLUMNS]
    inputs = [c for c in columns if c not in text] + [f"{c}{_CODE}" for c in text]
    plain = [f"{c}_number" for c in inputs]
    features = [f"{c}{_FEATURE}" for c in inputs]
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {p}" for c, p in zip(inputs, plain))
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"),
            Imputer(strategy="mean", inputCols=plain, outputCols=features),
            VectorAssembler(inputCols=features, outputCol="features"),
        ]
    )


def build_pipeline(
    columns: list[str], *, trees: int = TREES, max_depth: int = MAX_DEPTH, seed: int = SEED, share: float = 1.0
) -> Pipeline:
    """Preparation and forest, each tree of which draws its own ``share`` of the rows."""
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=LABEL,
        predictionCol=PREDICTION,
        numTrees=trees,
        maxDepth=max_depth,
        featureSubsetStrategy="all",
        seed=seed,
        subsamplingRate=share,
        # Fewer passes over the rows (measured: 18 down to 13 seconds).
        maxMemoryInMB=1024,
        cacheNodeIds=True,
    )
    return Pipeline(stages=[*build_preparation(columns).getStages(), forest])


def _draws(seed: int, mean: float) -> Column:
    """How often a row is drawn: a Poisson number that depends on the key only."""
    at_most, chances = 0.0, []
    while at_most < 1 - 2**-32 and len(chances) < mean + 20 * (mean + 1) ** 0.5:
        at_most += exp(len(chances) * log(mean) - mean - lgamma(len(chances) + 1))
        chances.append(at_most)
    draw = _draw(seed, 9)
    start = F.when(draw < chances[0] * 2**32, 0)
    steps = enumerate(chances[1:], 1)
    return reduce(lambda case, step: case.when(draw < step[1] * 2**32, step[0]), steps, start).otherwise(len(chances))


def drawn_rows(rows: DataFrame, trees: int, share: float, seed: int = SEED) -> DataFrame:
    """The rows that a tree draws, with how often all ``trees`` together draw each (``draws``).

    Every tree draws each row a Poisson number of times, ``share`` on average, as Spark's
    forest does. The sum over the trees is Poisson too, so one number a row tells it.
    """
    return rows.withColumn("draws", _draws(seed, trees * share)).filter("draws > 0")


def rows_by_tree(drawn: DataFrame, trees: int, seed: int = SEED) -> DataFrame:
    """Drawn rows once a draw, with the number of the ``tree``: each falls to any tree alike."""
    each = drawn.withColumn("draw", F.explode(F.sequence(F.lit(1), "draws")))
    tree = F.pmod(F.xxhash64(F.lit(seed), *schemas.KEY, "draw"), F.lit(trees)).cast("int")
    return each.withColumn("tree", tree).drop("draws", "draw")


def _write_drawn(prepared: DataFrame, folder: str, slices: int) -> None:
    """Features and label by tree, in the order of the key."""
    part = F.pmod(F.xxhash64(*schemas.KEY), F.lit(slices))
    by_tree = prepared.repartition(F.col("tree"), part).sortWithinPartitions("tree", *schemas.KEY)
    by_tree.select("features", LABEL, "tree").write.partitionBy("tree").parquet(folder)


def _grow(forest: RandomForestRegressor, rows: list[DataFrame]) -> RandomForestRegressionModel:
    """A forest with one tree for each of ``rows``, several of which grow at a time."""
    spark = rows[0].sparkSession
    settings = {p: forest.getOrDefault(p) for p in ("featuresCol", "labelCol", "predictionCol", "maxDepth", "seed")}
    single = DecisionTreeRegressor(**settings)
    with ThreadPool(min(len(rows), spark.sparkContext.defaultParallelism)) as pool:
        grown = pool.map(inheritable_thread_target(spark)(single.fit), rows, chunksize=1)
    return _joined(spark, forest, grown)


def _joined(
    spark: SparkSession, forest: RandomForestRegressor, grown: list[DecisionTreeRegressionModel]
) -> RandomForestRegressionModel:
    """The model of ``forest`` that has these trees."""
    context = spark.sparkContext
    kinds = context._jvm.org.apache.spark.ml.regression
    trees = context._gateway.new_array(kinds.DecisionTreeRegressionModel, len(grown))
    for place, tree in enumerate(grown):
        trees[place] = tree._java_obj
    model = RandomForestRegressionModel(kinds.RandomForestRegressionModel(forest.uid, trees, grown[0].numFeatures))
    return forest._copyValues(model)


def _fit_drawn(encoded: DataFrame, pipeline: Pipeline, max_rows: int) -> PipelineModel | None:
    """``pipeline`` fitted to ``encoded``, whose rows are read for the gaps' means and the
    draw only: each tree then grows from the rows it has drawn. None if one drew none."""
    *first, forest = pipeline.getStages()
    preparation = Pipeline(stages=first).fit(encoded)
    trees, slices = forest.getNumTrees(), ceil(max_rows / _SLICE_ROWS)
    drawn = drawn_rows(encoded, trees, forest.getSubsamplingRate(), forest.getSeed())
    prepared = preparation.transform(drawn).select(*schemas.KEY, "features", "draws")
    spark, folder = encoded.sparkSession, shared_folder(encoded.sparkSession)
    _write_drawn(rows_by_tree(prepared, trees, forest.getSeed()), folder, slices)
    schema = prepared.select("features", LABEL).schema
    rows = [spark.read.schema(schema).parquet(f"{folder}/{name}") for name in sorted(folders(spark, folder))]
    grown = _grow(forest, [r.coalesce(slices) for r in rows]) if len(rows) == trees else None
    remove_folder(spark, folder)
    return grown and PipelineModel([*preparation.stages, grown])


def bin_bounds(rows: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """The least value of each bin of each column, from all ``rows``: every value is a bin
    where there are no more than ``bins``, else bins have as many rows as each other.

    The distinct values are sorted by ranges, so no task holds all of a column.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    long = rows.select(*columns).unpivot([], columns, "name", "value")
    counted = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("rows"))
    by_value = counted.repartitionByRange("name", "value").sortWithinPartitions("name", "value")
    # Slices depend on the sampled range bounds: write them down once. The bins do not.
    by_value.withColumn("slice", F.spark_partition_id()).write.parquet(folder)
    placed = spark.read.parquet(folder)
    column = Window.partitionBy("name")
    earlier = column.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    in_slice = placed.groupBy("name", "slice").agg(F.count(F.lit(1)).alias("n_values"), F.sum("rows").alias("n_rows"))
    starts = in_slice.select(
        "name",
        "slice",
        F.coalesce(F.sum("n_values").over(earlier), F.lit(0)).alias("values_before"),
        F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("n_values").over(column).alias("all_values"),
        F.sum("n_rows").over(column).alias("all_rows"),
    )
    in_order = Window.partitionBy("name", "slice").orderBy("value")
    up_to = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.col("values_before") + F.row_number().over(in_order) - 1
    before = F.col("rows_before") + F.sum("rows").over(up_to) - F.col("rows")
    number = F.when(F.col("all_values") <= bins, place).otherwise(F.floor(before * bins / F.col("all_rows")))
    binned = placed.join(starts, ["name", "slice"]).select("name", "value", number.alias("bin"))
    bounds: dict[str, list[float]] = {c: [] for c in columns}
    for r in binned.groupBy("name", "bin").agg(F.min("value").alias("least")).collect():
        bounds[r.name].append(r.least)
    remove_folder(spark, folder)
    return {c: sorted(found) for c, found in bounds.items()}


def _binning(bounds: dict[str, list[float]]) -> list[Bucketizer | SQLTransformer | VectorAssembler]:
    """Stages that put the numbers of bins in place of the features (``bins``)."""
    numbers, plain = [f"{c}{_BIN}" for c in bounds], [f"{c}{_BIN}_number" for c in bounds]
    splits = [[-inf, *least, inf] for least in bounds.values()]
    # The bucketizer marks its numbers as categories, but they are ordinary ones.
    unmarked = ", ".join(f"{n} + 0D AS {p}" for n, p in zip(numbers, plain))
    return [
        Bucketizer(inputCols=list(bounds), outputCols=numbers, splitsArray=splits),
        SQLTransformer(statement=f"SELECT *, {unmarked} FROM __THIS__"),
        VectorAssembler(inputCols=plain, outputCol="bins"),
    ]


def _fit_all(encoded: DataFrame, pipeline: Pipeline, count: int) -> PipelineModel:
    """``pipeline`` fitted to all ``count`` rows of ``encoded``, the thresholds of its splits too.

    Of more than 10,000 rows Spark's forest would take thresholds from a sample. Here the
    features are binned by all rows, and as many bins are allowed as make it look at every
    row: it then finds each number of a bin, ``BINS`` at most. Trees grow in lots, as the
    forest keeps a draw and a place for each row and tree.
    """
    *first, forest = pipeline.getStages()
    spark, folder = encoded.sparkSession, shared_folder(encoded.sparkSession)
    preparation = Pipeline(stages=first).fit(encoded)
    features = preparation.stages[-1].getInputCols()
    prepared = snapshot(preparation.transform(encoded).select(*schemas.KEY, *features), folder)
    binning = _binning(bin_bounds(prepared, features))
    binned = PipelineModel(binning).transform(prepared).select(*schemas.KEY, "bins")
    # Every level of the trees passes over the rows, so spread them evenly; but each part
    # sends the statistics of all nodes of a level, which for few rows takes longer than the
    # rows do. In a fixed order the same rows give the same forest.
    least, most = _PART_ROWS
    cores = spark.sparkContext.defaultParallelism
    parts = min(ceil(count / least), cores * ceil(count / (most * cores)))
    spread = binned.repartition(parts, *schemas.KEY).sortWithinPartitions(*schemas.KEY)
    trees = forest.getNumTrees()
    lots = min(trees, ceil(count * trees / _LOT_PLACES))
    grown = []
    for lot in range(lots):
        size = trees * (lot + 1) // lots - trees * lot // lots
        allowed = min(max(BINS + 1, isqrt(count) + 1), 46_340)  # its square is an Int in Spark
        own = {"featuresCol": "bins", "numTrees": size, "seed": forest.getSeed() + lot * parts, "maxBins": allowed}
        grown += forest.copy({forest.getParam(p): v for p, v in own.items()}).fit(spread).trees
    remove_folder(spark, folder)
    joined = _joined(spark, forest.copy({forest.featuresCol: "bins"}), grown)
    return PipelineModel([*preparation.stages, *binning, joined])


def train(
    records: DataFrame,
    path: str,
    *,
    exclude: tuple[str, ...] = (),
    select: bool = False,
    max_rows: int | None = None,
    stored: bool = False,
    table_version: int | None = None,
    **settings: int,
) -> DelayModel:
    """Fit on the training part of ``records`` and publish the model.

    The records are written down first, unless they are a ``stored`` table. Labels and
    pipeline lie in a folder of their own, which is published when both are whole:
    until then, and if training breaks off, the model before stays the one that is
    loaded. Every tree draws as many rows as the training part has, from all of it, and
    thresholds of splits come from all of it too. ``max_rows`` bounds the rows a tree draws
    on average; every tree draws anew from all of the training part, from which columns,
    means and labels come too; these draws are made before the trees grow, so that no level of a tree
    passes over rows that it did not draw. ``table_version`` is noted with the model.
    """
    spark = records.sparkSession
    folder = shared_folder(spark)
    rows = drop_empty_rows(restore_names(records)).filter(F.col(LABEL).isNotNull())
    if not stored:
        rows = snapshot(rows, folder)
    made = f"model-{uuid.uuid4().hex}"
    text = [c for c in rows.columns if c in schemas.TEXT_COLUMNS]
    index = encoding.label_index(rows, text) if text else spark.createDataFrame([], encoding.INDEX_SCHEMA)
    labels = encoding.write_index(index, f"{path}/{made}/labels")
    training = split(rows)[0]
    columns = feature_columns(rows, training, exclude=exclude, select=select)
    count = training.count()
    share = min(1.0, max_rows / max(1, count)) if max_rows is not None else 1.0
    encoded = encoding.label_encode(training, [c for c in columns if c in text], labels)
    plan = build_pipeline(columns, share=share, **settings)
    pipeline = _fit_drawn(encoded, plan, max_rows) if share < 1 else None
    if pipeline is None and count > _SPLIT_ROWS:
        pipeline = _fit_all(encoded, plan, count)
    if pipeline is None:
        # In a fixed order the same rows give the same forest.
        spread = encoded.repartition(*schemas.KEY).sortWithinPartitions(*schemas.KEY)
        pipeline = plan.fit(spread)
    _save(pipeline, f"{path}/{made}/pipeline")
    _publish(spark, path, made, table_version)
    if not stored:
        remove_folder(spark, folder)
    return DelayModel(pipeline, labels)


def _save(pipeline: PipelineModel, folder: str) -> None:
    pipeline.write().save(folder)


def _publish(spark: SparkSession, path: str, made: str, table_version: int | None) -> None:
    """Name the folder as the newest model. The one before stays for those who hold it,
    older ones go, as do folders that no model was made of."""
    numbers = numbered_files(spark, f"{path}/{_PUBLISHED}")
    content = json.dumps({"folder": made, "table_version": table_version})
    publish_text(spark, f"{path}/{_PUBLISHED}/{max(numbers, default=0) + 1}", content)
    kept = [published(spark, path, n)["folder"] for n in numbers[-1:]] + [made]
    for folder in folders(spark, path):
        if folder.startswith("model-") and folder not in kept:
            remove_folder(spark, f"{path}/{folder}")


def published(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """What is known of the newest model, or of one by its number: its ``folder`` and the
    ``table_version`` that it was trained on."""
    numbers = [number] if number is not None else numbered_files(spark, f"{path}/{_PUBLISHED}")
    return json.loads(read_text(spark, f"{path}/{_PUBLISHED}/{numbers[-1]}")) if numbers else None


def load(spark: SparkSession, path: str) -> DelayModel | None:
    """The model published last, or None if there is none yet."""
    newest = published(spark, path)
    if newest is None:
        return None
    folder = f"{path}/{newest['folder']}"
    labels = spark.read.schema(encoding.INDEX_SCHEMA).parquet(f"{folder}/labels")
    return DelayModel(PipelineModel.load(f"{folder}/pipeline"), labels)


def train_or_load(records: DataFrame, path: str, **settings: int) -> DelayModel:
    """The saved model; if there is none, one trained on ``records``."""
    model = load(records.sparkSession, path)
    return train(records, path, **settings) if model is None else model


def predict(model: DelayModel, records: DataFrame) -> DataFrame:
    """``records`` with the predicted delay in seconds."""
    rows = drop_empty_rows(restore_names(records))
    encoded = encoding.label_encode(rows, model.text, model.labels)
    return model.pipeline.transform(encoded).select(*rows.columns, PREDICTION)


def mean_error(records: DataFrame) -> float:
    """The root mean square error that the training part's mean has on the held-out fifth."""
    training, held_out = split(restore_names(records))
    mean = training.agg(F.avg(LABEL)).first()[0]
    return held_out.agg(F.sqrt(F.avg((F.col(LABEL) - mean) ** 2))).first()[0]


def holdout_error(model: DelayModel, records: DataFrame, metric: str = "rmse") -> float:
    """Error on the held-out fifth."""
    _, held_out = split(restore_names(records))
    evaluator = RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName=metric)
    return evaluator.evaluate(predict(model, held_out))


def report(scored: DataFrame, prediction: str = PREDICTION) -> DataFrame:
    """Vehicle, next stop and predicted whole minutes, under display names."""
    minutes = scored.withColumn(PREDICTION, whole_minutes(F.col(prediction)))
    return minutes.select([F.col(c).alias(name) for c, name in REPORT_NAMES.items()])


def first_report(records: DataFrame, path: str, **settings: int) -> DataFrame:
    """Train on the newest window or load the model; report the window's last 5."""
    window = snapshot(ranking.latest(records, WINDOW))
    model = train_or_load(window, path, stored=True, **settings)
    return report(predict(model, ranking.oldest_of_latest(window, WINDOW)))


def rescore_latest(model: DelayModel, records: DataFrame, n: int = 5) -> DataFrame:
    """Report on the newest ``n`` records."""
    return report(predict(model, ranking.latest(records, n)))
