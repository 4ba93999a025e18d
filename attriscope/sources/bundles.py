"""Published model bundles: versioned, checked, and visible only when whole.

``publish`` writes a new folder ``v<number>-<random>`` under a model's root:

    model/      the PipelineModel
    files/      (path, length, sha256) of every file of the model, as Parquet
    manifest/   one JSON row: feature manifest, digest over the file list
    commit/     one row, written last

A version counts only if its commit's success marker is there, so a publisher that dies half-way leaves a folder that no
reader looks at, and two publishers never write into one folder.  ``newest`` takes the highest committed number whose
files still have the lengths and digests of its list; a damaged version is passed over for the one before it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = re.compile(r"v(\d{6})-[0-9a-f]{8}")


@dataclass
class Bundle:
    version: str
    path: str
    manifest: dict

    @cached_property
    def model(self) -> PipelineModel:
        """Read when it is first used: all trees then pass through the driver, which a list of files does not need."""
        return PipelineModel.load(f"{self.path}/model")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, root: str, committed: bool = True) -> list[str]:
    """Version folders under ``root``, newest first."""
    fs, p = _fs(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    found = sorted((n for n in names if VERSION.fullmatch(n)), reverse=True)
    return [n for n in found if not committed or _exists(spark, f"{root}/{n}/commit/_SUCCESS")]


def file_list(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of the files under ``folder``, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_replace("path", "^.*?/" + re.escape(folder.rstrip("/").rsplit("/", 2)[-2]) + "/model/", "")
    return files.select(name.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def _digest(files: DataFrame) -> str:
    rows = sorted((r["path"], r["length"], r["sha256"]) for r in files.collect())  # the model's files: bounded by its parameters
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


def publish(spark: SparkSession, root: str, model: PipelineModel, manifest: dict) -> str:
    """Write a new version; returns its name.  Readers see it after the last step or not at all."""
    last = versions(spark, root, committed=False)
    number = int(VERSION.fullmatch(last[0]).group(1)) + 1 if last else 1
    name = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    path = f"{root.rstrip('/')}/{name}"
    model.write().save(f"{path}/model")
    file_list(spark, f"{path}/model").coalesce(1).write.parquet(f"{path}/files")
    digest = _digest(spark.read.parquet(f"{path}/files"))
    spark.createDataFrame([(json.dumps({**manifest, "version": name, "digest": digest}),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(f"{path}/commit")
    return name


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether the files of a committed version are those that were published."""
    kept, found = spark.read.parquet(f"{path}/files"), file_list(spark, f"{path}/model")
    return _digest(kept) == _digest(found) == json.loads(spark.read.text(f"{path}/manifest").first()[0])["digest"]


def newest(spark: SparkSession, root: str) -> Bundle:
    """The newest committed version whose files are whole."""
    for name in versions(spark, root):
        path = f"{root.rstrip('/')}/{name}"
        if is_whole(spark, path):
            manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
            return Bundle(name, path, manifest)
    raise FileNotFoundError(f"no whole model version in {root}")


def bundle_scorer(bundle: Bundle):
    """A scorer (rows in, the same rows with Risk out) from a bundle: its fitted features, its order of features, its model."""
    from attriscope.operators.features import FittedFeatures, align_features, drop_for_scoring
    from attriscope.operators.ml import positive_probability

    fitted = FittedFeatures.from_json(bundle.manifest["features"])

    def score(df: DataFrame) -> DataFrame:
        rows = drop_for_scoring(df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        matrix = align_features(fitted.transform(rows, keep=("_row",), with_label=False), fitted.feature_names, keep=("_row",))
        return positive_probability(bundle.model.transform(matrix)).select("_row.*", F.col("prob").alias("Risk"))

    return score
