"""A source of checkpoint trees whose filters on the checkpoint reach the listing: other folders are never opened."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from traceloom import schemas
from traceloom.functions import text

from .changes import _opened

#: Fixed value: ``{prob_token}-probe``, in old trees a bare ``{prob_token}``.
FOLDER = re.compile(r"(\d+)(?:-probe)?")


class _One(InputPartition):
    def __init__(self, prob_token: int, path: str | None):
        self.prob_token, self.path = prob_token, path


class CheckpointFolders(DataSource):
    """``spark.read.format("checkpoint_folders").load(path)``: (prob_token, path, body), a row per file of the tree.

    ``prob_token`` is the number in the folder's name. Comparisons of it with values are taken over by the source: one
    listing of the tree's top finds the folders, and only those that pass are listed and read. With the option
    ``level`` = "folders" nothing below the top is listed, and path and body are null. ``suffix`` limits the files.
    """

    @classmethod
    def name(cls) -> str:
        return "checkpoint_folders"

    def schema(self) -> str:
        return "prob_token int, path string, body string"

    def reader(self, schema):
        return CheckpointReader(self.options)


class CheckpointReader(DataSourceReader):
    TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}

    def __init__(self, options):
        self.path, self.level, self.suffix = options["path"], options.get("level", "files"), options.get("suffix", ".json")
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        """Takes what compares ``prob_token`` with values; the rest stays with Spark."""
        for f in filters:
            if type(f) in self.TESTS and f.attribute == ("prob_token",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def folders(self) -> list[tuple[int, str]]:
        """The tree's folders that pass, by number: one listing."""
        from pyarrow import fs

        store, top = _opened(self.path)
        found = [(int(m[1]), i.path) for i in store.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.Directory and (m := FOLDER.fullmatch(i.base_name))]
        return sorted((n, p) for n, p in found if all(self.TESTS[kind](n, value) for kind, value in self.tests))

    def partitions(self):
        from pyarrow import fs

        if self.level == "folders":
            return [_One(n, None) for n, _ in self.folders()] or [_One(-1, None)]
        store, _ = _opened(self.path)
        files = [_One(n, i.path) for n, folder in self.folders() for i in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path) if i.type == fs.FileType.File and i.base_name.endswith(self.suffix)]
        return files or [_One(-1, None)]

    def read(self, partition: _One):
        if partition.prob_token < 0:
            return
        if partition.path is None:
            yield (partition.prob_token, None, None)
            return
        store, _ = _opened(self.path)
        with store.open_input_stream(partition.path) as f:
            yield (partition.prob_token, partition.path, f.read().decode())


def _registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CheckpointFolders)


def checkpoint_files(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(prob_token, path, body) of a checkpoint tree; filter on ``prob_token`` to read some folders alone."""
    _registered(spark)
    return spark.read.format("checkpoint_folders").option("suffix", suffix).load(path)


def earliest_truths(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ground_truth) from the earliest checkpoint's folder, the only one that is listed and read.

    Of several files of a question the first by name counts; files that are no JSON and summaries are left out, and
    the truth is trimmed, empty where the file has none.
    """
    _registered(spark)
    first = spark.read.format("checkpoint_folders").option("level", "folders").load(path).agg(F.min("prob_token")).first()[0]
    if first is None:
        raise ValueError(f"no checkpoint folders in {path}")
    files = checkpoint_files(spark, path).where(F.col("prob_token") == first)
    name = F.element_at(F.split("path", "/"), -1)
    shape = T.StructType([*schemas.PROBE_FILE.fields, T.StructField("_broken", T.StringType())])
    body = F.from_json("body", shape, {"columnNameOfCorruptRecord": "_broken"})
    rows = files.select(name.alias("name"), text.parse_probe_name(name).alias("f"), body.alias("b")).where("f IS NOT NULL AND name <> 'summary_results.json' AND b._broken IS NULL")
    truth = F.coalesce(text.strip(F.col("b.ground_truth")), F.lit(""))
    return rows.select(F.col("f.qid").cast("int").alias("qid"), "name", truth.alias("t")).groupBy("qid").agg(F.min_by("t", "name").alias("ground_truth"))
