"""Result files as a table: a data source with a partition for each file, of the subjects and tasks that are asked for.

``register(spark)`` once, then ``spark.read.format("sentence_results").option("subjects", "A,B").load(folder)``, or a table
over it. Files are reached by a URI that Arrow knows (file, s3, gs, hdfs, ...); stores that Spark alone can read go through
``matfile.read_results``. Subjects and tasks are options and not pushed filters: what Spark 4.1 pushes to a Python source
stays with the table, and a later scan of it without filters would read the files of the earlier one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pathloom.sources import matfile

FORMAT = "sentence_results"
NAME = re.compile(r"results([A-Za-z0-9]+)_([A-Za-z0-9]+)\.mat$")


@dataclass
class ResultFile(InputPartition):
    path: str
    subject: str
    task: str

    def __post_init__(self):
        super().__init__(None)


class ResultReader(DataSourceReader):
    """Lists the files that are asked for, and reads each where its partition is."""

    def __init__(self, folder: str, columns: list[str], subjects: set[str] | None, tasks: set[str] | None):
        self.folder, self.columns, self.subjects, self.tasks = folder, columns, subjects, tasks

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.folder)
        found = []
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.type != fs.FileType.File or not info.base_name.endswith(".mat"):
                continue
            if (name := NAME.search(info.base_name)) is None:
                raise ValueError(f"not a result file: {info.path}")
            subject, task = name[1], name[2].upper()
            if (self.subjects is None or subject in self.subjects) and (self.tasks is None or task in self.tasks):
                found.append(ResultFile(info.path, subject, task))
        return sorted(found, key=lambda p: p.path)

    def read(self, partition: ResultFile) -> Iterator[tuple]:
        if not isinstance(partition, ResultFile):  # Spark asks for one partition where there are no files
            return
        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_stream(partition.path) as stream:
            found = matfile.variables(stream.read())
        if "sentenceData" not in found:
            raise ValueError(f"no sentenceData in {partition.path}")
        place = [matfile.COLUMNS.index(c) for c in self.columns]
        for slot, item in enumerate(found["sentenceData"], 1):
            row = matfile.sentence(partition.subject, partition.task, slot, item)
            yield tuple(row[i] for i in place)


class ResultFiles(DataSource):
    """Sentences of result files named results<SUBJECT>_<TASK>.mat, with the columns of ``matfile.SENTENCES`` or some of them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return matfile.SENTENCES

    def reader(self, schema: StructType) -> DataSourceReader:
        folder = self.options["path"]
        listed = lambda key: None if key not in self.options else {x.strip() for x in self.options[key].split(",")}
        tasks = listed("tasks")
        where = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
        return ResultReader(where, schema.names, listed("subjects"), tasks and {t.upper() for t in tasks})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultFiles)
