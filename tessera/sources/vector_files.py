"""Vectors kept as a matrix file with a map of ids beside it, read into rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task reads.
STEP = 16384
SCHEMA = 2


def load_vectors(spark: SparkSession, matrix: str, id_map: str, step: int = STEP) -> DataFrame:
    """id, position, vector of a .npy matrix and a JSON map {"schema_version": 2, "ids": {id: position}} or {"order": [id, ...]}.

    The files must be reachable by all executors; each task maps the file and reads its rows alone. Positions outside the matrix are left out. A missing
    file gives no rows, a map of another schema fails.
    """
    empty = spark.createDataFrame([], "id string, position bigint, vector array<float>")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(matrix)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    meta = spark.read.text(id_map, wholetext=True)
    given = json.loads(meta.first().value)
    if given.get("schema_version", SCHEMA) != SCHEMA:
        raise ValueError(f"vector map of schema {given.get('schema_version')}, not {SCHEMA}")
    one = F.from_json("value", "ids map<string,bigint>, order array<string>")
    rows = meta.select(one.alias("m"))
    ids = rows.select(F.explode("m.ids").alias("id", "position")).unionByName(rows.select(F.posexplode("m.order").alias("position", "id")).select("id", F.col("position").cast("long").alias("position")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.load(matrix.removeprefix("file://"), mmap_mode="r")
        for b in batches:
            at = b.column("position").to_numpy()
            t = b.filter(pa.array((at >= 0) & (at < len(data))))
            got = data[t.column("position").to_numpy()]
            yield pa.RecordBatch.from_arrays([t.column("id"), t.column("position"), pa.array(list(np.asarray(got, np.float32)), pa.list_(pa.float32()))], ["id", "position", "vector"])

    near = ids.repartitionByRange(max(1, -(-ids.count() // step)), "position").sortWithinPartitions("position")
    return near.mapInArrow(run, "id string, position bigint, vector array<float>")
