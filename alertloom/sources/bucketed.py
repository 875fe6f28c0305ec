"""Tables that lie in buckets of a key, so that joins on the key do not move them.

Spark knows buckets by its catalog only.  What has to be known is therefore kept beside the
files, and any session that reads the folder enters it in its catalog under a name of its own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

ABOUT = "_bucketed.json"


def _file(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet, on whatever file system the path names."""
    fs, place = _file(spark, path)
    out = fs.create(place, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _file(spark, path)
    stream = fs.open(place)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def rename(spark: SparkSession, old: str, new: str) -> None:
    (fs, source), (_, target) = _file(spark, old), _file(spark, new)
    if not fs.rename(source, target):
        raise RuntimeError(f"could not write {new}")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` to a new folder in ``buckets`` files by the hash of ``key``."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    fields = spark.createDataFrame([], df.schema)._jdf.schema().toDDL()
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    write_text(spark, f"{path}/{ABOUT}", json.dumps({"name": name, "fields": fields, "key": key, "buckets": buckets}))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A folder that ``write_bucketed`` made; joins on its key read it as it lies."""
    about = json.loads(read_text(spark, f"{path}/{ABOUT}"))
    if not spark.catalog.tableExists(about["name"]):
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {about['name']} ({about['fields']}) USING parquet "
                  f"CLUSTERED BY ({about['key']}) INTO {about['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(about["name"])
