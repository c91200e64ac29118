"""Sessions, the folder for intermediate tables, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_made: dict[str, str] = {}
_folders: dict[str, list[str]] = {}


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """For tests and benchmarks on one machine."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("agoraspark").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only where none is named and all runs in one process (tests) is
    one made, once a session: a cluster's executors could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _made[app]


def new_folder(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the folders that new_folder has named, all or those from number `since` to `until`: for use once the results
    that are read from them have been written or collected."""
    made = _folders.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in made[since:until]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del made[since:until]


def folders(spark: SparkSession) -> int:
    """How many folders there are to release."""
    return len(_folders.get(spark.sparkContext.applicationId, []))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a context, unless their path has it already."""
    root = Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_agoraspark", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="agoraspark-")) / "agoraspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.glob("agoraspark/**/*.py")):
            out.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._agoraspark = True
