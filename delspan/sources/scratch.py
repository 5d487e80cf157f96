"""Where jobs write files that they read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir`` or, on one machine only, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="spark-texts-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        folder = "file://" + _own["dir"]
    return f"{folder.rstrip('/')}/texts-{uuid.uuid4().hex}/{name}"
