"""Where derived tables go, and what a table is made of at this moment."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is not set: a temporary one on a local master (tests), an error on a cluster."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
    return f"{found.get()}/keys-{uuid.uuid4().hex}"


def fs_of(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stamp(df: DataFrame) -> str:
    """A hash of what the rows come from: the plan, and each file's path, length and time of change; of rows held in memory, their plan's
    hash. The same while the source is the same. Of tables in other databases only the plan is known."""
    plan = df._jdf.queryExecution().optimizedPlan()
    parts = [re.sub(r"#\d+L?", "", plan.toString())]
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            location = leaf.relation().location()
            files = location.allFiles().toString() if hasattr(location, "allFiles") else ",".join(sorted(location.inputFiles()))
            parts.append(re.sub(r"access_time=\d+;?", "", files))
        else:
            parts.append(str(leaf.canonicalized().hashCode()))
    return hashlib.sha1("\n".join(parts).encode()).hexdigest()
