"""Session settings and the engine's fixed clock."""

from __future__ import annotations

import os
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

#: The dialect's "now" when the caller gives none.
DEFAULT_AS_OF = datetime(2026, 7, 1, 12, 0, 0)

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "tesseral", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings that results depend on; cluster sizing is left to the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings whose views nobody else sees."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; a temporary one only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesseral-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch(spark: SparkSession, kind: str) -> str:
    """The name of a new folder beside the checkpoints, removed when the application ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Engine:
    """A session plus the dialect's fixed clock; ``sql`` runs scripts of the dialect (see ``plans.script``)."""

    def __init__(self, spark: SparkSession | None = None, as_of: datetime = DEFAULT_AS_OF, store: str | None = None):
        from tesseral.sources.versioned import Store

        self.spark = spark or get_session()
        self.as_of = as_of
        #: The views created here: name -> query, oldest first.
        self.views: dict[str, str] = {}
        if store is None and not self.spark.sparkContext.master.startswith("local"):
            raise ValueError("store must name a folder that all executors share")
        self.store = Store(self.spark, store or os.path.join(tempfile.mkdtemp(prefix="tesseral-store-"), "tables"))

    def register(self, folder: str) -> None:
        """Register every Parquet table of a folder as a temporary view."""
        from tesseral.sources.readers import register_folder

        register_folder(self.spark, folder)

    def execute(self, script: str):
        """Run all statements; a list of results, one for each."""
        from tesseral.plans.script import run_script

        return run_script(self, script)

    def sql(self, script: str) -> DataFrame:
        """Run a script and return the last result that has rows."""
        rows = [r.df for r in self.execute(script) if r.df is not None]
        if not rows:
            raise ValueError("no statement of the script returns rows")
        return rows[-1]
