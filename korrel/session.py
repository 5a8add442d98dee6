"""Session factory and table registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
    "clicks sales sale_lines clients client_changes vendors items stamps"
).split()


def session(cpus: str = "*", app: str = "korrel", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the tables of ``sf_dir``; reading the schema is all that happens here."""
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, as in tests, a temporary folder; on a cluster that is refused, as
    executors would each write to their own disk."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="korrel-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed now, its lineage cut: kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same as Parquet in the shared folder, for tables of which most readers want some columns or rows."""
    from uuid import uuid4

    path = f"{shared_folder(df.sparkSession)}/written-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, mb: int = 16) -> int:
    """Shuffle partitions for ``df``: the session's number, or more so that each takes about ``mb`` of input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(-(-size // (mb << 20)), 200_000)) if size < 1 << 60 else least
