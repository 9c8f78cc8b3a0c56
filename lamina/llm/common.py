"""What the operators of this subpackage share: input columns, the shared folder, materialised steps."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the operator that runs now; its steps go there and are deleted with it.
_FOLDER: ContextVar[str | None] = ContextVar("lamina_folder", default=None)
#: A join splits off at most this many hot keys, each of that share of the rows at least (and of this many rows).
HOT_KEYS, HOT_ROWS = 1000, 10_000

#: Words of the contracts: runs of anything but the ASCII white space of this class.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application, for sessions whose workers can't import it."""
    context = spark.sparkContext
    if not getattr(context, "_lamina_shipped", False):
        root = Path(__file__).resolve().parents[2]
        with tempfile.TemporaryDirectory() as folder:
            source = Path(folder, "source")
            shutil.copytree(root / "lamina", source / "lamina", ignore=shutil.ignore_patterns("__pycache__"))
            context.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="lamina-py-"), "lamina_package")), "zip", source))
        context._lamina_shipped = True


def id_text(df: DataFrame, id_col: str, text_col: str, *, null_text: str | None = "") -> DataFrame:
    """Only the id and the text, under the names ``doc_id`` and ``text``; whatever else the input has is left out.

    Other columns of the input can therefore never clash with those an operator makes. A null text
    becomes ``null_text``.
    """
    text = F.col(f"`{text_col}`").cast("string")
    if null_text is not None:
        text = F.coalesce(text, F.lit(null_text))
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach: what ``spark.checkpoint.dir`` names. Only a local master gets one of its own if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        path = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder of the running operator, else in the shared folder."""
    return f"{_FOLDER.get() or shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of the lineage that lost executors can't take away."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(what: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Decorator: the result is written as a table of its own, and all tables that led to it are deleted, also if a step fails."""

    def around(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(df: DataFrame, *args, **kw) -> DataFrame:
            spark = df.sparkSession
            folder = scratch(spark, what)
            token = _FOLDER.set(folder)
            try:
                out = f(df, *args, **kw)
                _FOLDER.reset(token)
                token = None
                return materialise(out, f"{what}-result")
            finally:
                if token is not None:
                    _FOLDER.reset(token)
                remove(spark, folder)

        return run

    return around


def lookup(left: DataFrame, right: DataFrame, keys: list[str], most: int = 200_000) -> DataFrame:
    """Left join to ``right``, unique on ``keys``; both written tables.

    At most ``most`` rows of ``right`` (counted) are broadcast. Else the keys under which ``left`` has very many rows, at
    most ``HOT_KEYS`` by their definition, are joined by broadcast and the others by shuffle, so no task gets a hot key's rows.
    Null keys find nothing and are no key.
    """
    if right.count() <= most:
        return left.join(F.broadcast(right), keys, "left")
    total = left.count()
    hot = left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= max(HOT_ROWS, total // HOT_KEYS)).select(*keys)
    hot = F.broadcast(materialise(hot, "hot-keys"))
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    aside = left.join(hot, keys, "left_semi").unionByName(left.filter(empty)).join(F.broadcast(right.join(hot, keys, "left_semi")), keys, "left")
    return left.filter(~empty).join(hot, keys, "left_anti").join(right, keys, "left").unionByName(aside)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, by binding it to a lambda variable."""
    return F.transform(F.array(value), body)[0]
