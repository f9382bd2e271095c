"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Jobs need no call site for every column expression (measured: a quarter
    # less time to build the plans).
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "stopwise", master: str | None = None, **settings: str) -> SparkSession:
    """A session for these jobs; ``settings`` add to or replace ``SETTINGS``.

    Write setting names with ``__`` for dots.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = SETTINGS | {name.replace("__", "."): value for name, value in settings.items()}
    for name, value in wanted.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as it takes it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = file_system(spark, path)
    return files.exists(hadoop)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, without hidden ones; none if it is missing."""
    files, hadoop = file_system(spark, path)
    if not files.exists(hadoop):
        return []
    found = [s.getPath().getName() for s in files.listStatus(hadoop) if s.isDirectory()]
    return [n for n in found if not n.startswith(("_", "."))]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    files, hadoop = file_system(spark, path)
    files.delete(hadoop, True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder all executors can reach, for written intermediate tables.

    It lies under ``spark.checkpoint.dir``. Only a local session may leave that
    unset; it then gets a temporary folder for its lifetime.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="stopwise-")
    return f"{base.rstrip('/')}/stopwise-{uuid.uuid4().hex}"


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    files, hadoop = file_system(spark, path)
    stream = files.open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class AlreadyPublished(RuntimeError):
    """There is a file of that name."""


def publish_text(spark: SparkSession, path: str, content: str) -> None:
    """Make a small file appear with all its content at once: it is written under
    another name and renamed, never over a file that is there."""
    folder, name = path.rsplit("/", 1)
    files, source = file_system(spark, f"{folder}/_{uuid.uuid4().hex}")
    stream = files.create(source, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    never_over = spark._sc._gateway.new_array(kind, 1)
    never_over[0] = kind.NONE
    context = hadoop.FileContext.getFileContext(files.getUri(), files.getConf())
    try:
        context.rename(context.makeQualified(source), context.makeQualified(hadoop.Path(path)), never_over)
    except Exception as error:
        files.delete(source, False)
        if exists(spark, path):
            raise AlreadyPublished(path) from error
        raise


def numbered_files(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that are names of files in ``folder``, in order."""
    files, hadoop = file_system(spark, folder)
    if not files.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in files.listStatus(hadoop)]
    return sorted(int(n) for n in names if n.isdigit())
