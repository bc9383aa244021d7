"""Session defaults and the shared work folder.

Everything in the library is DataFrame in / DataFrame out; only the few
writers (sources, maintenance, streaming) need a place on shared storage.
That place is taken from the session's ``spark.checkpoint.dir`` so that on a
cluster every executor sees it. A fresh local folder is set only on a local
master; any other session without the setting is refused.
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at scale; all are plain Spark SQL confs.
SCALE_CONFS = {
    # runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, switch sort-merge to broadcast from real sizes
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # broadcast only below a fixed size the optimizer checks from stats
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tillroll") -> SparkSession:
    """Local or cluster session with the library's defaults.

    On a cluster pass ``master=None`` and let the launcher decide; the
    shuffle partition count then stays whatever the cluster config says.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in SCALE_CONFS.items():
        b = b.config(k, v)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # no context access (e.g. Spark Connect): use the conf
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if conf:
            return conf
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share") from None
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def work_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "tillroll", *parts, uuid.uuid4().hex])


WRITE_SPLIT = 32 << 20  # bytes of files that one writing task reads at most
COMPILED_METHOD = 8000  # bytes of a method beyond which the JVM never compiles it
_SPLIT_CONF, _METHOD_CONF = "spark.sql.files.maxPartitionBytes", "spark.sql.codegen.hugeMethodLimit"
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
_lock, _held = threading.Lock(), {}


def _bytes(size: str) -> int:
    n, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", size.strip().lower()).groups()
    return int(n) * _UNITS[unit]


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Scans that run inside read at most ``WRITE_SPLIT`` bytes per task. The
    fact tables are small in files and wide in memory, so that a task that
    sorts the rows of a split of the usual size for its partitions spills.
    Stages that clean or write all their columns in one generated method are
    run operator by operator where the JVM would only interpret it."""
    key, most = id(spark), {_SPLIT_CONF: WRITE_SPLIT, _METHOD_CONF: COMPILED_METHOD}
    with _lock:
        old, n = _held.get(key, ({c: spark.conf.get(c) for c in most}, 0))
        _held[key] = (old, n + 1)
        for c, limit in most.items():
            spark.conf.set(c, str(min(_bytes(old[c]), limit)))
    try:
        yield
    finally:
        with _lock:
            old, n = _held.pop(key)
            if n > 1:
                _held[key] = (old, n - 1)
            else:
                for c, value in old.items():
                    spark.conf.set(c, value)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so plain-Python helpers can see a local path."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)
