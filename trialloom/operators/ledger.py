"""Finished work recorded in the shared folder, and jobs run side by side.

An entry is a folder with the tables one job made and, written last, a mark that it is whole. Who
asks for an entry that has its mark reads it; any other one is made anew. So after a lost driver or
a failed job only what is missing is repeated.
"""

from __future__ import annotations

import hashlib
import inspect
import os
from collections.abc import Callable, Hashable, Mapping
from concurrent.futures import ThreadPoolExecutor
from types import ModuleType

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.session import shared_dir

_MARK = "_WHOLE"


def fingerprint(table: DataFrame, *more: object) -> str:
    """Text that is equal for equal rows, columns and ``more``, in any order of rows."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in table.columns])
    n, total = table.agg(F.count("*"), F.sum(row.cast("decimal(38, 0)"))).first()
    return _digest(n, total, table.dtypes, *more)


def source_digest(*modules: ModuleType) -> str:
    return _digest(*map(inspect.getsource, modules))


def _digest(*parts: object) -> str:
    return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()[:32]


class Ledger:
    """Entries of one name in the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, os.path.join(shared_dir(spark), f"ledger-{name}")

    def _file(self, *names: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, *names))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def whole(self, entry: str) -> bool:
        path, files = self._file(entry, _MARK)
        return files.exists(path)

    def entry(self, key: tuple, make: Callable[[], Mapping[str, DataFrame]]) -> str:
        """Entry of ``key``; its tables are made and written if it isn't whole."""
        entry = _digest(*key)
        if not self.whole(entry):
            for name, table in make().items():
                table.write.mode("overwrite").parquet(os.path.join(self.root, entry, name))
            path, files = self._file(entry, _MARK)
            files.create(path, True).close()
        return entry

    def read(self, entry: str, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, entry, name))


def at_once(spark: SparkSession, jobs: Mapping[Hashable, tuple], most: int) -> dict[Hashable, Exception]:
    """Call each job (a function and its arguments), up to ``most`` at a time; the errors of those that failed.

    Each runs in a thread with its own job group and scheduler pool, so that they share a fair
    scheduler and can be told apart and cancelled by name.
    """
    sc = spark.sparkContext

    def run(key: Hashable, call: tuple) -> None:
        name = " ".join(map(str, key)) if isinstance(key, tuple) else str(key)
        sc.setJobGroup(name, name)
        sc.setLocalProperty("spark.scheduler.pool", name)
        function, *arguments = call
        function(*arguments)

    failed: dict[Hashable, Exception] = {}
    with ThreadPoolExecutor(most) as pool:
        running = {key: pool.submit(inheritable_thread_target(spark)(run), key, call) for key, call in jobs.items()}
        for key, future in running.items():
            error = future.exception()
            if isinstance(error, Exception):
                failed[key] = error
            elif error is not None:
                raise error
    return failed
