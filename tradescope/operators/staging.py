"""Staged tables: intermediate results written once to the shared folder and read back.

A staged table cuts the lineage in a way that survives the loss of executors, and lets
several later steps scan only the columns they need instead of recomputing a join.
``staging`` is the scope of a computation that ends inside it: what is staged there is
deleted on the way out.

``stage_once`` shares a staged table between calls and applications: its folder is named by
the canonical plan and by the sizes and times of the files below it, so the same question
on the same files finds what is there and a changed file does not.  Every reader holds a
lease, an empty file in that folder; whoever gives back the last one deletes the folder.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from uuid import uuid4

from py4j.protocol import Py4JError

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_scope: ContextVar[str] = ContextVar("staging_scope", default="")
# Settings that change what a plan computes.
_MEANING = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive")
# A lease of an application that never gave it back counts for so long.
LEASE_HOURS = 48
# (application, scope) -> shared folder -> the lease held there.
_leases: dict[tuple[str, str], dict[str, str]] = {}


def stage_root(spark: SparkSession) -> str:
    """The shared folder the session names, else one beside the session's warehouse."""
    configured = spark.conf.get(_CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def _application_folder(spark: SparkSession) -> str:
    return f"{stage_root(spark)}/tradescope/{spark.sparkContext.applicationId}"


@dataclass(frozen=True)
class Store:
    """The file systems of a session; they outlive it."""

    jvm: object
    conf: object

    @classmethod
    def of(cls, spark: SparkSession) -> Store:
        return cls(spark._jvm, spark._jsc.hadoopConfiguration())

    def at(self, folder: str) -> tuple:
        """The file system of a path, and the path."""
        path = self.jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.conf), path

    def delete(self, folder: str) -> None:
        files, path = self.at(folder)
        files.delete(path, True)


def _delete(spark: SparkSession, folder: str) -> None:
    Store.of(spark).delete(folder)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{_application_folder(spark)}{_scope.get()}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _leaves(plan) -> Iterator:  # noqa: ANN001
    """Leaf nodes of a logical plan and of the subqueries inside it."""
    queries = plan.subqueriesAll()
    for part in (plan, *(queries.apply(i) for i in range(queries.size()))):
        found = part.collectLeaves()
        yield from (found.apply(i) for i in range(found.size()))


def plan_name(df: DataFrame) -> str | None:
    """A name for what the frame computes on the files as they are; None where there is no such name.

    It covers the canonical plan with all its literals, the path, size and time of every
    input file, and the settings that change results.  Frames that read anything else than
    files, or whose result is not determined by them, have none.
    """
    spark = df.sparkSession
    analysed = df._jdf.queryExecution().analyzed()
    if not analysed.deterministic():
        return None
    digest = hashlib.sha256()
    for leaf in _leaves(analysed):
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            return None
        relation = leaf.relation()
        if relation.getClass().getSimpleName() != "HadoopFsRelation":
            return None
        # One text of all file states: path, length and time of modification among others.  Reading
        # a file moves its time of access, which says nothing.
        states = re.sub(r"access_time=\d+", "", relation.location().allFiles().toString())
        digest.update(f"{states}\n{relation.fileFormat().toString()}\n".encode())
    fields = "spark.sql.debug.maxToStringFields"
    old = spark.conf.get(fields)
    spark.conf.set(fields, str(2**31 - 1))
    try:
        digest.update(analysed.canonicalized().toString().encode())
    finally:
        spark.conf.set(fields, old)
    # The text leaves out a few details of expressions; their hash does not.
    digest.update(str(analysed.semanticHash()).encode())
    digest.update(repr([spark.conf.get(c, None) for c in _MEANING]).encode())
    return digest.hexdigest()[:40]


def _leased(spark: SparkSession, folder: str) -> None:
    """Take a lease on a shared folder for the current scope, unless it holds one."""
    held = _leases.setdefault((spark.sparkContext.applicationId, _scope.get()), {})
    if folder not in held:
        lease = f"{folder}/leases/{spark.sparkContext.applicationId}-{uuid4().hex}"
        files, path = Store.of(spark).at(lease)
        files.create(path, False).close()
        held[folder] = lease


def _give_back(store: Store, folder: str, lease: str) -> None:
    """Delete a lease, and the folder if that was the last one that counts."""
    store.delete(lease)
    files, leases = store.at(f"{folder}/leases")
    oldest = (time.time() - LEASE_HOURS * 3600) * 1000
    if files.exists(leases) and any(s.getModificationTime() > oldest for s in files.listStatus(leases)):
        return
    # A new reader that comes meanwhile finds nothing under the name and starts anew.
    gone = f"{folder}.gone-{uuid4().hex}"
    if files.rename(store.at(folder)[1], store.at(gone)[1]):
        store.delete(gone)


def _end_leases(store: Store, application: str, scope: str) -> None:
    for folder, lease in _leases.pop((application, scope), {}).items():
        _give_back(store, folder, lease)


def stage_once(df: DataFrame, label: str) -> DataFrame:
    """``stage``, but what has been staged for the same plan on the same files is read again.

    The table lives as long as someone holds a lease: the current ``staging`` scope, or the
    application where there is none (until ``drop_staged`` or its end).  Frames without a
    ``plan_name`` are staged as usual.
    """
    spark = df.sparkSession
    name = plan_name(df)
    if name is None:
        return stage(df, label)
    folder = f"{stage_root(spark)}/tradescope/shared/{label}-{name}"
    _leased(spark, folder)
    _ending(spark)
    store = Store.of(spark)
    files, data = store.at(f"{folder}/data")
    if not files.exists(data):
        own = f"{folder}/writing-{uuid4().hex}"
        df.write.parquet(own)
        # The rename is what makes it whole; another writer may have been faster.
        if files.exists(data) or not files.rename(store.at(own)[1], data):
            store.delete(own)
    return spark.read.schema(df.schema).parquet(f"{folder}/data")


_ends: set[str] = set()


def _ending(spark: SparkSession) -> None:
    """Give the application's leases back when the interpreter ends, even if its session was stopped."""
    application = spark.sparkContext.applicationId
    if application in _ends:
        return
    _ends.add(application)
    store = Store.of(spark)

    def end() -> None:
        try:
            for held_by, scope in list(_leases):
                if held_by == application:
                    _end_leases(store, application, scope)
        except (Py4JError, OSError):
            # The JVM is gone: its leases run out by their age.
            _leases.clear()

    atexit.register(end)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside on leaving, also after an error.

    Frames built inside read the staged files, so their results must be written or
    collected before the end.  Scopes nest.
    """
    token = _scope.set(f"{_scope.get()}/scope-{uuid4().hex}")
    try:
        yield
    finally:
        _end_leases(Store.of(spark), spark.sparkContext.applicationId, _scope.get())
        _delete(spark, _application_folder(spark) + _scope.get())
        _scope.reset(token)


def drop_staged(spark: SparkSession) -> None:
    """Delete everything this application has staged; frames built on it become unreadable.

    Shared tables go once no other application holds a lease on them.
    """
    for application, scope in list(_leases):
        if application == spark.sparkContext.applicationId:
            _end_leases(Store.of(spark), application, scope)
    _delete(spark, _application_folder(spark))
