"""Task scheduling as table transitions: every function takes and returns whole frames, with now passed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Status ids.
OPEN, IN_PROGRESS, BLOCKED, BACKGROUND, COMPLETE, ERROR, CANCELLED, DEAD = range(8)
TERMINAL = (COMPLETE, ERROR, CANCELLED, DEAD)
LEASE_MINUTES = 5
#: IOException and TimeoutException with their subclasses in the Java library.
RETRYABLE = (
    "IOException", "TimeoutException", "EOFException", "FileNotFoundException", "InterruptedIOException", "SocketTimeoutException", "SocketException", "ConnectException",
    "BindException", "NoRouteToHostException", "PortUnreachableException", "UnknownHostException", "UnknownServiceException", "ProtocolException", "MalformedURLException", "HttpRetryException",
    "HttpTimeoutException", "HttpConnectTimeoutException", "WebSocketHandshakeException", "SSLException", "SSLHandshakeException", "SSLKeyException", "SSLPeerUnverifiedException", "SSLProtocolException",
    "ObjectStreamException", "InvalidClassException", "InvalidObjectException", "NotActiveException", "NotSerializableException", "OptionalDataException", "StreamCorruptedException", "WriteAbortedException",
    "SyncFailedException", "UTFDataFormatException", "UnsupportedEncodingException", "CharConversionException", "CharacterCodingException", "MalformedInputException", "UnmappableCharacterException", "ZipException", "JarException",
    "FileSystemException", "AccessDeniedException", "AtomicMoveNotSupportedException", "DirectoryNotEmptyException", "FileAlreadyExistsException", "FileSystemLoopException", "NoSuchFileException", "NotDirectoryException", "NotLinkException",
    "ClosedChannelException", "AsynchronousCloseException", "ClosedByInterruptException", "FileLockInterruptionException", "InterruptedByTimeoutException", "RemoteException",
)


def submit(new: DataFrame, now: Column, status: int = OPEN) -> DataFrame:
    return new.withColumns({"status": F.lit(status).cast("smallint"), "priority": F.coalesce("priority", F.lit(128)).cast("smallint"), "retry_count": F.lit(0), "executor": F.lit(None).cast("string"), "created_at": now})


def claimable(tasks: DataFrame, task_resources: DataFrame, resources: DataFrame, services: list[str]) -> DataFrame:
    """Open, unclaimed tasks whose resources are all available and below capacity; a null capacity is unlimited.

    Load is aggregated per resource before it is joined; names compare without regard to case.
    """
    available = F.array(*(F.lit(s.lower()) for s in services)).cast("array<string>")
    load = task_resources.join(tasks.where(F.col("status") == IN_PROGRESS).select(F.col("id").alias("task_id")), "task_id", "left_semi").groupBy("resource_id").agg(F.count(F.lit(1)).alias("active"))
    state = resources.join(load, F.col("id") == F.col("resource_id"), "left")
    closed = ~F.array_contains(available, F.lower("name")) | (F.col("max_concurrency").isNotNull() & (F.coalesce("active", F.lit(0)) >= F.col("max_concurrency")))
    blocked = task_resources.join(state.where(closed).select(F.col("id").alias("resource_id")), "resource_id", "left_semi").select(F.col("task_id").alias("id"))
    return tasks.where((F.col("status") == OPEN) & F.col("executor").isNull()).join(blocked, "id", "left_anti")


def claim_next(tasks: DataFrame, task_resources: DataFrame, resources: DataFrame, services: list[str], n: int = 1) -> DataFrame:
    """The first n claimable tasks by priority, then age, then id. With n above 1, capacity isn't consumed within the batch; see claim_batch."""
    return claimable(tasks, task_resources, resources, services).orderBy(F.desc("priority"), "created_at", "id").limit(n)


def claim_batch(tasks: DataFrame, task_resources: DataFrame, resources: DataFrame, services: list[str], n: int) -> DataFrame:
    """n tasks at once: on each resource, no more than its remaining capacity, in claim order.

    A task of several resources must be within the remaining capacity of each; a task above it still counts on its
    other resources, so a batch may claim fewer than single claims would, never more.
    """
    ready = claimable(tasks, task_resources, resources, services)
    load = task_resources.join(tasks.where(F.col("status") == IN_PROGRESS).select(F.col("id").alias("task_id")), "task_id", "left_semi").groupBy("resource_id").agg(F.count(F.lit(1)).alias("active"))
    limits = resources.where("max_concurrency is not null").select(F.col("id").alias("resource_id"), "max_concurrency").join(load, "resource_id", "left")
    order = Window.partitionBy("resource_id").orderBy(F.desc("priority"), "created_at", "id")
    ranked = ready.join(task_resources, F.col("task_id") == F.col("id")).join(limits, "resource_id").withColumn("rank", F.row_number().over(order))
    over = ranked.where(F.col("rank") > F.col("max_concurrency") - F.coalesce("active", F.lit(0))).select("id")
    return ready.join(over, "id", "left_anti").orderBy(F.desc("priority"), "created_at", "id").limit(n)


def apply_claim(tasks: DataFrame, claimed: DataFrame, node: str, now: Column) -> DataFrame:
    hit = claimed.select("id", F.lit(True).alias("_hit"))
    c = F.coalesce("_hit", F.lit(False))
    return tasks.join(hit, "id", "left").withColumns({"status": F.when(c, F.lit(IN_PROGRESS).cast("smallint")).otherwise(F.col("status")), "executor": F.when(c, node).otherwise(F.col("executor")), "claimed_at": F.when(c, now).otherwise(F.col("claimed_at"))}).select(*tasks.columns)


def unfinished_deps(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """task_id, unfinished: dependencies that aren't complete, 0 included."""
    joined = deps.join(tasks.select(F.col("id").alias("depends_on"), "status"), "depends_on", "left")
    return joined.groupBy("task_id").agg(F.count_if(~F.coalesce(F.col("status") == COMPLETE, F.lit(False))).alias("unfinished"))


def complete(tasks: DataFrame, deps: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Complete the listed ids that aren't terminal; blocked tasks without unfinished dependencies open again, unclaimed."""
    hit = done.select("id", F.lit(True).alias("_hit"))
    live = F.coalesce("_hit", F.lit(False)) & ~F.col("status").isin(*TERMINAL)
    after = tasks.join(hit, "id", "left").withColumns({"completed_at": F.when(live, now).otherwise(F.col("completed_at")), "status": F.when(live, F.lit(COMPLETE).cast("smallint")).otherwise(F.col("status"))}).select(*tasks.columns)
    free = unfinished_deps(deps, after).where("unfinished = 0").select(F.col("task_id").alias("id"), F.lit(True).alias("_free"))
    opens = F.coalesce("_free", F.lit(False)) & (F.col("status") == BLOCKED)
    return after.join(free, "id", "left").withColumns({"executor": F.when(opens, None).otherwise(F.col("executor")), "status": F.when(opens, F.lit(OPEN).cast("smallint")).otherwise(F.col("status"))}).select(*tasks.columns)


def failed_status(status: Column, retryable: Column, retry_count: Column, max_retries: int | None = None) -> Column:
    """Status after a failure: terminal stays, retryable opens again (no limit unless one is given), else error."""
    out = F.when(status.isin(*TERMINAL), status)
    if max_retries is not None:
        out = out.when(retryable & (retry_count >= max_retries), DEAD)
    return out.when(retryable, OPEN).otherwise(ERROR)


def dispatch_phase(any_failed: Column, any_complete: Column) -> Column:
    return F.when(any_failed, "onError").when(any_complete, "onResume").otherwise("onStart")


def stale_sweep(tasks: DataFrame, now: Column, lease_minutes: int = LEASE_MINUTES, background: int = DEAD) -> DataFrame:
    """Background tasks past expiry die (or open); tasks in progress longer than the lease open again, one retry more."""
    expired = (F.col("status") == BACKGROUND) & (F.col("expires_at") < now)
    late = (F.col("status") == IN_PROGRESS) & (F.col("claimed_at") < now - F.expr(f"interval {lease_minutes} minutes"))
    expired, late = F.coalesce(expired, F.lit(False)), F.coalesce(late, F.lit(False))
    return tasks.withColumns({"status": F.when(expired, F.lit(background)).when(late, F.lit(OPEN)).otherwise(F.col("status")).cast("smallint"), "retry_count": F.when(late, F.col("retry_count") + 1).otherwise(F.col("retry_count")), "executor": F.when(late, None).otherwise(F.col("executor"))})


def to_background(tasks: DataFrame, ids: DataFrame, now: Column, minutes: int) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit"))
    live = F.coalesce("_hit", F.lit(False)) & ~F.col("status").isin(*TERMINAL)
    return tasks.join(hit, "id", "left").withColumns({"expires_at": F.when(live, now + F.expr(f"interval {minutes} minutes")).otherwise(F.col("expires_at")), "status": F.when(live, F.lit(BACKGROUND).cast("smallint")).otherwise(F.col("status"))}).select(*tasks.columns)


def error_retryable(class_name: Column) -> Column:
    return F.substring_index(class_name, ".", -1).isin(*RETRYABLE)


def services_available(events: DataFrame, service: str, state: str, seq: list[str]) -> DataFrame:
    """Last state of each service: running is available."""
    last = events.groupBy(service).agg(F.max_by(state, F.struct(*seq)).alias("state"))
    return last.withColumn("available", F.col("state") == "RUNNING")


def join_trigger(events: DataFrame, key: list[str], type_col: str, needed: int) -> DataFrame:
    """Keys at which all needed event types have arrived."""
    return events.select(*key, type_col).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_types")).where(F.col("n_types") == needed)


class Registry:
    """Task types by name and class; a second registration of a name is an error."""

    def __init__(self) -> None:
        self.by_type: dict[str, type] = {}

    def register(self, name: str, cls: type) -> None:
        if name.lower() in self.by_type:
            raise ValueError(f"task type {name} is registered twice")
        self.by_type[name.lower()] = cls

    def lookup(self, name: str) -> type:
        return self.by_type[name.lower()]

    def type_of(self, cls: type) -> str:
        return next(k for k, v in self.by_type.items() if v is cls)
