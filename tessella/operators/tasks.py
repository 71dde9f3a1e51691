"""Task table: pages, states, progress; and configuration overlay and diff."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WAITING, DONE, FAILED, RUNNING = 0, 1, 2, 3


def page(tasks: DataFrame, number: int, size: int, status: int | None = None, key: str = "id") -> DataFrame:
    """A page from 1, newest key first; pages out of range are empty."""
    if number < 1 or size < 1:
        raise ValueError("pages and their size count from 1")
    rows = tasks if status is None else tasks.where(F.col("status") == status)
    return rows.orderBy(F.desc(key)).offset((number - 1) * size).limit(size)


def page_info(tasks: DataFrame, size: int) -> DataFrame:
    return tasks.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(size)).cast("long"))


def reset_unfinished(tasks: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Waiting and running tasks set back to waiting, to be queued again in the order of their ids."""
    back = tasks.where(F.col("status").isin(WAITING, RUNNING)).withColumns({"status": F.lit(WAITING), "progress": F.lit(0), "createtime": now})
    return back.orderBy(key)


def fold_states(events: DataFrame, task: str, order: list[str], kind: str, stop_note: str = "Stopped Before Start") -> DataFrame:
    """State of each task after its events start, finish, fail and stop.

    0 waits for start (3) or stop (2, with a note); 3 ends by finish (1), fail or stop (2); 1 and 2 are final. Each event is
    a map of states, so the fold is: the first start or stop leaves 0, and the first finish, fail or stop after a start
    leaves 3. Both are minima, taken in the scan of the events.
    """
    at = F.struct(*order, kind)
    relevant = events.where(F.col(kind).isin("start", "finish", "fail", "stop"))
    first = relevant.where(F.col(kind).isin("start", "stop")).groupBy(task).agg(F.min(at).alias("first"))
    later = relevant.where(F.col(kind) != "start").join(first, task).where((F.col(f"first.{kind}") == "start") & (at > F.col("first")))
    last = later.groupBy(task).agg(F.min(at).alias("last"))
    every = events.select(task).distinct()
    folded = every.join(first, task, "left").join(last, task, "left")
    ended = F.when(F.col(f"last.{kind}") == "finish", DONE).when(F.col("last").isNotNull(), FAILED)
    status = F.when(F.col("first").isNull(), WAITING).when(F.col(f"first.{kind}") == "stop", FAILED).otherwise(F.coalesce(ended, F.lit(RUNNING)))
    note = F.when(F.col(f"first.{kind}") == "stop", stop_note)
    return folded.select(task, status.alias("status"), note.alias("content"))


def throttle(events: DataFrame, task: str, time: str, order: list[str], gap: float) -> DataFrame:
    """Events that are accepted: the first of each task, then each that comes `gap` seconds or more after the last accepted.

    Acceptance depends on all before, so each task's events stream in order through one sorted partition; only the last
    accepted time is held, however many events a task has.
    """
    wait = int(gap * 1_000_000)
    rows = events.select(F.col(task), F.unix_micros(time).alias("_t"), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            take = []
            for own, t in zip(batch.column(task).to_pylist(), batch.column("_t").to_pylist()):
                if own != now or last is None or t - last >= wait:
                    now, last = own, t
                    take.append(True)
                else:
                    take.append(False)
            yield batch.filter(pa.array(take, pa.bool_()))

    return rows.repartition(task).sortWithinPartitions(task, "_t", *order).mapInArrow(run, rows.schema).drop("_t")


def progress_percent(number: Column, total: Column, share: float = 1.0, begun: float = 0.0) -> Column:
    """Percent done while one of several sources is worked on; null between the reports of every tenth."""
    return F.when(number % 10 == 0, number / total * 99.0 * share + begun * 100.0)


def valid_progress(progress: Column) -> Column:
    return progress.cast("int").isNotNull() & (progress.cast("int") == progress) & progress.between(0, 100)


def overlay(local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """Local settings with the remote ones over them."""
    r = remote.select(key, F.col(value).alias("_r"))
    return local.join(r, key, "full").select(key, F.coalesce("_r", value).alias(value))


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """add, update and delete between two settings; equal values give nothing. A null new value counts as deleted."""
    o, n = old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_in")), new.select(key, F.col(value).alias("_n"))
    kind = F.when(F.col("_in") & F.col("_n").isNull(), "delete").when(F.col("_in") & ~F.col("_o").eqNullSafe(F.col("_n")), "update").when(
        F.col("_o").isNull() & F.col("_n").isNotNull(), "add"
    )
    joined = o.join(n, key, "full").withColumn("change", kind)
    return joined.where(F.col("change").isNotNull()).select(key, "change", F.when(F.col("change") == "delete", F.col("_o")).otherwise(F.col("_n")).alias(value))


def look_up_params(inputs: Column, outputs: Column, key: str) -> Column:
    """A parameter of a task: the input's, else the output's, else null."""
    return F.coalesce(F.try_element_at(inputs, F.lit(key)), F.try_element_at(outputs, F.lit(key)))


def download_urls(params: Column, base: Column, drop: str = "file_list") -> Column:
    """Output parameters with each path as an address below base; the key `drop` goes."""
    kept = F.map_filter(params, lambda k, v: k != drop)
    return F.transform_values(kept, lambda k, v: F.concat(base, F.lit("/"), F.element_at(F.split(v, "/"), -1)))


def without_uploads(params: Column) -> Column:
    """Parameters (map of JSON values) as a user sees them: an uploaded file, a list of two, is shown by its first part."""
    return F.transform_values(params, lambda k, v: F.when(F.json_array_length(v) == 2, F.get_json_object(v, "$[0]")).otherwise(v))


def with_services(tasks: DataFrame, services: DataFrame, kind: str = "tasktype") -> DataFrame:
    """Tasks with the service of their kind; a task of an unknown kind keeps nulls and `known` false. A row for each kind is broadcast."""
    known = services.withColumn("known", F.lit(True))
    return tasks.join(F.broadcast(known), kind, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def new_tasks(requests: DataFrame, last_id: int, now: Column, order: str) -> DataFrame:
    """Rows of the task table for requests (tasktype, inputparams), waiting, with ids after the last."""
    from tessella.operators.dataset import number_rows

    return number_rows(requests, [order], "id", first=last_id + 1).withColumns({"status": F.lit(WAITING), "progress": F.lit(0), "createtime": now})
