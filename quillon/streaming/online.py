"""Streams: circuit breakers, token buckets, partial transcripts, answer events; each as a fold that holds one state a key.

``folded`` runs a fold over a table (sorted inside hash partitions, one state at a time), ``streamed`` the same fold over a
stream with Spark's keyed state; both call the same step function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Failures in a row that open a breaker and ms it stays open; least ms a bucket waits; letters of a partial that is searched for.
FAILURES, COOLDOWN, LEAST_WAIT, SPECULATE = 3, 15_000, 50.0, 12

Step = Callable[[tuple, tuple], tuple[tuple, tuple]]


def folded(rows: DataFrame, key: str, order: list[str], reads: list[str], step: Step, state: tuple, out: str) -> DataFrame:
    """(key, order, what ``step`` says) of every row; ``step`` (state, row's ``reads``) gives (state, values for ``out``)."""
    names = [f.name for f in StructType.fromDDL(out).fields]
    kept = [key, *order]
    ddl = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", " + out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, first = None, state, True
        for batch in batches:
            said: list[list] = [[] for _ in names]
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in reads]
            for k, *values in zip(batch.column(0).to_pylist(), *columns, strict=True):
                if first or k != now:
                    now, held, first = k, state, False
                held, values = step(held, tuple(values))
                for column, v in zip(said, values, strict=True):
                    column.append(v)
            table = pa.Table.from_batches([batch]).select(kept)
            for name, column in zip(names, said, strict=True):
                table = table.append_column(name, pa.array(column))
            yield from table.to_batches()

    picked = rows.select(*kept, *[c for c in reads if c not in kept])
    return picked.repartition(key).sortWithinPartitions(*kept).mapInArrow(run, ddl)


def streamed(stream: DataFrame, key: str, order: list[str], reads: list[str], step: Step, state: tuple, state_ddl: str, out: str) -> DataFrame:
    """``folded`` over a stream: rows of a micro-batch in order, the state kept between batches; late rows follow."""
    names = [f.name for f in StructType.fromDDL(out).fields]
    ddl = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in [key, *order]) + ", " + out

    def run(k, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else state
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, ignore_index=True)
        said = []
        for values in rows[reads].itertuples(index=False, name=None):
            now, values = step(tuple(now), values)
            said.append(values)
        held.update(tuple(now))
        yield pd.concat([rows[[key, *order]], pd.DataFrame(said, columns=names)], axis=1)

    return stream.select(key, *order, *[c for c in reads if c not in (key, *order)]).groupBy(key).applyInPandasWithState(run, ddl, state_ddl, "append", "NoTimeout")


def breaker_step(failures: int = FAILURES, cooldown: int = COOLDOWN) -> Step:
    """State (failures in a row, ms of opening); a row is (ms, failed). Says whether the call was let through and the breaker is open after it."""

    def step(held: tuple, row: tuple) -> tuple[tuple, tuple]:
        (n, opened), (ms, failed) = held, row
        if n >= failures:
            if ms - opened <= cooldown:
                return (n, opened), (False, True)
            n = failures - 1  # one trial
        n = n + 1 if failed else 0
        opened = ms if n >= failures else opened
        return (n, opened), (True, n >= failures)

    return step


def bucket_step(per_minute: float) -> Step:
    """State (available, ms of the last refill; -1 before the first); a row is (ms, cost). Says how many ms the call waits."""

    def step(held: tuple, row: tuple) -> tuple[tuple, tuple]:
        (available, last), (ms, cost) = held, row
        want = min(cost, per_minute)
        now = float(ms) if last < 0 else max(float(ms), last)  # calls of a key go one after the other
        available = min(per_minute, available + (now - last) / 60_000 * per_minute) if last >= 0 else per_minute
        if available < want:
            wait = max(LEAST_WAIT, (want - available) / per_minute * 60_000)
            now += wait
            available = min(per_minute, available + wait / 60_000 * per_minute)
        return (available - want, now), (now - ms,)

    return step


def partial_step(held: tuple, row: tuple) -> tuple[tuple, tuple]:
    """State (text last searched for,); a row is (text,). Says whether a partial transcript starts a search of its own."""
    text = (row[0] or "").strip()
    fires = len(text) > SPECULATE and text != held[0]
    return ((text,) if fires else held), (fires,)


def answer_events(events: DataFrame, key: str, order: str, kind: str, text: str) -> DataFrame:
    """(key, said, status): an answer put together from its events in order (t: text, insufficient, error, done)."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    g = events.groupBy(key).agg(rows.alias("rows"))  # an answer's events
    has = lambda k: F.exists("rows", lambda x: x["kind"] == k)
    said = F.array_join(F.transform(F.filter("rows", lambda x: x["kind"] == "t"), lambda x: x["t"]), "")
    return g.select(key, said.alias("said"), F.when(has("error"), "error").when(has("insufficient"), "insufficient").when(has("done"), "done").otherwise("open").alias("status"))


def tool_rounds(transcripts: DataFrame, key: str, order: str, role: str, most: int = 2) -> DataFrame:
    """(key, rounds, offered): rounds in which a tool was called, ``most`` at most, and whether one may be called again."""
    n = transcripts.groupBy(key).agg(F.count_if(F.col(role) == "assistant_tool").alias("calls"))
    return n.select(key, F.least(F.col("calls"), F.lit(most)).cast("long").alias("rounds"), (F.col("calls") < most).alias("offered"))


def append_new(batches: DataFrame, path: str, checkpoint: str, by: str):
    """Arriving rows to a Parquet folder by ``by``, from where the checkpoint says; ends when what is there has been read."""
    writer = batches.writeStream.format("parquet").partitionBy(by).option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
