"""Calls of a function outside of Spark, some rows a call, several calls at once in each task."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

GIVEN = 1000


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of `size` rows (the last one may be shorter), whatever the batches are."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= size:
            t = pa.Table.from_batches(held)
            whole = rows - rows % size
            for k in range(0, whole, size):
                yield t.slice(k, size)
            held, rows = t.slice(whole).to_batches(), rows - whole
    if rows:
        yield pa.Table.from_batches(held)


def _called(fn: Callable[[list[dict]], list], rows: list[dict], tries: int, wait: float) -> tuple[list, str | None, int]:
    """(answers, error, calls). A call fails when it raises or gives another number of answers than rows."""
    error = None
    for n in range(1, tries + 1):
        try:
            got = list(fn(rows))
            if len(got) == len(rows):
                return got, None, n
            error = f"{len(got)} answers for {len(rows)} rows"
        except Exception as e:  # whatever the caller's function raises is reported by row
            error = f"{type(e).__name__}: {e}"
        if n < tries and wait:
            time.sleep(wait * 2 ** (n - 1))
    return [None] * len(rows), error, tries


def batched_calls(df: DataFrame, fn: Callable[[list[dict]], list], size: int, workers: int = 4, tries: int = 3, wait: float = 1.0, kind: str = "string", names: tuple[str, str, str] = ("answer", "error", "calls")) -> DataFrame:
    """df with an answer for each row. Each task makes ceil(rows / size) calls, plus those repeated after a failure (after
    `wait` seconds, then twice as long, ...), over the edges of Arrow batches; up to `workers` at a time in threads, and as
    many chunks more wait, so a task holds 2 * workers * size rows, and GIVEN answered ones, which go on as one batch: batches of a row
each take longer than short calls. Rows come back in their order. After `tries` failed
    calls the chunk's rows have a null answer and the error. A task that is lost calls again."""
    answer, error, calls = names
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns of these names are there already: {sorted(clash)}")
    schema = StructType.fromDDL(f"{answer} {kind}, {error} string, {calls} int")
    from pyspark.sql.pandas.types import to_arrow_type

    to = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table, call: Future) -> tuple[pa.Table, pa.Array, str | None, int]:
            got, problem, n = call.result()
            try:
                return rows, pa.array(got, to), problem, n
            except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
                return rows, pa.nulls(len(got), to), f"{type(e).__name__}: {e}", n

        def given(held: list[tuple[pa.Table, pa.Array, str | None, int]]) -> list[pa.RecordBatch]:
            out = pa.concat_tables([t for t, *_ in held])
            problems = pa.array([p for t, _, p, _ in held for _ in range(t.num_rows)], pa.string())
            counts = pa.array([n for t, _, _, n in held for _ in range(t.num_rows)], pa.int32())
            for name, column in ((answer, pa.chunked_array([a for _, a, _, _ in held], to)), (error, problems), (calls, counts)):
                out = out.append_column(name, column)
            return out.combine_chunks().to_batches()

        with ThreadPoolExecutor(workers) as pool:
            pending: deque[tuple[pa.Table, Future]] = deque()
            held: list = []
            n_held = 0
            for chunk in _chunks(batches, size):
                pending.append((chunk, pool.submit(_called, fn, chunk.to_pylist(), tries, wait)))
                if len(pending) >= 2 * workers:
                    held.append(done(*pending.popleft()))
                    n_held += held[-1][0].num_rows
                    if n_held >= GIVEN:
                        yield from given(held)
                        held, n_held = [], 0
            held += [done(*p) for p in pending]
            if held:
                yield from given(held)

    return df.mapInArrow(run, StructType([*df.schema, *schema]))
