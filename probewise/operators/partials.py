"""Sums of numeric vectors that every partition contributes to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from probewise.functions.kernels import as_list_column, as_matrix
from probewise.schemas import PARTIAL_SUMS

BLOCK = 1 << 12     # numbers of a vector that travel as one array
TOGETHER = 1 << 23  # numbers that one job brings to the driver, unless one scope alone has more
FAN = 64            # partial results of one key that meet at the end
HELD = 1 << 20      # numbers of running moments that a task keeps before it sends them on


def added(vectors: Column) -> Column:
    """The sum of an array of equally long arrays, place by place."""
    return F.reduce(F.slice(vectors, 2, F.size(vectors)), F.get(vectors, F.lit(0)),
                    lambda total, v: F.zip_with(total, v, lambda a, b: a + b))


def fanned_in(parts: DataFrame, keys: list[str], value: str, merge: Callable[[Column], Column]) -> DataFrame:
    """(keys, value): all ``value`` of a key merged into one, ``merge`` taking an array of them.

    A key's partial results, one or so from each task, meet in ``FAN`` places first and the results of these at the end, so
    no task gathers what all others have sent.
    """
    out = parts.withColumn("fan", F.spark_partition_id() % FAN)
    for by in ([*keys, "fan"], keys):
        out = out.groupBy(*by).agg(F.collect_list(value).alias(value)).filter(F.size(value) > 0).withColumn(value, merge(F.col(value)))
    return out.select(*keys, value)


def summed(rows: DataFrame, kernel: Callable[[int, dict[str, pa.Array]], np.ndarray],
           slots: dict[int, int], whole: tuple[int, ...] = (), few: bool = False) -> dict[int, np.ndarray]:
    """Add up ``kernel(scope_id, columns)`` over all batches of each scope in ``slots``.

    Every row also counts for the scopes in ``whole``, besides its own. A task adds its own
    batches first and emits each scope's vector in blocks; Spark adds those by (scope, block) in two steps, and
    the driver receives the totals; the sums of ``few`` tasks (``FAN`` at most) need no shuffle before. Scopes
    with many sums take turns, so no number of them is refused.
    """
    out, turn, size = {}, {}, 0
    for scope_id, n in slots.items():
        if turn and size + n > TOGETHER:
            out.update(_summed(rows, kernel, turn, whole, few))
            turn, size = {}, 0
        turn[scope_id] = n
        size += n
    return {**out, **_summed(rows, kernel, turn, whole, few)} if turn else out


def _summed(rows: DataFrame, kernel, slots: dict[int, int], whole: tuple[int, ...], few: bool) -> dict[int, np.ndarray]:
    wanted = set(slots)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column("scope_id").to_numpy(zero_copy_only=False)
            met = set(np.unique(ids).tolist()) | set(whole)
            for scope_id in sorted(met & wanted):
                mine = ids == scope_id
                part = batch if scope_id in whole or mine.all() else batch.take(pa.array(np.flatnonzero(mine)))
                if not part.num_rows:
                    continue
                columns = dict(zip(part.schema.names, part.columns))
                value = kernel(int(scope_id), columns)
                totals[scope_id] = totals[scope_id] + value if scope_id in totals else value
        yield from vectors_in_blocks(totals)

    out = totals_by_scope(rows.mapInArrow(add_up, PARTIAL_SUMS), few)
    return {scope_id: out.get(scope_id, np.zeros(n)) for scope_id, n in slots.items()}


def vectors_in_blocks(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(scope_id, block, part): each scope's vector in blocks, as ``totals_by_scope`` adds them up."""
    for scope_id, total in totals.items():
        starts = np.arange(0, len(total) + BLOCK, BLOCK).clip(max=len(total))
        blocks = len(starts) - 1
        values = pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.array(total.astype(np.float64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(blocks, scope_id, dtype=np.int32)), pa.array(np.arange(blocks, dtype=np.int32)), values],
            names=["scope_id", "block", "part"])


def totals_by_scope(parts: DataFrame, few: bool = False) -> dict[int, np.ndarray]:
    """The sum of all vectors of each scope, on the driver; ``few`` of them need no shuffle before."""
    sums = parts.toArrow() if few else fanned_in(parts, ["scope_id", "block"], "part", added).toArrow()
    blocks: dict[tuple[int, int], np.ndarray] = {}
    for scope_id, block, total in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), sums.column(2)):
        values = total.values.to_numpy()
        held = blocks.get((scope_id, block))
        blocks[scope_id, block] = values if held is None else held + values
    out: dict[int, list[np.ndarray]] = {}
    for (scope_id, _), values in sorted(blocks.items()):
        out.setdefault(scope_id, []).append(values)
    return {scope_id: np.concatenate(values) for scope_id, values in out.items()}


_MOMENTS = "struct<n: double, mean: array<double>, spread: array<double>>"


def _merged(a: Column, b: Column) -> Column:
    """Moments of two groups of vectors as those of both, without the difference of large squares."""
    n = a["n"] + b["n"]
    apart = F.zip_with(b["mean"], a["mean"], lambda y, x: y - x)
    mean = F.zip_with(a["mean"], apart, lambda x, d: x + d * b["n"] / n)
    inside = F.zip_with(a["spread"], b["spread"], lambda x, y: x + y)
    spread = F.zip_with(inside, apart, lambda x, d: x + d * d * a["n"] * b["n"] / n)
    return F.struct(n.alias("n"), mean.alias("mean"), spread.alias("spread"))


class _Running:
    """Moments by group of the batches of one task."""

    def __init__(self) -> None:
        self.groups: dict[tuple, list] = {}
        self.numbers = 0

    def add(self, key: tuple, n: float, mean: np.ndarray, spread: np.ndarray) -> None:
        if key not in self.groups:
            self.groups[key] = [n, mean, spread]
            self.numbers += 2 * len(mean)
            return
        held = self.groups[key]
        total, apart = held[0] + n, mean - held[1]
        held[2] = held[2] + spread + apart * apart * (held[0] * n / total)
        held[1] = held[1] + apart * (n / total)
        held[0] = total

    def taken(self, fields: list[pa.Field]) -> pa.RecordBatch:
        groups, self.groups, self.numbers = self.groups, {}, 0
        columns = [pa.array([key[i] for key in groups], type=f.type) for i, f in enumerate(fields)]
        n, mean, spread = ([g[i] for g in groups.values()] for i in range(3))
        part = pa.StructArray.from_arrays(
            [pa.array(n, pa.float64()), as_list_column(np.array(mean)), as_list_column(np.array(spread))], ["n", "mean", "spread"])
        return pa.RecordBatch.from_arrays([*columns, part], [*(f.name for f in fields), "part"])


def vector_moments(rows: DataFrame, keys: tuple[str, ...] = (), x: str = "x", few: bool = True) -> DataFrame:
    """(keys, n, mean, spread): mean vector of each group and the summed squared distances from it, by component.

    A task keeps running moments of the groups it meets and sends one row for each, more only when it meets so many that they pass
    ``HELD`` numbers; those are merged in two steps, or in one where groups are not ``few`` and each comes from few tasks.
    """
    named = {k: rows.schema[k] for k in keys}
    schema = ", ".join([f"`{k}` {f.dataType.simpleString()}" for k, f in named.items()] + [f"part {_MOMENTS}"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, fields = _Running(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.schema.field(k) for k in keys]
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for k in keys:
                values = batch.column(k).dictionary_encode(null_encoding="encode")
                code = code * (len(values.dictionary) + 1) + values.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
            matrix = as_matrix(batch.column(x))[order]
            n = np.diff(np.append(starts, len(code)))
            mean = np.add.reduceat(matrix, starts, axis=0) / n[:, None]
            spread = np.add.reduceat((matrix - np.repeat(mean, n, axis=0)) ** 2, starts, axis=0)
            first = pa.array(order[starts])
            named_groups = list(zip(*(batch.column(k).take(first).to_pylist() for k in keys))) if keys else [()]
            for key, own in zip(named_groups, zip(n.astype(float), mean, spread)):
                running.add(key, *own)
                if running.numbers >= HELD:
                    yield running.taken(fields)
        if running.groups:
            yield running.taken(fields)

    parts = rows.select(*keys, F.col(x).cast("array<double>").alias(x)).mapInArrow(add_up, schema)

    def together(values: Column) -> Column:
        return F.reduce(F.slice(values, 2, F.size(values)), F.get(values, F.lit(0)), _merged)

    if few:
        whole = fanned_in(parts, list(keys), "part", together)
    else:
        whole = parts.groupBy(*keys).agg(F.collect_list("part").alias("part")).withColumn("part", together(F.col("part")))
    return whole.select(*keys, F.col("part.n").cast("long").alias("n"), "part.mean", "part.spread")
