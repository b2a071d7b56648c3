"""Many patterns searched in many texts at once by automata of bounded size.

Patterns are dealt to shards of about SHARD rows, which are sent to the executors one broadcast each; a task builds the automaton
of a shard once and reads each text once for it, so the cost of a text does not grow with the number of patterns of a shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loregraph.functions.tables import saved

#: Patterns of a shard, on average; rows of a batch of results.
SHARD, ROWS = 200_000, 50_000

#: The last automata of this Python process, by shard.
_built: dict[str, object] = {}


def kept(name: str, sent: Broadcast, build: Callable[[list], object]) -> object:
    """build(the broadcast rows), once a process."""
    if name not in _built:
        while len(_built) > 1:
            _built.pop(next(iter(_built)))
        _built[name] = build(sent.value)
    return _built[name]


def searched(texts: DataFrame, patterns: DataFrame, build: Callable[[list], object], hits: Callable, out: str, shard: int | None = None) -> DataFrame:
    """Rows of schema `out` from hits(automaton, row of texts), tuples in the order of that schema. The automaton of a shard is
    build(rows of patterns, as tuples)."""
    patterns = saved(patterns.distinct())
    shards = -(-patterns.count() // (shard or SHARD))
    spark = texts.sparkSession
    schema = spark.createDataFrame([], out).schema
    kinds = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    def part(sent: Broadcast) -> DataFrame:
        name = uuid.uuid4().hex

        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = kept(name, sent, build)
            for table in tables:
                rows: list[tuple] = []
                for row in zip(*[c.to_pylist() for c in table.columns]):
                    rows.extend(hits(machine, row))
                    if len(rows) >= ROWS:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

        return texts.mapInArrow(run, out)

    own = F.pmod(F.xxhash64(*patterns.columns), F.lit(max(shards, 1)))
    parts = [part(spark.sparkContext.broadcast([tuple(r) for r in patterns.where(own == i).collect()])) for i in range(shards)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], out)


def of_strings(values: dict[str, object]) -> ahocorasick.Automaton:
    """An automaton that finds the keys, none of which is empty, and yields their values."""
    machine = ahocorasick.Automaton()
    for key, value in values.items():
        machine.add_word(key, value)
    if len(machine):
        machine.make_automaton()
    return machine
