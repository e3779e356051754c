"""Which texts hold which of many patterns, and which patterns hold a text: one pass over the texts with an automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MOST_CHARS = 1_000_000  # of patterns in one automaton, some 100 MB in a task; more patterns take another pass


def automaton(patterns: Iterable[tuple[int, str]]) -> ahocorasick.Automaton | None:
    """Patterns by number; equal ones share their numbers."""
    numbers: dict[str, list[int]] = {}
    for n, pattern in patterns:
        if pattern:
            numbers.setdefault(pattern, []).append(n)
    if not numbers:
        return None
    made = ahocorasick.Automaton()
    for pattern, held in numbers.items():
        made.add_word(pattern, held)
    made.make_automaton()
    return made


def pattern_blocks(patterns: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple]]:
    """(key, text) of the patterns in lists of at most `most` characters, or one pattern, read to the driver one by one."""
    held, size = [], 0
    for row in patterns.filter(F.col(text) != "").select(key, text).toLocalIterator():
        if held and size + len(row[1]) > most:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern_key: str, pattern: str, both: bool = False, most: int = MOST_CHARS) -> DataFrame:
    """Distinct (pattern_key, key): the text holds the pattern, or with `both` the pattern holds the text as well. Letter for letter.

    The patterns are a stated set against all texts: blocks of at most `most` characters go to every task, each in a pass of its
    own, whatever the length of a pattern. Null and empty texts and patterns match nothing. For the other direction the
    texts of a batch that are no longer than the longest pattern make an automaton that runs over the patterns.
    """
    spark, kinds, named = texts.sparkSession, dict(texts.dtypes), dict(patterns.dtypes)
    ddl = f"`{pattern_key}` {named[pattern_key]}, `{key}` {kinds[key]}"
    rows = texts.filter(F.col(text) != "").select(key, text)
    found, arrow = spark.createDataFrame([], ddl), to_arrow_type(patterns.schema[pattern_key].dataType)
    for block in pattern_blocks(patterns, pattern_key, pattern, most):
        sent = spark.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            forward, longest = automaton((n, p) for n, (_, p) in enumerate(block)), max(len(p) for _, p in block)
            for batch in batches:
                values, places = batch.column(1).to_pylist(), []
                for at, value in enumerate(values):
                    hits = {n for _, numbers in forward.iter(value) for n in numbers}
                    places += [(n, at) for n in hits]
                if both and (backward := automaton((at, v) for at, v in enumerate(values) if len(v) <= longest)):
                    places += [(n, at) for n, (_, p) in enumerate(block) for at in {a for _, numbers in backward.iter(p) for a in numbers}]
                places = sorted(set(places))
                ids = pa.array([block[n][0] for n, _ in places], arrow)
                taken = batch.column(0).take(pa.array([at for _, at in places], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, taken], [pattern_key, key])

        found = found.unionByName(rows.mapInArrow(match, ddl))
    return found.distinct()
