"""Calls of a language model over rows, with the client plugged in; what follows (parsing, fallbacks) is in hooks.py.

A client is a function of (prompt, seconds) that returns text, or raises Refused (permanent: no further call), TimeoutError or any
other error (tried again). Every partition has a client of its own and a circuit breaker over its calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.repair import mended

Client = Callable[[str, float], str]
TRIES, SECONDS, MOST_TIMEOUTS, MOST_ERRORS = 3, 30.0, 3, 5


class Refused(Exception):
    """The service won't answer: no credit, no rights."""


class Breaker:
    """Opens for good on a refusal, on enough timeouts, or on enough errors; a success takes one error back."""

    def __init__(self, most_timeouts: int = MOST_TIMEOUTS, most_errors: int = MOST_ERRORS) -> None:
        self.most_timeouts, self.most_errors = most_timeouts, most_errors
        self.timeouts = self.errors = 0
        self.refused = False

    def open(self) -> bool:
        return self.refused or self.timeouts >= self.most_timeouts or self.errors >= self.most_errors

    def call(self, client: Client, prompt: str, tries: int, seconds: float) -> tuple[str | None, str | None]:
        """(answer, error)."""
        error = "breaker open"
        for _ in range(tries):
            if self.open():
                break
            try:
                answer = client(prompt, seconds)
                self.errors = max(0, self.errors - 1)
                return answer, None
            except Refused as e:
                self.refused, error = True, f"refused: {e}"
            except TimeoutError as e:
                self.timeouts, self.errors, error = self.timeouts + 1, self.errors + 1, f"timeout: {e}"
            except Exception as e:  # noqa: BLE001 - a client may fail in any way; the row says how
                self.errors, error = self.errors + 1, f"{type(e).__name__}: {e}"
        return None, error


def canned(answers: dict[str, str], default: str = "{}") -> Callable[[], Client]:
    """A client without a network: the answer of the first key that the prompt holds."""
    return lambda: lambda prompt, seconds: next((v for k, v in answers.items() if k in prompt), default)


def completed(rows: DataFrame, key: str, prompt: str, make_client: Callable[[], Client], tries: int = TRIES, seconds: float = SECONDS) -> DataFrame:
    """key, answer (repaired JSON text or null), error for each row of rows. make_client is called once a partition, on its executor."""
    kind = dict(rows.dtypes)[key]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, breaker = make_client(), Breaker()
        for batch in batches:
            got = [breaker.call(client, p or "", tries, seconds) for p in batch.column(1).to_pylist()]
            answers = [None if a is None else mended(a) for a, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array([e for _, e in got], pa.string())], [key, "answer", "error"])

    return rows.select(key, prompt).mapInArrow(ask, f"`{key}` {kind}, answer string, error string")


def within_budget(rows: DataFrame, by: Sequence[str], order: Sequence, most: int, used: DataFrame | None = None) -> DataFrame:
    """rows with `reserved`: whether the call of a row is within its request's budget of `most` calls, in order.

    used (by, calls) has what a request has spent before. A reserved call counts whether it succeeds or not.
    """
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    spent = F.lit(0)
    if used is not None:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in by])
        numbered = numbered.join(used.select(*[F.col(c).alias(f"_u_{c}") for c in by], F.col("calls").alias("_spent")), same, "left")
        spent = F.coalesce("_spent", F.lit(0))
    return numbered.withColumn("reserved", F.col("_n") + spent <= most).select(*rows.columns, "reserved")


# Letters of an abstract in each step, papers of a batch, papers of a request that are reviewed.
STEP_LETTERS, BATCH_SIZE, MOST_REVIEWED, LEAST_SPLIT = (800, 800, 200, 100), 8, 80, 2
ENTRY = ("paper_id", "title", "abstract", "year", "venue", "citation_count", "retrieval_path")


def reviewed_in_steps(papers: DataFrame, by: str, order: Sequence, make_client: Callable[[], Client], features: Sequence[str] = (), plan: str | None = None, size: int = BATCH_SIZE, most: int = MOST_REVIEWED, seconds: float = SECONDS) -> DataFrame:
    """by, paper_id, step, selection (JSON text): a model's judgements of a request's first `most` papers, asked in batches.

    A batch without any judgement is asked again: in halves if it has more than two papers (2), with abstracts of 200 letters (3), with
    100 letters and the columns `features` (4). A judgement counts if it names a paper of its batch, the last one of each. What
    no step brought is left to the caller's fallback (hooks.reviewed). papers has by, the ENTRY columns and `order`.
    Each step's calls are made when this runs and kept in the folder of spark.checkpoint.dir, so none is made again.
    """
    numbered = papers.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_nth") <= most)
    numbered = numbered.withColumn("_batch", F.floor((F.col("_nth") - 1) / size))
    open_, found = numbered.withColumn("_size", F.count("*").over(Window.partitionBy(by, "_batch"))), None
    for step, letters in enumerate(STEP_LETTERS, 1):
        half = F.when((F.col("_nth") - 1) % size < F.floor(F.col("_size") / 2), 0).otherwise(1) if step == 2 else F.lit(0)
        asked = (open_.filter(F.col("_size") > LEAST_SPLIT) if step == 2 else open_).withColumn("_half", half)
        fields = [F.substring(F.coalesce("abstract", F.lit("")), 1, letters).alias("abstract") if c == "abstract" else F.col(c) for c in ENTRY]
        entry = F.struct(*fields, *(features if step == len(STEP_LETTERS) else ()))
        key = F.to_json(F.struct(F.col(by), "_batch", "_half")).alias("_key")
        batches = asked.groupBy(by, "_batch", "_half").agg(F.array_sort(F.collect_list(F.struct("_nth", entry.alias("e")))).alias("_p"), *([F.first(plan).alias("_plan")] if plan else []))
        parts = [F.col("_plan").alias("plan")] if plan else []
        batches = batches.withColumn("_prompt", F.to_json(F.struct(*parts, F.transform("_p", lambda p: p["e"]).alias("papers")))).withColumn("_ids", F.transform("_p", lambda p: p["e"]["paper_id"]))
        batches = batches.select(by, "_batch", "_half", key, "_prompt", "_ids")
        answers = completed(batches, "_key", "_prompt", make_client, 1, seconds)
        listed = F.coalesce(F.from_json(F.get_json_object("answer", "$.selections"), "array<string>"), F.from_json("answer", "array<string>"))
        items = answers.join(batches, "_key").select(by, "_batch", "_ids", F.posexplode(listed).alias("_at", "selection")).withColumn("paper_id", F.get_json_object("selection", "$.paper_id"))
        items = items.filter(F.array_contains("_ids", F.col("paper_id"))).groupBy(by, "_batch", "paper_id").agg(F.max_by("selection", "_at").alias("selection"))
        got = items.withColumn("step", F.lit(step)).checkpoint()
        found = got if found is None else found.unionByName(got)
        done = got.select(F.col(by).alias("_by"), F.col("_batch").alias("_b")).distinct()
        open_ = open_.join(done, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_batch") == F.col("_b")), "left_anti")
    return found.select(by, "paper_id", "step", "selection")
