"""The judge over a stream of questions, with a state for each question and run: asked once, retried by timers, never read back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.functions.fixed_values import RUBRIC
from tessera.operators.judge import CARRIED, Client, parse_reply, prompts_of_runs, result_columns
from tessera.sources.documents import read_prior_results

_KEPT = ("row_idx", *CARRIED, "prompt")
_STATE = "attempts int, done boolean, row_idx long, section string, label string, n_choices int, in_repeat boolean, repeat_name string, prompt string"
_ANSWERED = "name string, run int, row_idx long, section string, label string, n_choices int, in_repeat boolean, repeat_name string, reply string, error string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Asking(StatefulProcessor):
    """Asks a question once. After a failure it waits backoff seconds times the attempts so far, as a timer, and holds no task meanwhile; without timers it
    asks again at once.

    A question that has its answer, or has failed retries times, keeps only that in its state: seen again, it gives nothing.
    """

    def __init__(self, client: Client, retries: int, backoff: float, timers: bool) -> None:
        self.client, self.retries, self.backoff, self.timers = client, retries, backoff, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("question", _STATE)

    def _ask(self, key: tuple, question: dict[str, Any], attempts: int, now: int) -> Iterator[pd.DataFrame]:
        while True:
            reply = error = None
            try:
                reply = self.client(RUBRIC, question["prompt"], int(key[1]))
            except Exception as failure:  # noqa: BLE001  whatever the client raises is a failed attempt
                error = str(failure)
            if error is None or attempts >= self.retries:
                break
            if self.timers:
                self.handle.registerTimer(now + int(1000 * self.backoff * attempts))
                self.state.update((attempts, False, *(question[c] for c in _KEPT)))
                return
            attempts += 1
        self.state.update((attempts, True, *(None for _ in _KEPT)))
        yield pd.DataFrame([{"name": key[0], "run": key[1], **{c: question[c] for c in ("row_idx", *CARRIED)}, "reply": reply, "error": error}]).astype(object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = next(iter(rows))
        for _ in rows:
            pass
        if not self.state.exists():
            question = first.iloc[0].astype(object).where(first.iloc[0].notna(), None).to_dict()
            yield from self._ask(key, question, 1, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, done, *kept = self.state.get()
        if not done:
            yield from self._ask(key, dict(zip(_KEPT, kept)), attempts + 1, timerValues.getCurrentProcessingTimeInMs())

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        self.state.update((0, True, *(None for _ in _KEPT)))

    def close(self) -> None:
        pass


def judge_stream(questions: DataFrame, client: Client, output: str, checkpoint: str, runs: int = 1, retries: int = 3, backoff: float = 30.0, retry_failed: bool = False, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Starts a query that adds results to the Parquet folder `output`; names must not be null.

    The state, by name and run, lives in the checkpoint folder. Results that the output folder has when a checkpoint begins are its
    first state (failed ones aren't, if retry_failed), and are read that once; a batch reads its own questions alone. A batch writes
    a folder of its own, so one that is run again after a failure replaces what it wrote. The trigger is availableNow by default, under
    which the query ends and so can't wait: failed questions are asked again at once. With a processing time, timers ask again as they come due.
    """
    trigger = trigger or {"availableNow": True}
    timers = "processingTime" in trigger
    spark = questions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    prior = read_prior_results(spark, output, "name string, run int, clarity_score double")
    prior = prior.where(F.col("clarity_score").isNotNull()) if retry_failed else prior
    asked = prompts_of_runs(questions, runs).select("name", "run", F.col("row_idx").cast("long").alias("row_idx"), *CARRIED, "prompt")
    answered = asked.groupBy("name", "run").transformWithStateInPandas(Asking(client, retries, backoff, timers), _ANSWERED, "append", "processingTime" if timers else "none", prior.select("name", "run").distinct().groupBy("name", "run"))
    results = result_columns(parse_reply(answered))
    part = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={part}-{number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
