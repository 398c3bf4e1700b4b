"""Judging questions: prompts, a pluggable client with retries, parsing, and resuming."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from tessera.functions.fixed_values import DIMENSIONS, NO_CHOICES, PARSE_ERROR, PROMPT, REPEAT_CONTEXT, REVIEW, RUBRIC
from tessera.functions.numbers import python_round
from tessera.functions.text import run_tag, unfence

SCORES = [f"{d}_score" for d in DIMENSIONS]
COMMENTS = [f"{d}_comment" for d in DIMENSIONS]
BASE = ("section", "name", "label", "n_choices", "in_repeat", "repeat_name")


def context_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REPEAT_CONTEXT.items()), "ctx_name string, context string")


def prompt(context: Column) -> Column:
    """The question put to the judge, as a plain expression; continuation lines are indented by four."""
    options = F.when(F.coalesce(F.size("choices"), F.lit(0)) <= 0, F.lit(NO_CHOICES)).otherwise(F.array_join(F.transform("choices", lambda c: F.concat(F.lit("  - "), F.coalesce(c["value"], F.lit("None")), F.lit(": "), F.coalesce(c["label"], F.lit("None")))), "\n"))
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    said = lambda part, c: F.concat(F.lit(PROMPT[part]), c)
    relevant = F.when(given("relevant"), said("relevant", F.col("relevant"))).otherwise("")
    block = F.when(F.coalesce(context != "", F.lit(False)), said("context", context)).otherwise("")
    repeat = F.when(F.coalesce("in_repeat", F.lit(False)) & given("repeat_name"), F.concat(said("repeat", F.col("repeat_name")), block)).otherwise("")
    return F.concat(*[said(c, F.coalesce(c, F.lit("None"))) for c in ("section", "name", "label", "type")], relevant, repeat, said("choices", options))


def with_prompts(questions: DataFrame) -> DataFrame:
    """Questions with their prompt; the context table has a dozen rows."""
    joined = questions.join(F.broadcast(context_table(questions.sparkSession)), F.col("repeat_name") == F.col("ctx_name"), "left")
    return joined.withColumn("prompt", prompt(F.col("context"))).drop("ctx_name", "context")


def pending(questions: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("name",), retry_failed: bool = False) -> DataFrame:
    """Questions without a result. A failed result counts as one, unless retry_failed."""
    finished = done.where(F.col("clarity_score").isNotNull()) if retry_failed else done
    return questions.join(finished.select(*keys).distinct(), list(keys), "left_anti")


class Client(Protocol):
    def __call__(self, system: str, prompt: str, run: int) -> str: ...


class StubClient:
    """Deterministic replies without a network: scores from a digest of prompt and run."""

    def __call__(self, system: str, prompt: str, run: int) -> str:
        d = hashlib.sha256(f"{run}\n{prompt}".encode()).digest()
        reply = {k: 1 + d[i] % 5 for i, k in enumerate(SCORES)} | {k: "stub" for k in COMMENTS}
        return json.dumps(reply | {"synthetic_generation_issues": "ninguno", "suggested_improvement": "ninguna"})


def ask(client: Client, question: str, run: int, retries: int = 3, backoff: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(reply, None), or (None, error) after the last failure; waits grow by backoff. Replies that don't parse aren't retried."""
    for attempt in range(1, retries + 1):
        try:
            return client(RUBRIC, question, run), None
        except Exception as error:  # noqa: BLE001  whatever the client raises is a failed attempt
            if attempt == retries:
                return None, str(error)
            sleep(backoff * attempt)
    return None, "no attempt was made"


def call_judge(prompts: DataFrame, client: Client, retries: int = 3, backoff: float = 30.0, delay: float = 0.0) -> DataFrame:
    """Adds reply and error. The calls wait on a network, so this is a Python stage; write its result before using it twice."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", reply string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for question, n in zip(batch["prompt"], batch["run"]):
                answers.append(ask(client, question, int(n), retries, backoff))
                if delay:
                    time.sleep(delay)
            yield batch.assign(reply=[a[0] for a in answers], error=[a[1] for a in answers])

    return prompts.mapInPandas(run, schema)


@F.pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    """The object as JSON if the text is one and nothing else, as strictly as the judge's replies are read; else null. Of a repeated key the last value
    counts. JVM parsers let trailing prose and single quotes pass, and take the first."""

    def strict(t: str | None) -> str | None:
        if t is None or not t.lstrip().startswith("{"):
            return None
        try:
            return json.dumps(json.loads(t), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(strict)


def parse_reply(replies: DataFrame, reply: str = "reply", error: str = "error") -> DataFrame:
    """Scores, comments and remarks of each reply.

    A reply may be fenced. One that isn't a JSON object, or has more around it, gives null scores, with its first 200 characters as the
    issue; a failed call gives null scores and the error. Keys beyond the known ones are kept as a map. score_in_range tells whether all
    scores are from 1 to 5, which isn't enforced.
    """
    text = unfence(F.col(reply))
    parsed = replies.withColumn("_t", text).withColumn("_m", F.from_json(json_object("_t"), "map<string, string>"))
    ok = F.col("_m").isNotNull() & F.col(error).isNull()
    bad = F.when(F.col(error).isNotNull(), F.substring(error, 1, 100)).otherwise(PARSE_ERROR)
    score = lambda k: F.when(ok, F.col("_m")[k].try_cast("double")).alias(k)
    known = [*SCORES, *COMMENTS, "synthetic_generation_issues", "suggested_improvement"]
    in_range = F.forall(F.array(*[F.col("_m")[k].try_cast("double") for k in SCORES]), lambda s: F.coalesce(s.between(1, 5), F.lit(False)))
    return parsed.select(
        *replies.columns, *[score(k) for k in SCORES], *[F.when(ok, F.col("_m")[k]).otherwise(bad).alias(k) for k in COMMENTS],
        F.when(ok, F.col("_m")["synthetic_generation_issues"]).when(F.col(error).isNotNull(), F.substring(error, 1, 200)).otherwise(F.substring("_t", 1, 200)).alias("synthetic_generation_issues"),
        F.when(ok, F.col("_m")["suggested_improvement"]).otherwise(REVIEW).alias("suggested_improvement"),
        F.when(ok, F.map_filter("_m", lambda k, v: ~k.isin(known))).alias("other"), F.coalesce(ok & in_range, F.lit(False)).alias("score_in_range"),
    )


#: What a result has of its question, beside name and row_idx.
CARRIED = ("section", "label", "n_choices", "in_repeat", "repeat_name")


def prompts_of_runs(questions: DataFrame, runs: int) -> DataFrame:
    """Questions with their prompt, once for each run."""
    spread = with_prompts(questions).crossJoin(F.broadcast(questions.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run"))))
    return spread.withColumns({"n_choices": F.size("choices"), "in_repeat": F.coalesce("in_repeat", F.lit(False))})


def result_columns(parsed: DataFrame) -> DataFrame:
    return parsed.select("run", run_tag(F.col("run")).alias("tag"), "row_idx", "section", "name", *CARRIED[1:], *SCORES, *COMMENTS, "synthetic_generation_issues", "suggested_improvement", "other", "score_in_range")


def evaluate(questions: DataFrame, client: Client, runs: int = 9, done: DataFrame | None = None, retry_failed: bool = False, **options) -> DataFrame:
    """One result per question and run, without those that `done` has (by name and run); failed ones are asked again if retry_failed."""
    asked = prompts_of_runs(questions, runs)
    if done is not None:
        asked = pending(asked, done, ("name", "run"), retry_failed)
    return result_columns(parse_reply(call_judge(asked, client, **options)))


def as_scorecard_input(results: DataFrame) -> DataFrame:
    """Results with the score columns by their names in summaries."""
    return results.select("*", *[F.col(f"{k}_score").alias(v) for k, v in DIMENSIONS.items()])


def progress(results: DataFrame, done_before: int = 0, order: str = "row_idx") -> DataFrame:
    """Report lines: running number after those done before, name, and the mean of scores that aren't null to one digit. For small tables."""
    known = F.filter(F.array(*SCORES), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))
    return results.select((F.row_number().over(Window.partitionBy("run").orderBy(order)) + done_before).alias("idx"), "run", "name", python_round(mean, 1).alias("avg"), *SCORES)
