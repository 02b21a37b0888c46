"""Contexts, prompts and progress of questions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkspark.config import ModelConfig
from chunkspark.sources.domains import Registry

STATUSES = ("STARTING", "POLISHING", "RETRIEVING", "ANSWERING", "COMPLETE", "ERROR")
#: What a question goes through; polishing is declared but never reported.
STEPS = ("STARTING", "RETRIEVING", "ANSWERING", "COMPLETE")
NO_CONTEXT = "No relevant code was found for this question."
FAILED = "The answer could not be generated."


#: Makers of language models by provider: called with a ModelConfig, they give a callable from prompt to answer.
MODELS = Registry("language model")


@MODELS.register("testing")
def offline(config: ModelConfig) -> Callable[[str], str]:
    """A model that asks nobody."""
    return lambda prompt: config.settings.get("answer", "No model is connected.")


def model_of(config: ModelConfig | None = None) -> Callable[[str], str]:
    """The model of a config, with its system prompt before each prompt."""
    c = config or ModelConfig()
    model = MODELS.get(c.provider)(c)
    return (lambda prompt: model(f"{c.system_prompt}\n\n{prompt}")) if c.system_prompt else model


def assemble_context(rows: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """key, prompt: the texts of a key in order, one under another."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(own, lambda r: r["t"]), "\n").alias("prompt"))


def with_prompt(questions: DataFrame, found: DataFrame, key: str = "qid", question: str = "question", rank: str = "rk", document: str = "document") -> DataFrame:
    """`questions` with retrieved_context, an array in order of rank (empty if nothing was found), and prompt."""
    own = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, document))), lambda r: r[document]).alias("retrieved_context"))
    out = questions.join(own, key, "left").withColumn("retrieved_context", F.coalesce("retrieved_context", F.array().cast("array<string>")))
    prompt = F.concat(F.lit("Question: "), F.col(question), F.lit("\n\nContext:\n"), F.array_join("retrieved_context", "\n---\n"))
    return out.withColumn("prompt", prompt)


def answer(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """`prompts` with `answer` and `failed`. Without context, or if the model fails, the answer is a fixed text."""
    from pyspark.sql import types as T

    def run(batches):
        for pdf in batches:
            answers, failed = [], []
            for prompt, context in zip(pdf["prompt"], pdf["retrieved_context"], strict=True):
                try:
                    answers.append(model(prompt) if len(context) else NO_CONTEXT)
                    failed.append(False)
                except Exception:  # noqa: BLE001
                    answers.append(FAILED)
                    failed.append(True)
            yield pd.DataFrame({**pdf, "answer": answers, "failed": failed})

    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType()), T.StructField("failed", T.BooleanType())])
    return prompts.mapInPandas(run, schema)


def progress(requests: DataFrame, key: str = "qid", failed_at: str | None = None) -> DataFrame:
    """key, step, status: the statuses of each request in order; a failure ends them with ERROR.

    `failed_at` is a column with the step that failed, null for none.
    """
    steps = F.array(*map(F.lit, STEPS))
    if failed_at is not None:
        upto = F.array_position(steps, F.col(failed_at)).cast("int")
        steps = F.when(F.col(failed_at).isNull(), steps).otherwise(F.concat(F.slice(steps, F.lit(1), upto), F.array(F.lit("ERROR"))))
    return requests.select(key, F.posexplode(steps).alias("step", "status"))


def out_of_order(statuses: DataFrame, key: str = "qid") -> DataFrame:
    """Status rows that come after a terminal one or not later than their predecessor in STEPS."""
    w = Window.partitionBy(key).orderBy("step")
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    marked = statuses.withColumn("_rank", rank).withColumn("_before", F.lag("_rank").over(w))
    return marked.filter((F.col("_before") >= 5) | (F.col("_rank") <= F.col("_before"))).drop("_rank", "_before")


def feedback(events: DataFrame, kind: str = "event_type", positive: list[str] | None = None) -> DataFrame:
    """n_positive and n_negative events per user, by whether the kind is a positive one."""
    good = F.col(kind).isin(*(positive or ["like"]))
    return events.groupBy("user_id").agg(F.count_if(good).alias("n_positive"), F.count_if(~good).alias("n_negative"))
