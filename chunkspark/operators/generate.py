"""Generation in stages: each stage is a prompt over what the stages before it gave, and a column of its own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stages of a user interface from its description: file name, markup, styles, script.
STAGES = ("filename", "uxml", "uss", "csharp")
PROMPTS = {
    "filename": "Name a file, without suffix, for this user interface: {description}",
    "uxml": "Write the UXML document {filename} of this user interface: {description}",
    "uss": "Write the USS styles of this UXML document:\n{uxml}",
    "csharp": "Write the C# script that drives this UXML document, styled by the USS below it:\n{uxml}\n{uss}",
}


def generate(requests: DataFrame, model: Callable[[str], str], stages=STAGES, prompts: dict[str, str] = PROMPTS, description: str = "description") -> DataFrame:
    """`requests` with a column for each stage and `error`. A stage that fails ends its row: later ones are null.

    An empty or missing description is an error before the first stage.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf[description]:
                done: dict[str, str | None] = dict.fromkeys(stages)
                error = None if isinstance(text, str) and text.strip() else "the description is empty"
                for stage in stages:
                    if error is not None:
                        break
                    try:
                        done[stage] = model(prompts[stage].format(description=text, **done))
                    except Exception as e:  # noqa: BLE001
                        error = f"{stage}: {e}"
                rows.append(done | {"error": error})
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=[*stages, "error"])], axis=1)

    schema = T.StructType([*requests.schema.fields, *(T.StructField(s, T.StringType()) for s in (*stages, "error"))])
    return requests.mapInPandas(run, schema)


def stage_events(generated: DataFrame, key: str, stages=STAGES) -> DataFrame:
    """key, step, status, content, complete: an event for each stage that was done, then one for the end."""
    done = [F.struct(F.lit(f"GENERATING_{s.upper()}").alias("status"), F.col(s).alias("content"), F.lit(False).alias("complete")) for s in stages]
    events = F.filter(F.array(*done), lambda e: e["content"].isNotNull())
    last = F.struct(F.when(F.col("error").isNull(), "COMPLETE").otherwise("ERROR").alias("status"), F.col("error").alias("content"), F.lit(True).alias("complete"))
    return generated.select(key, F.posexplode(F.concat(events, F.array(last))).alias("step", "e")).select(key, "step", "e.*")


def message_kind(message: Column) -> Column:
    """What a client's message is: a cancellation, an empty request, one with settings of its own, or a description."""
    has = F.try_variant_get(F.try_parse_json(message), "$.description", "string")
    return F.when(message.startswith("CANCEL:"), "cancel").when(F.trim(F.coalesce(has, message)) == "", "empty").when(has.isNotNull(), "override").otherwise("describe")
