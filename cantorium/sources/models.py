"""Answers of language models as a source: an injected client is called from tasks, its answers are parsed by columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantorium.functions.lexical import extract_json_array
from cantorium.functions.text import fill_prompt, llm_object
from cantorium.operators.tables import by_id_or_position

#: A client takes a prompt and a model name and returns the answer; it is made once a worker.
MakeClient = Callable[[], Callable[[str, str], str]]


def ask(requests: DataFrame, make_client: MakeClient, partitions: int) -> DataFrame:
    """Request columns with raw_response and error; partitions is how many calls run at once. An error leaves its row, not the job."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            answers, errors = [], []
            for prompt, model in zip(frame["prompt"], frame["model"]):
                try:
                    answers.append(client(prompt, model))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  whatever a client raises is data here
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield frame.assign(raw_response=answers, error=errors)

    return requests.repartition(partitions).mapInPandas(run, f"{fields}, raw_response string, error string")


def generate(tasks: DataFrame, prompts: DataFrame, make_client: MakeClient, partitions: int = 8) -> DataFrame:
    """Tasks times their requests through the client to parsed poems: task, request, cipai, title, content, raw_response, error."""
    requests = tasks.join(prompts, "prompt_name").withColumn("request", F.explode(F.sequence(F.lit(1), F.col("total_requests"))))
    prompt = fill_prompt(F.col("template"), F.col("cipai_pool"), F.col("theme"), F.concat_ws("|", "name", "request"))
    answered = ask(requests.select("name", "request", "model", prompt.alias("prompt")), make_client, partitions)
    parsed = answered.withColumn("poem", llm_object(F.col("raw_response"), "cipai string, title string, content string"))
    return parsed.select(F.col("name").alias("task"), "request", "model", "poem.cipai", "poem.title", "poem.content", "raw_response", "error")


def annotate(pending: DataFrame, make_client: MakeClient, instruction: str, model: str, batch: int = 3, partitions: int = 8) -> DataFrame:
    """Imagery and category of pending poems (id, content), asked for in batches: id, value (JSON of the result)."""
    # the batch number is a running count, made from counts of id ranges so that no window spans the whole table
    ranges = pending.select("id", "content", F.floor(F.col("id") / 10_000).alias("range"))
    own = Window.partitionBy("range").orderBy("id")
    placed = ranges.withColumn("n", F.row_number().over(own) - 1)
    placed = placed.select("id", "content", F.concat_ws("-", "range", F.floor(F.col("n") / batch)).alias("batch"), (F.col("n") % batch).cast("int").alias("pos"))
    listed = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(". ", (x["pos"] + 1).cast("string"), x["content"])), "\n")
    answered = ask(listed.select("batch", F.lit(model).alias("model"), F.concat(F.lit(instruction + "\n"), text).alias("prompt")), make_client, partitions)
    items = F.from_json(extract_json_array("raw_response"), "array<struct<id:int,imagery:array<string>,category:string>>")
    results = answered.select("batch", F.posexplode(items).alias("at", "r"))
    results = results.select("batch", "at", F.col("r.id").alias("id"), F.to_json(F.struct("r.imagery", "r.category")).alias("value"))
    return by_id_or_position(placed.select("id", "batch", "pos"), results, "batch").select("id", "value")
