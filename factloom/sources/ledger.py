"""A ledger of model calls: what has been answered is never asked (or paid) again."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.tables import KeyedTable

TRIES, FIRST_WAIT = 4, 0.5


class Ledger:
    """Answers under a hash of model and prompts.

    A task puts each answer into a file of its own in the shared folder before it asks for the next one, so what a killed task has
    been told is found by the task that repeats it. After the job the files become rows of a keyed table, which later jobs
    anti-join before they ask. A request is tried ``TRIES`` times, with doubled waits between; the last error ends the task.
    """

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.table = KeyedTable(spark, f"{self.path}/answers", ["request_id"])

    def request_id(self, system_prompt: str, prompt: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.model}\n{system_prompt}\n"), prompt), 256)

    def known(self) -> DataFrame:
        return self.table.read() if self.table.latest() else self.spark.createDataFrame([], "request_id string, answer string")

    def answer(self, requests: DataFrame, prompt_col: str, make_client: Callable[[], object], system_prompt: str) -> DataFrame:
        """``requests`` plus ``answer``; equal prompts are asked once."""
        asked = requests.withColumn("_request", self.request_id(system_prompt, F.coalesce(F.col(prompt_col), F.lit(""))))
        todo = asked.select(F.col("_request").alias("request_id"), F.coalesce(F.col(prompt_col), F.lit("")).alias("prompt")).dropDuplicates(["request_id"])
        found = todo.join(self.known().select("request_id"), "request_id", "left_anti").mapInPandas(_asking(f"{self.path}/spool", make_client, system_prompt), "request_id string, answer string")
        self.table.upsert(found)
        return asked.join(self.known().withColumnRenamed("request_id", "_request"), "_request").drop("_request")


def _asking(spool: str, make_client: Callable[[], object], system_prompt: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        files, root = arrow_fs.FileSystem.from_uri(spool)
        for b in batches:
            answers = []
            for request, prompt in zip(b.request_id, b.prompt, strict=True):
                folder, at = f"{root}/{request[:2]}", f"{root}/{request[:2]}/{request}.json"
                if files.get_file_info(at).type == arrow_fs.FileType.File:
                    with files.open_input_file(at) as f:
                        answers.append(json.loads(f.read())["answer"])
                    continue
                client = client or make_client()
                answers.append(_patiently(client, system_prompt, prompt))
                files.create_dir(folder, recursive=True)
                part = f"{at}.{uuid.uuid4().hex}"  # whole before it gets its name
                with files.open_output_stream(part) as f:
                    f.write(json.dumps({"answer": answers[-1]}).encode())
                files.move(part, at)
            yield pd.DataFrame({"request_id": b.request_id, "answer": answers})

    return run


def _patiently(client, system_prompt: str, prompt: str) -> str:
    for n in range(TRIES):
        try:
            return client.complete(system_prompt, prompt)
        except Exception:
            if n == TRIES - 1:
                raise
            time.sleep(FIRST_WAIT * 2**n)
    raise AssertionError
