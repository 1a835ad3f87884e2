"""Calls of a model from Spark: every request is answered once, failures are tried again, and what was answered stays so."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model: the request's text and the number of the attempt (from 1) to the answer's text; raises where there is none.
Model = Callable[[str, int], str]


def attempts(spark, ledger: str, kind: str) -> DataFrame:
    """(key, attempt, answer, error): all attempts in a ledger so far; none where it does not exist yet."""
    schema = f"key {kind}, attempt int, answer string, error string"
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def answered(requests: DataFrame, model: Model, ledger: str, key: str = "key", text: str = "request", tries: int = 3, parallel: int = 16, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """The requests with answer, error and attempts: null answers where all tries failed, for which the caller's default stands.

    Attempts go to the ledger, a Parquet folder in shared storage, one append for each round. A round asks what an anti-join
    of the requests with the ledger leaves open: no answer yet, and fewer than `tries` attempts. So a run that is broken off
    goes on where the last round ended, and one that is done asks nobody. Between rounds it waits 1, 2, 4, ... seconds.
    A round's requests are dealt to `parallel` tasks by their key, each of which asks one after the other; a task that is run again asks again
    for what its round had not yet written.

    A request that repeats (one key) is asked once. Requests with a null key or text are not asked and have no answer. An empty
    table gives an empty one and writes nothing. Columns of the requests stay; answer, error and attempts must not be among them.
    """
    taken = {"answer", "error", "attempts"} & {c.lower() for c in requests.columns}
    if taken:
        raise ValueError(f"requests have columns that answers are given in: {', '.join(sorted(taken))}")
    spark = requests.sparkSession
    kind = requests.schema[key].dataType.simpleString()
    once = requests.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(text).alias("request"))

    def ask(batches):
        for batch in batches:
            out = []
            for k, request, attempt in zip(batch["key"], batch["request"], batch["attempt"]):
                try:
                    out.append((k, attempt, str(model(request, int(attempt))), None))
                except Exception as e:  # whatever a model's client raises is this attempt's failure, and is kept
                    out.append((k, attempt, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["key", "attempt", "answer", "error"])

    for round_ in range(tries):
        so_far = attempts(spark, ledger, kind).groupBy("key").agg(F.max("attempt").alias("n"), F.max(F.col("answer").isNotNull()).alias("done"))
        closed = so_far.where(F.col("done") | (F.col("n") >= tries)).select("key")
        open_ = once.join(closed, "key", "left_anti").join(so_far.select("key", "n"), "key", "left").select("key", "request", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("attempt"))
        if not open_.limit(1).count():
            break
        if round_:
            pause(float(2 ** (round_ - 1)))
        open_.repartition(parallel, "key").mapInPandas(ask, f"key {kind}, attempt int, answer string, error string").write.mode("append").parquet(ledger)
    told = attempts(spark, ledger, kind).groupBy("key").agg(F.min("answer").alias("answer"), F.max_by("error", "attempt").alias("error"), F.max("attempt").alias("attempts"))
    out = requests.join(told.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    return out.withColumns({"error": F.when(F.col("answer").isNull(), F.col("error")), "attempts": F.coalesce("attempts", F.lit(0))})
