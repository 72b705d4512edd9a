"""Relationships proposed by a language model, within the types that the rules allow for a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import clamp_confidence, text
from factloom.operators import lookup, relations
from factloom.sources.extract import json_object
from factloom.sources.ledger import Ledger

ANSWER = "links array<struct<candidate_id:string,relationship_type:string,confidence:string,reasoning:string>>"
CANDIDATES_AT_ONCE = 40
SYSTEM_PROMPT = (
    "You are given one parent fact and candidate facts, each with the relationship types it may have. Answer as JSON: "
    '{"links": [{"candidate_id", "relationship_type", "confidence", "reasoning"}]}. Leave out candidates without a relationship.'
)


def allowed_types(f: DataFrame, window: int = relations.PAGE_WINDOW) -> DataFrame:
    """(candidate l, parent r, allowed): the types that the rules allow for each nearby pair, sorted; pairs without any are left out."""
    part = F.when(F.coalesce(relations.hierarchical("l", "r"), F.lit(False)) & ~F.coalesce(relations.sibling(), F.lit(False)), F.lit("PART_OF"))
    near = relations.candidates(f, window, same_bucket=True)
    judged = relations.classify(relations.with_transition(near.where("l_canonical_attribute = r_canonical_attribute"), f))
    judged = judged.select(F.col("source_fact_id").alias("l_id"), F.col("target_fact_id").alias("r_id"), F.col("relationship_type").alias("_type"))
    return near.join(judged, ["l_id", "r_id"], "left").select("l_id", "r_id", F.array_sort(F.array_compact(F.array(part, "_type"))).alias("allowed")).where(F.size("allowed") > 0)


def classify_with_model(f: DataFrame, facts: DataFrame, make_client: Callable[[], object], window: int = relations.PAGE_WINDOW, ledger: Ledger | None = None) -> DataFrame:
    """Edges that a model finds: (source_fact_id, target_fact_id, relationship_type, confidence, reasoning).

    A request holds one parent and at most ``CANDIDATES_AT_ONCE`` candidates; a parent with more has several. Answers count
    only for known candidates and allowed types. A ``ledger`` keeps answers, so that none is asked for twice.
    """
    told = facts.select("id", lookup.brief(facts).alias("said"))
    pairs = allowed_types(f, window).join(told.select(F.col("id").alias("l_id"), F.col("said").alias("l_said")), "l_id")
    item = F.struct("l_id", "l_said", "allowed")
    requests = (
        pairs.withColumn("part", F.pmod(F.xxhash64("l_id"), F.greatest(F.ceil(F.count(F.lit(1)).over(relations.Window.partitionBy("r_id")) / (CANDIDATES_AT_ONCE // 2)), F.lit(1))))
        .groupBy("r_id", "part")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .join(told.select(F.col("id").alias("r_id"), F.col("said").alias("r_said")), "r_id")
    )
    shown = F.concat_ws("\n", F.concat(F.lit("Parent: "), "r_said"), F.array_join(F.transform("items", lambda x: F.concat(F.lit("Candidate "), x["l_id"], F.lit(": "), x["l_said"], F.lit(" may be "), F.array_join(x["allowed"], ", "))), "\n"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            yield pd.DataFrame({"r_id": b.r_id, "part": b.part, "answer": [client.complete(SYSTEM_PROMPT, t) for t in b.prompt]})

    prompts = requests.select("r_id", "part", shown.alias("prompt"))
    answers = prompts.mapInPandas(ask, "r_id string, part long, answer string") if ledger is None else ledger.answer(prompts, "prompt", make_client, SYSTEM_PROMPT)
    links = answers.select("r_id", F.explode(F.from_json(json_object(F.col("answer")), ANSWER)["links"]).alias("x"))
    named = links.select("r_id", F.col("x.candidate_id").alias("l_id"), relations.relationship_type(F.col("x.relationship_type")).alias("relationship_type"), clamp_confidence(F.coalesce(F.nullif("x.confidence", F.lit("")), F.lit("0.7"))).alias("confidence"), text(F.col("x.reasoning")).alias("reasoning"))
    valid = named.join(pairs.select("l_id", "r_id", "allowed"), ["l_id", "r_id"]).where(F.array_contains("allowed", F.col("relationship_type")) & (F.col("l_id") != F.col("r_id")))
    return valid.select(F.col("l_id").alias("source_fact_id"), F.col("r_id").alias("target_fact_id"), "relationship_type", "confidence", "reasoning").dropDuplicates(["source_fact_id", "target_fact_id", "relationship_type"])
