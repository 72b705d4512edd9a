"""Facts from model answers: a client protocol, JSON repair, evidence alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import clamp_confidence, first_match, optional, strip, text
from factloom.sources.ledger import Ledger

# Shape of an answer, and prefixes of a snippet that may stand for it.
ANSWER = "facts array<struct<entity:string,attribute:string,value:string,unit:string,period:string,confidence:string,evidence_text:string,evidence_snippets:array<string>>>"
LEAST_PREFIX, PREFIXES = 12, [180, 80]
SYSTEM_PROMPT = (
    "Extract atomic facts from the passage as JSON: {\"facts\": [{entity, attribute, value, unit, period, confidence, evidence_snippets}]}. "
    "Values are strings. Every fact quotes its evidence word for word."
)


class Client(Protocol):
    """A model provider. Built on the executors by a factory, so it need not be serialisable."""

    def complete(self, system_prompt: str, user_prompt: str) -> str: ...


def answers(chunks: DataFrame, make_client: Callable[[], Client], system_prompt: str = SYSTEM_PROMPT, ledger: Ledger | None = None) -> DataFrame:
    """Chunks with the model's raw ``answer``. With a ``ledger`` nothing that it knows is asked again, whatever fails in between."""
    if ledger is not None:
        return ledger.answer(chunks, "text", make_client, system_prompt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            yield b.assign(answer=[client.complete(system_prompt, t) for t in b.text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{fields}, answer string")


def json_object(raw: Column) -> Column:
    """The outermost ``{...}`` of an answer, whatever fence or prose surrounds it; an empty answer when there is none that parses."""
    body = F.regexp_extract(text(raw), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body).otherwise(F.lit('{"facts": []}'))


def parse_answers(rows: DataFrame, column: str = "answer") -> DataFrame:
    """One row per fact item: the other columns and ``item``."""
    return rows.withColumn("_facts", F.from_json(json_object(F.col(column)), ANSWER)["facts"]).select(*[c for c in rows.columns if c != column], F.explode("_facts").alias("item"))


def squashed(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text(c), r"(?U)\s+", " ")))


def align(snippet: Column, source: Column) -> Column:
    """The snippet, or its longest listed prefix, that stands in the source up to case and white space; else null."""
    s, body = strip(snippet), squashed(source)
    inside = lambda c: F.contains(body, squashed(c))
    cases = [(s == "", F.lit(None).cast("string")), (inside(s), s), (F.length(s) < LEAST_PREFIX, F.lit(None).cast("string"))]
    cases += [(inside(F.substring(s, 1, n)), F.trim(F.substring(s, 1, n))) for n in PREFIXES]
    return first_match(cases, F.lit(None).cast("string"))


def facts_from_answers(rows: DataFrame) -> DataFrame:
    """Raw facts of answered chunks; items without entity, attribute, value or aligned evidence go, repeated snippets count once."""
    items = parse_answers(rows)
    i = F.col("item")
    snippets = F.filter(F.array_append(F.coalesce(i["evidence_snippets"], F.array().cast("array<string>")), i["evidence_text"]), lambda s: strip(s) != "")
    aligned = items.withColumn("_s", F.explode(snippets)).withColumn("evidence_text", align(F.col("_s"), F.col("text"))).where("evidence_text is not null")
    kept = aligned.select(
        *[strip(i[c]).alias(c) for c in ("entity", "attribute", "value")], *[optional(i[c]).alias(c) for c in ("unit", "period")], clamp_confidence(i["confidence"]).alias("confidence"),
        "source_document", "page_number", "evidence_text",
    ).where("entity <> '' and attribute <> '' and value <> ''")
    return kept.withColumn("_e", F.lower("evidence_text")).dropDuplicates(["entity", "attribute", "value", "source_document", "page_number", "_e"]).drop("_e")


def merge_extracted(facts: DataFrame) -> DataFrame:
    """Facts that agree up to case in all five texts: one row with all evidence and the highest confidence."""
    key = [F.lower(text(F.col(c))).alias(f"_{c}") for c in ("entity", "attribute", "value", "unit", "period")]
    names = ["entity", "attribute", "value", "unit", "period"]
    return (
        facts.groupBy(*key)
        .agg(F.min(F.struct(*names)).alias("f"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(F.struct("source_document", "page_number", "evidence_text"))).alias("evidence"))
        .select("f.*", "confidence", "evidence")
    )
