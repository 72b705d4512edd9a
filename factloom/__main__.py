"""``python -m factloom rebuild|audit|determinism RAW STORE``: build a store from raw claims in Parquet, show its audit, or compare several builds."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession

from factloom import report
from factloom.operators import audit, relations
from factloom.store import FactStore


def build(spark: SparkSession, raw: str, path: str) -> FactStore:
    store = FactStore(spark, f"{path.rstrip('/')}/{uuid.uuid4().hex}")
    store.append(spark.read.parquet(raw))
    return store.rebuild()


def audited(store: FactStore):
    return audit.audit(*[store.table(t) for t in ("facts", "evidence", "edges", "clusters", "embeddings")])


def prints(store: FactStore) -> list[tuple]:
    return sorted(tuple(r) for r in audit.fingerprint(store.table("facts"), store.table("edges"), store.table("clusters")).collect())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__)
    parser.add_argument("command", choices=["rebuild", "audit", "determinism"])
    parser.add_argument("raw", help="Parquet with raw claims")
    parser.add_argument("store", help="folder for the tables")
    parser.add_argument("--runs", type=int, default=5, help="builds that determinism compares")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if given.command == "determinism":
        stores = [build(spark, given.raw, given.store) for _ in range(given.runs)]
        found = [prints(s) for s in stores]
        same = all(f == found[0] for f in found)
        print("DETERMINISTIC" if same else "NON-DETERMINISTIC")
        for k, f in enumerate(found[1:], 2):
            for a, b in zip(found[0], f, strict=True):
                if a != b:
                    print(f"  run {k}: {a} != {b}")
        print(report.timings_text([s.timings.stages for s in stores]))
        return 0 if same else 1
    store = build(spark, given.raw, given.store)
    print(store.timings.render() if given.command == "rebuild" else report.audit_text(audited(store), relations.type_counts(store.table("edges"))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
