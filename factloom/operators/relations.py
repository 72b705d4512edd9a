"""Typed relationships between facts: candidate joins, one CASE classifier, validation, pair keys, component sums."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.canonical import CHILD_REVENUE, dimensions_compatible, numeric_amount, value_dimension
from factloom.functions.text import PERIOD_PLAIN_QUARTER, first_match, fmt_g, merge_reasons, normalize_token, squash, statement, strip_period_tokens, text

# Fixed values.
TYPES = ["SUPPORTS", "CORROBORATES", "CONTRADICTS", "RECONCILES", "TEMPORAL_SUCCESSOR", "PART_OF", "COMPUTED_SUPPORT", "UNRESOLVED_DIFFERENCE", "POTENTIAL_CONTRADICTION"]
UNDIRECTED = ["CORROBORATES", "CONTRADICTS", "RECONCILES", "UNRESOLVED_DIFFERENCE", "POTENTIAL_CONTRADICTION"]
ALIASES = {
    "SUPPORTING": "SUPPORTS", "SUPPORT": "SUPPORTS", "EXPLANATORY": "SUPPORTS", "PART": "PART_OF", "COMPONENT": "PART_OF", "COMPOSED_OF": "PART_OF", "DERIVED_FROM": "PART_OF",
    "CORROBORATION": "CORROBORATES", "CONTRADICTION": "CONTRADICTS", "RECONCILIATION": "RECONCILES", "TEMPORAL": "TEMPORAL_SUCCESSOR", "SUCCESSOR": "TEMPORAL_SUCCESSOR",
    "COMPUTED": "COMPUTED_SUPPORT", "ARITHMETIC": "COMPUTED_SUPPORT", "UNRESOLVED": "UNRESOLVED_DIFFERENCE", "POTENTIAL": "POTENTIAL_CONTRADICTION",
}
COMPONENT_WORDS = ["product", "products", "service", "services", "goods", "other", "domestic", "international", "subscription", "licensing", "license"]
PARENT_WORDS = ["total", "overall", "consolidated", "combined", "net", "group"]
QUALIFIERS = ["annual", "total", "net", "gross", "consolidated", "combined", "overall", "group", "reported", "restated", "adjusted", "the", "a"]
TRANSITION = r"(?iuU)\b(resign(?:ed|ation)?|appoint(?:ed|ment)?|succeeded|replaced|took over|outgoing|incoming|formerly)\b"
TOLERANCE, SUM_RELATIVE, SUM_ABSOLUTE = 0.05, 0.02, 0.51
MOST_COMPONENTS, LARGEST_SUBSET, PAGE_WINDOW = 16, 6, 5
DIRECTIONS = {"PART_OF": "Child -> Parent", "SUPPORTS": "Supporter -> Supported", "TEMPORAL_SUCCESSOR": "Earlier -> Later", "COMPUTED_SUPPORT": "Components -> Total"}
CORROBORATES, APPROXIMATE = "Same canonical attribute and normalized value.", "Values are approximately equivalent within 5% tolerance."
CONTRADICTS = "Same canonical attribute and period but different normalized values."
DIFFERS = "Different values for the same canonical attribute without extracted transition evidence."


def relationship_type(c: Column) -> Column:
    """One of ``TYPES``, through its aliases; null for others."""
    name = F.replace(F.upper(F.trim(text(c))), F.lit(" "), F.lit("_"))
    known = {**{t: t for t in TYPES}, **ALIASES}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), name)


def bare_attribute(attribute: Column) -> Column:
    """Without periods and leading words for a whole."""
    return squash(F.regexp_replace(squash(strip_period_tokens(normalize_token(attribute), PERIOD_PLAIN_QUARTER)), rf"^((?:{'|'.join(PARENT_WORDS)})(?:\s+|$))+", ""))


def features(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """What pair predicates need, one column each, computed once per fact."""
    held = evidence.groupBy(F.col("fact_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("source_document", "page_number", "evidence_id", "evidence_text"))).alias("_ev")
    )
    f = facts.join(held, "id", "left")
    raw = F.coalesce(F.col("raw_attribute"), F.col("attribute"))
    words = F.split(bare_attribute(raw), " ")
    entity = normalize_token(F.coalesce(F.nullif("original_entity", F.lit("")), "canonical_entity", "entity"))
    plain_entity = F.array_join(F.filter(F.split(entity, " "), lambda w: ~w.isin(QUALIFIERS)), " ")
    amount, unit = numeric_amount(F.col("eq_value"))
    blob = F.lower(F.concat_ws(" ", text(F.col("value")), text(F.col("canonical_value")), text(F.col("entity")), F.array_join(F.transform("_ev", lambda e: F.concat_ws(" ", e["evidence_text"], e["source_document"])), " ")))
    f = f.withColumns(
        {
            "words": words,
            "amount": amount,
            "amount_unit": unit,
            "dimension": value_dimension(F.col("canonical_value"), F.col("unit")),
            "entity_key": F.when(plain_entity != "", plain_entity).otherwise(entity),
            "bucket_entity": entity,
            "period_key": normalize_token(F.col("period")),
            "blob": blob,
            "evidence_ids": F.transform("_ev", lambda e: e["evidence_id"]),
            "pages": F.array_distinct(F.transform("_ev", lambda e: F.struct(e["source_document"].alias("d"), e["page_number"].alias("p")))),
        }
    )
    prefix = F.when(F.get("words", F.lit(0)).isin(COMPONENT_WORDS), F.get("words", F.lit(0)))
    rest = F.array_join(F.slice("words", F.lit(2), F.size("words")), " ")
    stored = F.when(F.col("canonical_attribute").isin("total_revenue", *CHILD_REVENUE), F.col("canonical_attribute"))
    revenue_word = F.contains(normalize_token(raw), F.lit("revenue"))
    named = first_match(
        [
            (F.col("prefix").isin("product", "products"), F.lit("product_revenue")), (F.col("prefix").isin("service", "services"), F.lit("services_revenue")),
            (F.col("prefix") == "subscription", F.lit("subscription_revenue")), (F.col("prefix").isin("licensing", "license"), F.lit("licensing_revenue")), (F.col("prefix").isNotNull(), F.lit(None).cast("string")),
        ],
        F.lit("total_revenue"),
    )
    f = f.withColumns({"prefix": prefix, "core": F.when(prefix.isNotNull() & (rest != ""), rest).otherwise(F.array_join("words", " "))})
    return f.withColumns({"revenue": F.coalesce(stored, F.when(revenue_word, named)), "transition": F.col("blob").rlike(TRANSITION)}).drop("_ev", "words")


PAIR = ["id", "canonical_attribute", "canonical_value", "value", "eq_value", "amount", "amount_unit", "dimension", "entity_key", "period_key", "evidence_ids", "revenue", "prefix", "core"]


def sides(f: DataFrame, columns: list[str] = PAIR) -> tuple[DataFrame, DataFrame]:
    return tuple(f.select(*[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "lr")


def _c(name: str) -> tuple[Column, Column]:
    return F.col(f"l_{name}"), F.col(f"r_{name}")


def equivalent() -> Column:
    a, b = _c("eq_value")
    return a == b


def approximate(tolerance: float = TOLERANCE) -> Column:
    (a, b), (u, v) = _c("amount"), _c("amount_unit")
    near = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) <= tolerance
    return F.coalesce(near & ~F.isnan(a) & ~F.isnan(b) & ((u == "") | (v == "") | (u == v)), F.lit(False))


def same_period() -> Column:
    a, b = _c("period_key")
    return (a != "") & (a == b)


def hierarchical(child: str, parent: str) -> Column:
    """Is the child a component of the parent: revenue categories under the total, or a prefixed attribute under its bare one."""
    c, p = (lambda n: F.col(f"{child}_{n}")), (lambda n: F.col(f"{parent}_{n}"))
    under_total = c("revenue").isin(CHILD_REVENUE) & (p("revenue") == "total_revenue")
    by_name = ~F.coalesce(c("revenue").isin(CHILD_REVENUE), F.lit(False)) & (c("core") != "") & (c("core") == p("core")) & c("prefix").isNotNull() & p("prefix").isNull()
    return (c("id") != p("id")) & (c("canonical_attribute") != p("canonical_attribute")) & ~F.coalesce(p("revenue").isin(CHILD_REVENUE), F.lit(False)) & F.coalesce(under_total | by_name, F.lit(False))


def sibling() -> Column:
    (a, b), (c, d), (p, q) = _c("revenue"), _c("core"), _c("prefix")
    both = F.coalesce(a.isin(CHILD_REVENUE) & b.isin(CHILD_REVENUE), F.lit(False))
    return F.when(both, a != b).otherwise((c == d) & p.isNotNull() & q.isNotNull() & (p != q))


def pairs(f: DataFrame) -> DataFrame:
    """Unordered pairs of one attribute and one original entity that can be compared: an equi-join, the smaller id on the left."""
    left, right = sides(f, [*PAIR, "bucket_entity"])
    same = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in ("canonical_attribute", "bucket_entity", "entity_key")]
    return left.join(right, [*same, F.col("l_id") < F.col("r_id"), dimensions_compatible(*_c("dimension"))])


SUPPORTED_BY = ["id", "value", "eq_value", "amount", "amount_unit", "dimension", "period_key"]
GRAM = 3


def grams(c: Column, size: Column) -> Column:
    """Distinct substrings of ``size`` characters; ``size`` is at most the length of ``c``."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, size)))


def holding(names: DataFrame, moving: DataFrame) -> DataFrame:
    """(name, s_id) where the fact's blob holds the name: an equi-join on the name's rarest ``GRAM`` characters, then the test.

    ``names``: distinct, not empty. A shorter name is its own gram. Grams of blobs are made only in the lengths that names ask for.
    """
    asked = names.select("name", F.least(F.length("name"), F.lit(GRAM)).alias("q"))
    index = moving.join(F.broadcast(asked.select("q").distinct()), F.length("s_blob") >= F.col("q")).select("s_id", "s_blob", F.explode(grams(F.col("s_blob"), F.col("q"))).alias("gram"))  # at most GRAM lengths
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = asked.select("name", "q", F.explode(grams(F.col("name"), F.col("q"))).alias("gram")).join(often, "gram").groupBy("name").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return best.join(index, "gram").where(F.contains(F.col("s_blob"), F.col("name"))).select("name", "s_id")


def with_transition(p: DataFrame, f: DataFrame) -> DataFrame:
    """Adds support_ids: facts that mention a transition and hold one of the two values.

    Only pairs that differ in value and period look for support, and only against the facts with a transition
    word, joined through the pairs' distinct values.
    """
    needs = p.where(~(equivalent() | approximate()) & ~same_period() & dimensions_compatible(*_c("dimension")))
    names = needs.select("l_id", "r_id", F.explode(F.array_distinct(F.array(F.lower(F.trim("l_value")), F.lower(F.trim("r_value"))))).alias("name")).where("name <> ''")
    moving = f.where("transition").select(F.col("id").alias("s_id"), F.col("blob").alias("s_blob"))
    support = names.join(holding(names.select("name").distinct(), moving), "name").groupBy("l_id", "r_id").agg(F.array_sort(F.collect_set("s_id")).alias("support_ids"))
    return p.join(support, ["l_id", "r_id"], "left")


def classify(p: DataFrame) -> DataFrame:
    """Edges of pairs: source, target, type, confidence, reasoning, supporting ids. One CASE decides."""
    close = approximate() & ~equivalent()
    supported = F.col("support_ids").isNotNull()
    kind = first_match(
        [
            (equivalent() | approximate(), F.lit("CORROBORATES")),
            (same_period(), F.lit("CONTRADICTS")),
            (supported, F.lit("RECONCILES")),
            (F.col("l_canonical_attribute") == "holder", F.lit("POTENTIAL_CONTRADICTION")),
        ],
        F.lit("UNRESOLVED_DIFFERENCE"),
    )
    kind_is = lambda t: F.col("relationship_type") == t
    return (
        p.where((F.col("l_entity_key") == F.col("r_entity_key")) & dimensions_compatible(*_c("dimension")))
        .withColumn("relationship_type", kind)
        .select(
            F.col("l_id").alias("source_fact_id"),
            F.col("r_id").alias("target_fact_id"),
            "relationship_type",
            first_match([(kind_is("CORROBORATES") & close, F.lit(0.84)), (kind_is("CORROBORATES") | kind_is("CONTRADICTS"), F.lit(0.9)), (kind_is("RECONCILES"), F.lit(0.86))], F.lit(0.7)).alias("confidence"),
            first_match(
                [
                    (kind_is("CORROBORATES"), F.when(close, F.lit(APPROXIMATE)).otherwise(F.lit(CORROBORATES))),
                    (kind_is("CONTRADICTS"), F.lit(CONTRADICTS)),
                    (kind_is("RECONCILES"), F.concat(F.lit("Supported by resignation/appointment fact "), F.array_join(F.transform("support_ids", lambda i: F.concat(F.lit("#"), i)), ", "), F.lit("."))),
                ],
                F.lit(DIFFERS),
            ).alias("reasoning"),
            F.when(kind_is("RECONCILES"), F.col("support_ids")).otherwise(F.array("l_id", "r_id")).alias("supporting_fact_ids"),
            F.concat("l_evidence_ids", "r_evidence_ids").alias("supporting_evidence_ids"),
        )
    )


NEAR = ["id", "canonical_attribute", "revenue", "prefix", "core", "bucket_entity"]


def near_ids(f: DataFrame, window: int = PAGE_WINDOW, same_bucket: bool = False) -> DataFrame:
    """(l_id, r_id): pairs that share a document within ``window`` pages (negative: any page) and may be child and parent or siblings;
    with ``same_bucket`` also those of one attribute and entity.

    Pages are cut into blocks as wide as the window. A left row stays in its block, a right row goes to its own and both beside it, so the
    band is part of an equi-join on (document, block, key), and rows meet only within the window's reach. The key is the *wanted* revenue
    category or component word, so rows of one and the same never meet: pairs grow with facts, not with their square.
    """
    placed = f.select(*NEAR, F.explode("pages").alias("_at")).select(*NEAR, F.col("_at.d").alias("d"), F.col("_at.p").alias("p"))
    own = F.floor(F.col("p") / max(window, 1)) if window >= 0 else F.lit(0)
    placed = placed.withColumns({"own": own.cast("long"), "prefix": F.coalesce("prefix", F.lit(""))})
    beside = F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1) if window >= 0 else F.array("own")
    ways = {
        "revenue": (placed.where(F.col("revenue").isin("total_revenue", *CHILD_REVENUE)), F.when(F.col("revenue") == "total_revenue", _texts(CHILD_REVENUE)).otherwise(F.array_except(_texts(["total_revenue", *CHILD_REVENUE]), F.array("revenue"))), ["revenue"]),
    }
    named = placed.where("core <> ''")
    mixed = named.groupBy("d", "core").agg(F.min("prefix").alias("low"), F.max("prefix").alias("high")).where("low <> high").select("d", "core")
    ways["core"] = (named.join(mixed, ["d", "core"], "left_semi"), F.array_except(_texts(["", *COMPONENT_WORDS]), F.array("prefix")), ["prefix", "core"])
    if same_bucket:
        ways["bucket"] = (placed, F.array("canonical_attribute"), ["canonical_attribute", "bucket_entity"])
    found = []
    for rows, wanted, key in ways.values():
        left = rows.select(F.col("id").alias("l_id"), F.col("canonical_attribute").alias("l_attribute"), "d", F.col("p").alias("l_p"), F.col("own").alias("block"), F.explode(wanted).alias(key[0]), *key[1:])
        right = rows.select(F.col("id").alias("r_id"), F.col("canonical_attribute").alias("r_attribute"), "d", F.col("p").alias("r_p"), F.explode(beside).alias("block"), *key)
        met = left.join(right, ["d", "block", *key]).where(F.col("l_id") != F.col("r_id"))
        if key != ["canonical_attribute", "bucket_entity"]:
            met = met.where("l_attribute <> r_attribute")
        found.append((met.where(F.abs(F.col("l_p") - F.col("r_p")) <= window) if window >= 0 else met).select("l_id", "r_id"))
    return reduce(DataFrame.unionByName, found).distinct()


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def candidates(f: DataFrame, window: int = PAGE_WINDOW, near: DataFrame | None = None, same_bucket: bool = False) -> DataFrame:
    """The pairs of ``near`` (else of ``near_ids``) with what predicates need of both sides; child l, parent r."""
    l, r = sides(f, [*PAIR, "bucket_entity"])  # noqa: E741
    return (near_ids(f, window, same_bucket) if near is None else near).join(l, "l_id").join(r, "r_id")


def part_of(f: DataFrame, summing: DataFrame | None = None, window: int = PAGE_WINDOW, near: DataFrame | None = None) -> DataFrame:
    """PART_OF edges, child to parent; 0.92 where the child is part of the parent's component sum."""
    eligible = candidates(f, window, near).where(hierarchical("l", "r") & ~F.coalesce(sibling(), F.lit(False)))
    if summing is None:
        summing = document_sums(eligible)
    s = summing.select(F.col("parent_id").alias("r_id"), F.explode("component_ids").alias("l_id"), F.lit(True).alias("_in"))
    reason = first_match(
        [
            (F.col("_in").isNotNull(), F.concat(F.col("l_amount").cast("string"), F.lit(" is a numeric component of "), F.col("r_amount").cast("string"))),
            (F.col("l_revenue").isin(CHILD_REVENUE), F.lit("Revenue hierarchy: child category of total revenue.")),
        ],
        F.lit("Parent-child attribute hierarchy."),
    )
    return eligible.join(s, ["l_id", "r_id"], "left").select(
        F.col("l_id").alias("source_fact_id"), F.col("r_id").alias("target_fact_id"), F.lit("PART_OF").alias("relationship_type"),
        F.when(F.col("_in").isNotNull(), 0.92).otherwise(0.8).alias("confidence"), reason.alias("reasoning"),
        F.array("l_id", "r_id").alias("supporting_fact_ids"), F.concat("l_evidence_ids", "r_evidence_ids").alias("supporting_evidence_ids"),
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def summing_subset(amounts: pd.Series, totals: pd.Series) -> pd.Series:
    """Indices of the first subset, largest sizes first, whose amounts sum to the total; null when there is none.

    At most ``MOST_COMPONENTS`` amounts are searched; sums of all subsets of one size are taken at once.
    """

    def search(values: np.ndarray, total: float) -> list[int] | None:
        if not 2 <= len(values) <= MOST_COMPONENTS:
            return None
        for size in range(min(LARGEST_SUBSET, len(values)), 1, -1):
            chosen = np.array(list(combinations(range(len(values)), size)))
            sums = values[chosen].sum(1)
            hit = np.flatnonzero(np.abs(sums - total) <= np.maximum(SUM_ABSOLUTE, SUM_RELATIVE * np.maximum(np.abs(sums), abs(total))))
            if len(hit):
                return chosen[hit[0]].tolist()
        return None

    return pd.Series([search(np.asarray(a, float), t) for a, t in zip(amounts, totals, strict=True)], dtype=object)


def _sums(grouped: DataFrame) -> DataFrame:
    """grouped: parent_id, total, children (array of order, id, amount, evidence)."""
    g = grouped.where(F.size("children").between(2, MOST_COMPONENTS)).withColumn("children", F.array_sort("children"))
    g = g.withColumn("chosen", summing_subset(F.transform("children", lambda c: c["amount"]), F.col("total"))).where("chosen is not null")
    return g.withColumn("chosen", F.transform("chosen", lambda i: F.get("children", i))).select(
        "parent_id", "total", F.transform("chosen", lambda c: c["id"]).alias("component_ids"), F.transform("chosen", lambda c: c["amount"]).alias("amounts"), F.flatten(F.transform("chosen", lambda c: c["evidence"])).alias("component_evidence")
    )


def _child(prefix: str) -> Column:
    c = lambda n: F.col(f"{prefix}{n}")
    order = F.struct(text(c("canonical_attribute")).alias("a"), text(c("canonical_value")).alias("v"), text(c("period_key")).alias("p"), c("id").alias("i"))
    return F.struct(order.alias("order"), c("id").alias("id"), c("amount").alias("amount"), c("evidence_ids").alias("evidence"))


def document_sums(eligible: DataFrame) -> DataFrame:
    """Component sums of each parent among its children in the same document."""
    units = (F.col("l_amount_unit") == F.col("r_amount_unit")) | (F.col("l_amount_unit") == "") | (F.col("r_amount_unit") == "")
    usable = eligible.where(F.col("l_amount").isNotNull() & F.col("r_amount").isNotNull() & units)
    counted = usable.groupBy("r_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MOST_COMPONENTS)  # larger groups are never searched, so never gathered
    return _sums(usable.join(counted, "r_id").groupBy(F.col("r_id").alias("parent_id"), F.col("r_amount").alias("total")).agg(F.collect_list(_child("l_")).alias("children")))


def computed_support(f: DataFrame) -> DataFrame:
    """COMPUTED_SUPPORT edges of totals whose children of the same entity and period sum up to them."""
    scoped = f.withColumns({"scope_entity": normalize_token(F.col("canonical_entity")), "scope_period": F.col("period_key")})
    children = scoped.where(F.col("revenue").isin(CHILD_REVENUE) & F.col("amount").isNotNull())
    totals = scoped.where((F.col("revenue") == "total_revenue") & F.col("amount").isNotNull())
    key = ["scope_entity", "scope_period"]
    few = children.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    t = totals.select(*key, F.col("id").alias("parent_id"), F.col("amount").alias("total"), F.col("amount_unit").alias("t_unit"), F.col("evidence_ids").alias("t_evidence"))
    units = (F.col("t_unit") == "") | (F.col("amount_unit") == "") | (F.col("t_unit") == F.col("amount_unit"))
    joined = t.join(children.join(few, key), key).where(units)
    size = Window.partitionBy("parent_id")
    joined = joined.withColumn("_fit", F.count(F.lit(1)).over(size)).where(F.col("_fit") <= MOST_COMPONENTS)
    sums = _sums(joined.groupBy("parent_id", "total").agg(F.collect_list(_child("")).alias("children")))
    sums = sums.join(t.select("parent_id", "t_evidence"), "parent_id")
    equation = F.concat(F.array_join(F.transform("amounts", fmt_g), " + "), F.lit(" = "), fmt_g(F.col("total")))
    return sums.select(
        F.col("parent_id").alias("source_fact_id"), F.get("component_ids", F.lit(0)).alias("target_fact_id"), F.lit("COMPUTED_SUPPORT").alias("relationship_type"), F.lit(0.95).alias("confidence"),
        equation.alias("reasoning"), F.concat(F.array("parent_id"), "component_ids").alias("supporting_fact_ids"), F.concat("t_evidence", "component_evidence").alias("supporting_evidence_ids"), "component_ids",
    )


def pair_key(edges: DataFrame) -> DataFrame:
    """pair_low, pair_high and the stored direction; computed support is keyed by its whole set of components."""
    e = edges if "component_ids" in edges.columns else edges.withColumn("component_ids", F.array().cast("array<string>"))
    undirected = F.col("relationship_type").isin(UNDIRECTED)
    low, high = F.least("source_fact_id", "target_fact_id"), F.greatest("source_fact_id", "target_fact_id")
    computed = (F.col("relationship_type") == "COMPUTED_SUPPORT") & (F.size("component_ids") > 0)
    e = e.withColumns(
        {
            "pair_low": F.when(computed, F.col("source_fact_id")).when(undirected, low).otherwise(F.col("source_fact_id")),
            "pair_high": F.when(computed, F.array_join(F.array_sort(F.array_union("component_ids", F.array("target_fact_id"))), "|")).when(undirected, high).otherwise(F.col("target_fact_id")),
            "_s": F.when(undirected, low).otherwise(F.col("source_fact_id")),
            "_t": F.when(undirected, high).otherwise(F.col("target_fact_id")),
        }
    )
    return e.withColumns({"source_fact_id": F.col("_s"), "target_fact_id": F.col("_t")}).drop("_s", "_t")


def dedupe(edges: DataFrame) -> DataFrame:
    """One edge for each type and pair: the highest confidence wins, reasons are joined winner first; self links go.

    Edges of one key and reason are reduced before their shuffle, so a key gathers its distinct reasons only.
    """
    keyed = pair_key(edges.where("source_fact_id <> target_fact_id"))
    key = ["relationship_type", "pair_low", "pair_high"]
    order = F.struct((-F.col("confidence")).alias("c"), F.coalesce("reasoning", F.lit("")).alias("r"), "source_fact_id", "target_fact_id")
    each = keyed.groupBy(*key, "reasoning").agg(F.min_by(F.struct("source_fact_id", "target_fact_id", "supporting_fact_ids", "supporting_evidence_ids"), order).alias("edge"), F.min(order).alias("at"))
    g = each.groupBy(*key).agg(F.min_by("edge", "at").alias("edge"), F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "reasoning"))).alias("_all"))
    return g.select(
        F.sha2(F.concat_ws("|", *key), 256).alias("id"), *key, "edge.source_fact_id", "edge.target_fact_id",
        (-F.col("at.c")).alias("confidence"), merge_reasons(F.transform("_all", lambda x: x["reasoning"])).alias("reasoning"), "edge.supporting_fact_ids", "edge.supporting_evidence_ids",
    )


def validate(edges: DataFrame, f: DataFrame) -> DataFrame:
    """edges plus ok, result and reason of the check for their type, all facts being the cohort."""
    l, r = sides(f)  # noqa: E741
    e = edges.join(l, F.col("source_fact_id") == F.col("l_id"), "left").join(r, F.col("target_fact_id") == F.col("r_id"), "left")
    known = e.where("l_id is not null and r_id is not null").select(*[f"{side}_{c}" for side in "lr" for c in SUPPORTED_BY]).distinct()
    support = with_transition(known, f).select("l_id", "r_id", "support_ids")
    e = e.join(support, ["l_id", "r_id"], "left")
    kind, same_attr = F.col("relationship_type"), F.col("l_canonical_attribute") == F.col("r_canonical_attribute")
    agree, supported = equivalent() | approximate(), F.col("support_ids").isNotNull()
    comparable, parts = dimensions_compatible(*_c("dimension")), F.coalesce(hierarchical("l", "r"), F.lit(False))
    differing = kind.isin("UNRESOLVED_DIFFERENCE", "POTENTIAL_CONTRADICTION")
    fail = first_match(
        [
            (F.col("l_id").isNull() | F.col("r_id").isNull(), F.lit("Missing source or target fact.")),
            (F.col("l_id") == F.col("r_id"), F.lit("Self-links are not allowed.")),
            (kind.isin("CONTRADICTS", "CORROBORATES") & ~comparable, F.concat(F.lit("Incomparable value dimensions ("), "l_dimension", F.lit(" vs "), "r_dimension", F.lit(")."))),
            ((kind == "CONTRADICTS") & ~same_attr, F.lit("Different attributes cannot contradict.")),
            ((kind == "CONTRADICTS") & ~same_period(), F.lit("Contradiction requires the same period.")),
            ((kind == "CONTRADICTS") & agree, F.lit("Contradiction requires different values.")),
            ((kind.isin("CORROBORATES", "RECONCILES") | differing) & ~same_attr, F.lit("Same canonical attribute required.")),
            ((kind == "CORROBORATES") & ~agree, F.lit("Corroboration requires equivalent values.")),
            ((kind == "RECONCILES") & agree, F.lit("Reconciliation applies to different values.")),
            ((kind == "RECONCILES") & same_period(), F.lit("Same-period disagreements are contradictions, not reconciliations.")),
            ((kind == "RECONCILES") & ~supported, F.lit("Reconciliation requires extracted transition evidence.")),
            (differing & agree, F.lit("Approximate equivalents corroborate instead.")),
            (differing & supported, F.lit("Transition evidence should reconcile this pair.")),
            ((kind == "COMPUTED_SUPPORT") & ~F.coalesce(F.col("l_revenue") == "total_revenue", F.lit(False)), F.lit("COMPUTED_SUPPORT must point at a total.")),
            ((kind == "PART_OF") & F.coalesce(sibling(), F.lit(False)), F.lit("Sibling facts cannot be PART_OF each other.")),
            ((kind == "PART_OF") & same_attr, F.lit("A fact cannot be PART_OF itself or the same canonical attribute.")),
            ((kind == "PART_OF") & F.coalesce(F.col("r_revenue").isin(CHILD_REVENUE), F.lit(False)), F.lit("Children may never become parents.")),
            ((kind == "PART_OF") & ~parts, F.lit("PART_OF requires a parent-child hierarchy (e.g. product_revenue -> total_revenue).")),
            (kind.isin("SUPPORTS", "TEMPORAL_SUCCESSOR"), F.lit("Candidate pair is not eligible for this relationship type.")),
            (~kind.isin(TYPES), F.concat(F.lit("Unknown relationship type "), kind, F.lit("."))),
        ],
        F.lit(None).cast("string"),
    )
    passed = F.coalesce(F.col("reasoning"), F.lit(""))
    return e.withColumn("_fail", fail).select(*edges.columns, F.col("_fail").isNull().alias("ok"), F.when(F.col("_fail").isNull(), "PASSED").otherwise("FAILED").alias("result"), F.coalesce("_fail", passed).alias("check_reason"))


EDGE_COLUMNS = ["source_fact_id", "target_fact_id", "relationship_type", "confidence", "reasoning", "supporting_fact_ids", "supporting_evidence_ids", "component_ids"]


def proposed(f: DataFrame, window: int = PAGE_WINDOW, support: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Edges of a fact set given by its ``features``, one a type and pair, not yet checked. ``f`` is read several times: write
    it first. Transition support is looked for in ``support``, else in ``f``; ``near``: its ``near_ids``, where they are written."""
    empty = F.array().cast("array<string>")
    crossed = classify(with_transition(pairs(f), f if support is None else support)).withColumn("component_ids", empty)
    return dedupe(crossed.select(*EDGE_COLUMNS).unionByName(computed_support(f).select(*EDGE_COLUMNS)).unionByName(part_of(f, window=window, near=near).withColumn("component_ids", empty).select(*EDGE_COLUMNS)))


def valid(edges: DataFrame, f: DataFrame) -> DataFrame:
    """The edges that pass their check."""
    return validate(edges, f).where("ok").drop("ok", "result", "check_reason")


def link_features(f: DataFrame, window: int = PAGE_WINDOW) -> DataFrame:
    """All edges of a fact set, deduplicated and valid; a store writes the proposed ones in between."""
    return valid(proposed(f, window), f)


def link(facts: DataFrame, evidence: DataFrame, window: int = PAGE_WINDOW) -> DataFrame:
    return link_features(features(facts, evidence), window)


def touched_by(f: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """Features of all facts that count for an edge of one of ``fact_ids``: those that share an attribute and entity or a
    scope of sums with it, and those in any document of a fact that shares a document with it."""
    own = f.join(fact_ids.select(F.col("fact_id").alias("id")).distinct(), "id", "left_semi")
    placed = f.select("id", F.explode("pages").alias("at")).select("id", F.col("at.d").alias("d")).distinct()
    scoped = f.withColumn("scope_entity", normalize_token(F.col("canonical_entity")))
    buckets = own.select("canonical_attribute", "bucket_entity").distinct()
    scopes = own.select(normalize_token(F.col("canonical_entity")).alias("scope_entity"), "period_key").distinct()
    beside = placed.join(placed.join(own.select("id"), "id", "left_semi").select("d").distinct(), "d", "left_semi").select("id").distinct()
    around = placed.join(placed.join(beside, "id", "left_semi").select("d").distinct(), "d", "left_semi").select("id")
    ids = f.join(buckets, ["canonical_attribute", "bucket_entity"], "left_semi").select("id")
    ids = ids.unionByName(scoped.join(scopes, ["scope_entity", "period_key"], "left_semi").select("id")).unionByName(around)
    return f.join(ids.distinct(), "id", "left_semi")


def at_facts(rows: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """Rows (source_fact_id, target_fact_id, ...) with an end in ``fact_ids`` (fact_id)."""
    ids = fact_ids.select("fact_id").distinct()
    s = rows.join(ids.select(F.col("fact_id").alias("source_fact_id"), F.lit(True).alias("_s")), "source_fact_id", "left")
    return s.join(ids.select(F.col("fact_id").alias("target_fact_id"), F.lit(True).alias("_t")), "target_fact_id", "left").where("_s or _t").select(*rows.columns)


def explained_by(edges: DataFrame, f: DataFrame, moved: DataFrame) -> DataFrame:
    """fact_id of facts at stored edges that a changed transition may decide anew: ``moved`` (features, old and new ones) holds the value of
    one end, or was named as support."""
    kinds = edges.where(F.col("relationship_type").isin("RECONCILES", "UNRESOLVED_DIFFERENCE", "POTENTIAL_CONTRADICTION"))
    ends = kinds.select(F.explode(F.array("source_fact_id", "target_fact_id")).alias("id")).distinct()
    values = ends.join(f.select("id", F.lower(F.trim("value")).alias("name")), "id").where("name <> ''")
    moving = moved.where("transition").select(F.col("id").alias("s_id"), F.col("blob").alias("s_blob"))
    held = values.join(holding(values.select("name").distinct(), moving), "name").select(F.col("id").alias("fact_id"))
    named = kinds.where("relationship_type = 'RECONCILES'").select("source_fact_id", F.explode("supporting_fact_ids").alias("id")).join(moved.select("id"), "id", "left_semi")
    return held.unionByName(named.select(F.col("source_fact_id").alias("fact_id"))).distinct()


def summed_with(f: DataFrame, moved: DataFrame, fact_ids: DataFrame, window: int = PAGE_WINDOW, write=lambda name, df: df) -> DataFrame:
    """fact_id of facts whose sums or parts may change with ``fact_ids``: totals of their scopes, and facts near them. ``f`` holds the facts as
    they are, ``moved`` the changed ones as they were and are; ``write`` may store what is read several times."""
    scope = lambda x: x.select(normalize_token(F.col("canonical_entity")).alias("scope_entity"), "period_key")
    totals = f.where("revenue = 'total_revenue'").withColumn("scope_entity", normalize_token(F.col("canonical_entity"))).join(scope(moved).distinct(), ["scope_entity", "period_key"], "left_semi").select(F.col("id").alias("fact_id"))
    slim = ["id", "canonical_attribute", "canonical_entity", "bucket_entity", "period_key", "revenue", "prefix", "core", "pages"]
    both = f.select(*slim).unionByName(moved.select(*slim).join(f.select("id"), "id", "left_anti").dropDuplicates(["id"]))
    pairs = near_ids(write("around", touched_by(write("both", both), fact_ids)), window)
    ids = fact_ids.select("fact_id").distinct()
    parents = pairs.join(ids.withColumnRenamed("fact_id", "l_id"), "l_id", "left_semi").select(F.col("r_id").alias("fact_id"))
    return totals.unionByName(parents).distinct()


def candidate_log(f: DataFrame, window: int = PAGE_WINDOW, near: DataFrame | None = None) -> DataFrame:
    """Rejected PART_OF proposals among nearby facts, given by their ``features``, with reasons."""
    p = candidates(f, window, near)
    related = F.coalesce(hierarchical("l", "r") | hierarchical("r", "l"), F.lit(False)) | F.coalesce(sibling(), F.lit(False))
    allowed = F.coalesce(hierarchical("l", "r"), F.lit(False)) & ~F.coalesce(sibling(), F.lit(False))
    reason = first_match([(F.coalesce(sibling(), F.lit(False)), F.lit("Sibling facts cannot be PART_OF each other.")), (F.coalesce(hierarchical("r", "l"), F.lit(False)), F.lit("Parent cannot be PART_OF its child."))], F.lit("Candidate pair is not eligible."))
    side = lambda s: statement(F.col(f"{s}_canonical_attribute"), F.col(f"{s}_value"), F.lit(""))
    return p.where(related & ~allowed & (F.col("l_canonical_attribute") != F.col("r_canonical_attribute"))).select(
        F.col("l_id").alias("source_fact_id"), F.col("r_id").alias("target_fact_id"), side("l").alias("source_fact"), side("r").alias("target_fact"), F.lit("PART_OF").alias("proposed_relationship"), F.lit(False).alias("accepted"), reason.alias("reason")
    )


def proposal_log(rejected: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """All proposals: those of ``rejected`` (a ``candidate_log``), and the edges that were accepted, with their reasons."""
    view = edge_view(edges, facts)
    accepted = view.select(
        "source_fact_id", "target_fact_id", F.col("source_statement").alias("source_fact"), F.col("target_statement").alias("target_fact"), F.col("relationship_type").alias("proposed_relationship"), F.lit(True).alias("accepted"), F.col("reasoning").alias("reason")
    )
    return rejected.unionByName(accepted)


def edge_view(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges with both statements, an arrow of them and what the direction means, in listing order."""
    view = facts.select("id", "entity", "attribute", "value", "unit", "period", statement(F.coalesce(F.nullif(F.col("canonical_attribute"), F.lit("")), "attribute"), F.col("value"), F.col("unit")).alias("statement"))
    s, t = (view.select(*[F.col(c).alias(f"{side}_{c}") for c in view.columns]) for side in ("source", "target"))
    joined = edges.join(s, F.col("source_fact_id") == F.col("source_id")).join(t, F.col("target_fact_id") == F.col("target_id")).drop("source_id", "target_id")
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair]), F.col("relationship_type")), F.lit("Source -> Target"))
    return joined.withColumns({"arrow": F.concat("source_statement", F.lit(" -> "), "target_statement"), "direction_label": label}).orderBy("relationship_type", "source_attribute", "target_attribute", "id")


def exists(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (source_fact_id, target_fact_id, relationship_type, and component_ids where sums are asked for) plus ``found``; directions count for directed types only."""
    have = edges.select("relationship_type", "pair_low", "pair_high").distinct().withColumn("found", F.lit(True))
    same = pair_key(asked.withColumns({"_asked_s": F.col("source_fact_id"), "_asked_t": F.col("target_fact_id"), "relationship_type": relationship_type(F.col("relationship_type"))}))
    return same.join(have, ["relationship_type", "pair_low", "pair_high"], "left").select(
        F.col("_asked_s").alias("source_fact_id"), F.col("_asked_t").alias("target_fact_id"), "relationship_type", F.coalesce("found", F.lit(False)).alias("found")
    )


def type_counts(edges: DataFrame) -> DataFrame:
    """Edges of every type, zero where there is none."""
    names = edges.sparkSession.createDataFrame([(t,) for t in TYPES], "relationship_type string")
    return names.join(edges.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n")), "relationship_type", "left").select("relationship_type", F.coalesce("n", F.lit(0)).alias("n"))


