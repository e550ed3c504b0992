"""From contract and patch documents to reviewed contracts, for many runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight import vocab
from tablesight.functions import cells
from tablesight.operators import contract, patch, rules
from tablesight.plans.shared import cut
from tablesight.plans.validate import WORKERS, items_of, parsed

KEY = ["run_id", "column"]
_ENTRY = ("change_id", "column", "field", "after_value", "reasoning", "justification", "confidence", "needs_human_review")


def contract_rows(docs: DataFrame) -> DataFrame:
    """Typed rows of contract documents (``run_id``, ``raw``); ``ordinal`` is the row's place in its document."""
    worker = WORKERS["canonical_contract"]
    names = worker.sections[0].fields
    return items_of(worker, parsed(docs, "document")).filter("section = 0").select("run_id", F.col("position").alias("ordinal"), F.lit(True).alias("in_a2"), *names)


def stated_counts(docs: DataFrame) -> DataFrame:
    """The summary counts contract documents claim, right or wrong."""
    doc = F.try_parse_json("raw")
    return docs.select("run_id", *[F.try_variant_get(doc, f"$.summary.{c}", "bigint").alias(c) for c in vocab.SUMMARY_COUNTS])


def patch_entries(docs: DataFrame) -> DataFrame:
    """Change-set entries of patch documents, with ``after_value`` as JSON text (null only when absent)."""
    items = F.try_variant_get(F.try_parse_json("raw"), "$.change_set", "array<variant>")
    rows = docs.filter(cells.json_error(F.col("raw"), "x").isNull()).select("run_id", F.posexplode(items).alias("position", "entry"))
    kinds = {"confidence": "double", "needs_human_review": "boolean"}
    cols = [F.try_variant_get("entry", f"$.{f}", kinds.get(f, "string")).alias(f) for f in _ENTRY if f != "after_value"]
    value = F.try_variant_get("entry", "$.after_value", "variant")
    return rows.select("run_id", "position", *cols, F.to_json(value).alias("after_value"), F.to_json("entry").alias("entry_json"))


def review_headers(docs: DataFrame) -> DataFrame:
    doc = F.try_parse_json("raw")
    return docs.select(
        "run_id", F.trim(F.try_variant_get(doc, "$.review_summary.overview", "string")).alias("review_overview"),
        F.coalesce(F.try_variant_get(doc, "$.review_summary.review_principles", "array<string>"), F.array().cast("array<string>")).alias("review_principles"))


def header_errors(docs: DataFrame) -> DataFrame:
    """Top-level problems of patch documents."""
    doc, raw = F.try_parse_json("raw"), F.col("raw")
    have = F.json_object_keys(raw)
    top = ("worker", "review_summary", "change_set", "review_flags", "assumptions")
    defaulted = ("change_set", "review_flags", "assumptions")
    say = lambda cond, *parts: F.when(F.coalesce(cond, F.lit(False)), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    extra = F.array_sort(F.array_except(have, F.array(*[F.lit(t) for t in top])))
    name = F.try_variant_get(doc, "$.worker", "string")
    overview = F.try_variant_get(doc, "$.review_summary.overview", "string")
    summary = F.get_json_object(raw, "$.review_summary")
    odd = F.array_sort(F.array_except(F.json_object_keys(summary), F.array(F.lit("overview"), F.lit("review_principles"))))
    checks = [
        say(F.size(extra) > 0, "Unexpected top-level key(s): ", F.array_join(extra, ", ")),
        *[say(~F.array_contains(have, t), f"Missing required top-level key: {t}") for t in top if t not in defaulted],
        say(name != "canonical_contract_reviewer", "worker must be 'canonical_contract_reviewer'."),
        say(F.size(odd) > 0, "review_summary has unexpected key(s): ", F.array_join(odd, ", ")),
        say(summary.isNotNull() & overview.isNull(), "review_summary.overview is required."),
        say(cells.trimmed(overview) == "", "review_summary.overview must not be blank."),
    ]
    live = docs.filter(cells.json_error(raw, "x").isNull())
    return live.select("run_id", F.explode(F.array_compact(F.array(*checks))).alias("message")).unionByName(
        rules.document_errors(docs, "raw", "reviewer_output"))


def review_contracts(contracts: DataFrame, patches: DataFrame) -> dict[str, DataFrame]:
    """Validate and apply patches. Both inputs are documents: ``run_id``, ``raw``.

    A run is applied only when its own contract is coherent and its patch has no error; every other
    run is in ``errors`` with its reasons. No-op edits are removed first and logged.
    """
    before = cut(contract_rows(contracts))
    source = rules.contract_rules().errors(before.withColumn("position", F.col("ordinal"))).select("run_id", "message")
    entries = rules.gate(source, patch_entries(patches))
    entries, noops = patch.split_noops(entries, before)
    entries = cut(entries)
    known = before.select(*KEY, F.lit(True).alias("known"))
    judged = entries.join(known, KEY, "left").withColumn("known_column", F.coalesce("known", F.lit(False)))
    allowed = F.array(*[F.lit(f) for f in _ENTRY])
    extra = F.array_sort(F.array_except(F.json_object_keys("entry_json"), allowed))
    errors = source.unionByName(header_errors(patches)).unionByName(
        rules.patch_rules().errors(judged).select("run_id", "message")).unionByName(
        patch.rejected(entries, before).filter(F.col("message").contains("code-owned")).select("run_id", "message")).unionByName(
        rules.duplicates(entries, ["change_id"], "Duplicate change_set.change_id: ")).unionByName(
        rules.duplicates(entries, ["column", "field"], "Duplicate change_set column/field pair: ")).unionByName(
        entries.select("run_id", F.concat(F.format_string("change_set[%d] has unexpected key(s): ", "position"), F.array_join(extra, ", ")).alias("message"),
                       extra.alias("extra")).filter(F.size("extra") > 0).drop("extra"))
    valid = rules.gate(errors, entries.filter(F.col("field").isin(*vocab.PATCHABLE_FIELDS)))
    preview = patch.touched_rows(valid, before)
    prefix = F.format_string("preview_contract.column_contracts[%d]", "ordinal")
    table = F.trim(F.coalesce("canonical_table_name", F.lit("")))
    loose = F.col("canonical_assignment_role").isin(*vocab.TABLELESS_ROLES)
    preview_rules = [F.array_compact(F.array(
        F.when(loose & (table != ""), F.concat(prefix, F.lit(".canonical_table_name must be blank for excluded or unresolved rows."))),
        F.when(~loose & (table == ""), F.concat(prefix, F.lit(".canonical_table_name must not be blank for resolved rows."))))),
        contract.row_invariant_errors(prefix, end=".")]
    errors = cut(errors.unionByName(preview.select("run_id", F.explode(F.flatten(F.array(*preview_rules))).alias("message"))).distinct())
    good = cut(rules.gate(errors, entries))
    base = rules.gate(errors, before).join(patches.select("run_id"), "run_id", "left_semi")
    after = cut(patch.apply(base, good))
    log = cut(patch.change_log(good.drop("entry_json"), base, after, stated_counts(contracts)))
    summary = patch.stamped_summary(after, log)
    return {"errors": errors, "noop_log": noops, "contract": after, "change_log": log, "summary": summary,
            "envelope": patch.envelope(summary, log, after, review_headers(patches))}
