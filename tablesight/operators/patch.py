"""Applying reviewed patches to contracts, and the change log that results.

Patch rows are ``run_id, position, change_id, column, field, after_value`` with ``after_value`` as
JSON text (a patch may set a field to null, so presence and value are kept apart), plus
``reasoning, justification, confidence, needs_human_review``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight import vocab
from tablesight.operators.contract import row_invariant_errors, summary_counts
from tablesight.plans.shared import stored

KEY = ["run_id", "column"]

# Texts of the log rows that code writes by itself.
SUMMARY_REASONING = "Summary counts are code-owned and were recomputed after applying the reviewer patch."
SUMMARY_JUSTIFICATION = (
    "The final reviewed contract must carry deterministic summary counts that match the final row states exactly.")

_TYPES = {**dict.fromkeys(vocab.PATCHABLE_LISTS, "array<string>"), **dict.fromkeys(vocab.PATCHABLE_NUMBERS, "double"),
          **dict.fromkeys(vocab.PATCHABLE_BOOLEANS, "boolean")}


def _typed(field: str, text: Column) -> Column:
    """JSON text to the field's type; null when it does not hold that type."""
    return F.try_variant_get(F.try_parse_json(text), "$", _TYPES.get(field, "string"))


def _json(value: Column) -> Column:
    """A contract field as compact JSON text (``null`` when it has no value)."""
    value = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_extract(value, r'^\{"v":([\s\S]*)\}$', 1)


def _patched(contract: DataFrame, patches: DataFrame) -> DataFrame:
    """The contract rows that some patch names; only these are written as JSON."""
    return contract.join(patches.select(*KEY).distinct(), KEY, "left_semi")


def field_values(contract: DataFrame) -> Column:
    """Map of every patchable field to its JSON text."""
    have = [f for f in vocab.PATCHABLE_FIELDS if f in contract.columns]
    return F.create_map(*[x for f in have for x in (F.lit(f), _json(F.col(f)))])


def _value_of(contract: DataFrame, field: Column, row: str) -> Column:
    """JSON text of the one field of ``contract`` that ``field`` names, read from the struct ``row``; one writer per type."""
    kinds: dict[str, list[str]] = {}
    for f, kind in contract.dtypes:
        if f in vocab.PATCHABLE_FIELDS:
            kinds.setdefault(kind, []).append(f)
    out = F.lit(None).cast("string")
    for kind, fields in kinds.items():
        value = F.lit(None).cast(kind)
        for f in fields:
            value = F.when(field == f, F.col(f"{row}.{f}")).otherwise(value)
        out = F.when(field.isin(*fields), _json(value)).otherwise(out)
    return out


def _canonical(field: Column, text: Column) -> Column:
    """``text`` re-serialised the way the contract serialises that field, so equal values compare equal."""
    out = text
    for f in vocab.PATCHABLE_FIELDS:
        value = F.to_json(F.struct(_typed(f, text).alias("v")), {"ignoreNullFields": "false"})
        out = F.when(field == f, F.regexp_extract(value, r'^\{"v":([\s\S]*)\}$', 1)).otherwise(out)
    return out


def split_noops(patches: DataFrame, contract: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches that change something, log rows for the ones that were removed)."""
    before = _patched(contract, patches).select(*KEY, field_values(contract).alias("before"))
    joined = patches.join(before, KEY, "left")
    same = F.coalesce(F.element_at("before", F.col("field")) == _canonical(F.col("field"), F.col("after_value")), F.lit(False))
    marked = joined.withColumn("noop", same & F.col("field").isin(*vocab.PATCHABLE_FIELDS)).drop("before")
    log = marked.filter("noop").select(
        "run_id", F.format_string("change_set[%d]", "position").alias("path"),
        F.lit('{"removed":"no_op_change_entry"}').alias("defaulted_to"))
    return marked.filter("not noop").drop("noop"), log


def rejected(patches: DataFrame, contract: DataFrame) -> DataFrame:
    """Why a patch cannot be applied: unknown column, forbidden field, or smuggled skip hint."""
    known = contract.select(*KEY, F.coalesce("interpretation_hints", F.array().cast("array<string>")).alias("hints"))
    joined = patches.join(known, KEY, "left")
    path = F.format_string("change_set[%d]", "position")
    wanted = F.coalesce(_typed("interpretation_hints", F.col("after_value")), F.array().cast("array<string>"))
    moved = (F.col("field") == "interpretation_hints") & (
        F.array_contains("hints", "skip_logic_protected") != F.array_contains(wanted, "skip_logic_protected"))
    message = (
        F.when(F.col("hints").isNull(), F.concat(path, F.lit(".column must resolve against canon_contract_json.column_contracts.")))
        .when(~F.col("field").isin(*vocab.PATCHABLE_FIELDS), F.concat(path, F.lit(".field points to a forbidden field: "), F.col("field")))
        .when(moved, F.concat(path, F.lit(".field cannot add or remove skip_logic_protected in interpretation_hints "
                                          "because that bookkeeping is code-owned.")))
    )
    return joined.select("run_id", "position", message.alias("message")).filter(F.col("message").isNotNull())


def apply(contract: DataFrame, patches: DataFrame) -> DataFrame:
    """The contract after all patches; where a field is patched twice the later patch wins.

    Patches are pivoted to one row per (run_id, column) first, so contract rows are never
    multiplied and rows without patches pass straight through.
    """
    fields = [f for f in vocab.PATCHABLE_FIELDS if f in contract.columns]
    # wrapped in a struct: a patch to JSON null must still count as present
    wide = patches.groupBy(*KEY).agg(*[
        F.max(F.when(F.col("field") == f, F.struct("position", "after_value"))).alias(f"to_{f}") for f in fields])
    joined = contract.join(wide, KEY, "left")
    return joined.withColumns({
        f: F.when(F.col(f"to_{f}").isNotNull(), _typed(f, F.col(f"to_{f}.after_value"))).otherwise(F.col(f)) for f in fields
    }).drop(*[f"to_{f}" for f in fields])


def unique_ids(rows: DataFrame) -> DataFrame:
    """Give repeated change ids the first free ``id_1``, ``id_2``... of their run, in order.

    Ids can only clash when they share a root (the id without trailing ``_n`` parts). Where a root
    has one spelling, the suffix is a running number. Only roots with several spellings (``a`` beside
    ``a_1``) need the order-dependent rule, and only those are folded, one array per run and root.
    """
    group = ["run_id", "root"]
    live = rows.withColumn("root", F.regexp_replace("change_id", r"(_[0-9]+)+$", "")).filter("run_id is not null and root is not null")
    of_root = Window.partitionBy(*group)
    mixed = F.min("change_id").over(of_root) != F.max("change_id").over(of_root)
    place = F.row_number().over(Window.partitionBy(*group, "change_id").orderBy("position")) - 1
    marked = live.withColumn("mixed", mixed)
    others = [c for c in rows.columns if c != "run_id"]
    plain = marked.filter(~F.col("mixed")).withColumn("place", place).select("run_id", *others, F.when(
        F.col("place") == 0, F.col("change_id")).otherwise(F.concat_ws("_", "change_id", F.col("place").cast("string"))).alias("unique_id"))
    ids = marked.filter("mixed").groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("position", "change_id"))).alias("items"), F.collect_list(F.struct(*others)).alias("rows"))
    numbered = lambda base, s: F.when(s.startswith(F.concat(base, F.lit("_"))), F.substring(s, F.length(base) + 2, F.length(s)))
    plain_number = lambda n: F.when(n.rlike("^[1-9][0-9]{0,8}$"), n.cast("int"))
    taken = lambda seen, base: F.transform(seen, lambda s: plain_number(numbered(base, s)))
    first = lambda seen, base: F.array_min(F.array_except(F.sequence(F.lit(1), F.size(seen) + 1), taken(seen, base)))
    free = lambda seen, base: F.when(~F.array_contains(seen, base), base).otherwise(F.concat_ws("_", base, first(seen, base).cast("string")))
    seen = F.aggregate("items", F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(free(acc, x["change_id"]))))
    # a row takes the names of its position, as many as rows have it
    found = ids.withColumn("names", seen).select("run_id", F.arrays_zip("items", "names").alias("named"), F.explode("rows").alias("row"))
    own = F.filter("named", lambda z: z["items"]["position"] == F.col("row.position"))
    return plain.unionByName(found.select("run_id", "row.*", F.explode(F.transform(own, lambda z: z["names"])).alias("unique_id")))


def change_log(patches: DataFrame, before: DataFrame, after: DataFrame, stated: DataFrame | None = None,
               keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """One row per applied patch, and one per summary count that had to be corrected.

    ``before`` and ``after`` carry ``ordinal``, the 0-based row position in their contract.
    ``stated`` holds the counts the contracts claimed; without it their recomputed counts are used.
    ``keep`` writes the log once; where the inputs lie dealt by run, it keeps the log so.
    """
    fields = lambda c: F.struct(*[f for f in vocab.PATCHABLE_FIELDS if f in c.columns])
    old = before.select(*KEY, "ordinal", fields(before).alias("old"))
    new = after.select(*KEY, fields(after).alias("new"))
    rows = patches.join(old, KEY).join(new, KEY).select(
        "run_id", "position", "change_id", "column",
        F.concat(F.lit("/reviewed_contract/column_contracts/"), F.col("ordinal").cast("string"), F.lit("/"), "field").alias("target_path"),
        _value_of(before, F.col("field"), "old").alias("before_value"), _value_of(after, F.col("field"), "new").alias("after_value"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.coalesce("justification", F.lit("")).alias("justification"),
        F.col("confidence").cast("double").alias("confidence"), F.coalesce("needs_human_review", F.lit(False)).alias("needs_human_review"),
    )
    claimed = stated if stated is not None else summary_counts(before)
    # numbering reads the log several times, most of them its ids alone
    log = keep(rows.unionByName(summary_corrections(claimed, summary_counts(after))), "change_log")
    return unique_ids(log).drop("change_id").withColumnRenamed("unique_id", "change_id")


def summary_corrections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Log rows for counts whose stated value differs from the recomputed one."""
    pairs = old.select("run_id", *[F.col(c).alias(f"old_{c}") for c in vocab.SUMMARY_COUNTS]).join(new, "run_id")
    items = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("key"), F.col(f"old_{c}").alias("old"), F.col(c).alias("new"))
        for i, c in enumerate(vocab.SUMMARY_COUNTS)
    ])
    rows = pairs.select("run_id", F.inline(items)).filter(~F.col("old").eqNullSafe(F.col("new")))
    return rows.select(
        "run_id", (F.lit(1_000_000_000) + F.col("i")).alias("position"),
        F.concat(F.lit("sys_summary_"), "key").alias("change_id"), F.lit("").alias("column"),
        F.concat(F.lit("/reviewed_contract/summary/"), "key").alias("target_path"),
        F.coalesce(F.col("old").cast("string"), F.lit("null")).alias("before_value"), F.col("new").cast("string").alias("after_value"),
        F.lit(SUMMARY_REASONING).alias("reasoning"), F.lit(SUMMARY_JUSTIFICATION).alias("justification"),
        F.lit(1.0).alias("confidence"), F.lit(False).alias("needs_human_review"),
    )


def changed_columns(log: DataFrame) -> DataFrame:
    name = F.trim("column")
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("change_count"),
        F.count_distinct(F.when(name != "", name)).alias("changed_column_count"))


def stamped_summary(after: DataFrame, log: DataFrame) -> DataFrame:
    """Recomputed counts plus the review fields of each run."""
    out = summary_counts(after).join(changed_columns(log), "run_id", "left").na.fill(0, ["change_count", "changed_column_count"])
    return out.select(
        "run_id",
        F.format_string("Post-review canonical column contract for %d columns. Deterministic summary counts reflect the final "
                        "reviewed rows after applying %d reviewer change(s) affecting %d column(s).",
                        "total_source_columns", "change_count", "changed_column_count").alias("overview"),
        *vocab.SUMMARY_COUNTS, F.lit(True).alias("review_applied"),
        F.col("change_count").alias("review_change_count"), F.col("changed_column_count").alias("review_changed_column_count"))


def order_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose position or column differs between the two contracts; empty when order held."""
    a = before.select("run_id", "ordinal", F.col("column").alias("before_column"))
    b = after.select("run_id", "ordinal", F.col("column").alias("after_column"))
    return a.join(b, ["run_id", "ordinal"], "full").filter(~F.col("before_column").eqNullSafe(F.col("after_column")))


def final_errors(after: DataFrame) -> DataFrame:
    """Invariants the patched rows still break."""
    prefix = F.format_string("reviewed_contract.column_contracts[%d]", "ordinal")
    return after.select("run_id", "ordinal", F.posexplode(row_invariant_errors(prefix)).alias("rule", "message"))


def envelope(summary: DataFrame, log: DataFrame, after: DataFrame, review: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """One compact JSON document per run, with the deprecated alias fields.

    A document holds one dataset's columns and changes, so its arrays are as large as that table is wide.
    """
    rows = after.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(
        *[c for c in after.columns if c not in ("run_id", "ordinal", "in_a2")]).alias("row")))), lambda r: r["row"]).alias("column_contracts"))
    entries = log.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(
        *[c for c in log.columns if c not in ("run_id", "position")]).alias("row")))), lambda r: r["row"]).alias("change_log"))
    out = rows.join(summary, "run_id").join(entries, "run_id", "left").join(review, "run_id", "left")
    empty = F.array().cast("array<struct<item:string,issue:string,why:string>>")
    if flags is not None:
        out = out.join(flags.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("item", "issue", "why"))).alias("flags")), "run_id", "left")
    else:
        out = out.withColumn("flags", empty)
    none = F.array().cast("array<struct<assumption:string,explanation:string>>")
    flags_col = F.coalesce("flags", empty)
    doc = F.struct(
        F.lit("canonical_contract_reviewer").alias("worker"),
        F.struct(F.col("review_overview").alias("overview"), F.col("review_change_count").alias("change_count"),
                 F.col("review_changed_column_count").alias("changed_column_count"), "review_principles").alias("review_summary"),
        F.struct(F.struct(*[c for c in summary.columns if c != "run_id"]).alias("summary"), "column_contracts").alias("reviewed_contract"),
        "change_log", flags_col.alias("reviewer_flags"), none.alias("reviewer_assumptions"),
        flags_col.alias("review_flags"), none.alias("assumptions"),
    )
    return out.select("run_id", F.to_json(doc).alias("canon_review_json"))


def touched_rows(patches: DataFrame, before: DataFrame) -> DataFrame:
    """Preview of only the rows a patch set touches."""
    keys = patches.select(*KEY).distinct()
    return apply(before.join(keys, KEY, "left_semi"), patches)


__all__ = ["apply", "change_log", "changed_columns", "envelope", "field_values", "final_errors", "order_violations",
           "rejected", "split_noops", "stamped_summary", "summary_corrections", "touched_rows", "unique_ids"]
