"""Batch validation of decision tables.

A rule is one Column that yields the messages a row earns (an array, mostly empty). A rule set runs
as a single projection over the decision table of all runs; only rows that break a rule are kept,
so a clean table costs one scan and no shuffle. Field names and message texts are fixed values: they
must equal the published rules for verdicts to agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight import vocab
from tablesight.functions import cells
from tablesight.operators.contract import row_invariant_errors

_TEXTS = "array<string>"


def _none() -> Column:
    return F.array().cast(_TEXTS)


def _when(cond: Column, *message: Column | str) -> Column:
    parts = [F.lit(m) if isinstance(m, str) else m for m in message]
    return F.when(F.coalesce(cond, F.lit(False)), F.array(F.concat(*parts))).otherwise(_none())


def _blank(field: str) -> Column:
    return cells.trimmed(F.col(field)) == ""


def _listed(values: Iterable[str]) -> str:
    return ", ".join(sorted(values))


class Rules:
    """Collects the rules of one kind of row; ``path`` is how messages name the row."""

    def __init__(self, array: str, many: bool = True):
        self.path = F.format_string(f"{array}[%d]", F.col("position")) if many else F.lit(array)
        self.items: list[Column] = []

    def required(self, *fields: str, end: str = " is required.") -> Rules:
        for f in fields:
            self.items.append(_when(F.col(f).isNull(), self.path, f".{f}{end}"))
        return self

    def nonblank(self, *fields: str, end: str = " must not be blank.") -> Rules:
        for f in fields:
            self.items.append(_when(_blank(f), self.path, f".{f}{end}"))
        return self

    def one_of(self, field: str, allowed: Sequence[str], text: str | None = None, nulls: bool = False) -> Rules:
        end = text or f" must be one of: {_listed(allowed)}"
        bad = F.col(field).isNotNull() & ~_blank(field) & ~F.col(field).isin(*allowed)
        if nulls:
            bad = F.col(field).isNull() | ~F.col(field).isin(*allowed)
        self.items.append(_when(bad, self.path, f".{field}{end}"))
        return self

    def each_of(self, field: str, allowed: Sequence[str], text: str | None = None, blank: str | None = None) -> Rules:
        end = text or f" must be one of: {_listed(allowed)}"
        tagged = F.transform(F.coalesce(field, _none()), lambda x, j: F.struct(x.alias("x"), j.alias("j")))
        bad = F.filter(tagged, lambda t: F.coalesce(~t["x"].isin(*allowed), F.lit(True)))
        said = lambda t: F.when(cells.trimmed(t["x"]) == "", blank or end).otherwise(end)
        self.items.append(F.transform(bad, lambda t: F.concat(
            self.path, F.lit(f".{field}["), t["j"].cast("string"), F.lit("]"), said(t))))
        return self

    def not_empty(self, *fields: str, end: str = " must not be empty.") -> Rules:
        for f in fields:
            self.items.append(_when(F.size(f) == 0, self.path, f".{f}{end}"))
        return self

    def unit_range(self, field: str = "confidence", end: str = " must be between 0 and 1.", nulls: bool = False) -> Rules:
        bad = ~F.col(field).between(0, 1)
        self.items.append(_when(bad | F.col(field).isNull() if nulls else bad, self.path, f".{field}{end}"))
        return self

    def pair(self, first: str, second: str, allowed: dict[str, Sequence[str]], *message: Column | str) -> Rules:
        """``second`` must be one of the values ``first`` allows; only judged when both are known."""
        known = {v for vs in allowed.values() for v in vs}
        ok = F.lit(False)
        for k, vs in allowed.items():
            ok = F.when(F.col(first) == k, F.col(second).isin(*vs)).otherwise(ok)
        judged = F.col(first).isin(*allowed) & F.col(second).isin(*known)
        self.items.append(_when(judged & ~ok, self.path, *message))
        return self

    def custom(self, cond: Column, *message: Column | str) -> Rules:
        self.items.append(_when(cond, self.path, *message))
        return self

    def add(self, messages: Column) -> Rules:
        self.items.append(messages)
        return self

    def found(self) -> Column:
        """All messages a row earns, in rule order.

        Rules that found nothing are dropped by a lambda, which Spark runs rule by rule; as generated code the rules of
        one kind are a method too long for the JVM to compile, and then cost ten times as much.
        """
        return F.flatten(F.filter(F.array(*self.items), lambda x: F.coalesce(F.size(x) > 0, F.lit(True))))

    def errors(self, df: DataFrame) -> DataFrame:
        """run_id, position, rule, message: one row per broken rule."""
        found = df.select("run_id", "position", self.found().alias("found"))
        return found.select("run_id", "position", F.posexplode("found").alias("rule", "message"))


# ---------------------------------------------------------------- rule sets


def type_rules() -> Rules:
    storage = F.col("recommended_storage_type")
    pair = " has inconsistent type/storage pair: "
    r = Rules("column_decisions").required(
        "column", "recommended_logical_type", "recommended_storage_type", "normalization_notes", "confidence", "reasoning",
        "skip_logic_protected", "needs_human_review")
    r.nonblank("column").one_of("recommended_logical_type", vocab.LOGICAL_TYPES).one_of(
        "recommended_storage_type", vocab.STORAGE_TYPES)
    known = F.col("recommended_logical_type").isin(*vocab.LOGICAL_TYPES) & storage.isin(*vocab.STORAGE_TYPES)
    for logical, allowed in vocab.STORAGE_FOR_LOGICAL.items():
        broken = known & (F.col("recommended_logical_type") == logical) & ~storage.isin(*allowed)
        if logical == "categorical_code":
            r.custom(broken, f"{pair}categorical_code cannot use storage type ", storage)
        else:
            r.custom(broken, f"{pair}{logical} must use storage type {' or '.join(allowed)}")
    for f, allowed in vocab.PATCHABLE_LISTS.items():
        r.each_of(f, allowed, blank=" must not be blank.")
    return r.nonblank("normalization_notes", "reasoning").unit_range()


def missingness_rules() -> Rules:
    disposition, validity, handling = "missingness_disposition", "structural_validity", "recommended_handling"
    protected = F.col("skip_logic_protected")
    structural = F.col(validity).isin("confirmed_structural", "plausible_structural")
    r = Rules("column_decisions").required(
        "column", disposition, validity, handling, "trigger_columns", "normalization_notes", "reasoning", "confidence",
        "skip_logic_protected", "needs_human_review").nonblank("column")
    r.one_of(disposition, vocab.MISSINGNESS_DISPOSITIONS).one_of(validity, vocab.STRUCTURAL_VALIDITY)
    r.one_of(handling, vocab.MISSINGNESS_HANDLING)
    shown = (F.col(disposition), " cannot use ")
    r.pair(disposition, validity, vocab.VALIDITY_FOR_DISPOSITION,
           f" has inconsistent {disposition}/{validity} pair: ", *shown, F.col(validity))
    r.pair(disposition, handling, vocab.HANDLING_FOR_DISPOSITION,
           f" has inconsistent {disposition}/{handling} pair: ", *shown, F.col(handling))
    r.nonblank("normalization_notes", "reasoning").unit_range()
    r.custom((F.col(handling) == "protect_from_null_penalty") & ~protected,
             ".skip_logic_protected must be true when recommended_handling is protect_from_null_penalty.")
    r.custom((F.col(validity) == "confirmed_structural") & ~protected,
             ".skip_logic_protected must be true when structural_validity is confirmed_structural.")
    return r.custom(protected & F.col(validity).isin(*vocab.STRUCTURAL_VALIDITY) & ~structural,
                    ".skip_logic_protected cannot be true when structural_validity is ", F.col(validity), ".")


def layout_table_rules() -> Rules:
    wide = (F.col("kind") == "child_repeat") & (F.col("build_strategy") == "wide_to_long_family")
    index = cells.trimmed(F.col("repeat_index_name"))
    grain = F.concat("parent_key", F.array("repeat_index_name"))
    family = F.col("source_basis_kind").isin(*vocab.FAMILY_LIKE_BASIS) & (F.col("kind") == "child_repeat")
    tail = " is required for family-like child tables."
    r = Rules("table_suggestions").required(
        "table_name", "kind", "source_basis_kind", "parent_table_name", "parent_key", "grain_columns", "repeat_index_name",
        "build_strategy", "excluded_columns", "confidence", "reasoning", "needs_human_review").nonblank("table_name")
    r.one_of("kind", vocab.TABLE_KINDS, " is invalid.").one_of("source_basis_kind", vocab.SOURCE_BASIS_KINDS, " is invalid.")
    r.not_empty("grain_columns").one_of("build_strategy", vocab.BUILD_STRATEGIES, " is invalid.").unit_range()
    r.nonblank("reasoning")
    r.custom(wide & (index == ""), ".repeat_index_name must be non-empty.")
    r.custom(wide & (index != "") & ~F.col("grain_columns").eqNullSafe(grain),
             ".grain_columns must equal parent_key + repeat_index_name.")
    r.custom(family & F.col("source_family_id").isNull(), f".source_family_id{tail}")
    r.custom(family & _blank("source_family_id"), ".source_family_id must not be blank.")
    r.custom(family & F.col("included_column_count").isNull(), f".included_column_count{tail}")
    r.custom(family & (F.col("included_column_count") <= 0), ".included_column_count must be > 0.")
    r.custom(family & F.col("included_columns_preview").isNull(), f".included_columns_preview{tail}")
    r.custom(family & (F.size("included_columns_preview") == 0), ".included_columns_preview must not be empty.")
    r.custom(family & (F.size("included_columns") > 0),
             ".included_columns must be omitted or empty for family-like child compact summaries.")
    return r.custom(~family & (F.col("source_family_id") != ""), ".source_family_id must be omitted or blank for non-family tables.")


def assignment_rules() -> Rules:
    """Also needs ``known_table``: whether the assigned table is among the run's suggestions."""
    role, loose = F.col("assignment_role"), F.col("assignment_role").isin(*vocab.TABLELESS_ROLES)
    valid = role.isin(*vocab.ASSIGNMENT_ROLES)
    r = Rules("column_table_assignments").required("column", "assigned_table", "assignment_role", "source_family_id", "why")
    r.nonblank("column").one_of("assignment_role", vocab.ASSIGNMENT_ROLES, " is invalid.")
    r.custom(~F.coalesce(valid & loose, F.lit(False)) & _blank("assigned_table"), ".assigned_table must not be blank.").nonblank("why")
    r.custom(valid & ~loose & ~_blank("assigned_table") & ~F.col("known_table"),
             ".assigned_table must match a table_name in table_suggestions.")
    return r.custom(valid & (role == "melt_member") & (F.col("source_family_id").isNull() | _blank("source_family_id")),
                    ".source_family_id is required for melt_member.")


def analysis_table_rules() -> Rules:
    strategy, wave = F.col("build_strategy"), F.col("wave_column")
    merge = strategy == "merge_sibling_families_with_wave"
    r = Rules("analysis_table_suggestions").required(
        "table_name", "kind", "source_canonical_tables", "included_family_ids", "grain_columns", "build_strategy", "wave_column",
        "value_columns", "confidence", "reasoning", "needs_human_review").nonblank("table_name")
    r.one_of("kind", vocab.ANALYSIS_TABLE_KINDS, " is invalid.").one_of("build_strategy", vocab.ANALYSIS_STRATEGIES, " is invalid.")
    r.not_empty("source_canonical_tables", "grain_columns", "value_columns").unit_range().nonblank("reasoning")
    r.custom(merge & _blank("wave_column"), ".wave_column must be non-empty for merge_sibling_families_with_wave.")
    r.custom(merge & ~_blank("wave_column") & ~F.array_contains("grain_columns", wave),
             ".wave_column must be present in grain_columns for merge_sibling_families_with_wave.")
    return r.custom((strategy == "pass_through") & (F.size("source_canonical_tables") != 1),
                    ".pass_through should reference exactly one source canonical table.")


def derivation_rules() -> Rules:
    r = Rules("derivations").required("derivation_name", "derivation_kind", "source_tables", "output_table_name", "join_keys",
                                      "grouping_keys", "null_handling_policy", "reasoning").nonblank("derivation_name")
    r.one_of("derivation_kind", vocab.DERIVATION_KINDS, " is invalid.").not_empty("source_tables").nonblank("output_table_name")
    return r.one_of("null_handling_policy", vocab.NULL_POLICIES, " is invalid.").nonblank("reasoning")


_CONTRACT_FIELDS = (
    "column", "canonical_modeling_status", "canonical_table_name", "canonical_assignment_role", "source_family_id", "a9_primary_role",
    "recommended_logical_type", "recommended_storage_type", "transform_actions", "structural_transform_hints", "interpretation_hints",
    "missingness_disposition", "missingness_handling", "skip_logic_protected", "confidence", "needs_human_review",
    "type_decision_source", "structure_decision_source", "missingness_decision_source", "semantic_decision_source", "applied_sources")


def contract_rules(token_flag: Column | None = None) -> Rules:
    tableless = F.col("canonical_assignment_role").isin(*vocab.TABLELESS_ROLES)
    r = Rules("column_contracts").required(*_CONTRACT_FIELDS, end=" is required")
    r.custom(F.col("column").isNull() | _blank("column"), ".column must be a non-empty string")
    for f, allowed in (
        ("canonical_modeling_status", vocab.MODELING_STATUSES), ("canonical_assignment_role", vocab.ASSIGNMENT_ROLES),
        ("recommended_logical_type", vocab.LOGICAL_TYPES), ("recommended_storage_type", vocab.STORAGE_TYPES),
        ("missingness_disposition", vocab.MISSINGNESS_DISPOSITIONS), ("missingness_handling", vocab.MISSINGNESS_HANDLING),
        ("type_decision_source", vocab.TYPE_SOURCES), ("structure_decision_source", vocab.STRUCTURE_SOURCES),
        ("missingness_decision_source", vocab.MISSINGNESS_SOURCES), ("semantic_decision_source", vocab.SEMANTIC_SOURCES),
    ):
        r.one_of(f, allowed, " is invalid", nulls=True)
    r.custom(F.col("canonical_table_name").isNull(), ".canonical_table_name must be a string")
    r.custom(tableless & ~_blank("canonical_table_name"), ".canonical_table_name must be blank for excluded or unresolved assignments")
    r.custom(~F.coalesce(tableless, F.lit(False)) & _blank("canonical_table_name"),
             ".canonical_table_name must be non-blank for resolved assignments")
    for f, allowed in vocab.PATCHABLE_LISTS.items():
        r.custom(F.col(f).isNull(), f".{f} must be an array").each_of(f, allowed, " is invalid")
    r.custom(F.col("skip_logic_protected").isNull(), ".skip_logic_protected must be boolean")
    r.custom(F.col("needs_human_review").isNull(), ".needs_human_review must be boolean")
    r.unit_range(end=" must be between 0 and 1", nulls=True)
    return r.add(row_invariant_errors(r.path, token_flag))


def family_result_rules() -> Rules:
    """Rows carry ``root_family_id`` beside the nested family_id."""
    child = F.col("recommended_handling") == "retain_as_child_table"
    one_of = lambda allowed: " must be one of [" + ", ".join(f"'{v}'" for v in sorted(allowed)) + "]."
    r = Rules("family_result", many=False).required(
        "family_id", "recommended_table_name", "recommended_parent_key", "recommended_repeat_index_name", "recommended_family_role",
        "recommended_handling", "member_semantics_notes", "confidence", "reasoning", "needs_human_review")
    r.nonblank("family_id", end=" must be non-empty.")
    r.add(_when(~_blank("family_id") & ~_blank("root_family_id") & (F.col("family_id") != F.col("root_family_id")),
                "top-level family_id must equal family_result.family_id."))
    r.nonblank("recommended_table_name", "member_semantics_notes", "reasoning", end=" must be non-empty.")
    r.one_of("recommended_family_role", vocab.FAMILY_ROLES, one_of(vocab.FAMILY_ROLES))
    r.one_of("recommended_handling", vocab.FAMILY_HANDLING, one_of(vocab.FAMILY_HANDLING)).unit_range()
    for f in ("recommended_parent_key", "recommended_repeat_index_name"):
        r.custom(child & (F.col(f).isNull() | _blank(f)), f".{f} must be non-empty when recommended_handling is retain_as_child_table.")
    return r


def member_default_rules() -> Rules:
    disposition, handling, protected = (F.col(c) for c in ("missingness_disposition", "missingness_handling", "skip_logic_protected"))
    structural = F.coalesce(disposition.isin(*vocab.STRUCTURAL_DISPOSITIONS), F.lit(False))
    fields = ("recommended_logical_type", "recommended_storage_type", "transform_actions", "structural_transform_hints",
              "interpretation_hints", "missingness_disposition", "missingness_handling", "skip_logic_protected")
    py = lambda allowed: "[" + ", ".join(f"'{v}'" for v in sorted(allowed)) + "]"
    r = Rules("member_defaults", many=False).add(_when(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNull(),
                                           "member_defaults must include at least one defaultable field."))
    for f, allowed in (("recommended_logical_type", vocab.LOGICAL_TYPES), ("recommended_storage_type", vocab.STORAGE_TYPES)):
        r.one_of(f, allowed, f" must be one of {py(allowed)}.")
    for f, allowed in vocab.PATCHABLE_LISTS.items():
        r.each_of(f, allowed, f" must be one of {py(allowed)}.", " must be non-empty.")
    r.one_of("missingness_disposition", vocab.STRUCTURAL_DISPOSITIONS, f" must be one of {py(vocab.STRUCTURAL_DISPOSITIONS)}.")
    r.one_of("missingness_handling", vocab.MISSINGNESS_HANDLING, f" must be one of {py(vocab.MISSINGNESS_HANDLING)}.").unit_range()
    r.add(_when((handling.isNotNull() | protected.isNotNull()) & ~structural,
                "member_defaults.missingness_disposition is required when member_defaults.missingness_handling or "
                "member_defaults.skip_logic_protected is provided."))
    for d in vocab.STRUCTURAL_DISPOSITIONS:
        allowed = vocab.HANDLING_FOR_DISPOSITION[d]
        r.add(_when((disposition == d) & handling.isin(*vocab.MISSINGNESS_HANDLING) & ~handling.isin(*allowed),
                    f"member_defaults.missingness_handling must be one of {py(allowed)} when member_defaults.missingness_disposition is {d}."))
    r.add(_when((handling == "protect_from_null_penalty") & ~F.coalesce(protected, F.lit(False)),
                "member_defaults.skip_logic_protected must be true when member_defaults.missingness_handling is protect_from_null_penalty."))
    return r.add(_when(protected & ~structural,
                       "member_defaults.skip_logic_protected can only be true when member_defaults.missingness_disposition is "
                       "structurally_valid_missingness or partially_structural_missingness."))


def grain_rules() -> Rules:
    r = Rules("recommended_primary_grain", many=False)
    for f in ("description", "justification"):
        r.custom(F.col(f).isNull(), f".{f} must be a string").custom(F.col(f).isNull() | _blank(f), f".{f} must be a non-empty string")
    r.add(_when(F.col("grain_type").isNull() | ~F.col("grain_type").isin(*vocab.GRAIN_TYPES),
                "Invalid recommended_primary_grain.grain_type: ", F.coalesce("grain_type", F.lit("None"))))
    r.custom(F.col("keys").isNull(), ".keys must be an array").custom(F.size("keys") == 0, ".keys must be a non-empty array")
    r.custom(F.col("confidence_score").isNull(), ".confidence_score must be numeric")
    r.unit_range("confidence_score", " must be between 0 and 1", nulls=True)
    return r.custom((F.col("grain_type") == "no_clear_key") & (F.size("keys") == 0), ".keys must still be non-empty for no_clear_key")


def scale_rules() -> Rules:
    r = Rules("mappings").required(
        "target_kind", "target_id", "mapping_status", "response_scale_kind", "ordered_labels", "label_to_ordinal_position",
        "label_to_numeric_score", "numeric_score_semantics_confirmed", "source", "notes", "confidence")
    r.nonblank("target_kind").one_of("target_kind", vocab.SCALE_TARGET_KINDS).nonblank("target_id", "mapping_status")
    r.one_of("mapping_status", vocab.SCALE_STATUSES)
    labels = F.transform("ordered_labels", lambda x, j: F.struct(x.alias("x"), j.alias("j")))
    r.add(F.transform(F.filter(F.coalesce(labels, F.array()), lambda t: cells.trimmed(t["x"]) == ""), lambda t: F.concat(
        r.path, F.lit(".ordered_labels["), t["j"].cast("string"), F.lit("] must not be blank."))))
    for f in ("label_to_ordinal_position", "label_to_numeric_score"):
        r.custom(F.exists(F.map_keys(f), lambda k: cells.trimmed(k) == ""), f".{f} key must not be blank.")
        r.add(F.transform(F.filter(F.map_entries(f), lambda e: e["value"].isNull()), lambda e: F.concat(
            r.path, F.lit(f".{f}["), e["key"], F.lit("] must be numeric."))))
    return r.unit_range()


def semantic_rules() -> Rules:
    r = Rules("important_variables").required("column_or_family", "kind", "meaning", "downstream_importance", "confidence")
    r.nonblank("column_or_family", "kind").one_of("kind", vocab.SEMANTIC_KINDS)
    return r.nonblank("meaning", "downstream_importance").unit_range()


def codebook_rules() -> Rules:
    fields = ("column", "codes_or_labels_note", "meaning")
    return Rules("codebook_hints").required(*fields, "confidence").nonblank(*fields).unit_range()


def skip_sentinel(df: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Errors of documents that say ``status = skipped``: the reason must be a known one."""
    reason = F.col("reason")
    message = (F.when(reason.isNull(), "reason must be a string.").when(cells.trimmed(reason) == "", "reason must not be blank.")
               .when(~reason.isin(*reasons), f"reason must be one of: {_listed(reasons)}"))
    out = df.filter(F.col("status") == "skipped").select("run_id", message.alias("message"))
    return out.filter(F.col("message").isNotNull())


_PATCH_FIELDS = ("change_id", "column", "field", "after_value", "reasoning", "justification", "confidence", "needs_human_review")


def patch_rules() -> Rules:
    """Entry rules; rows also carry ``known_column`` from a join with the contract."""
    field, raw = F.col("field"), F.col("after_value")
    kind = F.schema_of_variant(F.try_parse_json(raw))
    at = ".after_value"
    r = Rules("change_set")
    r.required(*_PATCH_FIELDS).nonblank("change_id", "column", "field", "reasoning", "justification").unit_range()
    named = ~_blank("column") & ~_blank("field")
    ok_field = field.isin(*vocab.PATCHABLE_FIELDS)
    r.custom(named & ~ok_field, ".field points to a forbidden field: ", field)
    r.custom(named & ok_field & ~F.col("known_column"), ".column does not exist in canon_contract_json: ", F.col("column"))
    live = named & ok_field & F.col("known_column")
    text = F.try_variant_get(F.try_parse_json(raw), "$", "string")
    for f, allowed in vocab.PATCHABLE_STRING_ENUMS.items():
        here = live & (field == f)
        r.custom(here & ~kind.eqNullSafe("STRING"), f"{at} must be a string.")
        r.custom(here & (kind == "STRING") & (cells.trimmed(text) == ""), f"{at} must not be blank.")
        r.custom(here & (kind == "STRING") & (cells.trimmed(text) != "") & ~text.isin(*allowed), f"{at} is invalid.")
    r.custom(live & field.isin(*vocab.PATCHABLE_STRINGS) & ~kind.eqNullSafe("STRING"), f"{at} must be a string.")
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<string>")
    for f, allowed in vocab.PATCHABLE_LISTS.items():
        here = live & (field == f)
        r.custom(here & ~F.coalesce(kind.startswith("ARRAY"), F.lit(False)), f"{at} must be an array.")
        tagged = F.transform(F.coalesce(items, _none()), lambda x, j: F.struct(x.alias("x"), j.alias("j")))
        bad = F.filter(tagged, lambda t: F.coalesce(~t["x"].isin(*allowed), F.lit(True)))
        r.add(F.when(F.coalesce(here, F.lit(False)), F.transform(bad, lambda t: F.concat(
            r.path, F.lit(f"{at}["), t["j"].cast("string"), F.lit("] is invalid.")))).otherwise(_none()))
    r.custom(live & field.isin(*vocab.PATCHABLE_BOOLEANS) & ~kind.eqNullSafe("BOOLEAN"), f"{at} must be a boolean.")
    number = cells.json_number(raw)
    r.custom(live & field.isin(*vocab.PATCHABLE_NUMBERS) & number.isNull(), f"{at} must be numeric.")
    return r.custom(live & field.isin(*vocab.PATCHABLE_NUMBERS) & ~number.between(0, 1), f"{at} must be between 0 and 1.")


# ---------------------------------------------------------------- set-level rules


def duplicates(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One message per key used more than once in a run; counting combines before the shuffle."""
    given = F.lit(True)
    for k in keys:
        given = given & F.coalesce(cells.trimmed(F.col(k)) != "", F.lit(False))
    used = df.filter(given).groupBy("run_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    return used.filter("n > 1").select("run_id", F.concat(F.lit(label), F.concat_ws(".", *keys)).alias("message"))


def coverage(seen: DataFrame, expected: DataFrame, missing: str, unexpected: str | None) -> DataFrame:
    """Columns a run should have and lacks, and the other way round, one message each."""
    key = ["run_id", "column"]
    names = F.array_join(F.array_sort(F.collect_set("column")), ", ")
    out = expected.select(*key).join(seen.select(*key), key, "left_anti").groupBy("run_id").agg(
        F.concat(F.lit(missing), names).alias("message"))
    if unexpected is not None:
        out = out.unionByName(seen.select(*key).join(expected.select(*key), key, "left_anti").groupBy("run_id").agg(
            F.concat(F.lit(unexpected), names).alias("message")))
    return out


def unexpected_keys(df: DataFrame, raw: str, allowed: Sequence[str], path: Column) -> DataFrame:
    """Keys of a JSON object that the schema does not know."""
    extra = F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(a) for a in allowed])))
    return df.select("run_id", "position", extra.alias("extra"), path.alias("path")).filter(F.size("extra") > 0).select(
        "run_id", "position", F.concat("path", F.lit(" has unexpected key(s): "), F.array_join("extra", ", ")).alias("message"))


def document_errors(df: DataFrame, raw: str, field: str) -> DataFrame:
    """Documents that are not a JSON object at all."""
    out = df.select("run_id", cells.json_error(F.col(raw), field).alias("message"))
    return out.filter(F.col("message").isNotNull())


def fill_defaults(df: DataFrame, defaults: dict[str, str], array: str) -> tuple[DataFrame, DataFrame]:
    """Null fields take their default (given as JSON text); returns the rows and the log of fills."""
    path = F.format_string(f"{array}[%d]", F.col("position"))
    log = F.array_compact(F.array(*[
        F.when(F.col(f).isNull(), F.struct(F.concat(path, F.lit(f".{f}")).alias("path"), F.lit(v).alias("defaulted_to")))
        for f, v in defaults.items()
    ]))
    entries = df.select("run_id", F.explode(log).alias("entry")).select("run_id", "entry.*")
    value = lambda f, v: F.array().cast(_TEXTS) if v == "[]" else F.lit(v.strip('"'))
    return df.withColumns({f: F.coalesce(F.col(f), value(f, v)) for f, v in defaults.items()}), entries


def gate(errors: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of runs that passed an earlier stage."""
    return df.join(errors.select("run_id").distinct(), "run_id", "left_anti")


def report(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Verdict per run: ok flag, first message and number of distinct messages.

    ``errors`` carries ``place``, the order in which the checks ran.
    """
    distinct = errors.groupBy("run_id", "message").agg(F.min("place").alias("place"))
    worst = distinct.groupBy("run_id").agg(
        F.min(F.struct("place", "message")).alias("first"), F.count(F.lit(1)).alias("n_errors"))
    return runs.select("run_id").distinct().join(worst, "run_id", "left").select(
        "run_id", F.col("first").isNull().alias("validation_ok"),
        F.coalesce("first.message", F.lit("")).alias("validation_error"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"))
