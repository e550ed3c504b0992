"""Validating whole JSON documents of many runs, one verdict per run.

A document is parsed once. Its arrays are exploded into one stream of items tagged with the section
they came from, and each item meets the rules of its section, so checking a fleet of documents is a
single pass plus small aggregations for duplicates, coverage and the verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight import vocab
from tablesight.functions import cells
from tablesight.operators import rules as r
from tablesight.operators.rules import Rules
from tablesight.plans.shared import cut

_SQL = {"s": "string", "t": "string", "l": "array<string>", "L": "array<string>", "n": "double", "b": "boolean",
        "i": "bigint", "m": "map<string,double>"}
_KIND = {"s": "STRING", "t": "STRING", "l": "ARRAY", "L": "ARRAY", "n": "NUMBER", "b": "BOOLEAN", "i": "NUMBER", "m": "OBJECT"}
_WORD = {"s": "a string", "t": "a string", "l": "an array", "L": "an array", "n": "numeric", "b": "boolean",
         "i": "an integer", "m": "an object"}


@dataclass(frozen=True)
class Section:
    """One array (or single object) of a document.

    ``fields`` maps a field to its kind: s text, t text that may be blank, l list, L list of non-blank
    texts, n number, i integer, b boolean, m map of numbers. ``at`` gives the JSON path of a field
    that is nested. Optional fields are not missed when absent.
    """

    path: str
    fields: dict[str, str]
    rules: Callable[[], Rules] | None = None
    many: bool = True
    defaults: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()
    at: dict[str, str] = field(default_factory=dict)
    unique: tuple[str, str] | None = None
    bool_word: str = "boolean"
    shape: bool = True
    required: bool = True
    min_items: int = 0
    absent: str | None = None


@dataclass(frozen=True)
class Worker:
    """What a valid document of one worker looks like."""

    worker: str | None
    top: tuple[str, ...]
    sections: tuple[Section, ...]
    defaults: tuple[tuple[str, str], ...] = ()
    summary: str = "summary"
    summary_lists: tuple[str, ...] = ()
    closed: bool = False
    skip_reasons: tuple[str, ...] = ()
    coverage: tuple[str, str, str | None] | None = None
    end: str = "."


def _notes(path: str, *keys: str) -> Section:
    return Section(path, dict.fromkeys(keys, "s"), lambda: Rules(path).nonblank(*keys), required=False)


_ASSUME = _notes("assumptions", "assumption", "explanation")
_FLAGS, _COLUMN_FLAGS = _notes("review_flags", "item", "issue", "why"), _notes("review_flags", "column", "issue", "why")
_LISTS = {"transform_actions": "l", "structural_transform_hints": "l", "interpretation_hints": "l"}
_EMPTY = dict.fromkeys(_LISTS, "[]")


def _grain_item(path: str, enums: dict[str, Sequence[str]], lists: Sequence[str], texts: Sequence[str], many: bool = True,
                flags: Sequence[str] = (), literals: dict[str, str] | None = None) -> Callable[[], Rules]:
    """Rules in the grain document's own wording."""
    def build() -> Rules:
        out = Rules(path, many)
        for f, value in (literals or {}).items():
            out.custom(~F.col(f).eqNullSafe(value), f".{f} must be '{value}'")
        for f in flags:
            out.custom(F.col(f).isNull(), f".{f} must be a boolean")
        for f in texts:
            out.custom(F.col(f).isNull() | (cells.trimmed(F.col(f)) == ""), f".{f} must be a non-empty string")
        for f in lists:
            out.custom(F.size(f) == 0, f".{f} must be a non-empty array")
        for f, allowed in enums.items():
            out.add(F.when(F.col(f).isNull() | ~F.col(f).isin(*allowed), F.array(F.concat(
                F.lit("Invalid "), out.path, F.lit(f".{f}: "), F.coalesce(f, F.lit("None"))))).otherwise(F.array().cast("array<string>")))
        return out
    return build


def _texts(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "s")


# Worker names, required keys, defaults and message texts below must equal the published
# document rules for verdicts to agree.
WORKERS: dict[str, Worker] = {
    "type_transform_worker": Worker(
        "type_value_specialist", ("worker", "summary", "column_decisions", "global_transform_rules", "review_flags", "assumptions"), (
            Section("column_decisions", {
                **_texts("column", "recommended_logical_type", "recommended_storage_type"), **_LISTS,
                **_texts("normalization_notes", "reasoning"), "confidence": "n", "skip_logic_protected": "b", "needs_human_review": "b"},
                r.type_rules, defaults=_EMPTY, unique=("column", "Duplicate column_decisions entry for column: "), bool_word="a boolean"),
            _notes("global_transform_rules", "rule_name", "applies_when", "rule_description"), _COLUMN_FLAGS, _ASSUME),
        (("global_transform_rules", "[]"), ("review_flags", "[]"), ("assumptions", "[]")), summary_lists=("key_patterns",),
        coverage=("column_decisions", "column_decisions is missing reviewed columns: ", "column_decisions contains unexpected columns: ")),
    "missingness_worker": Worker(
        "missingness_structural_validity_specialist",
        ("worker", "summary", "column_decisions", "global_contract", "global_findings", "review_flags", "assumptions"), (
            Section("column_decisions", {
                **_texts("column", "missingness_disposition", "structural_validity", "recommended_handling"), "trigger_columns": "L",
                **_texts("normalization_notes", "reasoning"), "confidence": "n", "skip_logic_protected": "b", "needs_human_review": "b"},
                r.missingness_rules, defaults={"trigger_columns": "[]"}, unique=("column", "Duplicate column_decisions entry for column: ")),
            Section("global_contract", {"token_missing_placeholders_detected": "b", "notes": "t"}, many=False, defaults={"notes": '""'}),
            _notes("global_findings", "finding", "impact"), _COLUMN_FLAGS, _ASSUME),
        (("global_findings", "[]"), ("review_flags", "[]"), ("assumptions", "[]")), summary_lists=("key_patterns",)),
    "table_layout_worker": Worker(
        "table_layout_specialist",
        ("worker", "summary", "table_suggestions", "column_table_assignments", "global_layout_findings", "review_flags", "assumptions"), (
            Section("table_suggestions", {
                "table_name": "s", "kind": "s", "source_basis_kind": "s", "parent_table_name": "t", "parent_key": "L", "grain_columns": "L",
                "repeat_index_name": "t", "build_strategy": "s", "excluded_columns": "L", "confidence": "n", "reasoning": "s",
                "needs_human_review": "b", "source_family_id": "t", "included_column_count": "i", "included_columns_preview": "L",
                "included_columns": "L"}, r.layout_table_rules, at={"source_basis_kind": "$.source_basis.kind"},
                defaults={"parent_table_name": '""', "parent_key": "[]", "repeat_index_name": '""', "excluded_columns": "[]",
                          "included_columns": "[]", "included_columns_preview": "[]"},
                optional=("source_family_id", "included_column_count"), unique=("table_name", "Duplicate table_name: "), min_items=1),
            Section("column_table_assignments", {
                "column": "s", "assigned_table": "t", "assignment_role": "s", "source_family_id": "t", "why": "s"}, r.assignment_rules,
                defaults={"source_family_id": '""'}, unique=("column", "Duplicate column_table_assignments entry for column: "), min_items=1),
            _notes("global_layout_findings", "finding", "impact"), _FLAGS, _ASSUME),
        (("global_layout_findings", "[]"), ("review_flags", "[]"), ("assumptions", "[]")), summary_lists=("key_layout_principles",),
        coverage=("column_table_assignments", "column_table_assignments is missing source columns: ",
                  "column_table_assignments contains unexpected source columns: ")),
    "analysis_layout_worker": Worker(
        "analysis_layout_specialist", ("worker", "summary", "analysis_table_suggestions", "derivations", "review_flags", "assumptions"), (
            Section("analysis_table_suggestions", {
                "table_name": "s", "kind": "s", "source_canonical_tables": "L", "included_family_ids": "L", "grain_columns": "L",
                "build_strategy": "s", "wave_column": "t", "value_columns": "L", "confidence": "n", "reasoning": "s", "needs_human_review": "b"},
                r.analysis_table_rules, defaults={"included_family_ids": "[]", "wave_column": '""'},
                unique=("table_name", "Duplicate analysis table_name: ")),
            Section("derivations", {
                "derivation_name": "s", "derivation_kind": "s", "source_tables": "L", "output_table_name": "s", "join_keys": "L",
                "grouping_keys": "L", "null_handling_policy": "s", "reasoning": "s"}, r.derivation_rules,
                defaults={"join_keys": "[]", "grouping_keys": "[]"}, unique=("output_table_name", "Duplicate derivations.output_table_name: ")),
            _FLAGS, _ASSUME),
        (("derivations", "[]"), ("review_flags", "[]"), ("assumptions", "[]")), summary_lists=("analysis_layout_principles",)),
    "family_worker": Worker(
        "family_specialist", ("worker", "family_id", "family_result", "review_flags", "assumptions"), (
            Section("family_result", {
                **_texts("family_id", "recommended_table_name"), "recommended_parent_key": "t", "recommended_repeat_index_name": "t",
                **_texts("recommended_family_role", "recommended_handling", "member_semantics_notes", "reasoning"), "confidence": "n",
                "needs_human_review": "b"}, r.family_result_rules, many=False),
            Section("member_defaults", {
                "recommended_logical_type": "s", "recommended_storage_type": "s", **_LISTS, "missingness_disposition": "s",
                "missingness_handling": "s", "skip_logic_protected": "b", "normalization_notes": "t", "confidence": "n", "needs_human_review": "b"},
                r.member_default_rules, many=False, required=False, defaults=_EMPTY, optional=(
                    "recommended_logical_type", "recommended_storage_type", "missingness_disposition", "missingness_handling",
                    "skip_logic_protected", "normalization_notes", "confidence", "needs_human_review")),
            _FLAGS, _ASSUME),
        (("review_flags", "[]"), ("assumptions", "[]")), summary=""),
    "grain_worker": Worker(
        None, ("recommended_primary_grain", "candidate_reference_tables", "preliminary_table_plan", "family_review_candidates",
               "review_questions", "user_inputs_requested", "diagnostics", "reasoning", "assumptions"), (
            Section("recommended_primary_grain", {
                "description": "t", "grain_type": "t", "keys": "l", "confidence_score": "n", "justification": "t"}, r.grain_rules, many=False, shape=False),
            Section("candidate_reference_tables", {
                "keys": "l", "reference_kind": "t", "relationship_to_primary": "t", **dict.fromkeys(
                    ("entity_description", "suggested_table_name", "why_not_base_attribute", "justification"), "t")},
                _grain_item("candidate_reference_tables", {"reference_kind": vocab.REFERENCE_KINDS, "relationship_to_primary": vocab.RELATIONSHIPS},
                            ("keys",), ("entity_description", "suggested_table_name", "why_not_base_attribute", "justification")), shape=False),
            Section("preliminary_table_plan", {"table_name": "t", "status": "t", "grain": "l", "table_description": "t", "justification": "t"},
                    _grain_item("preliminary_table_plan", {"status": vocab.TABLE_PLAN_STATUSES}, ("grain",),
                                ("table_name", "table_description", "justification")), shape=False),
            Section("family_review_candidates", dict.fromkeys(("family_id", "suggested_table_name", "repeat_index_name", "status", "why_review"), "t"),
                    _grain_item("family_review_candidates", {"status": vocab.FAMILY_REVIEW_STATUSES}, (),
                                ("family_id", "suggested_table_name", "repeat_index_name", "why_review")), shape=False),
            *[Section(f"review_questions.{q}", dict.fromkeys(("prompt", "recommended_answer", "why_it_matters", "answer_type"), "t"),
                      _grain_item(f"review_questions.{q}", {"answer_type": vocab.ANSWER_TYPES}, (), ("prompt", "recommended_answer", "why_it_matters"),
                                  many=False), many=False, shape=False, absent="Missing required review question: ")
              for q in ("grain_confirmation", "family_confirmation", "index_drop_confirmation")],
            *[Section(f"user_inputs_requested.{u}", {"input_type": "t", "required": "b", "purpose": "t"},
                      _grain_item(f"user_inputs_requested.{u}", {}, (), ("purpose",), many=False, flags=("required",),
                                  literals={"input_type": "free_text"}), many=False, shape=False,
                      absent="Missing required user input descriptor: ")
              for u in ("global_renaming_instructions", "missed_family_information", "free_text_override_instructions")],
            Section("diagnostics", dict.fromkeys(("encoding_hint", "encoding_justification", "recommended_next_action"), "t"),
                    _grain_item("diagnostics", {"encoding_hint": vocab.ENCODING_HINTS}, (), ("encoding_justification", "recommended_next_action"),
                                many=False), many=False, shape=False),
            Section("diagnostics.rejected_primary_candidates", {"keys": "l", "reason": "t"},
                    _grain_item("diagnostics.rejected_primary_candidates", {}, ("keys",), ("reason",)), shape=False),
            Section("assumptions", {"assumption": "t", "explanation": "t", "needs_user_validation": "b"},
                    _grain_item("assumptions", {}, (), ("assumption", "explanation"), flags=("needs_user_validation",)), shape=False)),
        (("candidate_reference_tables", "[]"), ("preliminary_table_plan", "[]"), ("family_review_candidates", "[]"), ("assumptions", "[]")),
        summary="", closed=True, end=""),
    "scale_mapping_worker": Worker(
        "scale_mapping_extractor", ("worker", "summary", "mappings", "review_flags", "assumptions"), (
            Section("mappings", {
                **_texts("target_kind", "target_id", "mapping_status"), "response_scale_kind": "t", "ordered_labels": "l",
                "label_to_ordinal_position": "m", "label_to_numeric_score": "m", "numeric_score_semantics_confirmed": "b", "source": "t",
                "notes": "t", "confidence": "n"}, r.scale_rules), _FLAGS, _ASSUME),
        (("review_flags", "[]"), ("assumptions", "[]")), summary_lists=("key_points",), skip_reasons=vocab.SCALE_SKIP_REASONS),
    "semantic_context_worker": Worker(
        "semantic_context_interpreter",
        ("worker", "summary", "dataset_context", "important_variables", "codebook_hints", "review_flags", "assumptions"), (
            Section("dataset_context", {"dataset_purpose": "t", "row_meaning_notes": "t", "collection_change_notes": "L",
                                        "known_optional_or_conditioned_sections": "L"}, many=False,
                    defaults={"collection_change_notes": "[]", "known_optional_or_conditioned_sections": "[]"}),
            Section("important_variables", {**_texts("column_or_family", "kind", "meaning", "downstream_importance"), "confidence": "n"}, r.semantic_rules),
            Section("codebook_hints", {**_texts("column", "codes_or_labels_note", "meaning"), "confidence": "n"}, r.codebook_rules),
            _FLAGS, _ASSUME),
        (("codebook_hints", "[]"), ("review_flags", "[]"), ("assumptions", "[]")), summary_lists=("key_points",),
        skip_reasons=vocab.SEMANTIC_SKIP_REASONS),
    "canonical_contract": Worker(
        "canonical_column_contract_builder", ("worker", "summary", "column_contracts", "global_value_rules", "review_flags", "assumptions"), (
            Section("column_contracts", {
                **dict.fromkeys(("column", "canonical_modeling_status", "canonical_table_name", "canonical_assignment_role", "source_family_id",
                                 "a9_primary_role", "recommended_logical_type", "recommended_storage_type", "missingness_disposition",
                                 "missingness_handling", "type_decision_source", "structure_decision_source", "missingness_decision_source",
                                 "semantic_decision_source", "semantic_meaning", "codebook_note", "normalization_notes"), "t"),
                **_LISTS, "applied_sources": "l", "skip_logic_protected": "b", "confidence": "n", "needs_human_review": "b"},
                r.contract_rules, shape=False, unique=("column", "Duplicate column_contracts entry for column: "), defaults={
                    "source_family_id": '""', "a9_primary_role": '""', **_EMPTY, "semantic_meaning": '""', "codebook_note": '""',
                    "normalization_notes": '""', "applied_sources": "[]"}),),
        (("global_value_rules", "[]"), ("review_flags", "[]"), ("assumptions", "[]")), summary_lists=(), end="",
        coverage=("column_contracts", "column_contracts is missing A2 source columns: ", None)),
}


def _none() -> Column:
    return F.array().cast("array<string>")


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, NUMBER, ARRAY, OBJECT, VOID or another type's name; null for null.

    A schema is made of plain values alone, since that of an array or object reads all that it holds. The lambdas name
    a value once, so that it is read once.
    """
    return _once(v, lambda x: F.when(_get(x, "$", "array<variant>").isNotNull(), "ARRAY").when(
        _get(x, "$", "map<string,variant>").isNotNull(), "OBJECT").otherwise(_once(F.schema_of_variant(x), _named)))


def _named(schema: Column) -> Column:
    return F.when(schema.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "NUMBER").when(schema.startswith("ARRAY"), "ARRAY").when(
        schema.startswith("OBJECT"), "OBJECT").otherwise(schema)


def _once(v: Column, of: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(v), of), F.lit(0))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _say(cond: Column, *parts: Column | str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _default(kind: str, text: str) -> Column:
    return _none() if text == "[]" else F.lit(text.strip('"'))


def _places(worker: Worker) -> list[str]:
    """The JSON paths of all fields that any section reads; ``kinds`` of ``items_of`` has their types in this order."""
    return list(dict.fromkeys(s.at.get(f, f"$.{f}") for s in worker.sections for f in s.fields))


def _shape(section: Section, path: Column, places: Sequence[str]) -> Column:
    """Missing fields, wrong JSON types, and list items that are not text."""
    out, said = [], [_say(F.col("node_kind") != "OBJECT", path, " must be an object.")]
    for f, kind in section.fields.items():
        name = section.at.get(f, f"$.{f}")[2:] if f in section.at else f
        v = _get(F.col("node"), section.at.get(f, f"$.{f}"), "variant")
        found, word = F.get("kinds", F.lit(places.index(section.at.get(f, f"$.{f}")))), section.bool_word if kind == "b" else _WORD[kind]
        if f not in section.optional and f not in section.defaults:
            said.append(_say(found.isNull(), path, f".{name} is required."))
        wrong = found.isNotNull() & (found != _KIND[kind])
        if f in section.defaults or f in section.optional:
            wrong = wrong & (found != "VOID")
        said.append(_say(wrong, path, f".{name} must be {word}."))
        if kind == "L":
            out.append(F.array_compact(F.array(*said)))
            said = []
            items = F.transform(_get(v, "$", "array<variant>"), lambda x, j: F.struct(
                _kind(x).alias("k"), cells.trimmed(F.try_variant_get(x, "$", "string")).alias("x"), j.cast("string").alias("j")))
            bad = F.filter(F.coalesce(items, F.array()), lambda t: (t["k"] != "STRING") | (t["x"] == ""))
            out.append(F.transform(bad, lambda t: F.concat(path, F.lit(f".{name}["), t["j"], F.when(
                t["k"] != "STRING", "] must be a string.").otherwise("] must not be blank."))))
    return F.flatten(F.array(*out, *([F.array_compact(F.array(*said))] if said else [])))


def _document_level(worker: Worker, doc: Column, raw: Column) -> Column:
    """Top-level keys, worker name and summary."""
    filled = {k for k, _ in worker.defaults}
    have = F.json_object_keys(raw)
    top = [_say(~F.array_contains(have, k), f"Missing required top-level key: {k}") for k in worker.top if k not in filled]
    if not worker.worker:  # the grain document names all missing keys in one message
        lost = F.filter(F.array(*[F.lit(k) for k in worker.top if k not in filled]), lambda k: ~F.array_contains(have, k))
        top = [_say(F.size(lost) > 0, "Missing required top-level key(s): ", F.array_join(lost, ", "))]
    if worker.closed:
        extra = F.array_sort(F.array_except(have, F.array(*[F.lit(k) for k in worker.top])))
        top.append(_say(F.size(extra) > 0, "Unexpected top-level key(s): ", F.array_join(extra, ", ")))
        reasoning, text = _kind(_get(doc, "$.reasoning", "variant")), _get(doc, "$.reasoning", "string")
        said = F.array_contains(have, "reasoning")
        top.append(_say(said & ~reasoning.eqNullSafe("STRING"), "reasoning must be a string"))
        top.append(_say(said & (~reasoning.eqNullSafe("STRING") | (cells.trimmed(text) == "")), "reasoning must be a non-empty string"))
    if worker.worker:
        name = _get(doc, "$.worker", "variant")
        text = _get(doc, "$.worker", "string")
        there = F.array_contains(have, "worker")
        top.append(_say(there & ~_kind(name).eqNullSafe("STRING"), f"worker must be a string{worker.end}" if worker.end else f"worker must be '{worker.worker}'"))
        top.append(_say((_kind(name) == "STRING") & (text != worker.worker), f"worker must be '{worker.worker}'{worker.end}"))
    if worker.summary:
        s, overview = _get(doc, "$.summary", "variant"), _get(doc, "$.summary.overview", "variant")
        there, is_object = F.array_contains(have, "summary"), _kind(s) == "OBJECT"
        top.append(_say(there & ~F.coalesce(is_object, F.lit(False)), "summary must be an object."))
        top.append(_say(is_object & overview.isNull(), f"summary.overview is required{worker.end}"))
        top.append(_say(is_object & overview.isNotNull() & (_kind(overview) != "STRING"), "summary.overview must be a string."))
        top.append(_say(is_object & (cells.trimmed(_get(doc, "$.summary.overview", "string")) == ""), "summary.overview must not be blank."))
        for f in worker.summary_lists:
            v = _kind(_get(doc, f"$.summary.{f}", "variant"))
            top.append(_say(is_object & v.isNotNull() & ~v.isin("ARRAY", "VOID"), f"summary.{f} must be an array."))
        if worker.worker == "table_layout_specialist":
            shape = _get(doc, "$.summary.recommended_model_shape", "string")
            top.append(_say(is_object & shape.isNull(), "summary.recommended_model_shape is required."))
            top.append(_say(is_object & ~shape.isin(*vocab.MODEL_SHAPES), "summary.recommended_model_shape is invalid."))
    for section in worker.sections:
        v = _kind(_get(doc, f"$.{section.path}", "variant"))
        want = "ARRAY" if section.many else "OBJECT"
        absent_ok = F.lit("VOID") if section.path in filled else F.lit("")
        top.append(_say(v.isNotNull() & (v != want) & (v != absent_ok),
                        f"{section.path} must be {'an array' if section.many else 'an object'}{worker.end}"))
        if section.absent is not None:
            parent = _kind(_get(doc, f"$.{section.path.rsplit('.', 1)[0]}", "variant"))
            top.append(_say((parent == "OBJECT") & v.isNull(), f"{section.absent}{section.path}"))
        if section.min_items:
            top.append(_say(F.size(_get(doc, f"$.{section.path}", "array<variant>")) == 0, f"{section.path} must not be empty."))
    return F.array_compact(F.array(*top))


def _tagged(found: Column, section: int) -> Column:
    return F.transform(found, lambda x, j: F.struct(F.lit(section).alias("section"), j.alias("position"), x.alias("node")))


def parsed(docs: DataFrame, field: str) -> DataFrame:
    """``docs`` (run_id, raw) with ``doc``, the document as a variant, and ``fault``, why it is none; written once.

    Whatever is checked later reads these two, so each document is parsed here and nowhere else.
    """
    return cut(docs.select("run_id", "raw", F.try_parse_json("raw").alias("doc"), cells.json_error(F.col("raw"), field).alias("fault")))


def items_of(worker: Worker, docs: DataFrame) -> DataFrame:
    """Of ``docs`` (of ``parsed``): run_id, section, position, node (the item as a variant) kinds, and every field any section of the worker reads."""
    doc = F.col("doc")
    packs = []
    for i, s in enumerate(worker.sections):
        found = _get(doc, f"$.{s.path}", "array<variant>") if s.many else F.when(
            _kind(_get(doc, f"$.{s.path}", "variant")) == "OBJECT", F.array(_get(doc, f"$.{s.path}", "variant")))
        packs.append(_tagged(F.coalesce(found, F.array().cast("array<variant>")), i))
    live = docs.filter("fault is null")
    if worker.skip_reasons:
        live = live.filter(~(_get(doc, "$.status", "string") == "skipped") | _get(doc, "$.status", "string").isNull())
    rows = live.select("run_id", F.explode(F.flatten(F.array(*packs))).alias("p"),
                       *([_get(doc, "$.family_id", "string").alias("root_family_id")] if worker.worker == "family_specialist" else []))
    # each field's type is read once here, as text; the rules of a field name it several times
    types = F.array(*[F.schema_of_variant(_get(F.col("node"), p, "variant")) for p in _places(worker)])
    rows = rows.select("*", "p.*").drop("p").withColumns({"node_kind": _kind(F.col("node")), "kinds": F.transform(types, _named)})
    fields: dict[str, tuple[str, str, str | None]] = {}
    for s in worker.sections:
        for f, kind in s.fields.items():
            fields.setdefault(f, (s.at.get(f, f"$.{f}"), _SQL[kind], s.defaults.get(f)))
    cols = {}
    for f, (path, kind, default) in fields.items():
        value = _get(F.col("node"), path, kind)
        if default is not None:
            absent = F.coalesce(F.get("kinds", F.lit(_places(worker).index(path))), F.lit("VOID")) == "VOID"
            value = F.when(absent, _default(kind, default)).otherwise(value)
        cols[f] = value
    return rows.withColumns(cols)


def validate(name: str, docs: DataFrame, expected: DataFrame | None = None, token_flags: DataFrame | None = None) -> dict[str, DataFrame]:
    """Check every document (``run_id``, ``raw``). Returns ``report``, ``errors`` and ``defaults_log``.

    ``expected`` (run_id, column) turns on the coverage check; ``token_flags`` (run_id,
    token_missing_placeholders_detected) the dataset-wide token rule of contracts.
    """
    worker = WORKERS[name]
    raw, doc = F.col("raw"), F.col("doc")
    docs = parsed(docs, f"{name} output")
    place = lambda a, b, c: F.struct(F.lit(a).alias("stage"), F.lit(b).cast("int").alias("position") if isinstance(b, int) else b.alias("position"),
                                     F.lit(c).cast("int").alias("rule") if isinstance(c, int) else c.alias("rule"))
    broken = docs.filter("fault is not null").select("run_id", F.col("fault").alias("message"), place(0, 0, 0).alias("place"))
    live = docs.filter("fault is null")
    if worker.skip_reasons:
        skipped = live.select("run_id", _get(doc, "$.status", "string").alias("status"), _get(doc, "$.reason", "string").alias("reason"))
        broken = broken.unionByName(r.skip_sentinel(skipped, worker.skip_reasons).withColumn("place", place(0, 0, 1)))
        live = live.filter(~F.coalesce(_get(doc, "$.status", "string") == "skipped", F.lit(False)))
    top = live.select("run_id", F.posexplode(_document_level(worker, doc, raw)).alias("rule", "message")).select(
        "run_id", "message", place(1, 0, F.col("rule")).alias("place"))
    items = items_of(worker, docs)
    if worker.worker == "table_layout_specialist":
        names = items.filter("section = 0").select("run_id", F.col("table_name").alias("assigned_table"), F.lit(True).alias("known")).filter(
            "assigned_table is not null").distinct()
        items = items.join(names, ["run_id", "assigned_table"], "left").withColumn("known_table", F.coalesce("known", F.lit(False)))
    if token_flags is not None and name == "canonical_contract":
        items = items.join(token_flags, "run_id", "left")
    found = _none()
    for i, s in reversed(list(enumerate(worker.sections))):
        path = F.format_string(f"{s.path}[%d]", "position") if s.many else F.lit(s.path)
        parts = [_shape(s, path, _places(worker))] if s.shape else []
        if s.rules is not None:
            flag = F.col("token_missing_placeholders_detected") if token_flags is not None and name == "canonical_contract" else None
            own = s.rules(flag) if flag is not None else s.rules()
            messages = F.flatten(F.array(*own.items))
            # presence was judged on the JSON itself, where null and absent differ
            parts.append(F.filter(messages, lambda m: ~m.rlike(r" is required\.$")) if s.shape else messages)
        found = F.when(F.col("section") == i, F.flatten(F.array(*parts)) if parts else _none()).otherwise(found)
    rows = items.select("run_id", "section", "position", F.posexplode(found).alias("rule", "message")).select(
        "run_id", "message", F.struct((F.col("section") + 2).alias("stage"), "position", "rule").alias("place"))
    errors = broken.unionByName(top).unionByName(rows)
    for i, s in enumerate(worker.sections):
        if s.unique is not None:
            dup = r.duplicates(items.filter(F.col("section") == i), [s.unique[0]], s.unique[1])
            errors = errors.unionByName(dup.withColumn("place", place(i + 2, 1_000_000, 0)))
    if expected is not None and worker.coverage is not None:
        path, lost, extra = worker.coverage
        at = [s.path for s in worker.sections].index(path)
        seen = items.filter((F.col("section") == at) & F.col("column").isNotNull()).select("run_id", "column").distinct()
        wanted = expected.join(live.select("run_id"), "run_id", "left_semi")
        errors = errors.unionByName(r.coverage(seen, wanted, lost, extra).withColumn("place", place(at + 2, 2_000_000, 0)))
    return {"report": r.report(docs, errors), "errors": errors.select("run_id", "message").distinct(),
            "defaults_log": defaults_log(worker, live, items)}


def defaults_log(worker: Worker, live: DataFrame, items: DataFrame) -> DataFrame:
    """Every field that was filled with its default: run_id, path, defaulted_to."""
    doc = F.col("doc")
    absent = lambda v: F.coalesce(_kind(v), F.lit("VOID")) == "VOID"
    entry = lambda path, text: F.struct(path.alias("path"), F.lit(text).alias("defaulted_to"))
    top = [F.when(absent(_get(doc, f"$.{k}", "variant")), entry(F.lit(k), v)) for k, v in worker.defaults]
    if worker.summary:
        is_object = _kind(_get(doc, "$.summary", "variant")) == "OBJECT"
        top += [F.when(is_object & absent(_get(doc, f"$.summary.{f}", "variant")), entry(F.lit(f"summary.{f}"), "[]")) for f in worker.summary_lists]
    out = live.select("run_id", F.explode(F.array_compact(F.array(*top))).alias("e")).select("run_id", "e.*") if top else None
    per = []
    for i, s in enumerate(worker.sections):
        path = F.format_string(f"{s.path}[%d]", "position") if s.many else F.lit(s.path)
        here = (F.col("section") == i) & (F.col("node_kind") == "OBJECT")
        per += [F.when(here & (F.coalesce(F.get("kinds", F.lit(_places(worker).index(s.at.get(f, f"$.{f}")))), F.lit("VOID")) == "VOID"), entry(F.concat(path, F.lit(f".{f}")), v))
                for f, v in s.defaults.items()]
    if per:
        rows = items.select("run_id", F.explode(F.array_compact(F.array(*per))).alias("e")).select("run_id", "e.*")
        out = rows if out is None else out.unionByName(rows)
    return out
