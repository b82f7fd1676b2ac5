"""The reviewers' sheet: every state, with its reasons."""

from tessera.operators import adjudication

SHEET = "row long, document string, title string, batch string, decision string, action string, original string, replacement string, confirm string, escalate string, reject string"
DOCUMENTS = "document string, title string, unlocks boolean, buckets array<string>, references array<string>"
KNOWN = [("d", "A title", True, [], ["Section 37.5 (a)"]), ("b", "Blocked", True, ["cross_context_ambiguous"], []), ("n", None, None, None, None)]
ROWS = {
    # (document, title, batch, decision, action, original, replacement, confirm, escalate, reject): (state, outcome, reasons)
    ("d", "", "k", "approve", "", "", "", "", "", ""): ("invalid_unknown_decision", "invalid_row", "invalid_reviewerDecision"),
    ("d", "", "k", "", "delete", "x", "", "", "", ""): ("invalid_unknown_action_type", "unsupported_action", "invalid_citationActionType"),
    ("d", "", "k", "", "drop_reference", "", "", "", "", ""): ("invalid_missing_required_fields", "invalid_row", "missing_reviewerDecision"),
    ("", "", "k", "no_action", "", "", "", "", "", ""): ("invalid_missing_required_fields", "invalid_row", "missing_documentId"),
    ("d", "", "k", "citation_fix", "replace_citation", "37.1", None, "", "", ""): ("invalid_missing_required_fields", "invalid_row", "missing_citationReplacement"),
    ("x", "", "k", "no_action", "", "", "", "", "", ""): ("invalid_missing_required_fields", "document_not_found", "document_not_found"),
    ("d", "a title", "k", "no_action", "", "", "", "", "", ""): ("invalid_title_mismatch", "title_mismatch", "title_mismatch"),
    ("d", "A title", "k", "", "", "", "", "", "yes", "1"): ("invalid_conflicting_flags", "conflicting_flags", "conflicting_escalate_and_doNotApprove"),
    ("d", None, "k", None, None, None, None, None, None, None): ("blank_template_row", "incomplete_row", "no_adjudication_fields_set"),
    ("d", "", "", "", "", "", "", "", "", ""): ("blank_template_row", "incomplete_row", "missing_batchKey_on_blank_template_row,no_adjudication_fields_set"),
    ("d", "", " ", "no_action", "", "", "", "", "", ""): ("invalid_missing_required_fields", "invalid_row", "missing_batchKey_on_reviewed_row"),
    ("d", "", "k", "citation_fix", "relabel_context", "a", "b", "", "", ""): ("reviewed_citation_fix_blocked", "unsupported_action", "relabel_context_not_simulated"),
    ("d", "", "k", "", "", "", "", "", "TRUE", ""): ("reviewed_escalate", "no_action", ""),
    ("d", "", "k", "do_not_approve", "", "", "", "maybe", "", ""): ("reviewed_do_not_approve", "no_action", "invalid_boolean"),
    ("d", "", "k", "no_action", "", "", "", "no", "", ""): ("reviewed_no_action", "no_action", ""),
    ("d", "", "k", "", "", "", "", "y", "", ""): ("reviewed_confirm_metadata", "metadata_confirmation_candidate", ""),
    ("b", "", "k", "confirm_metadata", "", "", "", "", "", ""): ("reviewed_confirm_metadata", "blocked_structural", "metadata_confirmation_not_safe_for_structural_block"),
    ("n", "", "k", "confirm_metadata", "", "", "", "", "", ""): ("reviewed_confirm_metadata", "blocked_structural", "metadata_confirmation_not_safe_for_structural_block"),
    ("b", "", "k", "citation_fix", "replace_citation", "37.1", "37.2", "", "", ""): ("reviewed_citation_fix_blocked", "blocked_structural", "structural_unresolved_blockers_present"),
    ("d", "", "k", "citation_fix", "replace_citation", "x", "sec. 37.5(a)", "", "", ""): ("reviewed_citation_fix_supported", "one_safe_manual_fix_candidate", ""),
    ("d", "", "k", "citation_fix", "normalize_format", "Ordinance 37.2", "37.2(r)", "", "", ""): ("reviewed_citation_fix_supported", "one_safe_manual_fix_candidate", ""),
    ("d", "", "k", "citation_fix", "replace_citation", "Ordinance 37.9", "37.9(a)", "", "", ""): ("reviewed_citation_fix_blocked", "blocked_structural", "no_safe_simulated_path"),
    ("d", "", "k", "citation_fix", "", "", "", "", "", ""): ("reviewed_citation_fix_blocked", "blocked_structural", "no_safe_simulated_path"),
    ("d", "", "k", "", "", "old", "", "", "", ""): ("invalid_missing_required_fields", "invalid_row", "citation_fields_without_action,missing_reviewerDecision"),
}


def test_states(spark):
    rows = [(k, *row) for k, row in enumerate(ROWS)]
    found = adjudication.simulated(spark.createDataFrame(rows, SHEET), spark.createDataFrame(KNOWN, DOCUMENTS), strict=True)
    got = {r.row: (r.state, r.outcome, r.reasons) for r in found.collect()}
    for k, (row, want) in enumerate(ROWS.items()):
        assert got[k] == want, row
    assert {s for s, _, _ in got.values()} == {s.state for s in adjudication.STATES}


def test_loose_flags_and_empty_sheets(spark):
    row = [(1, "d", "", "k", "no_action", "", "", "", "maybe", "", "")]
    known = spark.createDataFrame(KNOWN, DOCUMENTS)
    assert [r.reasons for r in adjudication.simulated(spark.createDataFrame(row, SHEET), known).collect()] == [""]
    assert adjudication.simulated(spark.createDataFrame([], SHEET), known).collect() == []
