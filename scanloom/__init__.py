"""Scan corpora of source code for security flaws with Spark."""

from scanloom.functions.text import canonical_rule_id, detect_language, extract_code, is_placeholder, redact
from scanloom.functions.syntax import register_py_fact_rows, register_py_facts
from scanloom.operators.evaluate import (
    ai_result_counts,
    ai_result_lines,
    blind_spots,
    counterparts,
    evaluate,
    sources_by_rule,
)
from scanloom.operators.content import scan_contents, scanned_by_run
from scanloom.operators.delta import hunk_headers, hunks, line_script, unified_text
from scanloom.operators.gate import by_file, files_with_findings, gate, gate_from_changes, gate_from_tables, scan_counts, summary, summary_by_language
from scanloom.operators.owners import owned
from scanloom.operators.patch import (
    apply_patches,
    bag_changes,
    candidates,
    changed_files,
    changes,
    delta_text,
    final_gate,
    finding_changes,
    finding_difference,
    first_pending,
    line_delta,
    next_pending,
    patch_explanations,
    patch_requests,
    patch_result,
    provenance,
    record_attempts,
    rescan,
    sided_findings,
    spent_files,
    suppress,
    text_pairs,
    validate_candidates,
    verify_patches,
)
from scanloom.operators.ranking import chosen_rules, estimated_frequency, frequency_sketches, importance, merged_sketches, rule_frequency, rule_priority
from scanloom.operators.report import patch_json, patch_report, progress_lines, report, report_lines, scan_json, verdict_lines
from scanloom.operators.rule_index import gram_counts, indexed_rule_findings, indexed_rule_totals
from scanloom.operators.rules import clean_rules, default_rules, failed_rules, rules_with_own, with_guidance, with_rules
from scanloom.operators.scan import (
    findings,
    in_scan_order,
    py_facts,
    rule_findings,
    scan_files,
    split_lines,
    syntax_issues,
)
from scanloom.operators.suppressions import judged
from scanloom.session import build_session
from scanloom.sources.tables import (
    from_table,
    read_ai_results,
    read_manifest,
    save_bucketed,
    write_findings,
    write_json,
)
from scanloom.sources.tree import list_tree, read_tree, stream_tree, write_tree
from scanloom.streaming.state import gate_changes, latest_counts, run_gate_changes, run_latest_counts
from scanloom.streaming.stream import gate_each_batch, new_arrivals, run_windows, scan_stream, windowed_findings

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("functions", "operators", "sources", "streaming", "plans", "session")]
