"""Audits as Markdown and HTML pages; each is one collected row."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUADRANTS = {
    "full_correct": "Accepted, and the process is valid", "ac_but_invalid": "Accepted, though the process is not valid",
    "implementation_error": "Not accepted: the steps hold, the code does not", "reasoning_error": "Not accepted: a step is wrong",
}
COLOURS = {"full_correct": "#166534", "ac_but_invalid": "#92400e"}


def audit_markdown(row: Mapping) -> str:
    """``row``: candidate, exec_status, passed, total, failed_index, process_valid, first_error_step, error_type, confidence, quadrant, evidence, rounds, steps, code, language."""
    get = lambda k, other="-": other if row.get(k) is None else row[k]
    out = [f"# Audit of {get('candidate')}", "", f"**{QUADRANTS.get(row.get('quadrant'), 'Not run')}**", "", "## Execution", ""]
    out.append(f"- {get('exec_status', 'not run')}, {get('passed')} of {get('total')} cases" + (f", first failure at #{row['failed_index']}" if row.get("failed_index") is not None else ""))
    out += ["", "## Process", "", f"- {'valid' if row.get('process_valid') else 'not valid'}, confidence {get('confidence', 0.0):.2f}"]
    if not row.get("process_valid"):
        out.append(f"- first wrong step {get('first_error_step')}, {get('error_type')}")
    out += [f"- {e}" for e in row.get("evidence") or []]
    if row.get("rounds"):
        out.append(f"- mended in {row['rounds']} rounds")
    if row.get("steps"):
        out += ["", "## Solution", ""]
        for step, text in sorted(row["steps"].items()):
            out += [f"### {step}", "", (text or "").strip() or "(empty)", ""]
        out += [f"```{get('language', '')}", (row.get("code") or "").rstrip(), "```"]
    return "\n".join([*out, ""])


def audit_html(row: Mapping) -> str:
    """The same as a page of its own, without anything from elsewhere."""
    title = html.escape(f"Audit of {row.get('candidate')}")
    colour = COLOURS.get(row.get("quadrant"), "#991b1b")
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>body{{font-family:sans-serif;max-width:60em;margin:2em auto}}pre{{white-space:pre-wrap}}b{{color:{colour}}}</style></head>'
        f"<body><h1>{title}</h1><p><b>{html.escape(QUADRANTS.get(row.get('quadrant'), 'Not run'))}</b></p><pre>{html.escape(audit_markdown(row))}</pre></body></html>"
    )


def pages(rows: DataFrame, name: Column, as_html: bool = False) -> DataFrame:
    """(name, text): the page of each row, as ``stores.write_files`` takes them."""

    def run(batches):
        for batch in batches:
            given = map(json.loads, batch.column("row").to_pylist())
            texts = [(audit_html if as_html else audit_markdown)(g) for g in given]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(texts, pa.string())], names=["name", "text"])

    return rows.select(name.alias("name"), F.to_json(F.struct(*rows.columns)).alias("row")).mapInArrow(run, "name string, text string")
