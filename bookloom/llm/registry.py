"""Names of the training-data queries and their SQL."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

#: query -> module; of each problem the found query, or the first one, is the one checked.
QUERIES = {
    "p1_found": "split",
    "p1_pieces": "split",
    "p1_audit": "split",
    "p2_found": "subjects",
    "p2_shares": "subjects",
    "p3_found": "lookalikes",
    "p3_forms": "lookalikes",
    "p3_groups": "lookalikes",
    "p4_found": "encodings",
    "p4_restored": "encodings",
    "p5_found": "scans",
    "p5_paragraphs": "scans",
    "p6_found": "sentences",
    "p6_sentences": "sentences",
    "p6_complete": "sentences",
    "p7_ids": "tokenize",
    "p7_counts": "tokenize",
    "p8_mix": "mixing",
    "p8_shares": "mixing",
    "p9_found": "spam",
    "p9_lines": "spam",
}


def queries():
    return {name: getattr(import_module(f"bookloom.llm.{module}"), name) for name, module in QUERIES.items() if find_spec(f"bookloom.llm.{module}")}


def oracles():
    from bookloom.llm import sentences, split

    return {"p1_found": split.P1_FOUND_SQL, "p1_audit": split.P1_AUDIT_SQL, "p6_complete": sentences.P6_COMPLETE_SQL}
