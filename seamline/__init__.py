"""Service contracts from source code, and questions over them, on Spark."""

from seamline.operators.drift import contract_drift
from seamline.operators.impact import (
    discover_services,
    endpoint_counts,
    endpoint_impact,
    no_orphans,
    orphan_check,
    orphan_topics,
    status,
    subscriptions_without_handler,
    topic_counts,
    topic_impact,
    unindexed_services,
)
from seamline.operators.resolve import resolve_routes
from seamline.operators.validate import contract_validity, contract_violations
from seamline.plans.extract import extract, extract_backend, extract_frontend, extraction_summary
from seamline.sources.contracts import (
    discover_repositories,
    document_parts,
    documents_to_facts,
    drop_old_versions,
    load_contracts,
    load_documents,
    load_one,
    read_documents,
    save_contracts,
    show_contract,
    with_positions,
    write_documents,
)
from seamline.sources.files import read_source_files

__all__ = [
    "contract_drift", "contract_validity", "contract_violations", "discover_repositories",
    "discover_services", "documents_to_facts", "endpoint_counts", "endpoint_impact", "extract",
    "extract_backend", "extract_frontend", "extraction_summary", "load_contracts", "load_documents",
    "load_one",
    "no_orphans", "orphan_check", "orphan_topics", "read_documents", "read_source_files", "resolve_routes",
    "save_contracts", "show_contract", "status", "subscriptions_without_handler", "topic_counts",
    "topic_impact", "unindexed_services", "with_positions", "write_documents", "document_parts",
    "drop_old_versions",
]
