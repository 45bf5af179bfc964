"""Everything about plans in one place: making them and reading them."""

from reconcile.plans.definitions import plan_definitions, with_definition_details
from reconcile.plans.plan import creates, deletes, last_rows, plan, repeated_keys, scoped, unreadable, updates
from reconcile.plans.results import (
    changed_names,
    containers_to_create,
    display_name,
    from_json,
    is_change,
    json_document_lines,
    marker,
    report,
    summarize,
    to_json_rows,
)

__all__ = [
    "changed_names",
    "containers_to_create",
    "creates",
    "deletes",
    "display_name",
    "from_json",
    "is_change",
    "json_document_lines",
    "last_rows",
    "marker",
    "plan",
    "plan_definitions",
    "repeated_keys",
    "report",
    "scoped",
    "summarize",
    "to_json_rows",
    "unreadable",
    "updates",
    "with_definition_details",
]
