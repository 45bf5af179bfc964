"""Sources: definition corpora, fragments and versioned snapshots."""

from reconcile.sources.buckets import Conflict, create_buckets, latest_manifest, read_buckets
from reconcile.sources.corpus import parse_corpus, read_corpus, with_unreadable, write_corpus
from reconcile.sources.fragments import assemble
from reconcile.sources.layouts import read_by_day, write_bucketed, write_by_day
from reconcile.sources.versions import latest_version, read_version, write_version

__all__ = [
    "Conflict", "assemble", "create_buckets", "latest_manifest", "latest_version", "parse_corpus", "read_buckets", "read_by_day", "read_corpus",
    "read_version", "with_unreadable", "write_bucketed", "write_by_day", "write_corpus", "write_version",
]
