"""Readers and writers of corpus tables and findings."""

from .exports import export_files, history_tables, read_history
from .findings import prefer_shards, read_findings, write_findings
from .published import Published, build_snapshots
from .revision_log import append_revisions, new_revisions, replace_articles, source_receipts
from .shards import digest_faults, export_shards, slug_collisions, shard_faults
from .stages import Stage, ledger, run_stages
from .token_lines import parse_token_lines, read_token_lines

__all__ = [
    "Published", "Stage", "append_revisions", "build_snapshots", "digest_faults", "export_files", "export_shards", "history_tables", "ledger", "new_revisions", "parse_token_lines", "prefer_shards", "read_findings",
    "read_history", "read_token_lines", "replace_articles", "run_stages", "shard_faults", "slug_collisions", "source_receipts", "write_findings",
]
