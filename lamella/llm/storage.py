"""Tables that cut lineage, kept in the folder that the cluster shares: see lamella.storage."""

from lamella.storage import materialize, new_path, release, release_table, shared_dir

__all__ = ["materialize", "new_path", "release", "release_table", "shared_dir"]
