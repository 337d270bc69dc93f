"""The shared folder, under the name that the sources use."""

from linewell.shared import checkpointed, fresh_path, shared_dir

__all__ = ["checkpointed", "fresh_path", "shared_dir"]
