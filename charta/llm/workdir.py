"""Written intermediate tables in the folder that driver and executors share."""

from charta.sources.workdir import SETTING, fresh_path, shared_dir, written

__all__ = ["SETTING", "fresh_path", "shared_dir", "written"]
