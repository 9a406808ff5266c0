"""pnlbook: trade-journal analytics as Spark DataFrame transforms.

Every public function takes and returns DataFrames (or Columns), so the
same code runs on ``local[*]`` and on a cluster; results are keyed by
``user_id`` and computed for all users at once.
"""

from pnlbook.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
