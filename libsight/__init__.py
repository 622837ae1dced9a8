"""libsight: reading-activity and literature-corpus analytics on Spark DataFrames.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns.  Nothing here collects data to the driver.
"""

__version__ = "0.1.0"
