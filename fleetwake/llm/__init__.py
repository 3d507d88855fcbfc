"""Operations on the free texts of deployment records, for building training data from them.

A deployment record is one row of ``sources.tables.load_deployments``: ``platform_id``,
``provenance`` (where the record comes from) and ``note`` (free text). A review is one row of the
review log: ``platform_id``, ``decision`` (``keep`` / ``reject``). Every operator takes the column
names as parameters with these defaults, reads only the columns that it names and ignores others.
Nothing else in the library imports this subpackage.
"""
