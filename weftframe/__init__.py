"""A table API on Spark DataFrames: filters, joins, pivots, statistics, search, import and export."""

import sys

import pyspark.cloudpickle as cloudpickle

from .errors import AuthenticationWarning, NoSuchIndexError, PathNotFoundError, ReadonlyIndexAccessError, SearchIndexInconsistentError, UnableToExtractAttributeNamesError
from .operators.fields import attrgetter
from .sources.read import FixedWidthReader
from .table import Table, csv_import, excel_import, json_import, tsv_import

# Functions sent to Python workers travel by value, so a worker needs no copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "AuthenticationWarning",
    "FixedWidthReader",
    "NoSuchIndexError",
    "PathNotFoundError",
    "ReadonlyIndexAccessError",
    "SearchIndexInconsistentError",
    "Table",
    "UnableToExtractAttributeNamesError",
    "attrgetter",
    "csv_import",
    "excel_import",
    "json_import",
    "tsv_import",
]
