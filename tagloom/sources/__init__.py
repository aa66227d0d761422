"""Where rows come from: table catalogs, parameterised SQL, staging queries."""

from .catalog import Catalog
from .jdbc import JdbcPartitioning, JdbcSource, Single, SplitBy, jdbc_options
from .shared import shared_folder, written
from .sqltext import sql_arguments
from .staging import StagingViews

__all__ = [
    "Catalog",
    "JdbcPartitioning",
    "JdbcSource",
    "Single",
    "SplitBy",
    "StagingViews",
    "jdbc_options",
    "shared_folder",
    "sql_arguments",
    "written",
]
