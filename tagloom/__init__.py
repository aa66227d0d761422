"""Wide entity profiles from declarative specifications, computed as Spark DataFrames."""

from .operators.formula import prepared_formula
from .operators.methods import GroupedMethod, method, register_grouped
from .plans.delta import DeltaStore, compute_delta
from .plans.model import RunReport, run_model, run_tag
from .plans.metadata import load_model, load_tag
from .plans.store import PathStore, TableStore
from .plans.tag import TagResult, compute_tag, require_all
from .sources import Catalog, JdbcPartitioning, Single, SplitBy
from .spec import Item, Model, Param, PostProcess, SpecError, Staging, Tag
from .streaming.runlog import RunLog

__all__ = [
    "Catalog",
    "DeltaStore",
    "GroupedMethod",
    "Item",
    "JdbcPartitioning",
    "Model",
    "Param",
    "PathStore",
    "PostProcess",
    "RunLog",
    "RunReport",
    "Single",
    "SpecError",
    "SplitBy",
    "Staging",
    "TableStore",
    "Tag",
    "TagResult",
    "compute_delta",
    "compute_tag",
    "load_model",
    "load_tag",
    "method",
    "prepared_formula",
    "register_grouped",
    "require_all",
    "run_model",
    "run_tag",
]
