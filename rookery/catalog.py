"""All queries of the library: importing this module imports every module that registers some."""

from . import operators, sources, streaming  # noqa: F401
from .functions import queries as _functions  # noqa: F401
from .plans import chunking, evaluation, keywords, models, recruiting, retrieval  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
