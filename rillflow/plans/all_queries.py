"""All registered queries but those of the training-data subpackage."""

from . import systems  # noqa: F401  registers its queries
from .queries import ORACLE_SQL, QUERIES  # noqa: F401
