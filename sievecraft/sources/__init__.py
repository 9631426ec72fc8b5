"""Where the business tables come from."""

from .derived import DerivedTables
from .schemas import SCHEMAS
from .tables import SchemaMismatch, Tables, conform, from_database, from_folder

__all__ = ["SCHEMAS", "DerivedTables", "SchemaMismatch", "Tables", "conform", "from_database", "from_folder"]
