"""What users import: the engine over a store, a local session, and the plans behind it."""

from .operators import extract, guard, rank, records
from .operators.memory import Memory
from .session import local_session

__all__ = ["Memory", "local_session", "extract", "guard", "rank", "records"]
