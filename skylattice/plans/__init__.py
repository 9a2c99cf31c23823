from skylattice.plans import ingestion, inventories, inversion, observe, space, validation  # noqa: F401
from skylattice.plans.registry import CATALOGUE

__all__ = ["CATALOGUE"]
