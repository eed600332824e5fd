"""Review signals over public-works spending records, as Spark DataFrame operators."""

from works_risk.params import Params

__all__ = ["Params"]
