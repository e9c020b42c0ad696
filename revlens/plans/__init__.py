"""Registered queries, one per inventory item; importing this fills the registry."""

from revlens.plans import q_clean  # noqa: F401
from revlens.plans import q_tables  # noqa: F401
from revlens.plans import q_metrics  # noqa: F401
from revlens.plans import q_text  # noqa: F401
from revlens.plans import q_extract  # noqa: F401
from revlens.plans import q_models  # noqa: F401
from revlens.plans import q_io  # noqa: F401
from revlens.plans import q_udf  # noqa: F401
from revlens.plans import q_subword  # noqa: F401
