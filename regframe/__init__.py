"""regframe — business-registry analytics expressed as Spark DataFrame plans.

Every operator takes DataFrames (usually through a :class:`Registry` bundle)
and returns a lazy DataFrame; nothing is collected inside an operator.
"""

from regframe.bundle import Registry
from regframe.session import build_session, checkpoint_dir

__all__ = ["Registry", "build_session", "checkpoint_dir"]
__version__ = "0.1.0"
