from opslens.functions.expr import *  # noqa: F401,F403
from opslens.functions.names import *  # noqa: F401,F403
