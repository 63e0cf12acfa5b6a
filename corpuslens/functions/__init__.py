"""Column functions built from Spark built-ins; all of them stay inside whole-stage codegen or Catalyst."""

from corpuslens.functions.paths import *  # noqa: F401,F403
from corpuslens.functions.payloads import *  # noqa: F401,F403
from corpuslens.functions.text import *  # noqa: F401,F403
from corpuslens.functions.values import *  # noqa: F401,F403
