"""The verbs: functions over typed columns, by name.

``call("upper", of(df, "name"))`` gives a :class:`~quillspark.functions.kernel.Value`
whose ``col`` is a plain Spark column.
"""

from quillspark.functions import (  # noqa: F401
    aggregation,
    arrays,
    coercion,
    dates,
    encoding,
    financial,
    generation,
    geo,
    logic,
    numeric,
    objects,
    strings,
)
from quillspark.functions.kernel import Value, lit, of  # noqa: F401
from quillspark.functions.registry import VERBS, call, register_verb  # noqa: F401
