"""Declarative transforms: a plan, its text form, and its compilation to DataFrames."""

from quillspark.plans.compiler import Result, Stream, run, run_records  # noqa: F401
from quillspark.plans.imports import files_below  # noqa: F401
from quillspark.plans.ir import Call, Condition, Copy, Literal, Loop, Mapping, Object, Segment, Template, Transform  # noqa: F401
from quillspark.plans.text import parse_transform  # noqa: F401
