"""Scalar functions of the dialect.

Each is a SQL temporary function under the prefix ``c_`` that Catalyst inlines into the plan, so
no Python worker runs. Functions that Spark has with the same meaning need no entry here.
"""

from .registry import BUILTIN_NAMES, RENAMED, lenient, register

__all__ = ["BUILTIN_NAMES", "RENAMED", "lenient", "register"]
