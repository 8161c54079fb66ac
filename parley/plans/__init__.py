"""Report modules; importing this package fills the registry."""

from parley.plans import base  # noqa: F401
from parley.plans import m01_length, m02_messages, m03_thinking, m04_rhythm, m05_tools, m06_lifetime, m07_attachments, m08_projects, m09_artifacts, m10_code, m11_citations, m12_errors, m13_interventions, overview, stats_tables  # noqa: F401

from parley.plans.base import REGISTRY, Context, run_module  # noqa: F401
