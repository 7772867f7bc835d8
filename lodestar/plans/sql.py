"""The SQL of all of the package's own queries that have one."""

from __future__ import annotations

from .oracle import ORACLE
from .oracle_chunks import CHUNK_ORACLE
from .oracle_loops import LOOP_ORACLE

ALL_SQL = ORACLE | CHUNK_ORACLE | LOOP_ORACLE
