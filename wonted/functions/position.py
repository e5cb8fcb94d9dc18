"""Positions in the order of judgement: (t, msg_id) packed into one DECIMAL(38,0).

One number compares like the pair, and unlike a struct it fits the fixed-width buffers of hash
aggregation, so "first time that ..." needs no sorting before the shuffle.
"""

from __future__ import annotations

TYPE = "decimal(38,0)"
UNIT = "10000000000000000000BD"  # above every msg_id


def position(t: str, msg_id: str) -> str:
    return f"cast(cast({t} AS decimal(18,0)) * {UNIT} + {msg_id} AS {TYPE})"


def id_of(pos: str) -> str:
    return f"bigint(pmod({pos}, {UNIT}))"


def time_of(pos: str) -> str:
    return f"bigint(({pos} - pmod({pos}, {UNIT})) div {UNIT})"
