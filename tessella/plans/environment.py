"""Rank and world size of a consumer from its environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

# The variables that launchers set, in the order in which they are asked.
RANK_VARIABLES = ("RANK", "SLURM_PROCID", "LOCAL_RANK")
WORLD_VARIABLES = ("WORLD_SIZE", "SLURM_NTASKS")
LOCAL_WORLD_VARIABLES = ("LOCAL_WORLD_SIZE", "SLURM_NTASKS_PER_NODE")
#: Set to let an epoch without any batch pass.
ALLOW_EMPTY = "TESSELLA_ALLOW_EMPTY_EPOCH"


@dataclass(frozen=True)
class Consumer:
    """One of ``world_size`` readers of the shards, ``local_world_size`` of them on its machine."""

    rank: int = 0
    world_size: int = 1
    local_world_size: int = 1

    @classmethod
    def inferred(cls, environment: Mapping[str, str] | None = None) -> Consumer:
        """The first variable of each list that is set; a lone consumer where none is."""
        env = os.environ if environment is None else environment
        first = lambda names, default: next((int(env[n]) for n in names if n in env), default)
        return cls(first(RANK_VARIABLES, 0), first(WORLD_VARIABLES, 1), first(LOCAL_WORLD_VARIABLES, 1))


def allows_empty_epochs(environment: Mapping[str, str] | None = None) -> bool:
    return bool((os.environ if environment is None else environment).get(ALLOW_EMPTY))
