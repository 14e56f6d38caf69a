"""Parameters of the linkage plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LinkConfig:
    """``k`` rarest keys of a record probe the index, ``top_m`` candidates stay.

    Keys of more than ``posting_cap`` targets are only unfolded for records that could need
    them among their ``top_m`` (the result does not change). ``hard_cap`` bounds a probing key's document frequency; ``soft_cap`` does so for
    records that have a rarer chosen key; ``min_shared`` bounds a pair's shared keys from
    below. ``split_states`` maps each word of a state's name, and ``compat`` merges phrases
    inside words as well; both are off. ``scripts`` reads scripts other than Latin.
    ``rounds`` trees at most are fitted, and fitting stops where a round lowers the
    validation error by less than ``least_gain`` of it.
    """

    k: int = 10
    top_m: int = 150
    posting_cap: int | None = 100_000
    hard_cap: int | None = None
    soft_cap: int | None = None
    min_shared: int = 1
    train_share: int = 10
    val_share: int = 10
    threshold: float = 0.5
    split_states: bool = False
    compat: bool = False
    scripts: bool = True
    rounds: int = 200
    least_gain: float = 1e-4
