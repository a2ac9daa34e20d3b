"""Choice among measured candidates: noise, ties, Pareto fronts, stated preference. Sweep tables are small, so this is plain Python."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from .cluster import noise_floor

Row = dict[str, float]


def known(v: object) -> bool:
    return isinstance(v, (int, float)) and not math.isnan(v)


def tie_set(rows: list[Row], metric: str, higher: bool = True, z: float = 2.0, se: float | None = None, fallback: float | None = None) -> list[Row]:
    """Rows within z standard errors (or a fallback band) of the leader; the leader alone if neither is known."""
    have = [r for r in rows if known(r.get(metric))]
    if not have:
        return []
    best = (max if higher else min)(r[metric] for r in have)
    band = z * se if se is not None and known(se) else (fallback or 0.0)
    return [r for r in have if abs(r[metric] - best) <= band]


def dominates(a: Row, b: Row, objectives: dict[str, bool]) -> bool:
    """a is at least as good everywhere and better somewhere; a missing metric decides nothing, so no dominance."""
    if any(not known(a.get(m)) or not known(b.get(m)) for m in objectives):
        return False
    s = [(a[m] - b[m]) * (1 if up else -1) for m, up in objectives.items()]
    return all(x >= 0 for x in s) and any(x > 0 for x in s)


def pareto_front(rows: list[Row], objectives: dict[str, bool]) -> list[Row]:
    return [r for r in rows if not any(dominates(o, r, objectives) for o in rows)]


def challenger_wins(incumbent: Row, challenger: Row, metric: str, se: float, higher: bool = True, z: float = 2.0) -> bool:
    gap = (challenger[metric] - incumbent[metric]) * (1 if higher else -1)
    return gap > z * se


@dataclass
class Choice:
    chosen: Row | None
    tied: list[Row] = field(default_factory=list)
    front: list[Row] = field(default_factory=list)
    rejected: list[tuple[Row, str]] = field(default_factory=list)
    band: float = 0.0


def select(rows: list[Row], locator: str, objectives: dict[str, bool], reject=None, higher: bool = True, z: float = 2.0, fallback: float | None = None, prefer=None) -> Choice:
    """Reject, take the Pareto front, take its ties (noise of the whole sweep), then the stated preference."""
    rejected = [(r, why) for r in rows if reject and (why := reject(r))]
    left = [r for r in rows if not any(r is x for x, _ in rejected)]
    front = pareto_front(left, objectives)
    noise = noise_floor([r[locator] for r in rows if known(r.get(locator))])
    tied = tie_set(front, locator, higher, z, None if math.isnan(noise) else noise, fallback)
    chosen = (min(tied, key=prefer) if prefer else tied[0]) if tied else None
    return Choice(chosen, tied, front, rejected, z * noise if not math.isnan(noise) else (fallback or 0.0))


def tie_aware_best(rows: list[Row], key: str, error: str | None = None, higher: bool = True, floor: float = 0.0, tiebreak=None) -> tuple[Row | None, list[Row]]:
    """The winner, and all within its error (at least ``floor``)."""
    have = [r for r in rows if known(r.get(key))]
    if not have:
        return None, []
    lead = (max if higher else min)(have, key=lambda r: r[key])
    width = max(floor, lead.get(error) or 0.0) if error else floor
    tied = [r for r in have if abs(r[key] - lead[key]) <= width]
    return (min(tied, key=tiebreak) if tiebreak else lead), tied


def discrimination(rows: list[Row], key: str) -> float:
    """Range of a metric over its noise."""
    v = [r[key] for r in rows if known(r.get(key))]
    noise = noise_floor(v)
    return (max(v) - min(v)) / noise if v and not math.isnan(noise) and noise > 0 else math.nan


def validate_additions(proposed: list[float], incumbent: list[float], low: float, high: float, resolution: float, most: int) -> tuple[list[float], list[tuple[float, str]]]:
    """Grid points to add: within the range, new at the resolution, capped; with reasons for those refused."""
    out: list[float] = []
    why: list[tuple[float, str]] = []
    for x in proposed:
        if not low <= x <= high:
            why.append((x, "outside the range"))
        elif any(abs(x - y) < resolution for y in [*incumbent, *out]):
            why.append((x, "not new"))
        elif len(out) >= most:
            why.append((x, "over the cap"))
        else:
            out.append(x)
    return out, why


SCORE_WORDS = ("score", "accuracy", "ami", "ari", "nmi", "kappa", "silhouette", "stability", "metric")


def assert_blind(payload: object, allow: tuple[str, ...] = (), path: str = "") -> None:
    """Refuse a payload that carries scores to a proposer who must not see them."""
    if isinstance(payload, dict):
        for k, v in payload.items():
            if any(w in str(k).lower().split("_") for w in SCORE_WORDS) and k not in allow:
                raise ValueError(f"a score at {path}/{k}")
            assert_blind(v, allow, f"{path}/{k}")
    elif isinstance(payload, (list, tuple)):
        for i, v in enumerate(payload):
            assert_blind(v, allow, f"{path}/{i}")
