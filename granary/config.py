"""Settings of a retention run, checked when they are made, and the sizes derived from them."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields

TRANSFORMS = ("zscore", "log_zscore", "robust", "log_robust")
MODES = ("baseline", "random", "utility")


def budget(rows: int, ratio: float) -> int:
    """Rows that each node may keep."""
    return max(1, math.ceil(rows * ratio))


def max_representatives(kept: int) -> int:
    """The whole root of the budget, at least 1, and below the budget where that can be."""
    return max(1, min(math.isqrt(max(0, kept)), max(1, kept - 1)))


def overlay_sizes(nodes: int) -> tuple[int, int]:
    """(view size, fan-out) of the gossip overlay."""
    log = 1 if nodes <= 1 else (nodes - 1).bit_length()
    most = max(1, nodes - 1)
    return min(most, max(4, math.ceil(math.sqrt(nodes) * log))), min(most, max(2, math.ceil(math.sqrt(nodes) * math.sqrt(log))))


def transform_name(name: str | None) -> str:
    """A transform's name, trimmed and lower-cased; blank is ``log_zscore``."""
    found = (name or "").strip().lower() or "log_zscore"
    if found not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}")
    return found


@dataclass(frozen=True)
class RetentionConfig:
    """Settings of a run.

    ``ratios`` are shares of all rows that each node may keep. ``order``: ``sequential`` nodes decide row by row and
    gossip in ``rounds``; ``interleaved`` ones gossip between rows (``view``, ``shuffle``, ``swap``, ``cycle``, ``batch``, ``queue``), all in one
    task a ratio; ``free`` nodes keep what an order-free rule picks, and do not gossip.
    """

    path: str = ""
    mode: str = "utility"
    nodes: int = 8
    ratios: tuple[float, ...] = (0.1,)
    transform: str = "log_zscore"
    ignore: tuple[str, ...] = ()
    id_column: str | None = None
    max_reps: int | None = None
    gamma: float = 1.0
    balance_min: float = 0.5
    balance_max: float = 2.0
    ttl: int = 2
    fit_rows: int = 20_000
    separator: str = ","
    fanout: int | None = None
    rounds: int = 8
    order: str = "sequential"
    report_every: int = 1000
    view: int | None = None
    shuffle: int | None = None
    swap: int = 50
    cycle: int = 50
    batch: int = 64
    queue: int = 100_000

    def __post_init__(self):
        checks = {
            "mode": self.mode.lower() in MODES,
            "nodes": 1 <= self.nodes <= 36,
            "ratios": all(0 < r <= 1 for r in self.ratios),
            "gamma": self.gamma >= 0 and math.isfinite(self.gamma),
            "balance": 0 < self.balance_min <= self.balance_max,
            "ttl": self.ttl >= 0,
            "fit_rows": self.fit_rows > 0,
            "separator": len(self.separator) >= 1,
            "max_reps": self.max_reps is None or self.max_reps >= 1,
            "fanout": self.fanout is None or self.fanout >= 1,
            "rounds": self.rounds >= 1,
            "order": self.order in ("sequential", "interleaved", "free"),
            "interleaved full retention": self.order != "interleaved" or self.mode.lower() != "baseline",
            "report_every": self.report_every >= 1,
            "view": self.view is None or self.view >= 1,
            "shuffle": self.shuffle is None or self.shuffle >= 1,
            "swap": self.swap >= 1,
            "cycle": self.cycle >= 1,
            "batch": self.batch >= 1,
            "queue": self.queue >= 1,
        }
        wrong = [k for k, good in checks.items() if not good]
        if wrong:
            raise ValueError(f"bad settings: {', '.join(wrong)}")
        transform_name(self.transform)

    @classmethod
    def load(cls, text: str) -> RetentionConfig:
        """From JSON; unknown keys fail."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
