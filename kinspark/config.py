"""Parameters of retrieval and decision."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Params:
    dfmax: int = 100_000
    budget: int = 3_000
    kq: int = 10
    topk: int = 20
    w_addr: float = 1.0
    #: "sum" divides by sqrt(sum w), "l2" by sqrt(sum w * w).
    norm: str = "sum"
    #: Rare-token features of the query side: "zero" as the published model has them, or "live".
    mindf: str = "zero"

    def with_(self, **changes) -> Params:
        return replace(self, **changes)

    def key(self, *more: object) -> str:
        """A digest of all parameters, for folders of results that may be resumed."""
        return hashlib.sha256(json.dumps([asdict(self), *map(str, more)], sort_keys=True).encode()).hexdigest()[:16]


PRODUCTION = Params(kq=100, budget=80_000, topk=30)
#: Small enough for every limit to bite on the test tables.
SMALL = Params(kq=10, budget=60, dfmax=150, topk=5)
# The thresholds of the sweep.
THRESHOLDS = (0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.93, 0.95, 0.97, 0.99, 0.995)
