"""The utility node restated without a heap, matrices or kept sums: every choice looks at everything that is stored."""

import math

import numpy as np


class PlainNode:
    def __init__(self, capacity, max_reps, gamma=1.0, lo=0.5, hi=2.0):
        self.capacity, self.max_reps, self.gamma, self.lo, self.hi = capacity, max_reps, gamma, lo, hi
        self.reps, self.items, self.stats = [], {}, {}  # reps: [key, vector, rank]; items: key -> dict; stats: rep -> (load, sum)

    def distance(self, a, b):
        d = float(np.sqrt(((np.asarray(a, float) - np.asarray(b, float)) ** 2).sum()))
        return d if math.isfinite(d) else math.inf

    def two(self, v, but=None):
        found = sorted(((self.distance(v, r[1]), i, r[0]) for i, r in enumerate(self.reps) if r[0] != but))
        found = [(k if math.isfinite(d) else None, d) for d, _, k in found[:2]] + [(None, math.inf)] * 2
        return found[0], found[1]

    def utility(self, near, d):
        if not math.isfinite(d) or near not in self.stats:
            return d
        load, total = self.stats[near]
        target = max(1.0, max(0, self.capacity - len(self.reps)) / max(1, len(self.stats)))
        return d / max(1e-9, total / load if load else 0.0) * min(self.hi, max(self.lo, ((target + 1) / (load + 1)) ** self.gamma))

    @staticmethod
    def rank(d1, d2):
        if not math.isfinite(d1):
            return math.inf
        return math.log1p(d1) * (1 + 0.25 * min(1.0, d1 / d2) if math.isfinite(d2) and d2 > 0 else 1.0)

    def recount(self, keep=None):
        self.stats = {r[0]: [0, 0.0] for r in self.reps if keep is None or r[0] in keep}
        for x in self.items.values():
            if x["near"] is not None:
                s = self.stats.setdefault(x["near"], [0, 0.0])
                s[0], s[1] = s[0] + 1, s[1] + x["d"]

    def offer(self, key, v):
        (near, d1), (second, d2) = self.two(v)
        utility, as_rep = (self.utility(near, d1), self.rank(d1, d2)) if self.reps else (math.inf, math.inf)
        if self.reps and not math.isfinite(utility):
            return "DROPPED", None
        full = len(self.reps) + len(self.items) >= self.capacity
        ranks = [r[2] for r in self.reps if math.isfinite(r[2])]
        early = len(self.reps) < min(8, self.capacity, self.max_reps) or not self.reps
        if full and not self.items:
            return "DROPPED", None
        item = {"v": v, "u": utility, "near": near, "d": d1, "second": second, "d2": d2}
        least = lambda but=None: min((x["u"], k) for k, x in self.items.items() if k != but)
        if not early and not as_rep > 1.10 * min(ranks, default=0.0):
            out = None
            if full:
                u, out = least()
                if utility <= u:
                    return "DROPPED", None
                x = self.items.pop(out)
                if x["near"] in self.stats:
                    s = self.stats[x["near"]]
                    s[0] -= 1
                    s[1] = max(0.0, s[1] - x["d"]) if s[0] else 0.0
            self.items[key] = item
            if near is not None:
                s = self.stats.setdefault(near, [0, 0.0])
                s[0], s[1] = s[0] + 1, s[1] + d1
            return ("EVICTED_AND_ADMITTED", out) if full else ("ADMITTED", None)
        gone, out = None, None
        if len(self.reps) >= self.max_reps:
            at = min(range(len(self.reps)), key=lambda i: self.reps[i][2] if math.isfinite(self.reps[i][2]) else -math.inf)
            gone, old, _ = self.reps[at]
            self.reps[at] = [key, v, math.inf]
            (n, a), (s, b) = self.two(old)
            self.items[gone] = {"v": old, "u": self.utility(n, a), "near": n, "d": a, "second": s, "d2": b}
        else:
            self.reps.append([key, v, math.inf])
        if full:
            out = least(gone)[1]
            del self.items[out]
        for x in self.items.values():
            if x["near"] is None:
                (x["near"], x["d"]), (x["second"], x["d2"]) = self.two(x["v"])
                x["u"] = self.utility(x["near"], x["d"])
                continue
            if gone is not None and gone in (x["near"], x["second"]):
                if x["near"] == gone:
                    x["near"], x["d"] = x["second"], x["d2"]
                    x["u"] = self.utility(x["near"], x["d"])
                x["second"], x["d2"] = self.two(x["v"], x["near"])[0]
            d = self.distance(x["v"], v)
            if d < x["d"]:
                if x["near"] != key:
                    x["second"], x["d2"] = x["near"], x["d"]
                x["near"], x["d"] = key, d
                x["u"] = self.utility(key, d)
            elif key != x["near"] and d < x["d2"]:
                x["second"], x["d2"] = key, d
        for r in self.reps:
            (_, a), (_, b) = self.two(r[1], r[0])
            r[2] = self.rank(a, b)
        self.recount({*self.stats, key} - {gone})
        return ("EVICTED_AND_ADMITTED", out) if full else ("ADMITTED", None)
