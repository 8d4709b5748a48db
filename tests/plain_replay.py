"""One batch decided by a plain loop, to hold the replay by rounds against."""

from __future__ import annotations

from datetime import timedelta
from functools import lru_cache

import numpy as np

from tidewire.config import Settings
from tidewire.functions import geo, similarity
from tidewire.operators import duplicates

def _km(a: tuple, b: tuple) -> float | None:
    if None in a or None in b:
        return None
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
    return float(2 * geo.EARTH_KM * np.arcsin(np.sqrt(h)))


def _fold(x: str | None) -> str:
    return " ".join("".join(ch for ch in (x or "").casefold() if ch.isalnum() or ch.isspace()).split())


_token_set = lru_cache(1 << 16)(similarity.token_set)


@lru_cache(1 << 16)
def _text_similarity(a: str | None, b: str | None) -> float:
    a, b = _fold(a), _fold(b)
    if not a or not b:
        return 0.0
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    lev = 1 - prev[-1] / max(len(a), len(b))
    return similarity.weighted(a, b) / 100 * 0.35 + similarity.token_set(a, b) / 100 * 0.35 + similarity.token_sort(a, b) / 100 * 0.15 + lev * 0.15


def _venue(x: dict) -> str | None:
    return " ".join(v for v in (x["venue_name"], x["address"]) if v and v.strip()) or None


def compare(c: dict, e: dict, s: Settings) -> tuple[float, bool, bool] | None:
    """(score, dates compatible, places compatible) of two events; None if they do not pass the gate."""
    hours = abs((c["start_at"] - e["start_at"]) / timedelta(hours=1)) if c["start_at"] is not None and e["start_at"] is not None else None
    km = _km((c["latitude"], c["longitude"]), (e["latitude"], e["longitude"]))
    dated = hours is not None and hours <= s.near_hours
    placed = km <= s.near_km if km is not None else bool(_venue(c) and _venue(e)) and _token_set(_venue(c), _venue(e)) >= 85
    if not (dated or placed or _token_set((c["title"] or "").strip(), (e["title"] or "").strip()) >= 100 * s.duplicate_candidate):
        return None
    when = 0.0 if hours is None else 1.0 if hours <= 4 else 0.75 if hours <= 24 else 0.35 if hours <= 72 else 0.0
    where = 0.0 if km is None else next((v for most, v in ((0.25, 1.0), (1, 0.8), (2, 0.6), (5, 0.3)) if km <= most), 0.0)
    parts = (_text_similarity(c["title"], e["title"]), _text_similarity(_venue(c), _venue(e)), when, where)
    return sum(p * w for p, w in zip(parts, duplicates.WEIGHTS)), dated, placed


def loop(rows: list[dict], events: list[dict], s: Settings = Settings()) -> dict[str, tuple]:
    """(decision, duplicate_of, score) of each candidate; rows in their order."""
    universe = [(e["event_id"], e) for e in sorted(events, key=lambda e: e["event_id"])]
    out = {}
    for r in rows:
        best = None
        for name, e in universe:
            m = compare(r, e, s)
            if m and (best is None or m[0] > best[0] + 1e-12):
                best = (m[0], name, m[1], m[2])
        decision, of, score = r["decision"], None, None
        if best and best[0] >= s.duplicate_review - 1e-9:
            decision, of, score = ("MERGE" if best[0] >= s.duplicate_merge and best[2] and best[3] else "REVIEW"), best[1], best[0]
        if decision == "ACCEPT":
            universe.append((f"new:{r['candidate_id']}", r))
        elif decision == "MERGE":
            t = next(e for n, e in reversed(universe) if n == of)
            universe.append((of, {**t, **{k: t[k] if t[k] not in (None, "") else r[k] for k in ("address", "latitude", "longitude")}}))
        out[r["candidate_id"]] = (decision, of, score)
    return out
