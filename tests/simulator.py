"""A deterministic run of the replication protocol, as rows: what was sent, stored, acknowledged and by which ensembles."""

from __future__ import annotations

import random


def simulate(seed: int, timelines: int = 2, events: int = 40, units: int = 4, replicas: int = 2, loss: float = 0.2, takeovers: int = 3):
    """Writers send each event to all units of the ensemble, again until all have it; a takeover fences the old ensemble, takes the largest frontier, copies what it covers, truncates what is above and goes on there.

    Returns sent, stored and acked rows (timeline, log_offset, ..) and the final ensembles by segment.
    """
    rng = random.Random(seed)
    sent, acked = set(), []
    stored: dict[tuple[str, int, str], str] = {}
    segments: list[tuple[str, int, list[str]]] = []
    for t in (f"t{i}" for i in range(timelines)):
        ensemble = rng.sample([f"u{i}" for i in range(units)], replicas)
        segments.append((t, 1, ensemble))
        offset, lra = 0, 0
        turn = sorted(rng.sample(range(5, events), takeovers))
        for step in range(events):
            offset += 1
            payload = f"{t}-{step}"
            sent.add((t, offset, payload))
            got: set[str] = set()
            give_up = step in turn
            for u in ensemble:
                while rng.random() < loss and not give_up:
                    pass
                if not give_up or rng.random() < 0.5:
                    stored[t, offset, u] = payload
                    got.add(u)
            if got == set(ensemble) and not give_up:
                lra = offset
                acked.append((t, offset, payload))
            if give_up:
                old, ensemble = ensemble, rng.sample([f"u{i}" for i in range(units)], replicas)
                for key in [k for k in stored if k[0] == t and k[1] > lra]:
                    del stored[key]
                segments = [s for s in segments if not (s[0] == t and s[1] > lra)]
                segments.append((t, lra + 1, ensemble))
                offset = lra
    return sorted(sent), [(t, o, u, p) for (t, o, u), p in stored.items()], acked, segments
