"""Exhaustive path enumeration of the journey spec, for tests only.

Independent of the DataFrame engine: plain Python over small timetables.
Every path (sequence of boardings with optional walks) is enumerated; the
answer is the earliest arrival (depart) / latest departure (arrive), then
the highest probability.
"""

from __future__ import annotations

from dataclasses import dataclass

WEEK, DAY = 604800, 86400


@dataclass
class Ride:
    edge_id: int
    trip_id: int
    day_start: int
    seg: int
    seq: int
    path_id: int
    dep_node: str
    arr_node: str
    dep_sow: int
    arr_sow: int
    dist: str | None


def solve(rides, walks, cdf, mode, start, target, T, threshold, bound=DAY, buffer_s=120, cutoff=0.99):
    """walks: links {(a, b): walk_s} in real direction, taken one at a time. cdf(dist, slack) -> p.
    Returns (arr_t, prob) in search-relative seconds, or None."""
    dep = mode == "depart"

    def orient(r):
        if dep:
            f = (r.dep_sow - T) % WEEK
            return r.dep_node, r.arr_node, f, f + (r.arr_sow - r.dep_sow)
        f = (T - r.arr_sow) % WEEK
        return r.arr_node, r.dep_node, f, f + (r.arr_sow - r.dep_sow)

    tsod = T % DAY
    info = {}
    for r in rides:
        fn, tn, ft, tt_ = orient(r)
        same = ft < DAY - tsod if dep else ft <= tsod
        if ft > 0 and (same or tt_ < DAY) and tt_ <= bound:
            info[r.edge_id] = (r, fn, tn, ft, tt_)
    sw = {}
    for (a, b), w in walks.items():
        key = (a, b) if dep else (b, a)
        sw.setdefault(key[0], []).append((key[1], w))

    def walked(stop, prev, t):
        """(stop, stop before, time) of every chain of links, link by link: never straight back
        (P14), and a chain goes on only where it beats the shorter ones to the same two stops."""
        known, level = {}, [(stop, prev, t)]
        while level:
            nxt = [(b, at, now + w) for at, before, now in level for b, w in sw.get(at, []) if b != before]
            yield from nxt
            level = [x for x in nxt if x[2] <= bound and (x[:2] not in known or x[2] < known[x[:2]])]
            for b, at, now in level:
                known[b, at] = min(now, known.get((b, at), now))
    by_from = {}
    for eid, (r, fn, tn, ft, tt_) in info.items():
        by_from.setdefault(fn, []).append(eid)
    segs = {}
    for eid, (r, *_rest) in info.items():
        segs.setdefault((r.trip_id, r.day_start, r.seg), []).append(eid)

    def aboard(eid):
        r = info[eid][0]
        out = []
        for c in segs[(r.trip_id, r.day_start, r.seg)]:
            rc = info[c][0]
            if (rc.seq >= r.seq) if dep else (rc.seq <= r.seq):
                out.append(c)
        return out

    best = [None]

    def offer(arr_t, prob):
        if prob <= threshold:
            return
        cand = (arr_t, -prob)
        if best[0] is None or cand < best[0]:
            best[0] = cand

    def expand(x, prob, to_node, to_t, depth):
        """x: None (virtual) or edge id of the label."""
        if depth > 12:
            return
        xr = info[x][0] if x is not None else None
        x_from = info[x][1] if x is not None else None
        # arrivals at the target
        if x is not None and to_node == target:
            offer(to_t, prob)
        chains = list(walked(to_node, x_from, to_t))
        for b, _, t in chains:
            if b == target:
                offer(t, prob)
        for via, before, at_t, is_walk in [(to_node, x_from, to_t, False), *((b, a, t, True) for b, a, t in chains)]:
            groups = {}
            for e in by_from.get(via, []):
                er, efn, etn, eft, ett = info[e]
                if eft < at_t or etn == before:
                    continue
                if x is not None:
                    if (er.trip_id, er.day_start) == (xr.trip_id, xr.day_start) or er.path_id == xr.path_id:
                        continue
                groups.setdefault((etn, er.path_id), []).append(e)
            for _, es in groups.items():
                es.sort(key=lambda e: (info[e][4], info[e][3], e))
                for e in es:
                    er, efn, etn, eft, ett = info[e]
                    slack = eft - at_t - buffer_s
                    if x is None and not is_walk:
                        p = 1.0
                    else:
                        law = (xr.dist if xr is not None else None) if dep else er.dist
                        p = 1.0 if law is None else cdf(law, slack)
                    np_ = prob * p
                    if np_ > threshold:
                        for c in aboard(e):
                            _, _, ctn, _, ctt = info[c]
                            expand(c, np_, ctn, ctt, depth + 1)
                    if p > cutoff:
                        break

    if threshold < 0 or threshold > 1:
        return None
    expand(None, 1.0, start, 0, 0)
    if best[0] is None:
        return None
    return best[0][0], -best[0][1]
