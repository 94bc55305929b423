"""Plain sequential statements of the order-dependent operators, to compare results with."""

from datetime import date


def day(text):
    try:
        return date.fromisoformat(text[:10]) if text else None
    except ValueError:
        return None


def place(row):
    d = day(row["date"])
    return (d is None, d or date.max, row["id"])


def gap(a, b, window):
    """Day gap of a candidate pair (10**9 if unknown), None if it is none."""
    same = {}
    for field in ("entity", "domain"):
        x, y = a[field], b[field]
        same[field] = bool(x) and bool(y) and x.strip().lower() == y.strip().lower()
    x, y = day(a["date"]), day(b["date"])
    days = abs((x - y).days) if x and y else None
    if same["entity"]:
        return 10**9 if days is None else days if days <= window else None
    if same["domain"] and days is not None and days <= min(window, 3):
        return days
    return None


def nearest(row, pool, window, k=10):
    found = [(gap(row, other, window), place(other), other) for other in pool if other["id"] != row["id"]]
    found = sorted((f for f in found if f[0] is not None), key=lambda f: f[:2])
    return [(f[0], f[2]) for f in found[:k]]


def clusters(rows, window, rule, prior=(), said=None):
    """Assignment of each event; ``said`` collects every decision: (a, b) -> (kind, applied)."""
    out = {}
    for company in {r["company"] for r in rows}:
        seeds = [p for p in prior if p["company"] == company]
        for row in sorted((r for r in rows if r["company"] == company), key=place):
            scored = [(rule.decide(row, s), s["id"]) for _, s in nearest(row, seeds, window)]
            same = [(c, i) for (kind, c), i in scored if kind == "same_event"]
            top = max((c for c, _ in same), default=None)
            joined = next((i for c, i in same if c == top), None) if top is not None and top >= 0.85 else None
            for (kind, _), i in scored if said is not None else ():
                said[min(i, row["id"]), max(i, row["id"])] = (kind, i == joined)
            if top is not None and top >= 0.85:
                out[row["id"]] = ("merged", next(i for c, i in same if c == top))
            elif row["official"]:
                seeds.append(row)
                out[row["id"]] = ("new", row["id"])
            else:
                out[row["id"]] = ("deferred", None)
    return out


def threads(rows, window, rule, said=None):
    """Actions and places; ``said`` collects every decision: (a, b) -> applied."""
    acts, spots = {}, {}

    def fits(a, b):
        kind, score = rule.decide(a, b)
        good = kind == "related_distinct" and score >= 0.75
        if said is not None:
            key = min(a["id"], b["id"]), max(a["id"], b["id"])
            said[key] = good or said.get(key, False)
        return good

    for company in {r["company"] for r in rows}:
        mine = sorted((r for r in rows if r["company"] == company), key=place)
        chains = []
        for row in mine:
            if row["id"] in spots:
                acts[row["id"]] = "already_threaded"
                continue
            chain = next(
                (c for c in chains if gap(row, c[1][-1], window) is not None and fits(c[1][-1], row)), None
            )
            if chain:
                spots[row["id"]] = (chain[0], len(chain[1]))
                chain[1].append(row)
                acts[row["id"]] = "appended_to_thread"
                continue
            free = [o for o in mine if o["id"] not in spots]
            mate = next((o for _, o in nearest(row, free, window) if fits(o, row)), None)
            if mate is None:
                acts[row["id"]] = "standalone"
                continue
            pair = sorted([mate, row], key=lambda e: e["date"] or "")
            chains.append((row["id"], pair))
            for n, e in enumerate(pair):
                spots[e["id"]] = (row["id"], n)
            acts[row["id"]] = "created_thread"
    return acts, spots
