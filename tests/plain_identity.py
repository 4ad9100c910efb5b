"""The fold of records into events on plain rows, one after the other."""

from gridlore import constants as C


def _minutes(a, b):
    return abs((a - b).total_seconds()) / 60


def match_rows(a, b):
    """``same_event`` on two rows of one district, keys as sets."""
    ax, bx = a["ends_at"], b["ends_at"]
    if a["starts_at"] == b["starts_at"] and ax == bx and (a["keys"] <= b["keys"] or b["keys"] <= a["keys"]):
        return True
    if a["keys"].isdisjoint(b["keys"]):
        return False
    apart = _minutes(a["starts_at"], b["starts_at"])
    if ax is None and bx is None and a["kind"] == b["kind"] == "fault":
        return apart <= (C.NO_END_ASSUMED_OVER if a["continuation"] or b["continuation"] else C.OPEN_FAULT_TOLERANCE)
    if apart > C.TIME_TOLERANCE:
        return False
    return ax is bx if ax is None or bx is None else _minutes(ax, bx) <= C.TIME_TOLERANCE


def merge_rows(old, new):
    official = lambda r: any(s["kind"] == "official" for s in r["sources"])
    facts = new if official(new) and not official(old) else old
    both_open = old["ends_at"] is None and new["ends_at"] is None and old["kind"] == new["kind"] == "fault"
    areas, sources = {}, {}
    for r in (old, new):
        for key, name in zip(r["area_folds"], r["areas"], strict=True):
            areas.setdefault(key, name)
        for key, source in zip(r["source_keys"], r["sources"], strict=True):
            sources.setdefault(key, source)
    ordered = sorted(sources.items(), key=lambda x: x[1]["kind"] != "official")
    return old | {
        "kind": facts["kind"], "starts_at": min(old["starts_at"], new["starts_at"]) if both_open else facts["starts_at"], "ends_at": facts["ends_at"],
        "area_folds": list(areas), "areas": list(areas.values()), "keys": old["keys"] | new["keys"],
        "source_keys": [k for k, _ in ordered], "sources": [s for _, s in ordered],
        "published_at": min(old["published_at"], new["published_at"]), "ingested_at": max(old["ingested_at"], new["ingested_at"]),
        "confidence": "high" if "high" in (old["confidence"], new["confidence"]) else "low",
        "scope": "district" if "district" in (old["scope"], new["scope"]) else "places", "members": old["members"] + new["members"],
    }


def fold(incoming, stored=()):
    """Events after the batch: stored rows of the same id first, then what the batch has written in that order,
    then stored rows by id. ``created`` and ``touched`` tell what became of each."""
    events = [r | {"created": False, "touched": False} for r in sorted(stored, key=lambda r: r["id"])]
    written = []
    for r in sorted(incoming, key=lambda r: r["id"]):
        by_id = [e for e in events if not e["created"] and e["id"] == r["id"]]
        fits = lambda e: e["district"] == r["district"] and match_rows(e, r)  # noqa: B023, E731
        known = (by_id or [e for e in written if fits(e)] or [e for e in events if not e["touched"] and fits(e)])[:1]
        if known:
            e = known[0]
            e.update(merge_rows(e, r))
        else:
            e = r | {"created": True, "touched": False}
            events.append(e)
        if not e["touched"]:
            e["touched"] = True
            written.append(e)
    return events


def plain_cards(rows, descending):
    """Cards of district-wide rows, read one after the other."""
    out = []
    for kind in {r["kind"] for r in rows}:
        sign = -1 if descending else 1
        order = sorted((r for r in rows if r["kind"] == kind), key=lambda r: (sign * r["starts_at"].timestamp(), r["id"]))
        groups = []
        for r in order:
            if groups and _minutes(groups[-1][0]["starts_at"], r["starts_at"]) <= C.SAME_START:
                groups[-1].append(r)
            else:
                groups.append([r])
        for g in groups:
            live = [r for r in g if r["ends_at"] is None]
            lead = min(live, key=lambda r: r["starts_at"]) if live else max(g, key=lambda r: r["ends_at"])
            out.append((lead["id"], kind, tuple(r["district"] for r in g if r is not lead), tuple(r["id"] for r in g if r is not lead)))
    return sorted(out)
