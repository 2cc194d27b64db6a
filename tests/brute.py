"""Slow, plain versions of the core problems, written from the statements alone."""

import json
import re
from datetime import datetime, timezone
from uuid import UUID

NIL = "00000000-0000-0000-0000-000000000000"


def uid(t):
    if t is None or not t.strip():
        return None
    try:
        return str(UUID(t.strip().lower()))
    except ValueError:
        return t.strip().lower()


def jparse(t):
    def bad(_):
        raise ValueError

    if t is None:
        return None, False
    try:
        v = json.loads(t, parse_constant=bad)
    except ValueError:
        return None, False
    return stand(v), True


def stand(v):
    if isinstance(v, str) and v.strip()[:1] in ("{", "["):
        try:
            w = json.loads(v)
        except ValueError:
            return v
        if isinstance(w, (dict, list)):
            return w
    return v


def lineages(rows):
    """rows: (id, supersedes, revoked) -> {(record, root, depth, n_revoked)}"""
    parent, rev = {}, {}
    for i, s, r in rows:
        s = uid(s)
        parent[i] = None if s == NIL else s
        rev[i] = rev.get(i, False) or r == 1
    out = set()
    for i in parent:
        if parent[i] not in parent:
            continue
        line, seen, at = [i], {i}, i
        while parent[at] in parent:
            at = parent[at]
            if at in seen:
                out.add((i, min(line[line.index(at) :]), -1, -1))
                break
            seen.add(at)
            line.append(at)
        else:
            out.add((i, at, len(line) - 1, sum(rev[x] for x in line)))
    return out


def micros(t):
    m = re.match(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)$", t.strip())
    base = datetime.fromisoformat(m[1] + m[3].replace("Z", "+00:00"))
    return int(base.timestamp()) * 1_000_000 + int(((m[2] or "") + "000000")[:6])


def faults(records, anchors, compacted):
    """records: dicts; anchors: (kind, target, state, micros); compacted: ids"""
    at = {}
    for r in records:
        at[r["id"]] = min(micros(r["recorded_at"]), at.get(r["id"], 1 << 62))
    gone = {uid(x) for x in compacted if x}
    known = {}
    for k, t, s, us in anchors:
        known.setdefault(f"{k.strip().lower()}/{t.strip().lower()}", []).append((us, s.strip().lower() == "dead"))
    out = set()
    for r in records:
        refs = set()
        s = uid(r["supersedes"])
        if s and s != NIL:
            refs.add(("supersedes", "records", s))
        v, ok = jparse(r["evidence_json"])
        for e in ([v] if isinstance(v, dict) else v if isinstance(v, list) else []) if ok else []:
            e = stand(e)
            if isinstance(e, str):
                low = e.strip().lower()
                kind = next((k for k in ("record", "anchor:ticket", "anchor:diff", "anchor:trunk") if re.match(re.escape(k) + r"\s*:", low)), None)
                ref = low[len(kind) :].strip()[1:] if kind else None
            elif isinstance(e, dict):
                kind, ref = e.get("kind"), e.get("reference")
            else:
                continue
            if not isinstance(kind, str) or not isinstance(ref, str) or not ref.strip():
                continue
            kind = kind.strip().lower()
            if kind == "record":
                refs.add(("evidence_json", "records", uid(ref)))
            elif kind in ("anchor:ticket", "anchor:diff", "anchor:trunk"):
                refs.add(("evidence_json", "anchor_facts", f"{kind}/{ref.strip().lower()}"))
        me = at[r["id"]]
        period = datetime.fromtimestamp(me // 1_000_000, timezone.utc).strftime("%Y-%m")
        for field, tab, key in refs:
            if tab == "records":
                st = ("deleted" if key in gone else "missing") if key not in at else "late" if at[key] > me else None
            elif key not in known:
                st = "missing"
            else:
                st = "deleted" if max(known[key])[1] else "late" if min(known[key])[0] > me else None
            if st:
                out.add((r["id"], field, tab, key, period, st))
    return out


def nodes(records):
    out = set()

    def go(v, ptr, up, rid, f):
        items = v.items() if isinstance(v, dict) else enumerate(v)
        for k, x in items:
            x = stand(x)
            p = ptr + "/" + str(k).replace("~", "~0").replace("/", "~1")
            case = isinstance(v, list) or isinstance(x, dict)
            if case:
                out.add((rid, f, p, up))
            if isinstance(x, (dict, list)):
                go(x, p, p if case else up, rid, f)

    for r in records:
        for f in ("payload_json", "evidence_json", "tags_json"):
            v, ok = jparse(r[f])
            if ok and isinstance(v, (dict, list)):
                go(v, "", "", r["id"], f)
    return out
