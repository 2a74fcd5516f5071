"""A plain-Python model of the reconciliation, written from its description and used as an oracle on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

NULLS = ("", "null", "none", "nan", "nat", "n/a", "na", "#n/a")


def canonical(v, normalise=True, places=6, digits=None):
    if v is None:
        return None
    s = v.strip()
    low = s.lower()
    if not normalise:
        return None if low in ("", "nan", "nat") else v
    if low in NULLS:
        return None
    if low in ("true", "yes", "y"):
        return "true"
    if low in ("false", "no", "n"):
        return "false"
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?", s)
    if m:
        base = f"{m[1]} {m[2]}"
        return f"{base}.{m[3][:digits].ljust(digits, '0')}" if digits and m[3] else base
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", s)
    if m and 1900 <= int(m[1]) <= 2100 and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31:
        return s
    if v != s:
        return v
    n = s.replace(",", "")
    try:
        if re.fullmatch(r"[+-]?\d+", n):
            return str(int(n))
        x = float(n)
        return str(int(x)) if x.is_integer() else str(round(x, places))
    except (ValueError, OverflowError):
        return v


def fuzzy_form(v):
    if v is None or v.strip().lower() in ("", "null", "none", "nan", "nat", "n/a", "na", "<null>"):
        return "NULL"
    t = re.sub(r"\s+", " ", re.sub(r"[/|\\]", " ", v.strip()))
    return re.sub(r"[_\-.()\[\]{}]", "", t).strip().upper()


def verdict(a, b, normalise=True, places=6):
    a, b = canonical(a, normalise, places), canonical(b, normalise, places)
    if a == b:
        return "EXACT", a, b
    if a is None or b is None:
        return "DIFFERENT", a, b
    try:
        x, y = float(a.replace(",", "")), float(b.replace(",", ""))
        near = abs(x - y) <= 100 or abs(x - y) / max(abs(x), abs(y), 1.0) <= 0.01
        return ("FUZZY_NUMERIC" if near else "DIFFERENT"), a, b
    except ValueError:
        pass
    s, t = fuzzy_form(a), fuzzy_form(b)
    if s == t:
        return "FUZZY_STRING", a, b
    if s and t and abs(len(s) - len(t)) <= max(2, min(len(s), len(t)) // 10):
        long, short = (s, t) if len(s) >= len(t) else (t, s)
        if short in long:
            return "FUZZY_STRING", a, b
    return "DIFFERENT", a, b


def reconcile(columns, source, target, keys, normalise=True, places=6):
    """Counter of discrepancies (7-tuples) of two lists of tuples."""
    norm = lambda rows: [[canonical(v, normalise, places) for v in r] for r in rows]
    ns, nt = norm(source), norm(target)

    def digest(row):
        again = [canonical(v, normalise, places) for v in row]
        return hashlib.sha256("\0".join("\1NULL" if v is None else v.lower() for v in again).encode()).hexdigest()[:32]

    hs, ht = [digest(r) for r in ns], [digest(r) for r in nt]
    at_s, at_t = defaultdict(list), defaultdict(list)
    for i, h in enumerate(hs):
        at_s[h].append(i)
    for i, h in enumerate(ht):
        at_t[h].append(i)
    out, used_s, used_t = Counter(), set(), set()
    for h in at_s.keys() & at_t.keys():
        n = min(len(at_s[h]), len(at_t[h]))
        used_s.update(at_s[h][:n])
        used_t.update(at_t[h][:n])
        if len(at_s[h]) != len(at_t[h]):
            out["DUPLICATE_COUNT_MISMATCH", f"HASH:{h[:16]}", "ALL", f"{len(at_s[h])} occurrences", f"{len(at_t[h])} occurrences", "N/A", "N/A"] += 1
    left = [i for i in range(len(source)) if i not in used_s]
    right = [i for i in range(len(target)) if i not in used_t]
    if not left and not right:
        return out
    place = {c: i for i, c in enumerate(columns)}
    show = lambda v: "NULL" if v is None else v
    key = lambda row: "||".join(f"{c}={show(row[place[c]])}" for c in keys)
    full = lambda row: "|".join(map(show, row))
    for side, groups, rows in (("SOURCE", at_s, ns), ("TARGET", at_t, nt)):
        for idx in groups.values():
            if len(idx) > 1:
                row = [canonical(v, normalise, places) for v in rows[idx[0]]]
                a, b = (full(row), "N/A") if side == "SOURCE" else ("N/A", full(row))
                out[f"DUPLICATE_IN_{side}", key(row), f"IDENTICAL_ROWS_COUNT={len(idx)}", a, b, a, b] += 1
    fold = lambda v: None if v is None else v.lower()
    score = lambda i, j: sum(fold(ns[i][place[c]]) == fold(nt[j][place[c]]) for c in columns if c not in keys)
    lookup = lambda row: "||".join(f"{c}={fuzzy_form(row[place[c]])}" for c in keys[:3])
    by_key, by_lookup = defaultdict(list), defaultdict(list)
    for j in right:
        by_key[key(nt[j])].append(j)
        by_lookup[lookup(nt[j])].append(j)
    claimed = set()
    for i in left:
        loose = {}
        found = [j for j in by_key.get(key(ns[i]), ()) if j not in claimed]
        is_fuzzy = not found
        if is_fuzzy:
            found = []
            for j in by_lookup.get(lookup(ns[i]), ()):
                if j not in claimed and all(verdict(ns[i][place[c]], nt[j][place[c]], normalise, places)[0] != "DIFFERENT" for c in keys):
                    found.append(j)
        if not found:
            out["MISSING_IN_TARGET", key(ns[i]), "ALL", full(source[i]), "ROW_NOT_FOUND", full(source[i]), "ROW_NOT_FOUND"] += 1
            continue
        j = max(found, key=lambda j: score(i, j))
        claimed.add(j)
        if is_fuzzy:
            loose = {c: v for c in keys if (v := verdict(ns[i][place[c]], nt[j][place[c]], normalise, places))[0] != "EXACT"}
        label = f"{key(ns[i])} ~> {key(nt[j])}" if is_fuzzy else key(ns[i])
        for c in columns:
            a, b = ns[i][place[c]], nt[j][place[c]]
            if c in loose:
                _, a, b = loose[c]
            elif a == b or (a is not None and b is not None and normalise and a.lower() == b.lower()):
                continue
            kind = "KEY_VALUE_MISMATCH" if c in keys else "VALUE_MISMATCH"
            out[kind, label, c, show(a), show(b), full(source[i]), full(target[j])] += 1
    for j in right:
        if j not in claimed:
            out["MISSING_IN_SOURCE", key(nt[j]), "ALL", "ROW_NOT_FOUND", full(target[j]), "ROW_NOT_FOUND", full(target[j])] += 1
    return out
