"""The filter, sort, group and update rules on plain Python documents."""

import functools
import re

MISSING = object()


def get(doc, path):
    for s in path.split("."):
        if not isinstance(doc, dict) or s not in doc:
            return MISSING
        doc = doc[s]
    return doc


def rank(v):
    if v is None:
        return 0
    if isinstance(v, bool):
        return 1
    if isinstance(v, (int, float)):
        return 2
    return 3 if isinstance(v, str) else None


def scalar_key(v):
    r = rank(v)
    return (r, float(v) if r in (1, 2) else v.encode() if r == 3 else 0)


def equal(v, x):
    if v is MISSING:
        return x is None
    if isinstance(v, list):
        return isinstance(x, list) and len(v) == len(x) and all(equal(a, b) for a, b in zip(v, x))
    if isinstance(v, dict):
        return isinstance(x, dict) and v.keys() == x.keys() and all(equal(v[k], x[k]) for k in v)
    return rank(x) is not None and scalar_key(v) == scalar_key(x)


def compare(op, v, x):
    if v is MISSING or rank(v) is None or rank(x) is None:
        return False
    a, b = scalar_key(v), scalar_key(x)
    return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]


def atom(v, op, x, options=""):
    if op == "$eq":
        return equal(v, x)
    if op == "$ne":
        return not equal(v, x)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return compare(op, v, x)
    if op == "$in":
        return any(equal(v, y) for y in x)
    if op == "$nin":
        return not any(equal(v, y) for y in x)
    if op == "$exists":
        return (v is not MISSING) == x
    if op == "$type":
        kinds = {0: "null", 1: "bool", 2: "number", 3: "string"}
        return v is not MISSING and x == ("array" if isinstance(v, list) else "object" if isinstance(v, dict) else kinds[rank(v)])
    if op == "$all":
        return isinstance(v, list) and all(any(equal(e, y) for e in v) for y in x)
    if op == "$elemMatch":
        return isinstance(v, list) and any(matches(e, x) for e in v)
    return isinstance(v, str) and bool(re.search(x, v, re.I if options else 0))


def matches(doc, filt):
    for key, x in filt.items():
        if key == "$and":
            ok = all(matches(doc, f) for f in x)
        elif key == "$or":
            ok = any(matches(doc, f) for f in x)
        elif key == "$not":
            ok = not matches(doc, x)
        elif isinstance(x, dict) and any(k.startswith("$") for k in x):
            ok = all(atom(get(doc, key), op, y, x.get("$options", "")) for op, y in x.items() if op != "$options")
        else:
            ok = equal(get(doc, key), x)
        if not ok:
            return False
    return True


def sort_key(v):
    return scalar_key(v) if v is not MISSING and rank(v) is not None else scalar_key(None)


def ordered(docs, sort):
    docs = sorted(docs, key=lambda d: d["_id"])
    for path, direction in reversed(sort):
        docs = sorted(docs, key=functools.partial(lambda p, d: sort_key(get(d, p)), path), reverse=False) if direction == 1 else sorted(docs[::-1], key=functools.partial(lambda p, d: sort_key(get(d, p)), path))[::-1]
    return docs
