"""find: filter, sort, page and project; index ranges; cursors.

Rows without a sort come in no order of their own, and a page of them is the first rows by `_id`. Sorts end with `_id`, so pages
are the same each time. A keyset page is a filter and a top-k; nothing is gathered but the page.
"""

from __future__ import annotations

import base64
import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.errors import BadQuery, LimitExceeded
from docloom.functions.values import NUMBER, Dynamic, Root, literal_key, millis, name, rank_of
from docloom.operators.aggregate import read_once
from docloom.plans import filters, projection

MOST_SORTS = 64


def directions(sort) -> list[tuple[str, bool]]:
    """(path, ascending) of a sort given as a path, a list of (path, 1 or -1), or a mapping."""
    if not sort:
        return []
    if isinstance(sort, str):
        sort = [(sort, 1)]
    own = [(p, d) for p, d in (sort.items() if isinstance(sort, dict) else sort)]
    if len(own) > MOST_SORTS or any(d not in (1, -1) for _, d in own):
        raise BadQuery("a sort has at most 64 paths, each 1 or -1")
    return [(p, d == 1) for p, d in own]


def order(sort, root: Root) -> list[Column]:
    """Nulls come first, or last going down; `_id` settles ties."""
    out = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in ((root.get(p).sort_column(), up) for p, up in directions(sort))]
    return out + ([name(root.id_column).asc()] if root.id_column in root.schema.names and "_id" not in [p for p, _ in directions(sort)] else [])


def find(df: DataFrame, filt=None, sort=None, project=None, skip: int = 0, limit: int = 0, root: Root | None = None, most_sorted: int | None = None) -> DataFrame:
    """limit 0: all. most_sorted: an error if more rows than this would be sorted."""
    root = root or Root(df.schema)
    node = filters.parse(filt)
    out = df if node == filters.All(()) else df.filter(filters.compile_filter(node, root))
    if skip < 0 or limit < 0:
        raise BadQuery("skip and limit are not negative")
    if sort and most_sorted is not None and out.limit(most_sorted + 1).count() > most_sorted:
        raise LimitExceeded(f"more than {most_sorted} rows to sort")
    if sort or skip or limit:
        out = out.orderBy(*order(sort, root))
    if skip:
        out = out.offset(skip)
    if limit:
        out = out.limit(limit)
    return projection.project(out, project, root)


def find_one(df: DataFrame, filt=None, sort=None, project=None, root: Root | None = None) -> DataFrame:
    return find(df, filt, sort, project, limit=1, root=root)


def find_first_id(df: DataFrame, filt=None, root: Root | None = None) -> DataFrame:
    """The lowest id of a match: one row, or none."""
    root = root or Root(df.schema)
    return df.filter(filters.compile_filter(filt, root)).select(name(root.id_column)).orderBy(name(root.id_column)).limit(1)


def find_ids(df: DataFrame, filt=None, most: int | None = None, root: Root | None = None) -> DataFrame:
    """The ids of all matches; an error if there are more than `most`."""
    root = root or Root(df.schema)
    out = df.filter(filters.compile_filter(filt, root)).select(name(root.id_column))
    if most is not None and out.limit(most + 1).count() > most:
        raise LimitExceeded(f"more than {most} matches")
    return out


def by_id(df: DataFrame, key, root: Root | None = None) -> DataFrame:
    root = root or Root(df.schema)
    return df.filter(name(root.id_column) == F.lit(key))


def _before(root: Root, keys: list[tuple[str, bool]], bound: list, inclusive: bool) -> Column:
    """Rows that come before the bound (a prefix of the keys) in index order."""
    steps, same = [], F.lit(True)
    for (path, up), x in zip(keys, bound):
        value = root.get(path)
        rank = rank_of(x)
        if isinstance(value, Dynamic) and rank == NUMBER:
            below, above, at = value.against(float(millis(x)))
            steps.append(same & (below if up else above))
            same = same & at
            continue
        plain = not isinstance(value, Dynamic) and rank is not None and rank == getattr(value, "rank", None) and rank
        a, b = value._against(x) if plain else (value.key(), literal_key(x))
        less = F.coalesce(a < b, F.lit(True)) if plain and up else F.coalesce(a > b, F.lit(False)) if plain else (a < b if up else a > b)
        steps.append(same & less)
        same = same & F.coalesce(a == b, F.lit(False))
    return reduce(or_, steps + ([same] if inclusive else []), F.lit(False))


def index_range(df: DataFrame, keys, lo: list | None = None, hi: list | None = None, limit: int = 0, ids_only: bool = False, root: Root | None = None, cursor: str | None = None, keyed: bool = False) -> DataFrame:
    """Rows from lo (inclusive) to hi (exclusive) in the order of the index keys; bounds may be prefixes.

    The bounds of a descending key are in index order: lo is the larger value. With `keyed` rows have `_sort`, from which
    cursor_after makes a token; with a token as `cursor` the range goes on after that row.
    """
    root, keys = root or Root(df.schema), directions(keys)
    if lo:
        df = df.filter(~_before(root, keys, lo, False))
    if hi:
        df = df.filter(_before(root, keys, hi, False))
    if cursor:
        df = df.filter(_after(root, keys, read_cursor(cursor)))
    if keyed:
        rows, values = read_once(df, root, [p for p, _ in keys])
        extra = [c for c in rows.columns if c not in df.columns]
        df = rows.withColumn("_sort", _sort_keys(values.__getitem__, keys))
    df = df.orderBy(*(_by_keys(root, keys) if keyed else order([(p, 1 if up else -1) for p, up in keys], root)))
    df = df.limit(limit) if limit else df
    df = df.drop(*extra) if keyed else df
    return df.select(name(root.id_column), *(["_sort"] if keyed else [])) if ids_only else df


def offset_cursor(offset: int, seq: int | None = None) -> str:
    """The token of the place after so many rows of a snapshot."""
    return base64.urlsafe_b64encode(json.dumps({"seq": seq, "offset": offset}).encode()).decode()


def offset_page(df: DataFrame, filt=None, sort=None, size: int = 100, cursor: str | None = None, root: Root | None = None, project=None) -> DataFrame:
    """The page at an offset's token; offset_cursor with `size` more gives the next."""
    at = read_cursor(cursor).get("offset") if cursor else 0
    if not isinstance(at, int) or at < 0:
        raise BadQuery("not an offset cursor")
    return find(df, filt, sort, project, at, size, root)


def _sort_keys(get, keys: list[tuple[str, bool]]) -> Column:
    return F.array(*[get(p).key() for p, _ in keys]) if keys else F.array().cast("array<struct<rank:tinyint,num:double,str:string>>")


def _by_keys(root: Root, keys: list[tuple[str, bool]]) -> list[Column]:
    """The order of order(), for VARIANT values by the keys that `_sort` holds already."""
    own = [F.get("_sort", F.lit(i)) if isinstance(root.get(p), Dynamic) else root.get(p).sort_column() for i, (p, _) in enumerate(keys)]
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, (_, up) in zip(own, keys)] + ([] if "_id" in [p for p, _ in keys] else order(None, root))


def _after(root: Root, own: list[tuple[str, bool]], at: dict) -> Column:
    """Rows after the place of a token, in the order of the sort and then `_id`."""
    steps, same = [], F.lit(True)
    if len(at.get("keys", ())) != len(own):
        raise BadQuery("the cursor is of another sort")
    for (path, up), (rank, num, text) in zip(own, at["keys"]):
        value = root.get(path)
        if isinstance(value, Dynamic) and rank == NUMBER:
            below, above, level = value.against(num)
            steps.append(same & (above if up else below))
            same = same & level
            continue
        key = root.get(path).key()
        bound = F.struct(F.lit(rank).cast("tinyint").alias("rank"), F.lit(num).cast("double").alias("num"), F.lit(text).cast("string").alias("str"))
        steps.append(same & (key > bound if up else key < bound))
        same = same & key.eqNullSafe(bound)
    return reduce(or_, [*steps, same & (name(root.id_column) > F.lit(at["id"]))])


def cursor_after(row, sort, root: Root, seq: int | None = None) -> str:
    """The token of the place after a row of the page, pinned to a snapshot's sequence number.

    The row has the sort keys as page() gives them.
    """
    return base64.urlsafe_b64encode(json.dumps({"seq": seq, "keys": [list(k) for k in row["_sort"]], "id": row[root.id_column]}).encode()).decode()


def read_cursor(token: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(token))
    except Exception as e:
        raise BadQuery("not a cursor") from e


def page(df: DataFrame, filt=None, sort=None, size: int = 100, cursor: str | None = None, root: Root | None = None) -> DataFrame:
    """The next page in sort order, with `_sort`, from which cursor_after makes the next token."""
    root, own = root or Root(df.schema), directions(sort)
    out = df.filter(filters.compile_filter(filt, root))
    if cursor:
        out = out.filter(_after(root, own, read_cursor(cursor)))
    out = out.withColumn("_sort", _sort_keys(root.get, own))
    return out.orderBy(*order(sort, root)).limit(size)
