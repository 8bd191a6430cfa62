"""An engine over an append-only changelog of Parquet files: collections, key-value pairs, transactions, change feeds.

A commit writes its rows to a staging folder and publishes them by one rename to changes/c=<seq>, for all collections
in it at once. Everything read is a filter over the changelog and the newest version of each key. One writer is
assumed. Expiry is judged by one time for each read.

The catalog is a series of numbered files, of which the last counts; each is written beside and renamed to a name that is
free. Compaction writes a base folder, publishes it by the next catalog, and only then deletes what the base stands
for; whoever stops in between leaves files that nobody reads. States and feeds from before the base are errors.
"""

from __future__ import annotations

import base64
import json
import time
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import AlreadyExists, BadQuery, BadUpdate, Conflict, DuplicateKey, LimitExceeded, NotFound
from docloom.functions.convert import new_id
from docloom.functions.values import Root
from docloom.operators import aggregate as A
from docloom.operators import find as Q
from docloom.operators import kv, nest, update, versions
from docloom.sources import files

CHANGES = T.StructType()
for _name, _kind in [("_id", T.StringType()), ("_seq", T.LongType()), ("_ord", T.LongType()), ("op", T.StringType()), ("body", T.VariantType()), ("_expires_at", T.LongType()), ("_ts", T.TimestampType()), ("key", T.BinaryType()), ("value", T.BinaryType()), ("c", T.LongType()), ("collection", T.StringType())]:
    CHANGES.add(_name, _kind)
ROW = ["_id", "op", "body", "_expires_at", "key", "value"]
KV = "_kv"
MOST_INDEX_FIELDS, MOST_BATCH, MOST_TX_OPS, TX_SECONDS, MOST_TX_BYTES = 64, 1024, 256, 30, 32 << 20
MOST_PROBED = 10_000  # versions that an index page holds against the last ones before it joins all
FORBIDDEN = {"find", "find_one", "find_ids", "update_one", "update_many", "delete_one", "delete_many", "count_documents", "distinct", "aggregate", "index_range", "create_index", "drop_collection"}


def now_ms() -> int:
    return int(time.time() * 1000)


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        files.make(spark, f"{self.path}/changes")
        files.make(spark, f"{self.path}/_catalog")
        found = files.versions(spark, f"{self.path}/_catalog")
        self.version = found[-1] if found else 0
        if found:
            self.catalog = json.loads(files.read_text(spark, f"{self.path}/_catalog/{self.version:012d}.json"))
        else:
            self.catalog = {"id": uuid.uuid4().hex, "collections": {}, "kept_from": 0, "kept_ordinals": {}, "base": None}
            self.save()

    def save(self) -> None:
        """The next version of the catalog; the one before stays, older ones go."""
        at = f"{self.path}/_catalog"
        if not files.publish(self.spark, at, self.version + 1, json.dumps(self.catalog)):
            raise Conflict("another writer has changed the catalog")
        self.version += 1
        for old in files.versions(self.spark, at):
            if old < self.version - 1:
                files.delete(self.spark, f"{at}/{old:012d}.json")

    def collection(self, name: str) -> Collection:
        if not name or "/" in name or name == KV:
            raise BadQuery(f"bad collection name {name!r}")
        if name not in self.catalog["collections"]:
            self.catalog["collections"][name] = {"indexes": []}
            self.save()
        return Collection(self, name)

    def drop_collection(self, name: str) -> None:
        """Its documents are deleted, its indexes go."""
        own = self.collection(name)
        own.delete_many({})
        del self.catalog["collections"][name]
        self.save()

    @property
    def pairs(self) -> KeyValueStore:
        return KeyValueStore(self)

    def transaction(self, seconds: float = TX_SECONDS) -> Transaction:
        return Transaction(self, seconds=seconds)

    def last_seq(self) -> int:
        return max(self._commits(), default=self.catalog["kept_from"])

    def _commits(self) -> list[int]:
        """Sequence numbers of the commits after the base, in order."""
        own = (int(n[2:]) for n in files.names(self.spark, f"{self.path}/changes") if n.startswith("c="))
        return sorted(c for c in own if c > self.catalog["kept_from"])

    def changes(self, collection: str | None = None) -> DataFrame:
        """The base's rows, with the base's place as `c`, and all commits after it."""
        out, base, mark = self.spark.read.schema(CHANGES).option("basePath", f"{self.path}/changes").parquet(f"{self.path}/changes"), self.catalog["base"], self.catalog["kept_from"]
        if base:
            own = T.StructType([f for f in CHANGES if f.name != "c"])
            kept = self.spark.read.schema(own).parquet(f"{self.path}/base/{base}").withColumn("c", F.lit(mark).cast("bigint"))
            out = kept.select(*CHANGES.names).unionByName(out.filter(F.col("c") > mark))
        return out.filter(F.col("collection") == collection) if collection is not None else out

    def commit(self, parts: dict[str, DataFrame]) -> int:
        """Rows of ROW's columns by collection, published together; returns their sequence number."""
        return self._publish(*self._stage(parts))

    def commit_some(self, parts: dict[str, DataFrame]) -> tuple[int, int]:
        """As commit(), but no rows make no commit; returns the sequence number (or 0) and how many rows there are.

        They are worked out once, and counted by the staged files' footers.
        """
        seq, staging = self._stage(parts)
        n = self.spark.read.schema(T.StructType([f for f in CHANGES if f.name != "c"])).parquet(staging).count()
        if n:
            return self._publish(seq, staging), n
        files.delete(self.spark, staging)
        return 0, 0

    def _stage(self, parts: dict[str, DataFrame]) -> tuple[int, str]:
        seq, staging = self.last_seq() + 1, f"{self.path}/staging/{uuid.uuid4().hex}"
        for name, rows in parts.items():
            have = {f.name for f in rows.schema}
            own = rows.select(*[F.col(c) if c in have else F.lit(None).cast(CHANGES[c].dataType).alias(c) for c in ROW])
            own = own.withColumns({"_seq": F.lit(seq).cast("bigint"), "_ord": F.monotonically_increasing_id(), "_ts": F.current_timestamp(), "_expires_at": F.coalesce("_expires_at", F.lit(0)).cast("bigint")})
            own.select(*[c.name for c in CHANGES if c.name not in ("c", "collection")]).write.parquet(f"{staging}/collection={name}")
        return seq, staging

    def _publish(self, seq: int, staging: str) -> int:
        if not files.rename(self.spark, staging, f"{self.path}/changes/c={seq:020d}"):
            files.delete(self.spark, staging)
            raise Conflict("another commit has this sequence number")
        return seq

    def readable(self, seq: int | None) -> int | None:
        """The sequence number, if the state there is still whole."""
        if seq is not None and seq < self.catalog["kept_from"]:
            raise Conflict(f"the state at {seq} is gone: what is kept begins at {self.catalog['kept_from']}")
        return seq

    def seq_at(self, when) -> int:
        """The sequence number that restores the state at a time; 0 if that was before the first commit."""
        return versions.seq_at(self.changes(), when).first()["seq"] or 0

    def snapshot_to(self, path: str, seq: int | None = None) -> int:
        """A copy of the state at a sequence number, as an engine of its own with one commit."""
        seq = self.last_seq() if seq is None else self.readable(seq)
        other = Engine(self.spark, path)
        parts = {n: versions.snapshot(self.changes(n), seq, now_ms()) for n in [*self.catalog["collections"], KV]}
        other.catalog["collections"] = json.loads(json.dumps(self.catalog["collections"]))
        other.save()
        other.commit(parts)
        return seq

    restore_to = snapshot_to

    def compact(self, watermark: int | None = None) -> None:
        """Older versions, deletes and expired documents up to the watermark go; feeds can resume after it only."""
        mark = min(self.last_seq(), self.last_seq() if watermark is None else watermark)
        old = self.catalog["base"]
        if mark <= self.catalog["kept_from"]:
            return
        seen = self.changes().filter(F.col("c") <= mark)
        ends = seen.filter(F.col("_seq") == mark).groupBy("collection").agg(F.max("_ord").alias("n")).collect()
        kept = versions.newest(seen, ["collection", "_id"]).filter("op <> 'delete'").filter(versions.alive(now_ms()))
        base = uuid.uuid4().hex
        kept.select(*[c for c in CHANGES.names if c != "c"]).write.partitionBy("collection").parquet(f"{self.path}/base/{base}")
        self.catalog = {**self.catalog, "base": base, "kept_from": mark, "kept_ordinals": {r["collection"]: r["n"] for r in ends}}
        self.save()  # from here on the base counts
        for n in files.names(self.spark, f"{self.path}/changes"):
            if n.startswith("c=") and int(n[2:]) <= mark:
                files.delete(self.spark, f"{self.path}/changes/{n}")
        for n in files.names(self.spark, f"{self.path}/base"):
            if n != base:
                files.delete(self.spark, f"{self.path}/base/{n}")

    def retain(self, most_age_ms: int | None = None, most_bytes: int | None = None, now: int | None = None) -> None:
        """Compacts the oldest commits, so that those kept for feeds are younger and together smaller than this."""
        commits, mark, size = self._commits(), self.catalog["kept_from"], 0
        if most_bytes is not None:
            for c in reversed(commits):
                size += files.size(self.spark, f"{self.path}/changes/c={c:020d}")
                if size > most_bytes:
                    mark = max(mark, c)
                    break
        if most_age_ms is not None:
            cut = (now_ms() if now is None else now) - most_age_ms
            old = self.changes().filter((F.col("c") > self.catalog["kept_from"]) & (F.unix_millis("_ts") < cut)).agg(F.max("c")).first()[0]
            mark = max(mark, old or 0)
        if mark > self.catalog["kept_from"]:
            self.compact(mark)

    def drop_tenant(self, prefix: str) -> None:
        """Every collection and pair whose name or key starts with the prefix."""
        for name in [n for n in self.catalog["collections"] if n.startswith(prefix)]:
            self.drop_collection(name)
        self.pairs.delete_prefix(prefix.encode())

    def stats(self) -> DataFrame:
        out = versions.newest(self.changes().withColumn("_k", F.concat_ws("\0", "collection", "_id")), "_k", ["_seq", "_ord"])
        return out.filter("op <> 'delete'").filter(versions.alive(now_ms())).groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.max("_seq").alias("last_seq"))

    def ping(self) -> bool:
        return files.exists(self.spark, self.path)


@dataclass
class Token:
    """A place in a collection's change feed."""

    engine: str
    collection: str
    seq: int
    ordinal: int = -1

    def encode(self) -> str:
        body = json.dumps([1, self.engine, self.collection, self.seq, self.ordinal]).encode()
        return base64.urlsafe_b64encode(zlib.crc32(body).to_bytes(4, "big") + body).decode()

    @staticmethod
    def decode(text: str) -> Token:
        try:
            raw = base64.urlsafe_b64decode(text)
            if zlib.crc32(raw[4:]).to_bytes(4, "big") != raw[:4]:
                raise ValueError
            version, *rest = json.loads(raw[4:])
            if version != 1:
                raise ValueError
            return Token(*rest)
        except Exception as e:
            raise BadQuery("not a resume token") from e


class Collection:
    def __init__(self, engine: Engine, name: str):
        self.engine, self.name, self.spark = engine, name, engine.spark
        self.root = Root(T.StructType.fromDDL("_id STRING, body VARIANT, _rev BIGINT, _expires_at BIGINT"), "_id", "body")

    @property
    def indexes(self) -> list[dict]:
        return self.engine.catalog["collections"][self.name]["indexes"]

    # --- reads

    def state(self, seq: int | None = None, now: int | None = None, ids: list[str] | None = None) -> DataFrame:
        """_id, body, _rev, _expires_at of the documents visible at a sequence number; of those with the ids, if there is a list."""
        own = self.engine.changes(self.name)
        own = versions.snapshot(own if ids is None else own.filter(self._among(ids)), self.engine.readable(seq), now_ms() if now is None else now)
        return own.select("_id", "body", F.col("_seq").alias("_rev"), "_expires_at")

    def find(self, filt=None, sort=None, projection=None, skip: int = 0, limit: int = 0, seq: int | None = None) -> DataFrame:
        return Q.find(self.state(seq), filt, sort, projection, skip, limit, self.root).drop("_rev", "_expires_at")

    def find_with_revision(self, filt=None, sort=None, projection=None, skip: int = 0, limit: int = 0) -> DataFrame:
        return Q.find(self.state(), filt, sort, projection, skip, limit, self.root).drop("_expires_at")

    def find_one(self, filt=None, sort=None) -> dict | None:
        return next(iter(self._documents(self.find(filt, sort, limit=1))), None)

    def get(self, key: str) -> dict | None:
        return next(iter(self._documents(Q.by_id(self.state(), key, self.root))), None)

    def get_with_revision(self, key: str) -> tuple[dict, int] | None:
        rows = Q.by_id(self.state(), key, self.root).select(F.to_json("body").alias("j"), "_rev").collect()
        return (json.loads(rows[0]["j"]), rows[0]["_rev"]) if rows else None

    @staticmethod
    def _documents(df: DataFrame):
        return (json.loads(r["j"]) for r in df.select(F.to_json("body").alias("j")).toLocalIterator())

    def iterate(self, filt=None, sort=None, projection=None):
        """The documents one by one, a partition at a time."""
        return self._documents(self.find(filt, sort, projection))

    def page(self, filt=None, sort=None, size: int = 100, cursor: str | None = None) -> tuple[list, str | None]:
        """Documents and the next cursor, which keeps to the first page's snapshot."""
        seq = Q.read_cursor(cursor)["seq"] if cursor else self.engine.last_seq()
        own = Q.page(self.state(seq), filt, sort, size, cursor, self.root)
        rows = own.select("_id", "_sort", F.to_json("body").alias("j")).collect()
        return [json.loads(r["j"]) for r in rows], Q.cursor_after(rows[-1], sort, self.root, seq) if len(rows) == size else None

    def offset_page(self, filt=None, sort=None, size: int = 100, cursor: str | None = None) -> tuple[list, str | None]:
        """As page(), with a token that counts rows of the first page's snapshot."""
        at = Q.read_cursor(cursor) if cursor else {"seq": self.engine.last_seq(), "offset": 0}
        own = Q.offset_page(self.state(at["seq"]), filt, sort, size, cursor, self.root)
        found = list(self._documents(own))
        return found, Q.offset_cursor(at["offset"] + size, at["seq"]) if len(found) == size else None

    def find_first_id(self, filt=None) -> str | None:
        row = Q.find_first_id(self.state(), filt, self.root).first()
        return row[0] if row else None

    def index_page(self, index: str, lo=None, hi=None, size: int = 100, cursor: str | None = None) -> tuple[list, str | None]:
        """The ids of an index range by pages, and the next token, which keeps to the first page's snapshot."""
        seq = Q.read_cursor(cursor)["seq"] if cursor else self.engine.last_seq()
        keys = [tuple(f) for f in self._index(index)["fields"]]
        rows = self._probed(seq, keys, lo, hi, size, cursor)
        if rows is None:
            rows = Q.index_range(self.state(seq), keys, lo, hi, size, True, self.root, cursor, True).collect()
        return [r["_id"] for r in rows], Q.cursor_after(rows[-1], None, self.root, seq) if len(rows) == size else None

    @staticmethod
    def _among(ids: list) -> Column:
        own = F.col("_id").isin([i for i in ids if i is not None])
        return own | F.col("_id").isNull() if None in ids else own

    def _probed(self, seq: int, keys: list, lo, hi, size: int, cursor: str | None) -> list | None:
        """The rows of an index page without a join of all versions; None if it takes more than MOST_PROBED.

        The first versions in the range are held against the last ones of their documents; if too few are the last, or there
        are more in the range, it is done with more of them.
        """
        seen = self.engine.changes(self.name).filter(F.col("_seq") <= self.engine.readable(seq))
        shown = seen.filter("op <> 'delete'").filter(versions.alive(now_ms()))
        n = 2 * size + 16
        while 0 < size and n <= MOST_PROBED:
            found = Q.index_range(shown, keys, lo, hi, n, root=self.root, cursor=cursor, keyed=True).select("_id", "_sort", "_seq", "_ord").collect()
            last = seen.filter(self._among(list({r["_id"] for r in found}))).groupBy("_id").agg(F.max(F.struct("_seq", "_ord")).alias("at"))
            last = {r["_id"]: tuple(r["at"]) for r in last.collect()} if found else {}
            rows = [r for r in found if (r["_seq"], r["_ord"]) == last[r["_id"]]]
            if len(rows) >= size or len(found) < n:
                return rows[:size]
            n *= 8
        return None

    def _index(self, index: str) -> dict:
        own = next((i for i in self.indexes if i["name"] == index), None)
        if own is None:
            raise NotFound(f"no index {index!r}")
        return own

    def index_range(self, index: str, lo=None, hi=None, limit: int = 0, ids_only: bool = False) -> DataFrame:
        return Q.index_range(self.state(), [tuple(f) for f in self._index(index)["fields"]], lo, hi, limit, ids_only, self.root)

    def count_documents(self, filt=None) -> int:
        return A.count(self.state(), filt, self.root).first()["n"]

    def distinct(self, path: str, filt=None) -> DataFrame:
        return A.distinct(self.state(), path, filt, self.root)

    def aggregate(self, pipeline, limits: A.Limits = A.Limits()) -> DataFrame:
        return A.aggregate(self.state(), pipeline, self.root, limits)

    # --- writes

    def _rows(self, documents: list[dict], expires_at: int = 0) -> DataFrame:
        if not documents:
            raise BadUpdate("no documents")
        fresh = None
        made = []
        for d in documents:
            if not isinstance(d, dict):
                raise BadUpdate("a document is an object")
            if "_id" not in d:
                fresh = fresh or iter([r["i"] for r in self.spark.range(len(documents)).select(new_id().alias("i")).collect()])
                d = {"_id": next(fresh), **d}
            made.append((str(d["_id"]), json.dumps(d), expires_at))
        if len({m[0] for m in made}) < len(made):
            raise DuplicateKey("two documents have one _id")
        df = self.spark.createDataFrame(made, "_id string, j string, _expires_at bigint")
        return df.select("_id", F.lit("upsert").alias("op"), F.parse_json("j").alias("body"), "_expires_at")

    def write(self, rows: DataFrame, check: bool = True) -> int:
        """Upserts and deletes (`op`) by `_id`; expiry by the TTL index; unique indexes hold over the final state."""
        return self.engine.commit({self.name: self._checked(rows, check)})

    def _checked(self, rows: DataFrame, check: bool = True) -> DataFrame:
        rows = self._expiring(rows)
        if check and any(i["unique"] for i in self.indexes):
            self._check_unique(rows)
        return rows

    def _expiring(self, rows: DataFrame) -> DataFrame:
        ttl = next((i for i in self.indexes if i.get("ttl") is not None), None)
        if "_expires_at" not in rows.columns:
            rows = rows.withColumn("_expires_at", F.lit(0).cast("bigint"))
        if ttl is None:
            return rows
        value = self.root.get(ttl["fields"][0][0])
        return rows.withColumn("_expires_at", versions.derived_expiry(F.when(value.is_type("number"), value.number()), ttl["ttl"]))

    def _check_unique(self, rows: DataFrame) -> None:
        """The written documents' keys are looked up among the others; keys that no one writes aren't grouped."""
        new = rows.filter("op = 'upsert'").select("_id", "body")
        old = self.state().join(rows.select("_id"), "_id", "left_anti").select("_id", "body")
        for i in self.indexes:
            if i["unique"]:
                paths = [f[0] for f in i["fields"]]
                probe = F.xxhash64(*[self.root.get(p).key() for p in paths])  # equal keys have equal hashes; others don't matter
                met = old.withColumn("_probe", probe).join(new.select(probe.alias("_probe")).distinct(), "_probe", "left_semi").drop("_probe")
                if not nest.unique_violations(met.unionByName(new), paths, self.root).isEmpty():
                    raise DuplicateKey(f"index {i['name']}")

    def insert_one(self, document: dict, expires_at: int = 0) -> str:
        return self.insert_many([document], expires_at)[0]

    def insert_many(self, documents: list[dict], expires_at: int = 0) -> list[str]:
        rows = self._rows(documents, expires_at).cache()
        try:
            self.write(rows)
            return [r["_id"] for r in rows.select("_id").collect()]
        finally:
            rows.unpersist()

    def insert_table(self, df: DataFrame, id_column: str = "_id") -> int:
        """A table's rows as documents, ids from one of its columns."""
        columns = [F.col(c) for c in df.columns if c != id_column]
        body = F.to_variant_object(F.struct(F.col(id_column).cast("string").alias("_id"), *columns))
        return self.write(df.select(F.col(id_column).cast("string").alias("_id"), F.lit("upsert").alias("op"), body.alias("body")))

    def replace_one(self, key: str, document: dict, expires_at: int = 0) -> int:
        return self.write(self._rows([{**document, "_id": key}], expires_at))

    def _revision(self, key: str) -> int | None:
        row = Q.by_id(self.state(), key, self.root).select("_rev").first()
        return row["_rev"] if row else None

    def replace_one_if_match(self, key: str, revision: int, document: dict) -> int:
        if self._revision(key) != revision:
            raise Conflict(f"{key!r} is not at revision {revision}")
        return self.replace_one(key, document)

    def update_by_id_if_match(self, key: str, revision: int, change: dict) -> int:
        if self._revision(key) != revision:
            raise Conflict(f"{key!r} is not at revision {revision}")
        self.update_one({"_id": key}, change)
        return self.engine.last_seq()

    def _update(self, filt, change, one: bool, upsert: bool) -> dict:
        own = update.update(self.state().select("_id", "body"), filt, change, one, upsert, root=self.root)
        rows = own.changed.select("_id", F.lit("upsert").alias("op"), "body")
        if own.upserted_id is not None:
            rows = rows.withColumn("body", self._with_id())
        _, n = self.engine.commit_some({self.name: self._checked(rows)})
        return {"matched": 0, "modified": 0, "upserted_id": own.upserted_id} if own.upserted_id is not None else {"matched": n, "modified": n}

    @staticmethod
    def _with_id() -> Column:
        fields = F.try_variant_get("body", "$", "map<string,variant>")
        own = F.variant_get(F.to_variant_object(F.struct(F.col("_id").alias("v"))), "$.v", "variant")
        return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: k != "_id"), F.create_map(F.lit("_id"), own)))

    def update_one(self, filt, change, upsert: bool = False) -> dict:
        return self._update(filt, change, True, upsert)

    def update_many(self, filt, change, upsert: bool = False) -> dict:
        return self._update(filt, change, False, upsert)

    def _delete(self, filt, one: bool) -> int:
        gone = update.delete(self.state().select("_id", "body"), filt, one, self.root).changed.select("_id", F.lit("delete").alias("op"))
        return self.engine.commit_some({self.name: gone})[1]

    def delete_one(self, filt) -> int:
        return self._delete(filt, True)

    def delete_many(self, filt) -> int:
        return self._delete(filt, False)

    def delete(self, key: str) -> bool:
        return bool(self._delete({"_id": key}, True))

    # --- indexes

    def create_index(self, fields, unique: bool = False, name: str | None = None, expire_after_seconds: int | None = None) -> str:
        own = [(p, 1 if up else -1) for p, up in Q.directions([(f, 1) if isinstance(f, str) else f for f in ([fields] if isinstance(fields, str) else fields)])]
        if not 1 <= len(own) <= MOST_INDEX_FIELDS:
            raise BadQuery(f"an index has 1 to {MOST_INDEX_FIELDS} fields")
        name = name or "by_" + "_".join(p for p, _ in own)
        if any(i["name"] == name for i in self.indexes):
            raise AlreadyExists(name)
        if expire_after_seconds is not None and (len(own) != 1 or any(i.get("ttl") is not None for i in self.indexes)):
            raise BadQuery("a collection has one TTL index, of one field")
        index = {"name": name, "fields": own, "unique": unique, "ttl": expire_after_seconds}
        if unique and not nest.unique_violations(self.state(), [p for p, _ in own], self.root).isEmpty():
            raise DuplicateKey(f"index {name}")
        self.indexes.append(index)
        self.engine.save()
        if expire_after_seconds is not None:
            self.engine.commit_some({self.name: self._checked(self.state().select("_id", F.lit("upsert").alias("op"), "body"), check=False)})
        return name

    # --- change feed

    def token(self) -> str:
        """After everything so far."""
        return Token(self.engine.catalog["id"], self.name, self.engine.last_seq(), (1 << 62)).encode()

    def _after_token(self, token: str) -> Token:
        own = Token.decode(token)
        if (own.engine, own.collection) != (self.engine.catalog["id"], self.name):
            raise BadQuery("the token is of another collection")
        kept = self.engine.catalog
        if own.seq < kept["kept_from"] or (own.seq == kept["kept_from"] and own.ordinal < kept["kept_ordinals"].get(self.name, -1)):
            raise Conflict("the feed no longer reaches back to the token")
        return own

    def changes_since(self, token: str) -> DataFrame:
        """The events strictly after the token, in order, each with its own token."""
        own = self._after_token(token)
        return versions.changes_after(self.engine.changes(self.name).filter(F.col("c") >= own.seq), own.seq, own.ordinal).select("_seq", "_ord", "op", "_id", "body")

    def event_token(self, row) -> str:
        return Token(self.engine.catalog["id"], self.name, row["_seq"], row["_ord"]).encode()


class KeyValueStore:
    """Binary keys and values with expiry."""

    def __init__(self, engine: Engine):
        self.engine, self.spark = engine, engine.spark

    def state(self, seq: int | None = None) -> DataFrame:
        own = versions.snapshot(self.engine.changes(KV), self.engine.readable(seq), now_ms())
        return own.select("key", "value", "_expires_at", "_seq")

    def write_batch(self, ops: list[tuple]) -> int:
        """("put", key, value[, expires_at]) and ("del", key), all at once; no key twice."""
        if not ops or len(ops) > MOST_BATCH:
            raise LimitExceeded(f"a batch has 1 to {MOST_BATCH} operations")
        if len({o[1] for o in ops}) < len(ops):
            raise DuplicateKey("a key is twice in the batch")
        rows = [(o[1].hex(), "delete" if o[0] == "del" else "upsert", (o[3] if len(o) > 3 else 0) if o[0] == "put" else 0, bytearray(o[1]), bytearray(o[2]) if o[0] == "put" else None) for o in ops]
        return self.engine.commit({KV: self.spark.createDataFrame(rows, "_id string, op string, _expires_at bigint, key binary, value binary")})

    def put(self, key: bytes, value: bytes, expires_at: int = 0) -> int:
        return self.write_batch([("put", key, value, expires_at)])

    def get(self, key: bytes) -> bytes | None:
        row = kv.get(self.state(), key).first()
        return bytes(row["value"]) if row else None

    def delete(self, key: bytes) -> bool:
        found = self.get(key) is not None
        if found:
            self.write_batch([("del", key)])
        return found

    def scan(self, lo: bytes = b"", hi: bytes = b"") -> DataFrame:
        return kv.scan(self.state(), lo, hi).orderBy("key")

    def prefix_scan(self, prefix: bytes) -> DataFrame:
        return kv.prefix_scan(self.state(), prefix).orderBy("key")

    def delete_prefix(self, prefix: bytes) -> int:
        gone = kv.prefix_scan(self.state(), prefix).select(F.lower(F.hex("key")).alias("_id"), F.lit("delete").alias("op"), "key")
        return self.engine.commit_some({KV: gone})[0]

    def usage(self) -> DataFrame:
        return kv.tenant_usage(self.state())


@dataclass
class Transaction:
    """Staged writes that see themselves, over the state at the start; all or none of them are committed."""

    engine: Engine
    staged: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)
    read: dict = field(default_factory=dict)
    done: bool = False
    seconds: float = TX_SECONDS  # from the first call to the last staged write

    def __post_init__(self):
        self.seq, self.began = self.engine.last_seq(), time.monotonic()

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.done:
            self.rollback() if kind else self.commit()

    def _step(self) -> None:
        if self.done:
            raise Conflict("the transaction has ended")
        if time.monotonic() - self.began > self.seconds or len(self.staged) + len(self.pairs) >= MOST_TX_OPS or self._bytes() > MOST_TX_BYTES:
            raise LimitExceeded("the transaction is too long or too large")

    def _bytes(self) -> int:
        return sum(len(json.dumps(d)) for d in self.staged.values()) + sum(len(k) + len(o[2] if o[0] == "put" else b"") for k, o in self.pairs.items())

    def __getattr__(self, called: str):
        """What works on whole collections isn't part of a transaction."""
        if called in FORBIDDEN:
            raise BadQuery(f"{called} can't be called in a transaction")
        raise AttributeError(called)

    def put_document(self, collection: str, document: dict, if_revision: int | None = None) -> str:
        self._step()
        own = self.engine.collection(collection)
        if "_id" not in document:
            document = {"_id": self.engine.spark.range(1).select(new_id().alias("i")).first()["i"], **document}
        key = str(document["_id"])
        self._note(own, key, if_revision)
        self.staged[collection, key] = document
        return key

    def delete_document(self, collection: str, key: str) -> None:
        self._step()
        self._note(self.engine.collection(collection), key, None)
        self.staged[collection, key] = None

    def _note(self, own: Collection, key: str, if_revision: int | None) -> None:
        if (own.name, key) not in self.read:
            row = Q.by_id(own.state(self.seq), key, own.root).select("_rev").first()
            self.read[own.name, key] = row["_rev"] if row else None
        if if_revision is not None and self.read[own.name, key] != if_revision:
            raise Conflict(f"{key!r} is not at revision {if_revision}")

    def get_document(self, collection: str, key: str) -> dict | None:
        """The staged document, or that of the start."""
        if (collection, key) in self.staged:
            return self.staged[collection, key]
        own = self.engine.collection(collection)
        rows = Q.by_id(own.state(self.seq), key, own.root).select(F.to_json("body").alias("j")).collect()
        return json.loads(rows[0]["j"]) if rows else None

    def put(self, key: bytes, value: bytes, expires_at: int = 0) -> None:
        self._step()
        self.pairs[key] = ("put", key, value, expires_at)

    def delete(self, key: bytes) -> None:
        self._step()
        self.pairs[key] = ("del", key)

    def get(self, key: bytes) -> bytes | None:
        if key in self.pairs:
            return self.pairs[key][2] if self.pairs[key][0] == "put" else None
        row = kv.get(self.engine.pairs.state(self.seq), key).first()
        return bytes(row["value"]) if row else None

    def rollback(self) -> None:
        self.staged, self.pairs, self.done = {}, {}, True

    def commit(self) -> int | None:
        """Revisions must be those of the start, unique indexes hold over the final state."""
        if self.done:
            raise Conflict("the transaction has ended")
        self.done = True
        if not self.staged and not self.pairs:
            return None
        spark, parts = self.engine.spark, {}
        for name in {c for c, _ in self.staged}:
            own = self.engine.collection(name)
            docs = {k: d for (c, k), d in self.staged.items() if c == name}
            now = {r["_id"]: r["_rev"] for r in own.state().filter(F.col("_id").isin(list(docs))).select("_id", "_rev").collect()}
            for key in docs:
                if now.get(key) != self.read[name, key]:
                    raise Conflict(f"{key!r} has changed since the transaction began")
            made = [(k, "delete" if d is None else "upsert", None if d is None else json.dumps({**d, "_id": k})) for k, d in docs.items()]
            rows = own._expiring(spark.createDataFrame(made, "_id string, op string, j string").select("_id", "op", F.parse_json("j").alias("body")))
            own._check_unique(rows)
            parts[name] = rows
        if self.pairs:
            keys = {r["_id"] for r in self.engine.changes(KV).filter((F.col("c") > self.seq) & F.col("_id").isin([k.hex() for k in self.pairs])).select("_id").collect()}
            if keys:
                raise Conflict("a pair has changed since the transaction began")
            rows = [(k.hex(), "delete" if o[0] == "del" else "upsert", o[3] if o[0] == "put" else 0, bytearray(k), bytearray(o[2]) if o[0] == "put" else None) for k, o in self.pairs.items()]
            parts[KV] = spark.createDataFrame(rows, "_id string, op string, _expires_at bigint, key binary, value binary")
        return self.engine.commit(parts)
