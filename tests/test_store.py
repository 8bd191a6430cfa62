import json

import pytest
from pyspark.sql import functions as F

from docloom.errors import AlreadyExists, BadQuery, BadUpdate, Conflict, DuplicateKey, LimitExceeded, NotFound
from docloom.sources import files, store
from docloom.sources.store import Engine, Token, now_ms
from docloom.streaming.watch import watch


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


BOATS = [{"_id": f"boat{i}", "mast": m, "crew": c, "port": p} for i, (m, c, p) in enumerate([(2, 11, "Kiel"), (1, 3, "Brest"), (3, 24, "Kiel"), (1, 4, "Cork"), (2, 9, "Brest"), (1, 2, "Cork")])]


@pytest.fixture
def boats(engine):
    own = engine.collection("boats")
    own.insert_many(BOATS)
    return own


def keys(df):
    return [r["_id"] for r in df.select("_id").collect()]


def bodies(df):
    return [json.loads(r["j"]) for r in df.select(F.to_json("body").alias("j")).collect()]


def test_finding(boats):
    assert keys(boats.find({"port": "Cork"}, [("crew", -1)])) == ["boat3", "boat5"]
    assert keys(boats.find({"crew": {"$lt": 10}, "mast": 1}, [("crew", 1)])) == ["boat5", "boat1", "boat3"]
    assert bodies(boats.find({}, [("crew", 1)], ["port"], skip=3, limit=1)) == [{"_id": "boat4", "port": "Brest"}]
    assert boats.find_one({"mast": 3})["crew"] == 24 and boats.get("boat9") is None and boats.find_first_id({"mast": 2}) == "boat0"
    assert boats.find_first_id({"mast": 9}) is None and [b["_id"] for b in boats.iterate({"port": "Kiel"}, [("crew", 1)])] == ["boat0", "boat2"]


def test_pages_keep_to_their_snapshot(boats):
    first, cursor = boats.page({}, [("mast", 1), ("crew", 1)], 4)
    counted, offset = boats.offset_page({}, [("mast", 1), ("crew", 1)], 4)
    boats.insert_one({"_id": "late", "mast": 2, "crew": 10, "port": "Cork"})
    boats.delete("boat2")
    second, end = boats.page({}, [("mast", 1), ("crew", 1)], 4, cursor)
    rest, last = boats.offset_page({}, [("mast", 1), ("crew", 1)], 4, offset)
    assert [b["_id"] for b in first + second] == ["boat5", "boat1", "boat3", "boat4", "boat0", "boat2"] == [b["_id"] for b in counted + rest] and end is last is None
    boats.engine.compact()
    with pytest.raises(Conflict):
        boats.page({}, [("mast", 1), ("crew", 1)], 4, cursor)
    with pytest.raises(BadQuery):
        boats.page({}, [("mast", 1)], 4, boats.page({}, None, 2)[1])


def test_writing(boats):
    assert boats.delete_many({"mast": 1}) == 3 and boats.count_documents() == 3 and not boats.delete("boat1")
    assert boats.update_many({"port": "Kiel"}, {"$inc": {"crew": 1}, "$push": {"log": {"at": "dock"}}, "$unset": {"mast": 1}})["modified"] == 2
    assert boats.get("boat2") == {"_id": "boat2", "crew": 25, "port": "Kiel", "log": [{"at": "dock"}]}
    assert boats.update_many({"port": "Oslo"}, {"$set": {"crew": 0}}) == {"matched": 0, "modified": 0}
    with pytest.raises(BadUpdate):
        boats.update_one({}, {"crew": 1})


def test_upserts(boats):
    made = boats.update_one({"port": "Riga"}, {"$set": {"crew": 6}, "$setOnInsert": {"mast": 4}}, upsert=True)
    assert made["matched"] == 0 and boats.get(made["upserted_id"]) == {"_id": made["upserted_id"], "port": "Riga", "crew": 6, "mast": 4}
    assert boats.update_one({"port": "Riga"}, {"$inc": {"crew": 2}, "$setOnInsert": {"mast": 9}}, upsert=True) == {"matched": 1, "modified": 1}
    assert boats.get(made["upserted_id"])["crew"] == 8 and boats.get(made["upserted_id"])["mast"] == 4
    assert boats.update_one({"_id": "raft", "port": "Nice"}, {"$set": {"crew": 1}}, upsert=True)["upserted_id"] == "raft"


def test_revisions(boats):
    _, rev = boats.get_with_revision("boat4")
    new = boats.replace_one_if_match("boat4", rev, {"crew": 1})
    with pytest.raises(Conflict):
        boats.replace_one_if_match("boat4", rev, {"crew": 2})
    assert boats.update_by_id_if_match("boat4", new, {"$inc": {"crew": 5}}) > new and boats.get("boat4") == {"_id": "boat4", "crew": 6}
    with pytest.raises(Conflict):
        boats.update_by_id_if_match("boat4", new, {"$inc": {"crew": 5}})
    assert {r["_id"]: r["_rev"] for r in boats.find_with_revision({"crew": {"$in": [3, 6]}}).collect()} == {"boat1": rev, "boat4": new + 1}


def test_unique_indexes(boats, engine):
    assert boats.create_index("crew", unique=True) == "by_crew"
    with pytest.raises(AlreadyExists):
        boats.create_index("crew")
    for clash in (lambda: boats.insert_one({"_id": "x", "crew": 24.0}), lambda: boats.update_many({"port": "Cork"}, {"$set": {"crew": 50}}), lambda: boats.insert_many([{"crew": 70}, {"crew": 70}]), lambda: boats.create_index("port", unique=True)):
        with pytest.raises(DuplicateKey):
            clash()
    boats.replace_one("boat2", {"crew": 24, "port": "Bonn"})
    boats.insert_one({"_id": "x", "crew": 25})
    assert [i["name"] for i in Engine(engine.spark, engine.path).collection("boats").indexes] == ["by_crew"]


def test_index_ranges(boats):
    boats.create_index([("mast", -1), ("crew", 1)])
    assert keys(boats.index_range("by_mast_crew", [2], [1], ids_only=True)) == ["boat4", "boat0"]
    found, cursor = boats.index_page("by_mast_crew", size=4)
    assert found == ["boat2", "boat4", "boat0", "boat5"] and boats.index_page("by_mast_crew", size=4, cursor=cursor) == (["boat1", "boat3"], None)
    with pytest.raises(NotFound):
        boats.index_range("by_port")


def test_index_pages_join_no_versions(boats, monkeypatch):
    boats.create_index([("mast", -1), ("crew", 1)])
    for _ in range(3):
        boats.update_many({"mast": 2}, {"$inc": {"crew": 1}})
    boats.update_one({"_id": "boat2"}, {"$set": {"mast": 0}})
    boats.insert_many([{"_id": "raft", "mast": "none"}, {"_id": "kayak"}, {"_id": "gone", "mast": 9}])
    boats.delete("gone")
    order = [r["_id"] for r in boats.index_range("by_mast_crew", ids_only=True).collect()]
    assert order == ["raft", "boat4", "boat0", "boat5", "boat1", "boat3", "boat2", "kayak"]

    def pages(size, *bounds):
        found, at = boats.index_page("by_mast_crew", *bounds, size=size)
        while at:
            more, at = boats.index_page("by_mast_crew", *bounds, size=size, cursor=at)
            found = found + more
        return found

    monkeypatch.setattr(store, "MOST_PROBED", 0)  # joined
    assert pages(3) == order and pages(2, [2], [1]) == ["boat4", "boat0"]
    monkeypatch.setattr(store, "MOST_PROBED", 10_000)
    monkeypatch.setattr(store.versions, "snapshot", None)
    assert pages(3) == order and pages(2, [2], [1]) == ["boat4", "boat0"]


def test_index_pages_behind_many_old_versions(boats, monkeypatch):
    boats.create_index([("crew", -1)])
    boats.insert_many([{"_id": f"gone{i}", "crew": 100 + i} for i in range(40)])
    boats.delete_many({"crew": {"$gte": 100}})
    for most in (10_000, 20):  # more are probed, or all joined
        monkeypatch.setattr(store, "MOST_PROBED", most)
        found, at = boats.index_page("by_crew", size=2)
        assert found == ["boat2", "boat0"] and boats.index_page("by_crew", size=2, cursor=at)[0] == ["boat4", "boat3"]


def test_writes_work_their_rows_out_once(boats, engine, monkeypatch):
    before = engine.last_seq()
    monkeypatch.setattr(type(boats.state()), "isEmpty", None)
    assert boats.update_many({"port": "Oslo"}, {"$set": {"mast": 4}}) == {"matched": 0, "modified": 0} and boats.delete_many({"mast": 7}) == 0
    assert engine.last_seq() == before and files.names(engine.spark, f"{engine.path}/staging") == []
    assert boats.update_many({"port": "Kiel"}, {"$set": {"mast": 4}}) == {"matched": 2, "modified": 2} and boats.delete_many({"mast": 4}) == 2
    assert engine.last_seq() == before + 2


def test_numbers_of_versions_are_shuffled_once(boats):
    plan = boats.state()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_null_ids_are_one_document(spark, engine):
    own = engine.collection("odd")
    own.insert_table(spark.createDataFrame([(None, 1), ("a", 1)], "_id string, n int"))
    own.insert_table(spark.createDataFrame([(None, 2)], "_id string, n int"))
    own.create_index("n")
    assert sorted((b.get("_id"), b["n"]) for b in bodies(own.find({"n": {"$gt": 1}}))) == [(None, 2)] and own.index_page("by_n")[0] == ["a", None]


def test_expiry(engine):
    tides = engine.collection("tides")
    tides.create_index("until", expire_after_seconds=2)
    tides.insert_many([{"_id": "ebb", "until": now_ms() - 90_000}, {"_id": "flood", "until": now_ms() + 900_000}, {"_id": "slack", "until": "whenever"}])
    assert sorted(keys(tides.find())) == ["flood", "slack"]
    with pytest.raises(BadQuery):
        tides.create_index("other", expire_after_seconds=5)


def state(c):
    return sorted(json.dumps(b, sort_keys=True) for b in bodies(c.find()))


def test_compaction_keeps_the_state_and_ends_older_ones(boats, engine, tmp_path):
    seq, token = engine.last_seq(), boats.token()
    boats.update_many({"port": "Kiel"}, {"$set": {"crew": 1}})
    boats.delete("boat5")
    assert boats.state(seq).count() == 6 and boats.count_documents() == 5
    engine.snapshot_to(str(tmp_path / "copy"), seq)
    assert Engine(engine.spark, str(tmp_path / "copy")).collection("boats").count_documents() == 6
    before, revisions = state(boats), {r["_id"]: r["_rev"] for r in boats.find_with_revision().collect()}
    engine.compact()
    assert state(boats) == before and {r["_id"]: r["_rev"] for r in boats.find_with_revision().collect()} == revisions and engine.changes().count() == 5
    for old in (lambda: boats.state(seq), lambda: engine.snapshot_to(str(tmp_path / "no"), seq), lambda: boats.changes_since(token), lambda: engine.pairs.state(seq)):
        with pytest.raises(Conflict):
            old()
    new = boats.token()
    boats.insert_one({"_id": "skiff", "crew": 1})
    assert keys(boats.changes_since(new)) == ["skiff"]
    boats.delete("boat0")
    engine.compact(engine.last_seq() - 1)
    assert sorted(keys(boats.find())) == ["boat1", "boat2", "boat3", "boat4", "skiff"] == sorted(keys(Engine(engine.spark, engine.path).collection("boats").find()))


class Stop(Exception):
    pass


@pytest.mark.parametrize("at", ["before the catalog", "before deletes", "between deletes"])
def test_compaction_can_stop_anywhere(boats, engine, monkeypatch, at):
    boats.update_many({"port": "Brest"}, {"$set": {"crew": 0}})
    boats.delete("boat2")
    want, done = state(boats), []

    def stopped(*a):
        done.append(a)
        if len(done) > (at == "between deletes"):
            raise Stop
        return real(*a)

    real = files.publish if at == "before the catalog" else files.delete
    monkeypatch.setattr(files, "publish" if at == "before the catalog" else "delete", stopped)
    with pytest.raises(Stop):
        engine.compact()
    monkeypatch.undo()
    again = Engine(engine.spark, engine.path)
    assert again.catalog["id"] == engine.catalog["id"] and state(again.collection("boats")) == want
    again.collection("boats").insert_one({"_id": "tug"})
    again.compact()
    assert len(state(again.collection("boats"))) == 6 and len(files.names(engine.spark, f"{engine.path}/base")) == 1


def test_the_catalog_survives_a_write_that_stops(engine, monkeypatch):
    engine.collection("kept")
    monkeypatch.setattr(files, "rename", lambda *a: (_ for _ in ()).throw(Stop()))
    with pytest.raises(Stop):
        engine.collection("lost")
    monkeypatch.undo()
    again = Engine(engine.spark, engine.path)
    assert again.catalog["id"] == engine.catalog["id"] and list(again.catalog["collections"]) == ["kept"]
    again.collection("more")
    with pytest.raises(Conflict):  # the first engine's catalog is no longer the last
        engine.collection("late")


def test_retention(boats, engine):
    for i in range(3):
        boats.insert_one({"_id": f"new{i}", "crew": i})
    token = Token(engine.catalog["id"], "boats", 2, 1 << 62).encode()
    engine.retain(most_age_ms=10**9, most_bytes=10**9)
    assert boats.changes_since(token).count() == 2 and engine.catalog["kept_from"] == 0
    engine.retain(most_bytes=files.size(engine.spark, f"{engine.path}/changes/c={4:020d}") + 10)
    assert engine.catalog["kept_from"] == 3 and boats.count_documents() == 9
    with pytest.raises(Conflict):
        boats.changes_since(token)
    engine.retain(most_age_ms=1000, now=now_ms() + 60_000)
    assert engine.catalog["kept_from"] == 4 and boats.count_documents() == 9


def test_feeds(boats, engine, tmp_path):
    start = boats.token()
    boats.delete("boat1")
    boats.insert_many([{"_id": "tug", "crew": 2}])
    events = boats.changes_since(start).collect()
    assert [(e["op"], e["_id"]) for e in events] == [("delete", "boat1"), ("upsert", "tug")]
    assert keys(boats.changes_since(boats.event_token(events[0]))) == ["tug"] and not keys(boats.changes_since(boats.event_token(events[1])))
    seen, run = [], lambda **more: watch(boats, lambda df, i: seen.extend((r["op"], r["_id"]) for r in df.collect()), str(tmp_path / "ck"), start, once=True, **more).awaitTermination()
    run(), run()
    assert seen == [("delete", "boat1"), ("upsert", "tug")]
    engine.collection("elsewhere").insert_one({"x": 1})
    boats.update_one({"_id": "tug"}, {"$set": {"crew": 3}})
    run()
    assert seen[2:] == [("upsert", "tug")]
    boats.delete("tug")
    with pytest.raises(Exception, match="slow consumer"):
        run(deadline=0.0)
    for bad in (lambda: engine.collection("elsewhere").changes_since(start), lambda: Token.decode("QUJD")):
        with pytest.raises(BadQuery):
            bad()


def test_too_many_feeds(boats, tmp_path, monkeypatch):
    from docloom.streaming import watch as W

    monkeypatch.setattr(W, "MOST_WATCHES", 0)
    with pytest.raises(LimitExceeded):
        watch(boats, lambda df, i: None, str(tmp_path / "ck"))


def test_pairs(engine):
    kv = engine.pairs
    kv.write_batch([("put", b"k\x00", b"zero"), ("put", b"k\xff", b"end"), ("put", b"l", b"next"), ("put", b"gone", b"", 1)])
    assert kv.get(b"l") == b"next" and kv.get(b"gone") is None
    assert [bytes(r["key"]) for r in kv.prefix_scan(b"k").collect()] == [b"k\x00", b"k\xff"] and [bytes(r["value"]) for r in kv.scan(b"k\x01", b"l").collect()] == [b"end"]
    assert kv.delete(b"l") and not kv.delete(b"l") and kv.delete_prefix(b"k") and kv.state().count() == 0 and kv.delete_prefix(b"k") == 0
    for bad, error in (([("put", b"d", b""), ("del", b"d")], DuplicateKey), ([], LimitExceeded)):
        with pytest.raises(error):
            kv.write_batch(bad)


def test_transactions_write_all_or_nothing(boats, engine):
    boats.create_index("crew", unique=True)
    with engine.transaction() as tx:
        tx.put_document("boats", {"_id": "boat0", "crew": 24})
        tx.put_document("boats", {"_id": "boat2", "crew": 11})
        tx.put(b"harbour", b"open")
        assert tx.get_document("boats", "boat0") == {"_id": "boat0", "crew": 24} and boats.get("boat0")["crew"] == 11 and tx.get(b"harbour") == b"open"
    assert (boats.get("boat0")["crew"], boats.get("boat2")["crew"], engine.pairs.get(b"harbour")) == (24, 11, b"open")
    tx = engine.transaction()
    tx.delete_document("boats", "boat0")
    tx.rollback()
    assert boats.get("boat0") is not None
    tx = engine.transaction()
    tx.put_document("boats", {"_id": "canoe", "crew": 11})
    with pytest.raises(DuplicateKey):
        tx.commit()
    assert boats.get("canoe") is None


def test_transactions_fail_when_others_were_faster(boats, engine):
    tx = engine.transaction()
    tx.put_document("boats", {"_id": "boat3", "crew": 90})
    boats.update_one({"_id": "boat3"}, {"$set": {"crew": 91}})
    with pytest.raises(Conflict):
        tx.commit()
    assert boats.get("boat3")["crew"] == 91


def test_limits_of_transactions(engine, monkeypatch):
    from docloom.sources import store

    tx = engine.transaction()
    for call in ("find", "update_many", "delete_one", "count_documents", "aggregate", "create_index"):
        with pytest.raises(BadQuery):
            getattr(tx, call)({})
    with pytest.raises(AttributeError):
        tx.nonsense
    monkeypatch.setattr(store, "MOST_TX_BYTES", 10)
    tx.put(b"0123456789", b"0123456789")
    with pytest.raises(LimitExceeded):
        tx.put(b"a", b"b")
    late = engine.transaction(seconds=0.0)
    with pytest.raises(LimitExceeded):
        late.put(b"a", b"b")


def test_tables_and_tenants(engine, spark):
    engine.collection("north/".replace("/", ":") + "ports").insert_table(spark.createDataFrame([(7, "Kiel"), (8, "Riga")], "nr long, town string"), "nr")
    ports = engine.collection("north:ports")
    assert ports.find_one({"town": "Riga"}) == {"_id": "8", "town": "Riga"} and ports.aggregate([{"$group": {"_id": "$town", "n": {"$count": {}}}}]).count() == 2
    engine.drop_tenant("north:")
    assert engine.collection("north:ports").count_documents() == 0 and engine.ping()
