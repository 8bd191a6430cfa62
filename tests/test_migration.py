import json

import pytest
from pyspark.sql import functions as F

from docloom.errors import AlreadyExists, BadDump
from docloom.functions.convert import array_items
from docloom.plans import migration
from docloom.sources.pgdump import read_dump, statements
from docloom.sources.store import Engine

# A weather service: sensors stand at stations, observers check what they read and have a badge and topics.
DUMP = r"""
SET client_encoding = 'UTF8'; -- one comment; with a semicolon
CREATE TABLE public.station (code text NOT NULL, title text, altitude numeric(7,1), CONSTRAINT station_pk PRIMARY KEY (code));
CREATE TABLE public.sensor (
    nr bigint NOT NULL,
    station_code text,
    kind text,
    cost numeric(8,2)
);
CREATE TABLE public.observer (nr integer PRIMARY KEY, login text NOT NULL UNIQUE);
CREATE TABLE public.badge (nr integer, observer_nr integer, colour text);
CREATE TABLE public.reading (nr integer, sensor_nr bigint, observer_nr integer, taken timestamp without time zone, degrees double precision);
CREATE TABLE public.topic (nr integer, word text);
CREATE TABLE public.observer_topic (observer_nr integer, topic_nr integer);
COPY public.station (code, title, altitude) FROM stdin;
HILL	Hill\\Top	812.5
QUAY	\N	-1.0
\.
COPY public.sensor (nr, station_code, kind, cost) FROM stdin;
1	HILL	wind	120.50
2	HILL	rain	8.00
3	QUAY	tide	\N
\.
COPY public.observer (nr, login) FROM stdin;
70	iris
71	otto
72	uma
\.
COPY public.badge (nr, observer_nr, colour) FROM stdin;
5	70	sea\tgreen
6	71	\N
\.
COPY public.reading (nr, sensor_nr, observer_nr, taken, degrees) FROM stdin;
903	1	70	2019-06-01 12:00:00	3.5
901	1	\N	2019-06-02 00:00:00.25	-4
902	2	70	\N	0
904	3	70	1970-01-01 00:00:01	11.25
\.
COPY public.topic (nr, word) FROM stdin;
31	snow
32	fog
\.
COPY public.observer_topic (observer_nr, topic_nr) FROM stdin;
70	31
71	31
72	31
70	32
\.
ALTER TABLE ONLY public.sensor ADD CONSTRAINT sensor_pk PRIMARY KEY (nr);
ALTER TABLE ONLY public.badge ADD CONSTRAINT badge_pk PRIMARY KEY (nr), ADD CONSTRAINT badge_once UNIQUE (observer_nr);
ALTER TABLE ONLY public.reading ADD CONSTRAINT reading_pk PRIMARY KEY (nr);
ALTER TABLE ONLY public.topic ADD CONSTRAINT topic_pk PRIMARY KEY (nr);
ALTER TABLE ONLY public.observer_topic ADD CONSTRAINT both_pk PRIMARY KEY (observer_nr, topic_nr);
ALTER TABLE ONLY public.sensor ADD CONSTRAINT at_station FOREIGN KEY (station_code) REFERENCES public.station(code);
ALTER TABLE ONLY public.reading ADD CONSTRAINT by_sensor FOREIGN KEY (sensor_nr) REFERENCES public.sensor(nr) ON DELETE CASCADE;
ALTER TABLE ONLY public.reading ADD CONSTRAINT by_observer FOREIGN KEY (observer_nr) REFERENCES public.observer(nr);
ALTER TABLE ONLY public.badge ADD CONSTRAINT of_observer FOREIGN KEY (observer_nr) REFERENCES public.observer(nr);
ALTER TABLE ONLY public.observer_topic ADD CONSTRAINT one FOREIGN KEY (observer_nr) REFERENCES public.observer(nr);
ALTER TABLE ONLY public.observer_topic ADD CONSTRAINT other FOREIGN KEY (topic_nr) REFERENCES public.topic(nr);
CREATE INDEX dearest ON public.sensor USING btree (cost DESC, kind);
"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "weather.sql"
    path.write_text(DUMP)
    return read_dump(spark, str(path))


@pytest.fixture(scope="module")
def plan(tables):
    return migration.classify(tables)


def documents(tables, plan, n):
    return {r["_id"]: json.loads(r["j"]) for r in migration.documents(tables, plan.collections[n]).select("_id", F.to_json("body").alias("j")).collect()}


def test_roles_of_tables(plan):
    assert set(plan.collections) == {"station", "sensor", "observer", "topic"}
    assert set(plan.embedded) == {"reading", "badge"} and plan.joins == ["observer_topic"] and plan.dropped_foreign_keys == 6
    assert plan.preserved_unique == [("observer", ["login"])] and plan.dropped_unique == [("badge", ["observer_nr"])]
    assert list(plan.collections).index("station") < list(plan.collections).index("sensor")


def test_indexes_of_collections(plan):
    assert plan.collections["sensor"].indexes == [([("station_code", 1)], False), ([("cost", -1), ("kind", 1)], False)]
    assert plan.collections["observer"].indexes == [([("login", 1)], True)] and plan.collections["topic"].indexes == []


def test_own_fields_are_converted(tables, plan):
    assert documents(tables, plan, "station") == {"HILL": {"_id": "HILL", "code": "HILL", "title": "Hill\\Top", "altitude": 8125}, "QUAY": {"_id": "QUAY", "code": "QUAY", "title": None, "altitude": -10}}


def test_children_lie_in_their_parent_in_the_order_of_the_dump(tables, plan):
    sensors = documents(tables, plan, "sensor")
    assert [r["nr"] for r in sensors["1"]["reading"]] == [903, 901] and sensors["1"]["cost"] == 12050 and sensors["3"]["cost"] is None
    assert [r["taken"] for r in sensors["1"]["reading"]] == [1559390400000, 1559433600250] and sensors["3"]["reading"][0]["taken"] == 1000
    assert sensors["3"]["reading"][0]["degrees"] == 11.25


def test_a_copy_of_the_other_parent_is_left_out_on_a_miss(tables, plan):
    with_, without = documents(tables, plan, "sensor")["1"]["reading"]
    assert with_["observer"] == {"nr": 70, "login": "iris"} and "observer" not in without and without["observer_nr"] is None


def test_single_children_and_join_tables(tables, plan):
    observers = documents(tables, plan, "observer")
    assert observers["70"]["badge"] == {"nr": 5, "observer_nr": 70, "colour": "sea\tgreen"} and observers["71"]["badge"]["colour"] is None
    assert observers["70"]["topic_ids"] == ["31", "32"] and observers["71"]["topic_ids"] == ["31"]
    assert "observer_ids" not in documents(tables, plan, "topic")["31"]


def test_loading_fills_empty_collections_only(spark, tables, plan, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    assert migration.load(engine, tables, plan) == {"station": 2, "observer": 3, "topic": 2, "sensor": 3}
    warm = engine.collection("sensor").find_one({"reading": {"$elemMatch": {"degrees": {"$gt": 10}}}})
    assert warm["_id"] == "3" and engine.collection("sensor").index_page("by_cost_kind", size=2)[0] == ["1", "2"]
    with pytest.raises(AlreadyExists):
        migration.load(engine, tables, plan)


@pytest.mark.parametrize("text", ["CREATE TABLE k (v int);\nINSERT INTO k VALUES (1);", "CREATE TABLE k (v int) PARTITION BY LIST (v);", "CREATE TABLE k (v int) INHERITS (old);", "CREATE TABLE k (v int);\nCOPY k (v) FROM stdin;\n5\n", "COPY nowhere (v) FROM stdin;\n5\n\\.\n", "CREATE TABLE k (v int);\nCOPY k (v) FROM stdin;\n5\t6\n\\.\n"])
def test_bad_dumps(spark, tmp_path, text):
    (tmp_path / "bad.sql").write_text(text)
    with pytest.raises(BadDump):
        read_dump(spark, str(tmp_path / "bad.sql"))


def test_literals():
    assert array_items('{x,"y, \\"z\\"",NULL,{u,v},{}}') == ["x", 'y, "z"', None, ["u", "v"], []]
    assert array_items("{") is None and array_items("plain") is None and array_items("{x}y") is None
    assert statements("one; -- two;\n'a;b'; c") == ["one", "'a;b'", "c"]


def test_conversions(spark):
    from docloom.functions import convert as C

    cases = [("numeric(9,3)", "2.0019", 2001), ("numeric(9,3)", "-0.007", -7), ("numeric(9,3)", ".25", 250), ("numeric", "8.25", "8.25"), ("integer", "many", "many"), ("bigint", "77", 77), ("boolean", "f", False), ("boolean", "perhaps", "perhaps"), ("double precision", "Infinity", "Infinity"), ("real", "0.5", 0.5), ("timestamp", "2000-02-29 06:30:00.0419+01", 951805800041), ("date", "1970-01-11", 864000000), ("date", "soon", "soon"), ("jsonb", '{"k":[2]}', {"k": [2]}), ("text[]", "{p,q}", ["p", "q"]), ("numeric(30,2)", "9" * 25, "9" * 25), ("text", None, None)]
    for kind, text, want in cases:
        got = spark.createDataFrame([(text,)], "t string").select(F.to_json(C.convert(F.col("t"), kind)).alias("j")).first()["j"]
        assert (json.loads(got) if got is not None else None) == want, (kind, text, got)
    ids = spark.range(3).select(C.new_id().alias("i")).collect()
    assert len({r["i"] for r in ids}) == 3 and all(len(r["i"]) == 32 for r in ids)


def test_stable_ids(spark):
    from docloom.functions import convert as C

    df = spark.createDataFrame([("x", None), ("x", ""), ("x", None), ("xy", "z"), ("x", "yz")], "k string, v string")
    ids = [r["i"] for r in df.select(C.stable_id([F.col("k"), F.col("v")]).alias("i")).collect()]
    assert ids[0] == ids[2] and len(set(ids)) == 4
