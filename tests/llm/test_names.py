import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemill.llm.links import classes, pairs_of
from tidemill.llm.names import Names, alike, linked, mailbox, records, same_names, similarity, transcribed

READINGS = [("surname", "高橋", "タカハシ", "Takahashi"), ("surname", "山田", "ヤマダ", "Yamada"), ("given", "健一", "ケンイチ", "Kenichi"), ("given", "智子", "トモコ", "Tomoko"), ("given", "翔", "ショウ", "Sho")]


@pytest.fixture(scope="module")
def names():
    return Names(READINGS)


def test_tokens(names):
    same = ["高橋 健一", "髙橋健一", "タカハシ　ケンイチ", "ﾀｶﾊｼ ｹﾝｲﾁ", "Takahashi Kenichi", "Kenichi TAKAHASHI", "高橋健一様", "高橋 健一（本人）", "takahashi_kenichi", "Mr. Takahashi, Kenichi", "たかはし けんいち", "Takahasi Keniti"]
    assert {tuple(sorted(names.tokens(n)[0])) for n in same} == {("keniti", "takahasi")}
    assert names.tokens("Maggie Oldby")[0] == names.tokens("Margaret Oldby")[0] and names.tokens("GideonUnderbeck")[0] == ["gideon", "underbeck"]
    firm = ["株式会社高橋モリモ物流", "高橋モリモ物流㈱", "高橋モリモ物流（総務）", "カ）ﾀｶﾊｼﾓﾘﾓ物流", "Takahashi Morimo Logistics Co., Ltd.", "The Takahashi Morimo Logistics Company", "高橋・モリモ 物流 御中"]
    tokens = [names.tokens(n) for n in firm]
    assert all(o for _, o in tokens[:2]) and {"".join(t) for t, _ in tokens} == {"takahasimorimologistics"}
    for nobody in (None, "", "  ", "テスト", "test user", "名無し", "---", "不明", "999"):
        assert names.tokens(nobody)[0] == []
    assert transcribed("シャッキョンヴ") == "shakkyonvu"


def test_similarity(names):
    score = lambda a, b: similarity(names.tokens(a)[0], names.tokens(b)[0], lambda t: 1.0)
    for a, b in [("K. Takahashi", "高橋健一"), ("Takahasi Kenichi", "高橋健一"), ("タカハシケンイチ", "高橋 健一"), ("Bri. Ashley", "Brita Ashley"), ("Ashley Brita K", "Brita Ashley"), ("Takahashi Morimo Mfg", "高橋モリモ製作所"), ("タカハシケンイチ", "Takahashi K"), ("J. Stanlow", "Jorun J. Stanlow"), ("C. Ono", "Ohno Tika"), ("Steph Hartby", "Stephanie Hartby"), ("takahashimorimo r.e.", "Takahashi Morimo Real Estate")]:
        assert score(a, b) > 0.75, (a, b)
    for a, b in [("高橋 健一", "高橋 智子"), ("山田 健一", "高橋 健一"), ("Takahashi T", "高橋健一"), ("Stanford, W.K.", "Wakamine Keino"), ("Ashby, R.E.", "Real Estate")]:
        assert score(a, b) < 0.62, (a, b)
    assert similarity([], ["a"], lambda t: 1.0) == 0 and alike("trdg", "trading") > 0.8 and alike("kenichi", "tomoko") == 0


def test_mailbox(spark):
    assert mailbox(" A.B00012345+x@P.example ") == ("a.b00012345", "p.example") and mailbox("none") == (None, None) == mailbox(None)
    born = dt.date(1980, 1, 2)
    rows = [(str(i), f"Ann Bell{'abcdefgh'[i]}", f"ann.{i}@p.example", born if i else None) for i in range(6)] + [("6", "Ann Bell", "u12300000552@p.example", born)]
    rows += [("10", "高橋物流株式会社", "info@firm.example", None), ("11", "Takahashi Logistics", "buy@firm.example", None), ("12", "高橋 健一", "k@home.example", None), ("13", None, "x@y.example", None)]
    df = spark.createDataFrame(rows, "user_id string, user_name string, email string, birth_date date")
    got = {r["user_id"]: (r["box"], r["domain"], r["organisation"]) for r in records(df, spark.createDataFrame(READINGS, "kind string, written string, kana string, romaji string")).collect()}
    assert got[0] == ("ann.0@p.example", None, False) and got[6] == (None, None, False) and got[12] == ("k@home.example", None, False)
    assert got[10] == got[11] == (None, "firm.example", True) and 13 not in got


def person(**k):
    return {"tokens": ["takahashi", "kenichi"], "weights": [("takahashi", 3.0), ("kenichi", 3.0)], "organisation": False, "box": None, "domain": None, "birth": None, "location": None, **k}


def test_evidence_for_and_against():
    assert linked(person(birth="2000-1-2"), person(birth="2000-1-2")) and not linked(person(), person())
    assert not linked(person(birth="2000-1-2", box="a@x"), person(birth="2000-1-2", box="b@x")) and not linked(person(birth="2000-1-2", location="p"), person(birth="2001-1-2", location="p"))
    relative = person(tokens=["takahashi", "tomoko"], weights=[("takahashi", 3.0), ("tomoko", 3.0)], location="p")
    assert not linked(person(location="p"), relative)


def test_classes_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 100)]
    got = {r["member"]: r["class"] for r in classes(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 200)} == {100} and len(got) == 44
    assert classes(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def users(seed=1):
    rng = random.Random(seed)
    spell = {"k": ["高橋 健一", "Takahashi Kenichi", "ﾀｶﾊｼ ｹﾝｲﾁ", "K. Takahashi", "Takahasi Kenichi"], "t": ["山田 智子", "Yamada Tomoko", "やまだ ともこ"], "s": ["高橋 翔", "Takahashi Sho"]}
    rows, truth, n = [], {}, 0
    for p in range(24):
        kind = rng.choice("kts")
        birth, box = dt.date(1950 + p, 3, 7), f"{kind}.x{p:08d}@h.example"
        for _ in range(rng.randint(1, 4)):
            with_box = rng.random() < 0.5
            rows.append((str(n), rng.choice(spell[kind]), box if with_box else f"u{n:011d}@h.example", None if with_box and rng.random() < 0.4 else birth, "x"))
            truth[n] = p
            n += 1
    rows += [(str(n), None, "k.x00000001@h.example", None, "x"), (str(n + 1), "テスト", None, dt.date(1950, 3, 7), "x"), ("abc", "高橋 健一", None, dt.date(1950, 3, 7), "x"), rows[0]]
    return rows, truth


def test_pipeline_against_brute_force(spark):
    rows, truth = users()
    df = spark.createDataFrame(rows, "user_id string, user_name string, email string, birth_date date, name string")
    readings = spark.createDataFrame(READINGS, "kind string, written string, kana string, romaji string")
    places = spark.createDataFrame([], "user_id bigint, location string")
    got = {tuple(r) for r in pairs_of(same_names(df, readings, places), "member", "class").collect()}
    recs = records(df, readings).collect()
    common = {t: sum(t in r["tokens"] for r in recs) for r in recs for t in r["tokens"]}
    parent = {r["user_id"]: r["user_id"] for r in recs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    import math

    full = [r.asDict() | {"location": None, "weights": [(t, math.log(1 + len(recs) / common[t])) for t in r["tokens"]]} for r in recs]
    for a, b in itertools.combinations(full, 2):
        if a["user_id"] != b["user_id"] and linked(a, b):
            parent[root(a["user_id"])] = root(b["user_id"])
    want = {(a, b) for a, b in itertools.combinations(sorted(parent), 2) if root(a) == root(b)}
    assert got == want
    assert all(truth[a] == truth[b] for a, b in got)


def test_hot_name_and_empty(spark):
    readings = spark.createDataFrame(READINGS, "kind string, written string, kana string, romaji string")
    places = spark.createDataFrame([], "user_id bigint, location string")
    df = spark.range(600).select(F.col("id").cast("string").alias("user_id"), F.lit("高橋 健一").alias("user_name"), F.lit(None).cast("string").alias("email"), F.date_add(F.lit("1950-01-01").cast("date"), (F.col("id") % 300).cast("int") * 31).alias("birth_date"))
    assert pairs_of(same_names(df, readings, places), "member", "class").count() == 300
    assert same_names(df.limit(0), readings, places).count() == 0


def test_grams_hold_all_links_of_a_date_and_of_a_house():
    """An initial and its name, and tokens of three and six letters with exchanged neighbours, have a gram in common."""
    from tidemill.llm.names import grams, small_links

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("kstnhmr") + rng.choice("aiueo") for _ in range(rng.randint(2, 4)))
    people = {i: [word(), word()] for i in range(400)} | {1000: ["t", "ono"], 1001: ["takahiro", "ono"], 1002: ["kei"], 1003: ["eki"], 1004: ["abcdef"], 1005: ["bacedf"]}
    for column, ids in (("birth", list(people)), ("location", [1000, 1001])):
        held = [(i, person(tokens=people[i], weights=[(t, 3.0) for t in people[i]], **{column: "e"})) for i in ids]
        pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(held, 2) if linked(x, y)]
        assert (1000, 1001) in pairs and sets_of(small_links(held), ids) == sets_of(pairs, ids)
        of = lambda i: set().union(*(grams(t) for t in people[i]))
        assert all(of(a) & of(b) for a, b in pairs)


def crowd(n, seed, kind):
    """Names around one evidence: some of one person in different spellings, most of others."""
    import math

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("kstnhmrywgzdb") + rng.choice("aiueo") for _ in range(rng.randint(2, 5)))
    stock = [word() for _ in range(max(12, n // 8))]
    people = []
    for i in range(n):
        if people and rng.random() < 0.3:
            t = list(rng.choice(people))
            for k, x in enumerate(t):
                at = rng.randrange(len(x))
                t[k] = rng.choice([x, x, x[:1], x[:3], x[:at] + x[at + 1 :] or x, x[:at] + "q" + x[at:], x[: at - 1] + x[at : at + 1] + x[at - 1 : at] + x[at + 1 :] if at else x, x[0] + "".join(c for c in x[1:] if c not in "aiueo")])
            t = rng.choice([t, t, t[::-1], ["".join(t)]])
        else:
            t = [rng.choice(stock), rng.choice(stock)]
        people.append(t)
    df = {}
    for t in people:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    column = {"birth": "birth", "place": "location", "domain": "domain"}[kind]
    return {i: person(tokens=t, weights={x: math.log(1 + n / df[x]) for x in t}, organisation=kind == "domain", **{column: "e"}) for i, t in enumerate(people)}


def sets_of(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    out = {}
    for i in ids:
        out.setdefault(root(i), set()).add(i)
    return {frozenset(g) for g in out.values() if len(g) > 1}


PAYLOAD = "rep bigint, p struct<tokens:array<string>,weights:map<string,double>,organisation:boolean,box:string,domain:string,birth:string,location:string>"


@pytest.mark.parametrize("kind", ["birth", "place", "domain"])
def test_signatures_find_what_brute_force_links(spark, kind):
    from tidemill.llm.names import hot_links, links_of

    people = crowd(260, 11, kind)
    want = sets_of([(a, b) for a, b in itertools.combinations(people, 2) if linked(people[a], people[b])], people)
    payload = spark.createDataFrame([(i, tuple(p[f] for f in ("tokens", "weights", "organisation", "box", "domain", "birth", "location"))) for i, p in people.items()], PAYLOAD)
    rows = spark.createDataFrame([(i, " ".join(p["tokens"]), p["tokens"], kind, f"{kind} e") for i, p in people.items()], "rep bigint, name string, tokens array<string>, kind string, evidence string")
    assert len(want) > (1 if kind == "domain" else 3)
    for block in (1000, 20):
        assert sets_of([tuple(r) for r in hot_links(rows.select("rep", "kind", "evidence"), payload, block).collect()], people) == want
    for hot in (0, 10**9):
        assert sets_of([tuple(r) for r in links_of(payload, hot).collect()], people) == want


def test_a_large_group_of_one_firm_is_linked_without_all_its_pairs(spark):
    """Names of one domain that all belong together, and others among them that do not."""
    from tidemill.llm.names import hot_links

    n = 1500
    people = {i: person(tokens=["takahasi", f"w{'bcdfg'[i % 5]}{i:04d}".translate(str.maketrans("0123456789", "abcdefghij"))], weights={"takahasi": 5.0}, organisation=True, domain="d") for i in range(n)}
    people |= {n + i: person(tokens=[f"{'xyz'[i]}u{'vwj'[i] * 4}o"], weights={}, organisation=True, domain="d") for i in range(3)}
    payload = spark.createDataFrame([(i, (p["tokens"], p["weights"], True, None, "d", None, None)) for i, p in people.items()], PAYLOAD)
    rows = spark.createDataFrame([(i, "domain", "domain d") for i in people], "rep bigint, kind string, evidence string")
    assert sets_of([tuple(r) for r in hot_links(rows, payload, 200).collect()], people) == {frozenset(range(n))}
