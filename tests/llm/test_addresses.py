import itertools
import random

import pytest

from tidemill.llm.addresses import Places, distance, locations, neighbours, number, same_location
from tidemill.llm.links import pairs_of

TAXONOMY = [
    (p, c + t, f"{n}丁目", z)
    for i, (p, c, t) in enumerate([("桜原都", "桜見市", "深野町"), ("桜原都", "桜見市", "深山"), ("汐谷県", "汐波区", "松野町"), ("汐谷県", "高橋市", "松野町"), ("汐谷県", "汐波区", "星ヶ丘"), ("瑞原県", "白波市", "黒森町")])
    for n in (1, 2, 3)
    for z in [f"{i + 1:03d}{n:04d}"]
]
READINGS = [("prefecture", "桜原都", "Sakurahara-to"), ("prefecture", "汐谷県", "Shiotani-ken"), ("city", "桜見市", "Sakurami-shi"), ("city", "汐波区", "Shionami-ku"), ("city", "高橋市", "Takahashi-shi"), ("town", "深野町", "Fukano-cho"), ("town", "松野町", "Matsuno-cho"), ("town", "星ヶ丘", "Hoshigaoka")]
SAME = [
    "桜原都桜見市深野町2丁目10番5号", "桜見市深野町２－１０－５", "桜原都 桜見市 深野町 二丁目十番五号 桜ハイツ301", "2-10-5 Fukano-cho, Sakurami-shi, Sakurahara-to", "Room 12, 2-10-5 FUKANO-CHO, SAKURAMI-SHI 001-0002, Japan",
    "〒001-0002 桜原都桜見市深野町2の10の5", "桜原桜見市深野町2丁目10番地の5", "桜原都桜見見市深野町2丁目10−5", "桜原都櫻見市深野町2ー10ー5-301", "桜原都桜見市野深町2丁目 10 - 5", "桜見市深野2丁目10番5号", "深野町2丁目10番5号荘101",
]


@pytest.fixture(scope="module")
def places():
    return Places(TAXONOMY, READINGS)


def test_spellings_of_one_house_number(places):
    found = {a: places.locate(a, None) for a in SAME}
    assert len(set(found.values())) == 1 and None not in found.values(), found


def test_numbers_are_strict(places):
    at = [places.locate(f"桜見市深野町{n}", None) for n in ("2-10-5", "2-10-6", "2-11-5", "1-10-5", "2-1-05")]
    assert len(set(at)) == 5
    assert number("二十一") == 21 and number("十") == 10 and number("三十") == 30 and number("〇") == 0


def test_text_and_code(places):
    town_only = places.locate("松野町1丁目2番3号", None)
    assert town_only is None  # two cities have it
    assert places.locate("松野町1丁目2番3号", "0030001") == places.locate("汐波区松野町1-2-3", None)
    assert places.locate("松野町1丁目2番3号", "０04-0001") == places.locate("高橋市松野町1-2-3", "9999999")
    assert places.locate("汐谷県汐波区松野町1-2-3", "0040001") == places.locate("汐波区松野町1-2-3", None)  # the text holds
    assert places.locate("桜見市1丁目2番3号", "0010001") == places.locate("桜見市深野町1-2-3", None)  # the town is missing
    assert places.locate("1-2-3", "0010001") == places.locate("桜見市深野町1-2-3", None)
    assert places.locate("桜見市1丁目2番3号", "0030001") is None and places.locate("1-2-3", None) is None
    assert places.locate("汐波区星が丘1-2-3", None) == places.locate("汐波区 星ケ丘 1-2-3", None) is not None


def test_no_house_number(places):
    for a in (None, "", "不明", "-", "桜原都桜見市深野町2丁目", "桜見市深野町", "2-10 nowhere", "x" * 5000):
        assert places.locate(a, "0010002") is None


def test_distance():
    assert distance("abcd", "abdc", 2) == 1 and distance("abc", "abc", 1) == 0 and distance("abc", "xyz", 1) == 2 and distance("", "ab", 2) == 2 and distance("abcdef", "a", 2) == 3
    for a, b in itertools.product(["深野町", "深町野", "野町", "深深野町"], repeat=2):
        assert distance(a, b, 3) == distance(b, a, 3)


def test_pairs(spark):
    users = [(str(i), a, None, "extra") for i, a in enumerate(SAME)] + [("0", SAME[0], None, "again"), ("x", SAME[0], None, ""), (None, SAME[0], None, ""), ("77", None, "0010002", ""), ("78", "桜見市深野町1-1-1", None, "")]
    taxonomy = spark.createDataFrame(TAXONOMY, "prefecture string, municipality string, chome string, zip_code string")
    readings = spark.createDataFrame(READINGS, "kind string, written string, romaji string")
    df = spark.createDataFrame(users, "user_id string, address string, zip_code string, location string")
    got = {tuple(r) for r in pairs_of(locations(df, taxonomy, readings), "user_id", "location").collect()}
    assert got == set(itertools.combinations(range(len(SAME)), 2))
    assert pairs_of(locations(df.limit(0), taxonomy, readings), "user_id", "location").count() == 0
    # without a list every address with three numbers stands for itself
    assert {r["user_id"] for r in locations(df, taxonomy.limit(0), readings.limit(0)).collect()} <= {*range(len(SAME)), 78}


def test_a_large_group_is_paired_in_blocks(spark, monkeypatch):
    import tidemill.llm.links as module

    monkeypatch.setattr(module, "BLOCK", 7)
    df = spark.range(40).selectExpr("id", "'same' g").union(spark.createDataFrame([(99, "other")], "id bigint, g string"))
    assert pairs_of(df, "id", "g").count() == 40 * 39 // 2


def brute(rows):
    """Classes of same_location over all pairs, as sets of ids."""
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if same_location(a[1:], b[1:]):
            parent[root(a[0])] = root(b[0])
    groups = {}
    for r in rows:
        groups.setdefault(root(r[0]), set()).add(r[0])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


RECORD = "rep string, place int, text string, chome int, ban int, go int, code string"


@pytest.mark.parametrize("block", [8, 40, 10_000])
def test_neighbourhoods_against_brute_force(spark, block):
    """Listed and unlisted places, typos at the beginning and at the end, and a location with a third of all records."""
    rng = random.Random(6)
    towns = ["hanamizucho", "kitanokawamachi", "oldharborroad", "sunsethillavenue"]

    def typo(t):
        i = rng.choice([0, 1, len(t) - 2, rng.randrange(len(t) - 1)])
        return rng.choice([t[:i] + t[i + 1] + t[i] + t[i + 2 :], t[:i] + t[i + 1 :], t[:i] + "q" + t[i + 1 :]])

    rows = []
    for i in range(240):
        if i % 3 == 0:
            rows.append((f"r{i}", 5, f"spelling {i}", 1, 2, 3, ""))
        elif i % 3 == 1:
            rows.append((f"r{i}", rng.randint(0, 9), f"s{i}", rng.randint(1, 2), 1, 1, ""))
        else:
            t = rng.choice(towns)
            rows.append((f"r{i}", None, typo(t) if rng.random() < 0.5 else t + "", rng.randint(1, 3), rng.randint(1, 2), 4, rng.choice(["", "", "1234567"])))
    from tidemill.llm.links import classes

    got = classes(neighbours(spark.createDataFrame(rows, RECORD), 8, block), "a", "b").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["class"], set()).add(r["member"])
    assert {frozenset(g) for g in groups.values()} == brute(rows)


def test_places_outside_the_list_are_paired(spark):
    users = [("1", "12-3-4 Old Harbor Road, Westhaven", None), ("2", "12-3-4 Old Harbro Road, Westhaven", None), ("3", "12-3-5 Old Harbor Road, Westhaven", None), ("4", "遠野郡青沢村字北2丁目3番4号", None), ("5", "遠野郡青沢村字北２－３－４", ""), ("6", "1-2-3", None)]
    taxonomy = spark.createDataFrame(TAXONOMY, "prefecture string, municipality string, chome string, zip_code string")
    readings = spark.createDataFrame(READINGS, "kind string, written string, romaji string")
    got = pairs_of(locations(spark.createDataFrame(users, "user_id string, address string, zip_code string"), taxonomy, readings), "user_id", "location").collect()
    assert {tuple(r) for r in got} == {(1, 2), (4, 5)}
