"""Which address records denote the same house number.

1. Every address is taken apart into place text, numbers (chome, ban, go), code, building and room.  The list of places
   only normalises: a text that means one place on it, but for typos, abbreviations and order, is known by that place.
2. Records are compared with each other by sorted neighbourhoods in several passes.  Each pass sorts all different records
   by another order of their components (place and numbers; numbers and place text from its beginning; numbers and place
   text from its end; code and numbers) and compares every record with the next ones in that order.  A typo or a missing
   part spoils the order in which it comes early, and the record meets its kin in another.
3. Numbers are never compared softly.  Places that the list knows must be the same one; other place texts must be close by
   an edit distance in which a transposition counts once.
4. Links are closed to classes, which are the locations.

The sorted order is cut into blocks of equal size by position, whatever the keys, and each block also gets the first rows
of the next, so a key that a third of all records share is many blocks, and no window is cut off.  A block gives out each
record's link to the first of its kin, so long runs of one location need no long chains.

Defined results: an address without house number is in no pair; where text and code both point to a known place the text
holds; where the text leaves several places open, the code decides if it names one of them, else the record is in no
pair; a text that is near no place on the list needs a chome (or three numbers) and is compared as it stands; rows without a
numeric user_id are in no pair; repeated rows of one user_id make no pair.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .links import classes

#: Records that a window spans, in each pass.
WINDOW = 8
#: Records of one block of a sorted order.
SORTED_BLOCK = 10_000
#: Entries of the list of places next to which a text is looked for, on either side.
NEAR = 10
#: Most entries the list of places may have; it is held by every worker.
MOST_PLACES = 500_000

# Other forms of characters in names of places.
VARIANTS = str.maketrans("髙嶋嶌﨑埼澤濱濵邊邉峯嶺櫻瀧龍廣國圓藏齋齊槗斎惠眞壽榮靜曾禮", "高島島崎崎沢浜浜辺辺峰峰桜滝竜広国円蔵斉斉橋斉恵真寿栄静曽礼")
KANJI_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")}

_NUM = r"([0-9]+|[〇一二三四五六七八九十]+)"
_HYPHEN = r"\s*[-の]\s*"
WITH_CHOME = re.compile(rf"{_NUM}\s*丁目\s*{_NUM}(?:\s*番地?\s*の?\s*|{_HYPHEN}){_NUM}")
THREE = re.compile(rf"(?<![0-9]){_NUM}{_HYPHEN}{_NUM}{_HYPHEN}{_NUM}")
TWO = re.compile(rf"(?<![0-9丁]){_NUM}(?:\s*番地?\s*の?\s*|{_HYPHEN}){_NUM}")
CHOME_ONLY = re.compile(rf"{_NUM}\s*丁目")
CODE = re.compile(r"〒?\s*(?<![0-9-])([0-9]{3}-[0-9]{4})(?![0-9-])|〒\s*([0-9]{7})")


def number(text: str) -> int:
    if text.isascii():
        return int(text)
    if "十" in text:
        tens, ones = text.split("十", 1)
        return 10 * (KANJI_DIGITS.get(tens, 1) if tens else 1) + (KANJI_DIGITS.get(ones, 0) if ones else 0)
    return int("".join(str(KANJI_DIGITS[c]) for c in text))


def tidy(text: str) -> str:
    """One width, one hyphen, no code marks."""
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"(?<=[0-9])\s*[‐‑‒–—―−ーｰ─━]\s*(?=[0-9])", "-", text)
    return re.sub(r"[​-‏﻿]", "", text)


def place_key(text: str) -> str:
    """Place text as it is compared: letters only, variant characters unified."""
    if re.search(r"[ぁ-ヿ一-鿿]", text):
        text = re.sub(r"[\s,、・]", "", text.translate(VARIANTS))
        return re.sub(r"[ケヶがガヵカゲ](?=丘)", "ヶ", text)
    return re.sub(r"[^a-z]", "", text.lower())


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def slack(key: str) -> int:
    """Edits that a place text of this length may have."""
    return min(3, len(key) // 5) if key.isascii() else 2 if len(key) >= 7 else 1 if len(key) >= 4 else 0


class Places:
    """The list of places in several sorted orders."""

    def __init__(self, taxonomy: list[tuple[str, str, str, str]], readings: list[tuple[str, str, str]]) -> None:
        romaji = {(kind, written): place_key(r) for kind, written, r in readings if r}
        self.place: dict[tuple[str, str, str], int] = {}
        self.chomes: dict[tuple[int, int], bool] = {}
        self.codes: dict[str, tuple[int, int]] = {}
        exact: dict[str, set[int]] = {}
        short: dict[str, set[int]] = {}  # forms without the last 町
        self.forms: dict[int, list[str]] = {}

        def add(form: str, at: int, to: dict[str, set[int]]) -> None:
            if form:
                to.setdefault(form, set()).add(at)
                self.forms.setdefault(at, []).append(form)

        for prefecture, municipality, chome, code in taxonomy:
            found = re.match(r"^(.+?[市区町村])(.+)$", municipality)
            if not found:
                continue
            city, town = found.groups()
            if (prefecture, city, town) not in self.place:
                at = self.place[prefecture, city, town] = len(self.place)
                p, c, t = place_key(prefecture), place_key(city), place_key(town)
                for form in (p + c + t, p[:-1] + c + t, c + t, t, c, p + c, p[:-1] + c):
                    add(form, at, exact)
                    if t.endswith("町") and form.endswith(t):
                        add(form[:-1], at, short)
                rp, rc, rt = (romaji.get(k) for k in (("prefecture", prefecture), ("city", city), ("town", town)))
                if rt and rc:
                    for form in (rt + rc + (rp or ""), rt + rc, rt, rc, rc + (rp or "")):
                        add(form, at, exact)
            at, digits = self.place[prefecture, city, town], re.sub(r"\D", "", unicodedata.normalize("NFKC", chome or ""))
            if digits:
                self.chomes[at, int(digits)] = True
                if code:
                    self.codes[code] = (at, int(digits))
        self.short: dict[int, set[str]] = {}
        for form, those in short.items():
            for at in those:
                self.short.setdefault(at, set()).add(form)
        # a place written in full goes before one whose 町 was left out
        self.exact = exact = {**{form: at for form, at in short.items() if form not in exact}, **exact}
        self.forward = sorted(exact)
        self.backward = sorted((form[::-1], form) for form in exact)
        self.look_up = lru_cache(maxsize=100_000)(self._look_up)

    def near(self, key: str) -> list[str]:
        """The neighbours of a text in both reading directions."""
        at = bisect.bisect_left(self.forward, key)
        out = self.forward[max(0, at - NEAR) : at + NEAR]
        at = bisect.bisect_left(self.backward, (key[::-1], ""))
        return out + [form for _, form in self.backward[max(0, at - NEAR) : at + NEAR]]

    def _look_up(self, key: str) -> frozenset[int]:
        """The places that a text may mean: those of its form, else those of the nearest neighbouring forms."""
        if not key:
            return frozenset()
        if key in self.exact:
            return frozenset(self.exact[key])
        most = slack(key)
        best, found = most + 1, set()
        for form in set(self.near(key)):
            d = distance(key, form, min(best, most))
            if d < best:
                best, found = d, set(self.exact[form])
            elif d == best <= most:
                found |= self.exact[form]
        return frozenset(found)

    def code(self, text: str | None) -> tuple[int, int] | None:
        digits = re.sub(r"\D", "", unicodedata.normalize("NFKC", text or ""))
        return self.codes.get(digits.zfill(7)) if digits else None

    def locate(self, address: str | None, code: str | None) -> tuple[int, int, int, int] | None:
        """(place, chome, ban, go) of a record, if it has a house number and its place is on the list and clear."""
        found = self.read(address, code)
        return (found[0], *found[2:5]) if found and found[0] is not None else None

    def read(self, address: str | None, code: str | None) -> tuple[int | None, str, int, int, int, str] | None:
        """(place or None if none is near, place text, chome, ban, go, code) of a record with a house number."""
        if not address:
            return None
        text = tidy(address)
        inside = CODE.search(text)
        given = re.sub(r"\D", "", unicodedata.normalize("NFKC", code or "")) or (re.sub(r"\D", "", inside.group()) if inside else "")
        known = self.code(code) or (self.code(inside.group(1) or inside.group(2)) if inside else None)
        text = CODE.sub(" ", text)
        text = re.sub(r"(?i)\b(?:room|rm\.?|apt\.?|unit)\s*#?\s*[0-9]+\s*,?|#\s*[0-9]+\s*,", " ", text)
        japanese = re.search(r"[ぁ-ヿ一-鿿]", text) is not None
        found = WITH_CHOME.search(text) or THREE.search(text)
        if found:
            chome, ban, go = map(number, found.groups())
        elif not CHOME_ONLY.search(text) and (found := TWO.search(text)) and known:
            (ban, go), chome = map(number, found.groups()), known[1]
        else:
            return None
        if japanese:
            where = text[: found.start()]
        else:
            where = re.sub(r"(?i)\bjapan\b", " ", text[: found.start()] + " " + text[found.end() :])
        key = place_key(where)
        places = self.look_up(key)
        fits = known is not None and known[1] == chome
        at = None
        if fits and key and (key in self.short.get(known[0], ()) or (key not in self.exact and min(distance(key, f, slack(key)) for f in self.forms[known[0]]) <= slack(key))):
            at = known[0]  # neither is beyond doubt, and they agree
        elif len(places) == 1:
            (only,) = places
            at = only if (only, chome) in self.chomes or (fits and known[0] == only) else None
        elif fits and (known[0] in places or (not places and len(found.groups()) == 3)):
            at = known[0]  # the code decides; without a chome the text must name the place
        if at is None and (places or known or len(key) < 4 or len(found.groups()) < 3):
            return None  # several places are open, or one without that chome, or nothing is said of the place
        return at, key, chome, ban, go, given


_READ = "user_id bigint, place int, text string, chome int, ban int, go int, code string"


def same_location(a: tuple, b: tuple) -> bool:
    """Whether two records (place, text, chome, ban, go, code) denote the same house number."""
    if a[2:5] != b[2:5]:
        return False
    if a[0] is not None or b[0] is not None:
        return a[0] == b[0]
    if a[1] == b[1]:
        return True
    if a[5] and b[5] and a[5] != b[5]:
        return False
    most = min(slack(a[1]), slack(b[1]))
    return distance(a[1], b[1], most) <= most


def neighbours(records: DataFrame, window: int = WINDOW, block: int = SORTED_BLOCK) -> DataFrame:
    """Links (a, b) of different records by sorted neighbourhoods.  ``records``: rep, place, text, chome, ban, go, code."""
    numbers = F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), 6, "0") for c in ("chome", "ban", "go")))
    bar = F.lit("|")
    orders = [
        F.concat(F.coalesce(F.lpad(F.col("place").cast("string"), 8, "0"), "text"), bar, numbers),
        F.concat(numbers, bar, "text"),
        F.concat(numbers, bar, F.reverse("text")),
        F.when(F.length("code") > 0, F.concat("code", bar, numbers, bar, "text")),
    ]
    keyed = F.filter(F.array(*(F.struct(F.lit(i).alias("pass"), k.alias("key")) for i, k in enumerate(orders))), lambda e: e["key"].isNotNull())
    each = records.select("*", F.explode(keyed).alias("_e")).select(*records.columns, "_e.pass", "_e.key")
    # positions in the global order: the row's place in its range, and the sizes of the ranges before it
    ordered = each.repartitionByRange("pass", "key", "rep").sortWithinPartitions("pass", "key", "rep")
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "p5-sorted")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each task of the sort
    before, total = {}, 0
    for one in sorted(sizes, key=lambda r: r["_part"]):
        before[one["_part"]], total = total, total + one["n"]
    if not total:
        return records.sparkSession.createDataFrame([], "a string, b string")
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    block = max(block, window)
    placed = ordered.withColumn("_index", row + offset[part]).drop("_at")
    own = F.floor(F.col("_index") / block)
    placed = placed.withColumn("_block", F.explode(F.when((own > 0) & (F.col("_index") % block < window - 1), F.array(own, own - 1)).otherwise(F.array(own))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_index")
        reps, passes = group["rep"].tolist(), group["pass"].tolist()
        place = [None if p != p or p is None else int(p) for p in group["place"]]
        rows = list(zip(place, group["text"], group["chome"], group["ban"], group["go"], group["code"]))
        root = list(range(len(rows)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, one in enumerate(rows):
            for j in range(i + 1, min(i + window, len(rows))):
                if passes[j] == passes[i] and same_location(one, rows[j]):
                    x, y = top(i), top(j)
                    root[max(x, y)] = min(x, y)
        links = [(reps[i], reps[top(i)]) for i in range(len(rows)) if top(i) != i]
        return pd.DataFrame([x for x in links if x[0] != x[1]], columns=["a", "b"])

    return placed.groupBy("_block").applyInPandas(run, "a string, b string").distinct()


def locations(users: DataFrame, taxonomy: DataFrame, readings: DataFrame) -> DataFrame:
    """``user_id`` and ``location`` (place, chome, ban, go) of every record with a clear location."""
    rows = taxonomy.select("prefecture", "municipality", "chome", "zip_code").limit(MOST_PLACES + 1).collect()
    if len(rows) > MOST_PLACES:
        raise ValueError(f"the list of places has more than {MOST_PLACES} entries")
    listed = [tuple(r) for r in rows if r[0] and r[1]]
    rows = readings.filter("kind in ('prefecture', 'city', 'town')").select("kind", "written", "romaji").limit(MOST_PLACES + 1).collect()
    if len(rows) > MOST_PLACES:
        raise ValueError(f"the table of readings has more than {MOST_PLACES} entries")
    read = [tuple(r) for r in rows if r[1]]
    spark = users.sparkSession
    shared = spark.sparkContext.broadcast((listed, read))
    records = users.select(F.expr("try_cast(trim(user_id) as bigint)").alias("user_id"), "address", "zip_code").filter("user_id is not null and address is not null").distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(*shared.value)
        for part in parts:
            out = []
            for user, address, code in part.itertuples(index=False):
                found = places.read(address, code)
                if found:
                    out.append((user, *found))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _READ.split(", ")])
            yield frame.astype({"place": "Int32"})

    # records read alike are one, known by a hash of 128 bits of what was read
    fields = ["place", "text", "chome", "ban", "go", "code"]
    rep = F.md5(F.to_json(F.struct(*fields)))
    read_rows = materialize(records.mapInPandas(run, _READ).withColumn("rep", rep), "p5-read")
    links = neighbours(read_rows.select("rep", *fields).distinct())
    found = classes(links, "a", "b").withColumnRenamed("member", "rep")
    return read_rows.select("user_id", "rep").distinct().join(found, "rep", "left").select("user_id", F.coalesce("class", "rep").alias("location")).distinct()
