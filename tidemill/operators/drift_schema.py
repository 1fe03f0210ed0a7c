"""One consistent table out of files whose columns drift: similarity flooding between the files of a feed.

1. Every line is read once; of each file and column there remain counts (records, values by type, nested keys) and the
   values of all its records by the hash of their key.
2. Each file is matched with the one before.  What the values say about a column that went and one that came is counted in
   Spark over all records: how many records have both, in how many the values agree, how often chance alone would make
   them agree, and how far the sets of values overlap.
3. The two schemas are graphs: columns, their names, types and nested keys, and the records that hold their values.  Pairs
   of columns start with the likeness of their names alone; scores are propagated between a pair of columns and the pairs
   of types, nested keys and records it touches, and pairs compete for what they share, until nothing moves.  Pairs are
   accepted by the score they end with, the best consistent ones first.
4. Pairs make fields: a field lives on under changing names, and its type is carried on while it has nulls only.  What
   differs from file to file is reported; the fields, named by the alias rules, are cast and united.

Defined results: lines that are not a JSON object (null, cut off, followed by other text, with NaN, other values) do not
count, for the table as for the changes, and a mark of byte order before a line is no part of it; of a key given twice the
last holds; a column belongs to a file if at least half of the file's records have its key; ties of types go to string,
then number, then boolean; files without valid lines have no columns; rows without file or feed are left out; two files of
a feed on one day are taken in order of their id; a column whose name stays is the same field, whatever its values; nested
values count as string.
"""

from __future__ import annotations

import json
import logging
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

log = logging.getLogger(__name__)

#: Values that a task holds before it gives out a partial profile.
HELD = 200_000
TYPES = ("string", "number", "boolean")

# Spellings of truth values.
TRUE, FALSE = frozenset("true t yes y 1 有効".split()), frozenset("false f no n 0 無効".split())

Rule = tuple[str, str, int]


def fold(name: str) -> str:
    return unicodedata.normalize("NFKC", name).strip().casefold()


def canonical(name: str, rules: list[Rule]) -> tuple[str | None, int]:
    """(canonical name, priority) of the first rule that fits, by priority and then pattern; (None, 0) without one."""
    return _canonical(name, tuple(rules))


@lru_cache(maxsize=100_000)
def _canonical(name: str, rules: tuple[Rule, ...]) -> tuple[str | None, int]:
    for pattern, target, priority in sorted(rules, key=lambda r: (r[2], r[0])):
        if re.match(pattern, fold(name), re.IGNORECASE):
            return target, priority
    return None, 0


def plain(value: object) -> str:
    """A value in a form that does not depend on its type or spelling."""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (int, float)):
        return f"{value:.6g}" if abs(value) < 1e6 else str(int(value)) if value == value and abs(value) < 1e18 else str(value)
    if isinstance(value, str):
        text = fold(value)
        if text in TRUE:
            return "1"
        if text in FALSE:
            return "0"
        if re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", text):
            return "".join(p.zfill(2) for p in re.split(r"[-/.]", text))
        if re.fullmatch(r"[+-]?\d{1,3}(,\d{3})+(\.\d+)?", text):
            text = text.replace(",", "")
        try:
            return plain(float(text.rstrip("% "))) if re.fullmatch(r"[+-]?\d+(\.\d+)?\s*%?", text) else text
        except ValueError:
            return text
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def kind_of(value: object) -> int:
    return 2 if isinstance(value, bool) else 1 if isinstance(value, (int, float)) else 0


def _refuse(constant: str):
    raise ValueError(constant)


_READ = json.JSONDecoder(parse_constant=_refuse)
_READ_TEXT = json.JSONDecoder(parse_constant=_refuse, parse_float=str, parse_int=str)


def parse(line: str | None, text: bool = False) -> dict | None:
    """The record of a line, None if it is no JSON object.  With ``text``, numbers stay as they are written."""
    if not line:
        return None
    try:
        record = (_READ_TEXT if text else _READ).decode(line.lstrip("\ufeff"))
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def nested(value: object, path: str = "") -> Iterator[str]:
    """Paths of the keys inside a value, with ``[]`` for the elements of a list."""
    for name, inner in value.items() if isinstance(value, dict) else (("[]", v) for v in value):
        at = f"{path}.{name}" if path else name
        yield at
        if isinstance(inner, (dict, list)):
            yield from nested(inner, at)


_PROFILE = "file_id bigint, column string, records bigint, n bigint, n_string bigint, n_number bigint, n_boolean bigint, kids array<string>, keys array<bigint>, vals array<string>"


def profile(lines: DataFrame, rules: list[Rule], key_name: str = "fund_id", flush: int = 20_000) -> DataFrame:
    """Partial profiles: one row per task, file and column (the column ``""`` counts the file's records)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, str], list[int]] = {}
        values: dict[tuple[int, str], dict[int, str]] = {}
        kids: dict[tuple[int, str], set[str]] = {}
        known: dict[str, bool] = {}
        shown: dict[object, str] = {}  # plain forms of values met before; those of one type only, as 1 == True
        held = 0

        def plainly(value: object) -> str:
            if type(value) is not str:
                return plain(value)
            form = shown.get(value)
            if form is None:
                if len(shown) > HELD:
                    shown.clear()
                form = shown[value] = plain(value)
            return form

        def rows() -> pd.DataFrame:
            out = [(f, c, *n, list(kids.get((f, c), ())), list(s := values.get((f, c), {})), list(s.values())) for (f, c), n in counts.items()]
            for one in (counts, values, kids):
                one.clear()
            return pd.DataFrame(out, columns=[f.split()[0] for f in _PROFILE.split(", ")])

        for batch in batches:
            for file_id, line in zip(batch["file_id"].to_numpy(), batch["line"].to_numpy()):
                record = parse(line)
                if record is None or file_id != file_id or file_id is None:
                    continue
                file_id = int(file_id)
                counts.setdefault((file_id, ""), [0] * 5)[0] += 1
                owner = None
                for name, value in record.items():
                    if name not in known:
                        known[name] = canonical(name, rules)[0] == key_name
                    if known[name] and value is not None:
                        owner = zlib.crc32(plainly(value).encode()) + 1
                for name, value in record.items():
                    at = (file_id, name)
                    n = counts.get(at)
                    if n is None:
                        n = counts[at] = [0] * 5
                    n[1] += 1
                    if value is not None:
                        n[2 + kind_of(value)] += 1
                        if isinstance(value, (dict, list)):
                            kids.setdefault(at, set()).update(nested(value))
                        if owner is not None and not known[name]:
                            values.setdefault(at, {})[owner] = plainly(value)
                            held += 1
                if len(counts) > flush or held > HELD:
                    yield rows()
                    held = 0
        if counts:
            yield rows()

    return lines.select("file_id", "line").mapInPandas(run, _PROFILE)


class Column:
    """A column of one file: its name as the rules read it, its types, and its nested keys."""

    __slots__ = ("name", "types", "kids", "target", "vague", "label")

    def __init__(self, name: str, types: list[int], kids: list[str], rules: list[Rule]) -> None:
        self.name, self.types, self.kids = name, types, frozenset(kids)
        self.target, priority = canonical(name, rules)
        self.vague = self.target is not None and priority > 1
        self.label = fold(name)

    def type(self) -> str | None:
        return TYPES[int(np.argmax(self.types))] if any(self.types) else None


def likeness(a: Column, b: Column) -> float:
    """Of names: same canonical name 1, different ones 0, else the overlap of their letter pairs."""
    if a.target and b.target and not (a.vague or b.vague):
        return 1.0 if a.target == b.target else 0.0
    pairs = [{t[i : i + 2] for i in range(len(t) - 1)} for t in (re.sub(r"[\W_]+", "", a.label), re.sub(r"[\W_]+", "", b.label))]
    return 2 * len(pairs[0] & pairs[1]) / max(len(pairs[0]) + len(pairs[1]), 1)


#: Fractions are equal up to this: a rate may be written with two decimals here and with three there.
NEAR = 0.0051


def _fraction(text):
    """A plain value with decimals as a number, null for any other."""
    return F.when(F.contains(text, F.lit(".")) & (F.length(text) < 12), text.try_cast("double"))


def _same(x, y):
    """Whether two plain values are the same but for the number of decimals they were written with."""
    near = F.abs(x.try_cast("double") - y.try_cast("double")) <= NEAR
    loose = (F.contains(x, F.lit(".")) | F.contains(y, F.lit("."))) & (F.length(x) < 12) & (F.length(y) < 12)
    return (x == y) | F.coalesce(loose & near, F.lit(False))


def _rough(x):
    """A plain value with at most two decimals."""
    return F.coalesce(F.round(_fraction(x), 2).cast("string"), x)


_EVIDENCE = "file_id bigint, old string, new string, shared bigint, agree bigint, chance double, overlap bigint, fewest bigint"


def evidence(values: DataFrame) -> DataFrame:
    """What values say about every pair of an old and a new column of a file (see ``_EVIDENCE``), counted over all records.

    ``values``: file_id (of the later file), side (0 old, 1 new), column, key, val; one row per column and record.
    """
    left = values.filter("side = 0").select("file_id", "key", F.col("column").alias("old"), F.col("val").alias("x"), _rough(F.col("val")).alias("rx"))
    right = values.filter("side = 1").select("file_id", "key", F.col("column").alias("new"), F.col("val").alias("y"), _rough(F.col("val")).alias("ry"))
    pair = ["file_id", "old", "new"]
    both = left.join(right, ["file_id", "key"])
    agree = both.groupBy(*pair).agg(F.count(F.lit(1)).alias("shared"), F.sum(_same(F.col("x"), F.col("y")).cast("bigint")).alias("agree"))
    nx, ny = both.groupBy(*pair, F.col("rx").alias("v")).agg(F.count(F.lit(1)).alias("nx")), both.groupBy(*pair, F.col("ry").alias("v")).agg(F.count(F.lit(1)).alias("ny"))
    chance = nx.join(ny, [*pair, "v"]).groupBy(*pair).agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("both"))
    dx, dy = left.select("file_id", "old", F.col("rx").alias("v")).distinct(), right.select("file_id", "new", F.col("ry").alias("v")).distinct()
    met = dx.join(dy, ["file_id", "v"]).groupBy(*pair).agg(F.count(F.lit(1)).alias("overlap"))
    sizes = dx.groupBy("file_id", "old").agg(F.count(F.lit(1)).alias("n_old")).join(dy.groupBy("file_id", "new").agg(F.count(F.lit(1)).alias("n_new")), "file_id")  # a few columns a file
    out = sizes.join(agree, pair, "left").join(chance, pair, "left").join(met, pair, "left")
    zero = F.lit(0).cast("bigint")
    share = F.coalesce(F.col("both") / (F.col("shared").cast("double") * F.col("shared")), F.lit(0.0))
    return out.select(*pair, F.coalesce("shared", zero).alias("shared"), F.coalesce("agree", zero).alias("agree"), share.alias("chance"), F.coalesce("overlap", zero).alias("overlap"), F.least("n_old", "n_new").alias("fewest"))


#: Part of the likeness of names in a pair's score, of equal types and of nested keys, and the score that is accepted; and
#: what is taken of values that no records share: a share for being unknown, and a part of how far they overlap.
NAME, TYPE, NESTED, ACCEPTED, UNKNOWN, RANGES = 0.4, 0.02, 0.25, 0.46, 0.21, 0.31
#: Records that two columns must share for their values to be compared record by record.
ENOUGH = 4
#: Steps of propagation within which scores must come to rest.
STEPS = 200


def values_say(shared: int, agree: int, chance: float, overlap: int, fewest: int) -> float:
    """How strongly the records bear out a pair: agreement beyond chance (kappa), or overlap where few records are shared."""
    if shared >= ENOUGH:
        share = agree / shared
        return max(0.0, share if chance >= 1 else (share - chance) / (1 - chance))
    ranges = overlap / fewest if fewest else 0.0
    return UNKNOWN + RANGES * (ranges if fewest >= ENOUGH or shared else min(ranges, 0.5))


def propagated(start: np.ndarray, records: np.ndarray, around: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Scores of pairs of columns (old x new) at rest.

    ``start``: what their names say; ``records``: how strongly the pair of their records binds them; ``around``: what comes
    from the pairs of types and nested keys, which have no other neighbours.  In each step a pair of records passes its
    score to the pairs of columns it touches, in proportion to the scores these have among all pairs that claim one of the
    two columns, so of several claims on a column the strongest one takes over.
    """
    score = start.copy()
    for _ in range(steps):
        claim = records * (score + 1e-9)
        best = np.maximum(claim.max(axis=1, keepdims=True), claim.max(axis=0, keepdims=True))
        fresh = start + around + records * claim / np.maximum(best, 1e-12)
        moved = np.abs(fresh - score).max()
        score = fresh
        if moved < 1e-4:
            return score
    if steps:
        log.warning("scores still move by %.5f after %d steps", moved, steps)
    return score


def flood(old: list[Column], new: list[Column], said: dict[tuple[str, str], tuple], steps: int = STEPS) -> list[tuple[int, int]]:
    """Consistent pairs of columns that go on under another name.  ``said`` is the evidence by (old, new) name."""
    if not old or not new:
        return []
    names = np.array([[likeness(a, b) for b in new] for a in old])
    sure = lambda c: c.target is not None and not c.vague
    # the graph has no pair of two columns that the rules know by different names
    apart = np.array([[sure(a) and sure(b) and a.target != b.target for b in new] for a in old])
    nothing = (0, 0, 0.0, 0, 0)
    records = np.array([[values_say(*said.get((a.name, b.name), nothing)) for b in new] for a in old])
    around = np.array([[TYPE * (a.type() == b.type()) + NESTED * len(a.kids & b.kids) / max(len(a.kids | b.kids), 1) for b in new] for a in old])
    score = propagated(np.where(apart, 0.0, NAME * names), np.where(apart, 0.0, records), np.where(apart, 0.0, around), steps)
    found: list[tuple[int, int]] = []
    used: tuple[set[int], set[int]] = (set(), set())
    for at in np.argsort(-score, axis=None, kind="stable"):
        i, j = divmod(int(at), len(new))
        if score[i, j] >= ACCEPTED and i not in used[0] and j not in used[1]:
            found.append((i, j))
            used[0].add(i)
            used[1].add(j)
    return found


_CHANGES = "feed string, file_id bigint, kind string, name string, previous string, type string, target string"


def follow(feed: str, columns: pd.DataFrame, said: pd.DataFrame, rules: list[Rule], steps: int = STEPS) -> list[tuple]:
    """All columns and changes of one feed.  ``kind`` is ``column`` for what a file has, else the change."""
    files: dict[int, dict[str, Column]] = {}
    dates = dict(zip(columns["file_id"].tolist(), columns["delivered_on"].tolist()))
    for file_id, name, kids, *types in zip(*(columns[c].tolist() for c in ("file_id", "column", "kids", "n_string", "n_number", "n_boolean"))):
        if isinstance(name, str):
            files.setdefault(file_id, {})[name] = Column(name, [int(n) for n in types], kids, rules)
    heard: dict[int, dict[tuple[str, str], tuple]] = {}
    for file_id, old, new, *what in zip(*(said[c].tolist() for c in ("file_id", "old", "new", "shared", "agree", "chance", "overlap", "fewest"))):
        heard.setdefault(file_id, {})[old, new] = tuple(what)
    out: list[tuple] = []
    fields: dict[str, dict] = {}  # current name -> the field: its last known type and its names so far
    before: dict[str, Column] | None = None
    for file_id in sorted(dates, key=lambda f: (str(dates[f]) if dates[f] is not None and dates[f] == dates[f] else "", f)):  # dates as text sort by time
        now = dict(sorted(files.get(file_id, {}).items()))
        new_fields: dict[str, dict] = {}
        renamed: dict[str, str] = {}
        if before is not None:
            gone, come = [c for n, c in before.items() if n not in now], [c for n, c in now.items() if n not in before]
            renamed = {come[j].name: gone[i].name for i, j in flood(gone, come, heard.get(file_id, {}), steps)}
        for name, column in now.items():
            previous = renamed.get(name, name)
            field = fields.get(previous) if before is not None and previous in before else None
            kind = column.type()
            if before is not None:
                if field is None:
                    out.append((feed, file_id, "added", name, None, kind, None))
                else:
                    if name in renamed:
                        out.append((feed, file_id, "renamed", name, previous, kind, None))
                    if kind and field["type"] and kind != field["type"]:
                        out.append((feed, file_id, "retyped", name, previous, kind, None))
            field = field or {"type": None, "target": None}
            field["type"] = kind or field["type"]
            if column.target and not column.vague:
                field["target"] = field["target"] or column.target
            new_fields[name] = field
        if before is not None:
            for name in before:
                if name not in now and name not in renamed.values():
                    out.append((feed, file_id, "removed", name, name, None, None))
        # a column that is away keeps its values for one step only: what returns later is added
        before, fields = now, new_fields
        for name, field in new_fields.items():
            out.append((feed, file_id, "column", name, None, field["type"], field))
    return [(*row[:6], row[6]["target"] if isinstance(row[6], dict) else None) for row in out]


def schema_changes(files: DataFrame, lines: DataFrame, rules: list[Rule], steps: int = STEPS) -> DataFrame:
    """Columns (``kind`` = column, with type and canonical name if known) and changes of every file.

    The lines are reduced to profiles before anything is shuffled, and the values of those columns only that went or came
    are compared, in Spark; what one task sees of a feed is a row per file and column and one per compared pair.
    """
    partial = materialize(profile(lines, rules), "p1-profile")
    listed = files.filter("feed is not null and file_id is not null").select("file_id", "feed", "delivered_on").distinct()
    numbers = ["records", "n", "n_string", "n_number", "n_boolean"]
    counts = partial.groupBy("file_id", "column").agg(*(F.sum(c).alias(c) for c in numbers), F.array_distinct(F.flatten(F.collect_set("kids"))).alias("kids"))
    whole = counts.filter("column = ''").select("file_id", F.col("records").alias("_records"))
    present = materialize(counts.filter("column <> ''").drop("records").join(whole, "file_id").filter("2 * n >= _records").drop("_records"), "p1-columns")
    before = F.lag("file_id").over(Window.partitionBy("feed").orderBy(F.col("delivered_on").asc_nulls_first(), "file_id"))  # a row per file
    pairs = listed.withColumn("_old", before).filter("_old is not null").select("file_id", "_old")
    names = present.select("file_id", "column")
    was = pairs.join(names.withColumnRenamed("file_id", "_old"), "_old").select("file_id", "column", F.col("_old").alias("_at"))
    now = pairs.join(names, "file_id").select("file_id", "column", F.col("file_id").alias("_at"))
    gone, come = was.join(now, ["file_id", "column"], "left_anti").withColumn("side", F.lit(0)), now.join(was, ["file_id", "column"], "left_anti").withColumn("side", F.lit(1))
    both_sides = gone.select("file_id").distinct().join(come.select("file_id").distinct(), "file_id")
    asked = gone.unionByName(come).join(both_sides, "file_id", "left_semi")
    held = partial.select(F.col("file_id").alias("_at"), "column", F.arrays_zip("keys", "vals").alias("_kv")).filter("size(_kv) > 0")
    values = asked.join(held, ["_at", "column"]).select("file_id", "side", "column", F.explode("_kv").alias("_e"))
    values = values.groupBy("file_id", "side", "column", F.col("_e.keys").alias("key")).agg(F.max("_e.vals").alias("val"))
    said = materialize(evidence(materialize(values, "p1-values")).join(listed.select("file_id", "feed"), "file_id"), "p1-evidence")
    columns = listed.join(present, "file_id", "left")

    def run(key, group, told):  # noqa: ANN001, ANN202
        rows = follow(key[0], group, told, rules, steps) if len(group) else []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _CHANGES.split(", ")])

    return columns.groupBy("feed").cogroup(said.groupBy("feed")).applyInPandas(run, _CHANGES)


def valid_records(lines: DataFrame) -> DataFrame:
    """``file_id`` and ``_values`` (key to text as written) of every line that is a JSON object, by the same reading as the
    profiles."""

    def text(value: object) -> str | None:
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value, ensure_ascii=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, line in zip(batch["file_id"].to_numpy(), batch["line"].to_numpy()):
                record = parse(line, True)
                if record is not None and file_id == file_id and file_id is not None:
                    out.append((int(file_id), {k: text(v) for k, v in record.items()}))
            yield pd.DataFrame(out, columns=["file_id", "_values"])

    return lines.select("file_id", "line").mapInPandas(run, "file_id bigint, _values map<string,string>")


def _typed(text, kind: str):
    """A value written as text in a column's type, null where it does not fit."""
    folded_text = F.lower(F.trim(text))
    if kind == "boolean":
        return F.when(folded_text.isin(*TRUE), True).when(folded_text.isin(*FALSE), False)
    if kind == "date":
        digits = F.regexp_replace(text, "[-/.]", "")
        return F.when(digits.rlike("^[0-9]{8}$"), F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))
    if kind.startswith("decimal"):
        return F.regexp_replace(text, r"[%,\s]", "").try_cast(kind)
    return text.try_cast(kind)


def united(files: DataFrame, lines: DataFrame, changes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The records of all files with one set of typed columns; what belongs to none of them is kept in ``extras``.

    A column takes the canonical name of its field, which any of the field's names may have given it; a name that no rule
    knows takes the canonical name that it goes by most often in other feeds.
    """
    columns = changes.filter("kind = 'column'").select("file_id", "name", "target")
    votes = columns.filter("target is not null").groupBy("name", "target").count()
    voted = votes.groupBy("name").agg(F.max(F.struct("count", F.col("target").alias("usual")))["usual"].alias("usual"))
    named = columns.join(voted, "name", "left").select("file_id", "name", F.coalesce("target", "usual").alias("target"))
    mapping = named.filter(F.col("target").isin(*fields)).groupBy("file_id", "target").agg(F.min("name").alias("name"))
    mapping = mapping.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "name"))).alias("_names"))  # a file's columns
    joined = valid_records(lines).join(mapping, "file_id", "left").join(files.select("file_id", "feed", "delivered_on"), "file_id")
    used = F.coalesce(F.map_values("_names"), F.array().cast("array<string>"))
    typed = [_typed(F.col("_values")[F.col("_names")[name]], kind).alias(name) for name, kind in fields.items()]
    extras = F.to_json(F.map_filter("_values", lambda k, v: ~F.array_contains(used, k)))
    return joined.select(F.col("feed").alias("source"), "file_id", F.col("delivered_on").alias("as_of"), *typed, extras.alias("extras"))
