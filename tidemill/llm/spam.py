"""Keyword-stuffed pages, tag lists and link lists.

1. Each page is read once: its words are counted, and its lines are weighed as sentences, keywords, links, or data and
   code.  What leaves this step is a few numbers per page, its counts of words, and its frequency spectrum (how many words
   occur how often), so texts are never shuffled.
2. SQL windows turn each spectrum into a rank-frequency curve, and a least-squares line is fitted to it in log-log space.
3. Prose of each language and length, taken over all different texts, gives the usual slope, residual and number of
   different words, and the usual distribution of words, from which every page's Jensen-Shannon divergence is taken.
   A page is flagged if it diverges more, or if its curve is more extreme, than prose of its language and length does.
4. Of the flagged pages those are cases that are not data or code for the most part and that hold keywords or links in some
   number, or so few different words for their length that the same keywords must fill their sentences.  This check alone
   would take in many pages of sentences with lists; the curves and the divergence tell which of them read like prose.

Defined results: null, empty and very short texts are no cases; equal texts are judged alike; the language is told from
the script of the text, never from a ``lang`` column; texts are read whole; pages of a length of which there is too little
prose are compared with all prose of their language.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Words that sentences are built with.
FUNCTION_EN = frozenset(
    "a an of to and for in on was is are were be been with by from that had has have which not but it its only after before as at "
    "or if they this their our than while until since during although because may might should could would also both into nobody "
    "whoever where does do did what how when who why can will you your we i about against over without beside under between there".split()
)
PARTICLES_JA = frozenset("の を は が に へ で と も では には とは にも でも からは までに より から まで".split())
ENDING_JA = re.compile(r"(?:した|ます|ません|です|でした|する|れる|いる|ある|ない|なり|なる|って|して|された|られ|ください|こと|ため|ので|について|によると|よると|あいだ|まとめ|でき\w*|われ|った|いた|んだ|たい|なら|せん|すなら|か|ね|よ|きまり|まり)$")

TOKEN = re.compile(r"[a-z][a-z0-9_]*|[一-龥々]+|[ァ-ヺー]+|[ぁ-ん]+|[0-9]+")
SHOWN = re.compile(r'(?:alt|content|title)="([^"]*)"')
TAG = re.compile(r"<[^<>]*>")
LINK = re.compile(r"(?:https?://|www\.)[^\s<>\")\],\x80-\U0010ffff]+")
BARE = re.compile(r"[a-z0-9-]+(?:\.|\[\.\]|\(\.\)| dot )(?:example|test|invalid|com|net|org|info|biz|io|jp)(?![a-z0-9])(?:[/?][^\s<>\")\],\x80-\U0010ffff]*)?")
BARE_HINT = re.compile(r"[.\])](?:example|test|invalid|com|net|org|info|biz|io|jp)(?![a-z0-9])")
DOT_HINT = re.compile(r"dot (?:example|test|invalid|com|net|org|info|biz|io|jp)(?![a-z0-9])")
SPACED = re.compile(r"(?<![^\W_])\w(?:[.\- ]\w)+(?![^\W_])")
#: Joiners, marks without width and pictographs; removed before reading.
UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff\ufe0f\U0001f000-\U0001faff\u2600-\u2604\u2607-\u27bf\u20e3]")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
FIELD = re.compile(r"\s*[|/,;・、\t]\s*")
NUMBER = re.compile(r"[a-z#]{0,4}[\d.,:/%$¥-]*\d[\d.,:/%$¥-]*$")
BLOB = re.compile(r"[a-z0-9+/=_-]{40,}+")
CODE = re.compile(
    r"\s*(?:\[?\d{4}-\d\d-\d\d[t ]\d\d:\d\d|file \"|traceback|at [\w.$]+\(|(?:create|select|insert|update|delete|where|def|import|return) |from \w+$|group by|order by|limit \d|[){}]|\w+error\b)"
)
CODE_INSIDE = re.compile(r"\b(?:info|warn|error|debug)\b.*\[\d+\]|decimal\(|(?:string|int|date|timestamp|double|bigint) comment|[;{]\s*$")
CODE_HINTS = (" comment", "decimal(", ";\n", "{\n", "info ", "warn ", "error ", "debug ")
CODE_MORE = re.compile(r"\s{2,}\S|\S+,$|\)")

EN_THE, EN_FUNCTION, EN_WORD, JA_GRAMMAR, JA_WORD, DIGITS = range(6)
_class: dict[str, int] = {}


def _class_of(token: str) -> int:
    first = token[0]
    if first.isascii():
        if first.isdigit():
            return DIGITS
        return EN_THE if token == "the" else EN_FUNCTION if token in FUNCTION_EN else EN_WORD
    if "ぁ" <= first <= "ん":
        return JA_GRAMMAR if token in PARTICLES_JA or ENDING_JA.search(token) else JA_WORD
    return JA_WORD


def classes(tokens: list[str]) -> list[int]:
    """How many tokens there are of each class."""
    out, known = [0] * 6, _class
    for token in tokens:
        if token not in known:
            if len(known) > 200_000:
                known.clear()
            known[token] = _class_of(token)
        out[known[token]] += 1
    return out


def _hinted(text: str) -> bool:
    """Whether a text may have an address without its scheme."""
    return BARE_HINT.search(text) is not None or ("dot " in text and DOT_HINT.search(text) is not None)


def is_prose(kinds: list[int]) -> bool:
    the, function, word, grammar, ja, _ = kinds
    en = the + function + word
    if grammar and grammar * 8 >= grammar + ja and (grammar + ja) * 2 >= word:
        return True
    return function >= 1 and en >= 3 and (the + function) * 20 >= en * 3 and en * 2 >= ja


class Page:
    """Weights (in characters) of the parts of a text, and its words."""

    __slots__ = ("words", "kinds", "prose", "keyword", "link", "links", "keywords", "other", "tags", "_tokens")

    def __init__(self, text: str) -> None:
        self._tokens: list[str] = []
        self.kinds = [0] * 6
        self.prose = self.keyword = self.link = self.links = self.keywords = self.other = self.tags = 0
        if not text.isascii():
            text = UNSEEN.sub("", text)
            if not unicodedata.is_normalized("NFKC", text):
                text = "\n".join([line if unicodedata.is_normalized("NFKC", line) else unicodedata.normalize("NFKC", line) for line in text.split("\n")])
        text = text.lower()
        bare, http, tags = _hinted(text), "http" in text or "www." in text, "<" in text
        hint, blob = any(h in text for h in CODE_HINTS), BLOB.search(text) is not None
        code = False
        for line in text.split("\n"):
            if not line or line.isspace():
                code = False
                continue
            if CODE.match(line) or (hint and CODE_INSIDE.search(line)) or (code and CODE_MORE.match(line)):
                code = True
                self.other += len(line)
                self._tokens += TOKEN.findall(line)
                continue
            code = False
            self._line(line, bare, http, tags, blob)
        self.words = Counter(self._tokens)
        self._tokens = []

    def _line(self, line: str, bare: bool, http: bool, tags: bool, blob: bool) -> None:
        links: list[str] = []
        plain, link_size = line, 0
        if (http and ("http" in line or "www." in line)) or bare:
            links = LINK.findall(line)
            plain = LINK.sub(" ", line) if links else line
            if bare and _hinted(plain):
                links += BARE.findall(plain)
                plain = BARE.sub(" ", plain)
            link_size = sum(map(len, links))
        marks = 0
        if tags and "<" in plain:
            shown = SHOWN.findall(plain)
            marks = len(plain)
            plain = TAG.sub(" ", plain) + " " + " | ".join(shown)
            marks -= len(plain)
            self.tags += line.count("<")
        if blob:
            blobs = [b for b in BLOB.findall(plain) if any(c.isdigit() for c in b)]
            for b in blobs:
                plain = plain.replace(b, " ")
            self.other += sum(map(len, blobs))
        tokens = TOKEN.findall(plain)
        if len(tokens) > 5 and len(plain) < 3 * len(tokens) and len([t for t in tokens if len(t) == 1 and not "ぁ" <= t <= "ん"]) * 3 > len(tokens):
            plain = SPACED.sub(lambda m: re.sub(r"[.\- ]", "", m.group()), plain)
            tokens = TOKEN.findall(plain)
        kinds = classes(tokens)
        self._tokens += tokens
        for i, n in enumerate(kinds):
            self.kinds[i] += n
        the, function, word, grammar, ja, digits = kinds
        if digits * 3 >= len(tokens) and not links and not marks:
            fields = [f for f in FIELD.split(line.strip()) if f]
            if len(fields) >= 3 and sum(1 for f in fields if NUMBER.match(f)) * 10 >= len(fields) * 3:
                self.other += len(line)
                return
        en = the + function + word
        if not marks and ((function >= 2 and (the + function) * 5 >= en and en >= ja) or (grammar * 4 >= grammar + ja > 0 and grammar + ja >= en)):
            self.prose += len(plain)  # sentences all along
            if len(links) > 2 + 2 * (function + grammar):
                self.link, self.links = self.link + link_size, self.links + len(links)
            return
        sentences, rest, rest_tokens = 0, 0, 0
        pieces = SENTENCE.split(plain)
        for piece in pieces:
            own = classes(TOKEN.findall(piece)) if len(pieces) > 1 else kinds
            size = len(" ".join(piece.split()))
            if is_prose(own):
                sentences += 1
                self.prose += size
            else:
                rest += size
                rest_tokens += sum(own) - own[DIGITS]
        self.keyword += rest
        self.keywords += rest_tokens
        if links and (not sentences or len(links) > 2 * sentences):
            self.link, self.links = self.link + link_size + max(marks, 0), self.links + len(links)
        elif marks and not sentences:
            self.keyword += min(marks, 2 * rest)

    def spectrum(self) -> dict[int, int]:
        return Counter(self.words.values())

    def distribution(self) -> dict[str, int]:
        """Counts of words, where all numbers are one word, and so are all links and all tags."""
        out = {w: n for w, n in self.words.items() if w > ":"}  # numbers sort before it, all other words after
        for name, n in (("<number>", sum(self.words.values()) - sum(out.values())), ("<link>", self.links), ("<tag>", self.tags)):
            if n:
                out[name] = n
        return out


#: Weight of keywords and links that makes a flagged page a case, as a share of the page (weights are in characters, and the
#: text of a link list's link counts as keyword); words or links that there must be at least.
SOME, LEAST_WORDS, LEAST_LINKS = 0.2, 7, 3
#: Different words of a page as a share of what prose of its language and length has; different prose texts that a band of
#: length needs to speak for itself; and different words that prose has whatever the corpus.
FEW_WORDS, LEAST_PAGES, LEAST_TYPES = 0.53, 20, 30
#: A page is flagged if its divergence lies this many robust standard deviations above that of prose, or the slope or the
#: residual of its curve this many away from it.
DIVERGENT, EXTREME = 2.0, 5.0
#: Words of one language and octave of length that the reference distribution names; the rest of a page counts as unnamed.
VOCABULARY = 1000

_FIELDS = ["tokens", "types", "prose", "keyword", "link", "links", "keywords", "other", "counted", "ja"]
_SCHEMA = "digest bigint, " + ", ".join(f"{f} bigint" for f in _FIELDS) + ", spectrum array<struct<f:bigint,n:bigint>>, words array<struct<w:string,n:bigint>>"


def _lists(rows: list[dict], kind: pa.DataType, names: tuple[str, str]) -> pa.Array:
    """Dictionaries as a list column of pairs."""
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    keys, values = [k for r in rows for k in r], [v for r in rows for v in r.values()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, kind), pa.array(values, pa.int64())], names=names))


def read_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row of numbers and counts per non-empty text, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, spectra, words = [], {f: [] for f in _FIELDS}, [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                if not value:
                    continue
                page = Page(value)
                the, function, word, grammar, ja, _ = page.kinds
                counts = page.distribution()
                row = (
                    sum(page.words.values()), len(page.words), page.prose, page.keyword, page.link, page.links, page.keywords, page.other,
                    sum(counts.values()), int(grammar + ja > the + function + word),
                )
                keys.append(i)
                for name, number in zip(_FIELDS, row):
                    out[name].append(number)
                spectra.append(page.spectrum())
                words.append(counts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(keys, pa.int64())) for c in (key, "digest")), *(pa.array(out[f], pa.int64()) for f in _FIELDS), _lists(spectra, pa.int64(), ("f", "n")), _lists(words, pa.string(), ("w", "n"))],
                names=[key, "digest", *_FIELDS, "spectrum", "words"],
            )

    return docs.select(key, text, F.xxhash64(text).alias("digest")).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, {_SCHEMA}")


def curves(pages: DataFrame, key: str) -> DataFrame:
    """Slope and residual of each page's rank-frequency curve (words of equal frequency share the last rank they take)."""
    points = pages.select(key, F.explode("spectrum").alias("s")).select(key, F.col("s.f").alias("f"), F.col("s.n").alias("n"))
    rank = F.sum("n").over(Window.partitionBy(key).orderBy(F.col("f").desc()).rowsBetween(Window.unboundedPreceding, 0))
    x, y = F.log(rank), F.log("f")
    fit = points.select(key, x.alias("x"), y.alias("y")).groupBy(key).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.count(F.lit(1)).alias("points")
    )
    left = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    return fit.select(key, F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce(F.sqrt(left / F.col("points")), F.lit(0.0)).alias("residual"))


def _is_prose() -> Column:
    return F.col("prose") > F.col("keyword") + F.col("link") + F.col("other")


def divergences(pages: DataFrame, key: str) -> DataFrame:
    """Jensen-Shannon divergence (0 to 1) of each page's words from those of prose of its language and octave of length.

    The reference is the mean distribution over texts, cut to its ``VOCABULARY`` most frequent words, so it is
    bounded by languages, octaves and that number whatever the corpus; a word that it does not name shares nothing.
    """
    octave = F.floor(F.log2(F.greatest("counted", F.lit(1)))).cast("int")
    pages = pages.select(key, "digest", "ja", octave.alias("octave"), F.greatest("counted", F.lit(1)).alias("counted"), "words", _is_prose().alias("_prose"))
    # copies of a text that has more than one page in a thousand weigh as one page; there are less than a thousand such texts
    total = pages.agg(F.count(F.lit(1)).alias("_all"))  # one row
    heavy = pages.filter("_prose").groupBy("digest").agg(F.count(F.lit(1)).alias("_copies")).join(F.broadcast(total)).filter("_copies > 1 and _copies * 1000 > _all").select("digest", "_copies")
    prose = pages.filter("_prose").join(F.broadcast(heavy), "digest", "left").withColumn("_weight", 1 / F.coalesce("_copies", F.lit(1)))
    words = prose.select("ja", "octave", (F.col("_weight") / F.col("counted")).alias("_each"), F.explode("words").alias("e"))
    sums = words.groupBy("ja", "octave", F.col("e.w").alias("w")).agg(F.sum(F.col("e.n") * F.col("_each")).alias("s"))
    texts_of = prose.groupBy("ja", "octave").agg(F.sum("_weight").alias("texts"))
    sums = materialize(sums, "p10-words")
    every = sums.groupBy("ja", "w").agg(F.sum("s").alias("s")).withColumn("octave", F.lit(-1))
    sums = sums.unionByName(every)
    of_language = texts_of.groupBy("ja").agg(F.sum("texts").alias("texts")).withColumn("octave", F.lit(-1))
    own = texts_of.filter(F.col("texts") >= LEAST_PAGES)
    sizes = own.unionByName(of_language)  # two languages, some twenty octaves
    top = F.row_number().over(Window.partitionBy("ja", "octave").orderBy(F.desc("s"), "w"))
    reference = sums.withColumn("_at", top).filter(F.col("_at") <= VOCABULARY).join(F.broadcast(sizes), ["ja", "octave"]).select("ja", F.col("octave").alias("_ref"), "w", (F.col("s") / F.col("texts")).alias("q"))
    reference = materialize(reference, "p10-reference")
    named = reference.groupBy("ja", "_ref").agg(F.sum("q").alias("_named"))
    chosen = own.select("ja", "octave", F.col("octave").alias("_own"))
    each = pages.join(F.broadcast(chosen), ["ja", "octave"], "left").select(key, "ja", F.coalesce("_own", F.lit(-1)).alias("_ref"), "counted", F.explode("words").alias("e"))
    met = each.select(key, "ja", "_ref", F.col("e.w").alias("w"), (F.col("e.n") / F.col("counted")).alias("p")).join(F.broadcast(reference), ["ja", "_ref", "w"])
    p, q = F.col("p"), F.col("q")
    shared = met.groupBy(key).agg(F.sum(p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q)) - p - q).alias("_shared"))
    refs = pages.join(F.broadcast(chosen), ["ja", "octave"], "left").select(key, "ja", F.coalesce("_own", F.lit(-1)).alias("_ref"))
    # what only one side has counts a full bit; the reference's unnamed rest is left out of it
    out = refs.join(shared, key, "left").join(F.broadcast(named), ["ja", "_ref"], "left")
    return out.select(key, ((1 + F.coalesce("_named", F.lit(1.0)) + F.coalesce("_shared", F.lit(0.0))) / (1 + F.coalesce("_named", F.lit(1.0)))).alias("divergence"))


def judge_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every non-empty page with its measures, ``flagged`` by them, and ``case``."""
    pages = materialize(read_pages(docs, key, text), "p10-pages")  # numbers and counts; read several times below
    measured = pages.drop("spectrum", "words").join(curves(pages, key), key, "left").fillna(0.0, ["slope", "residual"]).join(divergences(pages, key), key, "left")
    tokens = F.greatest("tokens", F.lit(1))
    band = F.floor(F.log2(tokens) * 2).cast("int")
    measured = measured.withColumns({"band": band, "variety": F.log(F.greatest("types", F.lit(1)) / F.greatest("tokens", F.lit(1)))})
    measured = materialize(measured, "p10-measured")
    names = ["slope", "residual", "variety", "divergence"]
    prose = measured.filter(_is_prose()).dropDuplicates(["digest"])  # copies of a text count once
    middle = prose.groupBy("ja", "band").agg(
        *(F.percentile_approx(n, [0.16, 0.5, 0.84], 500).alias(f"q_{n}") for n in names), F.percentile_approx("types", 0.5, 500).alias("m_types"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= LEAST_PAGES).drop("n")
    whole = prose.groupBy("ja").agg(*(F.percentile_approx(n, [0.16, 0.5, 0.84], 500).alias(f"w_{n}") for n in names))
    # longer prose has no fewer words than shorter prose, and no greater share of different ones: bounds from other bands
    other = middle.select("ja", F.col("band").alias("_band"), F.log("m_types").alias("_types"), F.col("q_variety")[1].alias("_variety"))
    bounds = measured.select("ja", "band").distinct().join(F.broadcast(other), "ja").groupBy("ja", "band").agg(
        F.max(F.when(F.col("_band") < F.col("band"), F.col("_types"))).alias("b_types"), F.max(F.when(F.col("_band") > F.col("band"), F.col("_variety"))).alias("b_variety")
    )
    middle = middle.join(bounds, ["ja", "band"], "right")
    # at most two languages and some fifty bands of length: bounded whatever the corpus
    joined = measured.join(F.broadcast(middle), ["ja", "band"], "left").join(F.broadcast(whole), "ja", "left")

    def away(n: str) -> Column:
        q = F.coalesce(f"q_{n}", f"w_{n}", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
        return (F.col(n) - q[1]) / F.greatest((q[2] - q[0]) / 2, F.lit(0.02))

    joined = joined.withColumns({f"z_{n}": away(n) for n in ("slope", "residual", "divergence")})
    # a band speaks for itself unless it is thin or its prose has fewer words than that of shorter bands
    least = F.least(tokens, F.lit(LEAST_TYPES))
    trusted = F.log("m_types") >= F.greatest("b_types", F.log(least * FEW_WORDS))
    usual = F.when(trusted, F.col("q_variety")[1]).otherwise(F.greatest(F.col("b_types") - F.log(tokens), "b_variety", F.log(least / tokens)))
    few = (F.col("variety") - usual < math.log(FEW_WORDS)) & (F.col("tokens") >= 20)
    flagged = (F.col("z_divergence") > DIVERGENT) | (F.abs("z_slope") > EXTREME) | (F.abs("z_residual") > EXTREME) | few
    bare = F.col("prose") == 0  # without a sentence, a link or two with their words are a list as well
    link = F.when((F.col("links") >= LEAST_LINKS) | bare, F.col("link")).otherwise(0)
    bad = F.col("keyword") + link
    enough = (F.col("keywords") >= LEAST_WORDS) | (F.col("links") >= LEAST_LINKS) | (bare & (F.col("links") >= 2) & (F.col("keywords") >= 4))
    some = (bad >= SOME * (bad + F.col("prose") + F.col("other"))) & enough
    data = F.col("other") >= 0.4 * (F.col("prose") + bad + F.col("other"))
    return joined.withColumns({"few": few, "flagged": flagged, "left": (some | few) & ~data, "share": bad / F.greatest(bad + F.col("prose") + F.col("other"), F.lit(1))}).withColumn("case", F.col("flagged") & F.col("left"))
