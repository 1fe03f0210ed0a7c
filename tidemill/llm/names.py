"""Variant spellings of the names of persons and organisations.

1. Every name is reduced to tokens in Latin letters: readings of written names come from a table of readings, kana are
   transcribed, titles, legal forms, departments and marks are taken off, short names are replaced by what they stand for.
2. Names alone do not tell namesakes apart, so records are compared only where another column speaks for them (the same
   mailbox or company domain, the same date of birth, the same house number).  Within such evidence, candidates come from a
   join on the q-grams of the tokens; one gram is the least that verified names share.  Where very many names share one
   evidence, a gram says too little, and they are joined on signatures that only tokens which are alike have in common, of
   the tokens that weigh so much that no accepted pair can do without all of them (a prefix filter by weight).  Both ways
   bring together all pairs that verification accepts, so the size of a group divides work and changes no result.
3. Candidates are verified by soft weighted token similarity: tokens pair up by edit distance, initials and contractions,
   and a token weighs more the rarer it is.  Evidence against (two mailboxes, two dates of birth) rules a pair out.
4. Links are closed to classes by propagating the smallest id.

Defined results: rows whose name is null, blank, a mark or a placeholder name nobody and are in no pair, as are rows
without a numeric user_id; day and month of a birth date may be exchanged; records of one user_id never form a pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .addresses import VARIANTS, distance
from .links import classes

# Placeholders, titles, legal forms, and the words of lines of business in both languages.
NOBODY = frozenset("test testuser user テスト テストユーザー 名無し ななし 名前なし 不明 匿名 同上 なし 未入力 未登録 unknown none null na anonymous noname dummy guest xxx sample".split())
TITLES = frozenset("mr mrs ms miss mx dr prof sir the co ltd limited corp corporation company inc incorporated kk gk llc plc jr sr ii iii".split())
SUFFIX = re.compile(r"(?:様|さん|殿|御中|氏|先生)\s*$")
LEGAL = re.compile(r"株式会社|有限会社|合同会社|㈱|㈲|[（(](?:株|有|同|kk|本人)[)）]|^\s*[カユド株有]\s*[）)]|[（(]\s*[カユド]\s*[）)]?\s*$", re.IGNORECASE)
DEPARTMENT = re.compile(r"[（(\[【][^()（）\[\]【】]{1,20}[)）\]】]|(?<=\s)\S{1,6}(?:部|課|係|室)\s*$|,?\s*\b(?:sales|accounting|purchasing|general affairs|hr|it)\s+(?:dept|department|division)\b\.?", re.IGNORECASE)
BUSINESS = {
    "不動産": "real estate", "化学": "chemical", "観光": "travel", "システムズ": "systems", "物流": "logistics", "運輸": "transport",
    "投信": "asset management", "電機": "electric", "商事": "trading", "印刷": "printing", "書店": "books", "書房": "books", "食品": "foods",
    "工業": "industries", "製作所": "manufacturing", "建設": "construction", "銀行": "bank", "証券": "securities", "保険": "insurance",
}
SHORT_NAMES = {
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "bill": "william", "will": "william", "billy": "william", "kathy": "katherine",
    "kate": "katherine", "katie": "katherine", "dan": "daniel", "danny": "daniel", "sam": "samuel", "matt": "matthew", "sue": "susan", "alex": "alexander",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "tom": "thomas", "rick": "richard", "dick": "richard", "rich": "richard", "nick": "nicholas",
    "chuck": "charles", "charlie": "charles", "bob": "robert", "rob": "robert", "bobby": "robert", "jim": "james", "jimmy": "james", "mike": "michael",
    "mick": "michael", "joe": "joseph", "ed": "edward", "ted": "edward", "eddie": "edward", "ben": "benjamin", "chris": "christopher", "andy": "andrew",
    "drew": "andrew", "tony": "anthony", "greg": "gregory", "jen": "jennifer", "jenny": "jennifer", "abby": "abigail", "liz": "elizabeth",
    "beth": "elizabeth", "betty": "elizabeth", "becky": "rebecca", "steve": "steven", "dave": "david", "theo": "theodore", "ron": "ronald",
    "teddy": "theodore", "tori": "victoria", "vic": "victoria", "steph": "stephanie", "stevie": "stephanie", "gwen": "gwendolyn", "fred": "frederick",
    "phil": "philip", "pete": "peter", "tim": "timothy", "jeff": "jeffrey", "josh": "joshua", "zach": "zachary", "nate": "nathaniel", "lizzie": "elizabeth",
    "sandy": "alexander", "kit": "christopher", "jamie": "james", "ken": "kenneth", "larry": "lawrence", "jack": "john", "jon": "jonathan", "debbie": "deborah", "vicky": "victoria", "cathy": "catherine",
}

CONTRACTED = {
    "am": "asset management", "re": "real estate", "mfg": "manufacturing", "elec": "electric", "sys": "systems", "chem": "chemical", "trdg": "trading",
    "trad": "trading", "trvl": "travel", "bks": "books", "prtg": "printing", "prnt": "printing", "print": "printing", "logis": "logistics", "trans": "transport",
    "transp": "transport", "ind": "industries", "inds": "industries", "fds": "foods", "lgstcs": "logistics",
}

_VOWELS = "aiueo"
_ROWS = {"": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ"}
_SPECIAL = {"シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "zu", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "o", "ン": "n", "ヴ": "vu", "ー": "", "ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o"}
KANA = {k: c + v for c, row in _ROWS.items() for k, v in zip(row, _VOWELS)} | _SPECIAL


def transcribed(kana: str) -> str:
    """Katakana in Latin letters."""
    out: list[str] = []
    double = False
    for c in kana:
        if c == "ッ":
            double = True
        elif c in "ャュョ" and out:
            last, v = out[-1], {"ャ": "a", "ュ": "u", "ョ": "o"}[c]
            out[-1] = last[:-1] + (v if last.endswith(("shi", "chi", "ji")) else "y" + v)
        elif c in KANA:
            out.append((KANA[c][:1] if double else "") + KANA[c])
            double = False
    return "".join(out)


_SOUNDS = [("shi", "si"), ("chi", "ti"), ("tsu", "tu"), ("fu", "hu"), ("ji", "zi"), ("sh", "sy"), ("ch", "ty"), ("j", "zy")]
#: The letters that an initial may stand for under the other rule.
_INITIALS = {"c": "t", "j": "z", "f": "h"}


def level(word: str) -> str:
    """Long vowels and doubled letters made single and one letter for one sound, so that transcriptions by different
    rules agree (Ohno, Ono; Chika, Tika)."""
    word = re.sub(r"[^a-z]", "", word.lower())
    if len(word) == 1:
        return word
    word = re.sub(r"oh(?![aiueo])", "o", word).replace("ou", "o")
    for one, other in _SOUNDS:
        word = word.replace(one, other)
    return re.sub(r"(.)\1+", r"\1", word)


class Names:
    """Names to tokens, by a table of readings."""

    def __init__(self, readings: list[tuple[str, str, str, str]]) -> None:
        self.surname = {w.translate(VARIANTS): level(r) for k, w, _, r in readings if k == "surname" and r}
        self.given = {w.translate(VARIANTS): level(r) for k, w, _, r in readings if k == "given" and r}

    def _written(self, word: str) -> list[str]:
        """Tokens of a word of Chinese characters and kana."""
        word = word.translate(VARIANTS)
        for table in (self.surname, self.given):
            if word in table:
                return [table[word]]
        kana = "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in word)
        if re.fullmatch(r"[ァ-ヺー]+", kana):
            return [level(transcribed(kana))]
        for end in range(len(word) - 1, 0, -1):  # a surname run together with what follows
            if word[:end] in self.surname:
                rest = word[end:]
                return [self.surname[word[:end]], *([self.given[rest]] if rest in self.given else self._written(rest))]
        for end in range(1, len(word)):
            if word[end:] in self.given:
                return [*([word[:end]]), self.given[word[end:]]]
        parts = re.findall(r"[ァ-ヺーぁ-ゖ]+|[^ァ-ヺーぁ-ゖ]+", word)
        return [t for p in parts for t in self._written(p)] if len(parts) > 1 else [word]

    def tokens(self, name: str | None) -> tuple[list[str], bool]:
        """(tokens, whether it is an organisation); no tokens for a name that names nobody."""
        text = unicodedata.normalize("NFKC", name or "").strip()
        text = re.sub(r"[​-‏﻿]", "", text)
        if re.sub(r"[\W_]", "", text).casefold() in NOBODY or not re.sub(r"[\W_\d]", "", text):
            return [], False
        plain = LEGAL.sub(" ", text)
        organisation = plain != text and not re.search("本人", text)
        plain = DEPARTMENT.sub(" ", plain)
        plain = SUFFIX.sub("", plain.strip())
        for word, english in BUSINESS.items():
            if plain.rstrip().endswith(word) and len(plain.strip()) > len(word):
                plain, organisation = plain.rstrip()[: -len(word)] + " " + english, True
        plain = re.sub(r"(?i)(?<![,\s])\s+r\.\s*e\.?(?=\W|$)", " real estate ", plain)
        plain = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", plain)  # names run together
        out: list[str] = []
        words = re.findall(r"[A-Za-z']+|[^\W\d_A-Za-z]+", plain.replace("・", " ").replace("゛", ""))
        for word in words:
            if word.isascii():
                lower = word.lower().replace("'", "")
                if lower in TITLES:
                    organisation = organisation or lower in ("co", "ltd", "corp", "corporation", "company", "inc", "kk", "llc")
                    continue
                if lower in ("real", "estate", "asset", "management", "chemical", "travel", "systems", "logistics", "transport", "electric", "trading", "printing", "books", "foods", "industries", "manufacturing"):
                    organisation = True
                if lower in CONTRACTED and (len(out) > 1 or (out and (organisation or word is words[-1]))):
                    out += [level(w) for w in CONTRACTED[lower].split()]
                    continue
                out.append(level(SHORT_NAMES.get(lower, lower)))
            else:
                out += self._written(word)
        return [t for t in out if t], organisation


def alike(a: str, b: str) -> float:
    """Likeness of two tokens: edits, an initial or beginning, or a contraction."""
    if a == b:
        return 1.0 if len(a) > 1 else 0.85  # an initial rather stands for a name than for another initial
    if len(a) > len(b):
        a, b = b, a
    if b.startswith(a) and (len(a) <= 4 or len(a) * 2 >= len(b)) or (len(a) == 1 and b.startswith(_INITIALS.get(a, a))):
        return 0.9
    most = 1 if len(b) <= 5 else 2 if len(b) <= 9 else 3
    d = distance(a, b, most)
    if d <= most:
        return 1.0 - d / len(b)
    if len(a) >= 3 and a[0] == b[0]:  # a contraction keeps the order of its letters
        rest = iter(b)
        if all(c in rest for c in a) and len(a) * 3 >= len(b) and not set("aeiou") & set(a[1:]):
            return 0.85
    return 0.0


def joined(word: str, parts: list[str]) -> float:
    """Likeness of a word and a name of two parts that may be written in it together, the second as an initial."""
    best = 0.0
    for first, second in (parts, parts[::-1]):
        if len(first) > 2 and len(second) == 1 and word.startswith(first) and len(word) > len(first) and alike(second, word[len(first) :]) >= 0.9:
            best = 0.85
    return best


def similarity(a: list[str], b: list[str], weight) -> float:
    """Soft weighted token similarity; rare tokens count more.  Names of which one is written in fewer words are also
    compared as a whole."""
    if not a or not b:
        return 0.0
    if (len(a), a) > (len(b), b):  # the weights of the first name count, so which one that is must not depend on the order
        a, b = b, a
    # whole tokens find their partners before initials do
    pairs = sorted(((min(len(x), len(y)) > 1, alike(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    left, right = set(range(len(a))), set(range(len(b)))
    shared, named = 0.0, False
    for _, s, i, j in pairs:
        if s >= 0.6 and i in left and j in right:
            left.discard(i)
            right.discard(j)
            named = named or min(len(a[i]), len(b[j])) > 1
            shared += s * max(weight(a[i]) if len(a[i]) > 1 else 0.5 * weight(b[j]), 0.1)
    lost = sum(weight(a[i]) * (0.15 if len(a[i]) == 1 else 1.0) for i in left)
    spare = sum(weight(b[j]) * (0.15 if len(b[j]) == 1 else 1.0) for j in right)
    whole = shared + lost + spare
    score = shared / whole if whole and named else 0.0  # initials alone name nobody
    if len(a) == 1 or (score < 0.75 and len(a) != len(b)):
        x = "".join(a)
        for y in {"".join(b), "".join(reversed(b))} if len(b) <= 3 else {"".join(b)}:
            most = max(1, min(3, len(y) // 5))
            d = distance(x, y, most)
            if d <= most and len(y) >= 5:
                score = max(score, 1.0 - d / len(y))
        if len(a) == 1 and len(b) == 2:
            score = max(score, joined(a[0], b))
    return score


def mailbox(email: str | None) -> tuple[str | None, str | None]:
    """(local part, domain) of an address in one case, without what follows a plus."""
    text = unicodedata.normalize("NFKC", email or "").strip().lower()
    found = re.fullmatch(r"([^@\s+]+)(?:\+[^@]*)?@([^@\s]+)", text)
    return found.groups() if found else (None, None)


_RECORD = "user_id bigint, name string, tokens array<string>, organisation boolean, local string, host string, birth string"

#: Name similarity needed beside each kind of evidence.
SURE = {"box": 0.2, "domain": 0.2, "birth": 0.66, "place": 0.68}
#: Holders of one evidence and gram that one task compares with as many others; only work is divided by it.
BLOCK = 1000
#: Holders of one evidence from which on they are joined on signatures instead of grams; both find the same pairs.
HOT = 300


#: Most entries the table of readings may have; it is held by every worker.
MOST_READINGS = 500_000


def records(users: DataFrame, readings: DataFrame) -> DataFrame:
    """One row per distinct record with a name: tokens and what else speaks for the person."""
    rows = readings.filter("kind in ('surname', 'given')").select("kind", "written", "kana", "romaji").limit(MOST_READINGS + 1).collect()
    if len(rows) > MOST_READINGS:
        raise ValueError(f"the table of readings has more than {MOST_READINGS} entries")
    shared = users.sparkSession.sparkContext.broadcast([tuple(r) for r in rows if r[1]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(shared.value)
        for part in parts:
            out = []
            for user, name, email, birth in part.itertuples(index=False):
                tokens, organisation = names.tokens(name)
                if not tokens:
                    continue
                local, host = mailbox(email)
                day = None
                if birth is not None and birth == birth:
                    day = f"{birth.year}-" + "-".join(map(str, sorted((birth.month, birth.day))))
                out.append((int(user), " ".join(tokens), tokens, organisation, local, host, day))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RECORD.split(", ")])

    cast = users.select(F.expr("try_cast(trim(user_id) as bigint)").alias("user_id"), "user_name", "email", "birth_date")
    read = materialize(cast.filter("user_id is not null and user_name is not null").distinct().mapInPandas(run, _RECORD).distinct(), "p3-read")
    # a firm has a domain of its own, where hardly anybody has a date of birth; a provider's holders are persons
    firms = read.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("_n"), F.count("birth").alias("_born"), F.max("organisation").alias("_firm"))
    firms = firms.filter("_firm and _born * 5 <= _n").select("host", F.lit(True).alias("_own"))
    own = F.coalesce("_own", F.lit(False)) & ~F.coalesce(F.col("local").rlike("[0-9]{4,}"), F.lit(False))
    box = F.when(~own & ~F.col("local").rlike("^[a-z]?[0-9]{6,}$"), F.concat("local", F.lit("@"), "host"))  # an account number names nobody
    out = read.join(firms, "host", "left").select("user_id", "name", "tokens", (F.col("organisation") | own).alias("organisation"), box.alias("box"), F.when(own, F.col("host")).alias("domain"), "birth")
    return out.distinct()


def grams(token: str) -> set[str]:
    """Pairs of letters and the beginning, of which tokens that are ``alike`` share at least one.

    An initial, beginning or contraction shares the beginning; an edit takes at most two pairs away and an exchange of
    neighbours three, which leaves none only in tokens of three and six letters, so these have their sorted letters as well.
    """
    marked = "^" + token
    out = {marked[i : i + 2] for i in range(len(token))}
    if len(token) in (3, 6):
        out.add("~" + "".join(sorted(token)))
    return out


def small_links(people: list[tuple[int, dict]]) -> list[tuple[int, int]]:
    """Links between the few holders of one evidence: those of the pairs with a gram in common that verification accepts,
    but for pairs that links have already brought together."""
    have = [set().union(*(grams(t) for t in p["tokens"])) for _, p in people]
    root = list(range(len(people)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, x) in enumerate(people):
        for j in range(i + 1, len(people)):
            if not have[i].isdisjoint(have[j]):
                a, b = top(i), top(j)
                if a != b and linked(x, people[j][1]):
                    root[max(a, b)] = min(a, b)
    pairs = ((people[i][0], people[top(i)][0]) for i in range(len(people)))
    return [(a, b) for a, b in pairs if a != b]


def deletions(text: str, most: int) -> set[str]:
    """The text and what is left of it without up to ``most`` letters; texts at that distance have one of these in common."""
    out = last = {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def signatures(tokens: list[str], weights: dict[str, float], least: float) -> Iterator[tuple[str, str, bool]]:
    """(signature, token behind it, whether it asks) of a name; two names for which ``similarity`` is at least ``least`` have
    one in common of which at least one side asks.

    Tokens ask if they are in the prefix by weight: the heaviest ones, until the rest weighs less than ``least`` of all.
    Equal tokens share T, those at some edits a D, a beginning and its word a P or Q, a contraction and its word a C, and
    names that are near when written together a J.
    """
    total, rest, asks = sum(weights.get(t, 0.0) for t in tokens), 0.0, set(tokens)
    for t in sorted(set(tokens), key=lambda t: (weights.get(t, 0.0), t)):
        rest += weights.get(t, 0.0) * tokens.count(t)
        if rest >= least * total:
            break
        if len(t) > 1:  # what an initial stands for may weigh more than it does
            asks.discard(t)
    for t in set(tokens):
        ask = t in asks
        yield "T" + t, t, ask
        for v in deletions(t, 1 if len(t) <= 5 else 2 if len(t) <= 9 else 3):
            yield "D" + v, t, ask
        for i in range(1, min(4, len(t)) + 1):
            yield f"P{t[:i]}", t, ask and i == len(t)
            if i < len(t) and ask:
                yield f"p{t[:i]}", t, True
            if i == len(t):
                yield f"p{t}", t, False
        if len(t) == 1 and t in _INITIALS:
            yield f"P{_INITIALS[t]}", t, True
            yield f"p{_INITIALS[t]}", t, False
        if len(t) >= 4:
            yield f"Q{t[:4]}", t, ask
        short = len(t) >= 3 and not set(_VOWELS) & set(t[1:])
        yield f"C{t[0]}", t, ask and short
        if ask:
            yield f"c{t[0]}", t, True
        if short:
            yield f"c{t[0]}", t, False
    apart = len(tokens) != 2  # two names of two words are not compared as a whole
    for whole in {"".join(tokens), "".join(reversed(tokens))}:
        if len(whole) <= 10:
            for v in deletions(whole, 1):
                yield "J" + v, whole, apart
        if len(whole) >= 9:
            for v in deletions(whole[:5], 1):
                yield "J^" + v, whole, apart
            for v in deletions(whole[-5:], 1):
                yield "J$" + v, whole, apart


def hot_links(rows: DataFrame, payload: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between holders of evidence that very many share.  ``rows``: rep, kind, evidence; ``payload``: rep, p.

    Holders of one evidence and signature are compared in blocks, each pair of blocks in a task of its own; a task leaves
    out pairs that its links have already brought together, so a group that belongs together costs little more than its size.
    """
    held = rows.join(payload, "rep")

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for rep, kind, evidence, p in zip(part["rep"], part["kind"], part["evidence"], part["p"]):
                for signature, token, ask in signatures(list(p["tokens"]), dict(p["weights"]), SURE[kind]):
                    out.append((rep, f"{evidence} {signature}", token, ask))
            yield pd.DataFrame(out, columns=["rep", "key", "token", "ask"])

    each = held.mapInPandas(sign, "rep bigint, key string, token string, ask boolean").groupBy("rep", "key", "token").agg(F.max("ask").alias("ask"))
    each = materialize(each, "p3-signatures")
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ask").alias("_any"), F.min("ask").alias("_all"))
    # under p and c, whole words ask for what is short, not for each other
    counts = counts.filter("n > 1 and _any").filter(~F.substring(F.substring_index("key", " ", -1), 1, 1).isin("p", "c") | ~F.col("_all")).select("key", "n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    split = each.join(counts, "key").withColumn("_own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    # every holder goes to the pairs of its block with all blocks; (x, y) and (y, x) are one task
    split = split.withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    split = split.select("rep", "token", "ask", "key", F.least("_own", "_with").alias("_x"), F.greatest("_own", "_with").alias("_y"))
    split = split.join(payload, "rep")

    ordered = split.repartition("key", "_x", "_y").sortWithinPartitions("key", "_x", "_y")
    return ordered.mapInPandas(_compare_blocks, "a bigint, b bigint").distinct()


def _compare_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key and blocks; at most two blocks are held at a time."""
    current, held = None, []
    for part in parts:
        out: list[tuple[int, int]] = []
        for at, row in zip(zip(part["key"], part["_x"], part["_y"]), zip(part["rep"], part["token"], part["ask"], part["p"])):
            if at != current:
                if len(held) > 1:
                    out += _meet(current[0].split(" ")[-1][0], held)
                current, held = at, []
            held.append(row)
        yield pd.DataFrame(out, columns=["a", "b"])
    yield pd.DataFrame(_meet(current[0].split(" ")[-1][0], held) if len(held) > 1 else [], columns=["a", "b"])


def _meet(kind: str, held: list[tuple[int, str, bool, dict]]) -> list[tuple[int, int]]:
    """Links between the holders of one signature of a kind (its first letter)."""
    root = list(range(len(held)))
    known: dict[tuple[str, str], bool] = {}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def near(x: str, y: str) -> bool:
        if kind == "T":
            return True
        if x == y:
            return kind == "J"  # equal tokens are compared where they meet
        pair = (x, y) if x < y else (y, x)
        if pair not in known:
            most = max(1, min(3, max(len(x), len(y)) // 5))
            known[pair] = distance(x, y, most) <= most if kind == "J" else alike(x, y) >= 0.6
        return known[pair]

    asked = [(j, *row) for j, row in enumerate(held) if kind not in "pc" or not row[2]]
    for i, (rep, token, ask, person) in enumerate(held):
        if not ask:
            continue
        for j, other, word, asks, them in asked:
            if (j < i and asks) or rep == other:
                continue
            x, y = top(i), top(j)
            if x != y and near(token, word) and linked(person, them):
                root[max(x, y)] = min(x, y)
    pairs = ((held[i][0], held[top(i)][0]) for i in range(len(held)))
    return [(a, b) for a, b in pairs if a != b]


def same_names(users: DataFrame, readings: DataFrame, places: DataFrame) -> DataFrame:
    """``member`` (user_id) and ``class`` of all users that share a person or organisation with another.

    ``places`` gives ``user_id`` and ``location`` of users with a known house number.
    """
    base = records(users, readings).join(places, "user_id", "left")
    # exact copies of name and evidence are one representative, so a name that a third of all rows have is joined once
    identity = ["name", "organisation", "box", "domain", "birth", "location"]
    base = materialize(base, "p3-records")
    reps = base.groupBy(*identity).agg(F.min("user_id").alias("rep"), F.first("tokens").alias("tokens"))
    strong = F.col("box").isNotNull() | F.col("domain").isNotNull() | F.col("birth").isNotNull() | F.col("location").isNotNull()
    copies = base.filter(strong).alias("l").join(reps.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in identity]).select(F.col("l.user_id").alias("a"), F.col("r.rep").alias("b")).filter("a <> b")
    reps = materialize(reps.filter(strong), "p3-reps")
    weights = reps.select("rep", F.explode("tokens").alias("token")).distinct()
    total = reps.select("rep").distinct().agg(F.count(F.lit(1)).alias("n"))
    common = weights.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total), F.lit(True))  # one row
    common = common.select("token", F.log(1 + F.col("n") / F.col("df")).alias("w"))
    weighted = reps.select(*identity, "rep", "tokens", F.explode("tokens").alias("token")).join(common, "token")
    full = weighted.groupBy(*identity, "rep").agg(F.first("tokens").alias("tokens"), F.map_from_entries(F.collect_set(F.struct("token", "w"))).alias("weights"))
    payload = materialize(full.select("rep", F.struct("tokens", "weights", "organisation", "box", "domain", "birth", "location").alias("p")), "p3-payload")
    return classes(copies.unionByName(links_of(payload)), "a", "b")


def links_of(payload: DataFrame, hot: int = HOT) -> DataFrame:
    """All links (a, b) that verification accepts, or so many of them that the same names are linked in the end.

    ``payload``: rep, p.  The holders of one evidence, up to ``hot`` of them, lie next to each other in a sorted partition.
    """
    kinds = [("box", "box"), ("domain", "domain"), ("birth", "birth"), ("place", "location")]
    evidence = F.filter(F.array(*(F.when(F.col(f"p.{c}").isNotNull(), F.struct(F.lit(k).alias("kind"), F.concat(F.lit(k + " "), F.col(f"p.{c}")).alias("evidence"))) for k, c in kinds)), lambda x: x.isNotNull())
    rows = payload.select("rep", F.explode(evidence).alias("e"), "p").select("rep", "e.kind", "e.evidence", "p")
    counts = rows.groupBy("evidence").agg(F.count(F.lit(1)).alias("_holders")).filter("_holders > 1")
    few = rows.join(counts.filter(F.col("_holders") <= hot).select("evidence"), "evidence").select("evidence", "rep", "p")
    links = few.repartition("evidence").sortWithinPartitions("evidence").mapInPandas(_compare, "a bigint, b bigint").distinct()
    many = rows.join(counts.filter(F.col("_holders") > hot).select("evidence"), "evidence").select("rep", "kind", "evidence")
    return links.unionByName(hot_links(many, payload))


def _compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, held = None, []
    for part in parts:
        out: list[tuple[int, int]] = []
        for evidence, rep, p in zip(part["evidence"], part["rep"], part["p"]):
            if evidence != current:
                out += small_links(held)
                current, held = evidence, []
            held.append((rep, p))
        yield pd.DataFrame(out, columns=["a", "b"])
    yield pd.DataFrame(small_links(held), columns=["a", "b"])


def linked(x: dict, y: dict) -> bool:
    """Whether two records are one person or organisation."""
    for against in ("box", "domain", "birth"):
        if x[against] and y[against] and x[against] != y[against]:
            return False
    if bool(x["organisation"]) != bool(y["organisation"]) and not (x["domain"] or y["domain"]):
        return False
    weights = {**dict(x["weights"]), **dict(y["weights"])}
    top = max(weights.values(), default=1.0)
    score = similarity(list(x["tokens"]), list(y["tokens"]), lambda t: weights.get(t, top))
    for kind, column in (("box", "box"), ("domain", "domain"), ("birth", "birth"), ("place", "location")):
        if x[column] and x[column] == y[column] and score >= SURE[kind]:
            return True
    return False

