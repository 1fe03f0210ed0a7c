import random

from tidemill.llm.spam import Page, judge_pages

RNG = random.Random(3)
SUBJECTS = ["the nightly load", "our broker", "a reviewer from the desk", "the second group", "the price feed", "whoever was on call", "the owner of the table"]
VERBS = ["wrote 12 small files into the lake", "could not resolve the code for 3 orders", "was late by 40 minutes", "moved most of its assets into cash", "asked why the rate fell by a third", "refunded an order placed in May", "confirmed that the field may be empty"]
ENDS = ["before noon", "since the host had restarted", "although nothing in the schema had changed", "and nobody noticed until June", "as the note already says", "because of the holiday"]
JA_A = ["夜間バッチは", "当番の担当者は", "東京の拠点では", "なお、基準価額は", "その結果、監視画面は"]
JA_B = ["小さなファイルを書き込みました", "三十分遅れて完了しました", "資産の一部を現金へ移しました", "価格が下がった理由を尋ねました", "愛称は空でもよいと確認しました"]
KEYS = ["wallet", "sale", "free shipping", "outlet", "gift card", "watch"]
JA_KEYS = ["財布", "送料無料", "激安", "通販", "口コミ"]


def prose(n):
    return " ".join(f"{RNG.choice(SUBJECTS).capitalize()} {RNG.choice(VERBS)} {RNG.choice(ENDS)}." for _ in range(n))


def prose_ja(n):
    return "".join(f"{RNG.choice(JA_A)}{RNG.choice(JA_B)}。" for _ in range(n))


def keywords(sep, words=KEYS, n=60):
    return sep.join(RNG.choice(words) for _ in range(n))


def url():
    return f"https://www.shop{RNG.randint(1, 99)}.example/item/{RNG.randint(1, 9999)}"


SPAM = {
    "keywords": keywords(" / "), "lines": keywords("\n"), "ja": keywords("・", JA_KEYS), "blank": keywords(" ", KEYS), "tags": " ".join("#" + RNG.choice(JA_KEYS) for _ in range(40)),
    "links": "\n".join(url() for _ in range(12)), "markdown": "\n".join(f"- [{RNG.choice(KEYS)} {RNG.choice(KEYS)}]({url()})" for _ in range(12)),
    "html": "<ul>" + "".join(f'<li><a href="{url()}">{RNG.choice(JA_KEYS)}</a></li>' for _ in range(12)) + "</ul>", "hidden": '<div style="display:none">' + keywords(" ") + "</div>",
    "images": "".join(f'<img alt="{RNG.choice(KEYS)} {RNG.choice(KEYS)}" src="/i/{i}.png">' for i in range(20)), "around": prose(1) + "\n" + keywords(", "),
    "spaced": " / ".join(" ".join(RNG.choice(["sale", "watch", "outlet"])) for _ in range(40)), "products": ", ".join(f"{RNG.choice(['red', 'blue'])} {RNG.choice(['leather', 'cotton'])} {RNG.choice(['hat', 'shoes'])} {RNG.randint(1, 9999)}" for _ in range(50)),
    "stuffed": "Looking for a wallet? Our wallet is the wallet for sale. Get wallet with sale, wallet with sale. The wallet and sale you want is wallet. " * 6,
    "bare": "\n".join(f"sale outlet - shop{i} dot example/item/{i}" for i in range(12)),
}
FAIR = {
    "csv": "day,fund,price\n" + "\n".join(f"2025-01-{i % 28 + 1:02d},FND{i:09d},{i * 3.5}" for i in range(60)), "records": "SKU;TITLE;PRICE\n" + "\n".join(f"{i:06d};wallet Ember;{i}.50;{i}" for i in range(60)),
    "log": "\n".join(f"2025-08-16T03:25:{i % 60:02d}Z INFO sink[1]: the batch wrote {i} rows" for i in range(40)), "trace": prose(1) + "\nTraceback (most recent call last):\n" + "\n".join(f'  File "/opt/jobs/a{i}.py", line {i}, in run' for i in range(30)),
    "code": "CREATE TABLE t (\n" + ",\n".join(f"  c_{i} STRING COMMENT 'price'" for i in range(30)) + "\n);", "todo": prose(1) + "\n" + "\n".join(f"* {RNG.choice(VERBS)}" for _ in range(20)),
    "notes": prose(4) + "\n" + url(), "references": "\n".join(f"[{i}] {url()}\n{prose(2)}" for i in range(6)), "short": "OK", "blank": " \n ", "emoji": "👍", "one link": "See " + url(),
}


def frame(spark):
    rows, n, want = [], 0, set()
    for group, bad in ((SPAM, True), (FAIR, False)):
        for _ in range(2):
            for text in group.values():
                rows.append((n, text, "x"))
                if bad:
                    want.add(n)
                n += 1
    for i in range(400):
        rows.append((1000 + i, prose(RNG.randint(1, 25)) if i % 2 else prose_ja(RNG.randint(1, 25)), "y"))
    rows += [(5000, None, None), (5001, "", None), (5002, prose(3000), None), (5003, keywords(" / ", n=20000), None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, candidate string"), want | {5003}


def test_planted_pages(spark):
    df, want = frame(spark)
    out = judge_pages(df, "doc_id", "text").toPandas()
    names = {i: k for i, k in enumerate([*SPAM, *SPAM, *FAIR, *FAIR])}
    found = set(out.doc_id[out.case])
    assert {names.get(i, i) for i in found ^ want} == set()
    assert out.doc_id.is_unique and not {5000, 5001} & set(out.doc_id)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert judge_pages(df, "doc_id", "text").count() == 0


def test_weights_of_a_page():
    page = Page("The load was late by an hour.\nwallet / sale / wallet")
    assert page.prose > 20 and page.keyword > 15 and page.keywords == 3


def test_stuffing_that_is_copied_or_alone_in_its_length(spark):
    RNG.seed(3)
    rows = [(i, prose(RNG.randint(1, 25)) if i % 2 else prose_ja(RNG.randint(1, 25))) for i in range(600)]
    rows += [(1000 + i, SPAM["stuffed"]) for i in range(400)]  # most of its band
    rows += [(2000, SPAM["stuffed"] * 60), (2001, prose(3000))]  # each alone in its band
    out = judge_pages(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").toPandas()
    assert set(out.doc_id[out.case]) == {*range(1000, 1400), 2000}


def test_the_curves_and_the_divergence_decide(spark):
    """Notes with a list of links read like prose: the check alone would take them in, their words do not let it."""
    RNG.seed(5)
    rows = [(i, prose(RNG.randint(8, 25)) if i % 2 else prose_ja(RNG.randint(8, 25))) for i in range(600)]
    listed = lambda n, make: "\n".join(f"[{i}] {url()}\n{make(2 if make is prose else 4)}" for i in range(n))
    rows += [(1000 + i, listed(8, prose if i % 2 else prose_ja)) for i in range(60)]
    rows += [(2000 + i, text) for i, text in enumerate(SPAM.values())]
    out = judge_pages(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").toPandas()
    notes, spam = out[out.doc_id.between(1000, 1999)], out[out.doc_id >= 2000]
    assert notes.left.mean() > 0.5 and not notes.case.any()  # the check would be wrong on most of them
    assert spam.case.mean() > 0.9 and out[out.doc_id < 1000].case.sum() == 0
    assert spam.divergence.min() > out[out.doc_id < 1000].divergence.median()
